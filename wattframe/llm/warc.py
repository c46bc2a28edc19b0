"""WARC archives as a data source for Spark.

``register(spark)``, then ``df.write.format("warc").save(path)`` and
``spark.read.format("warc").load(path)``.

Reading plans partitions of about ``rangeBytes`` (an option): of several small archives,
or of a range of records of a large one, for which a writer notes where records
begin. Filters on record type and on headers are pushed
down: a record's header is parsed first, and the payload of a record that is
not wanted, or of any record if the schema asks for no payload, is neither read
nor decoded; its length in the header says where the next record begins.

Payloads are stored as HTTP responses with gzip as their content encoding, so an
archive can be skipped through without decoding. A task writes archives of about
``archiveBytes`` under names of its own attempt, and nothing is moved: what a write
has committed is one list beside them, with each archive's name, size and marks. In
a folder with such lists only archives that are on one are read, so attempts that
were lost do not count; in a folder without any, every archive is read, as a whole.
"""

from __future__ import annotations

import base64
import gzip
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from wattframe.session import shared_path

from .common import pick

#: Payloads shorter than this are stored again and again, never referred to.
LEAST_REVISIT = 1000
#: Bytes after which a writer begins another archive, and which a reading task takes.
ARCHIVE_BYTES = RANGE_BYTES = 64 << 20
#: A writer notes where a record begins about so often.
MARK_BYTES = 8 << 20
_LIST = "_archives-"
_LISTED = pa.schema([("name", pa.string()), ("size", pa.int64()), ("marks", pa.list_(pa.int64()))])
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_HEAD_READ = 4096
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
# Header lines of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = "none"


# -- one record ----------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{_NO_ID if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes | None) -> bytes:
    """A record as bytes. ``digest`` is the payload's SHA-1 in hexadecimal, ``size``
    its length; a revisit has both, but not the payload."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    body = b""
    if kind == "response":
        body = gzip.compress(payload or b"", 4, mtime=0)
        http += ["Content-Encoding: gzip", f"Content-Length: {len(body)}"]
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        # A header is one line.
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def values(fields: dict[str, str]) -> dict[str, object]:
    """The columns that a record's header gives."""
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    url = fields.get("warc-target-uri")
    if url is not None:
        for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
            url = url.replace(code, c)
    return {
        "page_id": _id(fields.get("warc-record-id")),
        "url": url,
        "record_type": fields.get("warc-type"),
        "refers_to": _id(fields.get("warc-refers-to")),
        "payload_digest": base64.b32decode(digest).hex() if digest else None,
        "payload_bytes": int(fields["x-payload-length"]) if "x-payload-length" in fields else None,
    }


def decode(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return gzip.decompress(body) if b"content-encoding: gzip" in head.lower() else body


def records(file: pa.NativeFile, wanted, payloads: bool, at: int = 0, end: int | None = None) -> Iterator[dict[str, object]]:
    """Values of the records between ``at``, where one begins, and ``end`` that
    ``wanted`` accepts, by their header alone. Counts of bytes that are not needed are
    passed over."""
    end = file.size() if end is None else end
    while at < end:
        raw = file.read_at(min(_HEAD_READ, end - at), at)
        while (cut := raw.find(b"\r\n\r\n")) < 0:
            more = file.read_at(min(len(raw), end - at - len(raw)), at + len(raw))
            if not more:
                raise ValueError("a WARC record ends in its header")
            raw += more
        fields = parse_head(raw[:cut])
        start, size = cut + 4, int(fields["content-length"])
        row = values(fields)
        if wanted(row):
            if payloads and row["record_type"] == "response":
                block = raw[start : start + size]
                if len(block) < size:
                    block += file.read_at(size - len(block), at + start + len(block))
                row["payload"] = decode(block)
            yield row
        at += start + size + 4


# -- the source ----------------------------------------------------------------------


@dataclass
class Archives(InputPartition):
    """Ranges of archives that one task reads: file, first byte and end."""

    ranges: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, range_bytes: int = RANGE_BYTES) -> None:
        self.path, self.names, self.range_bytes = path, schema.fieldNames(), range_bytes
        self.equal: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, membership and presence of header columns are decided by the
        reader; all else is left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name is None or name == "payload" or name not in _ARROW.names:
                yield f
            elif isinstance(f, EqualTo):
                self._only(name, {f.value})
            elif isinstance(f, In):
                self._only(name, set(f.value))
            elif isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                yield f

    def _only(self, name: str, some: set) -> None:
        self.equal[name] = self.equal[name] & some if name in self.equal else some

    def partitions(self) -> list[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        scheme = self.path[: len(self.path) - len(self.path.split("://", 1)[-1])]
        host = "" if scheme in ("", "file://") else self.path.split("://", 1)[1].split("/", 1)[0]
        full = lambda p: f"{scheme}{host}{p if p.startswith('/') or not host else '/' + p}"
        files = {i.path: i.size for i in found if i.is_file}
        listed: dict[str, dict[str, tuple[int, list[int]]]] = {}
        for p in files:
            folder, _, base = p.rpartition("/")
            if base.startswith(_LIST):
                for r in pq.read_table(p, filesystem=where, schema=_LISTED).to_pylist():
                    listed.setdefault(folder, {})[r["name"]] = r["size"], r["marks"]
        plan: list[Archives] = []
        total = 0
        for p in sorted(p for p in files if p.endswith(".warc")):
            folder, _, base = p.rpartition("/")
            if folder in listed and base not in listed[folder]:
                continue
            size, marks = listed[folder][base] if folder in listed else (files[p], [0])
            for start, end in zip(marks, [*marks[1:], size]):
                if not plan or total + end - start > self.range_bytes:
                    plan.append(Archives([]))
                    total = 0
                own, name = plan[-1].ranges, full(p)
                if own and own[-1][0] == name and own[-1][2] == start:
                    own[-1] = (name, own[-1][1], end)
                else:
                    own.append((name, start, end))
                total += end - start
        return plan or [Archives([])]

    def _wanted(self, row: dict[str, object]) -> bool:
        return all(row[k] in v for k, v in self.equal.items()) and all(row[k] is not None for k in self.present)

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([_ARROW.field(n) for n in self.names])
        rows, held = [], 0
        for name, start, end in partition.ranges:
            where, path = fs.FileSystem.from_uri(name)
            with where.open_input_file(path) as file:
                for row in records(file, self._wanted, "payload" in self.names, start, end):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    """Archives of one committed task: name, size and where records begin."""

    files: list[tuple[str, int, list[int]]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int = ARCHIVE_BYTES, mark_bytes: int = MARK_BYTES) -> None:
        self.path, self.archive_bytes, self.mark_bytes = path, archive_bytes, mark_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files, out, size, marks = [], None, 0, []

        def close() -> None:
            out.close()
            files[-1] = (files[-1][0], size, marks)

        for batch in iterator:
            for row in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
                if out is None or size > self.archive_bytes:
                    if out is not None:
                        close()
                    files.append((f"{uuid.uuid4().hex}.warc", 0, []))
                    out, size, marks = where.open_output_stream(f"{root}/{files[-1][0]}"), 0, []
                if not marks or size - marks[-1] >= self.mark_bytes:
                    marks.append(size)
                raw = record(row["page_id"], row["url"], row["record_type"], row["refers_to"], row["payload_digest"], row["payload_bytes"], row["payload"])
                out.write(raw)
                size += len(raw)
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        rows = [{"name": n, "size": z, "marks": m} for message in messages if message for n, z, m in message.files]
        with where.open_output_stream(f"{root}/{_LIST}{uuid.uuid4().hex}.parquet") as out:
            pq.write_table(pa.Table.from_pylist(rows, _LISTED), out)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name, _, _ in message.files if message else ():
                where.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Records of WARC archives; columns as in ``SCHEMA``, of which a reader's
    schema may name some."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to a folder, not replaced")
        return WarcWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)), int(self.options.get("markBytes", MARK_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark push filters down to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- pages ---------------------------------------------------------------------------


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """A record per row of ``pages``, with the columns of ``SCHEMA``.

    Of payloads that are equal and have at least ``least`` bytes, the row with the
    largest id is the response and the others revisit it; all shorter ones are
    responses. A null text is an empty payload. Rows that repeat the largest id
    are all responses; a row without an id revisits one that has an id.
    """
    some = pick(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    some = some.select("page_id", "url", payload.alias("payload"))
    some = some.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long"), "same": F.sha2("payload", 256)})
    # Copies meet by digest, counted before they are shuffled.
    groups = some.where(F.col("payload_bytes") >= least).groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Merged, not broadcast: groups of copies grow with the table.
    joined = some.join(groups.hint("merge"), "same", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives below ``path`` (by default a new place in the
    shared folder) and read them back: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``url``. Length and digest of a
    response are those of the payload as read; a revisit has them in its header,
    and only headers are read for it."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_path(spark, "warc")
    as_records(pages, **columns).write.format("warc").mode("append").save(path)
    archive = spark.read.format("warc").load(path)
    full = archive.where("record_type = 'response'").withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    again = spark.read.format("warc").schema(SCHEMA.removesuffix(", payload binary")).load(path).where("record_type = 'revisit'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return full.select(*names).unionByName(again.select(*names))
