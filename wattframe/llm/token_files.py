"""Token ids in binary files, with keyed access through a minimal perfect hash.

Texts are encoded in ascending id order, range by range; each task writes one
shard: a header, then the raw ids of its documents one after the other, 16 bits
each if the vocabulary allows, else 32. A directory (Parquet) names the
documents of each file in order.

The index is cut into parts by a hash of the key. A part holds a minimal perfect
hash of its keys: bit arrays, level by level, where a key sits at the first
level that gives it a place of its own; the number of bits before it is its
rank, from 0 without gaps. By rank lie a stored fingerprint of the key, which
tells keys that are not there, and shard, offset and length of its ids. A lookup
takes the same few steps however many keys there are.

Every file has a name of its own attempt, and only what committed tasks return
is looked at later, so attempts that were lost leave nothing that counts.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wattframe.session import shared_path

from .common import pick, released, slices, stored

#: Keys of one part of the index.
PART_KEYS = 50_000
#: Texts encoded at once, in bytes.
ENCODE_BYTES = 4 << 20
#: Bytes of pieces and ids that a worker keeps, and as many of the generation before.
CACHE_BYTES = 24 << 20
# What Python needs for such an entry besides the letters and ids.
_ENTRY_COST = 150
# Heads: magic, version, bytes of an id, end id; magic, version, keys, levels.
_SHARD_HEAD, _SHARD_START = "<4sHHI", 12
_INDEX_HEAD, _INDEX_START = "<4sIII", 16
_SHARD_MAGIC, _INDEX_MAGIC = b"TOKS", b"MPHI"
# Letters that NFC leaves alone unless marks combine with them, and whose small
# letters are among them: without U+0130.
_LATIN = "ªµºÀ-ÖØ-öø-įı-ſ"
_PLAIN = f"^[!-~{_LATIN}]*$"
_WORD = f"^[a-z{_LATIN}]+$"
# Where the tokenizer cuts plain chunks, once in small letters.
_PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+)"
_BLOCK = 1 << 17
_U = np.uint64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# -- encoding ------------------------------------------------------------------------


def _plain(chunks: pa.Array) -> pa.Array:
    """Which chunks have ASCII and Latin letters only, and nothing like a special token."""
    return pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.invert(pc.match_substring(chunks, "<|")))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """A tokenizer file of the ``tokenizers`` library.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its chunks in order. The distinct chunks of some texts are
    cut once, and their distinct pieces looked up once; a worker keeps the ids of
    pieces in a store of bounded bytes.
    ``width`` is the number of bytes of an id.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self.of_words = self._of_words(spec)
        # White space at the ends of a text leaves empty chunks.
        self.words: dict[str, bytes] = {"": b""}
        self.old_words: dict[str, bytes] = {}
        self.held = 0

    def _of_words(self, spec: dict):
        """The same model for pieces already normalized and cut, with spaces between: the
        library need not do either again. Other kinds of tokenizers do it all."""
        from tokenizers import Tokenizer, pre_tokenizers

        kinds = lambda part, of: [x["type"] for x in (spec[part] or {}).get(of, ())]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        if kinds("normalizer", "normalizers") != ["NFC", "Replace", "Lowercase"] or kinds("pre_tokenizer", "pretokenizers") != ["Split", "ByteLevel"]:
            return self.tokenizer
        if cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return self.tokenizer
        made = Tokenizer(self.tokenizer.model)
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return made

    def keep(self, names: list[str], ids: list[bytes]) -> None:
        self.words.update(zip(names, ids))
        self.held += sum(map(len, names)) + sum(map(len, ids)) + _ENTRY_COST * len(names)

    def ask(self, parts: list[str], single: bool) -> None:
        """Have the library encode ``parts``. Those that are one word each (``single``) go
        as one text with spaces between: every word's ids end in one that ends a
        word, which tells them apart again."""
        for k in range(0, len(parts), 1024):
            some = parts[k : k + 1024]
            if single:
                flat = np.array(self.of_words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
                ends = np.flatnonzero(self.ends_word[flat]) + 1
                if len(ends) != len(some):
                    self.ask(some, False)
                    continue
                ends = [0, *(ends * self.width).tolist()]
            else:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                flat = np.fromiter(chain.from_iterable(ids), self.kind)
                ends = list(accumulate([len(x) * self.width for x in ids], initial=0))
            raw = flat.tobytes()
            self.keep(some, list(map(raw.__getitem__, map(slice, ends, ends[1:]))))

    def of_pieces(self, pieces: pa.Array) -> list[bytes]:
        """Packed ids of distinct pieces."""
        names = _strings(pieces)
        found = list(map(self.words.get, names))
        new = [k for k, ids in enumerate(found) if ids is None]
        if not new:
            return found
        if self.old_words:
            # What comes up again moves from the earlier store to the new one.
            asked = [names[k] for k in new]
            old = list(map(self.old_words.get, asked))
            again = [k for k, ids in enumerate(old) if ids is not None]
            self.keep([asked[k] for k in again], [old[k] for k in again])
            unknown = pieces.take(pa.array([k for k, ids in zip(new, old) if ids is None], pa.int64()))
        else:
            unknown = pieces.take(pa.array(new))
        plain = _plain(unknown)
        self.ask(_strings(unknown.filter(plain)), True)
        self.ask(_strings(unknown.filter(pc.invert(plain))), False)
        for k in new:
            found[k] = self.words[names[k]]
        return found

    def joined(self, flat: np.ndarray, size: np.ndarray, index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows one after the other, and the number of ids of each row. ``flat`` has
        the ids of parts, ``size`` of them each; row i is made of the parts
        ``index[offsets[i]:offsets[i + 1]]``."""
        start = np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(size[index])))
        out = np.empty(ends[-1], self.kind)
        for k in range(0, len(index), _BLOCK):
            some = index[k : k + _BLOCK]
            low, high = ends[k], ends[k + len(some)]
            out[low:high] = flat[np.repeat(start[some] - ends[k : k + len(some)], size[some]) + np.arange(low, high)]
        return out, np.diff(ends[offsets])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a column (null as empty) one after the other, and the number
        of ids of each text.

        A plain chunk is cut where the tokenizer cuts it, so words are found again
        whatever marks, digits and hyphens are around them. Other words may change
        once normalized, as may special tokens when cut; these chunks stay whole.
        """
        if self.held > CACHE_BYTES:
            self.words, self.old_words, self.held = {"": b""}, self.words, 0
        cut = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        some = cut.values.dictionary_encode()
        # The tokenizer lowers letters itself; doing so before finds more words again.
        plain = _plain(some.dictionary)
        chunks = pc.if_else(plain, pc.utf8_lower(some.dictionary), some.dictionary)
        mixed = pc.and_(plain, pc.invert(pc.match_substring_regex(chunks, _WORD)))
        spaced = pc.replace_with_mask(chunks, mixed, pc.replace_substring_regex(chunks.filter(mixed), _PIECE, r"\1 "))
        parts = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))
        pieces = parts.values.dictionary_encode()
        packed = self.of_pieces(pieces.dictionary)
        flat = np.frombuffer(b"".join(packed), self.kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        flat, size = self.joined(flat, size, pieces.indices.to_numpy(), parts.offsets.to_numpy())
        return self.joined(flat, size, some.indices.to_numpy(), cut.offsets.to_numpy())

    def encode(self, docs: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        flat, n = self.ids(pa.array(docs, pa.string()))
        raw, ends = flat.tobytes(), [0, *(np.cumsum(n) * self.width).tolist()]
        return list(map(raw.__getitem__, map(slice, ends, ends[1:])))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``path`` and return the directory: ``shard`` (in id
    order), ``file``, ``doc_id``, ``copy`` (0 unless the id repeats), ``at`` (ids
    before it in its shard) and ``n`` (its ids, with the end id).

    A null text is empty: its only id is the end id. Null ids come first. Rows
    that repeat an id follow each other and are numbered. An empty table gives
    no shard.
    """
    where, root = _open(path)
    where.create_dir(root, recursive=True)
    some = pick(docs, id=id_col, text=text_col)
    order = ["id", F.xxhash64("text"), "text"]
    ranged = some.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    schema = "shard int, file string, id long, again long, at long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), None
        coder = encoder(tokenizer)
        name = f"{path}/tokens-{shard:06d}-{uuid.uuid4().hex}.bin"
        at, last, again = 0, (), 0
        with released():
            try:
                for batch in batches:
                    for part in slices(batch, "text", ENCODE_BYTES):
                        ids = part.column("id").to_pylist()
                        if out is None:
                            target, file = _open(name)
                            out = target.open_output_stream(file)
                            out.write(struct.pack(_SHARD_HEAD, _SHARD_MAGIC, 1, coder.width, end_id))
                        flat, n = coder.ids(part.column("text"))
                        out.write(np.insert(flat, np.cumsum(n), end_id).tobytes())
                        n += 1
                        ends = at + np.cumsum(n)
                        at_, again_ = ends - n, []
                        for i in ids:
                            again = again + 1 if (i,) == last else 0
                            last = (i,)
                            again_.append(again)
                        at, k = int(ends[-1]) if ids else at, len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard] * k, pa.int32()), pa.array([name] * k, pa.string()), part.column("id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (again_, at_, n))],
                            ["shard", "file", "id", "again", "at", "n"],
                        )
            finally:
                if out is not None:
                    out.close()

    held = stored(ranged.mapInArrow(run, schema), "token-directory")
    # An id whose rows reach over several shards goes on counting: only the ends of
    # shards can hold such ids.
    each = held.groupBy("id", "shard").agg(F.count("*").alias("c"))
    over = each.groupBy("id").agg(F.count("*").alias("shards")).where("shards > 1").select(F.col("id").alias("i"))
    before = Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.join(over, F.col("id").eqNullSafe(F.col("i"))).select(F.col("id").alias("i"), F.col("shard").alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("carry"))
    full = held.join(carry, F.col("id").eqNullSafe(F.col("i")) & (F.col("shard") == F.col("s")), "left")
    return full.select("shard", "file", F.col("id").alias("doc_id"), (F.col("again") + F.coalesce("carry", F.lit(0))).alias("copy"), "at", "n")


# -- minimal perfect hash ------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_hashes(ids: pd.Series, copies: np.ndarray) -> np.ndarray:
    """64-bit hash of each key (id, copy); null ids have one of their own."""
    null = ids.isna().to_numpy()
    value = ids.fillna(0).to_numpy().astype(np.int64).astype(np.uint64)
    return _mix(value + np.asarray(copies).astype(np.uint64) * _U(0xD1342543DE82EF95), 1) ^ np.where(null, _U(0x5851F42D4C957F2D), _U(0))


class PerfectHash:
    """Ranks for a set of distinct 64-bit hashes, 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        ones = [np.bitwise_count(words).astype(np.int64) for words in levels]
        total = np.cumsum([0, *(int(o.sum()) for o in ones)])
        self.before = [start + np.cumsum(o) - o for start, o in zip(total.tolist(), ones)]
        self.size = int(total[-1])

    @classmethod
    def build(cls, keys: np.ndarray, most_levels: int = 60) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == most_levels:
                raise ValueError("keys are not distinct")
            bits = 64 * max(1, -(-2 * len(left) // 64))
            place = (_mix(left, len(levels) + 2) % _U(bits)).astype(np.int64)
            alone = np.bincount(place, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(levels)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key; some rank, or -1, for one that was not in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            place = (_mix(keys[todo], level + 2) % _U(64 * len(words))).astype(np.int64)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[todo[hit]] = (before[place >> 6] + below)[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u4")])


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 99) >> _U(32)).astype(np.uint32)


def _part(directory: DataFrame, parts: int) -> DataFrame:
    return directory.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int"))


def write_index(directory: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Write the index of ``directory`` below ``path``: ``part`` and ``file`` of each
    part, and the number of parts."""
    where, root = _open(path)
    where.create_dir(root, recursive=True)
    parts = max(1, -(-directory.count() // PART_KEYS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = key_hashes(pdf["doc_id"], pdf["copy"].to_numpy())
        hashed = PerfectHash.build(keys)
        entries = np.zeros(len(keys), _ENTRY)
        at = hashed.rank(keys)
        for name, column in (("print", _prints(keys)), ("shard", pdf["shard"]), ("at", pdf["at"]), ("n", pdf["n"])):
            entries[name][at] = column
        part = int(pdf["part"].iloc[0])
        name = f"{path}/index-{part:06d}-{uuid.uuid4().hex}.mph"
        target, file = _open(name)
        with target.open_output_stream(file) as out:
            out.write(struct.pack(_INDEX_HEAD, _INDEX_MAGIC, 1, len(keys), len(hashed.levels)))
            out.write(np.array([len(w) for w in hashed.levels], "<u8").tobytes())
            for words in hashed.levels:
                out.write(words.tobytes())
            out.write(entries.tobytes())
        return pd.DataFrame({"part": [part], "file": [name]})

    made = _part(directory.select("doc_id", "copy", "shard", "at", "n"), parts).groupBy("part").applyInPandas(run, "part int, file string")
    return stored(made, "token-index"), parts


def _read_index(name: str) -> tuple[PerfectHash, np.ndarray]:
    where, file = _open(name)
    with where.open_input_stream(file) as stream:
        raw = stream.read()
    magic, _, n, levels = struct.unpack_from(_INDEX_HEAD, raw)
    if magic != _INDEX_MAGIC:
        raise ValueError(f"{name} is no index")
    at = _INDEX_START
    sizes = np.frombuffer(raw, "<u8", levels, at).tolist()
    at += 8 * levels
    words = []
    for size in sizes:
        words.append(np.frombuffer(raw, "<u8", size, at))
        at += 8 * size
    return PerfectHash(words), np.frombuffer(raw, _ENTRY, n, at)


def lookup(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """``doc_id`` and ``copy`` of ``keys`` with ``shard``, ``at`` and ``n`` from the
    index. Keys that it does not hold are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashed, entries = _read_index(pdf["file"].iloc[0])
        key = key_hashes(pdf["doc_id"], pdf["copy"].to_numpy())
        rank = hashed.rank(key)
        there = rank >= 0
        there[there] = entries["print"][rank[there]] == _prints(key[there])
        found, some = entries[rank[there]], pdf[there]
        return pd.DataFrame({"doc_id": some["doc_id"], "copy": some["copy"], "shard": found["shard"].astype("i8"), "at": found["at"].astype("i8"), "n": found["n"].astype("i8")})

    asked = _part(keys, parts).join(index, "part").select("part", "file", "doc_id", "copy")
    return asked.groupBy("part").applyInPandas(run, "doc_id long, copy long, shard int, at long, n long")


def read_ids(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` (``shard``, ``at``, ``n`` and others) with ``ids``: the ids read from
    the shard's file, as little-endian unsigned 32-bit integers."""
    named = found.join(files.select("shard", "file"), "shard")
    ordered = named.repartition("shard").sortWithinPartitions("shard", "at")
    schema = ordered.withColumn("ids", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, width = None, None, 4
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 512):
                part, got = batch.slice(k, 512), []
                for path, at, n in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("file", "at", "n"))):
                    if path != name:
                        where, inner = _open(path)
                        file, name = where.open_input_file(inner), path
                        magic, _, width, _ = struct.unpack(_SHARD_HEAD, file.read_at(_SHARD_START, 0))
                        if magic != _SHARD_MAGIC:
                            raise ValueError(f"{path} is no shard of token ids")
                    raw = file.read_at(n * width, _SHARD_START + at * width)
                    got.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, "ids"])

    return ordered.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write shards and index below ``path`` (by default a new place in the shared
    folder), look every document up by its key, and read its ids back:
    ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``
    and ``shard``."""
    path = path or shared_path(docs.sparkSession, "tokens")
    directory = write_shards(docs, tokenizer, end_id, f"{path}/shards", id_col, text_col)
    index, parts = write_index(directory, f"{path}/index")
    shards = directory.groupBy("shard", "file").agg(F.sum("n").alias("ids"))
    # A row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored(shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token-shards")
    found = lookup(directory.select("doc_id", "copy"), index, parts)
    read = read_ids(found, shards)
    placed = read.join(shards.select("shard", "start"), "shard")
    return placed.select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard"
    )
