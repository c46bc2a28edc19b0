"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.session import shared_path


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, ``pick(docs, id="doc_id")``.

    Columns are found by their exact spelling, so further columns whose names
    differ in case only, or clash with the new names, do no harm.
    """
    held = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return held.select(*[F.col(f"_{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def whole(df: DataFrame, box: str = "row") -> DataFrame:
    """All columns as one struct, by position, next to nothing else: it can be
    carried through joins whatever its fields are called."""
    held = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return held.select(F.struct(*held.columns).alias(box))


def unboxed(df: DataFrame, names: list[str], box: str = "row") -> DataFrame:
    """The columns that ``whole`` packed, under their own names again."""
    return df.select(*[F.col(f"{box}._{i}") for i in range(len(names))]).toDF(*names)


def field(names: list[str], name: str, box: str = "row") -> Column:
    return F.col(f"{box}._{names.index(name)}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and
    every later reader sees the same rows even after executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return reread(df.sparkSession, path, df)


def by_rows(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df`` with a task for ``per_task`` rows, or for each core if those are more:
    a step over few narrow rows shall not cost a task for each shuffle partition."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most_bytes`` of text each (a
    single longer text is a part of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start or not size:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


@contextmanager
def released() -> Iterator[None]:
    """Give memory back to the machine behind a task: workers go on living, and
    what one task needed for a while would count against all later ones."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def to_batches(schema: pa.Schema, parts: Iterable[list]) -> Iterator[pa.RecordBatch]:
    for columns in parts:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)
