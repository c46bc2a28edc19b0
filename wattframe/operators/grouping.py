"""Helpers that keep grouped work bounded when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A group of up to so many narrow rows is sorted by one task.
GROUP_LIMIT = 4_000_000
# From this limit on, a table of hot groups (at most one row per ``limit`` rows) is
# small enough for every task to have.
BROADCAST_LIMIT = 1_000_000


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of the columns two by two, where a null equals a null."""
    same = F.lit(True)
    for a, b in zip(left, right):
        same = same & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return same


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int, size: str | None = None) -> DataFrame:
    """``_hot0``, ``_hot1`` and so on: the ``keys`` of groups of more than ``limit`` rows,
    and their ``size``, if named."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = sizes.select(*[F.col(f"`{k}`").alias(f"_hot{i}") for i, k in enumerate(keys)], *([F.col("_n").alias(size)] if size else []))
    return F.broadcast(hot) if limit >= BROADCAST_LIMIT else hot


def split_hot(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of groups up to ``limit`` rows, and those of larger groups (with the
    group's size as column ``size``, if named).

    Sizes come from a partial aggregation over the keys alone. The limit decides
    on the plan only, never on the rows of a result. Where no group is larger,
    adaptive execution drops the second branch. A null key is a key.
    """
    keys = list(keys)
    names = [f"_hot{i}" for i in range(len(keys))]
    hot = hot_groups(df, keys, limit, size)
    small = df.join(hot, null_safe(keys, names), "left_anti")
    large = df.join(hot, null_safe(keys, names), "inner" if size else "left_semi")
    return small, large.drop(*names)


def join_per_key(detail: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a big table (left) with one that has few rows per key.

    A key may hold a third of ``detail``. Spark cuts such a partition by itself
    (adaptive skew handling covers inner, left and semi joins on this side) and
    repeats only the rows of that key, so nothing is copied for the others. A null
    key is a key.
    """
    names = [f"_key{i}" for i in range(len(on))]
    keyed = table.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(on, names)], *[F.col(f"`{c}`") for c in table.columns if c not in on])
    return detail.join(keyed, null_safe(on, names), how).drop(*names)


def merge_single_rows(*parts: DataFrame) -> DataFrame:
    """One row out of several single-row tables with distinct columns, no join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def ranked(df: DataFrame, bucket: Column, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """0-based rank of each row in the order ``(bucket, *order)``.

    Works in two levels: row counts per bucket, prefix sums over those counts
    (one row per bucket), and a row number inside each bucket. ``bucket`` has
    to be non-decreasing in the wanted order and take a bounded number of
    values, so no task ever holds the whole table.
    """
    by = list(by)
    keyed = df.withColumn("_bkt", bucket)
    counts = keyed.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bkt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_bkt").orderBy(*order)
    # Null keys have a rank of their own.
    same = F.col("k._bkt").eqNullSafe(F.col("o._bkt"))
    for b in by:
        same = same & F.col(f"k.`{b}`").eqNullSafe(F.col(f"o.`{b}`"))
    placed = keyed.alias("k").join(offsets.alias("o"), same).select("k.*", "o._off")
    return (
        placed
        .withColumn(name, F.row_number().over(inside).cast("long") - 1 + F.col("_off"))
        .drop("_bkt", "_off")
    )
