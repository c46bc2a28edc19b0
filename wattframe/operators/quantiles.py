"""Exact quantiles that never gather an unbounded group in one task.

Groups of bounded size are sorted once. In a larger group values are counted
per coarse order-preserving bucket first, then per digit of their order keys in
the buckets that hold a wanted rank, and only what shares a digit with such a
rank is looked at value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DIGIT, order_bucket, order_key, reading
from .grouping import GROUP_LIMIT, join_per_key, split_hot


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
    digit: int = DIGIT,
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (linear
    interpolation between neighbours). NULL and NaN values do not count, and a
    group without any other value has no row."""
    by = list(by)
    rows = df.select(*by, reading(value).alias("_v")).filter("_v is not null")
    if not by:
        return _bucketed_groups(rows, probs, by, digit)
    small, large = split_hot(rows, by, limit)
    return _sorted_groups(small, probs, by).unionByName(_bucketed_groups(large, probs, by, digit))


def _sorted_groups(rows: DataFrame, probs: Mapping[str, float], by: list[str]) -> DataFrame:
    part = ", ".join(f"`{b}`" for b in by)
    ranked = rows.selectExpr(
        "*",
        f"row_number() over (partition by {part} order by _v) - 1 as _r",
        f"count(*) over (partition by {part}) as _n",
    )
    parts = []
    for name, p in probs.items():
        h = f"({float(p)!r}D * (_n - 1))"
        parts.append(
            f"sum(case when _r = floor({h}) then _v * (1 - ({h} - floor({h}))) "
            f"when _r = floor({h}) + 1 and {h} > floor({h}) then _v * ({h} - floor({h})) end) as `{name}`"
        )
    return ranked.groupBy(*by).agg(*[F.expr(x) for x in parts])


def _bucketed_groups(rows: DataFrame, probs: Mapping[str, float], by: list[str], digit: int = DIGIT) -> DataFrame:
    """Rank selection by digits: counts per coarse bucket tell which buckets hold a
    wanted rank, counts per digit of the values' order keys which part of those,
    and only the values of these parts are ordered, 2**23 distinct ones at most."""
    part = ", ".join(f"`{b}`" for b in by) or "0"
    cells = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumns({"_b": order_bucket("_v"), "_d": F.shiftright(order_key("_v"), digit)})

    # Wanted ranks: one row per (group, bucket).
    picks = []
    for name, p in probs.items():
        h = f"({float(p)!r}D * (_n - 1))"
        for up, share in ((0, f"1 - ({h} - floor({h}))"), (1, f"{h} - floor({h})")):
            picks.append(f"named_struct('name', '{name}', 'rank', floor({h}) + {up}, 'share', {share})")
    named = [f"`{b}`" for b in by]
    inside = "filter({}, r -> r.share > 0 and r.rank >= _below and r.rank < _below + _bc) as _picks"
    below = "coalesce(sum(_bc) over (partition by {} order by {} rows between unbounded preceding and 1 preceding), 0)"
    buckets = (
        cells.groupBy(*by, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .selectExpr("*", below.format(part, "_b") + " as _below", f"sum(_bc) over (partition by {part}) as _n")
        .selectExpr(*named, "_b", "_below as _start", inside.format(f"array({', '.join(picks)})"))
        .filter("size(_picks) > 0")
    )
    parts = (
        join_per_key(cells, buckets, [*by, "_b"], "inner")
        .groupBy(*by, "_b", "_d", "_start", "_picks")
        .agg(F.sum("_c").alias("_bc"))
        .selectExpr("*", "_start + " + below.format(f"{part}, _b", "_d") + " as _below")
        .selectExpr(*named, "_d", "_below", inside.format("_picks"))
        .filter("size(_picks) > 0")
    )
    upto = Window.partitionBy(*by, "_d").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        join_per_key(cells.drop("_b"), parts, [*by, "_d"], "inner")
        .withColumn("_end", F.col("_below") + F.sum("_c").over(upto))
        .selectExpr(*named, "_v", "explode(filter(_picks, r -> r.rank < _end and r.rank >= _end - _c)) as _p")
    )
    return hits.groupBy(*by).agg(
        *[F.expr(f"sum(case when _p.name = '{name}' then _v * _p.share end) as `{name}`") for name in probs]
    )


def exact_medians(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Medians of several columns of one table: ``columns`` maps output name to
    column. The columns are stacked, so it is still one pass of the above."""
    by = list(by)
    cells = F.array(*[F.struct(F.lit(n).alias("name"), reading(c).alias("v")) for n, c in columns.items()])
    stacked = df.select(*by, F.explode(cells).alias("_s")).select(
        *by, F.col("_s.name").alias("_name"), F.col("_s.v").alias("_x")
    )
    med = exact_quantiles(stacked, "_x", {"_med": 0.5}, [*by, "_name"])
    return med.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_med"))).alias(n) for n in columns])
