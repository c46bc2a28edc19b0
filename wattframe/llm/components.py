"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import by_rows, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (least node it reaches) for every node of
    ``links`` (two columns of type long). Self links and repeats do no harm; no
    links give an empty table.

    Alternating stars: each node links its larger neighbours, then all its
    smaller ones, to the least node it knows, until each hangs on the least node
    of its component. A step is written to the shared folder; its aggregations and
    joins are on narrow rows, in tasks by the number of links, and links that are
    stars already take no step.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    size = links.count()
    edges = stored(by_rows(links.distinct(), size), "links")
    while not _stars_only(edges, size):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = by_rows(large.where("u != v"), size)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = by_rows(small, size).unionByName(by_rows(low.select("u", F.col("m").alias("v")), size))
        edges = stored(by_rows(small.distinct(), size), "links")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(by_rows(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), size))


def _stars_only(edges: DataFrame, size: int) -> bool:
    """Whether each ``u`` has one ``v`` only, which is no ``u`` itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_rows(ends.where("up > 1 or up = 1 and down = 1"), size).agg(F.count("*")).first()[0] == 0
