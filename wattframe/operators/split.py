"""Seeded, disjoint train / validation / test splits with exact counts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ratio
from .grouping import ranked

NAMES = ("train", "validation", "test")

# Entities of a quick run. Nothing is limited unless a caller asks.
PRESET_LIMITS = {"train": 150, "validation": 40}


def shuffled_rank(ids: DataFrame, seed: int = 42, entity: str = "entity", by: Sequence[str] = ()) -> DataFrame:
    """0-based rank in a seeded order (the md5 of seed and id), per ``by``
    group. The first three digits of the digest make 4,096 even buckets."""
    keyed = ids.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(entity).cast("string"))))
    return ranked(keyed, F.substring("_key", 1, 3), ["_key", entity], by, "shuffle_rank").drop("_key")


def split_entities(
    ids: DataFrame,
    train: float = 0.6,
    validation: float = 0.2,
    test: float = 0.2,
    seed: int = 42,
    top_n: int | None = None,
    quality: str = "quality_score",
    cut: str = "each",
    entity: str = "entity",
) -> DataFrame:
    """Assign each entity to ``train``, ``validation`` or ``test``.

    ``top_n`` first keeps that many entities of the best ``quality``. With
    ``cut='each'`` every part's count is rounded down by itself; with
    ``cut='cumulative'`` the cut points are. Test takes what is left.
    """
    if not math.isclose(train + validation + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"ratios must add up to 1, not {train + validation + test}")
    if cut not in ("each", "cumulative"):
        raise ValueError(f"unknown cut {cut!r}")
    if top_n:
        ids = ids.orderBy(F.desc_nulls_last(quality), entity).limit(top_n)
    ids = ids.select(entity).distinct()
    n = ids.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    first = F.floor(n * F.lit(float(train)))
    if cut == "each":
        second = first + F.floor(n * F.lit(float(validation)))
    else:
        second = F.floor(n * F.lit(float(train + validation)))
    rank = F.col("shuffle_rank")
    return shuffled_rank(ids, seed, entity).select(
        entity,
        F.when(rank < first, NAMES[0]).when(rank < second, NAMES[1]).otherwise(NAMES[2]).alias("split"),
    )


def split_report(split: DataFrame) -> DataFrame:
    """Entities and their share per split; all three names appear."""
    counts = split.agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in NAMES], F.count(F.lit(1)).alias("_n")
    )
    return counts.unpivot(["_n"], list(NAMES), "split", "entities").select(
        "split", "entities", (100 * ratio("entities", "_n")).alias("pct")
    )


def training_entities(split: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities of the training and the validation part."""
    return split.filter(F.col("split").isin(*NAMES[:2])).select(entity)


def limits(n: int | None = None, preset: bool = False) -> Mapping[str, int]:
    """How many entities per split a run may use: ``n`` and a quarter of it (at
    least one) for validation, the preset, or by default no limit."""
    if n is not None:
        return {NAMES[0]: n, NAMES[1]: max(int(n * 0.25), 1)}
    return dict(PRESET_LIMITS) if preset else {}


def limit_entities(
    split: DataFrame, limit: Mapping[str, int] | None = None, seed: int = 42, entity: str = "entity"
) -> DataFrame:
    """The first entities of each split in its seeded order; a split without a
    limit stays whole, and without ``limit`` all do."""
    limit = limit or {}
    keep = F.lit(True)
    for name, n in limit.items():
        keep = keep & ((F.col("split") != name) | (F.col("shuffle_rank") < int(n)))
    return shuffled_rank(split, seed, entity, ["split"]).filter(keep).select(entity, "split")
