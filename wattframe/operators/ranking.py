"""Top-k reports: Spark keeps k rows per task, never a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .resample import reading_counts

# Metrics where more is better.
HIGHER_IS_BETTER = ("skill", "skill_w168", "skill_pct")


def top_by_readings(df: DataFrame, n: int = 10, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """The ``n`` entities with the most readings."""
    return reading_counts(df, entity, ts).orderBy(F.desc("readings"), entity).limit(n)


def best_and_worst(df: DataFrame, k: int = 5, metric: str = "rmse", entity: str = "entity") -> DataFrame:
    """The ``k`` smallest and the ``k`` largest of a metric, tagged ``side``."""
    known = df.filter(F.col(metric).isNotNull())
    best = known.orderBy(F.asc(metric), entity).limit(k).withColumn("side", F.lit("best"))
    worst = known.orderBy(F.desc(metric), entity).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def rank_entities(
    df: DataFrame, metric: str = "nrmse", worst_first: bool = True, k: int = 20, entity: str = "entity"
) -> DataFrame:
    """The ``k`` worst (or best) entities by a metric; missing ones come last."""
    higher = metric in HIGHER_IS_BETTER
    descending = worst_first != higher
    by = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    return df.orderBy(by, entity).limit(k)
