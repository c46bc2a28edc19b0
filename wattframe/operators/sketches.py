"""Small summaries that are stored, extended and merged without the rows.

Per entity and day a quantile sketch of the readings, per day a sketch of the
distinct entities, both with exact counts. New readings add their own rows to the
stored table; a question about any span or set of entities merges what is there.
Sketches are built by Spark's own aggregates, combined before the shuffle, so a day
or an entity of any size costs one sketch per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.columns import reading

#: Items that a quantile sketch keeps per level: rank errors of about 1.65 % at 200,
#: falling nearly in proportion. Up to so many readings are kept as they are.
K = 400
#: Logarithm of the registers of a distinct count: an error of about 1.6 % at 12.
LG = 12


def reading_sketches(df: DataFrame, entity: str = "entity", ts: str = "ts", value: str = "value", k: int = K) -> DataFrame:
    """Per (entity, day): ``rows``, ``readings`` (not missing), ``total``, ``low``, ``high``
    and ``sketch``, a quantile sketch of the readings (null without any).

    Rows without a time have a day of their own, null; a null entity is one.
    """
    v = F.col("_v")
    some = df.select(entity, F.col(ts).cast("date").alias("day"), reading(value).alias("_v"))
    return some.groupBy(entity, "day").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("readings"),
        F.sum(v).alias("total"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, k)).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ("entity",), k: int = K) -> DataFrame:
    """One row per group of ``by`` (one row without) with the same columns: what
    ``reading_sketches`` would say of all the rows together. Merging in any parts
    and order gives the same counts, and quantiles within the same error."""
    held = F.col("sketch").isNotNull()
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("readings").alias("readings"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.when(F.count("sketch") > 0, F.kll_merge_agg_double(F.when(held, F.col("sketch")), k)).alias("sketch"),
    )


def sketched_quantiles(merged: DataFrame, probs: Mapping[str, float], keep: Sequence[str] = ("entity",)) -> DataFrame:
    """``keep``, ``readings``, ``mean`` and a column per entry of ``probs``: a reading
    that has about this share of the readings at or below it. Exact up to ``K``
    readings; NULL without any."""
    return merged.select(
        *keep,
        "readings",
        (F.col("total") / F.nullif(F.col("readings"), F.lit(0))).alias("mean"),
        *[F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(name) for name, p in probs.items()],
    )


def profile_sketches(df: DataFrame, entity: str = "entity", ts: str = "ts", lg: int = LG) -> DataFrame:
    """Per day: ``total_rows``, ``missing_cells`` over all columns, and ``entities``, a
    sketch of the distinct entities."""

    def missing(f: T.StructField):
        c = F.col(f"`{f.name}`")
        return F.count_if(c.isNull() | F.isnan(c)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.count_if(c.isNull())

    cells = F.lit(0).cast("long")
    for f in df.schema.fields:
        cells = cells + missing(f)
    keyed = df.groupBy(F.col(ts).cast("date").alias("day"))
    return keyed.agg(F.count(F.lit(1)).alias("total_rows"), cells.alias("missing_cells"), F.hll_sketch_agg(F.col(entity).cast("string"), lg).alias("entities"))


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """One row over all days: ``total_rows``, ``missing_cells``, and about how many
    ``entities`` (exact for small numbers)."""
    return sketches.agg(
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("missing_cells"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("entities")), F.lit(0)).alias("entities"),
    )


def extend(sketches: DataFrame, path: str) -> None:
    """Add the sketches of new rows to the stored ones. A day may come in parts: its
    rows then stand side by side until they are merged."""
    sketches.write.mode("append").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
