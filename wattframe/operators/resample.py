"""Time bins and per-entity reading statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import bin_start, day_block, duration, reading
from .grouping import join_per_key, merge_single_rows
from .quantiles import exact_quantiles
from .series import BLOCK_DAYS


#: Bins of a gap that are written out at a time.
FILL_BLOCK = 8192


def _interval(freq: str):
    n, unit = duration(freq).split()
    return F.expr(f"INTERVAL '{n}' {unit.upper()}")


def resample_mean(
    df: DataFrame,
    freq: str = "3H",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    meter: str = "meter",
) -> DataFrame:
    """Mean of the non-missing readings per (entity, bin) as FLOAT; bins
    without one are dropped. ``meter`` is the earliest non-missing one in the
    bin, where the column exists."""
    cols = [F.col(entity), bin_start(ts, freq).alias("_bin"), reading(value).alias("_v")]
    if meter not in df.columns:
        mean = df.select(*cols).groupBy(entity, F.col("_bin").alias(ts)).agg(F.avg("_v").cast("float").alias(value))
        return mean.filter(F.col(value).isNotNull())
    # Per meter first, with numbers and times only, so that rows are hashed; what
    # is left for the meter's name is a row per bin and meter.
    rows = df.select(*cols, F.col(meter).alias("_m"), F.when(F.col(meter).isNotNull(), F.col(ts)).alias("_t"))
    per = rows.groupBy(entity, "_bin", "_m").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_c"), F.min("_t").alias("_t"))
    named = F.min(F.when(F.col("_t").isNotNull(), F.struct("_t", "_m"))).getField("_m")
    mean = F.try_divide(F.sum("_s"), F.sum("_c")).cast("float")
    return (
        per.groupBy(entity, F.col("_bin").alias(ts))
        .agg(mean.alias(value), named.alias(meter))
        .filter(F.col(value).isNotNull())
    )


def resample(
    df: DataFrame,
    freq: str = "1D",
    how: str = "mean",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """``mean``, ``sum`` or ``median`` per (entity, bin), with every bin between
    an entity's first and last reading: an empty bin is missing, or 0 for sums.

    Readings are aggregated first. Each bin then emits itself and the empty
    bins up to the next one, so no calendar table is built or joined. A long gap
    is written out in blocks of ``FILL_BLOCK`` bins, never as one array.
    """
    if how not in ("mean", "sum", "median"):
        raise ValueError(f"unknown aggregate {how!r}")
    step = _interval(freq)
    rows = df.filter(F.col(ts).isNotNull()).select(
        F.col(entity), bin_start(ts, freq).alias("_bin"), reading(value).alias("_v")
    )
    keys = [entity, "_bin"]
    if how == "median":
        bins = join_per_key(rows.groupBy(*keys).agg(F.count("_v").alias("_n")), exact_quantiles(rows, "_v", {"_out": 0.5}, keys), keys)
    else:
        agg = F.avg("_v") if how == "mean" else F.coalesce(F.sum("_v"), F.lit(0.0))
        bins = rows.groupBy(*keys).agg(agg.alias("_out"))
    # The next bin is in the same block of days or the first one of a later block: a
    # row per block tells which.
    bins = bins.withColumn("_blk", day_block("_bin", block_days))
    block, series = [entity, "_blk"], Window.partitionBy(entity).orderBy("_blk")
    starts = bins.groupBy(*block).agg(F.min("_bin").alias("_first")).select(*block, F.lead("_first").over(series).alias("_later"))
    bins = join_per_key(bins, starts, block)
    after = F.coalesce(F.lead("_bin").over(Window.partitionBy(*block).orderBy("_bin")), F.col("_later"))
    fill = F.lit(0.0) if how == "sum" else F.lit(None).cast("double")
    seconds = lambda interval: F.expr(f"cast(cast({interval} as interval second) as bigint)")
    spaced = bins.withColumn("_next", after).withColumn("_step", step)
    spaced = spaced.withColumn("_last", F.coalesce(F.floor(seconds("_next - _bin") / seconds("_step")).cast("long") - 1, F.lit(0).cast("long")))
    blocks = spaced.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / FILL_BLOCK))))
    place = F.sequence(F.col("_blk") * FILL_BLOCK, F.least(F.col("_last"), (F.col("_blk") + 1) * FILL_BLOCK - 1))
    return (
        blocks.withColumn("_i", F.explode(place))
        .withColumn(ts, F.col("_bin") + F.col("_step") * F.col("_i"))
        .select(entity, ts, F.when(F.col(ts) == F.col("_bin"), F.col("_out")).otherwise(fill).alias(value))
    )


def reading_counts(df: DataFrame, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Number of non-missing times per entity."""
    return df.groupBy(entity).agg(F.count(ts).alias("readings"))


def mean_load(df: DataFrame, entity: str = "entity", value: str = "value") -> DataFrame:
    """Mean of the non-missing values per entity."""
    return df.groupBy(entity).agg(F.avg(reading(value)).alias("mean_load"))


def metric_summary(df: DataFrame, metric: str) -> DataFrame:
    """Mean and median of one column over all rows."""
    return merge_single_rows(
        df.agg(F.avg(reading(metric)).alias("mean")), exact_quantiles(df, metric, {"median": 0.5})
    )


def series_bounds(df: DataFrame, kind: str = "kind", entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Per entity the last bin of the history and the first of the forecast."""
    return df.groupBy(entity).agg(
        F.max(F.when(F.col(kind) == "history", F.col(ts))).alias("history_last"),
        F.min(F.when(F.col(kind) == "forecast", F.col(ts))).alias("forecast_first"),
    )
