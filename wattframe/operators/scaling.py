"""Standard scaling: population variance, scale 1 where it is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .clean import filter_entities
from .grouping import join_per_key
from .series import FEATURES, row_index


def _long_features(df: DataFrame, features: Sequence[str], weight: Column) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("v"))
        for f in features
    ])
    return df.select(F.explode(cells).alias("_f"), weight.alias("_w")).select("_f.feature", "_f.v", "_w")


def _finish(stats: DataFrame) -> DataFrame:
    return stats.withColumn("scale", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)).select(
        "feature", "mean", "var", "scale"
    )


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean, population variance and scale of every feature over all rows: one
    aggregation, one row per feature."""
    v = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(f) for f, c in v.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in features])
    return _finish(one.select(F.explode(rows).alias("r")).select("r.feature", "r.s.mean", "r.s.var"))


def fit_scaler_sampled(
    df: DataFrame,
    entities: DataFrame,
    lookback: int = 480,
    horizon: int = 240,
    stride: int = 8,
    max_windows: int | None = None,
    features: Sequence[str] = FEATURES,
    entity: str = "entity",
    ts: str = "ts",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The scaler of a sample of windows: of each listed entity the windows at ten
    times the stride, or the first ``max_windows`` of them.

    Windows overlap, so a row counts once per window that holds it. That count
    follows from the row's position, so no window is built.
    """
    wide = stride * 10
    chosen = filter_entities(df, entities, entity)
    pos = row_index(chosen, entity, ts, tiebreak, "_k")
    length = chosen.groupBy(entity).agg(F.count(F.lit(1)).alias("_len"))
    k = F.col("_k")
    windows = F.floor((F.col("_len") - lookback - horizon) / wide) + 1
    if max_windows is not None:
        windows = F.least(F.lit(max_windows), windows)
    last = F.least(F.floor(k / wide), windows - 1)
    first = F.greatest(F.lit(0), F.ceil((k - lookback + 1) / wide))
    rows = (
        join_per_key(pos, length.filter(F.col("_len") >= lookback + horizon), [entity], "inner")
        .withColumn("_times", F.greatest(F.lit(0), last - first + 1))
        .filter("_times > 0")
    )
    cells = _long_features(rows, features, F.col("_times")).filter("v is not null")
    # Pooled over (feature, value): exact weights, and a stable second moment.
    per_value = cells.groupBy("feature", "v").agg(F.sum("_w").alias("_w"))
    mean = per_value.groupBy("feature").agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("mean"))
    centred = per_value.join(F.broadcast(mean), "feature")  # one row per feature
    d = F.col("v") - F.col("mean")
    return _finish(
        centred.groupBy("feature").agg(
            F.first("mean").alias("mean"), (F.sum(F.col("_w") * d * d) / F.sum("_w")).alias("var")
        )
    )


def _params(scaler: DataFrame, features: Sequence[str]) -> Column:
    """The scaler as an array of (mean, scale) in feature order. It has one row
    per feature, so it enters a plan as a scalar subquery: nothing is collected
    on the driver and nothing is joined."""
    by_name = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))
    return (
        scaler.filter(F.col("feature").isin(list(features)))
        .agg(by_name.alias("m"))
        .select(F.transform(F.array(*[F.lit(f) for f in features]), lambda f: F.col("m")[f]))
        .scalar()
    )


def apply_scaler(seqs: DataFrame, scaler: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``x`` of every sequence as (x - mean) / scale; ``y`` stays as it is."""
    scaled = F.expr(
        "transform(x, r -> zip_with(r, _scaler, (v, s) -> cast((cast(v as double) - s.mean) / s.scale as float)))"
    )
    return seqs.withColumn("_scaler", _params(scaler, features)).withColumn("x", scaled).drop("_scaler")


def scale_columns(df: DataFrame, scaler: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The same scaling on a table of rows."""
    scaled = {f: F.expr(f"(cast(`{f}` as double) - _scaler[{i}].mean) / _scaler[{i}].scale") for i, f in enumerate(features)}
    return df.withColumn("_scaler", _params(scaler, features)).withColumns(scaled).drop("_scaler")
