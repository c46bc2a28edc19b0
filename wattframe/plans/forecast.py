"""Forecasts for every entity at once, and the tables a model trains on."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import CALENDAR, calendar, duration, reading
from ..operators.grouping import join_per_key
from ..operators.regression import moments, predicted, solved
from ..operators.scaling import apply_scaler
from ..operators.series import (
    FEATURES, drop_nonfinite_sequences, lag_columns, latest_rows, sliding_sequences,
)


def _ahead(last: str, h: str, step: str):
    n, unit = duration(step).split()
    return F.col(last) + F.col(h) * F.expr(f"INTERVAL '{n}' {unit.upper()}")


def forecast_seasonal_naive(
    df: DataFrame,
    season: int = 168,
    horizon: int = 24,
    step: str = "1H",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Repeat each entity's last season of rows: entity, h, ts, pred.

    Every entity has ``horizon`` steps; where the series is too short to hold a
    step's row, ``pred`` is NULL.
    """
    tail = latest_rows(df.select(entity, ts, value, *tiebreak), season, entity, ts, tiebreak)
    known = tail.select(F.col(entity).alias("_e"), F.col("back").cast("long").alias("_back"), reading(value).alias("pred"))
    steps = tail.groupBy(entity).agg(F.max(ts).alias("_last")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    same = F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_back") == season - (F.col("h") - 1) % season)
    return steps.join(known, same, "left").select(entity, "h", _ahead("_last", "h", step).alias(ts), "pred")


def forecast_profile(
    df: DataFrame,
    horizon: int = 24,
    step: str = "1H",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Mean by (entity, weekday, hour) for the steps after each entity's last
    reading: entity, h, ts, pred (NULL where the profile has no such hour)."""
    c = calendar(ts)
    profile = df.groupBy(entity, c["day_of_week"].alias("_d"), c["hour"].alias("_h")).agg(
        F.avg(reading(value)).alias("pred"), F.max(ts).alias("_last")
    )
    ends = profile.groupBy(entity).agg(F.max("_last").alias("_last"))
    steps = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        ts, _ahead("_last", "h", step)
    )
    f = calendar(ts)
    steps = steps.withColumns({"_d": f["day_of_week"], "_h": f["hour"]}).drop("_last")
    return steps.join(profile.drop("_last"), [entity, "_d", "_h"], "left").select(entity, "h", ts, "pred")


def regression_table(
    df: DataFrame,
    lags: Sequence[int] = (24, 168),
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Rows with calendar features and lagged values, where all are present."""
    names = {f"lag_{k}": int(k) for k in lags}
    rows = lag_columns(df.select(entity, ts, value, *tiebreak), names, entity, ts, value, tiebreak)
    return rows.withColumns(calendar(ts)).na.drop("any", subset=[value, *names])


def fit_linear(
    table: DataFrame, lags: Sequence[int] = (24, 168), ridge: float = 0.0, value: str = "value", use_calendar: bool = True
) -> PipelineModel:
    """One linear model over all entities of a ``regression_table``."""
    inputs = [*(CALENDAR if use_calendar else ()), *[f"lag_{k}" for k in lags]]
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol=value, predictionCol="y_pred", regParam=ridge, elasticNetParam=0.0),
    ]
    return Pipeline(stages=stages).fit(table)


def forecast_linear(
    df: DataFrame,
    split: DataFrame,
    lags: Sequence[int] = (24, 168),
    ridge: float = 0.0,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
    use_calendar: bool = True,
) -> DataFrame:
    """Fit on the train entities, predict all: entity, split, ts, y_true,
    y_pred. Lags no shorter than the horizon make it a direct forecast."""
    table = regression_table(df, lags, entity, ts, value, tiebreak)
    table = join_per_key(table, split, [entity], "inner")
    model = fit_linear(table.filter(F.col("split") == "train"), lags, ridge, value, use_calendar)
    return model.transform(table).select(entity, "split", ts, F.col(value).alias("y_true"), "y_pred")


def linear_models(
    df: DataFrame,
    split: DataFrame | None = None,
    lags: Sequence[int] = (24, 168),
    ridge: float = 0.0,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
    use_calendar: bool = True,
    per_entity: bool = False,
) -> DataFrame:
    """Weights of a linear model on calendar features and lagged values: ``n``,
    ``weights`` (calendar first, then lags) and ``bias``.

    One row over the train entities of ``split`` (over all, without one), or with
    ``per_entity`` one row per entity with its own model.
    """
    table = regression_table(df, lags, entity, ts, value, tiebreak)
    inputs = [*(CALENDAR if use_calendar else ()), *[f"lag_{k}" for k in lags]]
    if not per_entity and split is not None:
        table = table.join(split.filter(F.col("split") == "train").select(entity), entity, "left_semi")
    fit = moments(table, inputs, value, [entity] if per_entity else [])
    return solved(fit, len(inputs), ridge).select(*([entity] if per_entity else []), "n", "weights", "bias")


def forecast_linear_ahead(
    df: DataFrame,
    models: DataFrame,
    lags: Sequence[int] = (24, 168),
    horizon: int = 24,
    step: str = "1H",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
    use_calendar: bool = True,
) -> DataFrame:
    """Steps after each entity's last reading by ``models`` (from ``linear_models``
    with the same arguments): entity, h, ts, pred.

    A step's lags are known readings or, beyond the last one, earlier steps'
    predictions. What meets is the last ``max(lags)`` readings of an entity. Every
    entity has ``horizon`` steps; ``pred`` is NULL where a lag is missing, the
    series is too short, or there is no model.
    """
    longest = max(int(k) for k in lags)
    tail = latest_rows(df.filter(F.col(ts).isNotNull()).select(entity, ts, value, *tiebreak), longest, entity, ts, tiebreak)
    past = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("back"), reading(value).alias("v"))))
    ends = tail.groupBy(entity).agg(past.alias("_past"), F.max(ts).alias("_last"))
    # Short series are filled up in front, so that a lag is a place from the end.
    missing = F.array_repeat(F.lit(None).cast("double"), longest - F.size("_past"))
    ends = ends.select(entity, "_last", F.concat(missing, F.col("_past.v")).alias("_past"))
    if entity in models.columns:
        own = models.select(F.col(entity).alias("_m"), "weights", "bias")
        ends = ends.join(own, F.col(entity).eqNullSafe(F.col("_m")), "left").drop("_m")
    else:
        # One row.
        ends = ends.join(F.broadcast(models.select("weights", "bias").limit(1)), how="left")
    names = list(CALENDAR) if use_calendar else []
    n, unit = duration(step).split()
    width = F.expr(f"INTERVAL '{n}' {unit.upper()}")

    def fixed(h):
        """What bias and calendar give for step ``h``."""
        features = calendar(F.col("_last") + h * width)
        total = F.col("bias")
        for k, c in enumerate(names):
            total = total + F.get("weights", F.lit(k)) * features[c].cast("double")
        return total

    def next_one(known, h):
        total = F.get("_fixed", h - 1)
        for k, lag in enumerate(lags):
            total = total + F.get("weights", F.lit(len(names) + k)) * F.get(known, F.size(known) - F.lit(int(lag)))
        return F.concat(known, F.array(total))

    ahead = F.sequence(F.lit(1), F.lit(horizon))
    steps = ends.withColumn("_fixed", F.transform(ahead, fixed)).withColumn("_all", F.aggregate(ahead, F.col("_past"), next_one))
    each = steps.select(entity, "_last", F.posexplode(F.slice("_all", longest + 1, horizon)).alias("_at", "pred")).withColumn("h", F.col("_at") + 1)
    return each.select(entity, "h", _ahead("_last", "h", step).alias(ts), "pred")


def fitted_linear(
    df: DataFrame,
    models: DataFrame,
    lags: Sequence[int] = (24, 168),
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
    use_calendar: bool = True,
) -> DataFrame:
    """Predictions of known rows by ``models`` of all entities: entity, ts, y_true,
    y_pred."""
    table = regression_table(df, lags, entity, ts, value, tiebreak)
    inputs = [*(CALENDAR if use_calendar else ()), *[f"lag_{k}" for k in lags]]
    # One row.
    table = table.join(F.broadcast(models.select("weights", "bias").limit(1)))
    return table.select(entity, ts, F.col(value).alias("y_true"), predicted("weights", "bias", inputs).alias("y_pred"))


def batch_predict(
    seqs: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    entity: str = "entity",
) -> DataFrame:
    """Score sequences with ``predict``: it gets an array [n, lookback,
    features] per Arrow batch and returns [n, horizon]. One output row per
    step: entity, start_idx, h, y_true, y_pred."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.stack(rows) for rows in pdf["x"]])
                yield pdf[[entity, "start_idx", "y"]].assign(p=list(np.asarray(predict(x), dtype="float64")))

    kind = seqs.schema[entity].dataType.simpleString()
    scored = seqs.select(entity, "start_idx", "x", "y").mapInPandas(
        score, f"`{entity}` {kind}, start_idx bigint, y array<float>, p array<double>"
    )
    pairs = scored.select(entity, "start_idx", F.posexplode(F.arrays_zip("y", "p")).alias("_h", "_v"))
    return pairs.select(
        entity,
        "start_idx",
        (F.col("_h") + 1).alias("h"),
        F.col("_v.y").cast("double").alias("y_true"),
        F.col("_v.p").alias("y_pred"),
    )


def training_tables(
    df: DataFrame,
    split: DataFrame,
    scaler: DataFrame,
    lookback: int = 480,
    horizon: int = 240,
    stride: int = 8,
    features: Sequence[str] = FEATURES,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Finite, scaled sequences tagged with the split of their entity. Rows of
    entities outside the split go before any window is built."""
    named = join_per_key(df, split, [entity], "inner")
    seqs = sliding_sequences(
        named, lookback, horizon, stride, entity, ts, value, features, tiebreak, keep=["split"]
    )
    return apply_scaler(drop_nonfinite_sequences(seqs), scaler, features)
