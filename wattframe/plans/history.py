"""History and forecast of all entities on one time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.clean import drop_unparseable_time, filter_meter, numeric_coerce, recent_history
from ..operators.grouping import join_per_key
from ..operators.resample import resample


def history_vs_forecast(
    readings: DataFrame,
    forecast: DataFrame,
    freq: str = "1D",
    how: str = "mean",
    days: int = 180,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    pred: str = "pred",
) -> DataFrame:
    """Recent readings binned with ``how`` and forecasts binned by mean, tagged
    by ``kind``. Only entities that have a forecast appear."""
    ahead = drop_unparseable_time(forecast, ts)
    # First of all, so that nothing is done for entities that do not appear.
    past = join_per_key(filter_meter(readings), ahead.select(entity).distinct(), [entity], "left_semi")
    past = numeric_coerce(drop_unparseable_time(past, ts), value)
    past = recent_history(past.select(entity, ts, value), days, entity, ts)
    past = resample(past, freq, how, entity, ts, value)
    ahead = resample(ahead, freq, "mean", entity, ts, pred).withColumnRenamed(pred, value)
    return past.withColumn("kind", F.lit("history")).unionByName(ahead.withColumn("kind", F.lit("forecast")))
