"""From raw readings to the clean table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.clean import dedup
from ..operators.reshape import add_time_features
from ..operators.resample import resample_mean


def preprocess(
    df: DataFrame,
    skip_dedup: bool = False,
    resample_3h: bool = False,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """Optional 3-hour resample, calendar features, deduplication.

    Bins are unique already, so after a resample there is nothing left to
    deduplicate and no second shuffle.
    """
    if resample_3h:
        df = resample_mean(df, "3H", entity, ts, value)
    elif not skip_dedup:
        df = dedup(df, entity, ts, tiebreak)
    return add_time_features(df, ts)
