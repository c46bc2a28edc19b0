"""How unusual a reading is for its entity and hour of the week."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import calendar, reading


def hour_of_week_score(
    df: DataFrame, least: int = 2, entity: str = "entity", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """All rows with ``expected`` and ``zscore`` against the entity's other readings
    at that weekday and hour.

    ``zscore`` is NULL where a profile has fewer than ``least`` readings or does not
    vary, and where the reading is missing. The profile has at most 168 rows per
    entity; a hot entity is left to adaptive skew handling in the join.
    """
    c = calendar(ts)
    rows = df.withColumns({"_d": c["day_of_week"], "_h": c["hour"]})
    profile = rows.groupBy(F.col(entity).alias("_e"), F.col("_d").alias("_pd"), F.col("_h").alias("_ph")).agg(
        F.avg(reading(value)).alias("expected"),
        F.stddev_pop(reading(value)).alias("_sd"),
        F.count(reading(value)).alias("_n"),
    )
    same = F.col(entity).eqNullSafe(F.col("_e")) & F.col("_d").eqNullSafe(F.col("_pd")) & F.col("_h").eqNullSafe(F.col("_ph"))
    usable = (F.col("_n") >= least) & (F.col("_sd") > 1e-9)
    score = F.when(usable, (reading(value) - F.col("expected")) / F.col("_sd"))
    return rows.join(profile, same, "left").select(*df.columns, "expected", score.alias("zscore"))
