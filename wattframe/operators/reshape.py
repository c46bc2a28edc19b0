"""Wide and long forms, calendar features and derived metric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import CALENDAR, calendar, ratio, reading
from .clean import drop_unparseable_time
from .resample import resample


def wide_to_long(
    df: DataFrame,
    id_column: str = "timestamp",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    meter: str | None = "electricity",
    partitions: int | None = None,
) -> DataFrame:
    """One row per (time, column) of a wide table; missing cells are kept, rows
    whose time cannot be read are dropped.

    A wide table is short but each row turns into as many rows as there are
    columns, so ``partitions`` can spread the rows before they multiply.
    """
    if id_column not in df.columns:
        raise ValueError(f"no column {id_column!r}")
    if partitions:
        df = df.repartition(partitions)
    df = drop_unparseable_time(df, id_column)
    cells = [c for c in df.columns if c != id_column]
    wide = df.select(id_column, *[reading(F.col(f"`{c}`")).cast("float").alias(c) for c in cells])
    out = wide.unpivot([id_column], [F.col(f"`{c}`") for c in cells], entity, value).withColumnRenamed(id_column, ts)
    if meter is not None:
        out = out.withColumn("meter", F.lit(meter))
    return out


def long_to_wide(
    df: DataFrame,
    entities: Sequence[str],
    freq: str = "1D",
    how: str = "mean",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Resampled series as one column per entity, sorted by time.

    ``entities`` is the explicit list of columns (a chart shows a handful), so
    no job has to find it. A time appears when any of the listed series spans it.
    """
    listed = df.filter(F.col(entity).isin(list(entities)))
    bins = resample(listed, freq, how, entity, ts, value)
    return bins.groupBy(ts).pivot(entity, list(entities)).agg(F.first(value, ignorenulls=True)).orderBy(ts)


def add_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The seven calendar features as small integers."""
    return df.withColumns(calendar(ts))


def stored_types(df: DataFrame) -> DataFrame:
    """Calendar features in their stored types: INT, and BOOLEAN for flags."""
    kinds = {c: "boolean" if c.startswith("is_") else "int" for c in CALENDAR}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in df.columns})


def add_error_ratios(df: DataFrame, skill: str = "skill_w168") -> DataFrame:
    """``nrmse`` and ``wape_pct`` against the mean load (missing when it is 0),
    ``mape_pct`` (the MAPE is a percentage already) and ``skill_pct``; each only
    where the columns it needs exist."""
    new = {}
    if "mean_load" in df.columns and "rmse" in df.columns:
        new["nrmse"] = ratio("rmse", "mean_load")
    if "mean_load" in df.columns and "mae" in df.columns:
        new["wape_pct"] = 100 * ratio("mae", "mean_load")
    if "mape" in df.columns and "mape_pct" not in df.columns:
        new["mape_pct"] = F.col("mape")
    if skill in df.columns:
        new["skill_pct"] = 100 * F.col(skill)
    return df.withColumns(new)
