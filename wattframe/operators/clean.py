"""Row filters, column resolution and deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.columns import first_present, ratio, reading
from .grouping import join_per_key, merge_single_rows

# Column names accepted for each role, most preferred first.
ENTITY_NAMES = ("building_id", "bldg_id", "site_id")
TIME_NAMES = ("timestamp_local", "timestamp_utc", "ts", "datetime")
TRUTH_NAMES = ("y_true", "target", "actual", "value_true", "y")
PREDICTION_NAMES = ("y_pred", "prediction", "pred", "yhat")

PREDICTIONS = {"entity": ENTITY_NAMES, "ts": TIME_NAMES[:3], "y_true": TRUTH_NAMES, "y_pred": PREDICTION_NAMES}
FORECASTS = {"entity": ENTITY_NAMES[:1], "ts": TIME_NAMES, "pred": ("pred",)}
READINGS = {"entity": ENTITY_NAMES[:1], "ts": TIME_NAMES, "value": ("value",)}


def filter_meter(df: DataFrame, kind: str = "electricity", meter: str = "meter") -> DataFrame:
    """Rows of one meter kind; the table as it is when it has no such column."""
    return df.filter(F.col(meter) == kind) if meter in df.columns else df


def drop_unparseable_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The time as TIMESTAMP_NTZ, without the rows where it cannot be read."""
    kind = df.schema[ts].dataType
    when = F.col(f"`{ts}`")
    if isinstance(kind, T.StringType):
        when = F.expr(f"try_cast(`{ts}` AS TIMESTAMP_NTZ)")
    elif not isinstance(kind, T.TimestampNTZType):
        when = when.cast("timestamp_ntz")
    return df.withColumn(ts, when).filter(F.col(f"`{ts}`").isNotNull())


def numeric_coerce(df: DataFrame, value: str = "value") -> DataFrame:
    """The value as DOUBLE; rows where it is missing or not a number go."""
    return df.withColumn(value, reading(F.expr(f"try_cast(`{value}` AS DOUBLE)"))).filter(F.col(value).isNotNull())


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows without a missing value (NULL or NaN) in any column."""
    return df.na.drop("any")


def drop_inf_rows(df: DataFrame) -> DataFrame:
    """Rows without an infinite value in any numeric column."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            out = out.filter(c.isNull() | F.isnan(c) | (F.abs(c) < float("inf")))
    return out


def drop_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a cleaning step."""
    return merge_single_rows(
        before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("rows_after"))
    ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def filter_name(df: DataFrame, text: str, regex: bool = False, entity: str = "entity") -> DataFrame:
    """Entities whose name holds ``text`` in any case, as plain text or as a
    regular expression."""
    name = F.col(entity).cast("string")
    return df.filter(name.rlike(f"(?i){text}") if regex else F.contains(F.lower(name), F.lit(text.lower())))


def resolve_columns(df: DataFrame, roles: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Rename the first present alias of each role to the role's name.

    The choice is made on the schema, so nothing runs. The entity becomes a
    string; a missing role is an error. ``keep`` lists further columns to keep.
    """
    chosen = {role: first_present(df.columns, names, f"{role} column") for role, names in roles.items()}
    out = df.select(
        *[F.col(f"`{c}`").alias(role) for role, c in chosen.items()], *[c for c in keep if c in df.columns]
    )
    if "entity" in chosen:
        out = out.withColumn("entity", F.col("entity").cast("string"))
    return out


def recent_history(df: DataFrame, days: int = 180, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Per entity, the rows of the last ``days`` days before its last reading. Rows
    without an entity are a series too; rows without a time are left out."""
    ends = df.groupBy(entity).agg(F.max(ts).alias("_end"))
    span = F.make_dt_interval(days=F.lit(int(days)))
    return (
        join_per_key(df, ends, [entity], "inner").filter(F.col(ts) >= F.col("_end") - span).drop("_end")
    )


def filter_entities(df: DataFrame, ids: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows whose entity is in the table ``ids`` (a semi join)."""
    return join_per_key(df, ids.select(entity).distinct(), [entity], "left_semi")


def dedup(df: DataFrame, entity: str = "entity", ts: str = "ts", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """The first row per (entity, time) in ``tiebreak`` order; by default that of
    all other columns, ``seq`` first if there is one, missing values first.

    Spark keeps only each map task's first row per key before the shuffle, so
    a large group of copies does not travel.
    """
    if tiebreak is None:
        rest = [f.name for f in df.schema.fields if f.name not in (entity, ts) and not isinstance(f.dataType, T.MapType)]
        tiebreak = sorted(rest, key=lambda c: c != "seq") or [entity]
    w = Window.partitionBy(entity, ts).orderBy(*[F.col(f"`{c}`") for c in tiebreak])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_report(df: DataFrame, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Rows, and rows that ``dedup`` keeps and removes."""
    per_key = df.groupBy(entity, ts).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def retention_report(before: DataFrame, after: DataFrame, entity: str = "entity") -> DataFrame:
    """Row and entity counts of a pipeline's input and output, and the share of
    rows that is left."""

    def sizes(df: DataFrame, tag: str) -> DataFrame:
        per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
        return per.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias(f"rows_{tag}"), F.count(F.lit(1)).alias(f"entities_{tag}")
        )

    return merge_single_rows(sizes(before, "in"), sizes(after, "out")).withColumn(
        "retention_pct", 100 * ratio("rows_out", "rows_in")
    )


def dataset_profile(df: DataFrame, entity: str = "entity", approx: bool = False) -> DataFrame:
    """Rows, distinct entities, and missing cells over all columns."""

    def missing(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.count_if(c.isNull() | F.isnan(c))
        return F.count_if(c.isNull())

    cells = F.lit(0)
    for f in df.schema.fields:
        cells = cells + missing(f)
    plain = [F.count(F.lit(1)).alias("total_rows"), cells.cast("long").alias("missing_cells")]
    if approx:
        return df.agg(*plain, F.approx_count_distinct(entity).alias("entities"))
    # Distinct entities through a grouped count: one pass, partial aggregation.
    per = df.groupBy(entity).agg(*plain)
    return per.agg(
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("missing_cells"), F.lit(0)).alias("missing_cells"),
        F.count(entity).alias("entities"),
    )


