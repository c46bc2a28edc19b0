"""Reading and writing meter readings: wide CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.columns import CALENDAR, first_present
from ..operators.clean import TIME_NAMES, drop_unparseable_time, filter_meter
from ..operators.reshape import stored_types, wide_to_long

# What the entity column of a table may be called.
ENTITY_NAMES = ("building_id", "bldg_id", "site_id", "entity")

READINGS_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("entity", T.StringType()),
    T.StructField("meter", T.StringType()),
    T.StructField("value", T.FloatType()),
])


def read_wide_csv(spark: SparkSession, path: str, id_column: str = "timestamp") -> DataFrame:
    """A CSV with one numeric column per entity. Only the header line is read
    to learn the names; the time stays text and every other column is DOUBLE.
    Files of a folder whose header has another order are an error."""
    names = spark.read.option("header", True).csv(path).columns
    if id_column not in names:
        raise ValueError(f"{path} has no column {id_column!r}")
    schema = T.StructType([
        T.StructField(c, T.StringType() if c == id_column else T.DoubleType()) for c in names
    ])
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def _sorted(df: DataFrame, layout: str, partitions: int | None) -> DataFrame:
    """Rows placed and sorted by (entity, time). ``range`` gives files with
    disjoint key ranges; ``balanced`` lets Spark cut a hot key over several
    files of even size, also where all its rows are copies of each other."""
    keys = ["entity", "ts"]
    if layout == "range":
        rest = [c for c in df.columns if c not in keys]
        args = [partitions] if partitions else []
        df = df.repartitionByRange(*args, *keys, *rest)
    elif layout == "balanced":
        df = df.hint("rebalance", *keys)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return df.sortWithinPartitions(*keys)


def write_readings(df: DataFrame, path: str, layout: str = "range", partitions: int | None = None, mode: str = "overwrite") -> None:
    """Readings in the fixed schema as Snappy Parquet, sorted by (entity, time)."""
    typed = df.select(*[F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])
    _sorted(typed, layout, partitions).write.mode(mode).option("compression", "snappy").parquet(path)


def write_clean(df: DataFrame, path: str, layout: str = "range", partitions: int | None = None, mode: str = "overwrite") -> None:
    """As ``write_readings`` with the calendar features: INT, flags BOOLEAN;
    ``meter`` only where it exists."""
    base = [f for f in READINGS_SCHEMA.fields if f.name in df.columns]
    typed = stored_types(df.select(*[F.col(f.name).cast(f.dataType) for f in base], *CALENDAR))
    _sorted(typed, layout, partitions).write.mode(mode).option("compression", "snappy").parquet(path)


def ingest_wide(spark: SparkSession, csv_path: str, parquet_path: str, partitions: int | None = None, id_column: str = "timestamp") -> DataFrame:
    """Wide CSV to sorted Parquet readings; returns the verification row."""
    wide = read_wide_csv(spark, csv_path, id_column)
    write_readings(wide_to_long(wide, id_column, partitions=partitions), parquet_path)
    return verify_readings(spark, parquet_path)


def verify_readings(spark: SparkSession, path: str, schema: T.StructType = READINGS_SCHEMA) -> DataFrame:
    """One row about a written table: its column types, whether they are the
    expected ones, rows, distinct entities, first and last time."""
    df = spark.read.parquet(path)
    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    expected = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    per = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("entities"),
        F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"),
    ).select(
        F.lit(", ".join(f"{n} {t}" for n, t in types)).alias("column_types"),
        F.lit(types == expected).alias("types_ok"),
        "*",
    )


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, with numbers for columns of nanosecond times.

    Spark refuses to derive a schema from such files, but reads them by a schema
    that says LONG. That schema is derived in a session of its own.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as refused:
        if "PARQUET_TYPE_ILLEGAL" not in str(refused):
            raise
    aside = spark.newSession()
    aside.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.schema(aside.read.parquet(path).schema).parquet(path)


def read_readings(
    spark: SparkSession,
    path: str,
    kind: str | None = "electricity",
    entity: str | Sequence[str] = ENTITY_NAMES,
    value: str = "value",
    meter: str = "meter",
    times: Sequence[str] = TIME_NAMES,
) -> DataFrame:
    """Readings as (ts, entity, [meter], value FLOAT), one meter kind. The entity is
    the first of the listed columns that is there.

    Times may be stored in nanoseconds, which Spark has no type for: they become
    times in microseconds, and the session's settings are not touched. The filter
    and the column list reach the Parquet scan; nothing is sorted here.
    """
    df = _scan(spark, path)
    when = first_present(df.columns, times, "time column")
    who = first_present(df.columns, [entity] if isinstance(entity, str) else entity, "entity column")
    if kind is not None:
        df = filter_meter(df, kind, meter)
    t = F.col(when)
    if isinstance(df.schema[when].dataType, T.LongType):
        micros = F.expr(f"make_dt_interval(0, 0, 0, CAST(`{when}` DIV 1000 AS DECIMAL(18, 0)) / 1000000)")
        t = F.lit("1970-01-01").cast("timestamp_ntz") + micros
    out = df.select(
        t.alias("ts"),
        F.col(who).cast("string").alias("entity"),
        *([F.col(meter).cast("string").alias("meter")] if meter in df.columns else []),
        F.col(value).cast("float").alias("value"),
    )
    return drop_unparseable_time(out, "ts")


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns of a Parquet table."""
    return spark.read.parquet(path).select(*columns)


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of a Parquet table, from the file footer."""
    return spark.read.parquet(path).columns
