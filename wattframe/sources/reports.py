"""Small tables: reports, splits, summaries and scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.split import NAMES

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV report with a known schema; no pass over the data to infer one."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows as JSON, one object per line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_split(split: DataFrame, path: str, entity: str = "entity", document: bool = False) -> None:
    """A split as JSON, one line per entity, written in parallel. With ``document``
    it is one document with a list per part, made by one task: for splits of a
    size that a person or a small program reads."""
    rows = split.select(F.col(entity).cast("string").alias("entity"), "split")
    if document:
        lists = [
            F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("entity")))).alias(s) for s in NAMES
        ]
        rows = rows.agg(*lists)
    rows.write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str, entity: str = "entity") -> DataFrame:
    """Either form of ``write_split`` as (entity, split)."""
    shape = ", ".join(f"{s} array<string>" for s in NAMES) + ", entity string, split string"
    raw = spark.read.schema(shape).json(path)
    lists = F.array(*[F.struct(F.lit(s).alias("s"), F.coalesce(s, F.array().cast("array<string>")).alias("ids")) for s in NAMES])
    listed = (
        raw.filter("split is null")
        .select(F.explode(lists).alias("p"))
        .select(F.explode("p.ids").alias(entity), F.col("p.s").alias("split"))
    )
    return listed.unionByName(raw.filter("split is not null").select(F.col("entity").alias(entity), "split"))


def write_scaler(scaler: DataFrame, path: str) -> None:
    """One row per feature, as one small Parquet file."""
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, mean double, var double, scale double").parquet(path)
