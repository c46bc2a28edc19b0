"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import duration, reading
from ..operators.reshape import add_time_features


#: Marks rows that only say how far the time has come.
END = "_end"


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a TIMESTAMP; run the session in UTC to keep the clock."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Calendar features; stateless."""
    return add_time_features(df, ts)


def stream_dedup(df: DataFrame, delay: str = "1 day", entity: str = "entity", ts: str = "ts") -> DataFrame:
    """The first row to arrive per (entity, time). State is kept for ``delay``."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([entity, ts])


def with_end(df: DataFrame, path: str) -> DataFrame:
    """``df`` together with the end markers below ``path``, told apart by ``END``. The
    folder is made if there is none."""
    spark, schema = df.sparkSession, df.schema
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return df.withColumn(END, F.lit(False)).unionByName(read_stream(spark, path, schema).withColumn(END, F.lit(True)))


def mark_end(spark: SparkSession, path: str, schema, at, ts: str = "ts") -> None:
    """Say that nothing before ``at`` comes any more: the next run of a stream made
    by ``with_end`` moves its watermark there, and what it still held comes out.
    The input itself is not read again."""
    none = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != END]
    spark.range(1).select(*none).write.mode("append").parquet(path)


def is_reading(df: DataFrame, ts: str = "ts"):
    """True for rows that are no end markers. It names the time as well, so that it
    is asked behind the watermark, which has to see the markers."""
    return (~F.col(END)) | F.col(ts).isNull() if END in df.columns else F.lit(True)


def stream_resample(
    df: DataFrame,
    freq: str = "3H",
    delay: str = "1 day",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    meter: str = "meter",
) -> DataFrame:
    """Mean of the non-missing readings per (entity, bin) as FLOAT, emitted once the
    watermark has passed the bin; bins without one are dropped. ``meter`` is the
    earliest non-missing one in the bin, where the column exists. The last bins
    come out with an end marker."""
    w = F.window(ts, duration(freq))
    kinds = [F.min(F.when(F.col(meter).isNotNull(), F.struct(ts, meter))).getField(meter).alias(meter)] if meter in df.columns else []
    return (
        event_time(df, ts)
        .withWatermark(ts, delay)
        .filter(is_reading(df, ts))
        .withColumn(value, reading(value))
        .groupBy(entity, w)
        .agg(F.avg(value).cast("float").alias(value), *kinds)
        .filter(F.col(value).isNotNull())
        .select(entity, F.col("window.start").alias(ts), value, *([meter] if kinds else []))
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Process what is there into Parquet files at ``path`` and stop. Returns what
    each batch reported."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return list(query.recentProgress)
