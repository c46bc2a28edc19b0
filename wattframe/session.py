"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "wattframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings above. Keyword arguments such as
    ``spark_sql_shuffle_partitions=8`` add or override settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, val in {**CONF, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names.

    Only a session without that setting (a unit test on one machine) gets a
    folder under ``/tmp``; a cluster has to name a folder all executors see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = "/tmp/wattframe"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lazy_checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, written by the first job
    that needs the rows."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    return df.checkpoint(eager=False)
