"""Readers and writers beyond what the registered queries cover."""

import datetime as dt
import json
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wattframe.session import shared_path
from wattframe.sources import readings as src, reports

T0 = dt.datetime(2024, 1, 1)


def test_wide_csv_needs_a_time_column(spark, tmp_path):
    (tmp_path / "w.csv").write_text("when,a\n2024-01-01,1\n")
    with pytest.raises(ValueError):
        src.read_wide_csv(spark, str(tmp_path / "w.csv"))


def test_ingest_keeps_missing_cells_and_drops_bad_times(spark, tmp_path):
    (tmp_path / "w.csv").write_text("timestamp,a.1,b\n2024-01-01 00:00:00,1.5,\nnever,2,3\n2024-01-01 01:00:00,x,4\n")
    row = src.ingest_wide(spark, str(tmp_path / "w.csv"), str(tmp_path / "out"), partitions=2).first()
    assert (row["total_rows"], row["entities"], row["types_ok"]) == (4, 2, True)
    rows = {(r["entity"], r["ts"].hour): r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("a.1", 0): 1.5, ("a.1", 1): None, ("b", 0): None, ("b", 1): 4.0}


def test_nanosecond_times(spark, tmp_path):
    frame = pd.DataFrame({
        "timestamp_local": pd.to_datetime(["2016-01-01 00:00:00", "2017-12-31 23:00:00.123456"], format="ISO8601"),
        "building_id": ["a", "b"], "meter": ["electricity", "water"], "value": [1.0, 2.0],
    })
    schema = pa.schema([
        ("timestamp_local", pa.timestamp("ns")), ("building_id", pa.string()), ("meter", pa.string()), ("value", pa.float32()),
    ])
    path = str(tmp_path / "ns.parquet")
    pq.write_table(pa.Table.from_pandas(frame, schema=schema, preserve_index=False), path)
    setting = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(setting)
    rows = src.read_readings(spark, path, kind=None).orderBy("ts").collect()
    assert src.read_readings(spark, path).count() == 1 and spark.conf.get(setting) == before
    assert [r["ts"] for r in rows] == [dt.datetime(2016, 1, 1), dt.datetime(2017, 12, 31, 23, 0, 0, 123456)]


def test_split_document_form(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"train": ["a", "b"], "validation": ["c"], "test": []}))
    got = {r["entity"]: r["split"] for r in reports.read_split(spark, str(path)).collect()}
    assert got == {"a": "train", "b": "train", "c": "validation"}
    out = str(tmp_path / "o")
    reports.write_split(reports.read_split(spark, str(path)), out, document=True)
    part = [f for f in os.listdir(out) if f.endswith(".json")]
    docs = [json.loads(line) for f in part for line in open(os.path.join(out, f))]
    assert docs == [{"train": ["a", "b"], "validation": ["c"], "test": []}]


def test_shared_path_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_path(spark, "x")
    assert path.startswith(root.rstrip("/") if root else "/tmp/wattframe")
    assert shared_path(spark, "x") != path


def test_verify_reports_wrong_types(spark, tmp_path):
    spark.createDataFrame([("a", T0, 1.0)], "entity string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "t"))
    assert src.verify_readings(spark, str(tmp_path / "t")).first()["types_ok"] is False
