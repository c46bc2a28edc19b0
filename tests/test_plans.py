"""Physical plans: what is pushed down, what is shuffled, what is bounded."""

import re

from pyspark.sql import functions as F

from checks.fixtures import fixture, table
from wattframe.operators import classification, clean, quality, resample, series
from wattframe.operators.reshape import add_time_features
from wattframe.sources import readings as src

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_meter_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    fixture(spark, SF, "dirty").write.parquet(path)
    p = plan(src.read_readings(spark, path, entity="entity"))
    assert "EqualTo(meter,electricity)" in p
    assert "seq" not in re.search(r"ReadSchema: (\S+)", p).group(1)


def test_column_list_reaches_the_scan(spark):
    p = plan(src.read_columns(spark, f"{SF}/events.parquet", ["user_id", "value"]))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in p


def test_dedup_limits_before_the_shuffle(spark):
    p = plan(clean.dedup(fixture(spark, SF, "dirty")))
    assert p.count("WindowGroupLimit") == 2 and p.count("Exchange hashpartitioning") == 1


def test_resample_is_one_shuffle_with_partial_aggregation(spark):
    df = table(spark, SF, "events").select(F.col("user_id").alias("entity"), "ts", "value")
    p = plan(resample.resample_mean(df))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_avg" in p


def test_unique_report_reads_blocks_once(spark):
    df = fixture(spark, SF, "readings")
    facts = quality._facts(df, 12, "entity", "ts", "value", 32, True, True, 4_000_000)
    p = plan(facts)
    # The block windows and both block aggregates share one shuffle of the rows.
    assert p.count("Exchange hashpartitioning(entity") == 2
    assert "SinglePartition" not in p


def test_no_window_over_a_whole_table(spark):
    df = add_time_features(fixture(spark, SF, "readings"))
    for out in (
        series.sliding_sequences(df, 12, 4, 3, tiebreak=["seq"]),
        series.lag_columns(df, {"a": 8}, tiebreak=["seq"]),
        series.time_gaps(df),
        quality.quality_report(df, 12),
    ):
        assert "SinglePartition" not in plan(out)


def test_windows_over_rows_are_bounded_by_blocks(spark):
    df = add_time_features(fixture(spark, SF, "readings"))
    p = plan(series.row_index(df, tiebreak=["seq"]))
    numbering = [line for line in p.splitlines() if "row_number()" in line]
    assert numbering and all("_blk" in line for line in numbering)


def test_no_cross_joins(spark):
    df = fixture(spark, SF, "readings")
    for out in (quality.quality_summary(quality.quality_report(df, 12)), quality.selection_summary(quality.quality_report(df, 12))):
        p = plan(out)
        assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_threshold_counts_are_not_spread_before_the_shuffle(spark):
    """A group is one row with its curve: no window, and no row per threshold, whose
    tasks grew to a hundred rows an entity."""
    nan, inf = float("nan"), float("inf")
    rows = [(e, y, s) for e in ("a", None) for y, s in ((1, 0.9), (0, 0.9), (1, 0.30), (0, -1.0), (1, nan), (0, inf), (1, None), (None, 0.4))] + [("b", 0, 0.2)]
    df = spark.createDataFrame(rows, "entity string, y_label int, y_score double")
    for made in (classification.optimal_threshold(df, "f1", ["entity"]), classification.threshold_curve(df, ["entity"])):
        text = plan(made)
        assert "Window" not in text and text.count("Exchange hashpartitioning") == 2 and "Join" not in text
    curve = {(r.entity, r.i): r for r in classification.threshold_curve(df, ["entity"]).collect()}
    assert len(curve) == 300
    for (entity, i), r in curve.items():
        own = [(y, s) for e, y, s in rows if e == entity and y is not None and s is not None]
        hits = [s >= i * (1 / 99) for _, s in own]
        want = tuple(sum(h is hit and (y == 1) is truth for (y, _), h in zip(own, hits)) for truth, hit in ((True, True), (False, True), (False, False), (True, False)))
        assert tuple(r[c] for c in classification.COUNTS) == want
    assert classification.threshold_curve(df.limit(0)).count() == 100 and classification.threshold_curve(df.limit(0), ["entity"]).count() == 0
