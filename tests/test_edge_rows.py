"""Literal rows with results worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wattframe.functions.columns import duration
from wattframe.operators import classification, clean, evaluation, forecast_metrics as fm, quality, resample, reshape, series, split

T0 = dt.datetime(2024, 1, 1)


def hours(*hs):
    return [T0 + dt.timedelta(hours=h) for h in hs]


def table(spark, rows, schema="entity string, ts timestamp_ntz, value double"):
    return spark.createDataFrame(rows, schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def close(a, b):
    return a is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_single_row_entity(spark):
    r = one(quality.quality_report(table(spark, [("a", T0, 3.0)])))
    assert (r["coverage_ratio"], r["continuity_ratio"], r["time_span_hours"]) == (0, 0, 0)
    assert r["std_value"] is None and r["mean_value"] == 3 and r["completeness_ratio"] == 1
    fast = one(quality.quality_report(table(spark, [("a", T0, 3.0)]), variant="fast"))
    assert fast["coverage_ratio"] == 1 and fast["continuity_ratio"] == 0


def test_all_null_entity(spark):
    r = one(quality.quality_report(table(spark, [("a", t, None) for t in hours(0, 1, 2)])))
    assert (r["completeness_ratio"], r["zero_ratio"], r["constant_ratio"]) == (0, 1, 1)
    assert [r[c] for c in ("mean_value", "std_value", "median_value", "min_value", "max_value")] == [0] * 5
    assert r["coefficient_of_variation"] == 0
    assert close(r["quality_score"], 0.25 + 0.25 + 0.05)


def test_nan_counts_as_missing(spark):
    r = one(quality.quality_report(table(spark, [("a", t, v) for t, v in zip(hours(0, 1, 2), [1.0, float("nan"), 3.0])])))
    assert close(r["completeness_ratio"], 2 / 3) and r["mean_value"] == 2


@pytest.mark.parametrize("length,stuck", [(3, 0), (4, 1), (6, 3)])
def test_run_at_threshold(spark, length, stuck):
    rows = [("a", t, 5.0) for t in hours(*range(length))] + [("a", T0 + dt.timedelta(hours=length), 9.0)]
    r = one(quality.quality_report(table(spark, rows), granularity_hours=12))
    assert close(r["constant_ratio"], stuck / (length + 1))


def test_run_across_a_null_and_short_threshold(spark):
    rows = [("a", t, v) for t, v in zip(hours(0, 1, 2, 3, 4), [5.0, 5.0, None, 5.0, 5.0])]
    assert close(one(quality.quality_report(table(spark, rows), 12))["constant_ratio"], 1 / 4)
    rows = [("a", t, 5.0) for t in hours(0, 1, 2)]
    assert close(one(quality.quality_report(table(spark, rows), 48))["constant_ratio"], 2 / 3)


def test_gap_boundary_is_strict(spark):
    r = one(quality.quality_report(table(spark, [("a", t, 1.0) for t in hours(0, 2, 5, 29, 54)])))
    assert (r["gaps_2h"], r["gaps_24h"]) == (3, 1)


def test_run_and_gap_across_block_borders(spark):
    days = [T0 + dt.timedelta(days=d) for d in range(0, 40)]
    rows = [("a", t, 7.0) for t in days]
    for block in (1, 3, 100):
        r = one(quality.quality_report(table(spark, rows), 24, block_days=block))
        assert close(r["constant_ratio"], 39 / 40) and r["gaps_2h"] == 0
        assert close(r["std_value"], 0.0) and r["mean_value"] == 7
        runs = one(series.constant_runs(table(spark, rows), 2, block_days=block))
        assert runs["run_length"] == 40 and runs["run_start"] == days[0] and runs["run_end"] == days[-1]


def test_duplicate_times(spark):
    df = spark.createDataFrame(
        [("a", T0, s, float(s)) for s in (3, 1, 2)], "entity string, ts timestamp_ntz, seq int, value double"
    )
    assert one(clean.dedup(df))["seq"] == 1
    flags = {r["seq"]: r["is_duplicate"] for r in series.duplicate_flags(df).collect()}
    assert flags == {1: False, 2: True, 3: True}
    assert close(one(quality.quality_report(df))["duplicate_ratio"], 2 / 3)


def test_empty_bins(spark):
    df = table(spark, [("a", T0 + dt.timedelta(minutes=10), 1.0), ("a", T0 + dt.timedelta(hours=3, minutes=10), 2.0)])

    def got(how):
        return [r["value"] for r in resample.resample(df, "1H", how).orderBy("ts").collect()]

    assert got("mean") == got("median") == [1, None, None, 2]
    assert got("sum") == [1, 0, 0, 2]
    nulls = table(spark, [("a", T0, None), ("a", T0 + dt.timedelta(hours=1), 4.0)])
    assert [r["value"] for r in resample.resample(nulls, "1H", "sum").orderBy("ts").collect()] == [0, 4]
    assert one(resample.resample_mean(nulls, "1H"))["value"] == 4


def test_calendar_edges(spark):
    times = [dt.datetime(2024, 1, 5, 18, 59), dt.datetime(2024, 1, 5, 19), dt.datetime(2024, 1, 6, 10), dt.datetime(2024, 1, 1, 8)]
    rows = reshape.add_time_features(table(spark, [("a", t, 1.0) for t in times])).collect()
    by = {r["ts"]: r for r in rows}
    assert [by[t]["is_working_hours"] for t in times] == [1, 0, 0, 1]
    assert by[times[3]]["day_of_week"] == 0 and by[times[2]]["is_weekend"] == 1
    assert dict(reshape.stored_types(reshape.add_time_features(table(spark, [("a", T0, 1.0)]))).dtypes)["is_weekend"] == "boolean"


@pytest.mark.parametrize("n,windows", [(6, 0), (7, 1), (9, 2)])
def test_series_length(spark, n, windows):
    df = reshape.add_time_features(table(spark, [("a", t, float(i)) for i, t in enumerate(hours(*range(n)))]))
    rows = series.sliding_sequences(df, 4, 3, 2).orderBy("start_idx").collect()
    assert len(rows) == windows
    for r in rows:
        i = r["start_idx"]
        assert [x[-1] for x in r["x"]] == [float(v) for v in range(i, i + 4)]
        assert r["y"] == [float(v) for v in range(i + 4, i + 7)]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y_true double, y_pred double")


def test_constant_truth_and_zero_truth(spark):
    m = one(fm.forecast_metrics(pairs(spark, [(5.0, 5.0), (5.0, 5.0)])))
    assert (m["r2"], m["nrmse"]) == (1, 0)
    m = one(fm.forecast_metrics(pairs(spark, [(5.0, 6.0), (5.0, 6.0)])))
    assert (m["r2"], m["nrmse"]) == (0, 0)
    m = one(fm.forecast_metrics(pairs(spark, [(0.0, 1.0), (2.0, 1.0)])))
    assert m["mape"] == 50
    assert one(fm.forecast_metrics(pairs(spark, [(0.0, 1.0), (0.0, 2.0)])))["mape"] is None
    assert one(fm.forecast_metrics(pairs(spark, [(1.0, 2.0)])))["r2"] is None


def test_nonfinite_pairs(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(inf, 1.0), (1.0, -inf), (nan, 1.0), (1.0, nan), (None, 1.0), (1.0, None)]
    assert set(one(fm.forecast_metrics(pairs(spark, bad))).values()) == {0.0}
    assert one(fm.forecast_metrics(pairs(spark, [*bad, (1.0, 3.0), (2.0, 2.0)])))["mae"] == 1


def labels(spark, rows):
    return spark.createDataFrame(rows, "y_label int, y_score double")


def test_single_class_and_empty(spark):
    for rows in ([(1, 0.9), (1, 0.2)], [(None, 0.5), (1, float("nan"))]):
        m = one(classification.anomaly_metrics(labels(spark, rows), find_optimal=True))
        assert [m[c] for c in (*classification.RATES, "roc_auc")] == [0] * 6
        assert all(m[c] is None for c in classification.COUNTS) and m["threshold"] == 0.5


def test_scores_on_grid_points(spark):
    step = 1 / 99
    rows = [(i % 2, i * step) for i in range(100)]
    curve = {r["i"]: r for r in classification.threshold_curve(labels(spark, rows)).collect()}
    for i in range(100):
        want = sum(1 for y, s in rows if s >= i * step)
        assert curve[i]["true_positives"] + curve[i]["false_positives"] == want
    outside = labels(spark, [(1, 1.7), (0, -0.4), (1, 0.3)])
    curve = {r["i"]: r for r in classification.threshold_curve(outside).collect()}
    assert curve[99]["true_positives"] == 1 and curve[0]["false_positives"] == 0 and len(curve) == 100


def test_threshold_default(spark):
    best = one(classification.optimal_threshold(labels(spark, [(0, 0.3), (0, 0.9)])))
    assert (best["optimal_threshold"], best["best_value"]) == (0.5, 0)


def test_zero_mean_load_and_no_lag(spark):
    m = spark.createDataFrame([("a", 1.0, 1.0, 0.0)], "entity string, rmse double, mae double, mean_load double")
    r = one(reshape.add_error_ratios(m))
    assert r["nrmse"] is None and r["wape_pct"] is None
    p = spark.createDataFrame(
        [("a", t, 1.0, 2.0) for t in hours(0, 1)], "entity string, ts timestamp_ntz, y_true double, y_pred double"
    )
    s = one(evaluation.skill_vs_persistence(p, 5))
    assert s["rmse_model"] == 1 and s["rmse_baseline"] is None and s["skill"] is None


def test_split_rounding_and_ratios(spark):
    ids = spark.createDataFrame([(f"m{i}",) for i in range(7)], "entity string")
    got = {r["split"]: r["entities"] for r in split.split_report(split.split_entities(ids)).collect()}
    assert got == {"train": 4, "validation": 1, "test": 2}
    with pytest.raises(ValueError):
        split.split_entities(ids, 0.6, 0.2, 0.3)


def test_limits():
    assert split.limits() == {} and split.limits(preset=True) == {"train": 150, "validation": 40}
    assert split.limits(2) == {"train": 2, "validation": 1}


def test_resolve_and_durations(spark):
    df = spark.createDataFrame([(1, T0, 2.0)], "site_id int, ts timestamp_ntz, pred double")
    with pytest.raises(ValueError, match="y_true"):
        clean.resolve_columns(df, clean.PREDICTIONS)
    assert duration("3H") == "3 hour" and duration("1D") == "1 day" and duration("15min") == "15 minute"
    with pytest.raises(ValueError):
        duration("often")


def test_rank_puts_missing_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0)], "entity string, skill_w168 double")
    from wattframe.operators.ranking import rank_entities

    assert [r["entity"] for r in rank_entities(df, "skill_w168").collect()] == ["c", "b", "a"]
    assert [r["entity"] for r in rank_entities(df, "skill_w168", worst_first=False).collect()] == ["b", "c", "a"]


def test_sequences_with_holes(spark):
    df = reshape.add_time_features(
        table(spark, [("a", t, v) for t, v in zip(hours(0, 1, 2, 3), [1.0, None, 3.0, float("inf")])])
    )
    seqs = series.sliding_sequences(df, 1, 1, 1)
    r = one(series.nonfinite_sequence_report(seqs))
    assert (r["kept"], r["skipped"]) == (0, 3)
    assert series.drop_nonfinite_sequences(seqs).count() == 0


def test_meter_column_is_optional(spark):
    df = table(spark, [("a", T0, 1.0)])
    assert clean.filter_meter(df).count() == 1
    assert "meter" not in resample.resample_mean(df).columns
    assert clean.dataset_profile(df.withColumn("x", F.lit(float("nan")))).first()["missing_cells"] == 1
