"""Random series against plain loops, on both the usual and the hot-group path."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import classification, quality, quantiles, scaling, series, split
from wattframe.operators.reshape import add_time_features
from wattframe.plans import forecast

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "entity string, ts timestamp_ntz, seq long, value double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, seq = [], 0
    for e, n in (("hot", 400), ("b", 37), ("c", 5), ("d", 1)):
        t = T0
        for _ in range(n):
            t += dt.timedelta(hours=rng.choice([0, 0, 1, 1, 1, 2, 3, 30]))
            v = rng.choice([None, 0.0, 1.0, 1.0, 1.0, 2.0, rng.uniform(-50, 50)])
            for _ in range(rng.choice([1, 1, 1, 4])):
                out.append((e, t, seq, v))
                seq += 1
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    shuffled = list(rows)
    random.Random(3).shuffle(shuffled)
    return spark.createDataFrame(shuffled, SCHEMA).repartition(5).cache()


def by_entity(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], -1e99 if r[3] is None else r[3])):
        out.setdefault(r[0], []).append(r)
    return out


def loop_report(rows, g):
    """The report's order-dependent parts as a plain loop over one series."""
    n = len(rows)
    steps = [(b[1] - a[1]).total_seconds() / 3600 for a, b in zip(rows, rows[1:])]
    values = [r[3] for r in rows if r[3] is not None]
    stuck = count = 0
    current = None
    for v in values:
        if v == current:
            count += 1
            stuck += count >= int(48 / g)
        else:
            current, count = v, 1
    return {
        "total_records": n,
        "gaps_2h": sum(s > 2 * g for s in steps),
        "gaps_24h": sum(s > 24 for s in steps),
        "constant_ratio": stuck / len(values) if values else 1.0,
        "duplicate_ratio": (n - len({r[1] for r in rows})) / n,
        "mean_value": float(np.mean(values)) if values else 0.0,
        "std_value": float(np.std(values, ddof=1)) if len(values) > 1 else (None if values else 0.0),
        "median_value": float(np.median(values)) if values else 0.0,
    }


@pytest.mark.parametrize("limit", [3, 4_000_000])
@pytest.mark.parametrize("g,block", [(12, 2), (24, 50)])
def test_quality_report(df, rows, g, block, limit):
    got = {r["entity"]: r.asDict() for r in quality.quality_report(df, g, block_days=block, limit=limit).collect()}
    for e, series_rows in by_entity(rows).items():
        for k, v in loop_report(series_rows, g).items():
            assert got[e][k] == (pytest.approx(v) if v is not None else None), (e, k)


@pytest.mark.parametrize("limit", [3, 4_000_000])
def test_constant_runs_and_gaps(df, rows, limit):
    want = []
    for e, rs in by_entity(rows).items():
        known = [r for r in rs if r[3] is not None]
        i = 0
        while i < len(known):
            j = i
            while j + 1 < len(known) and known[j + 1][3] == known[i][3]:
                j += 1
            if j - i + 1 >= 3:
                want.append((e, known[i][3], known[i][1], known[j][1], j - i + 1))
            i = j + 1
    got = [tuple(r) for r in series.constant_runs(df, 3, block_days=2, limit=limit).collect()]
    assert sorted(got) == sorted(want)

    gaps = {(r["entity"], r["ts"]): (r["readings"], r["gap"]) for r in series.time_gaps(df, block_days=2, limit=limit).collect()}
    for e, rs in by_entity(rows).items():
        times = sorted({r[1] for r in rs})
        for p, t in zip([None, *times], times):
            assert gaps[(e, t)] == (sum(r[1] == t for r in rs), None if p is None else t - p)


@pytest.mark.parametrize("limit", [3, 4_000_000])
def test_quantiles(df, rows, limit):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    values = {}
    for r in rows:
        if r[3] is not None:
            values.setdefault(r[0], []).append(r[3])
    got = {r["entity"]: r for r in quantiles.exact_quantiles(df, "value", probs, ["entity"], limit).collect()}
    assert set(got) == set(values)
    for e, vs in values.items():
        for name, p in probs.items():
            assert got[e][name] == pytest.approx(np.quantile(vs, p))
    whole = quantiles.exact_quantiles(df, "value", probs).first()
    every = [v for vs in values.values() for v in vs]
    assert [whole[n] for n in probs] == pytest.approx([np.quantile(every, p) for p in probs.values()])


def test_order_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(0, 10.0 ** k, 200) for k in range(-8, 9, 2)] + [[0.0, -0.0, 5e-324, 1.7e308, -1.7e308]])
    from wattframe.functions.columns import order_bucket

    out = spark.createDataFrame([(float(v),) for v in vals], "v double").select("v", order_bucket("v").alias("b")).toPandas()
    assert out.sort_values("v")["b"].is_monotonic_increasing


@pytest.mark.parametrize("limit", [3, 4_000_000])
def test_auc_counts_pairs(spark, limit):
    rng = random.Random(5)
    data = [(rng.choice("xy"), int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "entity string, y_label int, y_score double")
    got = {r["entity"]: r["roc_auc"] for r in classification.roc_auc(df, ["entity"], limit=limit).collect()}
    for e in "xy":
        pos = [s for k, y, s in data if k == e and y]
        neg = [s for k, y, s in data if k == e and not y]
        pairs = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[e] == pytest.approx(pairs / (len(pos) * len(neg)))


@pytest.mark.parametrize("shape", [(5, 3, 2), (12, 4, 3), (2, 1, 7), (1, 1, 1)])
def test_sequences_equal_slicing(df, rows, shape):
    look, hor, stride = shape
    known = [r for r in rows if r[3] is not None]
    feats = add_time_features(df.filter("value is not null"))
    got = {
        (r["entity"], r["start_idx"]): ([x[-1] for x in r["x"]], r["y"])
        for r in series.sliding_sequences(feats, look, hor, stride, tiebreak=["seq"], block_days=3).collect()
    }
    want = {}
    for e in {r[0] for r in known}:
        v = [np.float32(r[3]) for r in sorted((r for r in known if r[0] == e), key=lambda r: (r[1], r[2]))]
        for i in range(0, len(v) - look - hor + 1, stride):
            want[(e, i)] = (v[i:i + look], v[i + look:i + look + hor])
    assert got == want


@pytest.mark.parametrize("method", ["blocks", "range"])
def test_lags_equal_shifting(df, rows, method):
    out = series.lag_columns(df, {"one": 1, "five": 5}, tiebreak=["seq"], block_days=2, method=method)
    got = {(r["entity"], r["seq"]): (r["one"], r["five"]) for r in out.collect()}
    for e in {r[0] for r in rows}:
        rs = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(rs):
            assert got[(e, r[2])] == (rs[i - 1][3] if i >= 1 else None, rs[i - 5][3] if i >= 5 else None)


def test_sampled_scaler_equals_windows(spark, df, rows):
    look, hor, stride, most = 6, 2, 1, 4
    feats = add_time_features(df)
    ids = spark.createDataFrame([("hot",), ("b",), ("d",)], "entity string")
    got = {r["feature"]: r for r in scaling.fit_scaler_sampled(feats, ids, look, hor, stride, most, tiebreak=["seq"]).collect()}
    seen = []
    for e in ("hot", "b", "d"):
        v = [r for r in sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2]))]
        for i in list(range(0, len(v) - look - hor + 1, stride * 10))[:most]:
            seen += v[i:i + look]
    vals = [r[3] for r in seen if r[3] is not None]
    assert got["value"]["mean"] == pytest.approx(np.mean(vals)) and got["value"]["var"] == pytest.approx(np.var(vals))
    assert got["hour"]["mean"] == pytest.approx(np.mean([r[1].hour for r in seen]))


def test_scaler_without_variance(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    s = {r["feature"]: (r["mean"], r["scale"]) for r in scaling.fit_scaler(df, ["a", "b"]).collect()}
    assert s == {"a": (2.0, 1.0), "b": (2.0, 1.0)}


def test_split_is_disjoint_exact_and_stable(spark):
    ids = spark.createDataFrame([(f"m{i}",) for i in range(503)], "entity string")
    a = {r["entity"]: r["split"] for r in split.split_entities(ids).collect()}
    b = {r["entity"]: r["split"] for r in split.split_entities(ids.repartition(17).orderBy(F.desc("entity"))).collect()}
    assert a == b and len(a) == 503
    assert [list(a.values()).count(s) for s in split.NAMES] == [301, 100, 102]
    c = {r["entity"]: r["split"] for r in split.split_entities(ids, seed=7).collect()}
    assert c != a


def test_same_answer_for_any_partitioning(spark, df):
    def run():
        rows = quality.quality_report(df, 12, block_days=2).orderBy("entity").collect()
        return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_linear_forecast_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = []
    for e in "abcd":
        v = 10.0
        for i in range(200):
            t = T0 + dt.timedelta(hours=i)
            v = 0.6 * v + 0.3 * t.hour + rng.normal()
            rows.append((e, t, i, float(v)))
    df = spark.createDataFrame(rows, SCHEMA)
    parts = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "validation"), ("d", "test")], "entity string, split string")
    got = forecast.forecast_linear(df, parts, lags=(1, 24)).toPandas().sort_values(["entity", "ts"])
    table = forecast.regression_table(df, (1, 24)).toPandas().sort_values(["entity", "ts"])
    cols = ["hour", "day_of_week", "month", "is_weekend", "is_working_hours", "quarter", "day_of_year", "lag_1", "lag_24"]
    x = np.column_stack([table[cols].to_numpy(float), np.ones(len(table))])
    train = table["entity"].isin(["a", "b"]).to_numpy()
    w, *_ = np.linalg.lstsq(x[train], table["value"].to_numpy()[train], rcond=None)
    assert len(got) == len(table) == 4 * 176
    assert np.allclose(got["y_pred"].to_numpy(), x @ w, atol=1e-3)
