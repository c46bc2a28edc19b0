"""Stored sketches: errors, merging in parts, and growing tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import sketches as sk

T0 = dt.datetime(2024, 1, 1)
PROBS = {"a": 0.05, "b": 0.5, "c": 0.95}


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(size=20000)
    rows = [("hot" if i % 3 else f"e{i % 60}", T0 + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows + [(None, T0, 1.0), ("none", T0, None), ("hot", None, 2.0)], "entity string, ts timestamp_ntz, value double").cache()


def errors(df, quantiles):
    known = {}
    for e, v in df.filter("value is not null").select("entity", "value").collect():
        known.setdefault(e, []).append(v)
    worst = 0.0
    for row in quantiles.collect():
        for name, p in PROBS.items():
            own = np.array(known[row.entity])
            worst = max(worst, p - (own <= row[name]).mean(), (own < row[name]).mean() - p)
    return worst


def test_rank_errors_are_bounded_however_it_is_merged(spark, readings, tmp_path):
    one = sk.reading_sketches(readings)
    path = str(tmp_path / "s")
    for part in range(4):
        sk.extend(sk.reading_sketches(readings.filter(F.coalesce(F.minute("ts"), F.lit(0)) % 4 == part)), path)
    parts = sk.stored_sketches(spark, path)
    twice = sk.merged_sketches(sk.merged_sketches(parts, ["entity", "day"]))
    for merged in (sk.merged_sketches(one), sk.merged_sketches(parts), twice):
        found = sk.sketched_quantiles(merged.filter("readings > 0"), PROBS)
        assert found.count() == 22 and errors(readings, found) < 0.02
    counts = lambda m: sorted(((r.entity, r.rows, r.readings, r.low, r.high) for r in m.collect()), key=str)
    assert counts(sk.merged_sketches(one)) == counts(twice)
    none = {r.entity: r for r in sk.sketched_quantiles(sk.merged_sketches(one), PROBS).collect()}["none"]
    assert (none.readings, none["mean"], none.b) == (0, None, None)


def test_few_readings_are_exact(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=k), float(k)) for k in range(100)], "entity string, ts timestamp_ntz, value double")
    row = sk.sketched_quantiles(sk.merged_sketches(sk.reading_sketches(df)), PROBS).first()
    assert (row.a, row.b, row.c, row["mean"]) == (4.0, 49.0, 94.0, 49.5)


def test_profile_of_a_grown_table(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("e"), "id").alias("entity"), F.lit(T0).alias("ts"), F.when(F.col("id") % 5 > 0, F.rand(1)).alias("value"))
    sk.extend(sk.profile_sketches(make(0, 30000)), path)
    first = sk.sketched_profile(sk.stored_sketches(spark, path)).first()
    sk.extend(sk.profile_sketches(make(20000, 50000)), path)
    grown = sk.sketched_profile(sk.stored_sketches(spark, path)).first()
    assert (first.total_rows, grown.total_rows, grown.missing_cells) == (30000, 60000, 12000)
    assert abs(first.entities / 30000 - 1) < 0.05 and abs(grown.entities / 50000 - 1) < 0.05
    empty = sk.sketched_profile(sk.profile_sketches(make(0, 0))).first()
    assert tuple(empty) == (0, 0, 0)
