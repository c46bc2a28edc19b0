"""Dense blocks: same answers, and no piece with too many rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattframe.operators import clean, quality, resample, series

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def dense(spark):
    """One day of one meter with thousands of distinct readings, one that hardly
    reports, and rows without an entity."""
    rng = random.Random(4)
    rows = [("hot", T0 + dt.timedelta(seconds=rng.uniform(0, 86400)), float(rng.randint(0, 3)), k) for k in range(3000)]
    rows += [("calm", T0 + dt.timedelta(days=k), float(k // 3), k) for k in range(12)]
    rows += [(None, T0 + dt.timedelta(hours=5 * k), float(k % 2), k) for k in range(40)]
    return spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double, seq int").cache()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_no_piece_is_large(dense):
    for limit in (40, 200):
        sizes = series.with_pieces(dense, "entity", "ts", 32, limit).groupBy("entity", "_blk").count()
        assert sizes.agg(F.max("count")).first()[0] <= limit
        calm = sizes.filter("entity = 'calm'").collect()
        assert [r["count"] for r in calm] == [12]
    assert series.with_pieces(dense, "entity", "ts", 32).groupBy("entity").agg(F.countDistinct("_blk").alias("n")).filter("n > 1").count() == 0


def test_pieces_follow_the_time(dense):
    rows = series.with_pieces(dense, "entity", "ts", 5, 60).filter("entity = 'hot'").orderBy("ts").collect()
    assert all(a._blk <= b._blk for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("limit", [30, 500])
def test_answers_do_not_depend_on_pieces(dense, limit):
    assert rows_of(series.time_gaps(dense, limit=limit)) == rows_of(series.time_gaps(dense))
    assert rows_of(series.constant_runs(dense, 3, limit=limit)) == rows_of(series.constant_runs(dense, 3))
    places = lambda n: rows_of(series.row_index(dense, tiebreak=["seq"], limit=n).select("entity", "seq", "idx"))
    assert places(limit) == places(10**7)
    near = lambda df: sorted((r.entity or "", [round(x, 9) if isinstance(x, float) else x for x in r[1:]]) for r in df.collect())
    assert near(quality.quality_report(dense, limit=limit)) == near(quality.quality_report(dense))


def test_a_missing_entity_is_a_series(dense):
    gaps = series.time_gaps(dense).filter("entity is null")
    assert gaps.count() == 40 and gaps.filter("gap is null").count() == 1
    assert clean.recent_history(dense, 2).filter("entity is null").count() == 10
    row = quality.quality_report(dense).filter("entity is null").first()
    assert row.total_records == 40 and row.median_value == 0.5 and row.mean_value == 0.5


def test_ties_without_a_tiebreak_have_one_order(spark):
    rows = [("a", T0, float(v), v) for v in (5, 3, 9, 1)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double, seq int").repartition(3)
        assert [r.value for r in series.row_index(df).orderBy("idx").collect()] == [1, 3, 5, 9]


def test_gaps_are_filled_over_blocks(spark):
    rows = [("a", T0 + dt.timedelta(days=d), 1.0) for d in (0, 1, 70, 200)] + [(None, T0, 2.0), (None, T0 + dt.timedelta(days=40), 4.0)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double")
    for days in (1, 7, 32, 400):
        out = resample.resample(df, "1D", "sum", block_days=days).collect()
        days_of = sorted((r.ts - T0).days for r in out if r.entity == "a")
        assert days_of == list(range(201)) and sum(r.value for r in out if r.entity == "a") == 4
        assert len([r for r in out if r.entity is None]) == 41
