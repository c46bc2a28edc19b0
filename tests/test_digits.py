"""Order keys of doubles, and what is cut by their digits."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions.columns import order_key
from wattframe.operators import classification, quantiles
from wattframe.operators.grouping import split_hot

from .test_plans import plan


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x) if x == 0 else x))[0]
    return n if x >= 0 else -(n & (2**63 - 1))


def test_order_key_is_the_bits_of_the_number(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf]
    values += [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, s) for e in range(-1000, 1000, 13) for s in (0, math.inf)]
    while len(values) < 4000:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if not math.isnan(x):
            values.append(x)
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key("v").alias("k")).collect()
    assert all(r.k == bits(r.v) for r in got)
    last = spark.createDataFrame([(math.nan,), (math.inf,)], "v double").select("v", order_key("v").alias("k")).orderBy("k").collect()
    assert math.isnan(last[1].v)


def crowded(n, seed=3):
    """Scores that all fall into one coarse bucket, nearly all distinct; one that
    repeats, and a few far away."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", None]), int(rng.random() < 0.4), 0.5 + rng.random() * 1e-4) for _ in range(n)]
    rows += [("a", k % 2, 0.50005) for k in range(40)] + [("a", 1, -2.0), ("a", 0, 9.0), (None, 0, 0.1)]
    return rows


def pairs(rows):
    pos = np.array([s for _, y, s in rows if y == 1])
    neg = np.array([s for _, y, s in rows if y == 0])
    wins = (pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digit", [23, 30, 4])
def test_auc_of_a_crowded_bucket(spark, digit):
    rows = crowded(900)
    df = spark.createDataFrame(rows, "entity string, y_label int, y_score double")
    got = {r.entity: r.roc_auc for r in classification.roc_auc(df, ["entity"], limit=50, digit=digit).collect()}
    for e in ("a", None):
        assert got[e] == pytest.approx(pairs([r for r in rows if r[0] == e]))
    assert classification.roc_auc(df, limit=50, digit=digit).first().roc_auc == pytest.approx(pairs(rows))


@pytest.mark.parametrize("digit", [23, 30, 4])
def test_quantiles_of_a_crowded_bucket(spark, digit):
    rows = crowded(900)
    df = spark.createDataFrame(rows, "entity string, y_label int, y_score double")
    probs = {"low": 0.01, "mid": 0.5, "high": 0.987}
    got = {r.entity: r for r in quantiles.exact_quantiles(df, "y_score", probs, ["entity"], 50, digit).collect()}
    for e in ("a", None):
        own = [s for x, _, s in rows if x == e]
        assert [got[e][n] for n in probs] == pytest.approx([np.quantile(own, p) for p in probs.values()], rel=1e-12)
    whole = quantiles.exact_quantiles(df, "y_score", probs, digit=digit).first()
    assert [whole[n] for n in probs] == pytest.approx([np.quantile([s for _, _, s in rows], p) for p in probs.values()], rel=1e-12)


def test_windows_over_crowded_buckets_are_bounded(spark):
    df = spark.createDataFrame(crowded(4000), "entity string, y_label int, y_score double")
    # A digit of 38 bits cuts the bucket of 4,000 scores into leaves of a few.
    keys = df.select("y_score", F.shiftright(order_key("y_score"), 33).alias("leaf")).distinct()
    assert keys.groupBy("leaf").count().agg(F.max("count")).first()[0] < 80
    p = plan(classification.roc_auc(df, limit=50))
    ordered = [line for line in p.splitlines() if "Window [" in line and "_q" in line]
    assert any("_leaf" in line for line in ordered) and any("_node" in line for line in ordered)


def test_hot_groups_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 1)] * 9 + [("a", 2)] * 3 + [("b", None)] * 7, "k string, v int")
    small, large = split_hot(df, ["k"], 5, "n")
    assert {(r.k, r.n) for r in large.collect()} == {(None, 9), ("b", 7)} and large.count() == 16
    assert small.collect() == [("a", 2)] * 3 and split_hot(df, ["k"], 5)[1].columns == ["k", "v"]
