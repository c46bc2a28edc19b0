"""Regression from merged sums, and steps ahead, against plain least squares."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattframe.functions.columns import CALENDAR
from wattframe.operators.regression import moments, predicted, solved
from wattframe.plans import forecast


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_weights_equal_least_squares(spark, ridge):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) * [1, 100, 0.01, 5] + [0, 1e4, 3, -2]
    y = x @ [2.0, -0.5, 70.0, 1.0] + 9 + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, g=["p", "q"] * 200)
    pdf.loc[[3, 8], "a"] = None
    fit = solved(moments(spark.createDataFrame(pdf), list("abcd"), "y", ["g"]), 4, ridge).toPandas().set_index("g")
    for g, own in pdf.dropna().groupby("g"):
        m = own[list("abcd")].to_numpy()
        c = np.cov(m.T, bias=True)
        want = np.linalg.solve(c + ridge * np.diag(np.diag(c)), ((m - m.mean(0)) * (own.y - own.y.mean()).to_numpy()[:, None]).mean(0))
        assert np.allclose(fit.weights[g], want, rtol=1e-6) and np.isclose(fit.bias[g], own.y.mean() - m.mean(0) @ want)
        assert fit.n[g] == len(own)


def test_inputs_that_others_explain_have_no_weight(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "k": 7.0, "b": 2 * np.arange(50.0) + 1, "y": 3 * np.arange(50.0) - 4})
    fit = solved(moments(spark.createDataFrame(pdf), ["a", "k", "b"], "y"), 3).first()
    assert np.allclose(fit.weights, [3, 0, 0]) and np.isclose(fit.bias, -4)
    none = solved(moments(spark.createDataFrame(pdf).limit(0), ["a"], "y"), 1).first()
    assert none.n == 0 and none.weights is None and none.bias is None


def series(entities, n, seed=2):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 3, 1, 5)
    rows = []
    for e in entities:
        for k in range(n):
            rows.append((e, start + dt.timedelta(hours=k), float(10 + 5 * np.sin(k / 4) + rng.normal())))
    return rows


def test_steps_ahead_with_calendar(spark):
    rows = series(["a", "b", None], 120) + [("short", dt.datetime(2024, 3, 1), 4.0)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double")
    opts = {"lags": (2, 5), "ridge": 0.01}
    models = forecast.linear_models(df, **opts)
    got = forecast.forecast_linear_ahead(df, models, (2, 5), horizon=12).toPandas()
    weights, bias = models.first().weights, models.first().bias
    assert got.groupby(got.entity.fillna("-")).size().to_dict() == {"a": 12, "b": 12, "-": 12, "short": 12}
    for e in ("a", "b"):
        known = [v for x, _, v in rows if x == e]
        last = max(t for x, t, _ in rows if x == e)
        for h in range(1, 13):
            t = pd.Timestamp(last + dt.timedelta(hours=h))
            weekend = t.weekday() >= 5
            c = [t.hour, t.weekday(), t.month, weekend, 8 <= t.hour <= 18 and not weekend, t.quarter, t.dayofyear]
            known.append(bias + float(np.dot(weights, [*map(float, c), known[-2], known[-5]])))
        own = got[got.entity == e].sort_values("h")
        assert np.allclose(own.pred, known[-12:]) and list(own.ts)[-1] == last + dt.timedelta(hours=12)
    # One reading: the lags of steps 3, 4, 6 and so on are there, but never both.
    assert got[got.entity == "short"].pred.isna().all()
    per = forecast.linear_models(df, per_entity=True, **opts)
    assert {r.entity: r.n for r in per.collect()} == {"a": 115, "b": 115, None: 115}
    assert forecast.forecast_linear_ahead(df, per, (2, 5), horizon=3).filter("pred is not null").count() == 9


def test_fitted_rows_equal_the_library(spark):
    df = spark.createDataFrame(series(["a", "b"], 90), "entity string, ts timestamp_ntz, value double")
    split = spark.createDataFrame([("a", "train"), ("b", "test")], "entity string, split string")
    models = forecast.linear_models(df, split, lags=(1, 3), use_calendar=False)
    own = forecast.fitted_linear(df, models, (1, 3), use_calendar=False).select("entity", "ts", F.col("y_pred").alias("p"))
    library = forecast.forecast_linear(df, split, (1, 3), use_calendar=False)
    both = own.join(library, ["entity", "ts"]).toPandas()
    assert len(both) == 174 and np.allclose(both.p, both.y_pred)
    assert len(CALENDAR) == 7 and predicted is not None
