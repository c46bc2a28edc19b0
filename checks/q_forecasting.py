"""Forecasts, batch scoring and the history view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wattframe.operators import series, split
from wattframe.plans import forecast
from wattframe.plans.anomaly import hour_of_week_score
from wattframe.plans.history import history_vs_forecast

from .fixtures import fixture
from .q_quality import FEATURES_CTE, H, L, STRIDE, features, split_ctes
from .q_series import STARTS_CTE
from .registry import query, r

SEASON, AHEAD = 12, 30

NAIVE_CTES = (
    "tail as (select entity, ts, value, row_number() over (partition by entity order by ts desc, seq desc) back, "
    "max(ts) over (partition by entity) last_ts from readings)",
    f"steps as (select unnest(range(1, {AHEAD + 1})) h)",
    "ends as (select entity, max(ts) last_ts from readings group by entity)",
    "naive as (select e.entity, cast(h as integer) h, e.last_ts + to_hours(cast(h as integer)) ts, t.value pred from ends e "
    f"cross join steps left join tail t on t.entity = e.entity and t.back = {SEASON} - (h - 1) % {SEASON})",
)


def naive(spark, d):
    return forecast.forecast_seasonal_naive(fixture(spark, d, "readings"), SEASON, AHEAD, "1H", tiebreak=["seq"])


@query("K1_forecast_seasonal_naive", f"select entity, h, ts, {r('pred')} from naive", *NAIVE_CTES)
def k1(spark, d):
    return naive(spark, d)


@query(
    "K2_forecast_profile",
    f"select s.entity, s.h, s.ts, {r('p.pred', 'pred')} from future s left join profile p on p.entity = s.entity "
    "and p.dow = isodow(s.ts) and p.hr = extract(hour from s.ts)",
    "profile as (select entity, isodow(ts) dow, extract(hour from ts) hr, avg(value) pred from dirty group by 1, 2, 3)",
    f"steps as (select cast(unnest(range(1, {AHEAD + 1})) as integer) h)",
    "future as (select entity, h, max(ts) + to_hours(h) ts from dirty, steps group by entity, h)",
)
def k2(spark, d):
    return forecast.forecast_profile(fixture(spark, d, "dirty"), AHEAD, "1H")


@query("K3_forecast_linear")
def k3(spark, d):
    df = fixture(spark, d, "readings")
    return forecast.forecast_linear(df, split.split_entities(df), lags=(4, 8), ridge=0.1, tiebreak=["seq"])


@query(
    "K3_forecast_linear_one_lag",
    f"select t.entity, t.split, t.ts, {r('t.value', 'y_true')}, {r('m.b + m.a * t.lagged', 'y_pred', 4)} from pairs t, line m",
    *split_ctes("readings", 0.6, 0.2),
    "lagging as (select *, lag(value, 4) over (partition by entity order by ts, seq) lagged from readings)",
    "pairs as (select g.*, s.split from lagging g join split s on s.entity = g.entity where value is not null and lagged is not null)",
    "line as (select regr_slope(value, lagged) a, regr_intercept(value, lagged) b from pairs where split = 'train')",
)
def k3_one_lag(spark, d):
    df = fixture(spark, d, "readings")
    out = forecast.forecast_linear(df, split.split_entities(df), lags=(4,), tiebreak=["seq"], use_calendar=False)
    return out.withColumn("y_pred", F.round("y_pred", 4))


# Two lags: the plane through the covariances.
def _lagged(source: str) -> tuple[str, str]:
    return (
        f"lagging as (select *, lag(value, 4) over w x1, lag(value, 8) over w x2 from {source} window w as (partition by entity order by ts, seq))",
        "known as (select * from lagging where value is not null and x1 is not null and x2 is not null)",
    )


def _plane(source: str, key: str = "") -> str:
    """Two slopes and a bias over the rows of ``source``, per ``key`` if there is one."""
    det = "nullif(var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ** 2, 0)"
    b1 = f"(covar_pop(x1, value) * var_pop(x2) - covar_pop(x2, value) * covar_pop(x1, x2)) / {det} b1"
    b2 = f"(covar_pop(x2, value) * var_pop(x1) - covar_pop(x1, value) * covar_pop(x1, x2)) / {det} b2"
    means = f"select {key + ', ' if key else ''}{b1}, {b2}, avg(value) my, avg(x1) m1, avg(x2) m2 from {source}"
    return f"plane as (select *, my - b1 * m1 - b2 * m2 b0 from ({means}{' group by ' + key if key else ''}))"


def _walk(source: str, join: str) -> tuple[str, str]:
    return (
        f"tails as (select entity, max(ts) last_ts, list(value order by ts desc, seq desc)[:8] back from {source} group by entity)",
        f"walk as (select t.entity, 0 h, t.last_ts, list_reverse(back) vals, b0, b1, b2 from tails t {join} "
        f"union all select entity, h + 1, last_ts, list_append(vals, b0 + b1 * vals[len(vals) - 3] + b2 * vals[len(vals) - 7]), b0, b1, b2 from walk where h < {AHEAD})",
    )


_AHEAD_OUT = f"select entity, h, last_ts + to_hours(h) ts, {r('vals[len(vals)]', 'pred', 4)} from walk where h > 0"
_TRAIN = "(select k.* from known k join split s on s.entity = k.entity where s.split = 'train')"
TWO_LAGS = {"lags": (4, 8), "tiebreak": ["seq"], "use_calendar": False}


@query(
    "K3_forecast_linear_two_lags",
    f"select k.entity, k.ts, {r('k.value', 'y_true')}, {r('b0 + b1 * x1 + b2 * x2', 'y_pred', 4)} from known k, plane",
    *split_ctes("readings", 0.6, 0.2),
    *_lagged("readings"),
    _plane(_TRAIN),
)
def k3_two_lags(spark, d):
    df = fixture(spark, d, "readings")
    models = forecast.linear_models(df, split.split_entities(df), **TWO_LAGS)
    return forecast.fitted_linear(df, models, **TWO_LAGS).withColumn("y_pred", F.round("y_pred", 4))


@query(
    "K3_forecast_linear_ahead",
    _AHEAD_OUT,
    *split_ctes("readings", 0.6, 0.2),
    *_lagged("readings"),
    _plane(_TRAIN),
    *_walk("readings", "cross join plane"),
    recursive=True,
)
def k3_ahead(spark, d):
    df = fixture(spark, d, "readings")
    models = forecast.linear_models(df, split.split_entities(df), **TWO_LAGS)
    return forecast.forecast_linear_ahead(df, models, horizon=AHEAD, **TWO_LAGS).withColumn("pred", F.round("pred", 4))


@query(
    "K3_forecast_linear_ahead_per_entity",
    _AHEAD_OUT,
    *_lagged("by_type"),
    _plane("known", "entity"),
    *_walk("by_type", "left join plane p on p.entity = t.entity"),
    recursive=True,
)
def k3_own(spark, d):
    df = fixture(spark, d, "by_type")
    models = forecast.linear_models(df, per_entity=True, **TWO_LAGS)
    return forecast.forecast_linear_ahead(df, models, horizon=AHEAD, **TWO_LAGS).withColumn("pred", F.round("pred", 4))


def mean_of_lookback(x: np.ndarray) -> np.ndarray:
    return np.repeat(x[:, :, -1].astype("float64").mean(axis=1, keepdims=True), H, axis=1)


@query(
    "K4_batch_predict",
    f"select s.entity, s.start_idx, cast(y.idx - s.start_idx - {L} + 1 as integer) h, {r('cast(y.value as float)', 'y_true')}, "
    f"{r('s.pred', 'y_pred')} from (select s.entity, s.start_idx, avg(cast(cast(f.value as float) as double)) pred from starts s "
    f"join features f on f.entity = s.entity and f.idx between s.start_idx and s.start_idx + {L - 1} group by 1, 2) s "
    f"join features y on y.entity = s.entity and y.idx between s.start_idx + {L} and s.start_idx + {L + H - 1}",
    FEATURES_CTE,
    STARTS_CTE,
)
def k4(spark, d):
    seqs = series.sliding_sequences(features(spark, d), L, H, STRIDE, tiebreak=["seq"])
    return forecast.batch_predict(seqs, mean_of_lookback)


def _filled(src: str, agg: str, fill: str, kind: str) -> str:
    return (
        f"select g.entity, g.ts, {r(f'case when b.ts is null then {fill} else b.v end', 'value')}, '{kind}' kind from "
        f"(select entity, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), interval '1 day')) ts from {src} group by entity) g "
        f"left join (select entity, date_trunc('day', ts) ts, {agg} v from {src} group by 1, 2) b on b.entity = g.entity and b.ts = g.ts"
    )


@query(
    "G6_history_vs_forecast",
    _filled("recent", "sum(value)", "0", "history") + " union all " + _filled("naive", "avg(pred)", "null", "forecast"),
    *NAIVE_CTES,
    "recent as (select * from (select entity, ts, value, max(ts) over (partition by entity) hi from dirty "
    "where meter = 'electricity' and value is not null) where ts >= hi - interval '14 days')",
)
def g6(spark, d):
    return history_vs_forecast(fixture(spark, d, "dirty"), naive(spark, d), "1D", "sum", 14)


@query(
    "X5_hour_of_week_score",
    f"select d.entity, d.ts, d.seq, {r('d.value', 'value')}, d.meter, {r('p.expected', 'expected', 4)}, "
    + r("case when p.n >= 2 and p.sd > 1e-9 then (d.value - p.expected) / p.sd end", "zscore", 4)
    + " from dirty d join profiles p on p.entity = d.entity and p.dow = isodow(d.ts) and p.hr = extract(hour from d.ts)",
    "profiles as (select entity, isodow(ts) dow, extract(hour from ts) hr, avg(value) expected, stddev_pop(value) sd, count(value) n "
    "from dirty group by 1, 2, 3)",
)
def x5(spark, d):
    scored = hour_of_week_score(fixture(spark, d, "dirty"))
    return scored.withColumns({c: F.round(c, 4) for c in ("expected", "zscore")})
