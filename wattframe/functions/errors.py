"""Forecast-error aggregates as Column expressions.

Each takes truth and prediction columns and is one pass of ordinary partial
aggregates, so it works in ``agg`` with or without grouping. Rows where either
side is NULL, NaN or infinite do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_col, is_finite, ratio

# Fixed value: guards the percentage errors against zero truth.
EPSILON = 1e-10


def _both(y, p) -> tuple[Column, Column]:
    y, p = as_col(y).cast("double"), as_col(p).cast("double")
    ok = is_finite(y) & is_finite(p)
    return F.when(ok, y), F.when(ok, p)


def n_pairs(y, p) -> Column:
    y, p = _both(y, p)
    return F.count(y)


def mse(y, p) -> Column:
    y, p = _both(y, p)
    return F.avg((y - p) * (y - p))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    y, p = _both(y, p)
    return F.avg(F.abs(y - p))


def mape(y, p) -> Column:
    y, p = _both(y, p)
    return 100 * F.avg(F.when(F.abs(y) > EPSILON, F.abs((y - p) / F.nullif(y, F.lit(0.0)))))


def smape(y, p) -> Column:
    y, p = _both(y, p)
    return 100 * F.avg(F.abs(p - y) / ((F.abs(y) + F.abs(p)) / 2 + EPSILON))


def r2(y, p) -> Column:
    y, p = _both(y, p)
    n = F.count(y)
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * n
    return F.when(n >= 2, F.when(sst > 0, 1 - ratio(sse, sst)).when(sse == 0, 1.0).otherwise(0.0))


def nrmse(y, p) -> Column:
    yy, _ = _both(y, p)
    spread = F.max(yy) - F.min(yy)
    return F.when(spread > 0, ratio(rmse(y, p), spread)).when(spread == 0, 0.0)


def huber(y, p, delta: float = 1.0) -> Column:
    y, p = _both(y, p)
    e = F.abs(y - p)
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))
