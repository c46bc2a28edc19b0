"""Forecast errors of a predictions table, globally or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import errors as E

METRICS = {"rmse": E.rmse, "mae": E.mae, "mape": E.mape, "smape": E.smape, "r2": E.r2, "nrmse": E.nrmse}


def forecast_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """The chosen error metrics in one pass. All are 0 where no finite pair is
    left; a metric that is undefined otherwise is NULL."""
    return df.groupBy(*by).agg(*error_columns(metrics, y_true, y_pred))


def error_columns(metrics: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    """The same as aggregate columns."""
    none_left = E.n_pairs(y_true, y_pred) == 0
    return [F.when(none_left, 0.0).otherwise(METRICS[m](y_true, y_pred)).alias(m) for m in metrics]


def forecast_loss(
    df: DataFrame,
    kind: str = "mse",
    delta: float = 1.0,
    by: Sequence[str] = (),
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """A training loss as a table aggregate: ``mse``, ``mae`` or ``huber``; any
    other name means ``mse``."""
    loss = {"mae": E.mae, "huber": lambda y, p: E.huber(y, p, delta)}.get(kind, E.mse)
    return df.groupBy(*by).agg(loss(y_true, y_pred).alias("loss"))
