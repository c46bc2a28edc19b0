"""All registered queries, by inventory id, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .fixtures import sql_prelude

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its counterpart over the derived tables,
    with further common table expressions in ``ctes`` (``recursive``: some look at
    themselves)."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            _SQL[name] = ",\n".join([sql_prelude(recursive), *ctes]) + "\n" + sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (without a negative zero) and small integers widened,
    so that both engines print the same."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType)):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL form of ``tidy`` for one expression."""
    return f"round(cast({expr} as double), {digits}) + 0.0 as {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from . import q_cleaning, q_forecasting, q_metrics, q_quality, q_series, q_sketches, q_sources, q_streams  # noqa: F401
