"""Input tables derived from the given ones, as SQL that Spark and DuckDB share.

``{events}`` and the like stand for the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (given tables it reads, SQL)
TEXT: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": (
        ("events",),
        "select cast(user_id as string) entity, ts, event_id seq, cast(value as double) as value, "
        "'electricity' meter from {events}",
    ),
    # Missing values, zeros, repeated times, a second kind of meter.
    "dirty": (
        ("events",),
        "select cast(user_id as string) entity, ts, event_id*2 seq, "
        "case when event_id%17=0 then cast(null as double) when event_id%19=0 then 0e0 "
        "else cast(value as double) end as value, "
        "case when event_id%10=9 then 'water' else 'electricity' end meter from {events} "
        "union all "
        "select cast(user_id as string), ts, event_id*2+1, cast(value as double)+1e0, "
        "case when event_id%10=9 then 'water' else 'electricity' end from {events} where event_id%23=0",
    ),
    # Values coarse enough for runs of equal ones.
    "runs": (
        ("events",),
        "select cast(user_id as string) entity, ts, event_id*2 seq, "
        "case when event_id%17=0 then cast(null as double) when event_id%19=0 then 0e0 "
        "else cast(floor(value/40e0) as double) end as value from {events} "
        "union all "
        "select cast(user_id as string), ts, event_id*2+1, cast(floor((value+1e0)/40e0) as double) "
        "from {events} where event_id%23=0",
    ),
    # The same with one very long series that has no entity.
    "unnamed": (
        ("events",),
        "select case when user_id%4=0 then cast(null as string) else cast(user_id as string) end entity, ts, event_id*2 seq, "
        "case when event_id%17=0 then cast(null as double) when event_id%19=0 then 0e0 "
        "else cast(floor(value/40e0) as double) end as value from {events} "
        "union all "
        "select case when user_id%4=0 then cast(null as string) else cast(user_id as string) end, ts, event_id*2+1, "
        "cast(floor((value+1e0)/40e0) as double) from {events} where event_id%23=0",
    ),
    "by_type": (
        ("events",),
        "select event_type entity, ts, event_id seq, cast(value as double) as value from {events}",
    ),
    "predictions": (
        ("events",),
        "select cast(user_id as string) entity, ts, event_id, cast(value as double) y_true, "
        "cast(value as double)*0.9e0 + (event_id % 7) - 3 y_pred, "
        "case when event_type='error' then 1 else 0 end y_label, "
        "((event_id*7919) % 1000)/1000e0 * 0.7e0 + case when event_type='error' then 0.3e0 else 0e0 end y_score "
        "from {events}",
    ),
    "labelled": (
        ("labels", "documents"),
        "select l.doc_id, l.toxic, l.quality, (d.n_chars % 1000)/1000e0 score "
        "from {labels} l join {documents} d on l.doc_id = d.doc_id",
    ),
    # Long daily series with natural repeats of (entity, ts).
    "daily": (
        ("lineitem",),
        "select cast(l_suppkey as string) entity, l_shipdate ts, cast(l_extendedprice as double) as value, "
        "l_orderkey, l_linenumber, l_partkey from {lineitem}",
    ),
    # Times and values as text, some of them unreadable.
    "raw_text": (
        ("events",),
        "select cast(user_id as string) entity, event_id seq, "
        "case when event_id%29=0 then 'n/a' else cast(ts as string) end ts, "
        "case when event_id%31=0 then 'bad' else cast(value as string) end as value from {events}",
    ),
    "infinite": (
        ("events",),
        "select cast(user_id as string) entity, ts, event_id seq, "
        "case when event_id%37=0 then cast('Infinity' as double) when event_id%41=0 then cast('-Infinity' as double) "
        "when event_id%43=0 then cast(null as double) else cast(value as double) end as value from {events}",
    ),
    "named": (
        ("events",),
        "select concat(event_type, '-', cast(user_id as string)) entity, ts, event_id seq, "
        "cast(value as double) as value from {events}",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources, text = TEXT[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in sources})


def sql_prelude(recursive: bool = False) -> str:
    """The same tables as common table expressions for DuckDB."""
    parts = []
    for name, (sources, text) in TEXT.items():
        parts.append(f"{name} as ({text.format(**{t: t for t in sources})})")
    return ("with recursive " if recursive else "with ") + ",\n".join(parts)
