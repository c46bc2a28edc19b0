"""The streaming forms, run over the whole table once."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.session import shared_path
from wattframe.streaming import readings as st
from wattframe.streaming.alerts import keyed_state, stream_alerts

from .fixtures import table
from .q_cleaning import CAL_SQL, THREE_HOURS
from .registry import query, r


def events(spark, d):
    stream = st.read_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    return stream.select(F.col("user_id").cast("string").alias("entity"), "ts", F.col("event_id").alias("seq"), "value")


def finished(spark, stream):
    out, mark = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    st.run_once(stream, out, mark)
    return spark.read.schema(stream.schema).parquet(out)


def naive_time(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("X1_stream_time_features", f"select entity, ts, seq, {r('value')}, {CAL_SQL} from readings")
def x1(spark, d):
    return finished(spark, st.stream_time_features(events(spark, d)))


@query("X2_stream_dedup", "select distinct entity, ts from daily")
def x2(spark, d):
    stream = st.read_stream(spark, d, table(spark, d, "lineitem").schema, "lineitem.parquet")
    daily = stream.select(F.col("l_suppkey").cast("string").alias("entity"), F.col("l_shipdate").alias("ts"))
    return naive_time(finished(spark, st.stream_dedup(daily)))


#: A time after all readings.
NEVER = "2200-01-01 00:00:00"


def to_the_end(spark, stream, make, at):
    """``make`` of a stream and of an end marker at ``at``, run in two starts."""
    out, mark, ends = (shared_path(spark, f"stream-{n}") for n in ("out", "state", "ends"))
    whole = make(st.with_end(stream, ends))
    st.run_once(whole, out, mark)
    st.mark_end(spark, ends, stream.schema, at)
    st.run_once(whole, out, mark)
    return spark.read.schema(whole.schema).parquet(out)


@query(
    "X3_stream_resample",
    f"select entity, {THREE_HOURS} ts, {r('cast(avg(value) as float)', 'value')}, arg_min(meter, ts) meter from mixed group by 1, 2 having count(value) > 0",
    "mixed as (select cast(user_id as varchar) entity, ts, cast(value as double) as value, event_type meter from events)",
)
def x3(spark, d):
    stream = st.read_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    mixed = stream.select(F.col("user_id").cast("string").alias("entity"), "ts", "value", F.col("event_type").alias("meter"))
    return naive_time(to_the_end(spark, mixed, st.stream_resample, NEVER))


SILENCE_HOURS, STUCK = 36, 3


@query(
    "X4_stream_alerts",
    f"select entity, 'gap' kind, ts + interval '{SILENCE_HOURS} hours' ts, ts since, cast(null as bigint) n from spaced "
    f"where coalesce(after, timestamp '{NEVER}') - ts > interval '{SILENCE_HOURS} hours' "
    f"union all select entity, 'stuck', ts, since, cast({STUCK} as bigint) from placed where place = {STUCK}",
    "coarse as (select cast(user_id as varchar) entity, ts, floor(value / 40e0) as value from events)",
    "spaced as (select entity, ts, lead(ts) over (partition by entity order by ts) after from coarse)",
    "starts as (select *, case when value is distinct from lag(value) over (partition by entity order by ts, value) then 1 else 0 end begins "
    "from coarse where value is not null)",
    "runs_of as (select *, sum(begins) over (partition by entity order by ts, value rows unbounded preceding) run from starts)",
    "placed as (select *, row_number() over (partition by entity, run order by ts) place, min(ts) over (partition by entity, run) since from runs_of)",
)
def x4(spark, d):
    stream = st.read_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    coarse = stream.select(F.col("user_id").cast("string").alias("entity"), "ts", F.floor(F.col("value") / F.lit(40.0)).cast("double").alias("value"))
    with keyed_state(spark):
        found = to_the_end(spark, coarse, lambda s: stream_alerts(s, f"{SILENCE_HOURS} hours", STUCK), NEVER)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "since")})
