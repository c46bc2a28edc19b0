"""Reshape, cleaning, resampling and per-entity statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wattframe.functions.columns import CALENDAR
from wattframe.operators import clean, ranking, resample, reshape, series
from wattframe.plans.preprocess import preprocess

from .fixtures import fixture, table
from .registry import query, r, rs

TYPES = ["click", "error", "purchase", "signup", "view"]

CAL_SQL = """cast(extract(hour from ts) as integer) "hour", cast(isodow(ts)-1 as integer) day_of_week,
 cast(extract(month from ts) as integer) "month", cast(isodow(ts)>=6 as integer) is_weekend,
 cast(extract(hour from ts) between 8 and 18 and isodow(ts)<6 as integer) is_working_hours,
 cast(extract(quarter from ts) as integer) "quarter", cast(extract(doy from ts) as integer) day_of_year"""

THREE_HOURS = "time_bucket(interval '3 hours', ts)"

WIDE_CTE = (
    "wide as (select date_trunc('hour', ts) ts, "
    + ", ".join(f"avg(case when event_type='{t}' then value end) {t}" for t in TYPES)
    + " from events group by 1)"
)


def wide(spark, d):
    """Mean value per hour, one column per type of event."""
    hourly = table(spark, d, "events").withColumn("timestamp", F.window("ts", "1 hour")["start"])
    return hourly.groupBy("timestamp").pivot("event_type", TYPES).agg(F.avg("value"))


@query(
    "P1_wide_to_long",
    " union all ".join(
        f"select ts, '{t}' entity, {r(f'cast({t} as float)', 'value')}, 'electricity' meter from wide" for t in TYPES
    ),
    WIDE_CTE,
)
def p1(spark, d):
    return reshape.wide_to_long(wide(spark, d), "timestamp")


@query(
    "P2_long_to_wide",
    "select g.ts, "
    + ", ".join(r(f"max(case when entity='{t}' then value end)", t) for t in TYPES)
    + " from (select distinct ts from grid) g left join bins b on b.ts = g.ts group by g.ts",
    "bins as (select entity, date_trunc('hour', ts) ts, avg(value) as value from by_type group by 1, 2)",
    "grid as (select entity, unnest(generate_series(min(ts), max(ts), interval '1 hour')) ts from bins group by entity)",
)
def p2(spark, d):
    return reshape.long_to_wide(fixture(spark, d, "by_type"), TYPES, "1H")


@query("P3_add_time_features", f"select entity, ts, seq, {r('value')}, meter, {CAL_SQL} from readings")
def p3(spark, d):
    return reshape.add_time_features(fixture(spark, d, "readings"))


METRICS_CTE = (
    "metrics as (select entity, sqrt(avg((y_true-y_pred)*(y_true-y_pred))) rmse, avg(abs(y_true-y_pred)) mae, "
    "100*avg(case when abs(y_true)>1e-10 then abs((y_true-y_pred)/y_true) end) mape from predictions group by entity)"
)
# A mean load of zero for some entities exercises the guarded division.
LOAD_CTE = (
    "loads as (select entity, case when cast(entity as bigint) % 50 = 0 then 0e0 else avg(value) end mean_load "
    "from readings group by entity)"
)


def metrics_with_load(spark, d):
    from wattframe.operators.evaluation import add_mean_load
    from wattframe.operators.forecast_metrics import forecast_metrics

    m = forecast_metrics(fixture(spark, d, "predictions"), ["entity"], metrics=("rmse", "mae", "mape"))
    return add_mean_load(m, fixture(spark, d, "readings"))


@query(
    "P4_add_error_ratios",
    f"select entity, {rs('rmse','mae','mape','mean_load')}, {r('rmse/nullif(mean_load,0)','nrmse')}, "
    f"{r('100*mae/nullif(mean_load,0)','wape_pct')}, {r('mape','mape_pct')} from metrics join loads using (entity)",
    METRICS_CTE,
    LOAD_CTE,
)
def p4(spark, d):
    zero = F.col("entity").cast("bigint") % 50 == 0
    m = metrics_with_load(spark, d)
    return reshape.add_error_ratios(m.withColumn("mean_load", F.when(zero, 0.0).otherwise(F.col("mean_load"))))


@query("C1_filter_meter", f"select entity, ts, seq, {r('value')}, meter from dirty where meter = 'water'")
def c1(spark, d):
    return clean.filter_meter(fixture(spark, d, "dirty"), "water")


@query(
    "C2_drop_unparseable_time",
    "select entity, seq, cast(ts as timestamp) ts, value from raw_text where try_cast(ts as timestamp) is not null",
)
def c2(spark, d):
    return clean.drop_unparseable_time(fixture(spark, d, "raw_text"))


@query(
    "C3_numeric_coerce",
    f"select entity, seq, ts, {r('value')} from (select entity, seq, ts, try_cast(value as double) as value from raw_text) "
    "where value is not null",
)
def c3(spark, d):
    return clean.numeric_coerce(fixture(spark, d, "raw_text"))


@query("C4_drop_null_rows", f"select entity, ts, seq, {r('value')}, meter from dirty where value is not null")
def c4(spark, d):
    return clean.drop_null_rows(fixture(spark, d, "dirty"))


@query(
    "C4_drop_report",
    "select count(*) rows_before, count(value) rows_after, count(*) - count(value) rows_dropped from dirty",
)
def c4_report(spark, d):
    df = fixture(spark, d, "dirty")
    return clean.drop_report(df, clean.drop_null_rows(df))


@query(
    "C5_drop_inf_rows", f"select entity, ts, seq, {r('value')} from infinite where value is null or not isinf(value)"
)
def c5(spark, d):
    return clean.drop_inf_rows(fixture(spark, d, "infinite"))


@query("C6_filter_name", f"select entity, ts, seq, {r('value')} from named where contains(lower(entity), 'click-1')")
def c6(spark, d):
    return clean.filter_name(fixture(spark, d, "named"), "CLICK-1")


@query(
    "C6_filter_name_regex",
    f"select entity, ts, seq, {r('value')} from named where regexp_matches(entity, '^(view|sign).*5$', 'i')",
)
def c6_regex(spark, d):
    return clean.filter_name(fixture(spark, d, "named"), "^(VIEW|sign).*5$", regex=True)


@query("C7_resolve_columns", f"select entity, ts, {rs('y_true', 'y_pred')} from predictions")
def c7(spark, d):
    p = fixture(spark, d, "predictions").select(
        F.col("entity").cast("bigint").alias("bldg_id"),
        F.col("ts").alias("timestamp_utc"),
        F.col("y_true").alias("target"),
        F.col("y_pred").alias("yhat"),
        "event_id",
    )
    return clean.resolve_columns(p, clean.PREDICTIONS)


@query(
    "C8_recent_history",
    f"select entity, ts, seq, {r('value')}, meter from (select *, max(ts) over (partition by entity) hi from dirty) "
    "where ts >= hi - interval '7 days'",
)
def c8(spark, d):
    return clean.recent_history(fixture(spark, d, "dirty"), 7)


@query(
    "C8_recent_history_null_entity",
    f"select entity, ts, seq, {r('value')} from (select *, max(ts) over (partition by entity) hi from unnamed) "
    "where ts >= hi - interval '7 days'",
)
def c8_null(spark, d):
    return clean.recent_history(fixture(spark, d, "unnamed"), 7)


KEEP_SQL = (
    f"select entity, ts, seq, {r('value')}, meter from dirty where entity in "
    "(select entity from dirty group by entity having count(case when value = 0 then 1 end) >= 4)"
)


@query("C9_filter_entities", KEEP_SQL)
def c9(spark, d):
    df = fixture(spark, d, "dirty")
    ids = df.groupBy("entity").agg(F.count_if(F.col("value") == 0).alias("z")).filter("z >= 4")
    return clean.filter_entities(df, ids)


@query("J5_semi_join_ids", KEEP_SQL)
def j5(spark, d):
    df = fixture(spark, d, "dirty")
    ids = df.groupBy("entity").agg(F.count_if(F.col("value") == 0).alias("z")).filter("z >= 4")
    return clean.filter_entities(df, ids.select("entity"))


@query(
    "C10_dedup",
    f"select entity, ts, seq, {r('value')}, meter from dirty "
    "qualify row_number() over (partition by entity, ts order by seq) = 1",
)
def c10(spark, d):
    return clean.dedup(fixture(spark, d, "dirty"))


DAILY_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "value")


@query(
    "C10_dedup_daily",
    f"select entity, ts, {r('value')}, l_orderkey, l_linenumber, l_partkey from daily "
    "qualify row_number() over (partition by entity, ts order by l_orderkey, l_linenumber, l_partkey, value) = 1",
)
def c10_daily(spark, d):
    return clean.dedup(fixture(spark, d, "daily"), tiebreak=DAILY_ORDER)


@query(
    "C10_dedup_report",
    "select count(*) rows_before, count(distinct (entity, ts)) rows_after, "
    "count(*) - count(distinct (entity, ts)) rows_dropped from daily",
)
def c10_report(spark, d):
    return clean.dedup_report(fixture(spark, d, "daily"))


BINS_CTE = (
    f"bins as (select entity, {THREE_HOURS} ts, cast(avg(value) as float) as value, "
    "arg_min(meter, (ts, meter)) meter from dirty group by 1, 2 having avg(value) is not null)"
)


@query(
    "C11_retention_report",
    f"select i.n rows_in, o.n rows_out, i.e entities_in, o.e entities_out, {r('100e0*o.n/i.n', 'retention_pct')} from "
    "(select count(*) n, count(distinct entity) e from dirty) i, (select count(*) n, count(distinct entity) e from bins) o",
    BINS_CTE,
)
def c11(spark, d):
    df = fixture(spark, d, "dirty")
    return clean.retention_report(df, preprocess(df, resample_3h=True))


@query(
    "C12_preprocess",
    f"select entity, ts, seq, {r('value')}, meter, {CAL_SQL} from dirty "
    "qualify row_number() over (partition by entity, ts order by seq) = 1",
)
def c12(spark, d):
    return preprocess(fixture(spark, d, "dirty"))


@query("C12_preprocess_3h", f"select entity, ts, {r('value', digits=4)}, meter, {CAL_SQL} from bins", BINS_CTE)
def c12_3h(spark, d):
    df = preprocess(fixture(spark, d, "dirty"), resample_3h=True)
    return df.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("A1_resample_3h", f"select entity, ts, {r('value', digits=4)}, meter from bins", BINS_CTE)
def a1(spark, d):
    df = resample.resample_mean(fixture(spark, d, "dirty"))
    return df.withColumn("value", F.round(F.col("value").cast("double"), 4))


def _resampled(source: str, step: str, agg: str, fill: str = "null") -> tuple[str, str, str]:
    return (
        f"select g.entity, g.ts, {r(f'case when b.ts is null then {fill} else b.value end', 'value')} "
        "from grid g left join bins b on b.entity = g.entity and b.ts = g.ts",
        f"bins as (select entity, time_bucket(interval '{step}', ts) ts, {agg} as value from {source} group by 1, 2)",
        f"grid as (select entity, unnest(generate_series(min(ts), max(ts), interval '{step}')) ts from bins group by entity)",
    )


@query("A2_resample_mean_1h", *_resampled("dirty", "1 hour", "avg(value)"))
def a2_mean(spark, d):
    return resample.resample(fixture(spark, d, "dirty"), "1H", "mean")


@query("A2_resample_sum_6h", *_resampled("dirty", "6 hours", "coalesce(sum(value), 0)", "0"))
def a2_sum(spark, d):
    return resample.resample(fixture(spark, d, "dirty"), "6H", "sum")


@query("A2_resample_median_1d", *_resampled("dirty", "1 day", "median(value)"))
def a2_median(spark, d):
    return resample.resample(fixture(spark, d, "dirty"), "1D", "median")


@query("A2_resample_daily_sum", *_resampled("daily", "1 day", "coalesce(sum(value), 0)", "0"))
def a2_daily(spark, d):
    return resample.resample(fixture(spark, d, "daily"), "1D", "sum")


@query("A3_reading_counts", "select entity, count(ts) readings from dirty group by entity")
def a3(spark, d):
    return resample.reading_counts(fixture(spark, d, "dirty"))


@query("A4_mean_load", f"select entity, {r('avg(value)', 'mean_load')} from dirty group by entity")
def a4(spark, d):
    return resample.mean_load(fixture(spark, d, "dirty"))


@query(
    "A10_dataset_profile",
    "select count(*) total_rows, count(*) - count(value) missing_cells, count(distinct entity) entities from dirty",
)
def a10(spark, d):
    return clean.dataset_profile(fixture(spark, d, "dirty"))


@query(
    "A11_metric_summary",
    f"select {r('avg(rmse)', 'mean')}, {r('median(rmse)', 'median')} from metrics",
    METRICS_CTE,
)
def a11(spark, d):
    return resample.metric_summary(metrics_with_load(spark, d), "rmse")


@query(
    "A12_series_bounds",
    "select entity, max(ts) history_last, max(ts) + interval '1 hour' forecast_first from readings group by entity",
)
def a12(spark, d):
    past = fixture(spark, d, "readings").select("entity", "ts", F.lit("history").alias("kind"))
    ends = past.groupBy("entity").agg(F.max("ts").alias("ts"))
    ahead = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(24)))).select(
        "entity", (F.col("ts") + F.col("h") * F.lit(dt.timedelta(hours=1))).alias("ts"), F.lit("forecast").alias("kind")
    )
    return resample.series_bounds(past.unionByName(ahead))


@query(
    "J1_join_mean_load",
    f"select m.entity, {rs('rmse', 'mae', 'mape')}, {r('avg(value)', 'mean_load')} from metrics m "
    "left join readings d on d.entity = m.entity group by m.entity, rmse, mae, mape",
    METRICS_CTE,
)
def j1(spark, d):
    return metrics_with_load(spark, d)


@query("O1_sort_by_entity_time", f"select entity, ts, seq, {r('value')}, meter from dirty order by entity, ts, seq")
def o1(spark, d):
    return fixture(spark, d, "dirty").orderBy("entity", "ts", "seq")


@query(
    "O3_top_by_readings",
    "select entity, count(ts) readings from dirty where value is not null group by entity order by readings desc, entity limit 10",
)
def o3(spark, d):
    return ranking.top_by_readings(clean.numeric_coerce(fixture(spark, d, "dirty")), 10)


@query(
    "W1_time_gaps",
    "select entity, ts, readings, prev_ts, "
    + r("(epoch_us(ts) - epoch_us(prev_ts)) / 3600000000.0", "gap_hours")
    + " from (select *, lag(ts) over (partition by entity order by ts) prev_ts from "
    "(select entity, ts, count(*) readings from dirty group by 1, 2))",
)
def w1(spark, d):
    from wattframe.functions.columns import hours_between

    gaps = series.time_gaps(fixture(spark, d, "dirty"), block_days=5)
    return gaps.withColumn("gap_hours", hours_between("prev_ts", "ts")).drop("gap")


@query(
    "W1_time_gaps_daily",
    "select entity, ts, readings, prev_ts, "
    + r("(epoch_us(ts) - epoch_us(prev_ts)) / 3600000000.0", "gap_hours")
    + " from (select *, lag(ts) over (partition by entity order by ts) prev_ts from "
    "(select entity, ts, count(*) readings from daily group by 1, 2))",
)
def w1_daily(spark, d):
    from wattframe.functions.columns import hours_between

    gaps = series.time_gaps(fixture(spark, d, "daily"))
    return gaps.withColumn("gap_hours", hours_between("prev_ts", "ts")).drop("gap")


@query(
    "W1_time_gaps_null_entity",
    "select entity, ts, readings, prev_ts, "
    + r("(epoch_us(ts) - epoch_us(prev_ts)) / 3600000000.0", "gap_hours")
    + " from (select *, lag(ts) over (partition by entity order by ts) prev_ts from "
    "(select entity, ts, count(*) readings from unnamed group by 1, 2))",
)
def w1_null(spark, d):
    from wattframe.functions.columns import hours_between

    # Blocks of more than a few rows are cut into pieces.
    gaps = series.time_gaps(fixture(spark, d, "unnamed"), block_days=5, limit=12)
    return gaps.withColumn("gap_hours", hours_between("prev_ts", "ts")).drop("gap")


@query(
    "W2_duplicate_flags",
    "select entity, ts, l_orderkey, l_linenumber, l_partkey, "
    f"{r('value')}, row_number() over (partition by entity, ts "
    "order by l_orderkey, l_linenumber, l_partkey, value) > 1 is_duplicate from daily",
)
def w2(spark, d):
    return series.duplicate_flags(fixture(spark, d, "daily"), tiebreak=DAILY_ORDER)


RUNS_CTES = (
    "known as (select entity, ts, value, row_number() over w rn, lag(value) over w pv from {src} where value is not null "
    "window w as (partition by entity order by ts, value))",
    "run_rows as (select *, sum(case when pv is null or pv <> value then 1 else 0 end) "
    "over (partition by entity order by rn rows unbounded preceding) rid from known)",
    "run_lengths as (select entity, rid, min(value) as value, min(ts) run_start, max(ts) run_end, count(*) run_length "
    "from run_rows group by entity, rid)",
)


def runs_ctes(src: str) -> tuple[str, ...]:
    return tuple(c.replace("{src}", src) for c in RUNS_CTES)


@query(
    "W3_constant_runs",
    f"select entity, {r('value')}, run_start, run_end, run_length from run_lengths where run_length >= 4",
    *runs_ctes("runs"),
)
def w3(spark, d):
    return series.constant_runs(fixture(spark, d, "runs"), 4, block_days=3)


@query(
    "W3_constant_runs_dense",
    f"select entity, {r('value')}, run_start, run_end, run_length from run_lengths where run_length >= 4",
    *runs_ctes("unnamed"),
)
def w3_dense(spark, d):
    return series.constant_runs(fixture(spark, d, "unnamed"), 4, block_days=3, limit=12)


@query(
    "P3_stored_types",
    "select entity, ts, "
    + CAL_SQL.replace("cast(isodow(ts)>=6 as integer)", "isodow(ts)>=6").replace(
        "cast(extract(hour from ts) between 8 and 18 and isodow(ts)<6 as integer)",
        "extract(hour from ts) between 8 and 18 and isodow(ts)<6",
    )
    + " from readings",
)
def p3_stored(spark, d):
    return reshape.stored_types(reshape.add_time_features(fixture(spark, d, "readings"))).select(
        "entity", "ts", *CALENDAR
    )
