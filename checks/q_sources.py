"""Sources and sinks: each query writes below the shared folder and reads back."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import functions as F

from wattframe.operators import scaling, split
from wattframe.operators.reshape import wide_to_long
from wattframe.plans.preprocess import preprocess
from wattframe.session import shared_path
from wattframe.sources import readings as src, reports

from .fixtures import fixture
from .q_cleaning import CAL_SQL, TYPES, WIDE_CTE, metrics_with_load, METRICS_CTE, wide
from .q_metrics import EVAL_CTES, G3_ANOMALY, G3_FIELDS, _summary_cols, EVAL_COLS, evaluated
from .q_quality import _fit_sql, FEATURES_CTE, REPORT_SQL, features, report, report_ctes, split_ctes
from .registry import query, r, rs

LONG_SQL = " union all ".join(
    f"select ts, '{t}' entity, 'electricity' meter, cast({t} as float) as value from wide" for t in TYPES
)


def in_nanoseconds(spark, d) -> str:
    """The events in Parquet files with nanosecond times, one file per task."""
    path = shared_path(spark, "nanoseconds")
    rows = fixture(spark, d, "dirty").select(F.col("ts").alias("timestamp_local"), F.col("entity").alias("building_id"), "meter", F.col("value").cast("float").alias("value"))
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root, recursive=True)

    def write(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if tables:
            own = pa.concat_tables(tables)
            own = own.set_column(0, "timestamp_local", own.column("timestamp_local").cast(pa.timestamp("ns")))
            target, folder = fs.FileSystem.from_uri(path)
            pq.write_table(own, f"{folder}/part-{uuid.uuid4().hex}.parquet", filesystem=target)
            yield pa.RecordBatch.from_pydict({"rows": [own.num_rows]})

    rows.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return path


@query(
    "S5_read_readings_nanoseconds",
    f"select entity, ts, meter, {r('cast(value as float)', 'value')} from dirty where meter = 'electricity'",
)
def s5_nanoseconds(spark, d):
    return src.read_readings(spark, in_nanoseconds(spark, d))


def wide_csv(spark, d) -> str:
    path = shared_path(spark, "wide-csv")
    stamped = wide(spark, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    stamped.write.option("header", True).csv(path)
    return path


@query(
    "S1_read_wide_csv",
    "select strftime(ts, '%Y-%m-%d %H:%M:%S') \"timestamp\", " + rs(*TYPES) + " from wide",
    WIDE_CTE,
)
def s1(spark, d):
    return src.read_wide_csv(spark, wide_csv(spark, d))


@query("S2_ingest_wide", f"select ts, entity, meter, {r('value')} from long", WIDE_CTE, f"long as ({LONG_SQL})")
def s2(spark, d):
    out = shared_path(spark, "ingested")
    src.ingest_wide(spark, wide_csv(spark, d), out)
    return spark.read.parquet(out)


@query(
    "S4_verify_readings",
    "select 'ts timestamp_ntz, entity string, meter string, value float' column_types, true types_ok, count(*) total_rows, "
    "count(distinct entity) entities, min(ts) first_ts, max(ts) last_ts from long",
    WIDE_CTE,
    f"long as ({LONG_SQL})",
)
def s4(spark, d):
    out = shared_path(spark, "verified")
    src.write_readings(wide_to_long(wide(spark, d), "timestamp"), out)
    return src.verify_readings(spark, out)


@query("S3_write_readings", f"select ts, entity, meter, {r('cast(value as float)', 'value')} from dirty")
def s3(spark, d):
    out = shared_path(spark, "readings")
    src.write_readings(fixture(spark, d, "dirty"), out)
    return spark.read.parquet(out)


@query("S3_write_readings_balanced", f"select ts, entity, meter, {r('cast(value as float)', 'value')} from dirty")
def s3_balanced(spark, d):
    out = shared_path(spark, "readings")
    src.write_readings(fixture(spark, d, "dirty"), out, layout="balanced")
    return spark.read.parquet(out)


@query(
    "S5_read_readings",
    f"select ts, entity, meter, {r('cast(value as float)', 'value')} from dirty where meter = 'electricity'",
)
def s5(spark, d):
    out = shared_path(spark, "raw")
    fixture(spark, d, "dirty").select(
        F.col("ts").alias("timestamp_utc"), F.col("entity").cast("bigint").alias("building_id"), "meter", "value"
    ).write.parquet(out)
    return src.read_readings(spark, out)


@query(
    "S6_write_clean",
    f"select ts, entity, meter, {r('cast(value as float)', 'value')}, "
    + CAL_SQL.replace("cast(isodow(ts)>=6 as integer)", "isodow(ts)>=6").replace(
        "cast(extract(hour from ts) between 8 and 18 and isodow(ts)<6 as integer)",
        "extract(hour from ts) between 8 and 18 and isodow(ts)<6",
    )
    + " from dirty qualify row_number() over (partition by entity, ts order by seq) = 1",
)
def s6(spark, d):
    out = shared_path(spark, "clean")
    src.write_clean(preprocess(fixture(spark, d, "dirty")), out)
    return spark.read.parquet(out)


@query("S7_read_columns", f"select user_id, {r('value')} from events")
def s7(spark, d):
    return src.read_columns(spark, f"{d}/events.parquet", ["user_id", "value"])


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(
    "S8_column_names",
    " union all ".join(f"select '{c}' column_name, count({c}) present from events" for c in EVENT_COLUMNS),
)
def s8(spark, d):
    path = f"{d}/events.parquet"
    names = src.column_names(spark, path)
    counts = spark.read.parquet(path).agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "present")


@query("S9_csv_report", REPORT_SQL, *report_ctes("runs"))
def s9(spark, d):
    out = shared_path(spark, "report-csv")
    df = report(spark, d)
    reports.write_csv(df, out)
    return reports.read_csv(spark, out, df.schema)


@query(
    "C12_default_flow",
    f"select entity, ts, {r('cast(value as float)', 'value', 4)}, meter, {CAL_SQL} from dirty where meter = 'electricity' "
    "qualify row_number() over (partition by entity, ts order by cast(value as float) nulls first) = 1",
)
def default_flow(spark, d):
    """Write, read and preprocess, nothing but defaults."""
    path = shared_path(spark, "default-flow")
    src.write_readings(fixture(spark, d, "dirty"), path)
    clean = preprocess(src.read_readings(spark, path))
    return clean.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("S10_split_json", "select entity, split from split", *split_ctes("readings", 0.6, 0.2))
def s10(spark, d):
    out = shared_path(spark, "split-json")
    reports.write_split(split.split_entities(fixture(spark, d, "readings")), out, document=True)
    return reports.read_split(spark, out)


@query("S10_split_json_lines", "select entity, split from split", *split_ctes("readings", 0.6, 0.2))
def s10_lines(spark, d):
    out = shared_path(spark, "split-lines")
    reports.write_split(split.split_entities(fixture(spark, d, "readings")), out)
    return reports.read_split(spark, out)


@query(
    "S11_summary_json",
    f"select 'test_set' evaluation_type, count(*) n_buildings, cast(sum(n_sequences) as bigint) total_sequences, "
    f"{_summary_cols(EVAL_COLS[:4])}, {r('median(rmse)', 'rmse_median')}, "
    + _summary_cols(EVAL_COLS[4:]).replace("f1_score_", "f1_")
    + " from evaluated",
    *EVAL_CTES,
)
def s11(spark, d):
    from wattframe.operators.evaluation import summary_struct

    out = shared_path(spark, "summary-json")
    df = summary_struct(evaluated(spark, d))
    reports.write_json(df, out)
    return reports.read_json(spark, out, df.schema).select(
        "evaluation_type", "n_buildings", "total_sequences",
        *[f"forecast_metrics.{c}" for c in G3_FIELDS], *[f"anomaly_metrics.{c}" for c in G3_ANOMALY],
    )


@query(
    "S12_read_metrics",
    f"select m.entity, {rs('m.rmse', 'm.mae', 'm.mape').replace('as m.', 'as ')}, {r('avg(m.rmse) over ()', 'overall_rmse')} from metrics m",
    METRICS_CTE,
)
def s12(spark, d):
    per, overall = shared_path(spark, "metrics-csv"), shared_path(spark, "overall-json")
    m = metrics_with_load(spark, d).drop("mean_load")
    reports.write_csv(m, per)
    reports.write_json(m.agg(F.avg("rmse").alias("rmse")), overall)
    total = reports.read_json(spark, overall, "rmse double").scalar()
    return reports.read_csv(spark, per, m.schema).withColumn("overall_rmse", total)


@query("S13_scaler_table", _fit_sql("features"), FEATURES_CTE)
def s13(spark, d):
    out = shared_path(spark, "scaler")
    reports.write_scaler(scaling.fit_scaler(features(spark, d)), out)
    return reports.read_scaler(spark, out).withColumn("var", F.round("var", 5))
