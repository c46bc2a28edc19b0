"""Lags, sliding windows and the training tables made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import scaling, series, split
from wattframe.operators.clean import filter_entities
from wattframe.operators.resample import resample_mean
from wattframe.operators.reshape import add_time_features
from wattframe.plans.forecast import training_tables

from .fixtures import fixture
from .q_quality import FEATURE_NAMES, FEATURES_CTE, H, L, STRIDE, features, split_ctes
from .registry import query, r

K = 8


@query(
    "W4_lag_baseline",
    f"select entity, ts, event_id, {r('y_true')}, "
    + r(f"lag(y_true, {K}) over (partition by entity order by ts, event_id)", "y_base")
    + " from predictions",
)
def w4(spark, d):
    p = fixture(spark, d, "predictions").select("entity", "ts", "event_id", "y_true")
    return series.lag_baseline(p, K, tiebreak=["event_id"], block_days=5)


STARTS_CTE = (
    f"starts as (select entity, idx start_idx, ts start_ts from features where idx % {STRIDE} = 0 and idx <= n - {L + H})"
)
NAMED = ", ".join(f'"{f}"' for f in FEATURE_NAMES)


def flat(seqs, extra=()):
    """One row per step of ``x`` and of ``y``, so results compare as plain rows."""
    keys = ["entity", "start_idx", *extra]
    x = seqs.select(*keys, F.posexplode("x").alias("pos", "row")).select(
        *keys, F.lit("x").alias("part"), "pos",
        *[F.col("row")[i].cast("double").alias(f) for i, f in enumerate(FEATURE_NAMES)],
    )
    y = seqs.select(*keys, F.posexplode("y").alias("pos", "v")).select(
        *keys, F.lit("y").alias("part"), "pos",
        *[F.lit(None).cast("double").alias(f) for f in FEATURE_NAMES[:-1]],
        F.col("v").cast("double").alias("value"),
    )
    return x.unionByName(y)


def flat_sql(cells: str, keys: str = "s.entity, s.start_idx", starts: str = "starts s", digits: int = 6, pre: str = "f", y: str = "cast(f.value as float)") -> str:
    x_cols = ", ".join(r(f'cast({pre}."{f}" as float)', f'"{f}"', digits) for f in FEATURE_NAMES)
    y_cols = ", ".join(f'cast(null as double) as "{f}"' for f in FEATURE_NAMES[:-1])
    return (
        f"select {keys}, 'x' part, cast(f.idx - s.start_idx as integer) pos, {x_cols} from {starts} join {cells} f "
        f"on f.entity = s.entity and f.idx between s.start_idx and s.start_idx + {L - 1} union all "
        f"select {keys}, 'y' part, cast(f.idx - s.start_idx - {L} as integer) pos, {y_cols}, {r(y, 'value')} from {starts} "
        f"join {cells} f on f.entity = s.entity and f.idx between s.start_idx + {L} and s.start_idx + {L + H - 1}"
    )


@query("W5_sliding_sequences", flat_sql("features"), FEATURES_CTE, STARTS_CTE)
def w5(spark, d):
    return flat(series.sliding_sequences(features(spark, d), L, H, STRIDE, tiebreak=["seq"]))


@query(
    "W5_sequence_index",
    "select s.entity, s.start_idx, s.start_ts, e.ts end_ts from starts s join features e "
    f"on e.entity = s.entity and e.idx = s.start_idx + {L + H - 1}",
    FEATURES_CTE,
    STARTS_CTE,
)
def w5_index(spark, d):
    seqs = series.sliding_sequences(features(spark, d), L, H, STRIDE, tiebreak=["seq"], block_days=3)
    return seqs.select("entity", "start_idx", "start_ts", "end_ts")


@query(
    "W5_contiguous_hourly",
    "select s.entity, s.idx start_idx, s.ts start_ts, e.ts end_ts from hours s join hours e on e.entity = s.entity "
    f"and e.idx = s.idx + {L + H - 1} where s.idx % {STRIDE} = 0 and e.ts - s.ts = interval '{L + H - 1} hours'",
    "hours as (select *, row_number() over (partition by entity order by ts) - 1 idx from "
    "(select distinct entity, date_trunc('hour', ts) ts from by_type))",
)
def w5_contiguous(spark, d):
    hours = add_time_features(resample_mean(fixture(spark, d, "by_type"), "1H"))
    seqs = series.sliding_sequences(hours, L, H, STRIDE, contiguous_step="1H")
    return seqs.select("entity", "start_idx", "start_ts", "end_ts")


DIRTY_FEATURES = FEATURES_CTE.replace("from readings", "from dirty")


def dirty_sequences(spark, d):
    return series.sliding_sequences(
        add_time_features(fixture(spark, d, "dirty")), L, H, STRIDE, tiebreak=["seq"]
    )


HOLES = (
    f"holes as (select s.entity, s.start_idx, count(f.value) have from starts s join features f on f.entity = s.entity "
    f"and f.idx between s.start_idx and s.start_idx + {L + H - 1} group by 1, 2)"
)


@query(
    "W6_drop_nonfinite_sequences",
    f"select entity, start_idx from holes where have = {L + H}",
    DIRTY_FEATURES,
    STARTS_CTE,
    HOLES,
)
def w6(spark, d):
    return series.drop_nonfinite_sequences(dirty_sequences(spark, d)).select("entity", "start_idx")


@query(
    "W6_nonfinite_report",
    f"select count(case when have = {L + H} then 1 end) kept, count(case when have < {L + H} then 1 end) skipped from holes",
    DIRTY_FEATURES,
    STARTS_CTE,
    HOLES,
)
def w6_report(spark, d):
    return series.nonfinite_sequence_report(dirty_sequences(spark, d))


SCALED_CTE = (
    "scaled as (select entity, idx, value raw, "
    + ", ".join(
        f'(cast("{f}" as float) - avg("{f}") over ()) / case when var_pop("{f}") over () > 0 '
        f'then sqrt(var_pop("{f}") over ()) else 1 end "{f}"'
        for f in FEATURE_NAMES
    )
    + " from features)"
)


# The same by means and variances of the train entities only.
SCALED_ON_TRAIN = (
    "fitted as (select "
    + ", ".join(f'avg("{f}") "{f}_mean", var_pop("{f}") "{f}_var"' for f in FEATURE_NAMES)
    + " from features f join split s on s.entity = f.entity where s.split = 'train')",
    "scaled as (select entity, idx, value raw, "
    + ", ".join(f'(cast("{f}" as float) - "{f}_mean") / case when "{f}_var" > 0 then sqrt("{f}_var") else 1 end "{f}"' for f in FEATURE_NAMES)
    + " from features, fitted)",
)


def rounded(df, digits=4):
    return df.withColumns({f: F.round(f, digits) for f in FEATURE_NAMES})


@query(
    "N3_apply_scaler",
    "select * replace (round(value, 4) + 0.0 as value) from ("
    + flat_sql("scaled", digits=4, y="cast(f.raw as float)") + ")",
    FEATURES_CTE,
    STARTS_CTE,
    SCALED_CTE,
)
def n3_sequences(spark, d):
    df = features(spark, d)
    seqs = series.sliding_sequences(df, L, H, STRIDE, tiebreak=["seq"])
    return rounded(flat(scaling.apply_scaler(seqs, scaling.fit_scaler(df))))


@query(
    "K5_training_tables",
    "select * replace (round(value, 4) + 0.0 as value) from ("
    + flat_sql("scaled", "s.entity, s.start_idx, p.split", "starts s join split p on p.entity = s.entity", 4, y="cast(f.raw as float)")
    + ")",
    FEATURES_CTE,
    STARTS_CTE,
    *split_ctes("readings", 0.6, 0.2),
    *SCALED_ON_TRAIN,
)
def k5(spark, d):
    df = features(spark, d)
    parts = split.split_entities(df)
    train = filter_entities(df, parts.filter("split = 'train'"))
    seqs = training_tables(df, parts, scaling.fit_scaler(train), L, H, STRIDE, tiebreak=["seq"])
    return rounded(flat(seqs, ["split"]))
