"""Quality report, selection, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import quality, scaling, split
from wattframe.operators.reshape import add_time_features

from .fixtures import fixture
from .q_cleaning import CAL_SQL, runs_ctes
from .registry import query, r, rs, tidy

G = 12
CRITERIA = dict(min_quality_score=0.85, min_records=60, min_time_span_hours=480, max_gap_ratio=0.2)
CRITERIA_SQL = (
    "quality_score >= 0.85 and total_records >= 60 and time_span_hours >= 480 and continuity_ratio >= 1 - 0.2"
)
RATIOS = [c for c in quality.REPORT_COLUMNS if c not in ("total_records", "gaps_2h", "gaps_24h")]


def report_ctes(src: str, g: int = G, fast: bool = False, name: str = "report") -> tuple[str, ...]:
    limit = max(int(48 / g), 2)
    steps = (
        f"steps as (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by entity order by ts, value nulls first)) us from {src})",
        "stuck as (select entity, sum(greatest(0, run_length - {} + 1)) stuck from run_lengths group by entity)".format(limit),
        "facts as (select entity, count(*) n, count(value) m, count(distinct ts) times, "
        "(epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 span, "
        f"count(case when us > {2 * g} * 3600000000 then 1 end) g2, count(case when us > 24 * 3600000000 then 1 end) g24, "
        "count(case when value = 0 then 1 end) zeros, avg(value) mu, stddev_samp(value) sd, median(value) med, "
        "min(value) lo, max(value) hi from steps group by entity)",
    )
    if fast:
        cols = f"""1e0*m/n completeness_ratio, least(1e0, 1e0*n/(floor(floor(span)/{g})+1)) coverage_ratio,
 1e0*zeros/n zero_ratio, 0.1e0*zeros/n constant_ratio, mu mean_value, sd std_value, med median_value,
 lo min_value, hi max_value, coalesce(sd/nullif(mu,0), 0) coefficient_of_variation"""
    else:
        cols = f"""1e0*m/n completeness_ratio,
 case when n > 1 then least(1e0, 1e0*n/(floor(span/{g})+1)) else 0 end coverage_ratio,
 case when m = 0 then 1 else 1e0*zeros/m end zero_ratio, case when m = 0 then 1 else 1e0*coalesce(stuck,0)/m end constant_ratio,
 case when m = 0 then 0 else mu end mean_value, case when m = 0 then 0 else sd end std_value,
 case when m = 0 then 0 else med end median_value, case when m = 0 then 0 else lo end min_value,
 case when m = 0 then 0 else hi end max_value, case when mu > 0 then sd/mu else 0 end coefficient_of_variation"""
    return (
        *runs_ctes(src),
        *steps,
        f"parts as (select entity, n total_records, span time_span_hours, span/24 time_span_days, g2 gaps_2h, g24 gaps_24h, "
        f"case when n > 1 then 1 - 1e0*g2/(n-1) else 0 end continuity_ratio, 1e0*(n-times)/n duplicate_ratio, {cols} "
        "from facts left join (select entity stuck_entity, stuck from stuck) on entity is not distinct from stuck_entity)",
        f"{name} as (select *, 0.30*completeness_ratio + 0.25*coverage_ratio + 0.25*continuity_ratio + 0.10*(1-zero_ratio) "
        "+ 0.05*(1-constant_ratio) + 0.05*(1-duplicate_ratio) quality_score from parts)",
    )


REPORT_SQL = f"select entity, total_records, gaps_2h, gaps_24h, {rs(*RATIOS)} from report"


def report(spark, d, **kw):
    return quality.quality_report(fixture(spark, d, "runs"), G, block_days=5, **kw)


def clean_report(spark, d):
    return quality.quality_report(fixture(spark, d, "readings"), G, unique=True)


@query("A5_quality_report", REPORT_SQL, *report_ctes("runs"))
def a5(spark, d):
    return report(spark, d)


@query("A5_quality_report_unique", REPORT_SQL, *report_ctes("readings"))
def a5_unique(spark, d):
    return clean_report(spark, d)


@query(
    "A5_quality_report_daily",
    f"select entity, total_records, gaps_2h, gaps_24h, {', '.join(r(c, digits=4) for c in RATIOS)} from report",
    *report_ctes("daily"),
)
def a5_daily(spark, d):
    return tidy(quality.quality_report(fixture(spark, d, "daily"), G), 4)


#: So low that most blocks count as dense.
DENSE = 12


@query("A5_quality_report_null_entity", REPORT_SQL, *report_ctes("unnamed"))
def a5_null(spark, d):
    return quality.quality_report(fixture(spark, d, "unnamed"), G, block_days=5)


@query("A5_quality_report_dense", REPORT_SQL, *report_ctes("unnamed"))
def a5_dense(spark, d):
    return quality.quality_report(fixture(spark, d, "unnamed"), G, block_days=5, limit=DENSE)


@query("A6_quality_report_fast", REPORT_SQL, *report_ctes("runs", fast=True))
def a6(spark, d):
    return report(spark, d, variant="fast")


@query(
    "J4_merged_entity_counts",
    "select entity, total_records, gaps_2h, gaps_24h, "
    + rs("completeness_ratio", "zero_ratio", "duplicate_ratio")
    + " from report",
    *report_ctes("runs", fast=True),
)
def j4(spark, d):
    return report(spark, d, variant="fast").select(
        "entity", "total_records", "gaps_2h", "gaps_24h", "completeness_ratio", "zero_ratio", "duplicate_ratio"
    )


@query(
    "A7_quality_summary",
    f"select {r('avg(quality_score)', 'mean_score')}, {r('median(quality_score)', 'median_score')}, "
    f"{r('stddev_samp(quality_score)', 'std_score')}, {r('min(quality_score)', 'min_score')}, "
    f"{r('max(quality_score)', 'max_score')} from report",
    *report_ctes("runs"),
)
def a7(spark, d):
    return quality.quality_summary(report(spark, d))


@query(
    "A8_quality_tiers",
    "select tier, count(entity) entities, "
    + r("100e0*count(entity)/(select count(*) from report)", "pct")
    + " from (values ('high'), ('medium'), ('low')) t(tier) left join "
    "(select entity, case when quality_score >= 0.8 then 'high' when quality_score >= 0.6 then 'medium' else 'low' end tier "
    "from report) using (tier) group by tier",
    *report_ctes("runs"),
)
def a8(spark, d):
    return quality.quality_tiers(report(spark, d))


@query(
    "A9_selection_summary",
    f"select count(*) selected, {r('avg(quality_score)', 'mean_score')}, {r('min(quality_score)', 'min_score')}, "
    f"{r('avg(completeness_ratio)', 'mean_completeness')}, {r('avg(continuity_ratio)', 'mean_continuity')}, "
    f"{r('median(quality_score)', 'median_score')}, (select count(*) from report) entities, "
    f"{r('100e0*count(*)/(select count(*) from report)', 'selection_rate_pct')} from report where {CRITERIA_SQL}",
    *report_ctes("readings"),
)
def a9(spark, d):
    return quality.selection_summary(clean_report(spark, d), **CRITERIA)


@query(
    "O2_top_quality",
    "select entity, total_records, "
    + rs("quality_score", "completeness_ratio", "continuity_ratio", "time_span_days")
    + " from report order by report.quality_score desc, entity limit 10",
    *report_ctes("runs"),
)
def o2(spark, d):
    return quality.top_quality(report(spark, d), 10)


@query("L1_select_high_quality", REPORT_SQL + f" where {CRITERIA_SQL}".replace("quality_score >=", "report.quality_score >=")
       .replace("time_span_hours >=", "report.time_span_hours >=").replace("continuity_ratio >=", "report.continuity_ratio >="),
       *report_ctes("readings"))
def l1(spark, d):
    return quality.select_high_quality(clean_report(spark, d), **CRITERIA)


def split_ctes(src: str, a: float, b: float, cumulative: bool = False, seed: int = 42) -> tuple[str, ...]:
    first = f"floor(n*{a!r}e0)"
    second = f"floor(n*{a + b!r}e0)" if cumulative else f"{first} + floor(n*{b!r}e0)"
    return (
        f"ids as (select distinct entity from {src})",
        f"ordered as (select entity, row_number() over (order by md5('{seed}:' || entity), entity) - 1 k, "
        "count(*) over () n from ids)",
        f"split as (select entity, case when k < {first} then 'train' when k < {second} then 'validation' "
        "else 'test' end split from ordered)",
    )


def ids(spark, d):
    return fixture(spark, d, "readings").select("entity")


@query("L2_split_entities", "select entity, split from split", *split_ctes("readings", 0.6, 0.2))
def l2(spark, d):
    return split.split_entities(ids(spark, d))


@query(
    "L2_split_top_n",
    "select entity, split from split",
    *report_ctes("readings"),
    "best as (select entity from report order by quality_score desc, entity limit 40)",
    *split_ctes("best", 0.6, 0.2),
)
def l2_top(spark, d):
    return split.split_entities(clean_report(spark, d), top_n=40)


@query("L3_split_entities_cumulative", "select entity, split from split", *split_ctes("readings", 0.7, 0.15, True))
def l3(spark, d):
    return split.split_entities(ids(spark, d), 0.7, 0.15, 0.15, cut="cumulative")


@query(
    "L4_split_report",
    f"select split, count(*) entities, {r('100e0*count(*)/(select count(*) from split)', 'pct')} from split group by split",
    *split_ctes("readings", 0.6, 0.2),
)
def l4(spark, d):
    return split.split_report(split.split_entities(ids(spark, d)))


@query(
    "L5_training_entities",
    "select entity from split where split in ('train', 'validation')",
    *split_ctes("readings", 0.6, 0.2),
)
def l5(spark, d):
    return split.training_entities(split.split_entities(ids(spark, d)))


LIMITED = (
    "placed as (select *, row_number() over (partition by split order by md5('42:' || entity), entity) rn from split)",
)


@query(
    "O6_limit_entities",
    "select entity, split from placed where (split <> 'train' or rn <= 30) and (split <> 'validation' or rn <= 7)",
    *split_ctes("readings", 0.6, 0.2),
    *LIMITED,
)
def o6(spark, d):
    return split.limit_entities(split.split_entities(ids(spark, d)), split.limits(30))


@query("O6_limit_entities_none", "select entity, split from placed", *split_ctes("readings", 0.6, 0.2), *LIMITED)
def o6_none(spark, d):
    return split.limit_entities(split.split_entities(ids(spark, d)))


FEATURES_CTE = (
    f"features as (select entity, ts, seq, value, {CAL_SQL}, row_number() over (partition by entity order by ts, seq) - 1 idx, "
    "count(*) over (partition by entity) n from readings)"
)
FEATURE_NAMES = scaling.FEATURES
L, H, STRIDE = 12, 4, 3


def features(spark, d):
    return add_time_features(fixture(spark, d, "readings"))


def _fit_sql(src: str) -> str:
    return " union all ".join(
        f"select '{f}' feature, {r(f'avg(\"{f}\")', 'mean')}, {r(f'var_pop(\"{f}\")', 'var', 5)}, "
        f"{r(f'case when var_pop(\"{f}\") > 0 then sqrt(var_pop(\"{f}\")) else 1 end', 'scale')} from {src}"
        for f in FEATURE_NAMES
    )


@query(
    "N1_fit_scaler_sampled",
    _fit_sql("windows"),
    FEATURES_CTE,
    *split_ctes("readings", 0.6, 0.2),
    *LIMITED,
    f"starts as (select f.entity, f.idx i from features f join placed p on p.entity = f.entity and p.split = 'train' "
    f"where f.idx % {STRIDE * 10} = 0 and f.idx <= f.n - {L + H})",
    f"windows as (select f.* from features f join starts s on s.entity = f.entity and f.idx between s.i and s.i + {L - 1})",
)
def n1(spark, d):
    parts = split.split_entities(ids(spark, d))
    train = parts.filter("split = 'train'")
    out = scaling.fit_scaler_sampled(features(spark, d), train, L, H, STRIDE, tiebreak=["seq"])
    return out.withColumn("var", F.round("var", 5))


@query("N2_fit_scaler", _fit_sql("features"), FEATURES_CTE)
def n2(spark, d):
    return scaling.fit_scaler(features(spark, d)).withColumn("var", F.round("var", 5))


@query(
    "N3_scale_columns",
    "select entity, ts, seq, meter, "
    + ", ".join(r(f'("{f}" - avg("{f}") over ()) / case when var_pop("{f}") over () > 0 then sqrt(var_pop("{f}") over ()) else 1 end', f'"{f}"') for f in FEATURE_NAMES)
    + " from (select *, 'electricity' meter from features)",
    FEATURES_CTE,
)
def n3(spark, d):
    df = features(spark, d)
    return scaling.scale_columns(df, scaling.fit_scaler(df))
