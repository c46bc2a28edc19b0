"""Forecast and classification metrics, evaluation per entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import classification, evaluation, forecast_metrics as fm, ranking

from .fixtures import fixture
from .q_cleaning import METRICS_CTE, metrics_with_load
from .registry import query, r, rs

# Truth or prediction is NULL or infinite in some rows, a few entities keep none.
HOLEY_CTE = (
    "holey as (select entity, case when cast(entity as bigint) % 40 = 0 or event_id%13=0 then cast('Infinity' as double) "
    "when event_id%11=0 then 0e0 else y_true end y_true, case when event_id%17=0 then null else y_pred end y_pred from predictions)"
)
PAIRS_CTE = (
    "pairs as (select entity, case when ok then y_true end y, case when ok then y_pred end p from (select *, coalesce("
    "y_true is not null and y_pred is not null and not isinf(y_true) and not isinf(y_pred), false) ok from holey))"
)
SQL = {
    "rmse": "sqrt(avg((y-p)*(y-p)))",
    "mae": "avg(abs(y-p))",
    "mape": "100*avg(case when abs(y)>1e-10 then abs((y-p)/y) end)",
    "smape": "100*avg(abs(p-y)/((abs(y)+abs(p))/2 + 1e-10))",
    "r2": "case when count(y) >= 2 then case when var_pop(y) > 0 then 1 - sum((y-p)*(y-p))/(var_pop(y)*count(y)) "
    "when sum((y-p)*(y-p)) = 0 then 1 else 0 end end",
    "nrmse": "case when max(y) > min(y) then sqrt(avg((y-p)*(y-p)))/(max(y)-min(y)) when max(y) = min(y) then 0 end",
}


def metric_sql(*names: str) -> str:
    return ", ".join(r(f"case when count(y) = 0 then 0 else {SQL[n]} end", n) for n in names)


def holey(spark, d):
    p = fixture(spark, d, "predictions")
    bad = (F.col("entity").cast("bigint") % 40 == 0) | (F.col("event_id") % 13 == 0)
    y = F.when(bad, float("inf")).when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("y_true"))
    return p.select("entity", y.alias("y_true"), F.when(F.col("event_id") % 17 != 0, F.col("y_pred")).alias("y_pred"))


def _one(key: str, name: str) -> None:
    @query(key, f"select entity, {metric_sql(name)} from pairs group by entity", HOLEY_CTE, PAIRS_CTE)
    def run(spark, d):
        return fm.forecast_metrics(holey(spark, d), ["entity"], metrics=[name])


for _key, _name in (
    ("E1_rmse", "rmse"), ("E2_mae", "mae"), ("E3_mape", "mape"), ("E4_smape", "smape"), ("E5_r2", "r2"), ("E6_nrmse", "nrmse"),
):
    _one(_key, _name)


@query("E7_forecast_metrics", f"select {metric_sql(*SQL)} from pairs", HOLEY_CTE, PAIRS_CTE)
def e7(spark, d):
    return fm.forecast_metrics(holey(spark, d))


@query("E7_forecast_metrics_by_entity", f"select entity, {metric_sql(*SQL)} from pairs group by entity", HOLEY_CTE, PAIRS_CTE)
def e7_entity(spark, d):
    return fm.forecast_metrics(holey(spark, d), ["entity"])


LOSS = {
    "mse": "avg((y-p)*(y-p))",
    "mae": "avg(abs(y-p))",
    "huber": "avg(case when abs(y-p) <= 5 then 0.5*(y-p)*(y-p) else 5*(abs(y-p) - 2.5) end)",
}


@query(
    "E14_forecast_loss",
    " union all ".join(f"select '{k}' kind, {r(e, 'loss')} from pairs" for k, e in {**LOSS, "other": LOSS["mse"]}.items()),
    HOLEY_CTE,
    PAIRS_CTE,
)
def e14(spark, d):
    df = holey(spark, d)
    parts = [fm.forecast_loss(df, k, 5.0).withColumn("kind", F.lit(k)) for k in (*LOSS, "other")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RATES = (
    "1e0*(tp+tn)/nullif(tp+fp+tn+fn,0) accuracy, coalesce(1e0*tp/nullif(tp+fp,0),0) \"precision\", "
    "coalesce(1e0*tp/nullif(tp+fn,0),0) recall, coalesce(2e0*tp/nullif(2*tp+fp+fn,0),0) f1_score, "
    "coalesce(1e0*tn/nullif(tn+fp,0),0) specificity"
)
RATE_COLS = ", ".join(r(c if c != "precision" else '"precision"') for c in classification.RATES)
COUNT_COLS = "tp true_positives, fp false_positives, tn true_negatives, fn false_negatives"


def confusion(src: str, label: str = "y_label", score: str = "y_score", t: str = "0.5e0", by: str = "") -> tuple[str, ...]:
    k = f"{by}, " if by else ""
    g = f" group by {by}" if by else ""
    return (
        f"conf as (select {k}count(case when {label}=1 and {score}>={t} then 1 end) tp, "
        f"count(case when {label}<>1 and {score}>={t} then 1 end) fp, count(case when {label}<>1 and {score}<{t} then 1 end) tn, "
        f"count(case when {label}=1 and {score}<{t} then 1 end) fn from {src}{g})",
        f"rated as (select *, {RATES} from conf)",
    )


def auc_cte(src: str, label: str = "y_label", score: str = "y_score", by: str = "") -> tuple[str, ...]:
    part = f"partition by {by} " if by else ""
    k = f"{by}, " if by else ""
    g = f" group by {by}" if by else ""
    return (
        f"places as (select *, rank() over ({part}order by {score}) rk, count(*) over (partition by {k}{score}) same from {src})",
        f"auc as (select {k}case when pos > 0 and neg > 0 then (s - pos*(pos+1)/2e0)/(1e0*pos*neg) else 0 end roc_auc from "
        f"(select {k}count(case when {label}=1 then 1 end) pos, count(case when {label}<>1 then 1 end) neg, "
        f"sum(case when {label}=1 then rk + (same-1)/2e0 end) s from places{g}))",
    )


@query("E9_binary_metrics", f"select {RATE_COLS}, {COUNT_COLS} from rated", *confusion("predictions"))
def e9(spark, d):
    return classification.binary_metrics(fixture(spark, d, "predictions"))


@query(
    "E9_binary_metrics_by_entity",
    f"select entity, {RATE_COLS}, {COUNT_COLS} from rated",
    *confusion("predictions", t="0.4e0", by="entity"),
)
def e9_entity(spark, d):
    return classification.binary_metrics(fixture(spark, d, "predictions"), 0.4, ["entity"])


@query("E10_roc_auc", f"select {r('roc_auc')} from auc", *auc_cte("predictions"))
def e10(spark, d):
    return classification.roc_auc(fixture(spark, d, "predictions"))


@query("E10_roc_auc_by_entity", f"select entity, {r('roc_auc')} from auc", *auc_cte("predictions", by="entity"))
def e10_entity(spark, d):
    return classification.roc_auc(fixture(spark, d, "predictions"), ["entity"])


@query("E10_roc_auc_labels", f"select {r('roc_auc')} from auc", *auc_cte("labelled", "toxic", "score"))
def e10_labels(spark, d):
    return classification.roc_auc(fixture(spark, d, "labelled"), (), "toxic", "score")


def curve(src: str, label: str = "y_label", score: str = "y_score", by: str = "") -> tuple[str, ...]:
    k = f"{by}, " if by else ""
    return (
        "grid as (select unnest(range(100)) i)",
        f"conf as (select {k}i, i*(1e0/99) threshold, count(case when {label}=1 and {score}>=i*(1e0/99) then 1 end) tp, "
        f"count(case when {label}<>1 and {score}>=i*(1e0/99) then 1 end) fp, count(case when {label}<>1 and {score}<i*(1e0/99) then 1 end) tn, "
        f"count(case when {label}=1 and {score}<i*(1e0/99) then 1 end) fn from {src}, grid group by {k}i)",
        f"rated as (select *, {RATES} from conf)",
    )


def best_sql(metric: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    m = f'"{metric}"'
    return (
        f"select {k}{r(f'case when {m} > 0 then threshold else 0.5 end', 'optimal_threshold')}, {r(m, 'best_value')} "
        f"from rated qualify row_number() over ({part}order by {m} desc, i) = 1"
    )


def _best(key: str, metric: str, column: str) -> None:
    @query(key, best_sql(column), *curve("predictions"))
    def run(spark, d):
        return classification.optimal_threshold(fixture(spark, d, "predictions"), metric)


for _m, _c in (("f1", "f1_score"), ("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall")):
    _best(f"E11_optimal_threshold_{_m}", _m, _c)


@query("E11_optimal_threshold_by_entity", best_sql("f1_score", "entity"), *curve("predictions", by="entity"))
def e11_entity(spark, d):
    return classification.optimal_threshold(fixture(spark, d, "predictions"), "f1", ["entity"])


BAD_SCORES = (
    "scored as (select entity, case when event_id%19=0 then null when cast(entity as bigint)%30=0 then 1 else y_label end y_label, "
    "case when event_id%23=0 then cast('Infinity' as double) else y_score end y_score from predictions)",
    "finite as (select * from scored where y_label is not null and not isinf(y_score))",
    "classes as (select entity, count(case when ok and y_label=1 then 1 end) > 0 and count(case when ok and y_label<>1 then 1 end) > 0 two "
    "from (select *, coalesce(y_label is not null and not isinf(y_score), false) ok from scored) group by entity)",
)


def scored(spark, d):
    p = fixture(spark, d, "predictions")
    one = F.when(F.col("entity").cast("bigint") % 30 == 0, 1).otherwise(F.col("y_label"))
    return p.select(
        "entity",
        F.when(F.col("event_id") % 19 != 0, one).alias("y_label"),
        F.when(F.col("event_id") % 23 == 0, float("inf")).otherwise(F.col("y_score")).alias("y_score"),
    )


@query(
    "E12_anomaly_metrics",
    f"select {RATE_COLS}, {r('roc_auc')}, {COUNT_COLS}, 0.5e0 threshold, t.* from rated, auc, "
    f"(select {r('threshold', 'optimal_threshold')}, {r('f1_score', 'optimal_f1')} from rated_curve order by rated_curve.f1_score desc, i limit 1) t",
    *BAD_SCORES,
    *confusion("finite"),
    *auc_cte("finite"),
    *[c.replace("conf", "conf_curve").replace("rated", "rated_curve") for c in curve("finite")],
)
def e12(spark, d):
    return classification.anomaly_metrics(scored(spark, d), find_optimal=True)


def _gated(c: str) -> str:
    return r(f"case when two then {c} else 0 end", c)


@query(
    "E12_anomaly_metrics_by_entity",
    "select classes.entity, "
    + ", ".join(_gated(c if c != "precision" else '"precision"') for c in (*classification.RATES, "roc_auc"))
    + ", case when two then tp end true_positives, case when two then fp end false_positives, "
    "case when two then tn end true_negatives, case when two then fn end false_negatives, 0.5e0 threshold "
    "from classes left join rated using (entity) left join auc using (entity)",
    *BAD_SCORES,
    *confusion("finite", by="entity"),
    *auc_cte("finite", by="entity"),
)
def e12_entity(spark, d):
    return classification.anomaly_metrics(scored(spark, d), by=["entity"])


# Per-entity evaluation; an event's day stands for its sequence.
EVAL_CTES = (
    "pairs as (select entity, ts, y_true y, y_pred p from predictions)",
    f"err as (select entity, count(distinct date_trunc('day', ts)) n_sequences, {', '.join(f'{SQL[n]} {n}' for n in ('rmse','mae','mape','r2'))} from pairs group by entity)",
    *confusion("predictions", by="entity"),
    *auc_cte("predictions", by="entity"),
    'evaluated as (select err.*, f1_score, "precision", recall, roc_auc from err join rated using (entity) join auc using (entity))',
)
EVAL_COLS = ("rmse", "mae", "mape", "r2", "f1_score", '"precision"', "recall", "roc_auc")


def evaluated(spark, d):
    p = fixture(spark, d, "predictions").withColumn("day", F.col("ts").cast("date"))
    return evaluation.evaluate_by_entity(p, sequence="day")


@query("E8_evaluate_by_entity", f"select entity, n_sequences, {rs(*EVAL_COLS)} from evaluated", *EVAL_CTES)
def e8(spark, d):
    return evaluated(spark, d)


@query(
    "E8_evaluation_coverage",
    "select count(e.entity) evaluated, count(*) - count(e.entity) skipped from (select distinct entity from readings) i "
    "left join (select entity from predictions group by entity having count(*) >= 65) e on e.entity = i.entity",
)
def e8_coverage(spark, d):
    p = fixture(spark, d, "predictions").withColumn("n", F.lit(1))
    enough = p.groupBy("entity").agg(F.count("n").alias("n")).filter("n >= 65")
    return evaluation.evaluation_coverage(fixture(spark, d, "readings"), enough)


SCORE = "100*(0.6*greatest(0, least(1, r2)) + 0.4*f1_score)"


@query("E13_combined_score", f"select entity, {r(SCORE, 'combined_score')} from evaluated", *EVAL_CTES)
def e13(spark, d):
    return evaluated(spark, d).select("entity", evaluation.combined_score().alias("combined_score"))


@query(
    "E13_evaluate",
    f"select {', '.join(r(SQL[n], n) for n in SQL)}, (select roc_auc from (select {r('roc_auc')} from auc)) roc_auc, "
    + ", ".join(f"(select {c} from (select {r(c)} from rated)) {c}" for c in ("accuracy", '"precision"', "recall", "f1_score", "specificity"))
    + ", "
    + ", ".join(f"(select {c.split()[0]} from conf) {c.split()[1]}" for c in COUNT_COLS.split(", "))
    + f", 0.5e0 threshold, {r('(select max_by(threshold, (f1_score, -i)) from rated_curve)', 'optimal_threshold')}, "
    f"{r('(select max(f1_score) from rated_curve)', 'optimal_f1')}, "
    + r(f"100*(0.6*greatest(0, least(1, {SQL['r2']})) + 0.4*(select f1_score from rated))", "combined_score")
    + " from pairs",
    "pairs as (select y_true y, y_pred p from predictions)",
    *confusion("predictions"),
    *auc_cte("predictions"),
    *[c.replace("conf", "conf_curve").replace("rated", "rated_curve") for c in curve("predictions")],
)
def e13_evaluate(spark, d):
    return evaluation.evaluate(fixture(spark, d, "predictions"))


def _summary_cols(names) -> str:
    return ", ".join(
        f"{r(f'avg({c})', c.strip(chr(34)) + '_mean')}, {r(f'stddev_samp({c})', c.strip(chr(34)) + '_std')}" for c in names
    )


OPEN_SCORE = "100*(0.6*greatest(0, r2) + 0.4*f1_score)"


@query(
    "G1_evaluation_summary",
    f"select count(*) entities, cast(sum(n_sequences) as bigint) total_sequences, {r('avg(n_sequences)', 'mean_sequences')}, "
    f"{_summary_cols(EVAL_COLS)}, {r(f'avg({OPEN_SCORE})', 'combined_mean')}, {r(f'stddev_pop({OPEN_SCORE})', 'combined_std')} from evaluated",
    *EVAL_CTES,
)
def g1(spark, d):
    return evaluation.evaluation_summary(evaluated(spark, d))


@query(
    "G2_rmse_percentiles",
    ", ".join(["select " + r("quantile_cont(rmse, 0.25)", "p25"), r("quantile_cont(rmse, 0.5)", "p50"), r("quantile_cont(rmse, 0.75)", "p75")])
    + " from evaluated",
    *EVAL_CTES,
)
def g2(spark, d):
    return evaluation.rmse_percentiles(evaluated(spark, d))


G3_FIELDS = [f"{m}_{t}" for m in ("rmse", "mae", "mape", "r2") for t in ("mean", "std")] + ["rmse_median"]
G3_ANOMALY = [f"{m}_{t}" for m in ("f1", "precision", "recall", "roc_auc") for t in ("mean", "std")]


@query(
    "G3_summary_struct",
    f"select 'test_set' evaluation_type, count(*) n_buildings, cast(sum(n_sequences) as bigint) total_sequences, "
    f"{_summary_cols(EVAL_COLS[:4])}, {r('median(rmse)', 'rmse_median')}, "
    + _summary_cols(EVAL_COLS[4:]).replace("f1_score_", "f1_")
    + " from evaluated",
    *EVAL_CTES,
)
def g3(spark, d):
    s = evaluation.summary_struct(evaluated(spark, d))
    return s.select(
        "evaluation_type", "n_buildings", "total_sequences",
        *[f"forecast_metrics.{c}" for c in G3_FIELDS], *[f"anomaly_metrics.{c}" for c in G3_ANOMALY],
    )


K = 8
SKILL_CTES = (
    f"lagged as (select *, lag(y_true, {K}) over (partition by entity order by ts, event_id) y_base from predictions)",
    "skills as (select entity, sqrt(avg((y_true-y_pred)*(y_true-y_pred))) rmse_model, "
    "sqrt(avg((y_true-y_base)*(y_true-y_base))) rmse_baseline from lagged group by entity)",
)


def skills(spark, d):
    return evaluation.skill_vs_persistence(fixture(spark, d, "predictions"), K, tiebreak=["event_id"])


@query(
    "G4_skill_vs_persistence",
    f"select entity, {rs('rmse_model', 'rmse_baseline')}, {r('1 - rmse_model/nullif(rmse_baseline, 0)', 'skill')} from skills",
    *SKILL_CTES,
)
def g4(spark, d):
    return skills(spark, d)


@query(
    "J3_align_baseline_and_skill",
    f"select entity, {r('rmse_baseline')}, {r('1 - rmse_model/nullif(rmse_baseline, 0)', 'skill')} from skills",
    *SKILL_CTES,
)
def j3(spark, d):
    return skills(spark, d).select("entity", "rmse_baseline", "skill")


@query(
    "J2_join_skill",
    f"select m.entity, {rs('rmse', 'mae', 'mape', 'rmse_baseline')}, {r('1 - rmse_model/nullif(rmse_baseline, 0)', 'skill_w168')} "
    "from metrics m left join skills s on s.entity = m.entity",
    METRICS_CTE,
    *SKILL_CTES,
)
def j2(spark, d):
    return evaluation.add_skill(metrics_with_load(spark, d).drop("mean_load"), skills(spark, d))


LOADS = "loads as (select entity, avg(value) mean_load from readings group by entity)"
TABLE_CTE = (
    "metric_table as (select m.entity, rmse, mae, mape, mape mape_pct, mean_load, rmse/nullif(mean_load,0) nrmse, "
    "100*mae/nullif(mean_load,0) wape_pct, rmse_baseline, 1 - rmse_model/nullif(rmse_baseline,0) skill_w168, "
    "100*(1 - rmse_model/nullif(rmse_baseline,0)) skill_pct from metrics m left join loads using (entity) left join skills using (entity))"
)
TABLE_CTES = (METRICS_CTE, *SKILL_CTES, LOADS, TABLE_CTE)


def metric_table(spark, d):
    return evaluation.entity_metrics_table(
        fixture(spark, d, "predictions"), fixture(spark, d, "readings"), K, tiebreak=["event_id"]
    )


@query("G5_entity_metrics_table", f"select entity, {rs(*evaluation.TABLE_COLUMNS[1:])} from metric_table", *TABLE_CTES)
def g5(spark, d):
    return metric_table(spark, d)


@query(
    "O4_best_and_worst",
    f"(select entity, {rs('rmse','mae','r2','f1_score')}, 'best' side from evaluated order by evaluated.rmse, entity limit 5) union all "
    f"(select entity, {rs('rmse','mae','r2','f1_score')}, 'worst' side from evaluated order by evaluated.rmse desc, entity limit 5)",
    *EVAL_CTES,
)
def o4(spark, d):
    return ranking.best_and_worst(evaluated(spark, d).select("entity", "rmse", "mae", "r2", "f1_score"))


def _ranked(key: str, metric: str, worst: bool, order: str) -> None:
    @query(
        key,
        f"select entity, {rs('nrmse', 'skill_w168')} from metric_table order by metric_table.{metric} {order} nulls last, entity limit 20",
        *TABLE_CTES,
    )
    def run(spark, d):
        return ranking.rank_entities(metric_table(spark, d), metric, worst).select("entity", "nrmse", "skill_w168")


_ranked("O5_rank_entities_worst_nrmse", "nrmse", True, "desc")
_ranked("O5_rank_entities_worst_skill", "skill_w168", True, "asc")
_ranked("O5_rank_entities_best_skill", "skill_w168", False, "desc")


# Scores that are missing or no number, and labels that are missing.
FAULTY_CTE = (
    "faulty as (select event_id % 3 g, case when event_id % 11 = 0 then null when event_id % 13 = 0 and event_id % 3 = 1 "
    "then cast('NaN' as double) else y_score end y_score, case when event_id % 17 = 0 then null else y_label end y_label from predictions)"
)


def faulty(spark, d):
    id_, nan = F.col("event_id"), F.lit(float("nan"))
    score = F.when(id_ % 11 == 0, F.lit(None).cast("double")).when((id_ % 13 == 0) & (id_ % 3 == 1), nan).otherwise(F.col("y_score"))
    label = F.when(id_ % 17 == 0, F.lit(None).cast("int")).otherwise(F.col("y_label"))
    return fixture(spark, d, "predictions").select((id_ % 3).alias("g"), score.alias("y_score"), label.alias("y_label"))


_HIT = "(y_score >= 0.5 and not isnan(y_score))"


@query(
    "E9_binary_counts_faulty_scores",
    f"select g, count(*) filter (y_label = 1 and {_HIT}) true_positives, count(*) filter (y_label <> 1 and {_HIT}) false_positives, "
    f"count(*) filter (y_label <> 1 and not {_HIT}) true_negatives, count(*) filter (y_label = 1 and not {_HIT}) false_negatives "
    "from faulty where y_label is not null and y_score is not null group by g",
    FAULTY_CTE,
)
def e9_faulty(spark, d):
    return classification.binary_metrics(faulty(spark, d), by=["g"]).select("g", *classification.COUNTS)


@query(
    "E10_roc_auc_faulty_scores",
    "select g, " + r(
        "case when max(case when isnan(y_score) then 1 else 0 end) = 1 then 0e0 else "
        "(sum(case when y_label = 1 then rk end) - count(*) filter (y_label = 1) * (count(*) filter (y_label = 1) + 1) / 2e0) "
        "/ (count(*) filter (y_label = 1) * count(*) filter (y_label <> 1)) end", "roc_auc"
    ) + " from (select *, rank() over w + (count(*) over (partition by g, y_score) - 1) / 2e0 rk from faulty "
    "where y_label is not null and y_score is not null window w as (partition by g order by y_score)) group by g",
    FAULTY_CTE,
)
def e10_faulty(spark, d):
    return classification.roc_auc(faulty(spark, d), by=["g"])


@query(
    "E11_threshold_counts_faulty_scores",
    f"select g, cast(i as integer) i, count(*) filter (y_label = 1 and {_HIT.replace('0.5', 'i * (1e0 / 99)')}) true_positives, "
    f"count(*) filter (y_label <> 1 and {_HIT.replace('0.5', 'i * (1e0 / 99)')}) false_positives "
    "from faulty cross join (select unnest(range(100)) i) where y_label is not null and y_score is not null group by all",
    FAULTY_CTE,
)
def e11_faulty(spark, d):
    curve = classification.threshold_curve(faulty(spark, d), by=["g"])
    return curve.select("g", "i", *classification.COUNTS[:2])
