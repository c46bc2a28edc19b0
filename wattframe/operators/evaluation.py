"""Per-entity evaluation of predictions, and summaries over entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import errors as E
from ..functions.columns import ratio
from .classification import (
    COUNTS, anomaly_metrics, both_classes, confusion_counts, finite_pair, rates, roc_auc,
)
from .forecast_metrics import error_columns, forecast_metrics
from .grouping import merge_single_rows
from .quantiles import exact_medians, exact_quantiles
from .reshape import add_error_ratios
from .resample import mean_load
from .series import lag_baseline

FORECAST = ("rmse", "mae", "mape", "r2")
ANOMALY = ("f1_score", "precision", "recall", "roc_auc")

# Weights of forecast and anomaly quality in the combined score.
WEIGHTS = (0.6, 0.4)

TABLE_COLUMNS = (
    "entity", "rmse", "mae", "mape", "mape_pct", "mean_load", "nrmse", "wape_pct",
    "rmse_baseline", "skill_w168", "skill_pct",
)


def combined_score(
    r2: str = "r2", f1: str = "f1_score", weights: Sequence[float] = WEIGHTS, clip_above: bool = True
) -> Column:
    """100 times the weighted sum of R² (not below 0 and, by default, not above
    1) and F1."""
    part = F.least(F.lit(1.0), F.col(r2)) if clip_above else F.col(r2)
    return 100 * (weights[0] * F.greatest(F.lit(0.0), part) + weights[1] * F.coalesce(F.col(f1), F.lit(0.0)))


def evaluate(
    df: DataFrame,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    label: str = "y_label",
    score: str = "y_score",
    threshold: float = 0.5,
    weights: Sequence[float] = WEIGHTS,
) -> DataFrame:
    """All forecast and classification metrics of one table, with the best
    threshold and the combined score: one row."""
    both = merge_single_rows(
        forecast_metrics(df, (), y_true, y_pred), anomaly_metrics(df, threshold, True, (), label, score)
    )
    return both.withColumn("combined_score", combined_score(weights=weights))


def evaluate_by_entity(
    df: DataFrame,
    entity: str = "entity",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    label: str | None = "y_label",
    score: str | None = "y_score",
    sequence: str | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Per entity: number of sequences (distinct ``sequence``, or rows), rmse,
    mae, mape, r2, and F1, precision, recall, AUC where labels are given."""
    n = F.count_distinct(F.col(sequence)) if sequence else F.count(F.lit(1))
    aggs = [n.alias("n_sequences"), *error_columns(FORECAST, y_true, y_pred)]
    if not (label and score):
        return df.groupBy(entity).agg(*aggs)
    # Errors and confusion counts share one pass; only the AUC needs an order.
    y, p = finite_pair(label, score)
    rows = df.withColumns({"_y": y, "_s": p})
    out = rows.groupBy(entity).agg(*aggs, *confusion_counts(threshold, "_y", "_s"))
    auc = roc_auc(rows.filter("_y is not null"), [entity], "_y", "_s")
    found = {**rates(*[F.col(c) for c in COUNTS]), "roc_auc": F.col("roc_auc")}
    return out.join(auc, entity, "left").select(
        entity,
        "n_sequences",
        *FORECAST,
        *[F.when(both_classes(), found[c]).otherwise(0.0).alias(c) for c in ANOMALY],
    )


def evaluation_coverage(ids: DataFrame, evaluated: DataFrame, entity: str = "entity") -> DataFrame:
    """How many of the listed entities were evaluated and how many skipped."""
    marked = ids.select(entity).distinct().join(
        evaluated.select(entity, F.lit(1).alias("_hit")).distinct(), entity, "left"
    )
    return marked.agg(F.count("_hit").alias("evaluated"), F.count_if(F.col("_hit").isNull()).alias("skipped"))


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each metric over entities, mean
    and population deviation of the combined score, and sequence counts."""
    metrics = [m for m in (*FORECAST, *ANOMALY) if m in evaluated.columns]
    aggs = [f(m).alias(f"{m}_{tag}") for m in metrics for tag, f in (("mean", F.avg), ("std", F.stddev_samp))]
    if "f1_score" in evaluated.columns:
        c = combined_score(clip_above=False)
        aggs += [F.avg(c).alias("combined_mean"), F.stddev_pop(c).alias("combined_std")]
    return evaluated.agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("n_sequences").alias("total_sequences"),
        F.avg("n_sequences").alias("mean_sequences"),
        *aggs,
    )


def rmse_percentiles(evaluated: DataFrame, metric: str = "rmse") -> DataFrame:
    """Quartiles of a metric over entities, linearly interpolated."""
    return exact_quantiles(evaluated, metric, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def summary_struct(evaluated: DataFrame, set_name: str = "test") -> DataFrame:
    """The evaluation summary as one nested row, ready for a JSON sink."""
    flat = merge_single_rows(evaluation_summary(evaluated), exact_medians(evaluated, {"rmse_median": "rmse"}))

    def pick(names: Sequence[str]) -> Column:
        cols = []
        for m in names:
            cols += [F.col(f"{m}_mean"), F.col(f"{m}_std")]
            if m == "rmse":
                cols.append(F.col("rmse_median"))
        return F.struct(*cols)

    anomaly = F.struct(*[
        F.col(f"{m}_{t}").alias(f"{'f1' if m == 'f1_score' else m}_{t}") for m in ANOMALY for t in ("mean", "std")
    ])
    return flat.select(
        F.lit(f"{set_name}_set").alias("evaluation_type"),
        F.col("entities").alias("n_buildings"),
        "total_sequences",
        pick(FORECAST).alias("forecast_metrics"),
        anomaly.alias("anomaly_metrics"),
    )


def skill_vs_persistence(
    df: DataFrame,
    k: int = 168,
    entity: str = "entity",
    ts: str = "ts",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Per entity: RMSE of the model, RMSE of the lag-``k`` baseline over the
    rows that have one, and 1 - model / baseline (NULL without a baseline)."""
    lagged = lag_baseline(df.select(entity, ts, y_true, y_pred, *tiebreak), k, entity, ts, y_true, tiebreak)
    return (
        lagged.groupBy(entity)
        .agg(E.rmse(y_true, y_pred).alias("rmse_model"), E.rmse(y_true, "y_base").alias("rmse_baseline"))
        .withColumn("skill", 1 - ratio("rmse_model", "rmse_baseline"))
    )


def add_mean_load(metrics: DataFrame, readings: DataFrame, entity: str = "entity", value: str = "value") -> DataFrame:
    """Left join of each entity's mean reading to its metrics."""
    return metrics.join(mean_load(readings, entity, value), entity, "left")


def add_skill(metrics: DataFrame, skill: DataFrame, entity: str = "entity", name: str = "skill_w168") -> DataFrame:
    """Left join of baseline error and skill to the metrics."""
    return metrics.join(skill.select(entity, "rmse_baseline", F.col("skill").alias(name)), entity, "left")


def entity_metrics_table(
    predictions: DataFrame,
    readings: DataFrame,
    k: int = 168,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The per-entity table a dashboard shows: errors, errors relative to the
    mean load, and skill against persistence, in ``TABLE_COLUMNS`` order."""
    errors = forecast_metrics(predictions, [entity], metrics=("rmse", "mae", "mape"))
    table = add_mean_load(errors, readings, entity, value)
    table = add_skill(table, skill_vs_persistence(predictions, k, entity, ts, tiebreak=tiebreak), entity)
    return add_error_ratios(table).select(entity, *TABLE_COLUMNS[1:])
