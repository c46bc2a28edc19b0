"""Binary-classification metrics of a table of labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import DIGIT, NAN_BUCKET, is_finite, order_bucket, order_key, ratio0
from .grouping import GROUP_LIMIT, merge_single_rows, split_hot

COUNTS = ("true_positives", "false_positives", "true_negatives", "false_negatives")

# Fixed value: number of evenly spaced thresholds from 0 to 1.
GRID = 100


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio0(tp + tn, tp + fp + tn + fn),
        "precision": ratio0(tp, tp + fp),
        "recall": ratio0(tp, tp + fn),
        "f1_score": ratio0(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio0(tn, tn + fp),
    }


def confusion_counts(threshold: float, label: str, score: str) -> list[Column]:
    """The four counts as aggregates; rows without label or score do not count. A
    NaN score reaches no threshold."""
    truth, hit = F.col(label) == 1, (F.col(score) >= threshold) & ~F.isnan(F.col(score).cast("double"))
    cells = (truth & hit, ~truth & hit, ~truth & ~hit, truth & ~hit)
    return [F.count_if(c).alias(n) for c, n in zip(cells, COUNTS)]


def finite_pair(label: str, score: str) -> tuple[Column, Column]:
    """Label and score, both NULL unless both are finite."""
    ok = is_finite(label) & is_finite(score)
    return F.when(ok, F.col(label)), F.when(ok, F.col(score).cast("double"))


RATES = ("accuracy", "precision", "recall", "f1_score", "specificity")


def binary_metrics(
    df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), label: str = "y_label", score: str = "y_score"
) -> DataFrame:
    """Confusion counts and rates at one threshold (0 on zero division)."""
    counts = df.groupBy(*by).agg(*confusion_counts(threshold, label, score))
    return counts.select(*by, *[c.alias(n) for n, c in rates(*[F.col(c) for c in COUNTS]).items()], *COUNTS)


def _pairs_inside(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per group ``_p`` and ``_q``, its positive and negative rows, and ``_pairs``, the
    pairs among them in the right order; equal ones count half."""
    bucket = "partition by " + ", ".join(f"`{k}`" for k in keys)
    placed = rows.selectExpr(
        "*",
        f"sum(_q) over ({bucket} order by {order} range between unbounded preceding and current row) as _upto",
        f"sum(_q) over ({bucket} order by {order} range between current row and current row) as _same",
    )
    return placed.groupBy(*keys).agg(*map(F.expr, ("sum(_p) as _p", "sum(_q) as _q", "sum(double(_p) * (_upto - double(_same) / 2)) as _pairs")))


def _pairs_across(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The same for groups of such counts, in ``order``: pairs inside the parts, and
    between a part and those below it."""
    bucket = "partition by " + ", ".join(f"`{k}`" for k in keys)
    placed = parts.selectExpr("*", f"coalesce(sum(_q) over ({bucket} order by {order} rows between unbounded preceding and 1 preceding), 0) as _below")
    return placed.groupBy(*keys).agg(*map(F.expr, ("sum(_p) as _p", "sum(_q) as _q", "sum(_pairs + double(_p) * _below) as _pairs")))


def roc_auc(
    df: DataFrame, by: Sequence[str] = (), label: str = "y_label", score: str = "y_score", limit: int = GROUP_LIMIT, digit: int = DIGIT
) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 for a single class.

    Rows without label or score do not count; a NaN score has no rank, and the area
    of its group is 0. Pairs are counted inside order-preserving score buckets, and one row per
    bucket carries the counts of the buckets below. A bucket with very many
    rows first collapses to counts per distinct score, and is then cut by the
    digits of the scores' order keys: no window is over more than 2**23 rows,
    however many distinct scores there are.
    """
    df = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    by, part = list(by), ", ".join(f"`{b}`" for b in by)
    rows = df.select(
        *by,
        F.col(score).cast("double").alias("_s"),
        (F.col(label) == 1).cast("long").alias("_p"),
        (F.col(label) != 1).cast("long").alias("_q"),
        order_bucket(score).alias("_b"),
    )
    small, large = split_hot(rows, [*by, "_b"], limit)
    keys = [*by, "_b"]
    cells = large.groupBy(*keys, order_key("_s").alias("_k")).agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    leaves = _pairs_inside(cells.withColumn("_leaf", F.shiftright("_k", digit)), [*keys, "_leaf"], "_k")
    nodes = _pairs_across(leaves.withColumn("_node", F.shiftright("_leaf", digit)), [*keys, "_node"], "_leaf")
    buckets = _pairs_inside(small, keys, "_s").unionByName(_pairs_across(nodes, keys, "_node"))
    return (
        buckets.selectExpr(
            "*",
            f"coalesce(sum(_q) over (partition by {part or '0'} order by _b "
            "rows between unbounded preceding and 1 preceding), 0) as _below",
        )
        .groupBy(*by)
        .agg(F.expr(
            f"if(max(_b) = {NAN_BUCKET}, 0D, "
            "coalesce(sum(_pairs + double(_p) * _below) / nullif(sum(double(_p)) * sum(double(_q)), 0D), 0D)) as roc_auc"
        ))
    )


def _curves(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """One row per group (or the only one) with ``_curve``: at each of the ``GRID``
    thresholds ``i``, ``threshold``, ``COUNTS`` and ``RATES``.

    Each row is counted once, at the last threshold it reaches. A group has at most
    ``GRID + 1`` such counts; only those it has are shuffled and put in its row, and
    the sums over later thresholds are made there.
    """
    df = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    step = 1.0 / (GRID - 1)
    # A NaN score reaches no threshold.
    s = F.nanvl(F.col(score).cast("double"), F.lit(float("-inf")))
    near = F.least(F.greatest(F.floor(s / step), F.lit(-1)), F.lit(GRID - 1))
    # The division may be off by one step at a grid point.
    at = (
        F.when((near < GRID - 1) & ((near + 1) * F.lit(step) <= s), near + 1)
        .when((near >= 0) & (near * F.lit(step) > s), near - 1)
        .otherwise(near)
    )
    truth = F.col(label) == 1
    hist = df.groupBy(*by, at.cast("int").alias("i")).agg(
        F.count_if(truth).alias("p"), F.count_if(~truth).alias("q")
    )
    held = hist.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("p", "q")))).alias("_cells"))
    zero = F.lit(0).cast("long")

    def cell(i: Column) -> Column:
        found = F.col("_cells")[i]
        return F.struct(i.alias("i"), F.coalesce(found["p"], zero).alias("p"), F.coalesce(found["q"], zero).alias("q"))

    def add(sums: Column, c: Column) -> Column:
        # ``upto``: the counts from each threshold on, the last first.
        p, q = (sums["p"] + c["p"]).alias("p"), (sums["q"] + c["q"]).alias("q")
        return F.struct(p, q, F.concat(sums["upto"], F.array(F.struct(c["i"].alias("i"), p, q))).alias("upto"))

    none = F.struct(zero.alias("p"), zero.alias("q"), F.array().cast("array<struct<i int, p bigint, q bigint>>").alias("upto"))
    dense = F.transform(F.sequence(F.lit(GRID - 1), F.lit(-1)), cell)
    summed = held.select(*by, F.aggregate(dense, none, add).alias("_sums"))

    def rated(c: Column) -> Column:
        counts = (c["p"], c["q"], F.col("_sums.q") - c["q"], F.col("_sums.p") - c["p"])
        named = [x.alias(n) for n, x in (*zip(COUNTS, counts), *rates(*counts).items())]
        return F.struct(c["i"].alias("i"), (c["i"] * F.lit(step)).alias("threshold"), *named)

    return summed.select(*by, F.transform(F.slice("_sums.upto", 1, GRID), rated).alias("_curve"))


def threshold_curve(df: DataFrame, by: Sequence[str] = (), label: str = "y_label", score: str = "y_score") -> DataFrame:
    """Confusion counts and rates at each of the ``GRID`` thresholds; without ``by``
    also where no row has label and score."""
    by = list(by)
    return _curves(df, by, label, score).select(*by, F.inline("_curve"))


def optimal_threshold(
    df: DataFrame, metric: str = "f1", by: Sequence[str] = (), label: str = "y_label", score: str = "y_score"
) -> DataFrame:
    """The first threshold with the greatest metric, and that metric; (0.5, 0)
    where it is never above 0."""
    name = "f1_score" if metric == "f1" else metric
    if name not in RATES:
        raise ValueError(f"unknown metric {metric!r}")
    by = list(by)
    best = _curves(df, by, label, score).select(
        *by, F.array_max(F.transform("_curve", lambda c: F.struct(c[name].alias("m"), (-c["i"]).alias("neg"), c["threshold"].alias("t")))).alias("_b")
    )
    some = F.col("_b.m") > 0
    return best.select(
        *by,
        F.when(some, F.col("_b.t")).otherwise(0.5).alias("optimal_threshold"),
        F.when(some, F.col("_b.m")).otherwise(0.0).alias("best_value"),
    )


def anomaly_metrics(
    df: DataFrame,
    threshold: float = 0.5,
    find_optimal: bool = False,
    by: Sequence[str] = (),
    label: str = "y_label",
    score: str = "y_score",
) -> DataFrame:
    """All classification metrics over the rows with finite label and score.

    Where no such row or only one class is left, rates are 0 and counts NULL.
    ``find_optimal`` adds the threshold of the best F1 (NULL in that case).
    """
    by = list(by)
    y, p = finite_pair(label, score)
    clean = df.select(*by, y.alias("_y"), p.alias("_s"))
    known = clean.filter("_y is not null")
    parts = [binary_metrics(clean, threshold, by, "_y", "_s"), roc_auc(known, by, "_y", "_s")]
    if find_optimal:
        best = optimal_threshold(known, "f1", by, "_y", "_s")
        parts.append(best.withColumnRenamed("best_value", "optimal_f1"))
    if by:
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, by, "left")
    else:
        out = merge_single_rows(*parts)
    both = both_classes()
    extra = ["optimal_threshold", "optimal_f1"] if find_optimal else []
    return out.select(
        *by,
        *[F.when(both, F.col(c)).otherwise(0.0).alias(c) for c in (*RATES, "roc_auc")],
        *[F.when(both, F.col(c)).alias(c) for c in (*COUNTS, *extra)],
        F.lit(float(threshold)).alias("threshold"),
    )


def both_classes() -> Column:
    """True where the confusion counts hold a row of either class."""
    tp, fp, tn, fn = [F.col(c) for c in COUNTS]
    return (tp + fn > 0) & (fp + tn > 0)
