"""Per-entity data-quality report, its summaries and the selection on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import hours_between, ratio
from .grouping import GROUP_LIMIT, join_per_key, merge_single_rows
from .quantiles import exact_quantiles
from .series import BLOCK_DAYS, collapsed

REPORT_COLUMNS = (
    "total_records", "time_span_hours", "time_span_days",
    "completeness_ratio", "coverage_ratio", "continuity_ratio",
    "gaps_2h", "gaps_24h", "zero_ratio", "constant_ratio", "duplicate_ratio",
    "mean_value", "std_value", "median_value", "min_value", "max_value",
    "coefficient_of_variation", "quality_score",
)

# Weights of the quality score.
WEIGHTS = {
    "completeness_ratio": 0.30,
    "coverage_ratio": 0.25,
    "continuity_ratio": 0.25,
    "zero_ratio": 0.10,
    "constant_ratio": 0.05,
    "duplicate_ratio": 0.05,
}
COUNTED_AGAINST = ("zero_ratio", "constant_ratio", "duplicate_ratio")

# Tier bounds of the quality score.
HIGH, MEDIUM = 0.8, 0.6


def _score() -> str:
    return " + ".join(f"{w}D * ({f'1 - {c}' if c in COUNTED_AGAINST else c})" for c, w in WEIGHTS.items())


SUMS = ("n", "m", "zeros", "total", "spread", "gaps_2h", "gaps_24h", "times")
BOUNDS = {"t_min": "min", "t_max": "max", "v_min": "min", "v_max": "max"}


def _facts(
    df: DataFrame, g: float, entity: str, ts: str, value: str, block_days: int, runs: bool, unique: bool, limit: int
) -> DataFrame:
    """One row per entity with everything the report's formulas need but the
    median: counts, bounds, gaps, distinct times, mean, spread, stuck readings.

    Readings are summarised per block, on the partitioning of the block
    windows, and then per entity over one or two rows per block.
    """
    e = f"`{entity}`"
    near, day = f"interval '{2 * g * 3600:.6f}' second", "interval '24' hour"
    longest = max(int(48 / g), 2)

    def stuck(length: str) -> str:
        return f"greatest({length} - {longest} + 1, 0)"

    block = f"partition by {e}, _blk order by _t, _v"
    whole = f"({block} rows between unbounded preceding and unbounded following)"
    upto = f"({block} rows between unbounded preceding and current row)"
    cells = collapsed(df, entity, ts, value, block_days, unique, limit).selectExpr(
        "*",
        "if(_v is not null, _c, 0) as _known",
        f"_t - lag(_t) over ({block}) as _step",
        f"lag(_v) ignore nulls over ({block}) as _pv",
        f"sum(_c * _v) over {whole} / nullif(sum(if(_v is not null, _c, 0)) over {whole}, 0) as _bmean",
    )
    if runs:
        # Readings seen so far, and how many of them came before the current run.
        cells = cells.selectExpr("*", f"sum(_known) over {upto} as _seen").selectExpr(
            "*", f"max(if(_v is not null and not (_v <=> _pv), _seen - _known, 0)) over {upto} as _before"
        )
        per_run = (
            f"sum(if(_before > 0 and _v is not null, greatest(0, least(_known, _seen - _before - {longest} + 1)), 0)) as _stuck",
            "max(if(_before = 0, _v, null)) as v_first",
            "sum(if(_before = 0, _known, 0)) as l_first",
            "max_by(_v, if(_v is not null, _seen, null)) as _v_end",
            "max(_before) as _runs_before",
        )
    else:
        per_run = ()
    per_block = cells.groupBy(entity, "_blk").agg(*map(F.expr, (
        "sum(_c) as n",
        "sum(_known) as m",
        "sum(if(_v = 0, _c, 0)) as zeros",
        "sum(_c * _v) as total",
        "sum(_c * (_v - _bmean) * (_v - _bmean)) as spread",
        f"count_if(_step > {near}) as gaps_2h",
        f"count_if(_step > {day}) as gaps_24h",
        "count_if(_step is null or _step > interval '0' second) as times",
        "min(_t) as t_min",
        "max(_t) as t_max",
        "min(_v) as v_min",
        "max(_v) as v_max",
        *per_run,
    )))
    if runs:
        per_block = per_block.selectExpr(
            "*",
            "if(_runs_before > 0, _v_end, null) as v_last",
            "if(_runs_before > 0, m - _runs_before, 0) as l_last",
        ).selectExpr("*", f"_stuck - {stuck('l_last')} as inner_stuck")
    edge_columns = ("inner_stuck", "v_first", "l_first", "v_last", "l_last") if runs else ()

    # Across blocks: gaps and runs that cross a block border, pooled spread.
    series = f"partition by {e}"
    per_block = per_block.selectExpr(
        "*",
        f"t_min - lag(t_max) over ({series} order by _blk) as _border",
        f"total / nullif(m, 0) - sum(total) over ({series}) / nullif(sum(m) over ({series}), 0) as _off",
    ).selectExpr(
        e, "_blk", *edge_columns,
        *[c for c in SUMS if c not in ("gaps_2h", "gaps_24h", "spread")],
        *BOUNDS,
        f"gaps_2h + if(_border > {near}, 1, 0) as gaps_2h",
        f"gaps_24h + if(_border > {day}, 1, 0) as gaps_24h",
        "spread + m * _off * _off as spread",
    )
    if runs:
        # One row per block for its first run and all its sums, and one for a
        # separate last run; equal values of neighbouring edges make one run.
        order = f"{series} order by _blk, later rows between unbounded preceding and"
        edges = (
            per_block.selectExpr(
                "*",
                "explode(filter(array(named_struct('later', false, 'v', v_first, 'len', l_first), "
                "named_struct('later', true, 'v', v_last, 'len', l_last)), x -> not x.later or x.v is not null)) as _e",
            )
            .selectExpr("*", "_e.later as later", "_e.v as _ev", "coalesce(_e.len, 0) as _len")
            .selectExpr("*", f"last(_ev, true) over ({order} 1 preceding) as _pv")
            .selectExpr(
                "*",
                f"sum(if(_ev is not null and (later or not (_ev <=> _pv)), 1, 0)) over ({order} current row) as _chain",
            )
        )
        per_block = edges.groupBy(entity, "_chain").agg(*map(F.expr, (
            *[f"sum(if(later, null, {c})) as {c}" for c in SUMS],
            *[f"{f}(if(later, null, {c})) as {c}" for c, f in BOUNDS.items()],
            "sum(if(later, 0, inner_stuck)) as inner_stuck",
            "sum(_len) as _len",
        )))
        total_stuck = f"sum(inner_stuck + {stuck('_len')})"
    else:
        total_stuck = "cast(0 as bigint)"
    return per_block.groupBy(entity).agg(*map(F.expr, (
        *[f"sum({c}) as {c}" for c in SUMS],
        *[f"{f}({c}) as {c}" for c, f in BOUNDS.items()],
        f"{total_stuck} as stuck",
    )))


def quality_report(
    df: DataFrame,
    granularity_hours: float = 1,
    variant: str = "exact",
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    block_days: int = BLOCK_DAYS,
    unique: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Quality of each entity's series: the entity and ``REPORT_COLUMNS``.

    ``variant='fast'`` skips the detection of stuck readings (a tenth of the
    zero ratio stands in), divides zeros by all rows and has no special cases
    for a series without values. ``unique=True`` tells that readings are
    already deduplicated and saves one shuffle.
    """
    if variant not in ("exact", "fast"):
        raise ValueError(f"unknown variant {variant!r}")
    exact, g = variant == "exact", granularity_hours
    facts = _facts(df, g, entity, ts, value, block_days, exact, unique, limit)
    medians = exact_quantiles(df, value, {"median": 0.5}, [entity], limit)
    f = join_per_key(facts, medians, [entity]).withColumns({
        "hours": F.when(F.col("n") > 1, hours_between("t_min", "t_max")).otherwise(F.lit(0.0)),
        "mean": F.expr("total / nullif(m, 0)"),
        "std": F.expr("if(m > 1, sqrt(spread / nullif(m - 1, 0)), null)"),
    })
    if exact:
        shown = "if(m = 0, 0D, {})"
        special = {
            "coverage_ratio": f"if(n > 1, least(1D, n / (floor(hours / {g}) + 1)), 0D)",
            "zero_ratio": "if(m = 0, 1D, zeros / nullif(m, 0))",
            "constant_ratio": "if(m = 0, 1D, stuck / nullif(m, 0))",
            "coefficient_of_variation": "if(mean > 0, std / nullif(mean, 0), 0D)",
        }
    else:
        shown = "{}"
        special = {
            "coverage_ratio": f"least(1D, n / (floor(floor(hours) / {g}) + 1))",
            "zero_ratio": "zeros / n",
            "constant_ratio": "zeros / n * 0.1D",
            "coefficient_of_variation": "if(mean = 0 and std > 0, double('Infinity'), coalesce(std / nullif(mean, 0), 0D))",
        }
    columns = {
        "total_records": "n",
        "time_span_hours": "hours",
        "time_span_days": "hours / 24",
        "completeness_ratio": "m / n",
        "continuity_ratio": "if(n > 1, 1 - gaps_2h / nullif(n - 1, 0), 0D)",
        "gaps_2h": "gaps_2h",
        "gaps_24h": "gaps_24h",
        "duplicate_ratio": "(n - times) / n",
        **{f"{s}_value": shown.format(c) for s, c in (
            ("mean", "mean"), ("std", "std"), ("median", "median"), ("min", "v_min"), ("max", "v_max"),
        )},
        **special,
    }
    report = f.selectExpr(f"`{entity}`", *[f"{x} as {name}" for name, x in columns.items()])
    return report.selectExpr(
        f"`{entity}`", *[c for c in REPORT_COLUMNS if c != "quality_score"], f"{_score()} as quality_score"
    )


def quality_summary(report: DataFrame) -> DataFrame:
    """Mean, median, standard deviation, minimum and maximum of the score."""
    s = F.col("quality_score")
    plain = report.agg(
        F.avg(s).alias("mean_score"),
        F.stddev_samp(s).alias("std_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
    )
    return merge_single_rows(plain, exact_quantiles(report, "quality_score", {"median_score": 0.5})).select(
        "mean_score", "median_score", "std_score", "min_score", "max_score"
    )


def quality_tiers(report: DataFrame) -> DataFrame:
    """Entities and their share per tier: high, medium, low (all three rows)."""
    s = F.col("quality_score")
    counts = report.agg(
        F.count_if(s >= HIGH).alias("high"),
        F.count_if((s >= MEDIUM) & (s < HIGH)).alias("medium"),
        F.count_if(s < MEDIUM).alias("low"),
        F.count(F.lit(1)).alias("_n"),
    )
    return counts.unpivot(["_n"], ["high", "medium", "low"], "tier", "entities").select(
        "tier", "entities", (100 * ratio("entities", "_n")).alias("pct")
    )


def top_quality(report: DataFrame, k: int = 10, entity: str = "entity") -> DataFrame:
    """The ``k`` entities with the best score."""
    return (
        report.orderBy(F.desc_nulls_last("quality_score"), entity)
        .limit(k)
        .select(entity, "quality_score", "completeness_ratio", "continuity_ratio", "time_span_days", "total_records")
    )


def select_high_quality(
    report: DataFrame,
    min_quality_score: float = 0.8,
    min_records: int = 8760,
    min_time_span_hours: float = 8760,
    max_gap_ratio: float = 0.05,
) -> DataFrame:
    """Rows of the report that meet all four criteria."""
    return report.filter(
        _meets(min_quality_score, min_records, min_time_span_hours, max_gap_ratio)
    )


def _meets(
    min_quality_score: float = 0.8,
    min_records: int = 8760,
    min_time_span_hours: float = 8760,
    max_gap_ratio: float = 0.05,
) -> Column:
    return (
        (F.col("quality_score") >= min_quality_score)
        & (F.col("total_records") >= min_records)
        & (F.col("time_span_hours") >= min_time_span_hours)
        & (F.col("continuity_ratio") >= 1.0 - max_gap_ratio)
    )


def selection_summary(report: DataFrame, **criteria) -> DataFrame:
    """How many entities the criteria select, and the quality of those."""
    chosen = _meets(**criteria)
    score = F.when(chosen, F.col("quality_score"))
    plain = report.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(chosen).alias("selected"),
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.avg(F.when(chosen, F.col("completeness_ratio"))).alias("mean_completeness"),
        F.avg(F.when(chosen, F.col("continuity_ratio"))).alias("mean_continuity"),
    )
    median = exact_quantiles(report.filter(chosen), "quality_score", {"median_score": 0.5})
    return merge_single_rows(plain, median).withColumn("selection_rate_pct", 100 * ratio("selected", "entities"))
