"""Operators that depend on the time order inside each entity's series.

One entity may hold a large share of all rows, so no window runs over a whole
entity. A series is cut into blocks of fixed width in time, and a block with very
many rows into pieces of a width that its number of rows asks for; windows run
inside one (entity, piece), and only a summary row per piece is ordered over the
whole entity. Repeated readings are collapsed into counts before that, so
copies of one reading cost one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import day_block, duration, is_finite
from ..session import lazy_checkpoint
from .grouping import GROUP_LIMIT, hot_groups, join_per_key, null_safe, split_hot

BLOCK_DAYS = 32

# Fixed order of the features in a training sequence.
FEATURES = (
    "hour", "day_of_week", "month", "is_weekend", "is_working_hours", "quarter", "day_of_year", "value",
)


def _prior(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


#: A block is cut into at most 2**PIECE_BITS pieces.
PIECE_BITS = 20
#: Pieces are so many times finer than an even spread of the rows would need.
FINER_BITS = 6


def piece_of(ts: str, block_days: int, rows: Column | None = None, limit: int = GROUP_LIMIT) -> Column:
    """A long that numbers the pieces of time in order: the block's number, and the
    part of the block. Blocks of unknown size (``rows`` null) are one piece; others
    are cut into a power of two of equal parts, 64 times as many as would do if
    their rows were spread evenly."""
    block = F.shiftleft(day_block(ts, block_days).cast("long"), PIECE_BITS)
    if rows is None:
        return block
    days = F.pmod(F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")), F.lit(block_days))
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.expr(f"cast(extract(second from `{ts}`) as double)")
    part = F.floor((days + clock / 86400.0) / block_days * (1 << PIECE_BITS)).cast("long")
    bits = F.least(F.lit(PIECE_BITS), F.ceil(F.log2(rows / limit)).cast("int") + FINER_BITS)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), PIECE_BITS - bits)
    return block + F.when(rows.isNull(), F.lit(0).cast("long")).otherwise(part - part % width)


def with_pieces(df: DataFrame, entity: str, ts: str, block_days: int, limit: int = GROUP_LIMIT) -> DataFrame:
    """``df`` with ``_blk``, the piece of its series that a row is in."""
    keyed = df.withColumn("_day", day_block(ts, block_days))
    hot = hot_groups(keyed, [entity, "_day"], limit, "_rows")
    named = keyed.join(hot, null_safe([entity, "_day"], ["_hot0", "_hot1"]), "left")
    return named.withColumn("_blk", piece_of(ts, block_days, F.col("_rows"), limit)).drop("_day", "_rows", "_hot0", "_hot1")


def tie_order(df: DataFrame, tiebreak: Sequence[str], *known: str) -> list[str]:
    """``tiebreak``, or without one all other columns that can be ordered, by name:
    rows that still tie are the same, so any order of them is as good."""
    if tiebreak:
        return list(tiebreak)
    plain = [f.name for f in df.schema.fields if f.name not in known and not f.dataType.typeName().startswith(("map", "variant"))]
    return [f"`{c}`" for c in sorted(plain)]


def row_index(
    df: DataFrame,
    entity: str = "entity",
    ts: str = "ts",
    tiebreak: Sequence[str] = (),
    name: str = "idx",
    block_days: int = BLOCK_DAYS,
    method: str = "blocks",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """0-based position of each row in its entity's series (plus ``tiebreak``; by
    default all other columns).

    Rows are numbered inside a piece of the series; the number of rows in
    earlier pieces is a prefix sum over one row per piece. With ``blocks`` a
    piece is a block of days, or a part of one with more than ``limit`` rows. With
    ``range`` the rows are first range-partitioned by (entity, time, tiebreak) and
    a piece is what one partition holds, so even a huge number of rows at one
    time is cut; that costs a checkpoint.
    """
    tiebreak = tie_order(df, tiebreak, entity, ts)
    if method == "blocks":
        keyed = with_pieces(df, entity, ts, block_days, limit)
    elif method == "range":
        placed = df.repartitionByRange(F.col(entity), F.col(ts), *[F.col(c) for c in tiebreak])
        # Both uses below must see the same partitions, also after a lost executor.
        keyed = lazy_checkpoint(placed).withColumn("_blk", F.spark_partition_id())
    else:
        raise ValueError(f"unknown method {method!r}")
    series = Window.partitionBy(entity).orderBy("_blk")
    offsets = (
        keyed.groupBy(entity, "_blk")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(entity, "_blk", F.coalesce(F.sum("_cnt").over(_prior(series)), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(entity, "_blk").orderBy(ts, *tiebreak)
    # Rows without an entity or a time have positions too: such times come first.
    same = F.col(f"k.`{entity}`").eqNullSafe(F.col(f"o.`{entity}`")) & F.col("k._blk").eqNullSafe(F.col("o._blk"))
    return (
        keyed.alias("k")
        .join(offsets.alias("o"), same)
        .select("k.*", "o._off")
        .withColumn(name, F.row_number().over(inside).cast("long") - 1 + F.col("_off"))
        .drop("_blk", "_off")
    )


def time_gaps(
    df: DataFrame, entity: str = "entity", ts: str = "ts", block_days: int = BLOCK_DAYS, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Difference of each reading's time to the one before it.

    One row per distinct (entity, time) with ``readings``, the number of rows
    at that time: the first of them has this ``gap``, any further one has a
    gap of zero. ``gap`` is an interval, NULL for the first time of a series.
    """
    rows = with_pieces(df.filter(F.col(ts).isNotNull()).select(entity, ts), entity, ts, block_days, limit)
    block, series = [entity, "_blk"], Window.partitionBy(entity).orderBy("_blk")
    carry = (
        rows.groupBy(*block).agg(F.max(ts).alias("_last")).select(*block, F.lag("_last").over(series).alias("_carry"))
    )
    small, large = split_hot(rows, block, limit)
    counted = small.withColumn("_c", F.lit(1).cast("long")).unionByName(
        large.groupBy(*block, ts).agg(F.count(F.lit(1)).alias("_c"))
    )
    inside = Window.partitionBy(*block).orderBy(ts)
    return (
        join_per_key(counted, carry, block, "inner")
        .groupBy(*block, ts, "_carry")
        .agg(F.sum("_c").alias("readings"))
        .withColumn("prev_ts", F.coalesce(F.lag(ts).over(inside), F.col("_carry")))
        .withColumn("gap", F.col(ts) - F.col("prev_ts"))
        .select(entity, ts, "readings", "prev_ts", "gap")
    )


def duplicate_flags(
    df: DataFrame, entity: str = "entity", ts: str = "ts", tiebreak: Sequence[str] = ("seq",)
) -> DataFrame:
    """Mark second and later rows at one (entity, time) in ``tiebreak`` order. Rows
    without a time are at one time. ``tiebreak`` has to be unique within an
    (entity, time) for the same rows to be marked each time."""
    w = Window.partitionBy(entity, ts).orderBy(*tiebreak)
    return df.withColumn("is_duplicate", F.row_number().over(w) > 1)


def collapsed(
    df: DataFrame,
    entity: str,
    ts: str,
    value: str,
    block_days: int = BLOCK_DAYS,
    unique: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Readings as (entity, ``_blk``, ``_t``, ``_v``, ``_c``) with ``_c`` rows each.

    In blocks of more than ``limit`` rows equal readings collapse into one row
    before they meet, and the block is cut into pieces; other blocks need no
    grouping and no shuffle here. Where the caller knows that readings are unique
    (after ``dedup``), ``unique=True`` leaves out the look at block sizes.
    """
    base = df.selectExpr(f"`{entity}`", f"`{ts}` as _t", f"nanvl(cast(`{value}` as double), cast(null as double)) as _v")
    base = base.withColumn("_blk", piece_of("_t", block_days))
    one = F.lit(1).cast("long").alias("_c")
    if unique:
        return base.select(entity, "_blk", "_t", "_v", one)
    small, large = split_hot(base, [entity, "_blk"], limit, "_rows")
    cut = large.withColumn("_blk", piece_of("_t", block_days, F.col("_rows"), limit))
    return small.select(entity, "_blk", "_t", "_v", one).unionByName(
        cut.groupBy(entity, "_blk", "_t", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )


def with_runs(cells: DataFrame, entity: str) -> DataFrame:
    """Number the runs of equal non-missing values inside each block (``_run``
    counts from 1; rows before the first value have 0). Ties in time are taken
    in value order."""
    w = f"partition by `{entity}`, _blk order by _t, _v rows between unbounded preceding and"
    return (
        cells.selectExpr("*", f"last(_v, true) over ({w} 1 preceding) as _pv")
        .selectExpr("*", f"sum(if(_v is not null and not (_v <=> _pv), 1, 0)) over ({w} current row) as _run")
        .drop("_pv")
    )


def chained_run(entity: str, value: str, is_inner_edge: Column, order: Sequence[str]) -> Column:
    """Run number over edge runs in series order: an edge starts a new run when
    it is the later edge of its own block or its value differs from the one
    before it. Blocks without a value do not interrupt a run."""
    w = Window.partitionBy(entity).orderBy(*order)
    prev = F.last(value, ignorenulls=True).over(_prior(w))
    return F.col(value).isNotNull() & (is_inner_edge | ~prev.eqNullSafe(F.col(value)))


def constant_runs(
    df: DataFrame,
    min_length: int,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    block_days: int = BLOCK_DAYS,
    unique: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Runs of at least ``min_length`` equal consecutive non-missing values:
    entity, value, run_start, run_end, run_length. Missing values in between do
    not end a run."""
    cells = with_runs(collapsed(df, entity, ts, value, block_days, unique, limit), entity)
    runs = (
        cells.filter(F.col("_v").isNotNull())
        .groupBy(entity, "_blk", "_run")
        .agg(
            F.max("_v").alias("_v"),
            F.min("_t").alias("_from"),
            F.max("_t").alias("_to"),
            F.sum("_c").alias("_len"),
        )
        .withColumn("_last", F.max("_run").over(Window.partitionBy(entity, "_blk")))
    )
    columns = [
        F.col(entity),
        F.col("_v").alias("value"),
        F.col("_from").alias("run_start"),
        F.col("_to").alias("run_end"),
        F.col("_len").alias("run_length"),
    ]
    inner = runs.filter("_run > 1 and _run < _last and _len >= {}".format(int(min_length))).select(*columns)

    order = ("_blk", "_run")
    series = Window.partitionBy(entity).orderBy(*order)
    edges = (
        runs.filter("_run = 1 or _run = _last")
        .withColumn("_new", chained_run(entity, "_v", F.col("_run") > 1, order).cast("int"))
        .withColumn("_id", F.sum("_new").over(series.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(entity, "_id")
        .agg(
            F.max("_v").alias("_v"),
            F.min("_from").alias("_from"),
            F.max("_to").alias("_to"),
            F.sum("_len").alias("_len"),
        )
        .filter(F.col("_len") >= int(min_length))
        .select(*columns)
    )
    return inner.unionByName(edges)


def lag_columns(
    df: DataFrame,
    lags: Mapping[str, int],
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    tiebreak: Sequence[str] = (),
    block_days: int = BLOCK_DAYS,
    method: str = "blocks",
) -> DataFrame:
    """``value`` of so many rows earlier in the entity's series, one column per
    entry of ``lags``, NULL where there is none.

    Rows are numbered, cut into chunks of 16 times the longest lag ``k``, and
    the last ``k`` rows of a chunk are repeated in the next one, so every lag
    is found inside one (entity, chunk).
    """
    k = max(int(n) for n in lags.values())
    size = 16 * k
    pos = row_index(df, entity, ts, tiebreak, "_idx", block_days, method)
    own = F.floor(F.col("_idx") / size).cast("long")
    tail = (F.col("_idx") % size) >= size - k
    placed = pos.withColumn(
        "_chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(entity, "_chunk").orderBy("_idx")
    return (
        placed.withColumns({name: F.lag(value, int(n)).over(w) for name, n in lags.items()})
        .filter(own == F.col("_chunk"))
        .drop("_idx", "_chunk")
    )


def lag_baseline(
    df: DataFrame,
    k: int = 168,
    entity: str = "entity",
    ts: str = "ts",
    y_true: str = "y_true",
    tiebreak: Sequence[str] = (),
    name: str = "y_base",
    block_days: int = BLOCK_DAYS,
    method: str = "blocks",
) -> DataFrame:
    """Seasonal persistence: ``y_true`` of ``k`` rows earlier as ``y_base``."""
    return lag_columns(df, {name: k}, entity, ts, y_true, tiebreak, block_days, method)


def latest_rows(
    df: DataFrame, k: int, entity: str = "entity", ts: str = "ts", tiebreak: Sequence[str] = (),
    name: str = "back", block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """The last ``k`` rows per entity with ``back`` = 1 for the last. First the
    last ``k`` of each block, so a long series shrinks before it meets."""
    order = [F.desc(ts), *[F.desc(c) for c in tiebreak]]
    near = Window.partitionBy(entity, "_blk").orderBy(*order)
    whole = Window.partitionBy(entity).orderBy(*order)
    return (
        df.withColumn("_blk", day_block(ts, block_days))
        .withColumn("_rn", F.row_number().over(near))
        .filter(F.col("_rn") <= k)
        .withColumn(name, F.row_number().over(whole))
        .filter(F.col(name) <= k)
        .drop("_rn", "_blk")
    )


def sliding_sequences(
    df: DataFrame,
    lookback: int = 480,
    horizon: int = 240,
    stride: int = 8,
    entity: str = "entity",
    ts: str = "ts",
    value: str = "value",
    features: Sequence[str] = FEATURES,
    tiebreak: Sequence[str] = (),
    contiguous_step: str | None = None,
    keep: Sequence[str] = (),
    block_days: int = BLOCK_DAYS,
    method: str = "blocks",
) -> DataFrame:
    """Training windows: ``lookback`` rows of ``features`` as ``x`` and the
    next ``horizon`` values as ``y``, every ``stride`` rows.

    A row goes to its own chunk of rows and, near the start of a chunk, also to
    the chunk before, so a window lies whole inside the chunk it starts in. A
    chunk holds at most ``2 (lookback + horizon) + stride`` rows, whatever the
    length of the series. Windows are positional; ``contiguous_step`` (for
    example ``'3H'``) keeps only those without a gap in time. ``keep`` lists
    columns that are the same in all rows of an entity and stay in the result.
    """
    span = lookback + horizon
    size = stride * -(-span // stride)
    pos = row_index(df, entity, ts, tiebreak, "_idx", block_days, method)
    own = F.floor(F.col("_idx") / size).cast("long")
    shared = (F.col("_idx") % size < span - 1) & (own > 0)
    cell = F.struct(
        F.col("_idx").alias("idx"),
        F.col(ts).alias("ts"),
        F.array(*[F.col(value if f == "value" else f).cast("float") for f in features]).alias("x"),
        F.col(value).cast("float").alias("y"),
        *[F.col(c) for c in keep],
    )
    chunks = (
        pos.select(
            entity,
            F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))).alias("_chunk"),
            cell.alias("_cell"),
        )
        .groupBy(entity, "_chunk")
        .agg(F.sort_array(F.collect_list("_cell")).alias("_rows"))
    )
    starts = (
        chunks.filter(F.size("_rows") >= span)
        .withColumn(
            "_at",
            F.explode(F.sequence(F.lit(0), F.least(F.lit(size - 1), F.size("_rows") - span), F.lit(stride))),
        )
        .withColumn("_win", F.slice("_rows", F.col("_at") + 1, F.lit(span)))
    )
    out = starts.select(
        entity,
        *[F.col("_win")[0][c].alias(c) for c in keep],
        F.col("_win")[0]["idx"].alias("start_idx"),
        F.col("_win")[0]["ts"].alias("start_ts"),
        F.col("_win")[span - 1]["ts"].alias("end_ts"),
        F.expr(f"transform(slice(_win, 1, {int(lookback)}), r -> r.x) as x"),
        F.expr(f"transform(slice(_win, {int(lookback)} + 1, {int(horizon)}), r -> r.y) as y"),
    )
    if contiguous_step:
        n, unit = duration(contiguous_step).split()
        reach = F.expr(f"INTERVAL '{int(n) * (span - 1)}' {unit.upper()}")
        out = out.filter(F.col("end_ts") - F.col("start_ts") == reach)
    return out


def _finite_sequence() -> Column:
    return F.forall("x", lambda r: F.forall(r, is_finite)) & F.forall("y", is_finite)


def drop_nonfinite_sequences(seqs: DataFrame) -> DataFrame:
    """Keep sequences whose ``x`` and ``y`` are all finite."""
    return seqs.filter(_finite_sequence())


def nonfinite_sequence_report(seqs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sequences kept and skipped by ``drop_nonfinite_sequences``."""
    return seqs.groupBy(*by).agg(
        F.count_if(_finite_sequence()).alias("kept"), F.count_if(~_finite_sequence()).alias("skipped")
    )
