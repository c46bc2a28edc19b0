"""Sharding by fixed virtual slots.

A record's hash gives one of thousands of virtual slots, for ever. What moves
is the map from slots to shards, a small versioned table. The first version
deals slots out evenly, before anything is known about them; then the bytes per
slot are aggregated, and the map is edited: slots go from shards that hold too
much to those that hold least, and nothing else moves. The same edit mends shards
that have drifted apart, and another one makes room for one more shard.

Everything is DataFrame or SQL functions; what is brought together in one row is
one entry per virtual slot, whose number is fixed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattframe.session import shared_path

from .common import pick, stored

#: Virtual slots; never changed for a stored map.
SLOTS = 4096
#: Bytes that a record costs besides its text.
OVERHEAD = 8
#: Copies of a row that are written out at a time.
COPIES = 4096


def _slot(slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text plus 8; a null text has none),
    ``text_crc32``, ``copy`` and ``virtual_slot`` of every row.

    Rows that are the same in the first three are numbered by ``copy``, from 0, and
    the slot hashes all four: copies of one row spread like any rows. They are
    counted first, and dealt out in parts, so they never meet in one task.
    """
    some = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    row = ["doc_id", "size", "text_crc32"]
    some = some.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = some.groupBy(*row).agg(F.count("*").alias("copies"))
    zero = F.lit(0).cast("long")
    parts = counted.withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("copies") - 1) / COPIES)))).repartition(*row, "part")
    copy = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1))
    return parts.select(*row, copy.alias("copy")).withColumn("virtual_slot", _slot(slots, *row, "copy"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """``virtual_slot``, ``bytes``, ``rows``: one aggregation, combined before its
    shuffle, of at most ``SLOTS`` result rows."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(entries: Column, loads: Column) -> Column:
    """Slots (structs ``bytes``, ``rows``, ``virtual_slot``, largest first) dealt one
    after the other to the shard with the least bytes so far, ``loads`` at first."""

    def step(state: Column, e: Column) -> Column:
        shard = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == shard, x + e["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(e["virtual_slot"].alias("virtual_slot"), shard.alias("shard"), e["bytes"].alias("bytes"), e["rows"].alias("rows")))).alias("placed"),
        )

    none = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>)")
    return F.aggregate(entries, F.struct(loads.alias("loads"), none.alias("placed")), step)["placed"]


def build_map(sizes: DataFrame, shards: int) -> DataFrame:
    """The first version of the map: ``version``, ``virtual_slot``, ``shard``,
    ``bytes``, ``rows``. Slots go, largest first, to the shard with the least bytes,
    so shards differ by no more than about the smallest slots."""
    # One row: an entry per virtual slot.
    one = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("by"), "virtual_slot", "bytes", "rows"))).alias("all"))
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    placed = one.select(F.explode(_dealt(F.col("all"), loads)).alias("p")).select("p.*")
    return placed.select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """The first version of a map that nothing is known for: slots in turn."""
    none = F.lit(0).cast("long")
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), none.alias("bytes"), none.alias("rows")
    )


def rebalance_map(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for the ``sizes`` that slots have by now.

    Slots are looked at once, the largest first. One leaves its shard if the shard
    stays at its fair share or above without it, and goes to the shard that holds
    least, which is below its share; so shards end about a small slot apart, and a
    map that is even already stays as it is. Slots that the map does not have go to
    the shard that holds least. Sizes of all slots that have rows have to be given;
    other slots are empty by now.
    """
    now = slot_map.select("virtual_slot", "shard").join(sizes.select("virtual_slot", "bytes", "rows"), "virtual_slot", "full")
    zero = F.lit(0).cast("long")
    now = now.select("virtual_slot", "shard", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows"))
    # One row: an entry per virtual slot.
    entry = F.struct((-F.col("bytes")).alias("by"), "virtual_slot", "shard", "bytes", "rows")
    one = now.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("all"), F.coalesce(F.sum("bytes"), zero).alias("total"))
    held = lambda k: F.aggregate(F.filter("all", lambda e: e["shard"] == k), zero, lambda s, e: s + e["bytes"])
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), held)
    fair = F.ceil(F.col("total") / F.lit(shards)).cast("long")

    def step(state: Column, e: Column) -> Column:
        load = F.get(state["loads"], e["shard"])
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        leaves = e["shard"].isNull() | ((e["bytes"] > 0) & (load - e["bytes"] >= state["fair"]))
        to = F.when(leaves, least).otherwise(e["shard"])
        moved = F.transform(state["loads"], lambda x, i: x + F.when(i == to, e["bytes"]).otherwise(zero) - F.when(i == e["shard"], e["bytes"]).otherwise(zero))
        placed = F.struct(e["virtual_slot"].alias("virtual_slot"), to.alias("shard"), e["bytes"].alias("bytes"), e["rows"].alias("rows"))
        return F.struct(F.when(leaves, moved).otherwise(state["loads"]).alias("loads"), state["fair"].alias("fair"), F.concat(state["placed"], F.array(placed)).alias("placed"))

    none = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>)")
    start = one.select("all", F.struct(loads.alias("loads"), fair.alias("fair"), none.alias("placed")).alias("start"))
    dealt = start.select(F.explode(F.aggregate("all", F.col("start"), step)["placed"]).alias("p"))
    version = F.lit(1) + slot_map.agg(F.max("version")).first()[0]
    return dealt.select(version.cast("int").alias("version"), "p.*")


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, for one more shard than the ``shards`` there are: the new
    shard (number ``shards``) takes slots from each other shard until it has about
    a fair share; no other slot moves."""
    total = slot_map.groupBy().agg(F.sum("bytes").alias("total"))
    give = slot_map.groupBy("shard").agg(
        F.sum("bytes").alias("held"), F.array_sort(F.collect_list(F.struct("bytes", "virtual_slot", "rows"))).alias("all")
    )

    def step(state: Column, e: Column) -> Column:
        moves = state["left"] - e["bytes"] >= state["floor"]
        left = F.when(moves, state["left"] - e["bytes"]).otherwise(state["left"])
        entry = F.struct(e["virtual_slot"].alias("virtual_slot"), moves.alias("moves"), e["bytes"].alias("bytes"), e["rows"].alias("rows"))
        return F.struct(left.alias("left"), state["floor"].alias("floor"), F.concat(state["out"], F.array(entry)).alias("out"))

    none = F.expr("cast(array() as array<struct<virtual_slot:int,moves:boolean,bytes:bigint,rows:bigint>>)")
    # Aggregated totals of one row each: at most ``shards`` rows meet one row.
    fair = give.withColumn("k", F.lit(1)).join(F.broadcast(total.withColumn("k", F.lit(1))), "k")
    floor = (F.col("total") / F.lit(shards + 1)).cast("long")
    moved = fair.select(
        "shard",
        F.explode(F.aggregate("all", F.struct(F.col("held").alias("left"), floor.alias("floor"), none.alias("out")), step)["out"]).alias("e"),
    )
    version = F.lit(1) + slot_map.agg(F.max("version")).first()[0]
    return moved.select(
        version.cast("int").alias("version"), "e.virtual_slot", F.when(F.col("e.moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "e.bytes", "e.rows"
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier ones stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def has_map(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored there."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    stored = spark.read.schema("virtual_slot int, shard int, bytes long, rows long, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(version))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's place in its shard (from 0,
    without gaps): slots follow each other, and within a slot ids do. The map has
    at most ``SLOTS`` rows, so it is broadcast."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    placed = rows.withColumn("before", F.row_number().over(inside) - 1).join(F.broadcast(starts), "virtual_slot")
    return placed.select(*rows.columns, "shard", (F.col("start") + F.col("before")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row's shard under the law ``bytes``: sizes of shards are near equal.

    Returns ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (place in
    the shard), ``virtual_slot`` and ``grown_shard`` (null: shards do not follow from
    the id alone). The map is stored below ``map_path``, by default a new place in
    the shared folder: an even first version, and the one edited by the bytes of
    each slot, which places the rows. A map that is there is edited again, so of
    rows that came earlier only those of the moved slots change their shard. Null
    and empty texts have 8 bytes; null ids are ids; rows
    may repeat; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = stored(records(docs, id_col, text_col, slots), "shard-records")
    path = map_path or shared_path(spark, "slot-map")
    if not has_map(spark, path):
        save_map(even_map(spark, shards, slots), path)
    save_map(rebalance_map(load_map(spark, path), slot_sizes(rows), shards), path)
    placed = assign(rows, load_map(spark, path))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", "virtual_slot", F.lit(None).cast("int").alias("grown_shard")
    )
