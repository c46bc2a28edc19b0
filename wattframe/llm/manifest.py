"""A Merkle manifest of a table, and proofs that a recursive query checks.

Every row is a leaf. The leaves of a group, in order, are hashed two by two, level
by level, until one is left; the groups' roots make one more tree of the same
kind. Sixteen levels need no sixteen shuffles: 256 consecutive nodes are a block,
and a block builds its eight levels by itself. The tops of blocks are the nodes of
the next stage.

Built levels are stored as node rows. A row holds a node's way up through one
stage, a step per level (the sibling, and on which side it stands), and the stage
tells the row above it. A Spark recursive query climbs: it starts from every block
of leaves, and a step takes the row of the next stage, appends its siblings to the
proof and folds them into the hash of every leaf of the block. Near the root all
leaves meet the same few nodes, so those rows are laid out once per block of
leaves below them: no key of the climb has more than one row on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pick, stored

#: Nodes of a block, and the levels it spans.
BLOCK, LEVELS = 256, 8

def encoded(column: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*columns: Column) -> Column:
    """SHA-256 of the texts put together, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*columns).cast("binary"), 256))


def digest(node: Column) -> Column:
    return F.lower(F.hex(node))


def positions(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``idx`` (place within its group, from 0) and ``n`` (size of the
    group). Rows are numbered within sorted ranges of all groups, so a group of
    any size is spread; what is summed up per group is a count per range."""
    keys = [group, *order, "at"]
    ranged = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys)
    held = stored(ranged.withColumn("part", F.spark_partition_id()), "manifest-order")
    per = held.groupBy(group, "part").agg(F.count("*").alias("c"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(group).alias("_group"), F.col("part").alias("_part"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(of_group).alias("n"))
    local = F.row_number().over(Window.partitionBy("part", group).orderBy(*order, "at")) - 1
    numbered = held.withColumn("local", local)
    joined = numbered.join(per, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("idx", (F.col("start") + F.col("local")).cast("long")).drop("at", "part", "local", "_part", "_group", "start")


def _depth(n: Column) -> Column:
    """Levels until one node is left of ``n``, eight at most."""
    return F.when(n <= 1, 0).otherwise(F.least(F.lit(LEVELS), F.length(F.bin(n - 1)))).cast("int")


def _levels(nodes: Column, depth: Column) -> Column:
    """The nodes of a block, level by level: ``depth + 1`` lists."""

    def up(below: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)),
            lambda i: hashed(digest(F.get(below, i * 2)), F.coalesce(digest(F.get(below, i * 2 + 1)), F.lit(""))),
        )

    grown = lambda all_, i: F.when(i <= depth, F.concat(all_, F.array(up(F.element_at(all_, -1))))).otherwise(all_)
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), grown)


def _path(levels: Column, place: Column) -> Column:
    """Steps from the node at ``place`` of the lowest level to the top one."""

    def step(nodes: Column, level: Column) -> Column:
        at = F.call_function("shiftright", place, level)
        left = at % 2 == 1
        return F.struct(left.alias("left"), F.get(nodes, F.when(left, at - 1).otherwise(at + 1)).alias("sibling"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _folded(start: Column, path: Column) -> Column:
    """The top that follows from a node and its steps."""
    return F.aggregate(
        path,
        start,
        lambda node, s: F.when(s["sibling"].isNull(), hashed(digest(node)))
        .when(s["left"], hashed(digest(s["sibling"]), digest(node)))
        .otherwise(hashed(digest(node), digest(s["sibling"]))),
    )


def _siblings(path: Column) -> Column:
    """The siblings of a path, one after the other."""
    return F.aggregate(path, F.unhex(F.lit("")), lambda all_, s: F.concat(all_, F.coalesce(s["sibling"], F.unhex(F.lit("")))))


def _blocks(nodes: DataFrame, group: str, more: dict[str, str]) -> DataFrame:
    """``nodes`` (group, ``idx``, ``n``, ``node``) in blocks: ``block``, ``levels``, ``top``,
    ``n``, and a list per column of ``more`` (new name: old name) in the order of
    the nodes. At most ``BLOCK`` rows come together."""
    entry = F.struct("idx", "node", *(F.col(old).alias(new) for new, old in more.items()))
    some = nodes.groupBy(group, F.shiftright("idx", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.first("n").alias("n"))
    some = some.withColumn("levels", _levels(F.col("e.node"), _depth(F.col("n"))))
    return some.select(group, "block", "n", "levels", F.element_at("levels", -1)[0].alias("top"), *(F.col(f"e.{new}").alias(new) for new in more))


def _stages(first: DataFrame, group: str, most: int, name: str) -> list[DataFrame]:
    """Blocks of all stages, from stored blocks of leaves to the last stage, in
    which each group is one block. ``most`` is the size of the largest group."""
    stages = [first]
    while most > BLOCK:
        most = -(-most // BLOCK)
        tops = stages[-1].select(group, F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("node"))
        stages.append(stored(_blocks(tops, group, {}), name))
    return stages


def _ways(blocks: DataFrame, group: str) -> DataFrame:
    """A row per node at the foot of ``blocks``: ``node_idx`` and ``path``."""
    place = F.posexplode(F.element_at("levels", 1)).alias("place", "node")
    each = blocks.select(group, "block", "levels", place)
    return each.select(group, (F.col("block") * BLOCK + F.col("place")).alias("node_idx"), _path(F.col("levels"), F.col("place")).alias("path"))


def _copies(rows: DataFrame, group: str, column: str, count: Column) -> DataFrame:
    """Each row ``BLOCK`` times, for the numbers below ``column`` in the next finer
    stage that are less than ``count``; dealt out anew, since few rows may stand
    for very many."""
    low = F.col(column) * BLOCK
    finer = F.explode(F.sequence(low, F.least(low + BLOCK, count) - 1))
    return rows.withColumn(column, finer).repartition(group, column)


def _sizes(n: Column, stage: int) -> Column:
    """Nodes at the foot of a stage, for a group of ``n`` leaves."""
    for _ in range(stage):
        n = F.ceil(n / BLOCK).cast("long")
    return n


_CLIMB = """
    with recursive climb(grp, block, stage, folded, proof, subroot, root) as (
        select grp, block, 1, folded, unhex(''), cast(null as binary), cast(null as binary) from {start}
        union all
        select c.grp, c.block, c.stage + 1,
               transform(c.folded, f -> aggregate(n.path, f, (node, s) -> unhex(sha2(
                   case when s.sibling is null then lower(hex(node))
                        when s.left then concat(lower(hex(s.sibling)), lower(hex(node)))
                        else concat(lower(hex(node)), lower(hex(s.sibling))) end, 256)))),
               aggregate(n.path, c.proof, (all, s) -> concat(all, coalesce(s.sibling, unhex('')))),
               n.subroot, n.root
        from climb c join {nodes} n on c.grp = n.grp and c.block = n.block and c.stage = n.stage)
    select grp, block, folded, proof, subroot, root from (select * from climb limit all) where stage = {last}"""


def manifest(docs: DataFrame, leaf: list[str], group: str, id_col: str, claimed: dict[str, Column]) -> DataFrame:
    """The tree over ``docs`` and a checked proof of every row.

    A leaf hashes the columns ``leaf``, each as its length and value, ``-`` if null.
    The leaves of one value of ``group`` ascend by ``id_col`` (null first; rows that
    repeat an id by their hash), groups by value, null first. ``claimed`` gives
    columns that are read otherwise when proofs are checked.

    Returns ``doc_id`` and, as 64 hexadecimal digits, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the siblings from leaf to root) and ``folded_root`` (what
    follows from the claimed leaf and the siblings), and ``verified``. A table of
    one row is its own root, with an empty proof; an empty table gives an empty
    one. Other columns are dropped.
    """
    names = list(dict.fromkeys([*leaf, group, id_col]))
    held = pick(docs, **{f"c{i}": c for i, c in enumerate(names)})
    column = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    changed = {c: claimed[c](column) if c in claimed else column[c] for c in leaf}
    node = hashed(*(encoded(column[c]) for c in leaf))
    # Only rows whose claim differs are hashed again.
    differs = F.lit(False)
    for c in claimed:
        differs = differs | ~changed[c].eqNullSafe(column[c])
    claim = F.when(differs, hashed(*(encoded(changed[c]) for c in leaf)))
    rows = stored(held.select(column[id_col].alias("doc_id"), column[group].alias("label"), node.alias("node"), claim.alias("claim")), "manifest-leaves")
    labels = rows.groupBy("label").agg(F.count("*").alias("size")).withColumn("tree", F.lit(0))
    labels = stored(positions(labels, "tree", ["label"]).select("tree", "label", "size", "idx", "n"), "manifest-groups")
    placed = positions(rows, "label", ["doc_id", "node"])
    named = labels.select(F.col("idx").alias("grp"), F.col("label").alias("l"))
    placed = placed.join(named, F.col("label").eqNullSafe(F.col("l"))).select("grp", "idx", "n", "node", "doc_id", "claim")
    first = stored(_blocks(placed, "grp", {"ids": "doc_id", "claims": "claim"}), "manifest-blocks")
    size = labels.agg(F.max("size"), F.max("n")).first()
    if size[0] is None:
        return _empty(rows)
    stages = _stages(first, "grp", size[0], "manifest-stage")
    subroots = stages[-1].select(F.col("grp").alias("g"), F.col("top").alias("node"))
    tree = labels.join(subroots, labels["idx"] == F.col("g")).select("tree", "idx", "n", "node")
    crown = _stages(stored(_blocks(tree, "tree", {}), "manifest-crown"), "tree", size[1], "manifest-crown")
    root = crown[-1].select("tree", F.col("top").alias("root"))

    # The way of each node through a stage, laid out once per block of leaves below.
    count = labels.select(F.col("idx").alias("grp"), _sizes(F.col("size"), 1).alias("blocks"))
    laid, none = [], F.lit(None).cast("binary")
    for k, blocks in enumerate(stages[1:], 1):
        ways = _ways(blocks.select("grp", "block", "levels"), "grp").join(count, "grp")
        for finer in range(k - 1, 0, -1):
            ways = _copies(ways, "grp", "node_idx", _sizes(F.col("blocks"), finer - 1))
        laid.append(ways.select("grp", F.col("node_idx").alias("block"), F.lit(k).alias("stage"), "path", none.alias("subroot"), none.alias("root")))
    way, up = None, F.col("idx")
    for k, blocks in enumerate(crown):
        ways = _ways(blocks.select("tree", "block", "levels"), "tree").select(F.col("node_idx").alias(f"i{k}"), F.col("path").alias(f"path{k}"))
        way = (labels.select("tree", "idx") if way is None else way).join(ways, up == F.col(f"i{k}"))
        up = F.shiftright(up, LEVELS)
    whole = F.concat(*(F.col(f"path{k}") for k in range(len(crown))))
    last = way.withColumn("path", whole).join(root, "tree").join(subroots, F.col("idx") == F.col("g"))
    last = last.select(F.col("idx").alias("grp"), "path", F.col("node").alias("subroot"), "root").join(count, "grp")
    last = last.withColumn("node_idx", F.lit(0).cast("long"))
    for finer in range(len(stages) - 1, 0, -1):
        last = _copies(last, "grp", "node_idx", _sizes(F.col("blocks"), finer - 1))
    top_stage = len(stages)
    laid.append(last.select("grp", F.col("node_idx").alias("block"), F.lit(top_stage).alias("stage"), "path", "subroot", "root"))
    nodes = laid[0]
    for more in laid[1:]:
        nodes = nodes.unionByName(more)
    nodes = stored(nodes, "manifest-nodes")

    # The climb begins at the tops of the leaves' own blocks.
    leaves = F.element_at("levels", 1)
    start = F.transform(
        F.arrays_zip(leaves.alias("node"), F.col("claims").alias("claim")),
        lambda x, i: _folded(F.coalesce(x["claim"], x["node"]), _path(F.col("levels"), i)),
    )
    begun = first.select("grp", "block", start.alias("folded"))
    climbed = docs.sparkSession.sql(_CLIMB, start=begun, nodes=nodes, last=top_stage + 1)
    both = first.select("grp", "block", "levels", "ids").join(climbed, ["grp", "block"])
    each = both.select("levels", "proof", "subroot", "root", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), leaves.alias("node"), F.col("folded").alias("f"))).alias("i", "x"))
    own = _siblings(_path(F.col("levels"), F.col("i")))
    return each.select(
        F.col("x.id").alias("doc_id"),
        digest(F.col("x.node")).alias("leaf"),
        digest(F.col("subroot")).alias("subroot"),
        digest(F.col("root")).alias("root"),
        F.sha2(digest(F.concat(own, F.col("proof"))).cast("binary"), 256).alias("proof_sha256"),
        digest(F.col("x.f")).alias("folded_root"),
        (F.col("x.f") == F.col("root")).alias("verified"),
    )


def _empty(rows: DataFrame) -> DataFrame:
    """No rows, with the columns of a manifest."""
    text = [F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return rows.select("doc_id", *text, F.lit(True).alias("verified"))


def tampered(id_col: str, column: str, every: int = 7):
    """A claim that adds 1 to ``column`` where ``every`` divides the checksum of the
    decimal id. Nulls stay."""

    def claim(columns: dict[str, Column]) -> Column:
        hit = F.coalesce(F.crc32(columns[id_col].cast("string").cast("binary")) % every == 0, F.lit(False))
        return F.when(hit, columns[column] + 1).otherwise(columns[column])

    return {column: claim}


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a table of documents by language, checked against rows of
    which every seventh or so claims another length."""
    leaf = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest(docs, leaf, "lang", "doc_id", tampered("doc_id", "n_chars"))
