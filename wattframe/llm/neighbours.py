"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a set of pivots, nearest
first, cut after ``length``. It is posted in the inverted files of its first
``posted`` pivots. A query reads the files of its first ``visited`` pivots; in
each it ranks what it finds by the footrule distance of the two orders, and the
best ``rerank`` of a file are ranked anew by the exact inner product. A vector
that several of these files hold is looked at in the first of them only.

For the largest inner product, vectors get one more component that gives all of
them the same norm; a query has 0 there. Then the nearest is the one with the
largest inner product, and orders of pivots mean the same for both.

The effort grows with the index: a query's files hold a smaller part of a larger
table, so ``visited`` and ``rerank`` follow from the number of pivots. What the
search then finds for a sample of queries is held against an exact search, and
the effort doubles, up to the whole table, until the recall is safe.

Equal vectors are one entry of the index and one query, whatever their number.
Files of many entries or readers are cut into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pick, stored

#: Rows of one part of an inverted file, and readers that meet it in one task.
PART_ROWS = 4096
#: Queries that an exact search takes at once.
EXACT_QUERIES = 2048
#: Queries that recall is measured on, and standard errors that it must lie above what is asked for.
SAMPLE, ERRORS = 256, 3.0
#: ``visited`` and ``rerank`` for an index of 100 pivots, that is of 10,000 vectors.
VISITED, RERANK = 32, 300


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part: with an
    id, no null or non-finite component, not zero, and as long as most vectors
    are (the shorter of two equally frequent lengths). Repeated rows count once."""
    some = pick(vectors, id=id_col, vector=vector_col).where("id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = some.where(fine & F.exists("vector", lambda x: x != 0))
    sizes = some.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    return some.where(F.size("vector") == dim)


def _matrix(column) -> np.ndarray:
    """Vectors of a pandas column, or of an Arrow list column, as rows of doubles."""
    if isinstance(column, pa.Array):
        flat = np.asarray(column.flatten(), float)
        return flat.reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(float)


def _orders(classes: DataFrame, pivots: np.ndarray, norm2: float, length: int, query: bool) -> DataFrame:
    """``classes`` with ``order``: the numbers of the nearest ``length`` pivots.
    ``pivots`` have the additional component."""
    at = classes.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at)) if batch.num_rows else np.zeros((0, pivots.shape[1] - 1))
            near = x @ pivots[:, :-1].T
            if not query:
                near += np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))[:, None] * pivots[:, -1]
            order = np.argsort(-near, axis=1, kind="stable")[:, :length]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "order"])

    return classes.mapInArrow(run, classes.withColumn("order", F.lit(None).cast("array<int>")).schema)


def _top(score: np.ndarray, rep: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` largest scores, ties to the smaller ``rep``."""
    if len(score) > keep:
        edge = np.partition(score, len(score) - keep)[len(score) - keep]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((rep[some], -score[some]))[:keep]]


def _search(entries: DataFrame, readers: DataFrame, n_pivots: int, posted: int, visited: int, rerank: int, keep: int) -> DataFrame:
    """``quid`` and packed ``uids``, ``reps``, ``scores`` of the best of each file."""
    depth = lambda n: F.slice("order", 1, n)
    listed = entries.withColumn("pivot", F.explode(depth(posted)))
    reading = readers.select(F.col("uid").alias("quid"), "vector", "order", F.posexplode(depth(visited)).alias("turn", "pivot"))
    # At most a row per pivot each, and their number is bounded.
    parts = lambda t, name: t.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias(name))
    cut = parts(listed, "xs").join(parts(reading, "qs"), "pivot")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = listed.join(F.broadcast(cut), "pivot").withColumn("x", part("uid", "xs")).withColumn("q", every("qs")).drop("xs", "qs")
    right = reading.join(F.broadcast(cut), "pivot").withColumn("q", part("quid", "qs")).withColumn("x", every("xs")).drop("xs", "qs")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"quid": [], "uids": [], "reps": [], "scores": []})
        x, order = _matrix(left["vector"]), np.stack(left["order"].to_numpy())
        uid, rep = left["uid"].to_numpy(), left["rep"].to_numpy()
        length = order.shape[1]
        # Place of each pivot in each entry's order, ``length`` where it is cut off.
        kind = np.uint8 if length < 256 else np.uint16
        place = np.full((n_pivots, len(x)), length, kind)
        place[order.T, np.arange(len(x))] = np.arange(length, dtype=kind)[:, None]
        depth = np.arange(length, dtype=kind)[:, None]
        files = order[:, :posted]
        turns = np.empty(n_pivots, np.int32)
        rows = []
        for quid, vector, own, turn in zip(right["quid"], right["vector"], right["order"], right["turn"]):
            turns[:] = length
            turns[own] = np.arange(length)
            at = np.flatnonzero(turns[files].min(1) == turn)  # not in a file read before
            if len(at) > rerank:
                # Footrule, less what is the same for all: the more of the order is
                # shared, and the earlier, the nearer.
                shared = (length - np.maximum(place[own][:, at], depth)).sum(0, dtype=np.int32)
                at = at[np.argpartition(-shared, rerank)[:rerank]]
            score = x[at] @ np.asarray(vector, float)
            best = _top(score, rep[at], keep)
            if len(best):
                rows.append((quid, uid[at][best].astype("<i8").tobytes(), rep[at][best].astype("<i8").tobytes(), score[best].astype("<f8").tobytes()))
        return pd.DataFrame(rows, columns=["quid", "uids", "reps", "scores"])

    keys = ["pivot", "x", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, _PACKED)


_PACKED = "quid long, uids binary, reps binary, scores binary"


def _exact(classes: DataFrame, short: DataFrame, keep: int) -> DataFrame:
    """The same for the queries ``short`` (``quid``, ``vector``) against every class,
    a bounded number of queries at a time."""
    found = classes.sparkSession.createDataFrame([], _PACKED)
    chunks = -(-short.count() // EXACT_QUERIES)
    for c in range(chunks):
        some = short.where(F.pmod(F.xxhash64("quid"), F.lit(chunks)) == c).collect()
        quids, vectors = [r["quid"] for r in some], np.array([r["vector"] for r in some], float)

        def run(batches: Iterator[pa.RecordBatch], quids=quids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not quids:
                    continue
                uid, rep = (np.asarray(batch.column(batch.schema.get_field_index(k))) for k in ("uid", "rep"))
                scores = vectors @ _matrix(batch.column(batch.schema.get_field_index("vector"))).T
                best = [_top(s, rep, keep) for s in scores]
                pack = lambda parts, kind: pa.array([np.asarray(p).astype(kind).tobytes() for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(quids, pa.int64()), pack([uid[b] for b in best], "<i8"), pack([rep[b] for b in best], "<i8"), pack([s[b] for s, b in zip(scores, best)], "<f8")],
                    ["quid", "uids", "reps", "scores"],
                )

        found = found.unionByName(classes.select("uid", "rep", "vector").mapInArrow(run, _PACKED))
    return found


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """``quid``, ``uid``, ``score``: the best ``keep`` classes of each query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uid, rep = (np.concatenate([np.frombuffer(x, "<i8") for x in pdf[k]]) for k in ("uids", "reps"))
        score = np.concatenate([np.frombuffer(x, "<f8") for x in pdf["scores"]])
        best = _top(score, rep, keep)
        return pd.DataFrame({"quid": pdf["quid"].iloc[0], "uid": uid[best], "score": score[best]})

    return found.groupBy("quid").applyInPandas(run, "quid long, uid long, score double")


def effort(pivots: int) -> tuple[int, int]:
    """``visited`` and ``rerank`` that an index of so many pivots begins with."""
    grown = max(1.0, np.sqrt(pivots / 100))
    return min(pivots, round(VISITED * grown)), round(RERANK * grown)


def _recall(truth: dict[int, set[int]], found: DataFrame, whole: bool) -> tuple[float, float]:
    """Mean share of the nearest classes in ``truth`` that ``found`` has, over the
    queries that are in both, and its standard error (0 if these are all queries)."""
    quids = found.sparkSession.createDataFrame([(q,) for q in truth], "quid long")
    hits: dict[int, int] = {}
    # Bounded: ``SAMPLE`` queries.
    for r in found.join(F.broadcast(quids), "quid").select("quid", "uid").collect():
        hits[r["quid"]] = hits.get(r["quid"], 0) + (r["uid"] in truth[r["quid"]])
    share = np.array([hits[q] / len(truth[q]) for q in hits if truth[q]])
    if not len(share):
        return 1.0, 0.0
    return float(share.mean()), 0.0 if whole else float(share.std() / np.sqrt(len(share)))


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
    length: int | None = None,
    posted: int = 8,
    visited: int | None = None,
    rerank: int | None = None,
    least_recall: float = 0.9,
) -> DataFrame:
    """The ``k`` nearest rows, by inner product, that the index finds for each row
    whose id is divisible by ``every``: ``query_id``, ``rank`` from 1, ``vec_id``,
    ``score``. A row is not its own neighbour. Ties go to the smaller id.

    Pivots are the vectors that come first by a hash: by default as many as the
    root of the number of distinct vectors, between 32 and 2048. ``visited`` and
    ``rerank`` are what ``effort`` says, or the caller; they double until the recall
    on a sample of queries is ``ERRORS`` standard errors above ``least_recall`` (0: no
    measuring), at last to an exact search. ``length`` is at least ``visited``, by
    default half as much again. A query for which
    the files hold fewer than ``k`` candidates is answered by an exact search, so
    each gets ``k`` neighbours, or all there are. Rows that ``usable`` leaves out
    take no part; a repeated row counts once; an empty table gives an empty one.
    """
    keep = k + 1  # one of them may be the query itself
    rows = usable(vectors, id_col, vector_col).distinct()
    # Of equal vectors, the ``keep`` smallest ids are all that can be among the best.
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("i") <= keep)
    classes = numbered.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("uid"), F.col("ids")[0].alias("rep"), "ids", "vector"), "vector-classes")
    queries = stored(rows.where(F.col("id") % every == 0).join(classes.select("uid", "vector"), "vector").select("id", F.col("uid").alias("quid")), "vector-queries")
    asked = classes.join(queries.select(F.col("quid").alias("uid")).distinct(), "uid", "left_semi")
    size, norm2 = classes.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    total = rows.select("id").distinct().count()
    number = pivots or int(np.clip(round(np.sqrt(size)), 32, 2048))
    # Bounded: ``number`` vectors.
    raw = np.array([r["vector"] for r in classes.orderBy(F.xxhash64("vector"), "uid").limit(number).select("vector").collect()], float)
    if not size:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    more = np.sqrt(np.maximum(norm2 - (raw * raw).sum(1), 0))
    table = np.column_stack([raw, more])
    begin = effort(len(table))
    visited, rerank = visited or begin[0], rerank or begin[1]
    truth: dict[int, set[int]] | None = None
    while True:
        visited = min(visited, len(table))
        deep = min(max(visited, length or visited * 3 // 2), len(table))
        entries = stored(_orders(classes.select("uid", "rep", "vector"), table, norm2, deep, query=False), "vector-orders")
        readers = _orders(asked.select("uid", "vector"), table, norm2, deep, query=True)
        found = stored(_merged(_search(entries, readers, len(table), min(posted, deep), visited, rerank, keep), keep), "vector-found")
        enough = found.join(classes.select("uid", F.size("ids").alias("members")), "uid").groupBy("quid").agg(F.sum("members").alias("members"))
        enough = enough.where(F.col("members") >= min(keep, total)).select("quid")
        if not least_recall or (visited == len(table) and rerank >= size):
            break  # every entry has been looked at, or nobody asks
        if truth is None:
            some = asked.select(F.col("uid").alias("quid"), "vector").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE)
            some = stored(some, "vector-sample")
            truth = {r["quid"]: set() for r in some.select("quid").collect()}
            for r in _merged(_exact(classes, some, keep), keep).where("quid <> uid").collect():
                truth[r["quid"]].add(r["uid"])
        # The others, with too few candidates, are answered by the exact search.
        mean, error = _recall(truth, found.join(enough, "quid", "left_semi"), len(truth) < SAMPLE)
        if mean - ERRORS * error >= least_recall:
            break
        visited, rerank = 2 * visited, 2 * rerank
        if visited >= len(table):
            visited, rerank = len(table), size
    short = asked.select(F.col("uid").alias("quid"), "vector").join(enough, "quid", "left_anti")
    rest = _merged(_exact(classes, short, keep), keep)
    found = found.join(enough, "quid", "left_semi").unionByName(rest)
    # Members of the best classes, the best ``keep`` ids for each query vector.
    members = found.join(classes.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("vec_id"))
    best = members.groupBy("quid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, keep).alias("best"))
    own = queries.join(best, "quid").withColumn("best", F.slice(F.filter("best", lambda e: e["vec_id"] != F.col("id")), 1, k))
    return own.select(F.col("id").alias("query_id"), F.posexplode("best").alias("i", "e")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score")
    )
