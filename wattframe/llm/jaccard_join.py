"""Documents whose word shingles overlap: an exact Jaccard join by prefix filters
under several global orders.

If two sets have a Jaccard similarity of t or more, then under any one order of
all shingles the first ``n - ceil(t * n) + k`` shingles of each hold at least k
common ones. That holds for every order at once, so each is a filter, and a
pair has to pass all of them before it is verified:

* Order 1 ranks shingles by hash. It needs no counts, and with k in proportion
  to the set it drops every document of whose prefix too little occurs anywhere
  else. Only the documents left are looked at further.
* Order 2 ranks rare shingles first, by their number of documents among those
  left. Its prefixes are the posting lists that propose pairs. Passages that
  many documents share come last, so they propose none.
* Order 3 ranks by another hash. A proposed pair that shares nothing in these
  prefixes, nor in those of order 1, is not verified.

Sets that are equal are one node. Proposals are worked off by stars: each
posting list links its nodes to one of them, and what is verified becomes one
component. Then each node is held against a few nodes of its lists that lie in
other components, other ones each time, and the nearest by parity bits (a lower
bound of the difference of two sets) is verified, as long as the lists are large
and that finds many links. Last, all pairs of a list that still lie in different
components are verified, but for those whose parity bits rule them out. So no link
between different texts is lost, and a group of thousands of near copies costs
verifications in proportion to its size, also if each of them links with a few of
the others only.

Counting shingles sends packed arrays, one row per batch and bucket, in which a
batch names each shingle once: a shingle of a third of all documents costs its
bucket one entry per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import by_rows, pick, released, slices, stored, texts
from .components import components

SHINGLE = 5
PERCENT = 80
#: Bytes of text whose prefix sums are held at a time (or one longer text).
PIECE_BYTES = 1 << 20
#: Bytes of text whose sets are held and looked up together (or one longer text).
SLICE_BYTES = 2 << 20
#: Nodes of a list, at most, that its others are held against in a round of stars.
HUBS = 16
#: Pairs left in the lists, as a multiple of their entries, that are few.
FEW = 4
#: A round finds many links if one in so many of the nodes left is in one.
MANY = 20
#: Columns of a set's parity bits.
_BITS = tuple(f"b{i}" for i in range(8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _word_sums(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash (not mixed yet) and length of each word in lower-case bytes."""
    space = np.concatenate([[True], _SPACE[joined], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    # Hash of a word: difference of prefix sums, moved to position 0.
    up, down = _powers(1 << max(16, int(len(joined) + 1).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=np.uint64)])
    return starts, (total[ends] - total[starts]) * down[starts], (ends - starts).astype(np.uint64)


def _grams(word: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(word) - width + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(width):
        gram += word[k : k + n] * _U(pow(_BASE, 2 * k + 3, 1 << 64))
    return _mix(gram)


def _short(word: np.ndarray) -> np.ndarray:
    """The one shingle of a text with too few words."""
    if not len(word):
        return np.zeros(0, np.uint64)
    total = sum((int(w) * pow(_BASE, 2 * k + 3, 1 << 64) for k, w in enumerate(word)), len(word))
    return _mix(np.array([total & (2**64 - 1)], np.uint64))


def _long_set(raw: bytes, width: int) -> np.ndarray:
    """The shingles of one long text, part by part: the last words of a part, and
    a word that it cuts, are carried into the next one."""
    tail, found = np.zeros(0, np.uint64), []
    cut_sum, cut_size = _U(0), 0
    for at in range(0, len(raw), PIECE_BYTES):
        joined = _LOWER[np.frombuffer(raw, np.uint8, min(PIECE_BYTES, len(raw) - at), at)]
        starts, sums, sizes = _word_sums(joined)
        if cut_size:
            if len(starts) and starts[0] == 0:
                sums[:1] = cut_sum + sums[:1] * _U(pow(_BASE, cut_size, 1 << 64))
                sizes[:1] += _U(cut_size)
            else:
                sums, sizes = np.append(cut_sum, sums), np.append(_U(cut_size), sizes)
            cut_size = 0
        if at + PIECE_BYTES < len(raw) and len(sums) and not _SPACE[joined[-1]]:
            cut_sum, cut_size = sums[-1], int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        tail = np.concatenate([tail, _mix(sums + sizes)])
        if len(tail) >= width:
            found.append(np.unique(_grams(tail, width)))
            tail = tail[len(tail) - width + 1 :]
    return np.unique(np.concatenate(found)) if found else _short(tail)


def shingle_sets(docs: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each text as sorted 64-bit hashes.

    Words are runs without ASCII white space, A-Z in lower case. A text with
    fewer words is one shingle; one without words has none. Prefix sums are held
    for ``PIECE_BYTES`` of text at a time, whatever the length of a text.
    """
    out, some, size = [], [], 0
    for d in docs:
        raw = d.encode()
        if size + len(raw) > PIECE_BYTES:
            out += _sets_of(some, width)
            some, size = [], 0
        if len(raw) > PIECE_BYTES:
            out.append(_long_set(raw, width))
        else:
            some.append(raw)
            size += len(raw) + 1
    return out + _sets_of(some, width)


def _sets_of(raw: list[bytes], width: int) -> list[np.ndarray]:
    if not raw:
        return []
    starts, sums, sizes = _word_sums(_LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)])
    word = _mix(sums + sizes)
    gram = _grams(word, width)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)])).tolist()
    return [np.unique(gram[a : b - width + 1]) if b - a >= width else _short(word[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _need(n, percent: int):
    """Least overlap that a set of ``n`` shingles needs with a partner."""
    return -(-percent * n // 100)


def _extra(n):
    """k of order 1."""
    return 1 + n // 10


def _packed(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and 32-bit name within it of each token, and the order that sorts
    by bucket. Tokens that share both count as one, which only makes filters
    less sharp."""
    bucket = ((tokens & _U(0xFFFF)) * _U(buckets) >> _U(16)).astype(np.int64)
    return bucket, ((tokens >> _U(16)) & _U(0xFFFFFFFF)).astype(np.uint32), np.argsort(bucket, kind="stable")


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, int)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield int(bucket[a]), a, b


# -- order 1: what does not occur elsewhere ------------------------------------------

_SCAN = "kind int, uid long, id {id}, n int, floor int, near int, sig binary, bucket int, names binary, owners binary"


def _scan(docs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """One row per document (kind 0: number of shingles, how many of its order 1
    prefix have to occur elsewhere, how many do so in its own batch, and what
    its set is), and packed rows (kind 1) of the prefixes' other shingles."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = _SCAN.format(id=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        out = None
        for batch in batches:
            out = out or pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("id", batch.schema.field("id").type), ("n", pa.int32()), ("floor", pa.int32()), ("near", pa.int32()), ("sig", pa.binary()), ("bucket", pa.int32()), ("names", pa.binary()), ("owners", pa.binary())])
            for piece in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(texts(piece, "text"))
                base = part << 40 | seen
                seen += len(sets)
                sizes = [len(s) for s in sets]
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                heads = [s[: min(len(s), len(s) - _need(len(s), percent) + _extra(len(s)))] for s in sets]
                tokens = np.concatenate(heads)
                owner = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                new = np.ones(len(tokens), bool)
                new[1:] = tokens[1:] != tokens[:-1]
                group = np.cumsum(new) - 1
                size = np.bincount(group, minlength=1)
                several = size[group] > 1 if len(group) else np.zeros(0, bool)
                near = np.bincount(owner[several], minlength=len(sets))
                floor = [_extra(_need(n, percent)) if n else 0 for n in sizes]
                k = len(sets)
                none = pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array(range(base, base + k), pa.int64()), piece.column("id"), pa.array(sizes, pa.int32()), pa.array(floor, pa.int32()), pa.array(near, pa.int32()), pa.array(sigs, pa.binary()), *none], schema=out)
                # Each shingle once; owner -1 says that the batch has it several times.
                tokens, owner = tokens[new], np.where(several, -1, owner)[new].astype("<i4")
                bucket, names, order = _packed(tokens, buckets)
                bucket, names, owner = bucket[order], names[order], owner[order]
                cuts = list(_cut(bucket))
                k = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array([base] * k, pa.int64()), pa.nulls(k, out.field("id").type), *(pa.nulls(k, pa.int32()) for _ in range(3)), pa.nulls(k, pa.binary()), pa.array([c[0] for c in cuts], pa.int32()), pa.array([names[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([owner[a:b].tobytes() for _, a, b in cuts], pa.binary())], schema=out)

    return docs.mapInArrow(run, schema)


def _elsewhere(packed: DataFrame) -> DataFrame:
    """``uid`` and how many of its shingles in a bucket other batches have too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["names"]])
        owner = np.concatenate([np.where((o := np.frombuffer(x, "<i4").astype(np.int64)) < 0, -1, o + base) for x, base in zip(pdf["owners"], pdf["uid"])])
        _, at, count = np.unique(names, return_inverse=True, return_counts=True)
        uid, n = np.unique(owner[(count[at] > 1) & (owner >= 0)], return_counts=True)
        return pd.DataFrame({"uid": uid, "far": n})

    return packed.groupBy("bucket").applyInPandas(run, "uid long, far long").groupBy("uid").agg(F.sum("far").alias("far"))


# -- order 2: rare shingles first ----------------------------------------------------


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of ``nodes`` (``node``, ``id``, ``sig``), with the batch each was
    made in: batches of a bounded number of bytes."""
    joined = docs.alias("d").join(nodes.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id"))).select("node", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            yield from made(batches)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(texts(piece, "text"))
                # Another text under the same id is not the node's.
                own = [i for i, (s, sig) in enumerate(zip(sets, piece.column("sig").to_pylist())) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == sig]
                node = piece.column("node").to_pylist()
                k, seen = len(own), seen + 1
                bits = _parities([sets[i] for i in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | seen] * k, pa.int64()), pa.array([node[i] for i in own], pa.int64()), pa.array([len(sets[i]) for i in own], pa.int32()), pa.array([sets[i].tobytes() for i in own], pa.binary()), *(pa.array(b, pa.int64()) for b in bits.T)],
                    ["batch", "node", "n", "tokens", *_BITS],
                )

    return joined.mapInArrow(run, "batch long, node long, n int, tokens binary, " + ", ".join(f"{b} long" for b in _BITS))


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits in each of ``_BITS`` per set: whether an odd number of its shingles
    falls on the bit. Two sets differ in as many shingles as bits, at least."""
    size = 64 * len(_BITS)
    odd = np.zeros((len(sets), size), np.uint8)
    for row, s in zip(odd, sets):
        row[:] = np.bincount((s >> _U(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _prefixes(sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``token``, ``node``, ``n``, ``at`` (its place in the node's order 2) for the
    shingles of the order 2 prefixes that several nodes have."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, count = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]]), return_counts=True)
        bucket, names, order = _packed(tokens, buckets)
        bucket, names, count = bucket[order], names[order], count[order].astype("<i4")
        cuts = list(_cut(bucket))
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "bucket": [c[0] for c in cuts], "names": [names[a:b].tobytes() for _, a, b in cuts], "counts": [count[a:b].tobytes() for _, a, b in cuts]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(x, np.uint32) for x in pdf["names"]]
        flat, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([np.frombuffer(x, "<i4") for x in pdf["counts"]]), minlength=len(flat)).astype("<i8")
        ends = np.cumsum([0, *map(len, names)])
        rows = []
        for batch, bucket, own, a, b in zip(pdf["batch"], pdf["bucket"], names, ends[:-1], ends[1:]):
            count = total[at[a:b]]
            more = count > 1
            if more.any():
                rows.append((batch, bucket, own[more].tobytes(), count[more].tobytes()))
        return pd.DataFrame(rows, columns=["batch", "bucket", "names", "counts"])

    def rank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = [(_U(bucket) << _U(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for bucket, x in zip(right["bucket"], right["names"])]
        known = np.concatenate([*known, np.array([2**64 - 1], np.uint64)])
        count = np.concatenate([*(np.frombuffer(x, "<i8") for x in right["counts"]), np.array([1])])
        order = np.argsort(known)
        known, count = known[order], count[order]
        token, node, size, place = [], [], [], []
        for me, n, raw in zip(left["node"], left["n"], left["tokens"]):
            bucket, name, _ = _packed(np.frombuffer(raw, np.uint64), buckets)
            name = bucket.astype(np.uint64) << _U(32) | name
            i = np.searchsorted(known, name)
            often = np.where(known[i] == name, count[i], 1)
            head = n - _need(n, percent) + 1
            single = int((often == 1).sum())
            if single >= head:
                continue
            name, often = name[often > 1], often[often > 1]
            first = np.lexsort((_mix(name), often))[: head - single]
            token.append(name[first].astype(np.int64))
            node.append(np.full(len(first), me))
            size.append(np.full(len(first), n))
            place.append(np.arange(single, single + len(first)))
        if not token:
            return pd.DataFrame({"token": [], "node": [], "n": [], "at": []}).astype("int64")
        return pd.DataFrame({"token": np.concatenate(token), "node": np.concatenate(node), "n": np.concatenate(size), "at": np.concatenate(place)})

    asked = sets.groupBy("batch").applyInPandas(ask, "batch long, bucket int, names binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "batch long, bucket int, names binary, counts binary")
    return sets.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(rank, "token long, node long, n int, at int")


# -- verification --------------------------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` that are similar enough. Sets travel to their pairs
    once each way; the other orders are asked first."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        if len(small) * 100 < percent * len(large):
            return False
        p, q = len(x) - _need(len(x), percent) + 1, len(y) - _need(len(y), percent) + 1
        if not len(np.intersect1d(x[:p], y[:q], assume_unique=True)):  # order 1
            return False
        u, v = _mix(x ^ _U(_BASE)), _mix(y ^ _U(_BASE))  # order 3
        u, v = (u, v) if p >= len(u) or q >= len(v) else (np.partition(u, p)[:p], np.partition(v, q)[:q])
        if not len(np.intersect1d(u, v, assume_unique=True)):
            return False
        i = np.minimum(np.searchsorted(large, small), len(large) - 1)
        common = int((large[i] == small).sum())
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _possible(percent: int, left: str, right: str) -> str:
    """Size and place filter for two posting entries: their sizes fit, the shared
    shingle lies in the shorter prefix that the smaller of two sets needs, and
    after it enough may still come."""
    low, high = f"least({left}.n, {right}.n)", f"greatest({left}.n, {right}.n)"
    overlap = f"(least({left}.at, {right}.at) + least({left}.n - {left}.at, {right}.n - {right}.at))"
    # The first shared shingle of a pair is within n - 2t / (1 + t) n of the smaller.
    short = " and ".join(
        f"({a}.n > {b}.n or {a}.at * {100 + percent} <= {a}.n * {100 - percent})" for a, b in ((left, right), (right, left))
    )
    return f"100 * {low} >= {percent} * {high} and {short} and 100 * {overlap} >= {percent} * ({left}.n + {right}.n - {overlap})"


def _differ(left: str, right: str) -> str:
    """How many shingles two sets differ in, at least."""
    return "(" + " + ".join(f"bit_count({left}.{b} ^ {right}.{b})" for b in _BITS) + ")"


def _near(percent: int, left: str, right: str) -> str:
    """``_possible``, and the parity bits do not rule it out."""
    return f"{_possible(percent, left, right)} and {_differ(left, right)} * {100 + percent} <= {100 - percent} * ({left}.n + {right}.n)"


def _links(lists: DataFrame, sets: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """``node`` and ``component`` of the nodes that link with others."""
    tried = lists.sparkSession.createDataFrame([], "a long, b long")
    size, group, step, last, nodes = lists.count(), None, 0, star_rounds == 0, 0
    while True:
        entries = lists.withColumn("component", F.col("node"))
        if group is not None:
            entries = lists.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if step or last:
            some = stored(by_rows(_open(entries, sets), size), "open-lists")
            held, left, nodes = _left(some, size)
            last = last or left <= FEW * size
        if last:
            found = _across(some, percent)
        else:
            found = _nearest(some, percent, step, held) if step else _stars(by_rows(entries, size), percent, size)
        # Once either way round: each order of the nodes has other hubs.
        found = found.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).dropDuplicates(["lo", "hi"])
        known = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        pairs = stored(by_rows(found.join(known, ["lo", "hi"], "left_anti").select("a", "b"), size), "pairs")
        new = stored(_verified(pairs, sets, percent), "verified")
        tried = tried.unionByName(pairs)
        fresh = new.count()
        if fresh or group is None:
            base = new if group is None else new.unionByName(group.select(F.col("node").alias("a"), F.col("component").alias("b")))
            group = stored(components(base), "grouped")
        if last:
            return group
        # Stars go on as long as they find links, and later on many links.
        step += 1
        last = step > 1 and not fresh or step >= star_rounds and fresh * MANY <= nodes


def _stars(entries: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs of each list's first node with its others, each of which is a
    component: a node keeps the partner that most lists name."""
    entries = entries.select("token", F.struct(F.xxhash64(F.lit(0), "node").alias("by"), "node", "n", "at").alias("e"))
    hubs = entries.groupBy("token").agg(F.min("e").alias("h"))
    found = entries.join(hubs.hint("merge"), "token").where("e.node != h.node").where(_possible(percent, "e", "h"))
    found = by_rows(found.select(F.col("h.node").alias("a"), F.col("e.node").alias("b")), size)
    counted = by_rows(found.groupBy("a", "b").agg(F.count("*").alias("c")), size)
    best = counted.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m"))
    return by_rows(best.select((-F.col("m.a")).alias("a"), "b"), size)


def _open(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """The entries, with their parity bits, of lists with several components."""
    mixed = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    return entries.join(mixed, "token", "left_semi").join(sets.select("node", *_BITS).hint("merge"), "node")


def _left(some: DataFrame, size: int) -> tuple[int, float, int]:
    """Entries, pairs in a list that lie in different components, and nodes."""
    parts = by_rows(some.groupBy("token", "component").agg(F.count("*").cast("double").alias("c")), size)
    whole = parts.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.expr("c * c")).alias("own"))
    held, left = by_rows(whole, size).agg(F.sum("c"), F.sum(F.expr("(c * c - own) / 2"))).first()
    return int(held or 0), left or 0.0, by_rows(some.select("node").distinct(), size).count()


def _nearest(some: DataFrame, percent: int, step: int, held: int) -> DataFrame:
    """Of the first nodes by each of ``HUBS`` parts of a list, in another order in
    each step, the one in another component that is nearest to a node."""
    part = F.pmod(F.xxhash64(F.lit(-step), "node"), F.lit(HUBS)).alias("part")
    first = F.struct(F.xxhash64(F.lit(step), "node").alias("by"), "node", "n", "at", "component", *_BITS)
    hubs = by_rows(some.groupBy("token", part).agg(F.min(first).alias("h")).select("token", "h.*"), held)
    pairs = some.alias("e").join(hubs.alias("h").hint("merge"), F.expr(f"e.token = h.token and e.component != h.component and {_near(percent, 'e', 'h')}"))
    nearest = F.struct(F.expr(_differ("e", "h")).alias("d"), F.col("h.node").alias("a"))
    pairs = by_rows(pairs.select(F.col("e.node").alias("b"), nearest.alias("m")), HUBS * held)
    return by_rows(pairs.groupBy("b").agg(F.min("m").alias("m")).select("m.a", "b"), held)


def _across(some: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list's nodes that lie in different components and may be
    similar: of those whose parity bits differ too often, none is."""
    x, y = some.alias("x"), some.alias("y")
    apart = "x.token = y.token and x.node < y.node and x.component != y.component and "
    return x.join(y, F.expr(apart + _near(percent, "x", "y"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, star_rounds: int = 3, buckets: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``
    (least id it reaches by links, its own included), ``set_id`` (the same for
    rows of equal sets, null for empty ones) and ``uid`` (a number of the row).

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of
    5-word shingles. Null and empty texts, and those of white space, have no
    shingles and link with nothing. Rows that repeat an id are rows of their
    own. A null id is never least while another is there. An empty table gives
    an empty one.
    """
    if buckets is None:
        buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = pick(docs, id=id_col, text=text_col)
    scan = stored(_scan(named, min(buckets, 1 << 16), percent), "shingle-scan")
    rows = scan.where("kind = 0").select("uid", "id", "n", "floor", "near", "sig")
    far = _elsewhere(scan.where("kind = 1").select("uid", "bucket", "names", "owners"))
    # A set is a node named by its least row.
    classes = rows.where("n > 0").groupBy("sig").agg(F.min(F.struct("uid", "id")).alias("r"), F.min("id").alias("least"))
    classes = classes.select("sig", F.col("r.uid").alias("node"), F.col("r.id").alias("id"), "least")
    left = rows.where("n > 0").join(far, "uid", "left").where("near + coalesce(far, 0) >= floor").select(F.col("uid").alias("node"))
    nodes = stored(classes.join(left, "node", "left_semi").select("node", "id", "sig"), "nodes")
    sets = stored(_sets(named, nodes), "sets")
    lists = stored(_prefixes(sets, min(buckets, 1 << 16), percent), "posting-lists")
    group = _links(lists, sets, percent, star_rounds)
    named_nodes = classes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named_nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named_nodes.join(lowest, "component").select("sig", "component_id", F.col("node").alias("set_id"))
    out = rows.join(of_set, "sig", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "set_id", "uid"
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one with
    the least id stays, and each row without shingles. Rows that repeat an id
    share its fate, so ids should be unique here."""
    found = similar_documents(docs, id_col, text_col)
    stay = found.where("n_shingles = 0 or doc_id <=> component_id").select("doc_id").distinct()
    names = docs.columns
    held = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return held.join(stay, F.col(f"_{names.index(id_col)}").eqNullSafe(F.col("doc_id")), "left_semi").toDF(*names)
