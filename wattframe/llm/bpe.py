"""Byte-level BPE: texts to token ids and back.

Each match of the pattern is merged on its own. A segment tree over the byte
positions of a match holds, in every node, the least (pair rank, position) of
the positions below it, so the root names the leftmost pair of least rank. A
merge changes three leaves (the merged position, its right neighbour, which
dies, and its left neighbour) and the nodes above them.

Short matches go through many equal trees at once, as numpy arrays with one row
per match; long ones through one tree each. Both do the same merges. Chunks
between spaces repeat a lot, so each worker keeps the ids of those it met, in a
store of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import pick, released, slices, texts

#: Entries a worker keeps before it starts afresh.
CACHE_ENTRIES = 150_000
_WIDTHS = (4, 8, 16, 32, 64)
_POS_BITS = 7
_NONE = np.int64(1) << 60


class Vocabulary:
    """A rank file (base64 token, rank) and the pattern that cuts texts."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to write a token as two tokens, sorted for lookups.
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_ranks = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(2**62))
        self.pair_values = np.array([pairs[k] for k in keys.tolist()] + [0], np.int64)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def leaf(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Leaf values for pairs of ids; ``_NONE`` where the pair is no token
        or one side is missing (negative id)."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_values[at] << _POS_BITS | pos, _NONE)

    # -- one long match ----------------------------------------------------------------

    def merge_long(self, piece: bytes) -> bytes:
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        none = (1 << 60, 0)
        rank = self.pair_ranks.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := rank(ids[i] << 32 | ids[i + 1])) is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: tuple[int, int]) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        def pair(i: int) -> tuple[int, int]:
            j = after[i]
            r = rank(ids[i] << 32 | ids[j]) if j < n else None
            return none if r is None else (r, i)

        while tree[1] < none:
            r, i = tree[1]
            j = after[i]
            ids[i], after[i] = r, after[j]
            if after[i] < n:
                before[after[i]] = i
            ids[j] = -1
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    # -- many short matches ------------------------------------------------------------

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        rows = np.arange(n)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(at < size[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after = np.where(after >= size[:, None], width, after)
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = self.leaf(ids[:, :width], ids[:, 1:], at)
        k = width // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            tree[r, width + i] = value
            k = (width + i) >> 1
            for _ in range(width.bit_length() - 1):
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                k >>= 1

        while len(rows := rows[tree[rows, 1] < _NONE]):
            root = tree[rows, 1]
            i, rank = root & ((1 << _POS_BITS) - 1), root >> _POS_BITS
            j = after[rows, i]
            nn = after[rows, j]
            ids[rows, i] = rank
            ids[rows, j] = -1
            after[rows, i] = nn
            before[rows, nn] = i
            put(rows, j, np.full(len(rows), _NONE))
            put(rows, i, self.leaf(rank, ids[rows, nn], i))
            p = before[rows, i]
            some = p >= 0
            r, p = rows[some], p[some]
            put(r, p, self.leaf(ids[r, p], rank[some], p))
        live = ids[:, :width] >= 0
        flat = ids[:, :width][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    # -- texts -------------------------------------------------------------------------

    def learn(self, store: dict[str, bytes], pieces: list[str], lead: str = "") -> None:
        """Put the ids of ``lead + piece`` into ``store``. A match that is a token
        is that token."""
        todo: dict[int, tuple[list[str], list[bytes]]] = {}
        ranks = self.ranks
        for piece in pieces:
            raw = (lead + piece).encode()
            if (r := ranks.get(raw)) is not None:
                store[piece] = r.to_bytes(4, "little")
            elif len(raw) > _WIDTHS[-1]:
                store[piece] = self.merge_long(raw)
            else:
                some = todo.setdefault(_WIDTH_OF[len(raw)], ([], []))
                some[0].append(piece)
                some[1].append(raw)
        for width, (names, raws) in todo.items():
            for k in range(0, len(names), 8192):
                store.update(zip(names[k : k + 8192], self.merge_many(raws[k : k + 8192], width)))

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks, pieces = self.chunks, self.pieces
        if len(chunks) > CACHE_ENTRIES:
            chunks.clear()
        if len(pieces) > CACHE_ENTRIES // 8:
            pieces.clear()
        # A space belongs to the match after it, unless more white space follows or
        # the text ends: such texts are cut by the pattern as a whole.
        cut = [None if _SPACES.search(d) else d.split(" ") for d in docs]
        new: set[str] = set()
        for c in cut:
            if c:
                new.update(c[1:])
        new.difference_update(chunks.keys())
        # Letters, then ASCII marks: two matches (or one) whatever the pattern's other
        # branches say, as a match of letters ends where the marks begin.
        words, marked, other = [], [], []
        for c in new:
            if c.isalpha():
                words.append(c)
            elif (w := c.rstrip(_MARKS)).isalpha():
                marked.append((c, w, c[len(w) :]))
            else:
                other.append(c)
        self.learn(chunks, list({*words, *(w for _, w, _ in marked if w not in chunks)}), " ")
        found = [self.pattern.findall(" " + c) for c in other]
        first = [self.pattern.findall(c[0] if c else d) for d, c in zip(docs, cut)]
        unseen = {m for _, _, m in marked if m not in pieces}
        for f in (*found, *first):
            unseen.update(p for p in f if p not in pieces)
        self.learn(pieces, list(unseen))
        piece, chunk = pieces.__getitem__, chunks.__getitem__
        for c, w, m in marked:
            chunks[c] = chunks[w] + pieces[m]
        for c, f in zip(other, found):
            chunks[c] = b"".join(map(piece, f))
        return [b"".join([*map(piece, f), *(map(chunk, c[1:]) if c else ())]) for f, c in zip(first, cut)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SPACES = re.compile(r" (?:\s|\Z)")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WIDTH_OF = {n: next(w for w in _WIDTHS if n <= w) for n in range(1, _WIDTHS[-1] + 1)}


@lru_cache(maxsize=4)
def vocabulary(rank_file: str, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: the id column, and ``ids`` (binary, little-endian
    unsigned 32-bit integers).

    A null text counts as empty and gives no ids. Repeated rows stay, other
    columns are dropped, and an empty table gives an empty one. The rank file
    has to be at ``rank_file`` on every executor.
    """
    out = pick(docs, id=id_col, text=text_col)
    schema = out.select("id", F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(vocab.encode(texts(part, "text")), pa.binary())], ["id", "ids"])

    return out.mapInArrow(run, schema).toDF(id_col, "ids")


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded``, with ``decoded`` (binary, the bytes the ids
    stand for) in place of any column of that name. Null ids give null; an id
    outside the vocabulary is an error."""
    names = [c for c in encoded.columns if c != "decoded"]
    out = pick(encoded, **{f"c{i}": c for i, c in enumerate(names)})
    at = names.index(ids_col)
    schema = out.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                raw = [None if ids is None else vocab.decode(ids) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return out.mapInArrow(run, schema).toDF(*names, "decoded")


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both: ``doc_id``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256``. One worker does it all, and only digests leave it."""
    out = pick(docs, id=id_col, text=text_col)
    schema = out.select("id", F.lit(0).cast("long").alias("n"), F.lit("").alias("a"), F.lit("").alias("b")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file, pattern)
        with released():
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = vocab.encode(texts(part, "text"))
                    size = pa.array([len(x) // 4 for x in ids], pa.int64())
                    of_ids = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                    of_text = pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("id"), size, of_ids, of_text], ["id", "n", "a", "b"])

    return out.mapInArrow(run, schema).toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
