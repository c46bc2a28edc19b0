"""Merkle manifests: against hashing in plain Python."""

import hashlib
import random
import zlib

import pytest

from wattframe.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, block int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    return sha("".join(map(encoded, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))


def null_first(x):
    return (x is not None, x.encode() if isinstance(x, str) else x or 0)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs, trees, out = sorted(groups, key=null_first), {}, []
    for g in langs:
        groups[g].sort(key=lambda r: (null_first(r[0]), leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]])
    crown = tree([trees[g][-1][0] for g in langs])
    for seat, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = []
            for levels, at in ((trees[g], i), (crown, seat)):
                for nodes in levels[:-1]:
                    path.append((at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else None))
                    at //= 2
            node = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for left, sibling in path:
                node = sha(node) if sibling is None else sha(sibling + node if left else node + sibling)
            out.append((r[0], leaf_of(r), trees[g][-1][0], crown[-1][0], sha("".join(s for _, s in path if s)), node, node == crown[-1][0]))
    return sorted(out, key=str)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    langs = ["en", "en", "en", "en", "de", None, "é", "zz", "z"]
    return [(rng.choice([None, i, i, i, 7]), rng.choice([None, "", "é" * i, "x"]), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, i, 3])) for i in range(n)]


# Small blocks make many stages, also with copies of copies near the root.
@pytest.mark.parametrize("n,block,levels", [(0, 256, 8), (1, 256, 8), (3, 256, 8), (700, 256, 8), (300, 4, 2), (20, 2, 1)])
def test_manifest(spark, monkeypatch, n, block, levels):
    monkeypatch.setattr(manifest, "BLOCK", block)
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = some_rows(n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, manifest.document_manifest(docs).collect()), key=str) == brute(rows)


def test_one_group_and_very_long_texts(spark):
    rows = [(i, "é" * 300_000 if i == 4 else "t", None, "s", i) for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, manifest.document_manifest(docs).collect()), key=str)
    assert got == brute(rows) and all(r[2] == r[3] for r in got)


def test_positions_of_a_group_that_fills_many_ranges(spark):
    rows = [("a", i % 3) for i in range(400)] + [("b", 1), (None, 5)]
    got = manifest.positions(spark.createDataFrame(rows, "g string, k int").repartition(8), "g", ["k"]).collect()
    for g, size in (("a", 400), ("b", 1), (None, 1)):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(size)) and {r.n for r in own} == {size}
        assert [r.k for r in own] == sorted(r.k for r in own)
