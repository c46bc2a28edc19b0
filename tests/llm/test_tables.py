"""Operators that bring rows together: against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattframe.llm import exact_dedup, jaccard_join, mixing, neighbours, sharding, token_files, warc
from wattframe.llm.common import stored
from wattframe.llm.components import components
from wattframe.llm.queries import WORD_BPE


def crc(text):
    return zlib.crc32((text or "").encode())


# -- sharding ------------------------------------------------------------------------


def test_sharding_law_and_places(docs_of):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(500)] + [(None, None)] * 300 + [(7, "same")] * 200
    got = sharding.shard_documents(docs_of(rows), 6).toPandas()
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((len((t or "").encode()) + 8, crc(t)) for _, t in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    # Law ``bytes`` with the 300 and 200 equal rows among them.
    spread = got.groupby("shard")["size"].sum()
    assert len(spread) == 6 and spread.max() - spread.min() <= 400
    assert sharding.shard_documents(docs_of([]), 6).count() == 0


def test_thousands_of_copies_of_one_row_spread(docs_of):
    rows = [(i, "x" * (i % 50)) for i in range(2000)] + [(7, "same text " * 20)] * 3000
    got = sharding.shard_documents(docs_of(rows), 24).toPandas()
    spread = got.groupby("shard")["size"].sum()
    assert len(got) == 5000 and len(spread) == 24 and spread.max() <= 1.02 * spread.min()
    assert sorted(got[got.doc_id == 7]["size"])[-3000:] == [208] * 3000


def test_rebalancing_drifted_shards(spark, docs_of, tmp_path):
    path = str(tmp_path / "map")
    first = docs_of([(i, "x" * (i % 90)) for i in range(3000)])
    sharding.shard_documents(first, 5, map_path=path).count()
    old = sharding.load_map(spark, path).toPandas().set_index("virtual_slot")
    # A third of the slots grows tenfold, those of two shards above all.
    rows = sharding.records(first).withColumn("size", F.when(F.col("virtual_slot").isin(old.index[old.shard < 2].tolist()), F.col("size") * 10).otherwise(F.col("size")))
    sizes = sharding.slot_sizes(rows)
    sharding.save_map(sharding.rebalance_map(sharding.load_map(spark, path), sizes, 5), path)
    new = sharding.load_map(spark, path).toPandas().set_index("virtual_slot")
    assert set(new.version) == {3} and len(new) == len(old)
    held = new.groupby("shard")["bytes"].sum()
    fair = -(-held.sum() // 5)
    assert held.max() < 1.01 * fair and held.min() > 0.99 * fair
    moved = old.shard.ne(new.shard.reindex(old.index))
    assert 0 < moved.mean() < 0.5 and set(old.shard[moved]) >= {0, 1}
    again = sharding.rebalance_map(sharding.load_map(spark, path), sizes, 5).toPandas().set_index("virtual_slot")
    assert (again.shard == new.shard.reindex(again.index)).all()
    # A slot that the map does not have, and a shard more.
    few = sharding.load_map(spark, path).where("virtual_slot >= 100")
    wide = sharding.rebalance_map(few, sizes, 6).toPandas()
    assert set(wide.virtual_slot) >= set(new.index[new.bytes > 0]) and wide.groupby("shard")["bytes"].sum().min() > 0.9 * held.sum() / 6


def test_growing_a_map_moves_slots_only_into_the_new_shard(spark, docs_of, tmp_path):
    rows = sharding.records(docs_of([(i, "x" * (i % 90)) for i in range(2000)]))
    path = str(tmp_path / "map")
    sharding.save_map(sharding.build_map(sharding.slot_sizes(rows), 4), path)
    sharding.save_map(sharding.grow_map(sharding.load_map(spark, path), 4), path)
    old, new = (sharding.load_map(spark, path, v).toPandas().set_index("virtual_slot") for v in (1, 2))
    assert sharding.load_map(spark, path).first()["version"] == 2
    moved = old.shard.ne(new.shard.reindex(old.index))
    assert set(new.shard[moved[moved].index]) == {4} and len(old) == len(new)
    sizes = new.groupby("shard")["bytes"].sum()
    assert sizes.min() > 0.8 * sizes.max()


# -- exact dedup ---------------------------------------------------------------------


@pytest.mark.parametrize("first,growth", [(64, 16), (1, 2)])
def test_exact_dedup(docs_of, first, growth):
    rng = random.Random(1)
    rows = [(None, None), (3, None), (4, ""), (5, "a"), (5, "a"), (5, "b"), (9, "b"), (None, "n"), (None, "n")]
    rows += [(100 + i, "ab" * rng.randint(0, 40) + rng.choice("xy")) for i in range(60)] + [(300 + i, "q" * (70 + i % 3)) for i in range(20)]
    got = exact_dedup.exact_duplicates(docs_of(rows), first=first, growth=growth).select("row._0", "row._1", "keep_id", "group_size", "kept").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    kept = {}
    for i, t, keep, size, stays in got:
        own = groups[t or ""]
        best = max((x for x in own if x is not None), default=None)
        assert (keep, size) == (best, len(own))
        assert not stays or i == best
        kept[t or ""] = kept.get(t or "", 0) + stays
    assert kept == dict.fromkeys(groups, 1)


def test_exact_dedup_report_and_drop(docs_of):
    docs = docs_of([(1, "é"), (2, "é"), (3, None)])
    got = sorted(map(tuple, exact_dedup.duplicate_report(docs).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(1, 2, 2, False, sha("é")), (2, 2, 2, True, sha("é")), (3, 3, 1, True, sha(""))]
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert exact_dedup.drop_exact_duplicates(docs_of([])).count() == 0


# -- mixing --------------------------------------------------------------------------


def test_rates_match_targets_and_a_direct_solution(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    tokens = rng.integers(1, 200, 300)
    table = stored(spark.createDataFrame(pd.DataFrame({"tokens": tokens, **{f"p{i}": p[:, i] for i in range(3)}})), "t")
    fit = mixing.fit_rates(table, [0.2, 0.3, 0.5])
    assert np.allclose(fit.after, fit.targets, rtol=2e-3)
    rate = np.ones(300)
    for g in fit.steps:
        rate = np.maximum(0, rate - p @ np.array(g))
    assert np.allclose(fit.after, (p * (rate * tokens)[:, None]).sum(0))
    # A target that no nonnegative rates reach: the residual is still the least.
    one = stored(spark.createDataFrame([(10, 1.0, 0.0), (10, 0.5, 0.5)], "tokens long, p0 double, p1 double"), "t")
    hard = mixing.fit_rates(one, [0.0001, 0.9999], budget=20.0, most_steps=200)
    b = np.array([15.0, 5.0])
    grid = min((((10 * x + 5 * y - 0.002) ** 2 / b[0] + (5 * y - 19.998) ** 2 / b[1]), x, y) for x in np.linspace(0, 2, 201) for y in np.linspace(0, 6, 601))
    assert ((np.array(hard.after) - np.array([0.002, 19.998])) ** 2 / b).sum() <= grid[0] + 0.05


def test_mixing_documents(spark, docs_of):
    words = {"en": "the of and", "fr": "le la et"}
    rows = [(i, " ".join([words["fr" if i % 4 == 0 else "en"]] * (1 + i % 7)), "fr" if i % 4 == 0 else "en", "s", 1) for i in range(200)]
    rows += [(500, None, "en", "s", 1), (501, "", None, "s", 1), (502, "zzz", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    got = mixing.mixture(docs, labels, {"en": 0.5, "fr": 0.5}).toPandas()
    assert len(got) == 203
    known = got[got.id < 200]
    assert ((known.posterior.map(lambda p: p[1]) > 0.5) == (known.id % 4 == 0)).all()
    assert np.allclose(got.posterior.map(sum), 1) and (got.rate >= 0).all()
    assert dict(zip(got.id, got.tokens))[500] == 0 and dict(zip(got.id, got.tokens))[502] == 1
    mixed = mixing.mix(docs, labels, {"en": 0.5, "fr": 0.5}, floor=1.0)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == set(got.id)
    total = mixed.toPandas().assign(n=lambda d: d.text.fillna("").str.split().map(len)).groupby("lang").n.sum()
    assert 0.7 < total["fr"] / total["en"] < 1.4
    assert mixing.mix(docs.limit(0), labels, {"en": 0.5, "fr": 0.5}).count() == 0


# -- neighbours ----------------------------------------------------------------------


def brute_neighbours(rows, k, every):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-float(np.dot(np.array(w, float), np.array(v, float))), j) for j, w in good if j != i)[:k]
            out.setdefault(i, near)
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(240)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0]), (None, [1.0] * 8), (40, rows[40][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(table, k=20, every=20).toPandas()
    want = brute_neighbours(rows, 20, 20)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21))
        hits += len({j for _, j in want[q]} & set(part.vec_id))
    assert hits >= 0.9 * 20 * len(want)
    # Fewer rows than neighbours: all candidates, by the exact way.
    few = neighbours.nearest(table.where("vec_id < 12"), k=20, every=5).toPandas()
    assert (few.groupby("query_id").size() == 11).all() and len(few) == 33
    assert np.allclose(few.sort_values(["query_id", "rank"]).score, [-s for q in (0, 5, 10) for s, _ in brute_neighbours([r for r in rows if r[0] is not None and r[0] < 12], 20, 5)[q]])
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_neighbours_with_the_pivots_of_a_large_table(spark):
    # As many pivots as 600,000 vectors have: a fixed effort would see a quarter of the table.
    x = np.random.default_rng(4).normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    recall = lambda got: np.mean([j in near[q] for q, j in zip(got.query_id, got.vec_id)])
    near = {q: set(np.argsort(-np.where(np.arange(len(x)) == q, -9, x @ x[q]))[:20].tolist()) for q in range(0, len(x), 200)}
    got = neighbours.nearest(table, every=200, pivots=775).toPandas()
    assert len(got) == 800 and recall(got) >= 0.9
    # Whatever effort it begins with, the recall is measured and reached.
    low = neighbours.nearest(table, every=200, visited=2, rerank=25).toPandas()
    assert len(low) == 800 and recall(low) >= 0.9


# -- Jaccard join --------------------------------------------------------------------


def brute_components(rows, percent=80):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(rows))


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, last = [], None
    for i in range(n):
        if last is None or rng.random() < 0.3:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
            if rng.random() < 0.5:
                words = words + passage
        else:
            words = list(last)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        last = words
        rows.append((n - i, (" " if rng.random() < 0.9 else "\n\t ").join(words) if i % 11 else " ".join(words).upper()))
    return rows


@pytest.mark.parametrize("seed,star_rounds", [(1, 3), (2, 1)])
def test_jaccard_join(docs_of, seed, star_rounds):
    rows = near_copies(seed, 150) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "x " * 3000)]
    got = jaccard_join.similar_documents(docs_of(rows), star_rounds=star_rounds).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_jaccard_join_drops_all_but_one(docs_of):
    docs = docs_of([(5, "a b c d e f"), (4, "a b c d e f"), (6, None), (7, "q"), (8, "q")])
    left = jaccard_join.drop_similar(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 6, 7]
    assert jaccard_join.similar_documents(docs_of([])).count() == 0


def test_jaccard_join_of_copies_that_link_with_a_few(docs_of, monkeypatch):
    # Copies of one text with other words changed in each: one pair in sixteen
    # links, so no copy is one that most others link with.
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in range(150)]
        for _ in range(rng.choice((2, 3))):
            k = rng.randrange(150)
            words[k] = f"v{k}x{i}"
        rows.append((i, " ".join(words)))
    made, across = [], jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *a: made.append(across(*a)) or made[-1])
    got = jaccard_join.similar_documents(docs_of(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)
    # Before: 24,566 rows.
    assert made[0].count() <= 10 * len(rows)


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    up = {x: x for l in links for x in l}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in linked}


def tasks_of(spark, run):
    """Tasks of all jobs that ``run`` starts."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
    return sum(i.numTasks for k in stages if (i := tracker.getStageInfo(k)) and i.numCompletedTasks)


def test_components_of_few_links_take_few_tasks(spark):
    # Chains, and stars whose hub is the least node: many shuffle partitions that
    # nothing merges cost no task each.
    chains = [(k, k + 1) for k in range(1000) if k % 5]
    stars = [(2000 + 10 * k, 2000 + 10 * k + j) for k in range(100) for j in range(1, 10)]
    conf = {"spark.sql.shuffle.partitions": "199", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    got = {}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        take = lambda name, links: tasks_of(spark, lambda: got.update({name: components(spark.createDataFrame(links, "a long, b long")).collect()}))
        n_stars, n_chains = take("stars", stars), take("chains", chains)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got["stars"])) == sorted({(x, x // 10 * 10) for link in stars for x in link})
    assert sorted(map(tuple, got["chains"])) == sorted({(x, x - (x - 1) % 5) for link in chains for x in link})
    # Before: 199 and more for each of many stages.
    assert 0 < n_stars < 200 and n_stars < n_chains < 2000


# -- token files ---------------------------------------------------------------------


def test_token_files(docs_of):
    library = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcDÉ'.,#1é") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "J̌ <|endoftext|> <|ENDOFTEXT|> x"), (1003, "z" * 4000), (1004, "twice"), (1004, "twice"), (None, "none"), (-5, "first")]
    got = token_files.token_files(docs_of(rows), WORD_BPE).toPandas().sort_values("start")
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert list(zip(got.start, got.n_tokens, got.ids_crc32)) == want
    assert got.doc_id.isna().sum() == 1 and list(got.doc_id.dropna()) == sorted(i for i, _ in rows if i is not None)
    assert token_files.token_files(docs_of([]), WORD_BPE).count() == 0


def test_words_that_end_in_a_mark_once_normalized():
    library, coder = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE)
    words = ["BİRİNCİ", "İKİ", "\u09ac\u09df", "\u0958", "\ufb2a", "Été", "straße", "ŒUVRE", "ǅ", "слово", "ΛΌΓΟΣ", "漢字", "\U0002ebf0"]
    for text in [w + m for w in words for m in (".", ",", "!!", '")', "")]:
        assert coder.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, coder.kind).tobytes()], text


def test_an_encoder_keeps_a_bounded_number_of_bytes(monkeypatch):
    # Before: hundreds of thousands of chunks in each of four stores, however long.
    monkeypatch.setattr(token_files, "CACHE_BYTES", 1 << 20, raising=False)
    library, coder = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE)
    rng = random.Random(4)
    docs = [f"No. {i} " + "".join(rng.choice(("Ab-", "éé,", "12.", "the'll")) for _ in range(30_000)) + f" Ω{i}" for i in range(60)]
    docs += [" ".join("".join(rng.choices("abcdefgh", k=6)) + rng.choice(("", ".", "-x")) for _ in range(500)) for _ in range(60)]
    for d in docs + docs[-30:]:
        assert coder.encode([d]) == [np.array(library.encode(d, add_special_tokens=False).ids, coder.kind).tobytes()]
    assert sum(len(k) + len(ids) for store in vars(coder).values() if isinstance(store, dict) for k, ids in store.items()) < 4 << 20


def test_perfect_hash_and_unknown_keys(spark):
    keys = token_files.key_hashes(pd.Series(range(5000)), np.zeros(5000))
    hashed = token_files.PerfectHash.build(keys)
    assert sorted(hashed.rank(keys)) == list(range(5000)) and hashed.size == 5000
    directory = spark.createDataFrame([(i, 0, i % 3, 10 * i, 4) for i in range(100)], "doc_id long, copy long, shard int, at long, n long")
    from wattframe.session import shared_path

    index, parts = token_files.write_index(directory, shared_path(spark, "index"))
    asked = spark.createDataFrame([(5, 0), (99, 0), (100, 0), (5, 1)], "doc_id long, copy long")
    assert sorted(map(tuple, token_files.lookup(asked, index, parts).collect())) == [(5, 0, 2, 50, 4), (99, 0, 0, 990, 4)]


# -- WARC ----------------------------------------------------------------------------


def test_warc_round_trip_and_push_down(spark):
    from wattframe.session import shared_path

    long, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a", long), (2, "http://b%0A\r\n", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", long), (7, "u", other), (7, "u", other), (8, "u", "c" * 999), (9, "u", "c" * 999)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = shared_path(spark, "warc-test")
    got = warc.archive_pages(pages, path).toPandas()
    assert len(got) == len(rows)
    for i, u, h in rows:
        raw = (h or "").encode()
        one = got[(got.page_id.isna() if i is None else got.page_id == i) & (got.url.isna() if u is None else got.url == u)].iloc[0]
        kind = "revisit" if (h == long and i != 2) else "response"
        assert (one.payload_bytes, one.payload_digest, one.record_type) == (len(raw), hashlib.sha1(raw).hexdigest(), kind)
        assert (one.refers_to == 2) if kind == "revisit" else pd.isna(one.refers_to)
    archive = spark.read.format("warc").load(path)
    assert "PushedFilters" not in archive.columns and archive.where("page_id in (3, 4) and record_type = 'response'").count() == 2
    assert archive.where("page_id = 1").first().payload is None
    assert archive.where("page_id = 2").first().payload == long.encode()
    assert spark.read.format("warc").schema("page_id long, record_type string").load(path).where("record_type = 'revisit'").count() == 2
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_reader_passes_over_unwanted_payloads():
    class File:
        def __init__(self, raw):
            self.raw, self.read = raw, 0

        def size(self):
            return len(self.raw)

        def read_at(self, n, at):
            self.read += n
            return self.raw[at : at + n]

    body = bytes(random.Random(1).randbytes(200_000))
    raw = b"".join(warc.record(i, "u" * 6000 if i == 2 else "u", "response", None, hashlib.sha1(body).hexdigest(), len(body), body) for i in range(5))
    file = File(raw)
    assert [r["page_id"] for r in warc.records(file, lambda r: r["page_id"] == 3, True)] == [3]
    assert file.read < 2 * len(body)
    assert next(warc.records(File(raw), lambda r: r["page_id"] == 3, True))["payload"] == body
    with pytest.raises(ValueError):
        list(warc.records(File(raw[:100]), lambda r: True, True))


def test_long_texts_are_shingled_in_parts(monkeypatch):
    rng = random.Random(3)
    docs = ["".join(rng.choice("aB é\n\t.") for _ in range(rng.randint(0, 90))) for _ in range(800)] + ["", " ", "x" * 200, "a b c d", "a b c d e"]
    whole = jaccard_join.shingle_sets(docs)
    for piece in (50, 7, 1):
        monkeypatch.setattr(jaccard_join, "PIECE_BYTES", piece)
        assert all(np.array_equal(a, b) for a, b in zip(whole, jaccard_join.shingle_sets(docs), strict=True))


def test_token_files_on_random_texts():
    library, coder = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE)
    rng = random.Random(12)
    letters = "abcdeéßİΣςǅƲ漢한क़'st \n\t\x1c\xa0²½ⅷ!?.,-/<|>1 ́"
    docs = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    docs += ["".join(rng.choice("aaabtheinger.s '-,") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    docs += ["it's we're I'LL ''s !'t", "<|endoftext|> the-end <|ENDOFTEXT|>"]
    want = [np.array(library.encode(d, add_special_tokens=False).ids, coder.kind).tobytes() for d in docs]
    for k in range(0, len(docs), 100):
        assert coder.encode(docs[k : k + 100]) == want[k : k + 100]


def test_warc_ranges_of_a_large_archive_and_lost_attempts(spark, tmp_path):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"http://{i}", rng.randbytes(rng.randint(0, 3000)).hex()) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.as_records(pages).coalesce(1).write.format("warc").option("markBytes", 20000).mode("append").save(path)
    archives = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".warc"]
    assert len(archives) == 1 and archives[0].stat().st_size > 500_000
    cut = spark.read.format("warc").option("rangeBytes", 60000).load(path)
    assert cut.rdd.getNumPartitions() > 8 and spark.read.format("warc").load(path).rdd.getNumPartitions() == 1
    want = {(r.page_id, r.html) for r in pages.collect()}
    assert {(r.page_id, r.payload.decode()) for r in cut.collect()} == want and cut.count() == 400
    # What an attempt left that was never committed is not read.
    (tmp_path / "w" / "lost.warc").write_bytes(archives[0].read_bytes()[:1000])
    assert cut.count() == 400
    # More is added beside it.
    warc.as_records(pages.where("page_id < 10")).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 410
    # Archives from elsewhere have no list, and are read as a whole.
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc").write_bytes(archives[0].read_bytes())
    other = spark.read.format("warc").option("rangeBytes", 60000).load(f"file://{tmp_path}/other")
    assert other.rdd.getNumPartitions() == 1 and other.count() == 400
