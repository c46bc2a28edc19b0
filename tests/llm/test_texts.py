"""Operators that look at one text at a time: BPE, licences, toxicity."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wattframe.llm import toxicity
from wattframe.llm.bpe import Vocabulary, bpe_digests
from wattframe.llm.licenses import BASE, BadExpression, evaluate, longest_expression, scan_licenses
from wattframe.llm.queries import BYTE_BPE

EDGE = [(1, None), (2, ""), (3, "x" * 3000 + " " + "ab" * 500), (4, "a b"), (4, "a b"), (None, " \n "), (5, "Ça va ?  Bien.\n\n fin "), (6, "it's 3 ½ ² 漢字😀!!")]


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(BYTE_BPE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_texts(vocab, reference):
    rng = random.Random(3)
    letters = "abcdefgh  \n\t's12é漢😀 .!?_́ⅷ²-'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["z" * 2000, "ab" * 400, " " * 50, "é漢" * 90, "\r\n " * 9]
    for text, ids in zip(texts, vocab.encode(texts)):
        assert ids == np.array(reference.encode_ordinary(text), "<u4").tobytes(), text
        assert vocab.decode(ids) == text.encode()


def test_bpe_query(docs_of, reference):
    got = sorted(map(tuple, bpe_digests(docs_of(EDGE), BYTE_BPE, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in EDGE:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_digests(docs_of([]), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_license_words_and_places(docs_of):
    rows = EDGE + [
        (10, "The MIT, License; mit  license mit\nlicense"),
        (11, "apache-license GENERAL public LICENSE é mit licenses"),
        (12, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception -- see below"),
        (13, "spdx-license-identifier: gpl-3.0 and"),
    ]
    got = {(r.doc_id, r.n_words): r for r in scan_licenses(docs_of(rows)).collect()}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    tagged = next(r for r in got.values() if r.doc_id == 12)
    assert (tagged.labels, tagged.permitted, tagged.score) == ("apache,gpl,mit", True, 1.0)
    assert next(r for r in got.values() if r.doc_id == 13).permitted is False
    assert scan_licenses(docs_of([])).count() == 0


def test_license_expressions():
    permit = frozenset({"mit", "apache"})
    assert evaluate("mit or gpl-2.0 and gpl-3.0", permit)[1:] == (True, "mit gpl-2.0 gpl-3.0 and or")
    assert evaluate("(mit or gpl-2.0) and gpl-3.0", permit)[1] is False
    assert evaluate("gpl-2.0 with classpath-exception or apache-2.0", permit)[2] == "gpl-2.0 classpath-exception with apache-2.0 or"
    for bad in ("", "or mit", "mit mit", "(mit", "mit)", "mit and", "()"):
        with pytest.raises(BadExpression):
            evaluate(bad, permit)


def test_long_license_expressions_are_read_to_their_end(docs_of):
    permit = frozenset({"mit", "apache"})
    words = ["mit", "gpl-2.0", "and", "or", "with", "(", ")"]
    rng = random.Random(7)
    for _ in range(3000):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 9))]
        best = None
        for n in range(1, len(tokens) + 1):
            try:
                best = evaluate(" ".join(tokens[:n]), permit)
            except BadExpression:
                pass
        assert longest_expression(" ".join(tokens), permit) == best, tokens
    long = " AND ".join(["MIT"] * 200 + ["GPL-3.0-only"])
    rows = [(1, f"SPDX-License-Identifier: {long}\nMIT"), (2, f"SPDX-License-Identifier: MIT SPDX-License-Identifier: {long} */ or MIT")]
    one, two = sorted(scan_licenses(docs_of(rows)).collect(), key=lambda r: r.doc_id)
    assert (one.labels, one.permitted, one.expressions) == ("gpl,mit", False, ["mit mit and" + " mit and" * 198 + " gpl-3.0-only and"])
    assert two.expressions == ["mit", *one.expressions] and two.permitted is False
    # In proportion to its length.
    assert len(longest_expression("mit and " * 200_000 + "gpl-3.0", permit)[0]) == 200_001


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rng = random.Random(5)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if bad:
            words[rng.randrange(len(words))] = f"grobnik{rng.randint(0, 9)}a"
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_unseen_documents(docs_of, labelled):
    rows, labels = labelled
    report = toxicity.toxicity_report(docs_of(rows + [(900, None), (901, "")]), labels).collect()
    assert len(report) == 402
    unseen = [r for r in report if r.doc_id < 400 and (r.doc_id % 5 == 0 or r.held_out)]
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in unseen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in report)
    assert {r.predicted for r in report if r.doc_id >= 900} == {0}


def test_toxicity_learns_nothing_from_the_held_out_fold(docs_of, labelled):
    rows, labels = labelled
    docs = docs_of(rows)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.toxicity_report(docs, flipped).collect()}


def test_toxicity_without_labels(spark, docs_of, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "you idiot"), (2, "a fine day"), (3, None)])
    assert [r.doc_id for r in toxicity.drop_toxic(docs, none).collect()] == [2, 3]
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    assert toxicity.toxicity_report(docs_of([]), labelled[1]).count() == 0


def test_toxicity_keeps_the_share_of_all_labels(spark, docs_of):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(2000):
        bad = i % 10 == 0
        words = [f"word{rng.randrange(20)}" for _ in range(8)] + ["grobnik"] * (rng.random() < (0.6 if bad else 0.03))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs, labels = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    full, cut = toxicity.fit(docs, labels), toxicity.fit(docs, labels, max_toxic=150, max_other=150)
    sample = toxicity.training_sample(docs, labels, max_toxic=150, max_other=150).toPandas()
    assert sample.groupby("toxic").size().tolist() == [150, 150]
    everyone = toxicity.training_sample(docs, labels).toPandas()
    assert np.allclose(sample.groupby("toxic")["weight"].sum(), everyone.groupby("toxic").size())
    assert (everyone.weight == 1).all() and abs(full.bias - cut.bias) < 0.5, (full.bias, cut.bias)


def test_label_model_recovers_rates_and_correlation():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    on = np.array([0.8, 0.7, 0.6, 0.5, 0.0, 0.999])
    off = np.array([0.05] * 5 + [0.001])  # the last one is the annotator
    votes = (rng.random((6000, 6)) < np.where(y[:, None], on, off)).astype(float)
    votes[:, 4] = votes[:, 3]  # one voter repeats another
    post, rates, corr = toxicity.label_model(votes, 0.3, np.clip(votes[:, -1], 0.1, 0.9))
    assert abs(rates[0, :4] - on[:4]).max() < 0.05 and abs(rates[1, :4] - 0.05).max() < 0.03
    assert corr[3, 4] > 0.9 and abs(corr[0, 1]) < 0.2
    assert ((post > 0.5) == y).mean() > 0.98
