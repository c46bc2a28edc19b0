"""The corpus pipeline: each stage on its own input against brute force."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.conftest import SF
from wattframe.llm import toxicity
from wattframe.llm.bpe import vocabulary
from wattframe.llm.common import stored
from wattframe.llm.queries import BYTE_BPE, table

from .test_tables import brute_components, near_copies

STAGES = dict(corpus_pipeline.STAGES)


def digests(rows):
    vocab = vocabulary(BYTE_BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    out = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_every_stage_on_what_the_one_before_kept(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        left = stored(stage(spark, docs, SF), f"test-{name}")
        after = sorted((r.doc_id, r.text) for r in left.select("doc_id", "text").collect())
        assert left.columns == columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity_report(docs, labels).collect() if r.predicted}
            assert after == sorted(r for r in before if r[0] not in bad)
        elif name == "exact_dedup":
            largest = {}
            for i, t in before:
                largest[t or ""] = max(i, largest.get(t or "", i))
            assert after == sorted((i, t) for i, t in before if largest[t or ""] == i)
        elif name == "jaccard_join":
            stay = {d for d, n, c in brute_components(before) if n == 0 or d == c}
            assert after == sorted(r for r in before if r[0] in stay)
        else:
            assert set(after) == set(before) and len(after) >= len(before)
        docs = left
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    last = sorted(map(tuple, STAGES["byte_bpe"](spark, docs, SF).collect()), key=str)
    assert last == digests(rows)


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r.doc_id for r in got.collect()}
    assert ids and ids <= {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_columns_nulls_and_repeats(spark, name):
    rows = [*near_copies(4, 30), (900, None), (901, ""), (901, ""), (902, "x " * 2000), (903, "you stupid idiot " * 3)]
    clash = {"Text": "t", "score": 1.5, "p": 2.0, "predicted": 9, "id": 7, "kept": True, "keep_id": 3, "component_id": 4, "tokens": 5, "rate": 0.5, "row": "r", "_0": 6, "copies": 2}
    names = ["doc_id", "text", "lang", "source", "n_chars", *clash]
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in clash.items())
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, None, None, *clash.values()) for i, t in rows], schema)
    out = STAGES[name](spark, docs, SF)
    got = out.collect()
    if name == "byte_bpe":
        assert sorted(map(tuple, got), key=str) == digests(rows)
        return
    assert out.columns == names and got
    for r in got:
        assert {k: r[k] for k in clash} == clash and (r.doc_id, r.text) in rows
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0
