"""BPE over prefixes: against the library on random texts, and as a query."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from wattframe.llm.prefix_bpe import SuffixAutomaton, WordBpe, prefix_decode, prefix_digests, prefix_encode
from wattframe.llm.queries import WORD_BPE

LETTERS = "abcdeéßİΣςǅ漢字한क़िʼ’'st ́̈️\n\t\x1c\x85\xa0²½٣ⅷ!?.,<|>𝐀𐐀"


@pytest.fixture(scope="module")
def coder():
    return WordBpe(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60)))
        elif kind < 0.6:
            spans = ((1, 0x2FF), (1, 0xD7FF), (0xE000, 0x1FFFF), (1, 0xD7FF))
            text = "".join(chr(rng.randint(*rng.choice(spans))) for _ in range(rng.randint(0, 30)))
        else:
            text = "".join(rng.choice("aaabtheinger.s '") for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.1:
            text += rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x"]) + text
        yield text


def test_ids_and_decoded_text_equal_the_library(coder, library):
    extra = ["z" * 5000, "ab" * 900 + ".", " " * 9, "it's we're I'LL ''s !'t", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "J̌ é É"]
    for text in [*texts(4, 3000), *extra]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert coder.encode(text) == packed, text
        assert coder.decode(packed) == decoded, text
        assert coder.digests(text) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())


def test_windows_cut_at_white_space_only(coder, monkeypatch):
    text = "Une phrase, avec the<|endoftext|>words\tand\nlines " * 40 + "x" * 300
    whole = coder.digests(text)
    monkeypatch.setattr("wattframe.llm.prefix_bpe.WINDOW", 17)
    assert coder.digests(text) == whole


def test_stores_are_bounded(monkeypatch, library):
    for name in ("CHUNKS", "PIECES", "PAIRS"):
        monkeypatch.setattr(f"wattframe.llm.prefix_bpe.{name}", 20)
    coder, rng = WordBpe(WORD_BPE), random.Random(1)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9))
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, (coder.chunks, coder.before, coder.pieces))) <= 40


def test_automaton_finds_every_word_that_ends(coder):
    rng = random.Random(2)
    words = {tuple(rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 6))): k for k in range(60)}
    machine = SuffixAutomaton(words)
    text = tuple(rng.choice([1, 2, 3, 4]) for _ in range(500))
    state = matched = 0
    for n, symbol in enumerate(text, 1):
        while state >= 0 and (to := machine.step.get(state << 9 | symbol)) is None:
            state = machine.link[state]
            matched = machine.length[state] if state >= 0 else -1
        state = to if state >= 0 else 0
        matched = max(matched, -1) + 1
        got = [(size, name) for size, name in machine.ends[state] if size <= matched]
        want = sorted(((len(w), k) for w, k in words.items() if text[max(0, n - len(w)) : n] == w), reverse=True)
        assert got == want


def test_pairs_agree_with_plain_merging(coder):
    order = {(k >> 20, k & ((1 << 20) - 1)): r for k, r in coder.merge.items()}
    symbols = {i: w for w, i in coder.whole.items()}
    one = {w[0]: i for w, i in coder.whole.items() if len(w) == 1}
    made = {(k >> 20, k & ((1 << 20) - 1)): None for k in coder.merge}
    by_word = coder.whole

    def plain(word):
        ids = [one[s] for s in word]
        while True:
            best = min(((order[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in made), default=None)
            if best is None:
                return ids
            k = best[1]
            ids[k : k + 2] = [by_word[symbols[ids[k]] + symbols[ids[k + 1]]]]

    rng = random.Random(5)
    inner = [i for i, w in symbols.items() if w[-1] < 256 and len(w) < 5]
    any_ = [i for i, w in symbols.items() if len(w) < 5]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(any_)
        assert coder.may_follow(a, b) == (plain(symbols[a] + symbols[b]) == [a, b])


def test_query(docs_of, library):
    rows = [(1, None), (2, ""), (3, "x" * 3000 + " " + "ab" * 500), (4, "a b"), (4, "a b"), (None, " \n "), (5, "Ça va ?  Bien.\n\n fin "), (6, "it's 3 ½ ² 漢字😀!! <|endoftext|>")]
    got = sorted(map(tuple, prefix_digests(docs_of(rows), WORD_BPE).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    decoded = prefix_decode(prefix_encode(docs_of(rows), WORD_BPE), WORD_BPE)
    assert sorted(map(str, (r.decoded for r in decoded.collect()))) == sorted(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in rows)
    assert prefix_digests(docs_of([]), WORD_BPE).count() == 0
