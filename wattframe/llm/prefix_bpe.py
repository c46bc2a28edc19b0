"""Exact BPE with word ends by dynamic programming over prefixes.

A merge list gives every text one encoding, and the encoding of each prefix ends
in one token. The last tokens of all prefixes are found from left to right: a
token that ends at a position is the last one of that prefix if it may follow
the last token of the prefix before it. Two tokens may stand side by side if no
merge across their border comes before the merges that make them; that test
for every neighbouring pair is enough for the whole sequence. The ids are read
off backwards, from the last token to the one before it, and so on.

Tokens that end at a position come from a suffix automaton of the vocabulary:
its state after a prefix stands for the longest end of the prefix that lies in
some token, and its suffix links lead to all shorter ends. Time is in proportion
to the text, also for a match of millions of letters.

Words repeat, so each worker keeps the ids of the pieces that it met, in stores of
bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick, slices, texts

#: Entries of a worker's stores: chunks between spaces, pieces, pairs of tokens.
CHUNKS, PIECES, PAIRS = 300_000, 300_000, 400_000
#: Lengths of the beginnings of words that are kept, the longest first.
HEADS = (8, 5)
#: Bytes of a text that are cut at a time.
WINDOW = 1 << 20
_LOWER = bytes(b | 0x20 if 65 <= b <= 90 else b for b in range(256))
_BLANK = b" \t\n\r\x0b\x0c"
# Letters that NFC leaves alone unless marks combine with them, and whose small
# letters are among them: without U+0130.
_LATIN = "ªµºÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[!-~{_LATIN}]*")
_COMBINING = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    ones of Latin-1 for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(other)) for b in range(256)]


class SuffixAutomaton:
    """All factors of the added words, which are sequences of symbols below 512.

    ``step`` maps ``state << 9 | symbol`` to a state, ``link`` a state to that of the
    longest end in another state, ``length`` to its longest factor, ``ends`` to
    the words that are ends of the state's factors, as (length, name), longest
    first.
    """

    def __init__(self, words: dict[tuple[int, ...], int]) -> None:
        out: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def split(at: int, symbol: int, full: int) -> int:
            """The state of ``at`` and ``symbol``, apart from longer factors."""
            if length[full] == length[at] + 1:
                return full
            out.append(dict(out[full]))
            link.append(link[full])
            length.append(length[at] + 1)
            half = len(out) - 1
            link[full] = half
            while at >= 0 and out[at].get(symbol) == full:
                out[at][symbol] = half
                at = link[at]
            return half

        place = {}
        for word, name in words.items():
            at = 0
            for symbol in word:
                if (full := out[at].get(symbol)) is not None:
                    at = split(at, symbol, full)
                    continue
                out.append({})
                link.append(0)
                length.append(length[at] + 1)
                new, p = len(out) - 1, at
                while p >= 0 and symbol not in out[p]:
                    out[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, symbol, out[p][symbol])
                at = new
            place.setdefault(at, []).append((len(word), name))
        self.step = {state << 9 | symbol: to for state, d in enumerate(out) for symbol, to in d.items()}
        self.link, self.length = link, length
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(out)
        for state in sorted(range(1, len(out)), key=length.__getitem__):
            above = self.ends[link[state]]
            self.ends[state] = (*sorted(place[state], reverse=True), *above) if state in place else above


class WordBpe:
    """A tokenizer file with byte-level BPE, word ends, and a pattern.

    Its normalizer and its pattern are the library's for pieces with letters other
    than Latin ones; for those both are written out here. Merging is done here.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.specials.items()}}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        letter = byte_letters()
        byte = {c: b for b, c in enumerate(letter)}
        self.byte = {ord(c): b for c, b in byte.items()}

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end) and token != end
            raw = [byte[c] for c in (token[: -len(end)] if last else token)]
            return (*raw[:-1], raw[-1] + 256 * last)

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        made = {}
        for rank, (a, b) in enumerate(merges):
            made.setdefault(vocab[a + b], (rank, vocab[a], vocab[b]))
        if len(made) != len(merges) or any(max(made.get(a, (-1,))[0], made.get(b, (-1,))[0]) >= r for r, a, b in made.values()):
            raise ValueError(f"{path}: a token has two merges, or one before those of its parts")
        # The tokens that come to lie at the right and left border of a token while it
        # is made, with the rank at which the next one takes over.
        ids = sorted(set(made) | {i for t, i in vocab.items() if len(symbols(t)) == 1}, key=lambda i: made[i][0] if i in made else -1)
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        for i in ids:
            if i in made:
                rank, a, b = made[i]
                self.right[i] = (*self.right[b][:-1], (b, rank), (i, _NEVER))
                self.left[i] = (*self.left[a][:-1], (a, rank), (i, _NEVER))
            else:
                self.right[i] = self.left[i] = ((i, _NEVER),)
        self.size = {i: len(symbols(names[i])) for i in ids}
        self.whole = {symbols(names[i]): i for i in ids}
        self.automaton = SuffixAutomaton(self.whole)
        self.direct = {bytes(s & 255 for s in word): i for word, i in self.whole.items() if word[-1] >= 256}
        self.step = self.automaton.step.get
        self.pairs: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[tuple[int, ...], int, int]] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+").findall

    def may_follow(self, one: int, two: int) -> bool:
        """Whether ``two`` may stand behind ``one``: while both are made, no merge
        across the border comes first. Of equal merges the left one does."""
        merge, right, left = self.merge, self.right[one], self.left[two]
        i = j = 0
        while True:
            (a, until), (b, later) = right[i], left[j]
            rank = merge.get(a << 20 | b, _NEVER)
            if rank < until and rank <= later:
                return False
            if until == later == _NEVER:
                return True
            if until <= later:
                i += 1
            else:
                j += 1

    def merge_piece(self, piece: bytes) -> bytes:
        """Ids of one piece (the bytes of a word), as little-endian unsigned 32-bit
        integers."""
        if (whole := self.direct.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        heads, final = self.heads, len(piece)
        # The last token of each prefix; the empty one has none. Words that begin alike
        # share what was found for their heads.
        for n in HEADS:
            if n < final and (head := heads.get(piece[:n])) is not None:
                found, state, matched = head
                last = list(found)
                break
        else:
            last, n, state, matched = [-1], 0, 0, 0
        pairs, may_follow, add = self.pairs, self.may_follow, last.append
        step, link, length, ends = self.step, self.automaton.link, self.automaton.length, self.automaton.ends
        for symbol in (*piece[n:-1], piece[-1] + 256):
            n += 1
            while (to := step(state << 9 | symbol)) is None:
                state = link[state]
                matched = length[state]
            state = to
            matched += 1
            for size, token in ends[state]:
                if size > matched:
                    continue
                if (one := last[n - size]) >= 0:
                    if (fits := pairs.get(key := one << 20 | token)) is None:
                        pairs[key] = fits = may_follow(one, token)
                    if not fits:
                        continue
                add(token)
                break
            if n in HEADS and n < final:
                heads[piece[:n]] = tuple(last), state, matched
        out, n, size = array("I"), final, self.size
        while n:
            out.append(token := last[n])
            n -= size[token]
        out.reverse()
        return out.tobytes()

    def cut_pieces(self, chunk: bytes) -> list[bytes]:
        """What the tokenizer merges apart in a run without white space."""
        text = chunk.decode()
        if _PLAIN.fullmatch(text):
            return [p.encode() for p in self.cut(text.lower())]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, map(ord, p))) for p, _ in found]

    def learn(self, chunks: set[bytes]) -> None:
        known, before, pieces = self.chunks, self.before, self.pieces
        if len(pieces) > PIECES:
            pieces.clear()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        if len(self.heads) > PIECES:
            self.heads.clear()
        for c in chunks:
            if (ids := before.get(c)) is None:
                parts = []
                for p in self.cut_pieces(c):
                    if (part := pieces.get(p)) is None:
                        part = self.merge_piece(p)
                        if len(p) < 64:
                            pieces[p] = part
                    parts.append(part)
                ids = b"".join(parts)
            known[c] = ids

    def windows(self, text: str) -> Iterator[bytes]:
        """Ids of the text part by part. Parts end at white space, which the
        tokenizer drops, or at special tokens."""
        at = 0
        for m in self.special.finditer(text) if "<|" in text else ():
            yield from self._plain(text[at : m.start()])
            yield self.specials[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        raw = text.encode()
        # Where marks combine with letters, the order of NFC and lower case matters.
        if text.isascii() or not _COMBINING.search(text):
            raw = raw.translate(_LOWER)
        at = 0
        while at < len(raw):
            end = at + WINDOW
            if end < len(raw):
                found = max(raw.rfind(b, at, end) for b in (b" ", b"\n", b"\t"))
                if found <= at:
                    found = min((x for b in (b" ", b"\n", b"\t") if (x := raw.find(b, end)) >= 0), default=len(raw))
                end = found
            cut = raw[at:end].split()
            at = end + 1 if end < len(raw) else end
            if len(self.chunks) > CHUNKS:
                # Chunks that come up again move from the earlier store to the new one.
                self.chunks, self.before = {}, self.chunks
            if new := set(cut).difference(self.chunks):
                self.learn(new)
            yield b"".join(map(self.chunks.__getitem__, cut))

    def encode(self, text: str) -> bytes:
        return b"".join(self.windows(text))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' names with spaces between them: the file has no decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number and SHA-256 of the ids, SHA-256 of what they decode to. No more
        than a part of the text is held at a time."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.windows(text):
            if ids:
                ids_hash.update(ids)
                if n:
                    text_hash.update(b" ")
                text_hash.update(self.decode(ids))
                n += len(ids) // 4
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def prefix_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: the id column, and ``ids`` (binary, little-endian
    unsigned 32-bit integers).

    A null text counts as empty and gives no ids. Repeated rows stay, other
    columns are dropped, and an empty table gives an empty one. The tokenizer
    file has to be at ``tokenizer`` on every executor. Special tokens written out
    in a text are those tokens, as in the library.
    """
    out = pick(docs, id=id_col, text=text_col)
    schema = out.select("id", F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [coder.encode(t) for t in texts(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    return out.mapInArrow(run, schema).toDF(id_col, "ids")


def prefix_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and ``decoded`` (string) of packed ids. Null ids give null; an
    id outside the vocabulary is an error."""
    out = pick(encoded, id=id_col, ids=ids_col)
    schema = out.select("id", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer)
        for batch in batches:
            for part in slices(batch, "ids"):
                decoded = [None if ids is None else coder.decode(ids).decode() for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(decoded, pa.string())], ["id", "decoded"])

    return out.mapInArrow(run, schema).toDF(id_col, "decoded")


def prefix_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and digest both: ``doc_id``, ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256``. Only digests leave the worker."""
    out = pick(docs, id=id_col, text=text_col)
    schema = out.select("id", F.lit(0).cast("long").alias("n"), F.lit("").alias("a"), F.lit("").alias("b")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = zip(*map(coder.digests, texts(part, "text"))) if part.num_rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n", "a", "b"])

    return out.mapInArrow(run, schema).toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
