"""Toxicity by weak supervision.

Many voters look at a text: groups of lexicon terms (words and stems that
labelled toxic documents use and others do not, and a few well-known insults),
patterns (shouting, masked swear words, insults aimed at someone) and, where
there is one, an annotator's label. Each fires or not. A generative model with
a hidden class explains how they fire: expectation maximisation gives each
voter's rate in either class, and what it leaves unexplained gives the
correlation of voters, by which votes that repeat each other are discounted.
The posterior of the hidden class then is the target of a linear classifier
over words and stems, which alone scores texts.

Fitting uses a bounded sample of labelled rows, at most ``max_toxic`` and
``max_other`` of the two classes, taken in the order of a hash of the id; a row
weighs as many labelled rows of its class as it stands for, so the share of the
classes is that of all labels. Scoring reads every text in one pass without a
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, released, slices, texts

# Insults that need no labels to be known.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")

# Pattern voters.
PATTERNS = (
    r"\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|scum|trash)",
    r"\b(?:idiot|moron|loser|clown|scum)s?\b",
    r"\b(?:stupid|pathetic|worthless|disgusting|trash)\b",
    r"\b[a-z]+\*{2,}[a-z]*",
    r"!{3,}",
    r"\b(?:shut up|go away|get lost|hate you)\b",
)

STEMS = (4, 5, 6)
#: Bounds of the labelled sample that the model is fitted on.
MAX_TOXIC, MAX_OTHER = 4000, 8000
#: Least rate at which an annotator marks toxic documents, and most for others.
ANNOTATOR = (0.999, 0.001)
#: Log odds that all other voters give together, at most.
MOST_EVIDENCE = 5.0
#: What makes a term telling: likelihood ratio, and log odds against the other class.
MIN_RATIO, MIN_LIFT = 9.0, 1.5
CACHE_ENTRIES = 150_000
_WORDS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def words(text: str) -> set[bytes]:
    """Distinct lower-case words in UTF-8: runs of letters and of characters
    beyond ASCII."""
    return set(text.lower().encode().translate(_WORDS).split())


def features(word: bytes) -> list[bytes]:
    """A word, and its stems of fixed length marked with a dash."""
    return [word, *(word[:n] + b"-" for n in STEMS if len(word) > n)] if len(word) > 2 else []


@dataclass(frozen=True)
class Model:
    """Weights of the linear classifier, and what it was made from."""

    weights: dict[bytes, float]
    bias: float
    voter_rates: list[tuple[str, float, float]]
    correlated: list[tuple[str, str, float]]


def _telling_terms(sample: DataFrame, most: int) -> list[bytes]:
    """Terms that toxic documents of ``sample`` hold more often than chance
    explains, the most telling first: likelihood ratio of ``MIN_RATIO`` or more,
    and ``MIN_LIFT`` in log odds. At most ``most`` of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                term, toxic = [], []
                for text, x in zip(texts(part, "text"), part.column("toxic").to_pylist()):
                    found = {f for w in words(text) for f in features(w)}
                    term += found
                    toxic += [x] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), pa.array(toxic, pa.int32())], ["term", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return []
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    counts = sample.mapInArrow(run, "term binary, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = pos / (pos + neg)
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    told = counts.withColumn("ratio", 2 * (part(a, share) + part(b, 1 - share))).withColumn("lift", F.log((a + 0.5) / (pos + 1) / ((b + 0.5) / (neg + 1))))
    seeds = F.col("term").isin([bytearray(w.encode()) for w in SEED_TERMS])
    top = told.where(((F.col("ratio") >= MIN_RATIO) & (F.col("lift") > MIN_LIFT)) | (seeds & (F.col("lift") > 0)))
    return [bytes(r["term"]) for r in top.orderBy(F.desc("ratio"), "term").limit(most).collect()]


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden-class model of 0/1 votes (documents by voters).

    Returns the posterior of each document, the rate at which each voter fires
    in class 1 and 0 (2 by voters), and the correlation of voters within the
    classes. ``start`` is a first guess of the posterior, ``weight`` what a document
    counts for. The last voter is the annotator, who is trusted: wrong on few
    documents, and never discounted.
    """
    n, v = votes.shape
    weight = np.ones(n) if weight is None else weight
    total, mean = weight.sum(), np.average(votes, axis=0, weights=weight)
    post, keep = start.copy(), np.ones(v)
    corr = np.eye(v)
    rates = np.full((2, v), 0.5)
    for step in range(rounds):
        both = np.stack([post, 1 - post]) * weight
        rates = (both @ votes + 0.5 * mean) / (both.sum(1)[:, None] + 0.5)
        rates = np.clip(rates, 1e-3, 1 - 1e-3)
        rates[:, -1] = max(rates[0, -1], ANNOTATOR[0]), min(rates[1, -1], ANNOTATOR[1])
        if step >= 3:
            # What is left of a vote once the class is known.
            rest = votes - post[:, None] * rates[0] - (1 - post)[:, None] * rates[1]
            sd = np.maximum(np.sqrt(weight @ rest**2 / total), 1e-6)
            corr = (rest.T @ (weight[:, None] * rest)) / total / np.outer(sd, sd)
            keep = 1 / (1 + np.clip(corr - np.eye(v), 0, None).sum(0))
            keep[-1] = 1
        on, off = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        odds = votes * (keep * on) + (1 - votes) * (keep * off)
        # Voters that only look at the text never outweigh an annotator together.
        logit = np.log(prior / (1 - prior)) + np.clip(odds[:, :-1].sum(1), -MOST_EVIDENCE, MOST_EVIDENCE) + odds[:, -1]
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, rates, corr


def _fit_linear(rows: list[np.ndarray], size: int, target: np.ndarray, l2: float = 0.1, passes: int = 40, count: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over sparse 0/1 rows, each counted
    ``count`` times: Newton steps on one weight after the other."""
    n = len(rows)
    count = np.ones(n) if count is None else count
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    at = np.searchsorted(col, np.arange(size + 1))
    share = float(np.clip(np.average(target, weights=count), 1e-3, 1 - 1e-3))
    # The rarer class counts more, though not as much as the other altogether.
    weight = count * (target * np.sqrt(0.5 / share) + (1 - target) * np.sqrt(0.5 / (1 - share)))
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    z = np.full(n, b)
    for _ in range(passes):
        most = 0.0
        for j in range(size):
            d = doc[at[j] : at[j + 1]]
            p = 1 / (1 + np.exp(-np.clip(z[d], -30, 30)))
            g = (weight[d] * (p - target[d])).sum() + l2 * w[j]
            step = float(np.clip(-g / ((weight[d] * p * (1 - p)).sum() + l2 + 1e-3 * count[d].sum()), -1, 1))
            w[j] += step
            z[d] += step
            most = max(most, abs(step))
        for _ in range(3):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = float(np.clip(-(weight * (p - target)).sum() / ((weight * p * (1 - p)).sum() + 1e-3 * count.sum()), -1, 1))
            b += step
            z += step
        if most < 1e-2:
            break
    return w, b


def in_training_fold(id_col: str) -> Column:
    """True for ids whose crc32 (of the id as text) modulo 5 is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC,
    max_other: int = MAX_OTHER,
) -> DataFrame:
    """``id``, ``text``, ``toxic`` and ``weight`` of labelled documents in the training
    fold.

    At most ``max_toxic`` and ``max_other`` ids of the two classes, in the order
    of a hash of the id, so the ids can be broadcast. ``weight`` is the number of
    labelled ids of the class for each one taken. Labels that contradict each
    other for one id count by majority; rows without id or label are left out; of
    rows that repeat an id the greatest text counts, and a null text is empty.
    """
    known = pick(labels, id=id_col, toxic=label_col).where("id is not null and toxic is not null").where(in_training_fold("id"))
    known = known.groupBy("id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    n = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    ids = [
        known.where(F.col("toxic") == x).orderBy(F.xxhash64("id"), "id").limit(k).withColumn("weight", F.lit(max(1.0, all_ / max(k, 1))))
        for x, k, all_ in ((1, max_toxic, n[0]), (0, max_other, n[1]))
    ]
    found = pick(docs, id=id_col, text=text_col).join(F.broadcast(ids[0].unionByName(ids[1])), "id")
    return found.groupBy("id", "toxic", "weight").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC,
    max_other: int = MAX_OTHER,
    terms: int = 3000,
    voters: int = 24,
) -> Model:
    """Fit on the labelled documents of the training fold, a bounded sample of
    them as ``training_sample`` says. Without documents of both classes there is
    no lexicon, and the classifier knows the seed terms only."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, max_toxic, max_other).persist()
    try:
        return _fit(sample, terms, voters)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame, terms: int, voters: int) -> Model:
    told = _telling_terms(sample, terms)
    seeds = {w.encode() for w in SEED_TERMS}
    if not told:
        return Model({w: 6.0 for w in seeds}, -3.0, [], [])
    index = {t: i for i, t in enumerate(told)}
    # Lexicon voters: the terms, dealt out in turn.
    group = {i: i % voters for i in index.values()}
    names = [f"lexicon {k}" for k in range(voters)] + ["seed terms"] + [f"pattern {p}" for p in PATTERNS] + ["annotator"]
    n_votes = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in PATTERNS]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got, votes = [], []
                for text, x in zip(texts(part, "text"), part.column("toxic").to_pylist()):
                    ws = words(text)
                    cols = {index[f] for w in ws for f in features(w) if f in index}
                    low = text.lower()
                    v = np.zeros(n_votes, np.uint8)
                    v[list({group[c] for c in cols if c in group})] = 1
                    v[voters] = bool(ws & seeds)
                    v[voters + 1 : -1] = [bool(p.search(low)) for p in patterns]
                    v[-1] = x
                    got.append(np.array(sorted(cols), "<i4").tobytes())
                    votes.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(votes, pa.binary()), part.column("weight")], ["cols", "votes", "weight"])

    # Bounded: the sample's rows, each with at most ``terms`` columns.
    seen = sample.mapInArrow(run, "cols binary, votes binary, weight double").collect()
    rows = [np.frombuffer(r["cols"], "<i4").astype(np.int64) for r in seen]
    votes = np.array([np.frombuffer(r["votes"], np.uint8) for r in seen], float)
    gold = votes[:, -1]
    count = np.array([r["weight"] for r in seen])
    prior = float(np.clip(np.average(gold, weights=count), 0.01, 0.99))
    start = np.clip(0.8 * gold + 0.1 * np.minimum(votes[:, :-1].sum(1), 2) / 2 + 0.05, 0.02, 0.98)
    post, rates, corr = label_model(votes, prior, start, weight=count)
    weights, bias = _fit_linear(rows, len(index), post, count=count)
    pairs = np.argwhere(np.triu(corr, 1) > 0.2)
    return Model(
        {t: float(weights[i]) for t, i in index.items() if weights[i]},
        float(bias),
        [(m, float(a), float(b)) for m, a, b in zip(names, *rates)],
        [(names[i], names[j], float(corr[i, j])) for i, j in pairs],
    )


def probability(model: Model):
    """A function of a text column: the score of each text. Only the texts go to
    Python, and only numbers come back."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, tuple[bytes, ...]] = {}
        with released():
            for batch in batches:
                out = []
                for text in batch:
                    found: set[bytes] = set()
                    for w in words(text.as_py() or ""):
                        got = known.get(w)
                        if got is None:
                            known[w] = got = tuple(f for f in features(w) if f in weights)
                        if got:
                            found.update(got)
                    out.append(bias + sum(map(weights.__getitem__, sorted(found))))
                    if len(known) > CACHE_ENTRIES:
                        known.clear()
                yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))))

    return of


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from
    0.5 on), in place of any columns of these names. Empty and null texts get
    the score of a text without known terms. Only the text decides."""
    names = docs.columns
    held = docs.toDF(*[f"_{i}" for i in range(len(names))])
    scored = held.withColumn("p", probability(model)(F.col(f"_{names.index(text_col)}")))
    kept = [i for i, c in enumerate(names) if c not in ("score", "predicted")]
    return scored.select(*[f"_{i}" for i in kept], "p", (F.col("p") >= 0.5).cast("int")).toDF(*[names[i] for i in kept], "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with its columns."""
    names = docs.columns
    held = docs.toDF(*[f"_{i}" for i in range(len(names))])
    scored = score(held, fit(docs, labels, id_col, text_col), f"_{names.index(text_col)}")
    return scored.where("predicted = 0").select(*held.columns).toDF(*names)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    model = fit(docs, labels, id_col, text_col)
    scored = score(pick(docs, id=id_col, text=text_col), model)
    return scored.select(F.col("id").alias("doc_id"), (~in_training_fold("id")).alias("held_out"), "score", "predicted")
