"""Mixing domains to target weights when membership is only known by degrees.

A table with labelled rows trains a word model of the domains. It gives every
document a posterior over domains, so a document's tokens count for several
domains in part. Nonnegative rates, copies per document, are then fitted by
projected gradient steps so that the expected tokens of each domain match the
targets. All of it is DataFrame and SQL functions; what reaches the driver is a
few numbers per domain, and the words of the model, whose number is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, stored

#: Words that the model knows, and how far one document can move its posterior.
VOCABULARY, EVIDENCE = 2000, 2.0
#: Labelled documents that train the model, at most.
LABELLED = 10_000


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,]+")


def word_weights(labelled: DataFrame, domains: list[str], vocabulary: int = VOCABULARY) -> DataFrame:
    """``word`` and ``w``, its log probability in each of ``domains``, from
    ``labelled`` (``text``, ``domain``): the ``vocabulary`` words that occur most
    often, ties by the word. Rows of other domains are left out."""
    words = labelled.where(F.col("domain").isin(domains)).select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word != ''")
    counts = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    table = words.groupBy("word").agg(F.count("*").alias("n"), *counts).orderBy(F.desc("n"), "word").limit(vocabulary)
    table = stored(table, "mixing-words")
    total = table.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(domains))]).first()
    size = [float(t or 0) + 0.5 * vocabulary for t in total]
    return table.select("word", *[F.log((F.col(f"n{i}") + 0.5) / s).alias(f"w{i}") for i, s in enumerate(size)])


def posteriors(docs: DataFrame, weights: DataFrame, domains: list[str], prior: list[float], evidence: float = EVIDENCE) -> DataFrame:
    """``docs`` (``uid``, ``text`` and others) without the text, with ``tokens``
    (words) and ``p0``, ``p1``, ...: the posterior of each domain.

    A document's word log-likelihoods are averaged and count as ``evidence`` words
    at most, so long documents keep some doubt. One without known words gets the
    prior. The words table is bounded, so it is broadcast; sums are made before
    the shuffle, where a document's words still lie together.
    """
    k = len(domains)
    others = [c for c in docs.columns if c != "text"]
    words = docs.select(*others, F.explode(_words(F.col("text"))).alias("word")).join(F.broadcast(weights), "word", "left")
    # A text always splits into a word, if an empty one: no document is lost.
    sums = words.groupBy(*others).agg(
        F.sum((F.col("word") != "").cast("long")).alias("tokens"), F.count("w0").alias("known"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(k)]
    )
    scale = F.least(F.col("known").cast("double"), F.lit(evidence)) / F.greatest(F.col("known"), F.lit(1))
    logits = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * scale + F.log(F.lit(p)) for i, p in enumerate(prior)]
    sums = sums.select(*others, "tokens", *[x.alias(f"l{i}") for i, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(k)]) if k > 1 else F.col("l0")
    sums = sums.select(*others, "tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(k)])
    whole = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return sums.select(*others, "tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(k)])


@dataclass(frozen=True)
class Fit:
    """Targets and expected tokens per domain, and the steps that the rates took."""

    targets: list[float]
    before: list[float]
    after: list[float]
    steps: list[list[float]]


def fit_rates(table: DataFrame, weights: list[float], budget: float | None = None, floor: float = 0.0, most_steps: int = 60, tolerance: float = 1e-4) -> Fit:
    """Rates by projected gradient on ``sum_d (expected_d - target_d)^2 / tokens_d``.

    ``table`` has ``tokens`` and ``p0``, ...; every rate starts at 1. A step moves
    each document against the weighted residuals of its domains, then back to
    ``floor`` where it fell below. Each step is one pass that sums a number per
    domain; a rate follows from the document's posterior and the steps so far, so
    no state is kept that a lost executor could take. ``budget`` is the wanted
    number of tokens; by default the least for which no domain has to shrink.
    """
    k = len(weights)
    share = [w / sum(weights) for w in weights]

    def expected(steps: list[list[float]]) -> list[float]:
        rate = rates(steps, k, floor) * F.col("tokens")
        row = table.agg(*[F.sum(F.col(f"p{i}") * rate).alias(f"s{i}") for i in range(k)]).first()
        return [float(x or 0.0) for x in row]

    before = now = expected([])
    if budget is None:
        budget = max([b / s for b, s in zip(before, share) if s > 0] + [0.0])
    targets = [budget * s for s in share]
    steps: list[list[float]] = []
    while len(steps) < most_steps:
        gaps = [(n - t) / b if b > 0 else 0.0 for n, t, b in zip(now, targets, before)]
        if max((abs(n - t) for n, t in zip(now, targets)), default=0.0) <= tolerance * max(budget, 1.0):
            break
        # Weighted by the domains' tokens, the curvature is at most 1 along the
        # posteriors, so a step of 1 never overshoots.
        steps.append(gaps)
        now = expected(steps)
    return Fit(targets, before, now, steps)


def rates(steps: list[list[float]], k: int, floor: float = 0.0) -> Column:
    """The rate after ``steps``, from ``p0``, ..."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    history = F.array(*[F.array(*[F.lit(float(g)) for g in step]) for step in steps])
    slope = lambda g: sum((F.col(f"p{i}") * g[i] for i in range(1, k)), F.col("p0") * g[0])
    return F.aggregate(history, rate, lambda r, g: F.greatest(F.lit(float(floor)), r - slope(g)))


def copies(rate: Column, *key: str) -> Column:
    """Whole copies with the rate as their mean: the fraction is decided by a
    hash of ``key``, the same in every run."""
    chance = F.pmod(F.xxhash64(F.lit("mixing"), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mixture(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
    budget: float | None = None,
    floor: float = 0.0,
    vocabulary: int = VOCABULARY,
    labelled: int = LABELLED,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``size``, ``crc`` (of its text), ``domain``
    (as given), ``tokens``, ``posterior`` (array in the order of ``targets``), ``rate``
    and ``copies``.

    ``labels`` names the labelled documents; ``labelled`` of them at most, in the
    order of a hash of the id, train the word model with their ``domain_col``, which
    nothing else looks at. A null or empty text has no
    tokens and gets the prior as posterior. Rows that repeat an id and a text get
    equal results. An empty table gives an empty one; without labelled rows every
    posterior is even.
    """
    domains, k = list(targets), len(targets)
    text = F.coalesce("text", F.lit(""))
    named = pick(docs, id=id_col, text=text_col, domain=domain_col)
    known = pick(labels, id=id_col).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(labelled)
    trained = named.join(F.broadcast(known), "id", "left_semi")
    words = word_weights(trained, domains, vocabulary)
    each = trained.groupBy().agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]).first()
    prior = [(float(x or 0) + 1.0) / (sum(float(y or 0) for y in each) + k) for x in each]
    keyed = named.select(
        "id", F.octet_length(text).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), "domain", F.monotonically_increasing_id().alias("uid"), "text"
    )
    table = stored(posteriors(keyed, words, domains, prior), "mixing-posteriors")
    fit = fit_rates(table, list(targets.values()), budget, floor)
    rate = rates(fit.steps, k, floor)
    out = table.select("id", "size", "crc", "domain", "tokens", F.array(*[F.col(f"p{i}") for i in range(k)]).alias("posterior"), rate.alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), "id", "size", "crc"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say, with its columns.
    Options are those of ``mixture``."""
    found = mixture(docs, labels, targets, id_col, text_col, **options).select("id", "size", "crc", "copies").distinct()
    names = docs.columns
    held = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own_text = F.coalesce(F.col(f"_{names.index(text_col)}"), F.lit(""))
    same = F.col(f"_{names.index(id_col)}").eqNullSafe(F.col("id")) & (F.octet_length(own_text) == F.col("size")) & (F.crc32(own_text.cast("binary")) == F.col("crc"))
    # Merged, not broadcast: the right side has a row per document.
    repeated = held.join(found.hint("merge"), same).withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*held.columns).toDF(*names)
