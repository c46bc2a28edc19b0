"""Licence scan: identifier tags, notice phrases, and licence expressions.

One Aho-Corasick automaton per worker holds all phrases, and the words of the
identifier tag. It runs over the words of a text, joined by single spaces, so a
phrase is found where its words stand one after the other, whatever is between
them. Only texts with a tag are looked at again, for the expressions behind
their tags. A shunting-yard parser reads ``and``, ``or``, ``with`` and brackets and
evaluates an expression: which licences it names, and whether a set of
permitted licences is enough for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices, texts

# Phrases that the scan always reports, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases with their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "apache software license": "apache",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "the unlicense": "unlicense",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "all rights reserved": "proprietary",
}

# What identifiers in expressions are called, by how they begin.
FAMILIES = ("mit", "apache", "agpl", "lgpl", "gpl", "mpl", "bsd", "isc", "cc", "unlicense", "epl", "boost", "bsl")

#: Licences that an expression may rely on, by family.
PERMITTED = ("mit", "apache", "bsd", "isc", "cc", "unlicense", "boost", "bsl")
_TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier\s*:[ \t]*")
_EXPRESSION = re.compile(r"[a-z0-9.+\-() \t]*")
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# Letters and digits as they are, A-Z in lower case, bytes of other characters, and
# a space for the rest.
_WORD_BYTES = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 0x20 for b in range(256))


def family(identifier: str) -> str:
    """The label of an identifier such as ``gpl-2.0-only``; itself if unknown."""
    return next((f for f in FAMILIES if identifier.startswith(f)), identifier)


class BadExpression(ValueError):
    """Text behind a tag that is no expression."""


def evaluate(expression: str, permitted: frozenset[str]) -> tuple[list[str], bool, str]:
    """Families named in a lower-case licence expression, whether ``permitted``
    is enough for it, and the expression in postfix form.

    Shunting yard: ``with`` binds before ``and``, ``and`` before ``or``. One side is
    enough for ``or``, both are needed for ``and``; an exception leaves its
    licence as it is.
    """
    # Where its names begin, and whether what is permitted is enough, for each value.
    values: list[tuple[int, bool]] = []
    names: list[str] = []
    postfix: list[str] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        if len(values) < 2:
            raise BadExpression(expression)
        (right, rb), (left, lb) = values.pop(), values.pop()
        postfix.append(op)
        if op == "with":
            del names[right:]
            values.append((left, lb))
        else:
            values.append((left, lb and rb if op == "and" else lb or rb))

    operand = True  # what may come next
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand:
                raise BadExpression(expression)
            waiting.append(token)
        elif token == ")":
            if operand:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(":
                apply(waiting.pop())
            if not waiting:
                raise BadExpression(expression)
            waiting.pop()
        elif token in _RANK:
            if operand:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                apply(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand:
                raise BadExpression(expression)
            name = family(token)
            values.append((len(names), name in permitted))
            names.append(name)
            postfix.append(token)
            operand = False
    while waiting:
        op = waiting.pop()
        if op == "(":
            raise BadExpression(expression)
        apply(op)
    if len(values) != 1:
        raise BadExpression(expression)
    return names, values[0][1], " ".join(postfix)


def longest_expression(text: str, permitted: frozenset[str]) -> tuple[list[str], bool, str] | None:
    """The longest beginning of ``text`` that is an expression: comments may follow
    a tag on its line."""
    tokens = _TOKEN.findall(text)
    whole, depth, operand = 0, 0, True
    for n, token in enumerate(tokens, 1):
        if (token == "(" or token not in _RANK and token != ")") != operand:
            break  # nothing that begins like this is an expression
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
        else:
            operand = token in _RANK
        if depth < 0:
            break
        if not depth and not operand:
            whole = n
    return evaluate(" ".join(tokens[:whole]), permitted) if whole else None


def _behind_tags(text: str) -> Iterator[str]:
    """What stands behind each tag on its line, up to a character that no expression
    has, or to the next tag."""
    tags = list(_TAGGED.finditer(text))
    for m, following in zip(tags, [*(t.start() for t in tags[1:]), len(text)]):
        yield _EXPRESSION.match(text, m.end(), following)[0]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    found: dict[str, tuple[str, bool]] = {p: (label, p in BASE) for p, label in phrases}
    machine = ahocorasick.Automaton()
    for phrase, (label, base) in found.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 1, label, base))
    machine.add_word(f" {_TAG} ", (len(_TAG) + 1, "", False))
    machine.make_automaton()
    return machine


def scan_text(text: str, machine: ahocorasick.Automaton, permitted: frozenset[str]) -> tuple:
    """Values of the columns of ``scan_licenses`` for one text."""
    words = text.encode().translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode()} "
    n_base, first, last, tagged = 0, None, None, False
    base, labels = set(), set()
    for end, (back, label, is_base) in machine.iter(line):
        tagged = tagged or not label
        if label:
            labels.add(label)
        if is_base:
            n_base += 1
            base.add(label)
            start = end - back  # the space before the phrase
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
    expressions, permit = [], None
    if tagged:
        for behind in _behind_tags(_lower_ascii(text)):
            if (e := longest_expression(behind, permitted)) is not None:
                labels.update(e[0])
                expressions.append(e[2])
                permit = e[1] if permit is None else permit and e[1]
    count = lambda at: None if at is None else line.count(" ", 0, at)
    score = 1.0 if expressions else 1.0 - 0.5 ** (n_base + len(labels - base)) if labels else 0.0
    return len(words), n_base, count(first), count(last), ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, permit


def _lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (their least and greatest start),
    ``base_labels``, ``labels`` (those of all phrases and expressions), ``score`` (1
    with a readable expression, else the surer the more is found), ``expressions``
    (in postfix form) and ``permitted`` (whether ``permitted`` licences are enough
    for all expressions, null without any).

    A null text is empty and has no words. Overlapping places all count. Rows
    may repeat; other columns are left out; an empty table gives an empty one.
    """
    some = pick(docs, id=id_col, text=text_col)
    phrases = tuple({**(NOTICES if notices is None else notices), **BASE}.items())
    allowed = frozenset(permitted)
    schema = f"id {some.schema['id'].dataType.simpleString()}, {_COLUMNS}"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(phrases)
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan_text(t, machine, allowed) for t in texts(part, "text")]
                columns = zip(*rows) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *names])

    return some.mapInArrow(run, schema).withColumnRenamed("id", "doc_id")
