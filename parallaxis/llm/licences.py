"""Licence scans: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parallaxis.llm import _text

#: Phrases, as lower-case words one space apart, and their labels. Places of these count in n_base.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases of this method.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "reserved",
}
#: Tags before a licence expression, lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Labels of licence identifiers whose version or variant doesn't matter; other identifiers are their own labels in lower case.
FAMILIES = {"mit": "mit", "apache-2.0": "apache-2", "cc-by-nc": "cc-by-nc", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0"}
#: How sure each kind of evidence is.
TAG_STRENGTH, BASE_STRENGTH, NOTICE_STRENGTH = 0.9, 0.8, 0.6

BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*", re.ASCII)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order, by the shunting-yard algorithm; the longest well-formed beginning of text, or None.

    with binds tightest, then and, then or; all group from the left.
    """
    found, best = [m for m in re.finditer(r"[^\s()]+|[()]", text.lower())], None
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for m in found:
        word = m[0]
        if not _TOKEN.fullmatch(word):
            break
        if word == "(":
            if operand:
                break
            stack.append(word)
        elif word == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in _PRECEDENCE:
            if not operand:
                break
            while stack and _PRECEDENCE.get(stack[-1], 0) >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        elif operand:
            break
        else:
            out.append(word)
            operand = True
        if operand and "(" not in stack:
            best = out + stack[::-1]
    return best


def label_of(identifier: str) -> str:
    """The label of a licence identifier."""
    name = identifier.rstrip("+").rstrip(".")
    return next((label for family, label in sorted(FAMILIES.items(), key=lambda x: -len(x[0])) if name == family or name.startswith(family + "-")), name)


def evaluate(postfix: list[str]) -> tuple[frozenset[str], str]:
    """The labels that a postfix expression names (an exception after with isn't one), and the expression written in full parentheses."""
    stack: list[tuple[frozenset[str], str]] = []
    for word in postfix:
        if word in _PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            stack.append((left if word == "with" else left | right, f"({a} {word} {b})"))
        else:
            stack.append((frozenset({label_of(word)}), word))
    return stack[0]


@functools.lru_cache
def _phrases() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in {**NOTICE_PHRASES, **BASE_PHRASES}:
        machine.add_word(f" {phrase} ", (len(phrase), BASE_PHRASES.get(phrase), NOTICE_PHRASES.get(phrase)))
    machine.make_automaton()
    return machine


@functools.lru_cache
def _tags() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for tag in TAGS:
        machine.add_word(tag, tag)
    machine.make_automaton()
    return machine


def scan_words(line: str) -> tuple[list[int], set[str], set[str]]:
    """Word positions of base phrases, base labels and notice labels in words that stand one space apart."""
    starts, base, notices, at, words = [], set(), set(), 0, 0
    for last, (size, label, notice) in sorted(_phrases().iter(f" {line} "), key=lambda x: x[0] - x[1][0]):
        first = last - size  # of the phrase, in the padded line
        words, at = words + line.count(" ", at, first - 1), first - 1
        if label:
            starts.append(words)
            base.add(label)
        if notice:
            notices.add(notice)
    return starts, base, notices


def scan_tags(text: str) -> list[tuple[frozenset[str], str]]:
    """Labels and normal form of each expression that follows a tag on its line."""
    out = []
    for last, _ in _tags().iter(text):
        line = re.match(r"[^\r\n]*", text[last + 1 :] if len(text) - last < 4096 else text[last + 1 : last + 1 + (text.find("\n", last) - last if "\n" in text[last:] else len(text))])[0]
        if postfix := parse_expression(line):
            out.append(evaluate(postfix))
    return out


def scan_licences(documents: DataFrame) -> DataFrame:
    """One row a document: places and labels of licence statements in its whole text.

    score is the chance that the text states a licence: one minus the product
    of what each label's best evidence leaves open. A null text is empty and
    has none; repeated rows are scanned each; columns besides doc_id and text
    are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in _text.chunks(batch.column(1)):
                w = _text.words(data, offsets, lower=True, breaks=BREAKS)
                first = w.firsts()
                joined = w.data.tobytes()
                lowered = _text.ASCII_LOWER[data].tobytes()
                tagged = any(t.encode() in lowered for t in TAGS)
                rows = []
                for i in range(b - a):
                    f, e = first[i], first[i + 1]
                    line = joined[w.start[f] : w.end[e - 1]].decode() if e > f else ""
                    starts, base, notices = scan_words(line)
                    found = scan_tags(lowered[offsets[i] : offsets[i + 1]].decode()) if tagged else []
                    stated = frozenset().union(*(x for x, _ in found))
                    open_ = 1.0
                    for label in base | notices | stated:
                        open_ *= 1 - max(TAG_STRENGTH * (label in stated), BASE_STRENGTH * (label in base), NOTICE_STRENGTH * (label in notices))
                    rows.append((int(e - f), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | notices | stated)), 1 - open_, sorted({x for _, x in found})))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in RESULT.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(scan, RESULT)
