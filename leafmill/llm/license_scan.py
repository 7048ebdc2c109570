"""Licence detection by ordered signature rules over canonical text.

Canonical text: the lower-cased words of a document, one blank between them; so a match is an interval of words. A rule names
groups of words, of each of which one must occur before its expression is tried; a document that holds no word of any first group is not
looked at further. Detections that lie inside another of higher priority, or of
equal priority and greater length, are suppressed. Base phrases are found by word hashes in every document and always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_rules
from .common import prepare
from .textkit import NOT_ALNUM, Texts

#: Phrase and label of the fixed part.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str
    keywords: tuple[tuple[str, ...], ...]
    weight: float


def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""
    out = []
    for label, priority, keywords, pattern in license_rules.RULES:
        for short, whole in license_rules.SHORT.items():
            pattern = pattern.replace(short, whole)
        out.append(Rule(label, priority, pattern, tuple(tuple(k.split("|")) for k in keywords.split()), min(0.95, 0.35 + priority / 100)))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(2)
def compiled(given: tuple[Rule, ...]) -> tuple[tuple[Rule, re.Pattern, tuple[frozenset[str], ...]], ...]:
    return tuple((r, re.compile(rf"(?<!\S)(?:{r.pattern})(?!\S)"), tuple(map(frozenset, r.keywords))) for r in given)


def gate(given: tuple[Rule, ...]) -> tuple[str, ...]:
    """Words of which every match of any rule holds one: the first groups. A rule without keywords can't be gated."""
    if not all(r.keywords for r in given):
        raise ValueError("every rule needs keywords")
    return tuple(sorted({w for r in given for w in r.keywords[0]}))


def detections(words: list[str], given: tuple[Rule, ...]) -> list[tuple[int, int, Rule]]:
    """(first word, word after the last, rule) of what stays after suppression, in order."""
    text, present = " ".join(words), frozenset(words)
    found = []
    starts = None
    for rule, expression, keys in compiled(given):
        if not any(present.isdisjoint(group) for group in keys):
            for m in expression.finditer(text):
                if starts is None:
                    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
                found.append((int(np.searchsorted(starts, m.start())), int(np.searchsorted(starts, m.end() + 1)), rule))
    return suppress(found)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop what lies inside a kept detection; higher priority is kept first, then greater length, then earlier start and label.

    Of each priority those in order of their start: one lies inside another where the furthest end before it reaches its own; what
    is kept of higher ones is held by start with the furthest end so far. So the time is that of sorting, for each priority."""
    kept: list[tuple[int, int, Rule]] = []
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = sorted(found, key=lambda d: (-d[2].priority, d[0], -d[1], d[2].label))
    for _, some in groupby(order, key=lambda d: d[2].priority):
        new, reach = [], -1
        for d in some:
            at = int(np.searchsorted(starts, d[0], "right"))
            if reach < d[1] and not (at and ends[at - 1] >= d[1]):
                new.append(d)
                reach = d[1]
        kept += new
        every = sorted((d[0], d[1]) for d in kept)
        starts, ends = np.array([x for x, _ in every]), np.maximum.accumulate([x for _, x in every])
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def _hash(words: list[str]) -> np.ndarray:
    return Texts(pa.array([" ".join(words)])).words(NOT_ALNUM).hashes()


SPANS = "array<struct<first:bigint,after:bigint,label:string>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", given: tuple[Rule, ...] | None = None) -> DataFrame:
    """Base places and labels, all labels, a score and the kept detections (word intervals) of every row.

    Null and empty texts have no words and score 0. Null and repeated ids stay, row by row; other columns are ignored; an empty table gives no rows. A text
    of any length is scanned whole, in one task.
    """
    prepare(docs.sparkSession)
    given = given or rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gated_by = np.sort(_hash(list(gate(given))))
        phrases = [(_hash(phrase.split()), label) for phrase, label in BASE]
        span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            texts = Texts(batch.column(1), lower=True)
            words = texts.words(NOT_ALNUM)
            h, n = words.hashes(), texts.n
            owner = np.repeat(np.arange(n), words.count)
            places = [[] for _ in range(n)]
            for phrase, label in phrases:
                size = len(phrase)
                if len(h) >= size:
                    hit = h[: len(h) - size + 1] == phrase[0]
                    for k in range(1, size):
                        hit &= h[k : len(h) - size + 1 + k] == phrase[k]
                    at = np.flatnonzero(hit)
                    for p in at[owner[at] == owner[at + size - 1]]:
                        places[owner[p]].append((int(p - words.first[owner[p]]), label))
            gated = np.bincount(owner[gated_by[np.minimum(np.searchsorted(gated_by, h), len(gated_by) - 1)] == h], minlength=n) > 0
            rows = []
            for i in range(n):
                spans: list[tuple[int, int, Rule]] = []
                if gated[i]:
                    data, a, b = texts.data, words.first[i], words.first[i + 1]
                    whole = data[texts.at[i] : texts.at[i + 1]].tobytes()
                    spans = detections([whole[s:e].decode() for s, e in zip(words.start[a:b] - texts.at[i], words.end[a:b] - texts.at[i], strict=True)], given)
                base = sorted({label for _, label in places[i]})
                at = [p for p, _ in places[i]]
                miss = 1.0
                for _, _, r in spans:
                    miss *= 1 - r.weight
                if base:
                    miss = min(miss, 0.1)
                rows.append((len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(r.label for _, _, r in spans)})), 1 - miss, [{"first": s, "after": e, "label": r.label} for s, e, r in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.count.astype(np.int64)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}")
