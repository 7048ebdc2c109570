"""Quality rules as a short-circuit cascade: rules are ordered by rejections per cost, both estimated on a sample.

A rule is a vectorised predicate over the texts that no earlier rule has rejected; as texts go, the facts at hand are cut down to those
still in. What a rule costs is what it has to find out beyond the facts that rules before it have found: so costs are marginal, and counted in
bytes, words and comparisons, not in seconds, and the order is the same on every run. The verdict is the conjunction of all rules, so
the order changes the time taken, and which failed rule is named, but never the verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textkit import BLANK, Texts, Words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: Rows, about, on which costs and selectivities are estimated. They are looked at whole, on the executors; only sums come to the driver.
SAMPLE_ROWS = 1000


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Facts:
    """What rules look at; each fact is computed when first asked for."""

    texts: Texts
    _kept: dict = field(default_factory=dict)

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def of(self, alive: np.ndarray) -> "Facts":
        """The same facts of some of the texts: what is known is cut, not found out anew."""
        at = self.texts.at
        sizes, inside = np.diff(at)[alive], np.repeat(alive, np.diff(at))
        texts = Texts.__new__(Texts)
        texts.n, texts.at = int(alive.sum()), np.concatenate([[0], np.cumsum(sizes)])
        texts.data = texts.raw = self.texts.data[inside]
        out = Facts(texts)
        for name, value in self._kept.items():
            if name == "words":
                some = np.repeat(alive, value.count)
                moved = np.repeat(at[:-1][alive] - texts.at[:-1], value.count[alive])
                words = Words.__new__(Words)
                words.texts, words.start, words.end, words.count = texts, value.start[some] - moved, value.end[some] - moved, value.count[alive]
                words.first = np.concatenate([[0], np.cumsum(words.count)])
                out._kept[name] = words
            elif name == "hashes":
                out._kept[name] = value[np.repeat(alive, self.words.count)]
            elif name == "lines":
                owner, again = value
                some = alive[owner]
                out._kept[name] = ((np.cumsum(alive) - 1)[owner[some]], again[some])
            else:
                out._kept[name] = value[alive]
        return out

    @property
    def words(self) -> Words:
        return self._once("words", self.texts.words)

    @property
    def hashes(self) -> np.ndarray:
        return self._once("hashes", self.words.hashes)

    @property
    def n_words(self) -> np.ndarray:
        return self.words.count

    def bytes_in(self, name: str, table: np.ndarray) -> np.ndarray:
        return self._once(name, lambda: per_text(table[self.texts.data], self.texts.at))

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes in words that don't continue a code point."""
        return self._once("word_chars", lambda: per_text(~BLANK[self.texts.data] & ((self.texts.data & 0xC0) != 0x80), self.texts.at))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of lines with a word: owner and whether an equal line stands before it in the text."""
        return self._once("lines", self._lines)

    def _lines(self):
        data, at = self.texts.data, self.texts.at
        breaks = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
        begin = begin[begin < len(data)]
        begin = begin[data[begin] != 10]  # the others are empty lines
        end = np.unique(np.concatenate([at[1:], breaks]))
        # A line ends at the next line break or text end after its start.
        end = end[np.searchsorted(end, begin, "right")] if len(begin) else begin
        spans = Words.__new__(Words)
        spans.texts, spans.start, spans.end = self.texts, begin, end
        has = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, begin)
        spans.start, spans.end = begin[has], end[has]
        owner = np.searchsorted(at, spans.start, "right") - 1
        return owner, repeated(spans.hashes(), owner)

    @property
    def n_dup_lines(self) -> np.ndarray:
        owner, again = self.lines
        return np.bincount(owner[again], minlength=self.texts.n)

    @property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.texts.n)

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self._once("repeat", self._repeat)

    def _repeat(self, size: int = 5):
        windows, first = self.words.windows(self.hashes, size)
        owner = np.repeat(np.arange(self.texts.n), np.diff(first))
        twice = found_twice(windows, owner)
        begin = np.arange(len(windows)) - first[owner] + self.words.first[owner]
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, begin[twice], 1)
        np.add.at(edge, begin[twice] + size, -1)
        return per_text(np.cumsum(edge)[:-1] > 0, self.words.first)

    @property
    def top_word(self) -> np.ndarray:
        """Occurrences of each text's most frequent word."""
        return self._once("top", self._top)

    def _top(self):
        owner = np.repeat(np.arange(self.texts.n), self.words.count)
        out = np.zeros(self.texts.n, np.int64)
        if len(owner):
            order = np.lexsort((self.hashes, owner))
            h, o = self.hashes[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
            np.maximum.at(out, o[new], np.diff(np.concatenate([new, [len(h)]])))
        return out


def _groups(values: np.ndarray, owner: np.ndarray):
    order = np.lexsort((np.arange(len(values)), values, owner))
    v, o = values[order], owner[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return order, same


def repeated(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the value occurs before in its owner."""
    order, same = _groups(values, owner)
    out = np.zeros(len(values), bool)
    out[order] = same
    return out


def found_twice(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    order, same = _groups(values, owner)
    both = same.copy()
    both[:-1] |= same[1:]
    out = np.zeros(len(values), bool)
    out[order] = both
    return out


def _sorting(n: float) -> float:
    return n * math.log2(n + 2)


#: Of each fact, those it is found from, and about how many steps it takes for a text of so many bytes, words and lines.
COSTS: dict[str, tuple[tuple[str, ...], Callable[[float, float, float], float]]] = {
    "words": ((), lambda b, w, n: 6 * b),
    "hashes": (("words",), lambda b, w, n: 8 * b + 4 * w),
    "symbols": ((), lambda b, w, n: 2 * b),
    "upper": ((), lambda b, w, n: 2 * b),
    "letters": ((), lambda b, w, n: 2 * b),
    "inside": ((), lambda b, w, n: 2 * b),
    "word_chars": ((), lambda b, w, n: 4 * b),
    "lines": (("words",), lambda b, w, n: 10 * b + 4 * _sorting(n)),
    "repeat": (("words", "hashes"), lambda b, w, n: 12 * w + 4 * _sorting(w)),
    "top": (("words", "hashes"), lambda b, w, n: 4 * w + 4 * _sorting(w)),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Facts], np.ndarray]


RULES = (
    Rule("few_words", ("words",), lambda f: f.n_words < 10),
    Rule("repeated_passages", ("words", "repeat"), lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", ("symbols", "words"), lambda f: 10 * f.bytes_in("symbols", SYMBOLS) > 2 * f.n_words),
    Rule("capitals", ("upper", "letters"), lambda f: 2 * f.bytes_in("upper", UPPER) > f.bytes_in("letters", LETTER)),
    Rule("not_letters", ("letters", "inside"), lambda f: 10 * f.bytes_in("letters", LETTER) < 6 * f.bytes_in("inside", ~BLANK)),
    Rule("word_length", ("word_chars", "words"), lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 16 * f.n_words)),
    Rule("repeated_lines", ("lines",), lambda f: 10 * f.n_dup_lines > 3 * f.n_lines),
    Rule("one_word", ("top", "words"), lambda f: 10 * f.top_word > 4 * f.n_words),
)
#: Facts that the columns of judge() need of every text.
COUNTED = ("words", "word_chars", "symbols", "lines", "hashes", "repeat")


def closure(needs: tuple[str, ...]) -> set[str]:
    """Facts that have to be found for these."""
    out: set[str] = set()
    for name in needs:
        out |= {name} | closure(COSTS[name][0])
    return out


def cascade(array: pa.Array, rules: tuple[Rule, ...], facts: Facts | None = None, seen: list[int] | None = None) -> np.ndarray:
    """Index of the first rule that rejects each text, -1 for kept ones. A rule is tried on no text that one before it has rejected, but for
    a tenth of the texts at most, below which cutting the facts down isn't worth it. ``seen`` gets the number of texts each rule was tried on."""
    out, at = np.full(len(array), -1), np.arange(len(array))
    facts = facts or Facts(Texts(array))
    alive = np.ones(len(array), bool)
    for k, rule in enumerate(rules):
        if alive.sum() <= 0.9 * len(alive):
            facts, at = facts.of(alive), at[alive]
            alive = np.ones(len(at), bool)
        if seen is not None:
            seen.append(len(at))
        if not len(at):
            continue
        bad = alive & rule.rejects(facts)
        out[at[bad]] = k
        alive &= ~bad
    return out


PROFILE = "failed bigint, n bigint, " + ", ".join(f"{name} double" for name in COSTS)


def profile(sample: DataFrame, rules: tuple[Rule, ...]) -> list:
    """Rows (failed, n, cost of each fact) of a sample's texts by the set of rules that reject them, as bits: two to the power of rules at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Facts(Texts(batch.column(0)))
            failed = sum((rule.rejects(f).astype(np.int64) << k for k, rule in enumerate(rules)), np.zeros(f.texts.n, np.int64))
            sizes = list(zip(np.diff(f.texts.at).tolist(), f.n_words.tolist(), f.n_lines.tolist(), strict=True))
            costs = [pa.array([cost(*x) for x in sizes], pa.float64()) for _, cost in COSTS.values()]
            yield pa.RecordBatch.from_arrays([pa.array(failed), pa.array(np.ones(len(failed), np.int64)), *costs], ["failed", "n", *COSTS])

    rows = sample.select("text").mapInArrow(run, PROFILE)
    return rows.groupBy("failed").agg(*[F.sum(c).alias(c) for c in ("n", *COSTS)]).collect()


def ordered(profiled: list, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejections per cost: always that next which rejects most of the texts still in for what it has to find out of these,
    beyond the facts ``known`` and those that rules before it need. Without a sample, in the order given."""
    if not profiled:
        return rules
    alive, left, found, out = list(profiled), list(enumerate(rules)), closure(known), []
    while left:

        def gain(rule: tuple[int, Rule], alive=alive, found=found) -> float:
            cost = sum(r[name] for r in alive for name in closure(rule[1].needs) - found)
            return (sum(r["n"] for r in alive if r["failed"] >> rule[0] & 1) + 0.5) / (cost + sum(r["n"] for r in alive) + 1)

        best = max(left, key=gain)
        left.remove(best)
        out.append(best[1])
        found = found | closure(best[1].needs)
        alive = [r for r in alive if not r["failed"] >> best[0] & 1]
    return tuple(out)


def estimated(own: DataFrame, rules: tuple[Rule, ...], sample_rows: int, known: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules in order, from about ``sample_rows`` rows of (doc_id, text) that a hash picks."""
    n = own.count()
    some = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // sample_rows))) == 0)
    return ordered(profile(some, rules), rules, known) if n else rules


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that no rule rejects; only what the cascade asks for is found out of a text. Null and empty
    texts are rejected; repeated rows stay or go each for itself, with one outcome; an empty table stays empty."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen, at = estimated(own, rules, sample_rows), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(cascade(batch.column(at).cast(pa.string()), chosen) < 0))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, verdict and first failed rule of every row.

    Null and empty texts have no words and fail. Rows are judged one by one: null and repeated ids stay as they are, other
    columns are ignored, an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The counts are asked for of every text, so their facts cost the rules nothing.
    cost_order = estimated(own, rules, sample_rows, COUNTED)
    names = [r.name for r in cost_order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            f = Facts(Texts(texts))
            base = (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)
            failed = cascade(texts, cost_order, f)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x.astype(np.int64)) for x in (f.n_words, f.word_chars, f.bytes_in("symbols", SYMBOLS), f.n_dup_lines, f.n_repeat_words)),
                    pa.array(base),
                    pa.array(~base & (failed < 0)),
                    pa.array([names[k] if k >= 0 else None for k in failed], pa.string()),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"],
            )

    return own.mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, failed_rule string")
