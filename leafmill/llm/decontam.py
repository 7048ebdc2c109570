"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of template tokens are
hash-joined, and the slots of aligned windows must agree, which also catches questions asked anew with other parameters.

Items are indexed by their literal windows as well, so a copy whose capitals differ is found. Windows of documents pass a sieve
first, a Bloom filter over the items' windows whose size is bounded, whatever the benchmark: where it is too small for one it lets more
through, and the join decides. The join is by hash between tables; hot windows of documents are dealt to several tasks. Windows of one document and
item that are equally far apart form an alignment, in which each value of the item must stand for one value of the document.

Items of one template are one question, asked with other values: they are indexed together, by the values of the one with the smallest id and the literal
windows of all. A window that stands at more than COMMON places of the benchmark, as a common instruction does, tells no question from another:
it isn't joined, and the words that such windows cover don't count. So a document gives rows for at most COMMON places a window, however
many items share its text. A question all of whose windows are common is a window as a whole.

Windows are as long as the item allows: one changed word in the middle of an item of fewer than two windows would else spoil all of
them, so these have windows of half their words. An item shorter than a window is one window, its whole sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up, prepare
from .textkit import NOT_ALNUM, U64, Texts, Words, mix

WINDOW = 8
#: Words of a window of a template that must be literal; in proportion, rounded up, for a shorter window.
LITERAL = 4
#: Percent of an item's words that aligned windows must cover.
COVER = 50
#: A window at more places of the benchmark than this is no evidence.
COMMON = 8
#: The sieve has 16 bits for a window, but no fewer and no more than 2 to the power of these. It is built in slices of SLICE_BITS.
LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 28, 22
#: Windows of documents that one task joins for one hash; more are dealt to several.
PART = 4096

# Words for numbers and for units, in English, German, French and Spanish.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarden "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millones"
).split()
UNIT_WORDS = (
    "meter meters metre metres centimeters centimetres millimeters millimetres kilometers kilometres gram grams kilogram kilograms mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw mw volt volts amp amps joule joules celsius fahrenheit kelvin percent dollar dollars cent cents euro euros usd eur gbp kb mb gb tb kmh mph degrees degree "
    "zoll meilen zentimeter millimeter kilometer gramm kilogramm tonnen pfund sekunde sekunden minuten stunde stunden tage tagen woche wochen monat monate monaten jahr jahre jahren grad prozent dollars "
    "pouce pouces pied pieds mètre mètres kilomètre kilomètres gramme grammes kilo kilos tonne tonnes litre litres seconde secondes heure heures jour jours semaine semaines mois ans année années degrés centimes "
    "pulgada pulgadas pie pies metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas meses año años grados dólares euros céntimos"
).split()
NUMBER, NAME, UNIT = (mix(np.array([k], U64))[0] for k in (101, 102, 103))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Whether a word that begins with these two bytes begins with a capital: ASCII, and two-byte letters of Latin, Greek and Cyrillic.
_CAPITAL = np.zeros((256, 256), bool)
_CAPITAL[65:91] = True
for _c in range(0x80, 0x530):
    if chr(_c).isupper():
        _CAPITAL[tuple(chr(_c).encode())] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_JOINT = np.zeros(256, bool)
_JOINT[list(b".,:/")] = True


@cache
def _hashes(*words: str) -> np.ndarray:
    return np.sort(Texts(pa.array([" ".join(words)])).words(NOT_ALNUM).hashes())


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@dataclass
class Tokens:
    """Tokens of a batch: literal hashes, template hashes (placeholders for typed tokens), and the words they come from."""

    words: Words
    literal: np.ndarray
    template: np.ndarray
    typed: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> "Tokens":
        texts = Texts(array, lower=True)
        words = texts.words(NOT_ALNUM)
        raw, start, end = texts.raw, words.start, words.end
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        number = digits[end] - digits[start] == end - start
        first = np.zeros(len(start), bool)
        first[words.first[:-1][words.count > 0]] = True
        before = np.concatenate([[0], end[:-1]])
        # A decimal or a date is one number: its later parts are dropped.
        part = np.zeros(len(start), bool)
        part[1:] = number[1:] & number[:-1] & ~first[1:] & (start[1:] - end[:-1] == 1)
        part &= _JOINT[raw[np.maximum(start - 1, 0)]] if len(raw) else part
        name = _CAPITAL[raw[start], raw[np.minimum(start + 1, len(raw) - 1)]] & ~first & (stops[start] == stops[before]) if len(start) else np.zeros(0, bool)
        literal = words.hashes()
        keep = ~part
        kept = Words.__new__(Words)
        kept.texts, kept.start, kept.end = texts, start[keep], end[keep]
        total = np.concatenate([[0], np.cumsum(keep)])
        kept.first = total[words.first]
        kept.count = np.diff(kept.first)
        literal, number, name = literal[keep], number[keep], name[keep]
        number |= _is_in(literal, _hashes(*NUMBER_WORDS))
        unit = _is_in(literal, _hashes(*UNIT_WORDS)) & ~number
        template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
        return cls(kept, literal, template, number | unit | name)

    def slots(self, begin: np.ndarray, size: int) -> pa.Array:
        """Of windows by their first tokens: for each token its kind and value in one number, 0 for untyped ones."""
        at = begin[:, None] + np.arange(size)
        values = np.where(self.typed[at], self.literal[at] ^ self.template[at], U64(0)).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * size), pa.array(values.ravel()))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Literal and template hashes of windows, whether the template has literals enough, and the windows before each text."""
        literal, first = self.words.windows(self.literal, size)
        template, _ = self.words.windows(self.template, size)
        begin = np.arange(first[-1]) + np.repeat(self.words.first[:-1] - first[:-1], np.diff(first))
        typed = np.concatenate([[0], np.cumsum(self.typed)])
        n = typed[begin + size] - typed[begin]
        return literal, template, (n > 0) & (n <= size - -(-size * LITERAL // WINDOW) if size < WINDOW else n <= size - LITERAL), first


def window_of(words: int, size: int = WINDOW) -> int:
    """The window of an item of so many words: ``size``, half the words of an item of fewer than two windows, all words of a shorter one."""
    return size if words >= 2 * size else words // 2 if words >= size else words


@dataclass
class Sieve:
    """A Bloom filter with three probes: bits of a power of two in all, packed."""

    bits: np.ndarray

    @staticmethod
    def probes(hashes: np.ndarray, power: int) -> Iterator[np.ndarray]:
        for k in range(3):
            yield (hashes if k == 0 else mix(hashes + U64(k))) & U64((1 << power) - 1)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be among those put in."""
        some = np.arange(len(hashes))
        for k in range(3):
            at = (hashes[some] if k == 0 else mix(hashes[some] + U64(k))) & U64(8 * len(self.bits) - 1)
            some = some[self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1 == 1]
        return some

    @classmethod
    def of(cls, windows: DataFrame, n: int) -> "Sieve":
        """From rows with ``hash``: each slice of the bits is made by one task, and all slices together, of bounded size, reach the driver."""
        power = min(MOST_BITS, max(LEAST_BITS, int(16 * n - 1).bit_length()))
        slices = 1 << max(0, power - SLICE_BITS)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(list(cls.probes(batch.column(0).to_numpy().view(U64), power))))
                own = (at >> U64(SLICE_BITS)).astype(np.int32)
                for k in np.unique(own).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at[own == k].tobytes()], pa.binary())], ["slice", "at"])

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags, own = None, 0
            for batch in batches:
                for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    flags = np.zeros(1 << min(power, SLICE_BITS), np.uint8) if flags is None else flags
                    own = k
                    flags[(np.frombuffer(at, U64) & U64(len(flags) - 1)).astype(np.int64)] = 1
            if flags is not None:
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

        rows = windows.select("hash").mapInArrow(dealt, "slice int, at binary").repartitionById(slices, "slice").mapInArrow(made, "slice int, bits binary").collect()
        bits = np.zeros((1 << power) // 8, np.uint8)
        for r in rows:
            one = np.frombuffer(r["bits"], np.uint8)
            bits[r["slice"] * len(one) : (r["slice"] + 1) * len(one)] = one
        return cls(bits)


WINDOWS = "size int, at int, literal boolean, hash bigint, slots array<bigint>"
ITEMS = f"item_id bigint, item bigint, question bigint, words int, {WINDOWS}"
HITS = f"doc_id bigint, doc bigint, {WINDOWS}"


def _rows(tokens: Tokens, size: int, keep) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(owners, columns of WINDOWS) of the windows that ``keep(hashes, owners)`` gives the places of: literal ones, then good templates."""
    literal, template, good, first = tokens.windows(size)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for hashes, kind in ((literal, True), (template, False)):
        some = keep(hashes, owner)
        some = some if kind else some[good[some]]
        at = some - first[owner[some]]
        n = len(some)
        yield owner[some], [pa.array(np.full(n, size, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(n, kind)), pa.array(hashes[some].view(np.int64)), tokens.slots(at + tokens.words.first[owner[some]], size)]


def item_windows(benchmark: DataFrame, item_id: str, text: str, size: int, whole: bool = False) -> DataFrame:
    """All windows of all items, of the size that each item's length asks for, or, if ``whole``, one window of all its words. Items that are equal in
    id and text are one; ``question`` names the template of all of an item's words."""
    own = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens.of(batch.column(2))
            count, first = tokens.words.count, tokens.words.first
            question = np.array([int.from_bytes(hashlib.blake2b(tokens.template[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
            sizes = count if whole else np.array([window_of(n, size) for n in count.tolist()], np.int64)
            for one in np.unique(sizes[sizes > 0]).tolist():
                for owner, columns in _rows(tokens, one, lambda hashes, owner, one=one: np.flatnonzero(sizes[owner] == one)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(question[owner]), pa.array(count[owner].astype(np.int32)), *columns], [c.split()[0] for c in ITEMS.split(", ")])

    return own.select("item_id", F.xxhash64("text").alias("item"), "text").mapInArrow(run, ITEMS)


def questions_of(windows: DataFrame) -> DataFrame:
    """(question, item_id, item, n_items): of items of one template the one with the smallest id, nulls last, and how many they are."""
    each = windows.groupBy("question", "item_id", "item").agg(F.lit(1).alias("one"))
    first = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "item"))
    return each.groupBy("question").agg(first.alias("r"), F.count("*").alias("n_items")).select("question", "r.item_id", "r.item", "n_items")


def _places(ps: Column, size: Column) -> Column:
    """The words that windows at these places cover."""
    return F.array_distinct(F.flatten(F.transform(ps, lambda p: F.sequence(p, p + size - 1))))


def evidence(windows: DataFrame, questions: DataFrame, common: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(evidence, judged) of items' windows. ``evidence``: question, words, size, at, literal, hash and the slots of the question's first item, of windows at no more than
    ``common`` places. ``judged``: question and its ``proper`` words, which no common window covers, or, if there are none, those that evidence covers."""
    key, place = ["size", "literal", "hash"], ["question", "words", "size", "at", "literal", "hash"]
    # A template's hash is the same for all items of a question, so these are one row; of literal windows each item has its own.
    own = scratch.save(windows.groupBy(*place).agg(F.lit(1).alias("one")).drop("one"), "places")
    counts = own.groupBy(*key).agg(F.count("*").alias("m")).select(*key, "m", F.col("m").alias("places"))
    marked = scratch.save(look_up(own, counts, key, "m", own.count(), F.xxhash64("question", "at")).withColumn("rare", F.col("places") <= common), "marked")
    # Of a place of a question: is what all of its items share there, the template or else the literal window, common?
    first = windows.join(questions.select("question", "item_id", "item"), "question").where(windows["item_id"].eqNullSafe(questions["item_id"]) & (windows["item"] == questions["item"])).select("question", "at", "slots", *key)
    places = first.join(marked.where("not rare").select("question", "at", *key, F.lit(True).alias("shared")), ["question", "at", *key], "left").groupBy("question", "at").agg(F.first("slots").alias("slots"), F.count("shared").alias("shared"), F.first("size").alias("size"))
    places = scratch.save(places, "slots")
    rare = marked.where("rare").select(*place)
    found = look_up(rare, rare.groupBy("question", "at").agg(F.count("*").alias("m")).join(places.select("question", "at", "slots"), ["question", "at"]), ["question", "at"], "m", own.count(), F.col("hash"), "inner")
    shared = places.groupBy("question").agg(F.first("size").alias("size"), F.collect_list(F.when(F.col("shared") > 0, F.col("at"))).alias("cs"))
    held = rare.groupBy("question", "words").agg(F.collect_set("at").alias("hs"))
    proper = F.array_except(F.sequence(F.lit(0), F.col("words") - 1), _places(F.col("cs"), F.col("size")))
    judged = held.join(shared, "question").select("question", F.when(F.size(proper) > 0, proper).otherwise(_places(F.col("hs"), F.col("size"))).alias("proper"))
    return scratch.save(found, "evidence"), scratch.save(judged, "judged")


def hits_of(docs: DataFrame, sieve: Sieve, sizes: list[int]) -> DataFrame:
    """Windows of documents (doc_id, doc, text) that pass the sieve."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(shared.value)
        for batch in batches:
            tokens = Tokens.of(batch.column(2))
            for size in sizes:
                for owner, columns in _rows(tokens, size, lambda hashes, _: sieve.passing(hashes)):
                    if len(owner):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), *columns], [c.split()[0] for c in HITS.split(", ")])

    return docs.select("doc_id", "doc", "text").mapInArrow(run, HITS)


def _found(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, size: int, cover: int, common: int, scratch: Scratch) -> DataFrame | None:
    """(doc_id, doc, item_id, n_items, covered_words, item_words, n_windows, literal) from rows (doc_id, doc, text); ``doc`` is the text's hash."""
    prepare(docs.sparkSession)
    every = scratch.save(item_windows(benchmark, item_id, item_text, size), "windows")
    if every.isEmpty():
        return None
    questions = scratch.save(questions_of(every), "questions")
    windows, judged = evidence(every, questions, common, scratch)
    lacking = scratch.save(questions.join(judged, "question", "left_anti").select("question"), "lacking")
    if not lacking.isEmpty():
        whole = item_windows(benchmark, item_id, item_text, size, True).join(lacking, "question", "left_semi")
        more, more_judged = evidence(scratch.save(whole, "whole"), questions, 1 << 62, scratch)
        windows, judged = windows.unionByName(more), judged.unionByName(more_judged)
    n = windows.count()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ``size`` of them, and lengths of items that are windows as a whole
    hits = scratch.save(hits_of(docs, Sieve.of(windows, n), sizes), "hits")
    often = hits.groupBy("hash").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    often = scratch.save(often.join(windows.select("hash").distinct(), "hash"), "often")
    left = look_up(hits, often, ["hash"], "m", hits.count(), F.xxhash64("doc", "at"), "inner").withColumn("part", F.pmod(F.xxhash64("doc_id", "doc", "at"), F.col("parts")).cast("int"))
    right = windows.join(often.select("hash", "parts"), "hash").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select("hash", "size", "literal", "part", "question", "words", F.col("at").alias("p"), F.col("slots").alias("theirs"))
    both = left.drop("parts").join(right, ["hash", "size", "literal", "part"])
    values = F.filter(F.zip_with("theirs", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"] != 0) & (x["b"] != 0))
    key = ["doc_id", "doc", "question", "words", "size"]
    # An alignment has at most as many windows as the item.
    aligned = both.select(*key, (F.col("at") - F.col("p")).alias("shift"), F.struct("p", "literal").alias("w"), values.alias("v"))
    aligned = aligned.groupBy(*key, "shift").agg(F.collect_set("w").alias("ws"), F.array_distinct(F.flatten(F.collect_list("v"))).alias("vs"))
    agree = F.size("vs") == F.size(F.array_distinct(F.transform("vs", lambda x: x["a"])))
    each = aligned.where(agree).select(*key, F.explode("ws").alias("w")).groupBy(*key, "w.p").agg(F.bool_or("w.literal").alias("literal"), F.count("*").alias("n"))
    items = each.groupBy(*key).agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sort_array(F.collect_list(F.when(F.col("literal"), F.col("p")))).alias("ls"), F.sum("n").alias("n_windows"))
    items = items.join(judged, "question").join(questions.select("question", "item_id", "n_items"), "question")
    covered, literal = _places(F.col("ps"), F.col("size")), _places(F.col("ls"), F.col("size"))
    out = items.select("doc_id", "doc", "item_id", "n_items", "words", "proper", covered.alias("covered"), "n_windows", (F.size(literal) == F.size(covered)).alias("literal"))
    out = out.where(100 * F.size(F.array_intersect("covered", "proper")) >= cover * F.size("proper"))
    return out.select("doc_id", "doc", "item_id", "n_items", F.size("covered").cast("bigint").alias("covered_words"), F.col("words").cast("bigint").alias("item_words"), "n_windows", "literal")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, cover: int = COVER, common: int = COMMON) -> DataFrame:
    """(doc_id, item_id, n_items, covered_words, item_words, n_windows, literal) of each document and question found in it.

    A question is all items of one template; ``item_id`` is the smallest of theirs and ``n_items`` their number. It is found if aligned windows whose slots agree cover
    ``cover`` percent of its words, leaving out those of windows at more than ``common`` places of the benchmark.
    Null and empty texts hold nothing, items without words are never found. Rows equal in id and text are one document, or one item;
    null ids appear as they are, and rows that share an id but not the text are found each for itself. Other columns are ignored.
    ``literal``: windows that are equal word by word cover all that is covered. An empty table on either side gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("doc"), F.col(text).cast("string").alias("text"))
    found = _found(own, benchmark, item_id, item_text, size, cover, common, Scratch(docs.sparkSession, "leaks"))
    schema = "doc_id bigint, item_id bigint, n_items bigint, covered_words bigint, item_words bigint, n_windows bigint, literal boolean"
    return docs.sparkSession.createDataFrame([], schema) if found is None else found.drop("doc")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, cover: int = COVER, common: int = COMMON) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found. Rows with null or empty texts stay; rows equal in id and text go or stay together;
    an empty table stays empty, and without items all rows stay. See leaks() for the rest."""
    scratch = Scratch(docs.sparkSession, "leaks")
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("doc"), F.col(text).cast("string").alias("text"), F.struct("*").alias("row"))
    found = _found(keyed, benchmark, item_id, item_text, size, cover, common, scratch)
    if found is None:
        return docs
    found = scratch.save(found.select(F.col("doc_id").alias("d"), F.col("doc").alias("h")).distinct(), "found")
    left = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc") == F.col("h")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
