"""Best-fit packing of token sequences: a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest sequences, counted by configuration
and in fractions, that hold the histogram. Multiplicative weights on the lengths are its dual prices: in each step those that lag
behind gain weight, a knapsack dynamic program prices all configurations at once, and the dearest ones that hold the lengths furthest
behind take up a share of what is left. Later passes begin with the mean weights of the pass before, until the gap to the dual bound
is small. The multiplicities are then rounded down; the rest, less than one sequence per configuration, is packed best-fit decreasing.
The configurations that best-fit decreasing would use, with its multiplicities, are a solution of the program as well: mixtures of it and the
weights' solution are rounded too, and the fewest sequences count, so the result is never worse than either.

Only the histogram (at most ``capacity`` rows) reaches the driver. Pieces get their place by their rank among pieces of equal
length, so the assignment is one shuffle by (length, salt), whatever the share of one length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, prepare

CAPACITY = 1024
END_ID = 2
#: Share of a configuration's scarcest length that one step uses up, and lengths left for each configuration taken from one dynamic program.
STEP, EACH = 0.15, 16
#: How strongly a length that lags behind gains price for the moment, and for good.
ETA, LEARN = 0.02, 0.004
#: Exponent of a length's first price: a long piece is worth more than short ones of the same total, which fill gaps later.
CONVEX = 1.05
#: A pass ends when this share of all tokens is left. Passes at most, and the gap to the dual bound, as a share of it, that ends them.
LEFT, PASSES, GAP = 1e-5, 8, 5e-4
#: Shares of best-fit's solution in the mixtures that are rounded after each pass; that solution itself is rounded before them.
MIXTURES = (0.0, 0.5)
#: Each pass takes smaller steps than the one before, by this factor.
FINER = 0.75

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# --- the linear program, on the driver


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each room up to ``capacity`` the greatest total price of lengths that fit it, any number of each, and the last length
    taken (0: one less room is as good). Lengths without a positive price aren't taken."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(price > 0)
    own, upto = price[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := upto[room]:
            gain = best[room - lengths[:k]] + own[:k]
            j = int(gain.argmax())
            if gain[j] > best[room]:
                best[room], took[room] = gain[j], lengths[j]
    return best, took


def configuration(took: np.ndarray, room: int) -> dict[int, int]:
    """Counts by length of the best filling of a room."""
    counts: dict[int, int] = {}
    while room > 0:
        if length := int(took[room]):
            counts[length] = counts.get(length, 0) + 1
        room -= length or 1
    return counts


def best_fit(rest: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on a histogram: the longest piece first, then always the longest that still fits."""
    rest, out = rest.copy(), []
    while (left := np.flatnonzero(rest)).size:
        counts, room = np.zeros_like(rest), capacity
        while True:
            fits = left[: np.searchsorted(left, room, "right")]
            fits = fits[rest[fits] > counts[fits]]
            if not fits.size:
                break
            length = int(fits[-1])
            k = min(room // length, int(rest[length] - counts[length]))
            counts[length] += k
            room -= k * length
        used = np.flatnonzero(counts)
        copies = int((rest[used] // counts[used]).min())
        rest -= copies * counts
        out.append((counts, copies))
    return out


def one_pass(n: np.ndarray, weight: np.ndarray, step: float, learn: float, capacity: int) -> tuple[dict[tuple, float], np.ndarray]:
    """(multiplicities by configuration, mean log weights) of one run of multiplicative weights that begins with the log weights given."""
    lengths = np.arange(capacity + 1)
    base, total = (lengths / capacity) ** CONVEX, float((n * lengths).sum())
    rest, weight, least = n.astype(float), weight.copy(), 1e-9 * n
    share: dict[tuple, float] = {}
    sums, seen = np.zeros(capacity + 1), np.zeros(capacity + 1)
    while (live := rest > least).any() and (left := float((rest * lengths).sum())) >= LEFT * total:
        part = np.where(live, rest / np.maximum(n, 1), 0)
        lag = np.clip(part * total / left - 1, -1, 2)
        _, took = knapsack(np.where(live, base * np.exp(weight + ETA * lag), 0), capacity)
        weight[live] += learn * np.minimum(lag[live], 1)
        if left > 0.05 * total:
            sums[live] += weight[live] * left
            seen[live] += left
        for length in np.argsort(-part, kind="stable")[: -(-int(live.sum()) // EACH)].tolist():
            if rest[length] <= least[length]:
                continue
            counts = configuration(took, capacity - length)
            counts[length] = counts.get(length, 0) + 1
            most = min(rest[k] / c for k, c in counts.items())
            amount = most if most < 0.5 else step * most
            key = tuple(sorted(counts.items()))
            share[key] = share.get(key, 0.0) + amount
            for k, c in counts.items():
                rest[k] = max(rest[k] - amount * c, 0.0)
    return share, np.where(seen > 0, sums / np.maximum(seen, 1e-300), weight)


def dual_bound(n: np.ndarray, weight: np.ndarray, capacity: int) -> float:
    """No packing needs fewer sequences: prices under which no configuration costs more than 1 bound the program from below."""
    lengths = np.arange(capacity + 1)
    price = np.where(n > 0, (lengths / capacity) ** CONVEX * np.exp(weight), 0)
    return max(float((n * lengths).sum()) / capacity, float((n * price).sum()) / max(knapsack(price, capacity)[0][capacity], 1e-300))


def rounded(n: np.ndarray, share: dict[tuple, float], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole multiplicities, the greatest first, and best-fit for what these leave."""
    left, out = n.copy(), []
    for key, x in sorted(share.items(), key=lambda kv: (-kv[1], kv[0])):
        if copies := min(int(x + 1e-9), min(int(left[k]) // c for k, c in key)):
            counts = np.zeros_like(n)
            for k, c in key:
                counts[k] = c
            out.append((counts, copies))
            left -= copies * counts
    return out + best_fit(left, capacity)


def mixed(a: dict[tuple, float], b: dict[tuple, float], part: float) -> dict[tuple, float]:
    """A solution of the program between two."""
    return {k: (1 - part) * a.get(k, 0.0) + part * b.get(k, 0.0) for k in {**a, **b}}


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Configurations (counts by length) and how often each is used; together they hold exactly the histogram."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        n[length] += count
    whole = []
    if n[capacity]:
        whole = [(np.eye(1, capacity + 1, capacity, dtype=np.int64)[0], int(n[capacity]))]
        n[capacity] = 0
    if not n.any():
        return whole
    weight, bound = np.zeros(capacity + 1), 0.0
    seed: dict[tuple, float] = {}
    for counts, copies in best_fit(n, capacity):
        key = tuple((int(k), int(counts[k])) for k in np.flatnonzero(counts))
        seed[key] = seed.get(key, 0.0) + copies
    best = rounded(n, seed, capacity)
    for k in range(PASSES):
        share, weight = one_pass(n, weight, STEP * FINER**k, LEARN * FINER**k, capacity)
        bound = max(bound, dual_bound(n, weight, capacity))
        for part in MIXTURES:
            found = rounded(n, mixed(share, seed, part), capacity)
            if sum(c for _, c in found) < sum(c for _, c in best):
                best = found
        if sum(c for _, c in best) - np.ceil(bound - 1e-6) <= min(len(share), max(1, GAP * bound)):
            break
    return whole + best


def places(solution: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Runs of ranks: rank r of a length in [rank, rank + copies) goes to sequence ``base + r - rank`` at ``offset``."""
    runs, base = [], 0
    taken: dict[int, int] = {}
    for counts, copies in solution:
        offset = 0
        for length in np.flatnonzero(counts)[::-1]:
            for _ in range(int(counts[length])):
                rank = taken.get(int(length), 0)
                runs.append((int(length), rank, base, offset))
                taken[int(length)] = rank + copies
                offset += int(length)
        base += copies
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 4)
    return {"key": (cols[:, 0] << 48) + cols[:, 1], "rank": cols[:, 1], "base": cols[:, 2], "offset": cols[:, 3]}


# --- tokens


@lru_cache(1)
def _encoder(vocabulary: str):
    """Ids of the byte-level vocabulary. Both libraries give the same ids; tiktoken is five times as fast. A text that
    spells a special token is left to tokenizers, which decides what it means."""
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(f"{vocabulary}.tiktoken"), "rb"))}
    fast = tiktoken.Encoding("bytes", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public.path(f"{vocabulary}.json"))

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" in text:
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """Token pieces of each row: (doc_id, piece, start, length, ids_crc32). A null or empty text is the end id alone; null or repeated ids are cut row by row; other
    columns are ignored, whatever their names; an empty table gives no rows. A text of any length is encoded whole, in one task."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(value.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    for col, x in zip(rows, (key, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``capacity`` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty; null or
    repeated ids are packed row by row; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(pieces_of(docs, doc_id, text, capacity, vocabulary, end_id), "pieces")
    salts = 4 * partitions(spark)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = scratch.save(counts, "counts")  # capacity x salts rows at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = places(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).cast("bigint").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(runs["key"], (length << 48) + rank, "right") - 1
            sequence = runs["base"][at] + rank - runs["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(runs["offset"][at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
