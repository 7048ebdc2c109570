"""Importance resampling towards a target corpus, on hashed runs of words.

Features of a text are its runs of one to ``RUN`` words. Words get integer ids from a dictionary of the batch, runs are tuples of ids, and the bytes of each
distinct tuple are put together and hashed once; counts of tuples are joined back to documents and summed by bucket. Each document's buckets
are stored, packed, so that texts are read once; the totals by bucket, as many as there are buckets, give every bucket's gain, and a document's weight is
the mean of the gains of its features. Noise from a hash of the id makes taking the best scores a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, prepare
from .textkit import NOT_ALNUM, Texts

RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
FEATURES = "n_words bigint, n_features bigint, buckets binary"


class Distinct:
    """Distinct words of a batch of texts (lower-cased): ``ids`` has the number of each word in order, ``words`` the bytes of each number."""

    def __init__(self, texts: pa.Array):
        found = Texts(texts, lower=True).words(NOT_ALNUM)
        self.first, self.count = found.first, found.count
        data = found.texts.data.tobytes()
        # Words as slices of the batch's bytes: Arrow numbers them exactly, without a Python object for each.
        ends = np.empty(2 * len(found.start) + 1, np.int64)
        ends[:-1:2], ends[1::2], ends[-1] = found.start, found.end, len(data)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = pieces.take(pa.array(np.arange(0, len(ends) - 1, 2))).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: list[bytes] = coded.dictionary.to_pylist()


def runs(ids: np.ndarray, first: np.ndarray, n_words: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tuples of ``size`` ids, which tuple each run is, number of the text of each run). Runs stay within a text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = len(ids) - size + 1
    if total <= 0:
        return np.zeros((0, size), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = owner[:total] == owner[size - 1 :]
    # A tuple is numbered by its first ids, then by that number and the next id, so keys never exceed words times runs.
    key = ids[:total][whole]
    head = np.arange(n_words)[:, None]
    for k in range(1, size):
        joint, key = np.unique(key * n_words + ids[k : k + total][whole], return_inverse=True)
        head = np.column_stack([head[joint // n_words], joint % n_words])
    return head, key, owner[:total][whole]


def bucket_table(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, number of the text of each feature, bucket of each feature)."""
    own = Distinct(texts)
    owners, found = [], []
    for size in range(1, most + 1):
        tuples, which, owner = runs(own.ids, own.first, max(len(own.words), 1), size)
        words = own.words
        hashed = np.fromiter((zlib.crc32(b" ".join([words[i] for i in t])) for t in tuples.tolist()), np.int64, len(tuples)) % buckets
        owners.append(owner)
        found.append(hashed[which])
    return own.count, np.concatenate(owners), np.concatenate(found)


def features(docs: DataFrame, doc_id: str, text: str, most: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of each row; ``buckets`` packs the bucket of each feature as a little-endian number of 32 or, if that holds them, 16 bits, sorted."""
    prepare(docs.sparkSession)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, owner, bucket = bucket_table(batch.column(1), most, buckets)
            order = np.argsort(owner * buckets + bucket, kind="stable")
            counts = np.bincount(owner, minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bucket[order].astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(counts, pa.int64()), packed.cast(pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return own.mapInArrow(run, f"doc_id {own.schema[0].dataType.simpleString()}, {FEATURES}")


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; each task sums up what it reads, so ``buckets`` rows of sums reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                sums += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to that in the source, each count one higher; floors."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features, 0 for none."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([int(gain[np.frombuffer(p.as_buffer(), kind)].sum()) for p in batch.column(3)], np.int64)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            weight = np.floor_divide(sums, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, ..., rank) by score, ties to the smaller id: range-sorted, then numbered within partitions and by what lies before each
    partition, so no task sees more than its range."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    placed = scored.withColumn("_from", F.spark_partition_id()).repartitionByRange(partitions(scored.sparkSession), *order, "_from").sortWithinPartitions(*order).drop("_from")
    placed = scratch.save(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.select("*", F.shiftrightunsigned("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_within"))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row for each partition of the range sort.
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_within") + F.col("_before") + 1).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_features, weight, score, rank; ``rank`` is null for rows that aren't drawn.

    Null texts have no features and weigh 0, as do empty ones. Repeated rows are scored and drawn each for itself; rows tied in score and id are
    ranked in any order. Ids of any type keep it; rows without one are scored as if it were empty and come first among ties. Other columns are
    ignored, whatever their names. Without target texts gains come from the source alone; an empty table gives no rows. A row is one text,
    whole, in one task.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    found = scratch.save(features(docs, doc_id, text, most, buckets), "features")
    wanted = features(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_target")), "_id", "_target", most, buckets)
    gain = gains(totals(found, buckets), totals(wanted, buckets))
    scored = scratch.save(weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    scratch.drop(found)
    able = scored.where(F.col("n_words") >= least_words)
    draws = percent * able.count() // 100
    drawn = ranked(able, scratch).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
