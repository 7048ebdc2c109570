"""A byte-level convolutional network in numpy that scores whole documents for quality.

Each filter is a table of 256 weights per byte of its width, so a convolution is a sum of look-ups. Filters slide over every
byte of the document; their rectified outputs are max-pooled over overlapping chunks, each chunk's pooled vector gives a logit, and the
mean over the chunks of a document, with a bias, gives one probability.

Training takes at most TRAIN_ROWS labelled rows, chosen by a hash of their id, and all chunks of each; scoring covers every byte of
every document. Labels, language, source and id never enter a score. Without rows of both labels there is nothing to learn: such a
network has no opinion, scores every text 0.5 and rejects none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textkit import Texts

WIDTH = 5
FILTERS = 24
#: A chunk is two neighbouring blocks; so chunks overlap by one block.
BLOCK = 192
TRAIN_ROWS = 1500
#: Up to so many sampled ids are broadcast to the join with their texts; a greater sample is joined as Spark sees fit.
BROADCAST_ROWS = 20_000
#: Chunks whose convolutions are held at once in training.
STEP_CHUNKS = 256
EPOCHS = 14
RATE = 0.02
SEED = 7


class Network:
    def __init__(self, filters: int = FILTERS, width: int = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.3, (width, 256, filters)).astype(np.float32)
        self.b = np.zeros(filters, np.float32)
        self.v = rng.normal(0, 0.3, filters).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.fitted = False

    @property
    def width(self) -> int:
        return len(self.w)

    def convolved(self, data: np.ndarray) -> np.ndarray:
        """Outputs at each position that has ``width`` bytes."""
        n = len(data) - self.width + 1
        out = self.w[0][data[:n]]
        for k in range(1, self.width):
            out += self.w[k][data[k : k + n]]
        return out

    def scores(self, texts: Texts, step: int = 1 << 18) -> np.ndarray:
        """Probability of each text. A text counts as followed by ``width`` zero bytes, so empty texts have one window."""
        if not self.fitted:
            return np.full(texts.n, 0.5)
        sizes = np.diff(texts.at)
        padded = np.zeros(texts.at[-1] + self.width * texts.n, np.uint8)
        shift = np.repeat(np.arange(texts.n) * self.width, sizes)
        padded[np.arange(texts.at[-1]) + shift] = texts.data
        windows = sizes + 1  # first bytes of windows, of which the last holds padding only
        begin = texts.at[:-1] + np.arange(texts.n) * self.width
        blocks = -(-windows // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(texts.n), blocks)
        start = begin[owner] + (np.arange(first[-1]) - first[owner]) * BLOCK
        end = np.minimum(start + BLOCK, begin[owner] + windows[owner])
        pooled = np.empty((len(start), len(self.v)), np.float32)
        k = 0
        while k < len(start):
            to = max(k + 1, int(np.searchsorted(start, start[k] + step)))
            z = self.convolved(padded[start[k] : end[to - 1] + self.width - 1])
            # Between a text's end and the next start stand windows of padding; odd segments take them up.
            cuts = np.stack([start[k:to], end[k:to]], 1).ravel() - start[k]
            pooled[k:to] = np.maximum.reduceat(np.concatenate([z, z[-1:]]), cuts, axis=0)[::2]
            k = to
        pooled = np.maximum(pooled + self.b, 0)
        last = np.zeros(len(pooled), bool)
        last[first[1:] - 1] = True
        both = pooled.copy()
        both[:-1] = np.where(last[:-1, None], pooled[:-1], np.maximum(pooled[:-1], pooled[1:]))
        single = blocks == 1
        chunk = ~last
        chunk[first[:-1][single]] = True
        logit = both @ self.v
        n = np.bincount(owner[chunk], minlength=texts.n)
        total = np.bincount(owner[chunk], logit[chunk], minlength=texts.n)
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + float(self.c[0]))))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray, starts: list[range]) -> list[np.ndarray]:
        """Of the mean weighted log loss, by w, b, v and c. That of a max-pooled output goes to the bytes of the window that won.

        Outputs of STEP_CHUNKS chunks are held at a time; of all others only what won."""
        size = 2 * BLOCK + self.width - 1
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        begin = np.concatenate([np.array(s, np.int64) for s in starts])

        def bytes_of(some: slice) -> np.ndarray:
            """A row per chunk; windows beyond the text's end hold zeros only and equal the one kept for it."""
            out = np.zeros((len(begin[some]), size), np.uint8)
            for row, i, s in zip(out, owner[some].tolist(), begin[some].tolist(), strict=True):
                piece = texts[i][s : s + size]
                row[: len(piece)] = np.frombuffer(piece, np.uint8)
            return out

        n = size - self.width + 1
        steps = [slice(k, k + STEP_CHUNKS) for k in range(0, len(begin), STEP_CHUNKS)]
        wons, tops = [], []
        for some in steps:
            data = bytes_of(some)
            z = self.w[0][data[:, :n]]
            for k in range(1, self.width):
                z += self.w[k][data[:, k : k + n]]
            wons.append(z.argmax(1))
            tops.append(np.take_along_axis(z, wons[-1][:, None], 1)[:, 0])
        won, top = np.concatenate(wons), np.concatenate(tops) + self.b
        act = np.maximum(top, 0)
        count = np.bincount(owner, minlength=len(texts))
        logit = np.bincount(owner, act @ self.v, minlength=len(texts)) / count + self.c[0]
        d = (1 / (1 + np.exp(-logit)) - labels) * weight / len(texts)
        dl = (d / count)[owner].astype(np.float32)
        dact = dl[:, None] * self.v * (top > 0)
        grads = [np.zeros_like(self.w), dact.sum(0), act.T @ dl, np.array([d.sum()], np.float32)]
        f = np.broadcast_to(np.arange(len(self.v)), won.shape)
        for some in steps:
            data = bytes_of(some)
            for k in range(self.width):
                np.add.at(grads[0][k], (np.take_along_axis(data, won[some] + k, 1), f[some]), dact[some])
        return grads

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 48, seed: int = SEED) -> "Network":
        """Adam on the log loss over all chunks of the texts, which rarer labels enter with more weight."""
        if len(set(labels.tolist())) < 2:
            return self
        self.fitted = True
        rng = np.random.default_rng(seed)
        starts = [chunk_starts(len(t)) for t in texts]
        parts = [self.w, self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        t = 0
        share = labels.mean() if len(labels) else 0.5
        weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) ** 0.5
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
                grads = self.gradients([texts[i] for i in at], labels[at], weight[at], [starts[i] for i in at])
                t += 1
                for p, g, mm, ss in zip(parts, grads, m, s, strict=True):
                    mm *= 0.9
                    mm += 0.1 * g
                    ss *= 0.99
                    ss += 0.01 * g * g
                    p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(ss / (1 - 0.99**t)) + 1e-6)
                self.w *= 1 - 1e-4
        return self


def chunk_starts(n: int) -> range:
    """First bytes of all chunks of a text of n bytes; a short one is filled up with zeros later."""
    return range(0, max(1, n + 1 - BLOCK), BLOCK)


def is_held_out(doc_id):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most ``rows`` labelled rows outside the held-out third, which reach the driver. Rows without a label, an id or a
    document don't count, and a repeated id counts row by row; without rows of both labels the network stays without an opinion."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~is_held_out(doc_id))
    chosen = chosen.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))

    # The texts of the sampled rows, and no others, reach the driver.
    sample = own.join(F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen, "_id").select(F.col("_id").cast("bigint").alias("id"), F.col("_label").cast("double").alias("label"), F.encode(F.coalesce("_text", F.lit("")), "UTF-8").alias("text"))
    found = sample.orderBy("id", "label", "text").limit(rows).collect()
    net = Network()
    if found:
        net.fit([bytes(r["text"]) for r in found], np.array([r["label"] for r in found]))
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts have the score of no bytes.

    Null ids are kept and not held out; repeated ids are scored row by row; other columns are ignored; an empty table gives no rows. Every byte of a text of any
    length counts.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.scores(Texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = own.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, net: Network, text: str = "text", bar: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, whose score is at least ``bar``. Null and empty texts have the score of no bytes; repeated
    rows stay or go each for itself, with one outcome; an empty table stays empty."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(net.scores(Texts(batch.column(at))) >= bar))

    return docs.mapInArrow(run, docs.schema)
