"""Connected components of a graph in DataFrames: alternating large-star and small-star steps.

Each step is an aggregation and a look-up by node, so a node with any number of links is spread over tasks. Tasks contract what
they hold to stars before each step, which makes chains short. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up, prepare


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and for each the smallest node that these links connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        differ = p != q
        if not differ.any():
            return nodes, nodes[root]
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def contract(links: DataFrame) -> DataFrame:
    """The links of each partition replaced by links of the same nodes to their smallest: (a, b) with a > b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            nodes, root = local_roots(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
            a, b = nodes[nodes != root], root[nodes != root]
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """From links (a, b): a row (node, root) for each node with a link, where root is the smallest node of its component.

    Loops, repeated links and either direction are fine; links with a null end are ignored; no links give no rows.
    """
    prepare(links.sparkSession)
    ends = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    now = scratch.save(contract(ends), "links")
    before = None
    while True:
        n, s = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if not n or before == (n, s):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct().unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = (n, s)
        # Large star: neighbours above a node are linked with the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        large = look_up(both, least, ["a"], "k", 2 * n, F.col("b")).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), "large")
        # Small star: a node and its neighbours below are linked with the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = look_up(large, least, ["a"], "k", n, F.col("b")).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new = scratch.save(contract(small).distinct(), "links")
        scratch.drop(now, large, free=False)
        now = new
