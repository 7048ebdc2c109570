"""Exact Jaccard self-join on word shingles: size-banded tiles, hashed bitmaps, then sorted-array intersection.

1. Each document becomes the sorted distinct 64-bit hashes of its shingles. Equal sets are one node.
2. Sizes fall into bands. Sets that link differ in at most H elements, H given by the band. Elements are dealt by hash into more than H
   parts, so two sets that link have a part alike. A part's hash, with the band, is the key of a tile: only members of a tile
   can link, and to share a common passage isn't enough. A set with so few non-empty parts that this proof fails also gets keys by prefix:
   its smallest hashes, of which two such sets that link share one.
3. Within a tile, bit counts of hashed bitmaps bound the overlap from above; what passes is compared exactly.
4. Tiles of up to SMALL members give all pairs. In larger ones, members whose bitmaps allow a link are connected by a forest; what it connects
   is a family. One pair a node is verified first, and joins most of a family; pairs of a family are then compared only where they are
   still in different components, each pair once, in blocks by size band. The members of a family's largest component are never dealt out to meet each
   other, so they are repeated only as often as there are blocks of members outside it. So each pair that could link is compared, refuted by its bound, or already connected: no link is lost.

Keys are shuffled as packed blocks, one row for each task's batch and destination.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up, partitions, prepare
from .components import components
from .textkit import U64, Texts, distinct, mix

SIZE, PERCENT = 5, 80
SMALL = 8
#: Members of one block of a large tile or family at most, on average, and elements of their sets in a family's block.
BLOCK, BLOCK_ELEMENTS = 8192, 1 << 22

KEY = np.dtype([("key", "<u4"), ("at", "<u2")])


@lru_cache(4)
def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; neighbours of a set that may link with it lie in its band or the next."""
    low = [1]
    while low[-1] < top:
        x = low[-1]
        low.append(max(x + 1, -(-x * 100 // percent), x * 3 // 2))
    return np.array(low, np.int64)


def parts_of(band: int, percent: int) -> tuple[int, int]:
    """(H, number of parts) of a band: 8 % more parts than H + 1, so that some may be empty."""
    low = bands(percent)
    h = 2 * (int(low[band + 1]) - 1) * (100 - percent) // (100 + percent)
    return h, h + 1 + -(-8 * (h + 1) // 100) + 1


def keys_of(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Tile keys of one set, given as its sorted hashes."""
    low, n = bands(percent), len(values)
    own = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for band in (own, own + 1):
        if band > own and 100 * n < percent * int(low[band]):
            continue
        h, parts = parts_of(band, percent)
        part = ((values >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)  # sorted, as the values are
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix(values + U64(band)), first)
        out.append(mix(sums + part[first].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(band)))
        if len(first) <= h:
            out.append(mix(values[: n - -(-percent * n // 100) + 1] ^ U64(0xA5A5A5A5A5A5A5A5 + band)))
    return np.concatenate(out)


def bitmap_of(values: np.ndarray, each: int = 2) -> bytes:
    """At least ``each`` bits an element, a power of two in all."""
    bits = max(64, 1 << int(each * len(values) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(values & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
    """Whether the bound from the bitmaps allows a link: a bit of one that the other lacks is an element that it lacks."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    most = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= percent * (na + nb - most)


def sets_of(array: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        words = Texts(array, lower=True).words()
        return distinct(*words.shingles(size))


def signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums of differently mixed hashes."""

    def total(of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(of) + 1, U64)
        np.cumsum(of, out=sums[1:])
        return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)

    return total(mix(values ^ U64(0x51ED))), total(mix(values + U64(0xB0B)))


def node_table(docs: DataFrame, size: int, percent: int, dests: int) -> DataFrame:
    """Two kinds of rows: of each document its node (doc_id, hi, lo, n, bitmap), and blocks of keys (dest, nodes, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        schema = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("bitmap", pa.binary()), ("dest", pa.int32()), ("nodes", pa.binary()), ("keys", pa.binary())])
        for batch in batches:
            values, first = sets_of(batch.column(1), size)
            rows, n = batch.num_rows, np.diff(first)
            hi, lo = signatures(values, first)
            maps, new, keys = [], [], []
            for i in range(rows):
                ident = (int(hi[i]), int(lo[i]))
                if not n[i] or ident in seen:
                    maps.append(None)
                    continue
                seen.add(ident)
                own = values[first[i] : first[i + 1]]
                maps.append(bitmap_of(own))
                new.append(i)
                keys.append(keys_of(own, percent))
            nothing = [pa.nulls(rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(maps, pa.binary()), *nothing], schema=schema)
            for low in range(0, len(new), 1 << 16):
                some, own = np.array(new[low : low + (1 << 16)]), keys[low : low + (1 << 16)]
                every = np.concatenate(own)
                who = np.repeat(np.arange(len(own)), [len(k) for k in own])
                dest = (every % U64(dests)).astype(np.int32)
                order = np.argsort(dest, kind="stable")
                cuts = np.searchsorted(dest[order], np.arange(dests + 1))
                blocks: tuple[list, ...] = ([], [], [])
                for d in range(dests):
                    at = order[cuts[d] : cuts[d + 1]]
                    if len(at):
                        owners, local = np.unique(who[at], return_inverse=True)
                        packed = np.empty(len(at), KEY)
                        packed["key"], packed["at"] = every[at] >> U64(32), local
                        for col, x in zip(blocks, (d, lo[some[owners]].tobytes(), packed.tobytes()), strict=True):
                            col.append(x)
                k = len(blocks[0])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())), pa.array(blocks[0], pa.int32()), pa.array(blocks[1], pa.binary()), pa.array(blocks[2], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, hi bigint, lo bigint, n int, bitmap binary, dest int, nodes binary, keys binary")


def tile_pairs(tiles: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From (tile, member) pairs sorted by tile, then member: all pairs of members of small tiles, and the members of each large one."""
    begin = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
    count = np.diff(np.concatenate([begin, [len(tiles)]]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, SMALL + 1):
        at = begin[count == k]
        for i in range(k):
            for j in range(i + 1, k):
                left.append(member[at + i])
                right.append(member[at + j])
    pairs = np.unique(np.concatenate(left) << 32 | np.concatenate(right))
    return pairs >> 32, pairs & 0xFFFFFFFF, [member[begin[t] : begin[t] + count[t]] for t in np.flatnonzero(count > SMALL)]


def candidates(blocks: DataFrame, dests: int) -> DataFrame:
    """Rows (a, b) of pairs of small tiles, and rows (tile, members) of large tiles. Members are the low halves of signatures; two sets
    that share theirs are both meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tile", pa.int64()), ("members", pa.binary())])
        nodes, keys, at, total, dest = [], [], [], 0, 0
        for batch in batches:
            for d, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                dest = d
                nodes.append(np.frombuffer(x.as_buffer(), np.int64))
                packed = np.frombuffer(y.as_buffer(), KEY)
                keys.append(packed["key"])
                at.append(packed["at"].astype(np.int64) + total)
                total += len(nodes[-1])
        if not total:
            return
        every, inverse = np.unique(np.concatenate(nodes), return_inverse=True)
        both = np.unique(np.concatenate(keys).astype(U64) << U64(32) | inverse[np.concatenate(at)].astype(U64))
        a, b, large = tile_pairs(both >> U64(32), (both & U64(0xFFFFFFFF)).astype(np.int64))
        for low in range(0, len(a), 1 << 16):
            x, y = every[a[low : low + (1 << 16)]], every[b[low : low + (1 << 16)]]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], schema=schema)
        for t, span in enumerate(large):
            for low in range(0, len(span), 1 << 14):
                some = every[span[low : low + (1 << 14)]]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([(dest << 32) + t]), pa.array([some.tobytes()], pa.binary())], schema=schema)

    return blocks.repartitionById(dests, "dest").mapInArrow(run, "a bigint, b bigint, tile bigint, members binary")


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, an, bn, abits, bbits) those whose bitmaps allow a link, with the bound as ``close``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            an, bn = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = [may_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), int(p), int(q), percent) for x, y, p, q in zip(batch.column(4), batch.column(5), an, bn, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "an", "bn", "abits", "bbits").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (a, b, linked): the exact comparison of each pair's shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, fx), (y, fy) = sets_of(batch.column(2), size), sets_of(batch.column(3), size)
            found = [linked(x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("atext")).hint("merge"), "a")
    return left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("btext")).hint("merge"), "b").select("a", "b", "atext", "btext").mapInArrow(run, "a bigint, b bigint, linked boolean")


def related(tiles: DataFrame, percent: int) -> DataFrame:
    """Of blocks of large tiles (rows tile, x, y, mine, node, n, bits): pairs (a, b) that connect all members whose bitmaps allow a link
    in a block. Members already connected in the block are passed over, so it gives fewer pairs than it has members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        n, node, mine = group["n"].to_numpy(np.int64), group["node"].to_numpy(), group["mine"].to_numpy()
        maps = [np.frombuffer(b, np.uint64) for b in group["bits"]]
        words = min(map(len, maps))
        m = np.stack([folded(b, words) for b in maps])
        inner = group["x"].iloc[0] == group["y"].iloc[0]
        left, right = (np.arange(len(n)),) * 2 if inner else (np.flatnonzero(mine), np.flatnonzero(~mine))
        joined, out = np.arange(len(n)), []
        for i in left:
            rest = right[right > i] if inner else right
            rest = rest[(joined[rest] != joined[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            if len(rest):
                most = np.minimum(n[i] - np.bitwise_count(m[i] & ~m[rest]).sum(1, dtype=np.int64), n[rest] - np.bitwise_count(m[rest] & ~m[i]).sum(1, dtype=np.int64))
                for j in rest[100 * most >= percent * (n[i] + n[rest] - most)]:
                    if joined[j] != joined[i]:
                        out.append((max(node[i], node[j]), min(node[i], node[j])))
                        joined[joined == joined[j]] = joined[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return tiles.groupBy("tile", "x", "y").applyInPandas(run, "a bigint, b bigint").distinct()


def tile_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (tile, node) dealt into pairs of blocks of each tile, with sizes and bitmaps."""
    count = members.groupBy("tile").agg(F.count("*").alias("w"), F.ceil(F.count("*") / BLOCK).cast("int").alias("c"))
    own = look_up(members, count, ["tile"], "w", members.count(), F.col("node"), "inner")
    own = own.join(nodes.select("node", "n", "bits").hint("merge"), "node").withColumn("at", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return own.select("tile", F.least("at", "j").alias("x"), F.greatest("at", "j").alias("y"), (F.col("at") <= F.col("j")).alias("mine"), "node", "n", "bits")


def compared(tiles: DataFrame, size: int, percent: int) -> DataFrame:
    """Of blocks of families (rows family, band, kind, x, y, mine, node, n, root, text): links (a, b) that connect different roots.

    Pairs of one root are passed over, also once a link of this block has joined their roots; so a block gives fewer links than it has members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        node, n, root = group["node"].to_numpy(), group["n"].to_numpy(np.int64), group["root"].to_numpy().copy()
        values, first = sets_of(pa.array(group["text"], pa.string()), size)
        own = [values[first[i] : first[i + 1]] for i in range(len(node))]
        words = max(1, 1 << int(8 * n.max() - 1).bit_length() >> 6)
        maps = np.stack([_spread(v, words) for v in own])
        inner = group["kind"].iloc[0] == 0 and group["x"].iloc[0] == group["y"].iloc[0]
        mine = group["mine"].to_numpy()
        left, right = (np.arange(len(node)),) * 2 if inner else (np.flatnonzero(mine), np.flatnonzero(~mine))
        out = []
        for i in left:
            rest = right[right > i] if inner else right
            rest = rest[(root[rest] != root[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            if not len(rest):
                continue
            most = np.minimum(n[i] - np.bitwise_count(maps[i] & ~maps[rest]).sum(1, dtype=np.int64), n[rest] - np.bitwise_count(maps[rest] & ~maps[i]).sum(1, dtype=np.int64))
            for j in rest[100 * most >= percent * (n[i] + n[rest] - most)]:
                if root[j] != root[i] and linked(own[i], own[j], percent):
                    out.append((max(node[i], node[j]), min(node[i], node[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return tiles.groupBy("family", "band", "kind", "x", "y").applyInPandas(run, "a bigint, b bigint").distinct()


def _spread(values: np.ndarray, words: int) -> np.ndarray:
    flags = np.zeros(words * 64, np.uint8)
    flags[(values & U64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """The exact comparison of two sorted arrays."""
    if not len(p) or not len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def outside_largest(members: DataFrame) -> DataFrame:
    """``members`` (node, root, family) with ``minor``: whether a member is outside of its family's largest component."""
    roots = members.groupBy("family", "root").agg(F.count("*").alias("k"))
    largest = roots.groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.sum("k").alias("w"))
    return look_up(members, largest, ["family"], "w", members.count(), F.col("node"), "inner").select("node", "root", "family", (F.col("root") != F.col("largest")).alias("minor"))


def family_blocks(members: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Members of families dealt into blocks by size band and hash; every two blocks of bands that can link, but for two of the largest
    component, form one tile of compared().

    ``members``: (node, root, family, minor). A member is repeated for each block that its own meets."""
    low = [int(x) for x in bands(percent)[:64]]
    band = sum((F.when(F.col("n") >= x, 1).otherwise(0) for x in low[1:]), F.lit(0))
    own = scratch.save(members.join(nodes.select("node", "n"), "node").withColumn("band", band), "banded")
    blocks = lambda of: F.coalesce(F.greatest(F.ceil(F.count_if(of) / BLOCK), F.ceil(F.sum(F.when(of, F.col("n"))) / BLOCK_ELEMENTS)).cast("int"), F.lit(0))
    count = own.groupBy("family", "band").agg(blocks(F.col("minor")).alias("minors"), blocks(~F.col("minor")).alias("majors"), F.count("*").alias("w"))
    near = lambda by, name: count.select("family", (F.col("band") + by).alias("band"), F.col("minors").alias(f"minors_{name}"), F.col("majors").alias(f"majors_{name}"))
    count = scratch.save(count.join(near(-1, "above"), ["family", "band"], "left").join(near(1, "below"), ["family", "band"], "left"), "blocks")
    own = look_up(own, count, ["family", "band"], "w", own.count(), F.col("node"), "inner")
    at = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    lowest = lambda by: F.get(F.array(*map(F.lit, low)), F.col("band") + by)
    # The smallest sizes of a band don't reach the band above, nor the largest the band below.
    above, below = 100 * F.col("n") >= percent * lowest(1), percent * F.col("n") <= 100 * (lowest(0) - 1)
    upto = lambda c, when: F.when((F.col(c) > 0) & when, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda b, k, x, y, mine: F.struct(b.cast("int").alias("band"), F.lit(k).alias("kind"), x.alias("x"), y.alias("y"), mine.alias("mine"))
    here, true, false, minor = F.col("band"), F.lit(True), F.lit(False), F.col("minor")
    every = F.concat(
        F.transform(upto("minors", minor), lambda j: tile(here, 0, F.least(at, j), F.greatest(at, j), at <= j)),
        F.transform(upto("majors", minor), lambda j: tile(here, 1, at, j, true)),
        F.transform(upto("minors", ~minor), lambda j: tile(here, 1, j, at, false)),
        F.transform(upto("minors_above", minor & above), lambda j: tile(here, 2, at, j, true)),
        F.transform(upto("minors_below", minor & below), lambda j: tile(here - 1, 2, j, at, false)),
        F.transform(upto("majors_above", minor & above), lambda j: tile(here, 3, at, j, true)),
        F.transform(upto("minors_below", ~minor & below), lambda j: tile(here - 1, 3, j, at, false)),
        F.transform(upto("minors_above", ~minor & above), lambda j: tile(here, 4, at, j, true)),
        F.transform(upto("majors_below", minor & below), lambda j: tile(here - 1, 4, j, at, false)),
    )
    return own.select("family", "node", "n", "root", F.explode(every).alias("t")).select("family", "t.*", "node", "n", "root").join(texts.hint("merge"), "node")


def node_texts(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, text) of the rows of ``needed`` (node, rep, hi, lo): a text of document ``rep`` that has the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = signatures(*sets_of(batch.column(3), size))
            same = (hi == batch.column(1).to_numpy()) & (lo == batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["node", "text"]).filter(pa.array(same))

    # Repeated rows collapse where the join has put them; the hint keeps the same plan at every size.
    found = docs.join(needed.hint("merge"), docs["doc_id"] == needed["rep"]).groupBy("doc_id", "node", "hi", "lo", F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"))
    return found.select("node", "hi", "lo", "text").mapInArrow(run, "node bigint, text string")


def members_of(tiles: DataFrame) -> DataFrame:
    """(tile, lo) of each member of the large tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low = np.frombuffer(members.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), tile)), pa.array(low)], ["tile", "lo"])

    return tiles.mapInArrow(run, "tile bigint, lo bigint")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links, itself included.

    Null and empty texts, and texts without words, have no shingles and no links. Rows with a null id take no part in links
    and have a null component. Rows that repeat an id are compared text by text. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch, dests = Scratch(spark, "jaccard"), partitions(spark)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Merge hints below keep one plan at every size; what is broadcast on small inputs would not be on large ones.
    made = scratch.save(node_table(own, size, percent, dests), "made")
    rows = scratch.save(made.where("dest is null").select("doc_id", "hi", "lo", "n"), "rows")
    # A bitmap stands with the first row of its set in each task; all of them are equal.
    sets = made.where("dest is null and n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bitmap").alias("bits"), F.count("*").alias("k"))
    nodes = scratch.save(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = scratch.save(candidates(made.where("dest is not null").select("dest", "nodes", "keys"), dests), "found")
    scratch.drop(made)

    def side(s: str) -> DataFrame:
        return nodes.select(F.col("lo").alias(f"{s}_lo"), F.col("node").alias(s), F.col("n").alias(f"{s}n"), F.col("bits").alias(f"{s}bits")).hint("merge")

    pairs = found.where("a is not null").select(F.col("a").alias("a_lo"), F.col("b").alias("b_lo")).distinct()
    pairs = bounded(pairs.join(side("a"), "a_lo").join(side("b"), "b_lo"), percent)
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    members = members_of(found.where("tile is not null").select("tile", "members")).join(nodes.select("lo", "node").hint("merge"), "lo").select("tile", "node")
    tied = scratch.save(related(tile_blocks(scratch.save(members, "members"), nodes), percent), "tied")
    families = scratch.save(components(tied, scratch), "families").select("node", F.col("root").alias("family"))
    pairs = scratch.save(pairs.unionByName(tied).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = scratch.save(node_texts(own, needed.join(nodes.select("node", "rep", "hi", "lo"), "node"), size), "texts")

    # One pair of each node, with its smallest neighbour, connects most of a group.
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    few = both.groupBy("a").agg(F.min("b").alias("b"))
    few = few.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = scratch.save(verified(few, texts, size, percent), "first")
    scratch.free()
    roots = scratch.save(components(first.where("linked"), scratch), "roots")

    # Then whatever is still apart: families with several roots, block by block, and the other pairs.
    def root_of(df: DataFrame, node: str, name: str, of: DataFrame = roots) -> DataFrame:
        return df.join(of.select(F.col("node").alias(node), F.col("root").alias(name)).hint("merge"), node, "left").withColumn(name, F.coalesce(name, node))

    inside = root_of(families, "node", "root")
    mixed = inside.groupBy("family").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("family")
    inside = scratch.save(inside.join(mixed, "family").select("node", "root", "family"), "inside")
    joined = compared(family_blocks(outside_largest(inside), nodes, texts, percent, scratch), size, percent).withColumn("linked", F.lit(True))
    apart = root_of(root_of(pairs, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    own_family = inside.select("node", F.col("family").alias("root"))
    apart = root_of(root_of(apart, "a", "fa", own_family), "b", "fb", own_family).where("fa <> fb").select("a", "b")
    apart = apart.join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = scratch.save(verified(apart, texts, size, percent).unionByName(joined), "second")
    if second.where("linked").isEmpty():
        final = roots
    else:
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second.where("linked").select("a", "b"))
        final = scratch.save(components(links, scratch), "roots")
    scratch.drop(found, pairs, texts, inside)

    ends = final.join(nodes.select("node", "rep"), "node")
    least = ends.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("w"))
    named = look_up(ends, least, ["root"], "w", nodes.count(), F.col("node"), "inner").select("node", "component_id")
    known = scratch.save(nodes.join(named, "node", "left").select("hi", "lo", "k", F.coalesce("component_id", "rep").alias("component_id")), "known")
    scratch.keep_only(rows, known)
    out = look_up(rows.withColumn("hi", F.when(F.col("n") > 0, F.col("hi"))), known, ["hi", "lo"], "k", rows.count(), F.coalesce("doc_id", F.lit(0)))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))
