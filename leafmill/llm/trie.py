"""A prefix trie of conversations as a table of nodes: each distinct sequence of first turns that some conversation begins with.

Turns are numbered by a range sort. Prefixes get polynomial fingerprints, which numpy scans sum up block by block of a conversation; prefixes of
one depth and fingerprint are candidates for one node. Every candidate is then held against its group's representative, the member with the
smallest id: the last turn, by SHA-256 of role and text, and the group of the prefix before. What differs is split off and what hangs
below it as well, until nothing differs; by induction over depth the groups are then the distinct prefixes.

A representative of a node represents all nodes below it on its path, so each conversation owns one unbroken stretch of its path, down to
its end. Sums over a subtree are therefore what the representative's own stretch has from there on, plus the whole stretches of all other members: one
aggregation over members, with no pass per level. No step holds a conversation or a node's members in one task: conversations are cut into
blocks, and hot keys are broadcast or salted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, look_up, need_whole_numbers, partitions, prepare

#: Turns of a conversation that one task scans as one block.
BLOCK = 1 << 12
#: Two primes below 2 to the 31 and a base for each: a fingerprint is a pair of sums, in one number of 62 bits.
PRIMES, BASES = (2**31 - 1, 2**31 - 19), (1_000_003, 998_244_353)
#: Characters of a text by which turns tied in number and role are ordered; those alike so far are ordered by digest.
TIE_CHARS = 64
#: Conversation ids of a node are put together from ranges of two to the power of so many ids.
ID_BITS = 12

ROWS = "conv_id bigint, position bigint, digest binary, n_bytes bigint"


def content_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """For each row, the first row of its run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def ordered(turns: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, digest, n_bytes) of each turn: its number in the conversation, from 1, and digest and UTF-8 bytes of what it says.

    Turns are ordered by ``turn``, null first, then role and the beginning of the text, then digest. Null roles and texts are empty; rows without a conv_id
    belong to no conversation and are left out. Each task numbers a range of the sorted rows; the few conversations that go on in the next range continue there.
    """
    spark = turns.sparkSession
    prepare(spark)
    need_whole_numbers(turns, conv_id)
    own = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    slim = own.select("_conv", "_turn", "_role", F.substring("_text", 1, TIE_CHARS).alias("_head"), content_digest(F.col("_role"), F.col("_text")).alias("_digest"), F.octet_length("_text").cast("bigint").alias("_bytes"))
    order = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_head"), F.col("_digest")]
    placed = slim.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("_conv", "_digest", "_bytes")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = _runs(conv)
            local = np.arange(len(conv)) - first + 1
            if conv[0] == last:
                local[first == 0] += done
            last, done = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(local), batch.column(1), batch.column(2), pa.array(np.full(len(conv), part, np.int32))], ["conv_id", "position", "digest", "n_bytes", "_part"])

    local = scratch.save(placed.mapInArrow(number, f"{ROWS}, _part int"), "local")
    ends = local.groupBy("conv_id", "_part").agg(F.max("position").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("_n")
    # Of each range only the first conversation can have begun before it.
    going_on = ends.select("conv_id", "_part", before.alias("_before")).where("_before > 0")
    return local.join(F.broadcast(going_on), ["conv_id", "_part"], "left").select("conv_id", (F.col("position") + F.coalesce("_before", F.lit(0))).alias("position"), "digest", "n_bytes")


def fingerprints(rows: DataFrame, scratch: Scratch, primes: tuple[int, int] = PRIMES, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, position, digest, n_bytes) with ``f``, the fingerprint of the turns up to this one, and ``pf``, of those before."""
    spark = rows.sparkSession
    dealt = rows.select("conv_id", "position", "digest", "n_bytes", F.xxhash64("digest").alias("_h"), F.floor((F.col("position") - 1) / block).alias("_block"))
    dealt = dealt.repartition(partitions(spark), "conv_id", "_block").sortWithinPartitions("conv_id", "_block", "position")
    powers = np.ones((2, block), np.int64)
    for k in range(2):
        for i in range(1, block):
            powers[k, i] = int(powers[k, i - 1]) * BASES[k] % primes[k]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0, 0]
        for batch in batches:
            conv, position, h, number = (batch.column(k).to_numpy() for k in (0, 1, 4, 5))
            if not len(conv):
                continue
            first = _runs(conv, number)
            blocks, which = np.unique(number, return_inverse=True)
            columns = []
            for k, p in enumerate(primes):
                ahead = np.array([pow(BASES[k], int(b) * block, p) for b in blocks], np.int64)[which]
                term = h % p * powers[k, (position - 1) % block] % p * ahead % p
                sums = np.cumsum(term)
                sums = sums - sums[first] + term[first]
                if (conv[0], number[0]) == last:
                    sums[first == 0] += carried[k]
                sums %= p
                carried[k] = int(sums[-1])
                columns += [pa.array(sums), pa.array(term)]
            last = (conv[-1], number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), *columns], ["conv_id", "position", "digest", "n_bytes", "_block", "s1", "t1", "s2", "t2"])

    scanned = scratch.save(dealt.mapInArrow(scan, f"{ROWS}, _block bigint, s1 bigint, t1 bigint, s2 bigint, t2 bigint"), "scanned")
    upto = Window.partitionBy("conv_id").orderBy("_block")
    # What the whole blocks of a conversation before this one sum up to: a row for each whole block.
    before = scanned.where(F.col("position") % block == 0).select("conv_id", (F.col("_block") + 1).alias("_block"), *[(F.sum(f"s{k}").over(upto) % primes[k - 1]).alias(f"o{k}") for k in (1, 2)])
    out = scanned.join(before, ["conv_id", "_block"], "left")
    upto_here = [F.col(f"s{k}") + F.coalesce(f"o{k}", F.lit(0)) for k in (1, 2)]
    joint = lambda a, b: (a % primes[0]) * F.lit(1 << 31) + b % primes[1]
    f = joint(*upto_here)
    pf = joint(*[s - F.col(f"t{k}") + primes[k - 1] for k, s in enumerate(upto_here, 1)])
    return out.select("conv_id", F.col("position").alias("depth"), "digest", "n_bytes", f.alias("f"), pf.alias("pf"))


KEY = ["depth", "f", "tag"]


def represented(members: DataFrame, total: int) -> DataFrame:
    """Members (conv_id, depth, f, tag, pf, ptag, digest, n_bytes) with their group's size and representative, and whether they differ from it."""
    least = F.min(F.struct("conv_id", "digest", "pf", "ptag"))
    groups = members.groupBy(*KEY).agg(F.count("*").alias("_k"), least.alias("_least"))
    groups = groups.select(*KEY, "_k", F.col("_k").alias("n_convs"), F.col("_least.conv_id").alias("rep"), F.struct("_least.digest", "_least.pf", "_least.ptag").alias("_want"))
    found = look_up(members, groups, KEY, "_k", total, F.col("conv_id"), "inner")
    return found.withColumn("differs", F.struct("digest", "pf", "ptag") != F.col("_want")).drop("_want")


def verified(members: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """Members in groups of which all agree with their representative. Rounds end because each leaves what agrees and splits what doesn't."""
    now = members.withColumn("tag", F.lit(0).cast("bigint")).withColumn("ptag", F.lit(0).cast("bigint"))
    for k in range(1 << 30):
        checked = scratch.save(represented(now, total), "checked")
        bad = checked.where("differs")
        if bad.isEmpty():
            return checked
        # Collisions of fingerprints. Below one, all groups of the path get another tag, the same for paths that differ alike.
        spots = bad.groupBy("conv_id").agg(F.sort_array(F.collect_list("depth")).alias("_spots"))
        retagged = lambda tag, depth: F.when(F.get("_spots", F.lit(0)) <= depth, F.xxhash64(tag, F.lit(k), F.filter("_spots", lambda d: d <= depth))).otherwise(tag)  # noqa: B023, E731
        now = checked.drop("n_convs", "rep", "differs").join(spots, "conv_id", "left").withColumn("ptag", retagged(F.col("ptag"), F.col("depth") - 1)).withColumn("tag", retagged(F.col("tag"), F.col("depth"))).drop("_spots")
    raise AssertionError("rounds without end")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of ends (rep, depth, conv_id): ids in ascending order, comma-joined. Ids of a range of numbers are put together first, and a task
    then feeds its hash with one range after another, so a node at which a great part of all conversations ends is never held as a whole."""
    some = ends.groupBy("rep", "depth", F.shiftright("conv_id", ID_BITS).alias("_range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("_ids"))
    dealt = some.repartition(partitions(ends.sparkSession), "rep", "depth").sortWithinPartitions("rep", "depth", "_range").select("rep", "depth", "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for rep, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last == (rep, depth):
                    digest.update(b",")
                else:
                    if digest:
                        done.append((*last, digest.hexdigest()))
                    last, digest = (rep, depth), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["rep", "depth", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, digest.hexdigest())], ["rep", "depth", "ends_sha256"])

    return dealt.mapInArrow(run, "rep bigint, depth bigint, ends_sha256 string")


def build(rows: DataFrame, scratch: Scratch, conversations: DataFrame | None = None, primes: tuple[int, int] = PRIMES, block: int = BLOCK) -> DataFrame:
    """Nodes of rows (conv_id, position, digest, n_bytes), numbered from 1 without gaps: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has the conv_id of each conversation, repeats and nulls ignored, for those without turns; without it those of ``rows`` are taken. No
    conversations give no nodes, not even a root. ``saved_tokens`` counts UTF-8 bytes of texts that later members share with the first.
    """
    scanned = fingerprints(rows, scratch, primes, block)
    ids = (rows if conversations is None else conversations).where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    roots = ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("f"), F.lit(-1).cast("bigint").alias("pf"))
    members = scratch.save(scanned.unionByName(roots), "members")
    total = members.count()
    checked = verified(members, scratch, total)

    nodes = checked.where("conv_id = rep").select("conv_id", *KEY, "pf", "ptag", "n_convs", "n_bytes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("ptag").alias("tag")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("_saved", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn("_leaf", F.col("n_children").isNull().cast("bigint")).withColumn("_block", F.floor(F.col("depth") / block))
    nodes = scratch.save(nodes, "nodes")

    # The stretch that each conversation owns, block by block.
    here = Window.partitionBy("conv_id", "_block").orderBy("depth")
    blocks = nodes.groupBy("conv_id", "_block").agg(F.sum("_saved").alias("_s"), F.sum("_leaf").alias("_l"), F.min("depth").alias("_top"))
    whole, upto = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("_block")
    blocks = blocks.select("conv_id", "_block", F.min("_top").over(whole).alias("_top"), *[x for c in ("_s", "_l") for x in (F.sum(c).over(whole).alias(f"{c}_all"), (F.sum(c).over(upto) - F.col(c)).alias(f"{c}_before"))])
    within = nodes.withColumn("_s_here", F.sum("_saved").over(here) - F.col("_saved")).withColumn("_l_here", F.sum("_leaf").over(here) - F.col("_leaf"))
    within = within.join(blocks.drop("_top"), ["conv_id", "_block"])
    rest = lambda c: F.col(f"{c}_all") - F.col(f"{c}_before") - F.col(f"{c}_here")
    own = within.select("conv_id", *KEY, "pf", "ptag", "n_convs", "n_children", rest("_s").alias("_s"), rest("_l").alias("_l"))

    # Members of a node that don't represent it count with all they own; ``_top`` is how many such nodes a conversation has.
    stretch = blocks.groupBy("conv_id").agg(F.max("_top").alias("_top"), F.max("_s_all").alias("_s_all"), F.max("_l_all").alias("_l_all")).where("_top > 0")
    others = look_up(checked.where("conv_id <> rep").select("conv_id", "rep", "depth"), stretch, ["conv_id"], "_top", total, F.col("depth"), "inner")
    others = others.groupBy(F.col("rep").alias("conv_id"), "depth").agg(F.sum("_s_all").alias("_s_more"), F.sum("_l_all").alias("_l_more"))

    last = checked.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("rep", "depth").alias("rep"))
    ends = ends_digest(last.select("rep", "depth", "conv_id")).withColumnRenamed("rep", "conv_id")

    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("tag").alias("ptag"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = look_up(own, parents.withColumnRenamed("n_children", "_k"), ["depth", "pf", "ptag"], "_k", total, F.col("conv_id"))
    out = out.join(others, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        (F.col("_l") + F.coalesce("_l_more", F.lit(0))).alias("n_leaves"),
        (F.col("_s") + F.coalesce("_s_more", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of the conversations as they stand; see ordered() and build() for nulls, ties and empty tables. Other columns are ignored, whatever their names;
    repeated rows are turns of their own; ids must be whole numbers, else TypeError."""
    scratch = Scratch(turns.sparkSession, "trie")
    return build(scratch.save(ordered(turns, scratch, conv_id, turn, role, text), "turns"), scratch)
