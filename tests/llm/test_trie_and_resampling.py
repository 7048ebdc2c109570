"""The prefix trie against sets of Python tuples, with fingerprints weak enough to collide, and importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries, resampling, trie
from leafmill.llm.common import Scratch

from ..compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_resampling", "op13_prefix_trie"])
def test_twin(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name])


def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids(p), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_conversations(seed: int) -> dict[int, list[tuple[str, str]]]:
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", ""]), rng.choice(["a", "b", "ü", "", "longer text"]))
    convs: dict[int, list] = {}
    for c in rng.sample(range(-50, 10_000), 40):
        base = rng.choice([*convs.values(), []])
        convs[c] = base[: rng.randrange(len(base) + 1)] + [turn() for _ in range(rng.choice([0, 0, 1, 2, 6]))]
    return convs


def rows_of(spark, convs):
    rows = [(c, k, r, t, "clash") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, depth string")


@pytest.mark.parametrize(("seed", "primes", "block"), [(0, trie.PRIMES, trie.BLOCK), (1, trie.PRIMES, 2), (2, (2, 3), 3), (3, (2, 1), 2)])
def test_trie(spark, seed, primes, block):
    """The last two have fingerprints of so few values that different prefixes share most of them."""
    convs = random_conversations(seed)
    scratch = Scratch(spark, "test")
    turns = scratch.save(trie.ordered(rows_of(spark, convs), scratch), "turns")
    ids = spark.createDataFrame([(c,) for c in [*convs, *list(convs)[:3]]] + [(None,)], "conv_id long")
    got = [tuple(r) for r in trie.build(turns, scratch, ids, primes, block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(convs)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 5, "user", "x" * 300_000), (2, None, "user", "first"), (2, 7, "", ""), (3, 1, "z", "tie b"), (3, 1, "z", "tie a"), (4, 1, "z", "tie a"), (4, 2, "z", "tie b")]
    got = {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    convs = {1: [("user", "first"), ("", ""), ("", ""), ("user", "x" * 300_000)], 2: [("user", "first"), ("", "")], 3: [("z", "tie a"), ("z", "tie b")], 4: [("z", "tie a"), ("z", "tie b")]}
    assert got == plain_trie(convs)
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert trie.prefix_trie(empty).count() == 0
    with pytest.raises(TypeError, match="conv_id"):
        trie.prefix_trie(empty.withColumn("conv_id", F.lit("x")))


def test_long_conversation_over_many_tasks(spark):
    """One conversation of most rows is numbered and scanned in several tasks."""
    convs = {7: [("u", str(k % 11)) for k in range(3000)], 9: [("u", str(k % 11)) for k in range(2000)] + [("u", "else")], 8: []}
    convs.pop(8)
    scratch = Scratch(spark, "test")
    turns = scratch.save(trie.ordered(rows_of(spark, convs), scratch), "turns")
    assert turns.where("conv_id = 7").agg(F.max("position"), F.count("*"), F.countDistinct("position")).first() == (3000, 3000, 3000)
    got = {(r["conv_id"], r["depth"]): r for r in trie.build(turns, scratch, block=128).collect()}
    assert len(got) == 3002 and got[7, 2000]["n_convs"] == 2 and got[7, 2001]["n_convs"] == 1 and got[9, 2001]["parent_conv_id"] == 7
    assert got[7, 0]["saved_tokens"] == sum(len(t) for _, t in convs[7][:2000]) and got[7, 0]["n_leaves"] == 2 and got[7, 2000]["n_children"] == 2


# --- resampling


def plain_resampling(docs, targets, most=2, buckets=10_000, least=20, percent=25, seed=7):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in targets for b in found(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in docs:
        own = found(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


ODD = [(None, "a b"), (1, None), (2, ""), (3, "Ä-b c7 d" * 5000), (4, "x" * 200_000), (5, "same words here"), (5, "same words here"), (6, "!!!")]


@pytest.mark.parametrize(("most", "buckets", "least"), [(1, 50, 1), (2, 10_000, 3), (3, 70_000, 3)])
def test_resampling(spark, most, buckets, least):
    rng = random.Random(most)
    docs = [*ODD, *((100 + i, " ".join(rng.choice(["Alpha", "beta", "ü", "x1", "q"]) for _ in range(rng.randrange(0, 30)))) for i in range(60))]
    targets = ["alpha beta", None, "x1 x1 ü", ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    wanted = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resampling.resample(frame, wanted, most=most, buckets=buckets, least_words=least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resampling(docs, targets, most, buckets, least)
    assert resampling.resample(frame.where("false"), wanted).count() == 0 and resampling.resample(frame, wanted.where("false")).count() == len(docs)


def test_resampling_favours_the_target(spark):
    """Half of the documents speak of what the target speaks of. Smoothing leaves them a mean gain of about 1.4 more, odds of about four to one."""
    rng = random.Random(3)
    vocab = {k: [f"{k}{i}" for i in range(200)] for k in "st"}
    docs = [(i, " ".join(rng.choice(vocab["st"[i % 2]]) for _ in range(60))) for i in range(400)]
    wanted = spark.createDataFrame([(" ".join(rng.choice(vocab["t"]) for _ in range(60)),) for _ in range(50)], "text string")
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), wanted).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 101)) and sum(r["doc_id"] % 2 for r in got) >= 70


def test_resampling_keeps_types_of_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y")], "doc_id string, text string")
    assert {r["doc_id"] for r in resampling.resample(docs, docs).collect()} == {"a", "b"}
