"""Operators over the corpus: packing, archives, joins, line deduplication, chats, components."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, jaccard, line_dedup, packing, queries, warc
from leafmill.llm.common import Scratch, look_up
from leafmill.llm.components import components, local_roots

from ..compare import same
from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_warc", "op4_jaccard", "op5_lines", "op10_chat"])
def test_twin(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name])


def exact_tokens():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers():
    """The faster library gives the same ids on random texts of all planes, blanks, digits and marks."""
    rng, encode, tokens = random.Random(9), packing._encoder("byte_bpe_50k"), exact_tokens()
    kinds = [lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t\r\x0b\u00a0\u2003\u3000"), lambda: chr(rng.randrange(0x80, 0xD800)), lambda: chr(rng.randrange(0xE000, 0x110000)), lambda: rng.choice("'s 't're 0123456789."), lambda: chr(rng.randrange(0x300, 0x370)), lambda: chr(rng.randrange(0, 32))]
    texts = ["".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 60))) for _ in range(4000)] + ["".join(k() for _ in range(3000)) for k in kinds]
    for text, ids in zip(texts, tokens.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == ids.ids, text


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a<|endoftext|>b"), (-4, "word " * 5000), (None, "x"), (-2, "")], "doc_id long, text string"))
    got = packing.pack(docs.withColumn("length", F.lit("clash"))).toPandas()
    tokens = exact_tokens()
    want = []
    for r in docs.collect():
        ids = np.array([*tokens.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    key = lambda t: tuple((x is None or x != x, 0 if x is None or x != x else x) for x in t)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))) == sorted(map(key, want))
    got = got.sort_values(["sequence_id", "offset"])
    sums = got.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 1024 and (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert len(sums) <= -(-got["length"].sum() // 1024) * 1.03 + 2
    assert packing.pack(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configurations_cover_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 129, 40), rng.integers(1, 200, 40), strict=True)}
    solution = packing.solve(histogram, 128)
    total = sum(counts * copies for counts, copies in solution)
    assert {k: int(total[k]) for k in np.flatnonzero(total)} == histogram
    assert all((counts * np.arange(129)).sum() <= 128 for counts, _ in solution)
    plain = packing.best_fit(np.array([histogram.get(k, 0) for k in range(129)]), 128)
    assert sum(c for _, c in solution) <= sum(c for _, c in plain)
    assert packing.solve({}, 128) == []


PAGES = [(1, "http://a/", "<p>x"), (2, "http://b/\r\nX: y", "<p>x"), (3, None, None), (4, "u", ""), (5, "ü", "ä" * 5000), (5, "ü", "ä" * 5000), (6, "http://c/", "<p>x"), (None, "http://n/", "<p>x"), (None, None, "only here")]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 7) for p in PAGES], "page_id long, url string, html string, payload int")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder, roll_bytes=500).collect()
    assert sum(r["n_records"] for r in manifest) == len(PAGES) and len(manifest) > 2
    assert not (tmp_path / "a/_temporary").exists()
    got = warc.read(spark, folder).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"]) for r in got) == sorted((p[0] is None, p[0] or 0, len((p[2] or "").encode())) for p in PAGES)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None}
    assert (kinds[1], kinds[2], kinds[6], kinds[3], kinds[4], kinds[5]) == (("revisit", 6), ("revisit", 6), ("response", None), ("revisit", 4), ("response", None), ("response", None))
    for r in got:
        if r["record_type"] == "response":
            assert warc.base32_sha1(r["payload"]) == r["payload_digest"]
    again = f"file://{tmp_path}/b"
    second = warc.write(pages, again, roll_bytes=500).collect()
    assert {r["name"]: r["sha1"] for r in manifest} == {r["name"]: r["sha1"] for r in second}
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0 if warc.write(pages.where("false"), f"file://{tmp_path}/c") else True
    ids, targets = [], []
    import gzip

    for f in sorted((tmp_path / "a").glob("*.warc.gz")):
        for head in gzip.decompress(f.read_bytes()).decode(errors="replace").split("\r\n"):
            ids += [head.partition(": ")[2]] if head.startswith("WARC-Record-ID: ") else []
            targets += [head.partition(": ")[2]] if head.startswith("WARC-Refers-To: ") else []
    assert len(ids) == len(set(ids)) == len(PAGES) and set(targets) <= set(ids) and targets
    big = warc.write(pages, f"file://{tmp_path}/d", min_revisit_bytes=100)
    assert big.count() and {r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/d").collect()} == {"response"}


def test_broken_archive_is_noticed():
    import io

    good = warc.record(1, "u", b"payload", None)
    assert next(warc.parse(io.BytesIO(warc.member(good))))["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(io.BytesIO(warc.member(good.replace(b"payload\r", b"pAyload\r")))))


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: brute.shingles(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    want = brute.components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def varied(seed):
    """Groups whose members are alike in chains and stars, short texts, and passages that texts share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    base = [some(rng.choice([1, 3, 5, 6, 8, 9, 12, 20, 40, 80])) for _ in range(25)]
    docs = [*base, [], []]
    hub, passage = some(120), some(60)
    for _ in range(60):
        c = list(hub)
        for _ in range(rng.randint(0, 5)):
            c[rng.randrange(len(c))] = rng.choice(words)
        docs += [c, some(rng.randint(5, 60)) + passage]
    for _ in range(80):
        c = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            c.insert(rng.randrange(len(c) + 1), rng.choice(words))
        docs.append(c)
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("block", [8, 8192])
def test_jaccard_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = varied(3)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (None, texts[0], 1), (5, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(5)
    found = jaccard.link(docs).collect()
    assert len(found) == len(rows)
    sets = {i: brute.shingles(t) for i, t, _ in rows if i is not None}
    want = brute.components(sets)
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]) for r in found if r["doc_id"] is not None)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_jaccard_of_nothing(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_alike_sets_share_a_key(percent):
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.choice([1, 2, 4, 5, 7, 9, 13, 30, 100, 400]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        k = int(len(a) * (100 - percent) / 100 * rng.random())
        b = np.unique(np.concatenate([rng.permutation(a)[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)]))
        if len(b) and jaccard.linked(a, b, percent):
            assert np.intersect1d(jaccard.keys_of(a, percent), jaccard.keys_of(b, percent)).size
            x, y = (np.frombuffer(jaccard.bitmap_of(v), np.uint64) for v in (a, b))
            assert jaccard.may_link(x, y, len(a), len(b), percent)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n):
    c = list(text)
    for _ in range(n):
        k = rng.randrange(len(c) + 1)
        if rng.random() < 0.4 or not c:
            c.insert(k, rng.choice("abä"))
        elif rng.random() < 0.5:
            del c[k % len(c)]
        else:
            c[k % len(c)] = rng.choice("abä")
    return "".join(c)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = [(a, changed(rng, a, rng.randint(0, 4))) for a in ("".join(rng.choice("abä") for _ in range(rng.randint(0, 12))) for _ in range(500))]
    a, b = F.col("a"), F.col("b")
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within(a, b, threshold).alias("w"), line_dedup.may_be_within(a, b, threshold).alias("m")).collect():
        near = distance(r["a"], r["b"]) <= threshold
        assert r["w"] == near and (r["m"] or not near)


def test_trimmed_lines(spark):
    """Long lines, of which trimming leaves little, all, or nothing, are judged as Spark's own edit distance does."""
    rng = random.Random(8)
    lines = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 400, 1500) for letters in ("a", "abä😀", "abcdefgh ")]
    rows = [(a, changed(rng, a, rng.randint(0, 4))) for a in lines for _ in range(25)] + [(a, a) for a in lines]
    a, b = F.col("a"), F.col("b")
    judged = spark.createDataFrame(rows, "a string, b string").select(*[(line_dedup.within(a, b, t) == (F.levenshtein(a, b) <= t)).alias(f"t{t}") for t in (1, 2, 3)])
    assert judged.where("not (t1 and t2 and t3)").count() == 0 and judged.where("t1 is null or t2 is null or t3 is null").count() == 0


@pytest.mark.parametrize(("threshold", "heavy"), [(1, 2), (1, 32), (2, 32)])
def test_lines_against_all_pairs(spark, monkeypatch, threshold, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(threshold * 10 + heavy)
    stock = ["".join(rng.choice("abä") for _ in range(rng.randint(3, 14))) for _ in range(40)]
    docs = [(i, "\n".join(changed(rng, rng.choice(stock), rng.randint(0, 2)) for _ in range(rng.randint(0, 7))), "c") for i in range(50)]
    docs += [(100, None, "c"), (None, "abab\nabab", "c"), (101, "", "c"), (7, docs[7][1], "c")]
    order = sorted({(i if i is not None else 2**62, p, line) for i, t, _ in docs if t is not None for p, line in enumerate(t.split("\n"))})
    gone, seen = set(), []
    for i, p, line in order:
        if len(line) >= 3:
            if any(abs(len(line) - len(x)) <= threshold and distance(line, x) <= threshold for x in seen):
                gone.add((i, p))
            if line not in seen:
                seen.append(line)
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string, n_lines string"), min_chars=3, threshold=threshold).collect()
    texts = {i: t for i, t, _ in docs}
    assert len(got) == len(docs)
    for r in got:
        t = texts[r["doc_id"]]
        key = r["doc_id"] if r["doc_id"] is not None else 2**62
        assert r["text"] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (key, p) not in gone))
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def found_near(lines, spark, threshold):
    """Pairs of texts that near_pairs() gives, those of its groups included."""
    of = {(r["h1"], r["h2"]): r["line"] for r in lines.collect()}
    pairs, groups = line_dedup.near_pairs(lines, Scratch(spark, "test"), threshold)
    got = {frozenset((of[r["a1"], r["a2"]], of[r["b1"], r["b2"]])) for r in pairs.collect()}
    held = {}
    for r in groups.collect() if groups is not None else ():
        held.setdefault(r["key"], []).append((of[r["h1"], r["h2"]], r["own"]))
    return got | {frozenset((a, b)) for rows in held.values() for a, own in rows if own for b, _ in rows if a != b}


@pytest.mark.parametrize(("threshold", "heavy"), [(1, 8), (2, 8), (3, 8), (1, 2), (2, 2)])
def test_heavy_keys_are_refined_at_any_threshold(spark, monkeypatch, threshold, heavy):
    """Of lines with one long part in common no key over HEAVY forms pairs, and all near pairs are found."""
    most, whole = [], line_dedup._meet
    monkeypatch.setattr(line_dedup, "_meet", lambda keys: most.append(keys.groupBy("key").count().agg(F.max("count")).first()[0]) or whole(keys))
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(threshold)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    head, tail = some(20), some(20)
    texts = [head + some(12) for _ in range(15)] + [some(9) + tail for _ in range(15)] + [f"{head}{k:03d}{tail}" for k in range(0, 999, 41)]
    texts += [changed(rng, rng.choice(texts[:60]), rng.randint(1, threshold + 1)) for _ in range(40)]
    texts = sorted(set(texts))
    lines = line_dedup.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20)
    want = {frozenset((a, b)) for k, a in enumerate(texts) for b in texts[k + 1 :] if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold}
    assert found_near(lines, spark, threshold) == want and len(want) > 10
    assert all(m is None or m <= heavy for m in most)


def test_lines_of_one_pattern_form_few_pairs(spark, monkeypatch):
    """Lines with one number amid common text: pairs grow about as the lines do, not with their square."""
    made, whole = [], line_dedup._meet
    monkeypatch.setattr(line_dedup, "_meet", lambda keys: made.append(whole(keys)) or made[-1])
    counts = []
    for m in (300, 1200):
        made.clear()
        rng = random.Random(m)
        texts = sorted({f"visitor number {rng.randrange(10**6):06d} came to the page of the mill" for _ in range(m)})
        lines = line_dedup.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20)
        got = found_near(lines, spark, 1)
        stems = {}
        for t in texts:
            for k in range(15, 21):
                stems.setdefault((k, t[:k] + t[k + 1 :]), []).append(t)
        assert got == {frozenset((a, b)) for group in stems.values() for a in group for b in group if a < b}
        counts.append(sum(x.count() for x in made))
    assert counts[1] <= 8 * max(counts[0], 300)


@pytest.mark.parametrize("rows", [0, 3, line_dedup.SIEVE_ROWS])
def test_sieve_of_any_size_gives_the_same_lines(spark, monkeypatch, rows):
    """A sieve too small for what is wanted lets all through, and the join decides: the SQL twin holds at every size."""
    monkeypatch.setattr(line_dedup, "SIEVE_ROWS", rows)
    monkeypatch.setattr(line_dedup, "HEAVY", 2)
    same(queries.op5_lines(spark, SF), queries.SQL["op5_lines"])


def test_sieve_never_loses_a_row(spark):
    wanted = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    got = line_dedup.sifted(rows, "h", wanted, "maybe").where("maybe").select("id").collect()
    assert {r["id"] for r in got} >= set(range(0, 5000, 7)) and len(got) < 1000
    assert line_dedup.sifted(rows, "h", wanted.where("false"), "maybe").where("maybe").count() == 0


def test_dedup_with_clashing_columns(spark):
    rows = [(1, "the same line of twenty and more", 5, "h", [1], 7, "k"), (2, "the same line of twenty and more", 6, "h", None, 8, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, text_hash string, gone array<int>, _gone int, row string")
    got = {r["doc_id"]: tuple(r) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: (*rows[0], 1, 0), 2: (2, "", *rows[1][2:], 1, 1)}


TURNS = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "a<|end|>\n<|turn:user|>\nb\\p\\b\\"), (1, 1, "assistant", "<"), (1, None, "sys|>tem", "|><|x|>"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 5, "assistant", "ü日"), (2, 1, "assistant", "")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn int, role string, text string, loss string").withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_turns(rows)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for c in (1, 2, None):
        own = sorted((t for t in TURNS if t[0] == c), key=order)
        assert sorted((t["role"], t["text"]) for t in got[c]["turns"]) == sorted((t[2] or "", t[3] or "") for t in own)
        assert "".join(sorted(got[c]["loss_texts"])) == "".join(sorted(t[3] or "" for t in own if t[2] == "assistant"))
    for r in made.collect():
        for x in r["loss"]:
            assert r["formatted"][x["start"] : x["start"] + x["length"]].count("<|") == 0
    assert chat.format_turns(rows.where("false")).count() == 0


def test_ties_are_ordered_by_what_is_said(spark):
    """Equal turn and role: the order is that of the texts, as in the SQL twin, not that of their escaped forms."""
    rows = spark.createDataFrame([(1, 0, "user", "="), (1, 0, "user", "<|"), (1, 0, "user", "\\")], "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_turns(rows)
    assert [t["text"] for t in chat.read_back(made).first()["turns"]] == ["<|", "=", "\\"]


def test_loss_places(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn int, role string, text string, loss string").withColumn("parts", chat.text_part(F.col("text")))
    plain = lambda s: s.replace("\\p", "<|").replace("\\b", "\\")
    for r in chat.format_turns(rows).collect():
        said = [plain(r["formatted"][x["start"] : x["start"] + x["length"]]) for x in r["loss"]]
        assert sorted(said) == sorted(t[3] or "" for t in TURNS if t[0] == r["conv_id"] and t[2] == "assistant")


def test_typed_parts(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "i.png", 280, 57, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3), ("odd", "plain", None, None, None, None, None), ("image", None, None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts {chat.PARTS}")
    r = chat.format_turns(rows).first()
    assert r["formatted"] == "<|turn:user|>\nsee \\p<|image:1|><|audio:2|><|document:3|>plain<|image:5|><|end|>\n<|turn:assistant|>\n<|end|>\n"
    assert [(a["turn"], a["part"], a["kind"], a["uri"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "i.png", 30), (0, 2, "audio", "a.wav", 63), (0, 3, "document", "d.pdf", 2304), (0, 5, "image", None, 1)]
    assert r["attachment_tokens"] == 30 + 63 + 2304 + 1
    back = rows.where("role = 'user'").select(chat.read_parts(chat.visit(F.col("parts")), chat.attachments(F.col("parts"))).alias("p")).first()["p"]
    assert [(p["kind"], p["text"], p["uri"], p["tokens"]) for p in back] == [("text", "see <|", None, 0), ("image", None, "i.png", 30), ("audio", None, "a.wav", 63), ("document", None, "d.pdf", 2304), ("text", "plain", None, 0), ("image", None, None, 1)]


@pytest.mark.parametrize("name", ["op5_lines", "op10_chat"])
def test_native_plans_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (None, 3), (-4, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "t")).collect()}
    kept = [(a, b) for a, b in links if a is not None and a != b]
    nodes, roots = local_roots(np.array([a for a, _ in kept]), np.array([b for _, b in kept]))
    assert got == dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert components(df.where("false"), Scratch(spark, "t")).count() == 0


def test_look_up_keeps_every_row(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"))
    right = left.where("k is not null and k % 2 = 1").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    got = look_up(left, right, ["k"], "n", 3000, F.col("id"))
    assert got.count() == 3000 and got.where("k % 2 = 1 and v <> k * 10 or k % 2 = 1 and v is null").count() == 0
    assert look_up(left, right, ["k"], "n", 3000, F.col("id"), "inner").count() + look_up(left, right, ["k"], "n", 3000, F.col("id"), "anti").count() == 3000


def test_chat_parts_over_seams(spark):
    """Texts cut into parts anywhere, also within control strings, are formatted as the whole text is, and read back exactly."""
    rng = random.Random(17)
    bits = ["<", "|", "<|", "|>", "end", "<|end|>\n", "<|turn:assistant|>\n", "<|image:0|>", "\\", "\\p", "b", "x", "", "\n"]
    rows, whole = [], []
    for conv in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 6)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        role = rng.choice(["user", "assistant"])
        parts = [(rng.choice(["text", None, "note"]), p or rng.choice([None, ""]), None, None, None, None, None) for p in pieces]
        parts.insert(rng.randrange(len(parts) + 1), None)
        rows.append((conv, 0, role, parts))
        whole.append((conv, 0, role, text))
    split = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    plain = spark.createDataFrame(whole, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    made, want = ({r["conv_id"]: r for r in chat.format_turns(x).collect()} for x in (split, plain))
    assert {c: (r["formatted"], r["loss"]) for c, r in made.items()} == {c: (r["formatted"], r["loss"]) for c, r in want.items()}
    read = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(split)).collect()}
    for conv, _, role, text in whole:
        assert [(t["role"], t["text"]) for t in read[conv]["turns"]] == [(role, text)]
        assert read[conv]["loss_texts"] == ([text] if role == "assistant" else [])


def test_chat_parts_between_attachments(spark):
    image = ("image", None, "u", 28, 28, None, None)
    said = lambda t: ("text", t, None, None, None, None, None)
    rows = [(1, 0, "user", [said("<"), said(""), said("|"), image, said("|end|>\n"), said("<")]), (2, 0, "user", [said("<"), image, said("|"), said("<"), said("|"), said("|")])]
    made = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}"))
    got = {r["conv_id"]: [(p["kind"], p["text"]) for p in r["p"]] for r in chat.read_back(made).join(made.select("conv_id", "formatted", "attachments"), "conv_id").select("conv_id", chat.read_parts(F.substring("formatted", F.lit(len("<|turn:user|>\n") + 1), F.length("formatted") - len("<|turn:user|>\n") - len(chat.END)), F.col("attachments")).alias("p")).collect()}
    assert got == {1: [("text", "<|"), ("image", None), ("text", "|end|>\n<")], 2: [("text", "<"), ("image", None), ("text", "|<||")]}
