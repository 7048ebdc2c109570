"""Operators on whole texts: rules, licences, classifier, decontamination, URL filters."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontam, license_scan, quality_cnn, quality_rules, queries, url_tree
from leafmill.llm.textkit import Texts, distinct

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "a b c d e a b c d e", "x\n\nx\n x\nx", "\x00 ß ü", "MIT license\nmit-License apache license", "the GNU general public LICENSE", "# * $ % & | < >", "日本 語 " * 30, "w " * 3000, "\r\x0b\x0c\t", "one\ntwo\none\ntwo\none"]


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, null ids, and columns whose names clash with results."""
    rows = [(i, t, "en", 1, 0.5, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "en", 1, 0.5, "x"), (None, "free text", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, score double, labels string")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize(("run", "model"), [(quality_rules.judge, brute.rule_counts), (license_scan.scan, brute.license_base)])
def test_counts_against_brute_force(spark, run, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (docs, odd_docs(spark)):
        texts = {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}
        got = by_id(run(frame))
        for i, t in texts.items():
            want = model(t)
            assert {k: got[i][k] for k in want} == want, (i, t and t[:80])
        assert run(frame).count() == frame.count()
        assert run(frame.where("false")).count() == 0


def test_rule_order_does_not_change_the_verdict(spark):
    array = pa.array([*ODD, *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())], pa.string())
    want = quality_rules.cascade(array, quality_rules.RULES) >= 0
    for seed in range(4):
        rules = list(quality_rules.RULES)
        random.Random(seed).shuffle(rules)
        assert ((quality_rules.cascade(array, tuple(rules)) >= 0) == want).all()
    rows = spark.createDataFrame([(x,) for x in array.to_pylist()], "text string")
    profiled = quality_rules.profile(rows, quality_rules.RULES)
    chosen = quality_rules.ordered(profiled)
    assert {r.name for r in chosen} == {r.name for r in quality_rules.RULES}
    assert [r.name for r in quality_rules.ordered(quality_rules.profile(rows.repartition(3), quality_rules.RULES))] == [r.name for r in chosen]


def test_the_order_is_that_of_marginal_gain():
    """A rule that is dear by itself comes early once another has found its facts, and what is rejected already counts for nothing."""
    rule = lambda name, *needs: quality_rules.Rule(name, needs, lambda f: f.n_words < 0)
    rules = (rule("a", "words"), rule("b", "words", "hashes", "repeat"), rule("c", "symbols"), rule("d", "hashes"))
    row = lambda failed, n: {"failed": failed, "n": n} | {k: 100.0 * n * (5 if k == "repeat" else 1) for k in quality_rules.COSTS}
    got = quality_rules.ordered([row(0b0000, 50), row(0b0001, 20), row(0b0101, 25), row(0b1000, 5)], rules)
    assert [r.name for r in got] == ["a", "d", "c", "b"]
    assert [r.name for r in quality_rules.ordered([row(0b0010, 9), row(0b0100, 4)], rules, ("repeat",))][0] == "b"


def test_rejected_texts_are_not_looked_at_again(spark):
    junk, good = ["# # # $"] * 300, ["a clean line of some twelve quite ordinary words that differ all over, no. %d" % k for k in range(100)]
    array, seen = pa.array(junk + good), []
    got = quality_rules.cascade(array, quality_rules.RULES, seen=seen)
    assert (got[:300] == 0).all() and (got[300:] == -1).all()
    assert seen == [400] + [100] * (len(quality_rules.RULES) - 1)
    facts = quality_rules.Facts(Texts(array))
    for rule in quality_rules.RULES:
        rule.rejects(facts)
    keep = np.arange(400) % 7 < 3
    cut, anew = facts.of(keep), quality_rules.Facts(Texts(array.filter(pa.array(keep))))
    for rule in quality_rules.RULES:
        assert (rule.rejects(cut) == rule.rejects(anew)).all()
    assert (cut.hashes == anew.hashes).all() and (cut.words.start == anew.words.start).all() and all((a == b).all() for a, b in zip(cut.lines, anew.lines, strict=True))


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = by_id(quality_rules.judge(docs))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert {i for i in texts if got[i]["kept"]} == {i for i, t in texts.items() if brute.is_kept(t)}
    kept = quality_rules.accepted(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(r["text"] for r in odd_docs(spark).collect() if brute.is_kept(r["text"]))


def test_clean_documents_pass_and_junk_fails(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0


def test_license_labels():
    def labels(text):
        words = brute.ALNUM.findall(brute.lower(text))
        return [r.label for _, _, r in license_scan.detections(words, license_scan.rules())]

    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: MIT") == ["mit"]
    assert labels("GNU Lesser General Public License v2.1 or later") == ["lgpl-2.1"]
    assert labels("An ordinary text about nothing.") == []
    assert len({r.pattern for r in license_scan.rules()}) >= 300


def test_gated_scan_equals_the_ungated_one(spark):
    """Every rule tried on every document, without any prefilter, and detections suppressed pair by pair."""
    given = license_scan.rules()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {r["doc_id"]: [(x["first"], x["after"], x["label"]) for x in r["spans"]] for r in license_scan.scan(docs).collect() if r["doc_id"] is not None}
    some = 0
    for r in docs.where("doc_id is not null").collect():
        words = brute.ALNUM.findall(brute.lower(r["text"] or ""))
        want = brute.license_spans(words, license_scan.compiled(given))
        assert got[r["doc_id"]] == want, r["doc_id"]
        some += bool(want)
    assert some > 20


def test_many_detections_are_suppressed_in_order_of_sorting():
    rng = random.Random(2)
    rule = [license_scan.Rule(f"r{k}", rng.randrange(4), "", (("x",),), 0.5) for k in range(12)]
    for _ in range(200):
        found = [(a, a + rng.randrange(1, 9), rng.choice(rule)) for a in (rng.randrange(30) for _ in range(rng.randrange(40)))]
        assert [(a, b, r.label) for a, b, r in license_scan.suppress(found)] == brute.suppressed(found)
    lines = [(8 * k, 8 * k + 4, rule[0]) for k in range(100_000)]
    assert len(license_scan.suppress(lines)) == 100_000


def spellings(parsed) -> list[str]:
    """Texts for every choice of branches and options of a parsed expression; a repeat stands for its least and greatest number, at most two."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [chr(v) if str(k) == "LITERAL" else "7" if "DIGIT" in str(v) else "w" for k, v in arg]
        elif op == "BRANCH":
            some = [t for branch in arg[1] for t in spellings(branch)]
        elif op == "SUBPATTERN":
            some = spellings(arg[3])
        else:
            assert op == "MAX_REPEAT", op
            some = [t * n for n in {arg[0], min(int(arg[1]), max(arg[0], 2))} for t in spellings(arg[2])]
        out = [a + b for a in out for b in dict.fromkeys(some)]
    return out


def test_every_alternative_passes_the_prefilters():
    """Each spelling that a rule's expression matches in canonical text holds a word of each of the rule's groups."""
    import re

    for rule, expression, keys in license_scan.compiled(license_scan.rules()):
        texts = [t for t in spellings(re._parser.parse(rule.pattern)) if re.fullmatch("[a-z0-9]+(?: [a-z0-9]+)*", t)]
        assert texts and keys, rule.pattern
        for t in texts:
            assert expression.fullmatch(t) and all(group & set(t.split()) for group in keys), (rule, t)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("free public license 1.0.0", "0bsd"), ("the FreeBSD license", "bsd-2-clause"), ("Do what the heck you want to public license", "wtfpl"), ("PSF license 2", "python-2.0"), ("CreativeML Open RAIL-M", "openrail"),
        ("CeCILL2.1", "cecill-2.1"), ("CeCILL v2.1", "cecill-2.1"), ("CeCILL 2.1", "cecill-2.1"), ("Apache License2.0", "apache-2.0"), ("licensed under the Apache License Version 2.0 the license you may not use this file except", "apache-2.0"),
        ("all advertising materials mentioning features or use of this software must display", "bsd-4-clause"),
    ],
)
def test_spellings_without_the_usual_keyword(spark, text, label):
    assert label in license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"].split(",")


def test_version_belongs_to_the_name():
    for text in ("cecill v2 1", "cecill v 2 1", "cecill version 2 1", "cecill 2 1", "cecill2 1"):
        assert [(s, e) for s, e, _ in license_scan.detections(text.split(), license_scan.rules())] == [(0, len(text.split()))]


def test_suppression():
    rule = lambda label, priority: license_scan.Rule(label, priority, "", (("x",),), 0.5)
    found = [(0, 5, rule("a", 2)), (1, 3, rule("b", 1)), (4, 8, rule("c", 1)), (4, 8, rule("c", 1))]
    assert [(s, e, r.label) for s, e, r in license_scan.suppress(found)] == [(0, 5, "a"), (4, 8, "c")]


def test_classifier_on_the_held_out_third(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    out = got[got["held_out"]]
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_classifier_covers_the_whole_document():
    net = quality_cnn.Network(4, 3, 1)
    net.fitted = True
    texts = ["", "a", "ab" * 50, "x" * 191, "x" * 192, "x" * 193, "yz " * 1000]
    got = net.scores(Texts(pa.array([*texts, None])))

    def one(text):
        data = np.frombuffer(text.encode() + bytes(net.width), np.uint8)
        n = len(text.encode()) + 1
        z = np.stack([sum(net.w[k][data[p + k]] for k in range(net.width)) for p in range(n)])
        blocks = [np.maximum(z[s : s + quality_cnn.BLOCK].max(0) + net.b, 0) for s in range(0, n, quality_cnn.BLOCK)]
        chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
        return 1 / (1 + np.exp(-(np.mean([c @ net.v for c in chunks]) + net.c[0])))

    assert np.allclose(got, [one(t) for t in [*texts, ""]], atol=1e-5)
    assert np.allclose(net.scores(Texts(pa.array(texts)), step=1), got[:-1], atol=1e-6)


@pytest.mark.parametrize("step", [3, 256])
def test_training_takes_every_chunk(monkeypatch, step):
    """Of long texts that differ in one chunk alone, wherever it stands, the classifier learns the label; chunks held at once don't matter."""
    monkeypatch.setattr(quality_cnn, "STEP_CHUNKS", step)
    size = 40 * quality_cnn.BLOCK
    texts, labels = [], []
    for k in range(40):
        text = bytearray(b"plain words " * (size // 12))
        if k % 2:
            at = (1 + k) * quality_cnn.BLOCK % (size - 300)
            text[at : at + 60] = b"#" * 60
        texts.append(bytes(text))
        labels.append(k % 2)
    read = []
    table = np.frombuffer
    monkeypatch.setattr(quality_cnn.np, "frombuffer", lambda data, kind: read.append(len(data)) or table(data, kind))
    net = quality_cnn.Network(4, 3, 1).fit(texts, np.array(labels, float), epochs=1)
    assert sum(read) >= 2 * sum(map(len, texts))
    monkeypatch.undo()
    got = quality_cnn.Network(4, 3, 1).fit(texts, np.array(labels, float), epochs=1)
    assert np.allclose(net.w, got.w, atol=1e-4) and np.allclose(net.v, got.v, atol=1e-4)


def test_gradients_against_differences():
    """The gradients that training follows equal differences of the loss, computed plainly."""
    rng = np.random.default_rng(3)
    net = quality_cnn.Network(3, 2, 1)
    net.fitted = True
    for p in (net.w, net.v):
        p *= 3
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 5, 190, 400, 900)]
    labels, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5, 1])

    def loss():
        p = net.scores(Texts(pa.array([t.decode() for t in texts])))
        return float((weight * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean())

    grads = net.gradients(texts, labels, weight, [quality_cnn.chunk_starts(len(t)) for t in texts])
    for part, grad in zip((net.w, net.b, net.v, net.c), grads, strict=True):
        flat, want = part.reshape(-1), grad.reshape(-1)
        for k in [*np.argsort(-np.abs(want))[:12].tolist(), *rng.integers(0, len(flat), 4).tolist()]:
            held, step = flat[k], 2e-3
            flat[k] = held + step
            up = loss()
            flat[k] = held - step
            down = loss()
            flat[k] = held
            assert abs((up - down) / (2 * step) - want[k]) < 0.02 * abs(want[k]) + 2e-3


def test_classifier_edge_cases(spark):
    docs = odd_docs(spark)
    for rows in ([], [(4, 1)], [(4, 0), (6, 0)], [(4, None)]):
        net = quality_cnn.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert not net.fitted and quality_cnn.accepted(docs, net).count() == docs.count()
        assert {(r["score"], r["predicted"]) for r in quality_cnn.score(docs, net).collect()} == {(0.5, 1)}
    net = quality_cnn.train(docs, spark.createDataFrame([(0, 0), (2, 1), (3, 0), (5, 1), (6, 1), (8, 0)], "doc_id long, quality int"))
    assert quality_cnn.score(docs, net).count() == docs.count() == quality_cnn.accepted(docs, net, bar=0.0).count()
    assert quality_cnn.accepted(docs, net).columns == docs.columns


ITEM = "A train leaves Paris at 7 with Maria aboard and travels 120 km in 3 hours before it stops near the old river bridge"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"Before. {ITEM} After it.", True),
        (ITEM.upper(), True),
        (ITEM.replace("7", "9").replace("Maria", "Peter").replace("120", "85").replace("3 hours", "2 hours"), True),
        (ITEM.replace("km", "miles"), True),
        ("A train leaves Paris at 7 with Maria aboard and nothing else is like it at all in this rather long other text", False),
        ("", False),
        (None, False),
    ],
)
def test_leaks(spark, text, found):
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "short one")], "item_id long, text string")
    got = decontam.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == ([(1, 7)] if found else [])
    assert decontam.clean(docs, items).count() == (0 if found else 1)


def leaked(spark, items, texts):
    """Of each text the items found in it, by their places in the lists."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = [set() for _ in texts]
    for r in decontam.leaks(docs, table).collect():
        out[r["doc_id"]].add(r["item_id"])
    return out


def test_slots_must_agree(spark):
    item = "then Anna gave 4 coins to the boy and later Anna gave 4 coins to the girl near the gate"
    same = item.replace("Anna", "Karl").replace("4", "9")
    mixed = item.replace("Anna", "Karl", 1).replace("4", "9", 1)
    assert leaked(spark, [item], [same, mixed.replace("Anna", "Olga").replace("4 coins to the girl", "5 coins to the girl")]) == [{0}, set()]


SHORT = "Which river flows through Vienna"
EDITED = "the old miller counted every sack of grain beside the mill before night fell again"


@pytest.mark.parametrize(
    ("item", "text", "found"),
    [
        (SHORT, f"Before it. {SHORT}? After it.", True),
        (SHORT, f"he asked: {SHORT.upper()}", True),
        (SHORT, "Which river flows through Graz", True),
        (SHORT, "Which river runs through Vienna", False),
        ("How far is 12 km", "tell me, how far is 15 km from here", True),
        ("How far is 12 km", "tell me, how far was 15 km from here", False),
        ("photosynthesis", "about Photosynthesis.", True),
        ("photosynthesis", "about photos", False),
        (EDITED, f"x {EDITED.replace('grain', 'flour')} y", True),
        (EDITED, "x the old miller counted every sack y", False),
        ("one item of just eight words for you", "an item: one item of just seven words for you", True),
        ("one item of just eight words for you", "an item: one item of just nothing", True),
        ("one item of just eight words for you", "an item: one item of few words for you", False),
    ],
)
def test_leaks_of_short_items(spark, item, text, found):
    """Items shorter than a window are found whole; those of fewer than two windows also with one word changed, where half of their words stand together."""
    assert leaked(spark, [item, "", ITEM], [text, ITEM]) == [{0} if found else set(), {2}]


def test_one_changed_word_is_survived_from_eight_words_on(spark):
    words = "amber birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh nook orchard pond quarry ridge".split()
    for n in (8, 9, 11, 15, 16, 18):
        texts = [" ".join([*words[:k], "changed", *words[k + 1 : n]]) for k in range(n)]
        assert leaked(spark, [" ".join(words[:n])], texts) == [{0}] * n, n


def drawn_items(rng, n):
    """Questions with names, numbers and units among words, and a way to ask each anew."""
    words = "the a lone miller baker sold carried bread water grain over under river road hill before after noon while children waited near old gate and then counted what was left".split()
    names, units = "Anna Boris Clara Dmitri Elena Farid Greta Henrik".split(), "km kg miles hours litres".split()
    out = []
    for _ in range(n):
        plan = [rng.choices(("word", "name", "number", "unit"), (7, 1, 1, 1))[0] for _ in range(rng.randint(16, 40))]
        plan[0] = "word"
        fixed = [rng.choice(words) for _ in plan]
        ids = [rng.randrange(3) for _ in plan]

        def ask(rng=rng, plan=plan, fixed=fixed, ids=ids):
            people, numbers, sizes = rng.sample(names, 3), rng.sample(range(2, 99), 3), rng.sample(units, 3)
            pick = {"name": lambda k: people[k], "number": lambda k: str(numbers[k]), "unit": lambda k: sizes[k]}
            return " ".join(pick[kind](k) if kind != "word" else w for kind, w, k in zip(plan, fixed, ids, strict=True))

        out.append(ask)
    return out


def test_questions_asked_anew_are_found(spark):
    """Recall of planted questions with other names, numbers and units, and no finds in texts of the same words."""
    rng = random.Random(31)
    ask = drawn_items(rng, 60)
    items = [a() for a in ask]
    texts = [f"some words before it. {a()} and more behind it" for a in ask] + [" ".join(w for _ in range(6) for w in rng.sample(items[k].split(), 6)) for k in range(60)]
    found = leaked(spark, items, texts)
    assert sum(k in f for k, f in enumerate(found[:60])) >= 54
    assert sum(map(len, found[60:])) == 0


def test_leaks_against_brute_force(spark, monkeypatch):
    """Equal to plain Python on texts that mix parts of items; also with a sieve too small and hot windows dealt out."""
    rng = random.Random(5)
    ask = drawn_items(rng, 25)
    items = [a() for a in ask] + [items_text for items_text in ("one", "two 3 km", "", "the old gate", "Anna sold 4 kg of bread")]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            words = (rng.choice(ask)() if rng.random() < 0.7 else rng.choice(items)).split() or ["x"]
            a = rng.randrange(len(words))
            parts.append(" ".join(words[a : a + rng.randint(1, 30)] if rng.random() < 0.6 else words))
        texts.append(". ".join(parts))
    want = [{k for k, item in enumerate(items) if brute.leaks(item, t)} for t in texts]
    assert leaked(spark, items, texts) == want and sum(map(len, want)) > 50
    monkeypatch.setattr(decontam, "MOST_BITS", 9)
    monkeypatch.setattr(decontam, "LEAST_BITS", 6)
    monkeypatch.setattr(decontam, "SLICE_BITS", 7)
    monkeypatch.setattr(decontam, "PART", 3)
    assert leaked(spark, items, texts) == want


def test_leaks_edge_cases(spark):
    long = "word " * 20000 + ITEM
    rows = [(1, ITEM, 5, "r"), (1, ITEM, 5, "r"), (None, ITEM, 5, "r"), (2, long, 5, "r"), (1, "nothing here", 5, "r"), (3, None, 5, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, row string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM), (8, None)], "item_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["item_id"], r["n_items"]) for r in decontam.leaks(docs, items).collect())
    assert got == [((False, 1), 7, 2), ((False, 2), 7, 2), ((True, 0), 7, 2)]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "nothing here"]
    assert decontam.leaks(docs.where("false"), items).count() == 0 and decontam.clean(docs, items.where("false")).count() == 6


def test_leaks_in_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    contained = {(d["doc_id"], b["item_id"]) for b in items.collect() for d in docs.where(F.contains("text", F.lit(b["text"]))).select("doc_id").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert contained <= got and len(got - contained) <= 2
    assert decontam.leaks(docs, items.where("false")).count() == 0


URLS = ["http://a.net/x/1", "https://A.Example.NET/en/2?q#f", "x.example.com/de/", "http://b.example.com/de/3", "http://org/fr/1", "http://net", "http://a.net:80/", None, "", "://", "http://h.org#/fr/", "http://x.org/fr/é?/", "HTTP://EXAMPLE.NET/en/"]


def test_url_facts(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], 1), (None, None, None)]
    got = url_tree.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), F.lit(None)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            want = brute.url_facts(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (want["host"], want["path"], want["rule"])
            assert r["verdict"] == (want["rule_verdict"] or "allow")
    assert url_tree.judge(spark.createDataFrame([], "page_id long, url string"), F.lit(None)).count() == 0


def test_bad_template_is_rejected(spark):
    rows = [(i, f"http://shop.example.io/{'spam' if i % 2 else 'news'}/{i}.html", i % 2) for i in range(400)] + [(1000, "http://shop.example.io/spam/77.html", None), (1001, "http://shop.example.io/news/78.html", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in url_tree.judge(docs, F.col("bad")).collect()}
    assert (got[1000]["verdict"], got[1001]["verdict"]) == ("block", "allow")
    assert got[1000]["template"] == "/spam/{n}.html"


def test_alike_branches_merge(spark):
    rows = [(i, f"http://blog.example.io/{'abcdefgh'[i % 8]}/{i}", int(i // 8 % 20 == 0)) for i in range(800)]
    got = url_tree.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), F.col("bad")).select("template").distinct().collect()
    assert [r["template"] for r in got] == ["/*/{n}"]


def test_alike_groups_of_branches_merge(spark):
    """Two groups of sections, one bad and one good, stand as two wildcards, each of several sections; what is deep or long is no exception."""
    rows = []
    for k, section in enumerate("abcdefgh"):
        rows += [(len(rows), f"http://big.example.io/{section * 60}/v1/x/y/z/w/{i}.html", int(i % 20 != 0) if k % 2 else int(i % 20 == 0)) for i in range(200)]
    got = url_tree.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), F.col("bad")).collect()
    assert {(r["path"][1], r["template"]) for r in got} == {(s, f"/*{1 + k % 2}/*/*/*/*/*/{{n}}.html") for k, s in enumerate("abcdefgh")}
    assert all((r["verdict"] == "block") == (r["path"][1] in "bdfh") for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_templates_against_a_plain_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(2500):
        host = rng.choice(["a.io", "b.io", "c.io"])
        path = [rng.choice(["news", "shop", "tag", "x1", "deadbeef99", "7"]) for _ in range(rng.randint(0, 3))] + rng.choice([[], [str(k)], [f"{k}.html"], ["a", "b", "c", "d", "e", rng.choice("fg")]])
        bad = None if rng.random() < 0.3 else int(rng.random() < (0.9 if path[:1] in (["shop"], ["tag"]) else 0.05))
        rows.append((k, f"http://{host}/{'/'.join(path)}", bad))
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_tree.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), F.col("bad"), rules=()).collect()}
    want = brute.url_templates(rows)
    assert got == want and len({t for t, _ in want.values()}) > 8


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/en/5.html", 9), (2, "http://a/en/6", 9), (2, "http://a/en/6", 9), (3, None, 9), (4, "http://a/x", 9), (5, "http://a/99999999999999999999", 9), (None, "http://a/7/", 9)], "page_id long, url string, doc int")
    labels = spark.createDataFrame([(5, 0, 0), (6, 1, 0), (6, 1, 1), (7, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = url_tree.bad_by_document(pages, labels)
    assert got.columns == ["page_id", "url", "doc", "_bad"]
    assert sorted((str(r["page_id"]), str(r["_bad"])) for r in got.collect()) == sorted([("1", "1"), ("2", "1"), ("2", "1"), ("3", "None"), ("4", "None"), ("5", "None"), ("None", "0")])


def test_shingles_against_brute_force():
    texts = [*ODD, "A b C d E f", "a b c d e f", "one two", "one  two", "two one"]
    values, first = distinct(*Texts(pa.array(texts, pa.string()), lower=True).words().shingles())
    sets = [frozenset(values[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    models = [brute.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(m) for m in models]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(models[i] & models[j])
