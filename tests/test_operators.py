"""Layout, usage, identity, sources, sinks, speech and stateful folds on small inputs."""

import json

from pyspark.sql import functions as F

from leafmill.operators import identity, layout, speech, stitch, summaries, usage
from leafmill.plans.queries import QUERIES
from leafmill.sources import readers, sinks
from leafmill.streaming import folds, keyed
from leafmill.streaming.replay import STREAMS, and_clock, guard_rows, panel_rows, replay

from .compare import SF, rows


def test_reporting_day_and_distinct_pages(spark):
    events = spark.createDataFrame(
        [("book1", "2026-08-02 03:59:00", "scan", "scan1:left", None), ("book1", "2026-08-02 03:59:00", "scan", "scan1:left", None), ("Book1 ", "2026-08-02 03:59:00", "scan", "scan1:right", None), ("book1", "2026-08-02 04:00:00", "scan", "scan2:left", None), ("book1", "2026-08-02 12:00:00", "audio", None, 61.4), ("book1", "2026-08-02 12:00:00", "audio", None, -5.0), ("book1", "2026-08-02 12:00:00", "book_summary", None, None), ("", "2026-08-02 12:00:00", "scan", "x", None)],
        "tag_id string, ts string, kind string, page_key string, seconds double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [tuple(r) for r in usage.daily(events).select(F.col("period_key").cast("string"), "tag_id", "pages_scanned", "audio_seconds", "book_summary_uses").orderBy("period_key").collect()]
    assert got == [("2026-08-01", "BOOK1", 2, 0.0, 0), ("2026-08-02", "BOOK1", 1, 61.4, 1)]


def test_closed_periods_without_anything(spark):
    none = spark.createDataFrame([], "period_key date, tag_id string, pages_scanned long, audio_seconds double, chapter_summary_uses long, book_summary_uses long")
    got = usage.closed_periods(none, F.lit("2026-08-03").cast("date"), none.select("period_key")).collect()
    assert [str(r["period_key"]) for r in got] == ["2026-08-02"]


def test_paragraphs_and_page_number(spark):
    lines = [(0, "Alter Hafen", 10, 0, 200, 30, 0.9), (1, "Am Steg lag ein Ka-", 10, 80, 300, 110, 0.9), (2, "nister voll Öl.", 10, 115, 300, 145, 0.9), (3, "Keiner nahm ihn.", 10, 300, 300, 330, 0.9), (4, "17", 150, 900, 170, 930, 0.9)]
    df = spark.createDataFrame([("p", *x) for x in lines], "page string, line_index int, text string, left int, top int, right int, bottom int, confidence double")
    got = [(r["kind"], r["text"], r["line_indices"]) for r in layout.paragraphs(df, ["page"]).orderBy("paragraph").collect()]
    assert got == [("chapter_heading", "Alter Hafen", [0]), ("paragraph", "Am Steg lag ein Kanister voll Öl.", [1, 2]), ("paragraph", "Keiner nahm ihn.", [3])]
    numbered = df.withColumn("engine", F.lit("tesseract")).withColumn("block_num", F.when(F.col("line_index") < 2, 1).otherwise(2)).withColumn("par_num", F.lit(1))
    assert layout.paragraphs(numbered, ["page"]).count() == 2


def test_best_candidate_and_swap(spark):
    df = spark.createDataFrame([("p", 0, 0.5), ("p", 180, 0.5), ("q", 0, 0.1), ("q", 180, 0.4)], "page string, rotation_deg int, score double")
    assert {r["page"]: r["rotation_deg"] for r in layout.best_candidate(df, ["page"]).collect()} == {"p": 0, "q": 180}
    r = spark.range(1).select(layout.side_by_orientation(F.lit("reader1"), F.lit("a"), F.lit("b")).alias("s")).first()["s"]
    assert (r["left"], r["right"]) == ("b", "a")


def test_reading_stream_over_pages(spark):
    df = spark.createDataFrame([("B", 1, "page_1", 1, "Der Kahn trieb lange am Ufer und"), ("B", 2, "page_2", 1, "stieß gegen den Steg. Erst"), ("B", 3, "page_3", 1, "dann")], "tag_id string, page_position int, page_id string, paragraph int, text string")
    got = [(r["text"], r["complete"], r["source_pages"]) for r in speech.reading_stream(df).orderBy("position").collect()]
    assert got == [("Der Kahn trieb lange am Ufer und stieß gegen den Steg.", True, ["page_1", "page_2"]), ("Erst dann", False, ["page_2", "page_3"])]


def test_packing_of_speech(spark):
    text = "Eins zwei. Drei vier. " + "lang " * 20
    row = spark.range(1).select(speech.packed_speech(F.lit(text), "google-gemini-flash", 30).alias("c"), speech.packed_speech(F.lit("  "), "google").alias("none"), speech.packed_speech(F.lit(text), "other", 5).alias("whole"), speech.packed_speech(F.lit("A & B. C."), "google", 27).alias("ssml"), speech.packed_chars(F.array(F.lit("aa"), F.lit("bb"), F.lit("c" * 9)), 5).alias("chars")).first()
    assert row["c"][0] == "Eins zwei. Drei vier." and all(len(c) <= 30 for c in row["c"]) and " ".join(row["c"]) == text.strip()
    assert row["none"] == [] and row["whole"] == [text.strip()] and row["chars"] == ["aa bb", "c" * 9] and row["ssml"] == ["A & B.", "C."]


def test_alias_precedence(spark):
    tags = spark.createDataFrame([(1, "iso15693", "X"), (1, "iso14443a", "Y"), (2, "iso15693", "A1"), (2, "iso15693", "BOOK"), (3, "iso15693", "BOOK"), (4, "iso15693", "Q"), (5, "iso15693", "Q"), (5, "iso15693", "R")], "scan int, technology string, uid string")
    alias = spark.createDataFrame([("OWNER", "A1")], "tag_id string, alias string")
    books = spark.createDataFrame([("BOOK",)], "tag_id string")
    assert {r["scan"]: (r["tag_id"], r["rule"]) for r in identity.resolve(tags, alias, books).collect()} == {1: ("Y", 1), 2: ("OWNER", 2), 3: ("BOOK", 3), 4: ("Q", 4), 5: (None, None)}


def test_mail_gate(spark):
    df = spark.createDataFrame([(["A@x.de"], "Save it", ["a.txt"], True), (["a@x.de", "b@x.de"], "save it", ["a.txt"], False), (["a@x.de"], "load", ["a.txt"], False), (["a@x.de"], "save it", ["../a"], False), (["a@x.de"], "save it", ["a", "b"], False)], "s array<string>, j string, a array<string>, want boolean")
    assert df.where(identity.mail_is_accepted(F.col("s"), F.lit("a@x.de"), F.col("j"), F.col("a")) != F.col("want")).count() == 0


def test_recognised_shapes(spark):
    box = [[0, 0], [4, 0], [4, 2], [0, 2]]
    results = {"a": {"txts": ["x", " ", "y"], "scores": [0.5, 0.1], "boxes": [box]}, "b": [[box, ["z", 0.9]]], "c": {"lines": [{"text": "w", "score": 0.25, "box": box}]}, "d": {"rec_texts": ["v"], "rec_scores": [1]}, "e": []}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in results.items()], "page_id string, result string")
    got = sorted((r["page_id"], r["line_index"], r["text"], r["confidence"], len(r["bbox"])) for r in readers.recognised(df).collect())
    assert got == [("a", 0, "x", 0.5, 4), ("a", 2, "y", 0.0, 0), ("b", 0, "z", 0.9, 4), ("c", 0, "w", 0.25, 4), ("d", 0, "v", 1.0, 0)]


def test_recognised_odd_results(spark):
    """What has texts has no entries; scores and boxes beyond the texts, or without texts, count for nothing."""
    box = [[0, 0], [4, 0], [4, 2], [0, 2]]
    results = {
        "long": {"texts": ["x"], "scores": [0.5, 0.6, 0.7], "boxes": [box, box]}, "both": {"txts": ["t"], "lines": [{"text": "no"}]}, "none": {"txts": [], "lines": [{"text": "no"}]},
        "stray": {"scores": [0.5], "boxes": [box], "lines": [{"txt": " w "}, {"text": ""}, {"text": "u", "confidence": 0.125}]}, "flat": [[box, "f", 0.75], [box, ["g"]]], "word": "text", "bad": {"lines": 3}, "gaps": {"txts": ["a", None, "b"], "scores": [None, 1, "x"]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in results.items()] + [("null", None)], "page_id string, result string")
    got = sorted((r["page_id"], r["line_index"], r["text"], r["confidence"], len(r["bbox"])) for r in readers.recognised(df).collect())
    print(got)
    assert got == [
        ("both", 0, "t", 0.0, 0), ("flat", 0, "f", 0.75, 4), ("flat", 1, "g", 0.0, 4), ("gaps", 0, "a", 0.0, 0), ("gaps", 2, "b", 0.0, 0),
        ("long", 0, "x", 0.5, 4), ("stray", 0, "w", 0.0, 0), ("stray", 2, "u", 0.125, 0),
    ]


def test_device_lines(spark):
    lines = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "position int, line string")
    assert [tuple(r) for r in readers.network_profiles(lines("a\\:b\\\\:u:802-11-wireless:", "x:y:ethernet:z", "bad")).collect()] == [("a:b\\", "u", "802-11-wireless", None)]
    assert [tuple(r) for r in readers.pin_levels(lines("17: ip pu | hi // GPIO17 = input", " 4: op | lo", "x")).collect()] == [(17, True), (4, False)]
    assert [tuple(r) for r in readers.key_values(lines("# c", "[imap]", "Host = a=b", "", "[smtp]", "port=25")).collect()] == [("imap", "host", "a=b"), ("smtp", "port", "25")]
    tags = identity.reader_tags(lines("READER id=1 tag14443a=1 uid14443a=aa:bb tag15693=0 uid15693=cc", "READER id=1 tag=1 tech=ISO15693 uid=e0-01", "noise", "READER id=x tag=1 tech=ISO15693 uid=e0", "READER tag15693=1 uid15693=-").withColumnRenamed("position", "line_id"))
    assert sorted((r["line_id"], r["technology"], r["uid"]) for r in tags.collect()) == [(0, "iso14443a", "AABB"), (1, "iso15693", "E001")]


def test_stored_documents(spark, tmp_path):
    folder = tmp_path / "B1" / "pages"
    folder.mkdir(parents=True)
    (folder / "0001.json").write_text(json.dumps({"page_id": "page_0001", "side": "left", "extra": 1, "page_number": 1}, indent=2))
    got = readers.pages(spark, str(tmp_path)).first()
    assert (got["tag_id"], got["page_id"], got["page_number"], got["tail_fragment"]) == ("B1", "page_0001", 1, None)
    keys = spark.createDataFrame([("7",), ("12345",), ("page_1",)], "k string").select(readers.lookup_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == ["0007", "12345", "page_1"]
    images = spark.createDataFrame([("/c/a.png",), ("/c/b.png",), ("/c/c.png",), ("/d/rechts.jpg",), ("/d/links.jpg",), ("/d/seite_links.jpg",), ("/d/aaa.jpg",)], "path string")
    assert sorted(tuple(r) for r in readers.image_pair(images).collect()) == [("/c", "left", "/c/a.png"), ("/c", "right", "/c/b.png"), ("/d", "left", "/d/links.jpg"), ("/d", "right", "/d/rechts.jpg")]


def test_upsert_archive_and_partitions(spark, tmp_path):
    stored = spark.createDataFrame([("B", 1, "old", 1), ("B", 2, "old", 1)], "tag_id string, k int, v string, ingest_seq int")
    new = spark.createDataFrame([("B", 2, "new", 2), ("B", 2, "newer", 3), ("C", 1, "new", 2)], "tag_id string, k int, v string, ingest_seq int")
    merged = sinks.upsert(stored, new, ["tag_id", "k"])
    assert sorted((r["tag_id"], r["k"], r["v"]) for r in merged.collect()) == [("B", 1, "old"), ("B", 2, "newer"), ("C", 1, "new")]
    sinks.write_books(merged, str(tmp_path / "t"))
    sinks.write_books(merged.where("tag_id = 'C'").withColumn("v", F.lit("x")), str(tmp_path / "t"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["newer", "old", "x"]
    assert sinks.delete_book(merged, "B").count() == 1
    live = spark.createDataFrame([("2026-01-01", "B"), ("2026-01-02", "B")], "period_key string, tag_id string").withColumn("period_key", F.to_date("period_key"))
    assert sinks.archive_period(spark, live, "2026-01-01", str(tmp_path / "a")).count() == 1 and spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_book_upsert_refuses_another_language(spark):
    books = spark.createDataFrame([("A", "t0", "t0", None), ("B", "t0", "t0", "de")], "tag_id string, created_at string, last_seen_at string, language string")
    seen = spark.createDataFrame([("A", "t1", "de"), ("B", "t1", "en"), ("C", "t1", "en")], "tag_id string, seen_at string, language string")
    out, refused = identity.upsert_books(books, seen)
    assert sorted(tuple(r) for r in out.collect()) == [("A", "t0", "t1", "de"), ("B", "t0", "t0", "de"), ("C", "t1", "t1", "en")]
    assert [r["tag_id"] for r in refused.collect()] == ["B"]


def test_summaries(spark):
    rows = spark.createDataFrame([("B", "chapter_0002", "t", "u", "zwei"), ("B", "chapter_0001", "t", "u", "eins")], "tag_id string, chapter_id string, created_at string, updated_at string, text string")
    now = summaries.fingerprint(rows)
    assert now.first()["source_chapter_ids"] == ["chapter_0001", "chapter_0002"]
    assert summaries.stale_books(now, now).count() == 0 and summaries.stale_books(now, now.where("false")).count() == 1
    long = rows.withColumn("target_words", F.lit(3))
    got = {r["chapter_id"]: (r["summary"], r["status"]) for r in summaries.summarised(long, lambda text, n: "a b c d e", lambda text, n: " ".join(text.split()[:n])).collect()}
    assert got["chapter_0001"] == ("a b c", "ok")
    answer = json.dumps({"candidates": [{"content": {"parts": []}}, {"content": {"parts": [{"text": "x\n\n\n\ny"}]}, "finishReason": "STOP"}]})
    r = spark.createDataFrame([(answer,)], "j string").select(summaries.response_text(F.col("j")).alias("r")).first()["r"]
    assert (r["text"], r["complete"], r["blocked"]) == ("x\n\ny", True, False)


def guarded(spark, *given):
    df = spark.createDataFrame([("B", s, float(i), n) for i, (s, n) in enumerate(given)], "tag_id string, scan_id string, seq double, numbers array<int>")
    return [r["decision"] for r in folds.batch(df, "tag_id", folds.GUARD).orderBy("seq").collect()]


def test_sequence_guard(spark):
    assert guarded(spark, ("a", [1, 2]), ("b", [1, 2]), ("b", [2]), ("c", [1, 2])) == ["allow", "repeat", "held", "allow"]
    assert guarded(spark, ("a", [5, 6]), ("b", [3, 4]), ("c", [3, 4])) == ["allow", "backward", "allow"]
    assert guarded(spark, ("a", [1]), ("a", [2]), ("b", [2]), ("c", []), ("d", [3])) == ["allow", "allow", "repeat", "allow", "allow"]


def test_chord_debounce_and_quadrature(spark):
    panel = [("p", 0.0, "down", "start_stop_nfc", 0), ("p", 0.05, "down", "book_summary", 0), ("p", 0.1, "down", "chapter_summary", 0), ("p", 1.0, "down", "book_summary", 0), ("p", 1.05, "up", "book_summary", 0), ("p", 2.0, "down", "chapter_summary", 0), ("p", 2.5, "step", "encoder", -1)]
    df = spark.createDataFrame(panel, "panel string, t double, event_type string, control string, delta int")
    assert [r["action"] for r in folds.batch(df, "panel", folds.CHORDS).collect()] == ["DELETE_BOOK_REQUEST", "BOOK_SUMMARY", "CHAPTER_SUMMARY", "VOLUME_DELTA"]
    levels = spark.createDataFrame([("b", t, p) for t, p in ((0.0, False), (0.01, True), (0.02, False), (0.03, True), (0.06, True), (0.07, True), (0.2, False), (0.23, False))], "button string, t double, pressed boolean")
    assert [(r["event_type"]) for r in folds.batch(levels, "button", folds.DEBOUNCE).collect()] == ["down", "up"]
    turns = [folds.RING[k % 4] for k in (0, 1, 2, 3, 4, 3, 2, 1, 0)]
    phases = spark.createDataFrame([("e", float(i), a, b) for i, (a, b) in enumerate(turns)], "encoder string, t double, a int, b int")
    assert [r["delta"] for r in folds.batch(phases, "encoder", folds.QUADRATURE).collect()] == [1, -1]


def test_streams_equal_their_batch_forms(spark):
    pressed = panel_rows(spark, SF)
    forms = [(guard_rows(spark, SF), "tag_id", folds.GUARD, "seq", lambda s: folds.stream(s, "tag_id", folds.GUARD)), (and_clock(pressed, "panel", "t", 1.0), "panel", folds.CHORDS, "t", lambda s: keyed.timed(s, "panel", folds.CHORDS))]
    for given, key, fold, order, work in forms:
        whole, streamed = folds.batch(given, key, fold).toPandas(), replay(spark, given, order, work).toPandas()
        assert rows(whole, list(whole.columns)) == rows(streamed, list(whole.columns))
    assert rows(STREAMS["stream_sections"](spark, SF).toPandas(), ["tag_id", "sequence", "end_position"]) == rows(QUERIES["section_bounds"](spark, SF).toPandas(), ["tag_id", "sequence", "end_position"])


def test_latest_and_placeholders(spark):
    df = spark.createDataFrame([("B", "s", "left", "p1", None), ("B", "s", "left", "p1", 4), ("B", "s", "right", "p1", None)], "tag_id string, scan_id string, side string, report_page_id string, page_number int")
    assert sorted((r["side"], r["page_number"] or 0) for r in stitch.without_placeholders(df).collect()) == [("left", 4), ("right", 0)]


def test_measures(spark):
    from leafmill.operators import metrics as M

    r = spark.range(1).select(
        M.total_seconds(F.create_map(F.lit("a"), F.lit(1.5), F.lit("b"), F.lit(2.0))).alias("sum"), M.preferred_first(F.array(*map(F.lit, "cab")), F.array(F.lit("b"), F.lit("x"))).alias("order"),
        F.concat_ws("|", M.recap_label(F.lit(3), F.lit(5), F.lit("c")), M.recap_label(F.lit(3), F.lit(3), F.lit("c")), M.recap_label(F.lit(None).cast("int"), F.lit(3), F.lit("c")), M.progress_label(F.lit(3), F.lit(9))).alias("label"), M.archived_day(F.lit("2026-02-30.json")).alias("bad"), M.archived_day(F.lit("2026-02-03.json")).cast("string").alias("day"),
        M.wav_seconds(F.lit(100), F.lit(0)).alias("none"), M.is_inside(F.lit("/a/b"), F.lit("/a/")).alias("inside"), M.is_inside(F.lit("/a/../b"), F.lit("/a")).alias("out"), F.size(M.grid(3, 2, 5.0)).alias("grid"), M.stretched(F.lit(60.0), F.lit(50.0), F.lit(70.0)).alias("grey"),
    ).first()
    assert (r["sum"], r["order"], r["label"], r["bad"], r["day"], r["none"], r["inside"], r["out"], r["grid"], r["grey"]) == (3.5, ["b", "c", "a"], "kapitel-zusammenfassung:3-5|kapitel-zusammenfassung:3|kapitel-zusammenfassung:c|kapitel-zusammenfassung-temporaer:3-9", None, "2026-02-03", None, True, False, 6, 127.5)
    files = spark.createDataFrame([("g", "preferred", False, 9), ("g", "preferred", True, 8), ("g", "fallback", True, 5)], "g string, source string, exists boolean, modified int")
    assert tuple(M.latest_source(files, "g").first()) == ("g", 5, True, "fallback")
    said = spark.createDataFrame([("x", "ab", 2.0, 5.0), ("x", "c", 1.0, 1.5)], "g string, text string, queued_at double, ready_at double")
    assert tuple(M.batch_counters(said, "g").first()) == ("x", 2, 3, 0.5)


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    import pytest

    from leafmill.session import shared_dir

    conf = lambda value: SimpleNamespace(get=lambda key, default=None: value)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_dir(SimpleNamespace(conf=conf("file:///x/"), sparkContext=SimpleNamespace(master="spark://host:7077"))) == "file:///x"
    assert shared_dir(SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(master="local[4]"))).startswith("file://")


def test_languages(spark):
    import pytest

    from leafmill.functions import language

    rows = spark.createDataFrame([(" DE ",), ("en",), (None,)], "c string")
    assert [tuple(r["p"]) for r in rows.select(language.profile(F.col("c")).alias("p")).collect()] == [("de", "de-DE", "Kapitel", "German"), ("en", "en-US", "Chapter", "English"), ("de", "de-DE", "Kapitel", "German")]
    with pytest.raises(Exception, match="unknown language"):
        spark.createDataFrame([("xx",)], "c string").select(language.language(F.col("c"))).collect()


def test_documents_are_replaced_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("B", "pages", "0001", json.dumps({"page_id": "old", "page_number": 1}), 1), ("B", "pages", "0001", json.dumps({"page_id": "new", "page_number": 1}), 2), ("B", "pages", "x", json.dumps({"page_id": "x"}), 1)], "tag_id string, kind string, key string, document string, ingest_seq int")
    assert sinks.write_documents(rows, f"file://{tmp_path}/l") == 2
    sinks.write_documents(rows.where("key = 'x'").withColumn("document", F.lit(json.dumps({"page_id": "y"}))), f"file://{tmp_path}/l")
    got = readers.stored_order(readers.pages(spark, f"{tmp_path}/l")).orderBy("position").collect()
    assert [(r["page_id"], r["position"]) for r in got] == [("new", 0), ("y", 1)]
    assert sorted(p.name for p in (tmp_path / "l/B/pages").iterdir() if not p.name.endswith(".crc")) == ["0001.json", "x.json"]


def test_boundaries_are_resolved_by_the_first_rule(spark):
    from leafmill.operators import sections

    pages = spark.createDataFrame([("B", 0, 5, "p5", "s1", "left", "r1"), ("B", 1, 6, "p6", "s1", "right", "r2"), ("B", 2, None, "q", "s2", "left", "p9"), ("C", 0, 5, "p5", "s1", "left", None)], "tag_id string, position int, page_number int, page_id string, scan_id string, side string, report_page_id string")
    wanted = spark.createDataFrame([("B", 6, "p5", None, None, 0), ("B", None, "p5", "s1", "right", 0), ("B", 99, "none", "s2", "left", 0), ("B", None, "p9", None, None, 0), ("B", None, None, None, None, 0), ("B", 6, "p5", None, None, 0), ("C", 5, None, None, None, 0)], "tag_id string, page_number int, page_id string, scan_id string, side string, offset int")
    got = sections.resolve(wanted, pages).collect()
    assert sorted((r["tag_id"], -1 if r["resolved_position"] is None else r["resolved_position"]) for r in got) == [("B", -1), ("B", 0), ("B", 1), ("B", 1), ("B", 2), ("B", 2), ("C", 0)]


def test_answers(spark):
    answers = [({"candidates": [{"finishReason": "max_tokens"}]}, (True, True)), ({"candidates": [{"finishReason": "Recitation"}]}, (False, False)), ({"promptFeedback": {"blockReason": "X"}}, (False, False)), ({}, (False, True))]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(answers)], "i int, j string")
    assert [tuple(r["s"]) for r in rows.orderBy("i").select(summaries.response_state(F.col("j")).alias("s")).collect()] == [want for _, want in answers]


def test_a_held_scan_stays_held(spark):
    assert guarded(spark, ("a", [1, 2]), ("b", [1, 2]), ("c", [3, 4]), ("b", [1]), ("d", [5])) == ["allow", "repeat", "allow", "held", "allow"]
