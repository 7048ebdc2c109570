"""Streams whose results no table shows: timers, state that ends, restarts, batches that run twice."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leafmill.operators import sections
from leafmill.plans.ingest import ingest
from leafmill.plans.records import _reports
from leafmill.session import SWEEP
from leafmill.streaming import folds, keyed, tables
from leafmill.streaming.replay import and_clock, delivered, feed, folder_of, replay, to_end

from .compare import SF, rows

PANEL = "panel string, t double, event_type string, control string, delta int"


def test_lone_press_acts_without_another_event(spark):
    """One press and nothing after it: the clock alone moves on. A chord whose third press comes in a later batch is still one."""
    given = [("a", 1.0, "down", "book_summary", 0), ("b", 2.0, "down", "start_stop_nfc", 0), ("b", 2.05, "down", "book_summary", 0), ("b", 2.17, "down", "chapter_summary", 0), ("c", 3.0, "down", "chapter_summary", 0), ("c", 3.1, "up", "chapter_summary", 0), ("clock", 9.0, "tick", "", 0)]
    df = spark.createDataFrame(given, PANEL)
    want = {("a", 1.18, "BOOK_SUMMARY"), ("b", 2.17, "DELETE_BOOK_REQUEST"), ("c", 3.1, "CHAPTER_SUMMARY")}
    assert {(r["panel"], round(r["t"], 3), r["action"]) for r in replay(spark, df, "t", lambda s: keyed.timed(s, "panel", folds.CHORDS)).collect()} == want
    assert {(r["panel"], round(r["t"], 3), r["action"]) for r in folds.batch(df, "panel", folds.CHORDS).collect()} == want


def test_press_waits_while_its_window_may_be_open(spark):
    df = spark.createDataFrame([("a", 1.0, "down", "book_summary", 0), ("clock", 1.1, "tick", "", 0)], PANEL)
    assert replay(spark, df, "t", lambda s: keyed.timed(s, "panel", folds.CHORDS)).count() == 0


def test_silent_feeds(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    given = [("never", at(0), True), ("stalls", at(0), True), ("stalls", at(5), False), ("stalls", at(7), False), ("lives", at(1), False), *[("lives", at(s), False) for s in range(2, 60)]]
    df = spark.createDataFrame(given, "feed string, ts timestamp, is_start boolean")
    got = replay(spark, df, "ts", lambda s: keyed.silent_feeds(s.withWatermark("ts", "0 seconds"), "feed", 3, 10)).collect()
    assert {(r["feed"], r["since"], r["reported_at"], r["n_frames"], r["reason"]) for r in got} == {("never", at(0), at(10), 0, "no frames"), ("stalls", at(7), at(10), 2, "stalled")}


def test_guard_state_stays_flat(spark):
    """10,000 scans are held, one a second; entries end with HELD_FOR, so few more than those of that time are kept."""
    n = 20_000
    given = spark.range(n).select(F.lit("B").alias("tag_id"), F.concat(F.lit("s"), "id").alias("scan_id"), F.col("id").cast("double").alias("seq"), F.array(F.lit(1)).alias("numbers"))
    folder = folder_of(spark)
    decisions = []
    ran = to_end(keyed.guarded(feed(given, "seq", folder)), folder, lambda part, k: decisions.append(part.groupBy("decision").count().collect()))
    counts = {}
    for batch in decisions:
        for r in batch:
            counts[r["decision"]] = counts.get(r["decision"], 0) + r["count"]
    assert counts == {"allow": n // 2, "repeat": n // 2}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, ran.recentProgress) if p["stateOperators"]]
    assert kept[-1] <= folds.HELD_FOR


def test_forgotten_book_begins_anew(spark):
    given = [("B", "a", 1.0, [5, 6], None), ("B", None, 2.0, None, folds.FORGET), ("B", "b", 3.0, [3, 4], None), ("B", "c", 4.0, [3, 4], None)]
    df = spark.createDataFrame(given, "tag_id string, scan_id string, seq double, numbers array<int>, control string")
    want = {("a", "allow"), ("b", "allow"), ("c", "repeat")}
    assert {(r["scan_id"], r["decision"]) for r in replay(spark, df, "seq", keyed.guarded).collect()} == want
    assert {(r["scan_id"], r["decision"]) for r in folds.batch(df, "tag_id", folds.GUARD).collect()} == want


def test_resumed_sections(spark):
    """A restart without a checkpoint, fed with all pages again, goes on after what is stored; a book of which nothing is stored begins at its first page."""
    facts = spark.createDataFrame([(b, p, [0] if p == 12 else [], 50, 60) for b in "AB" for p in range(45)], "tag_id string, position int, markers array<int>, fallback int, resume int")
    whole = replay(spark, facts, "position", lambda s: folds.stream(s, "tag_id", folds.SECTIONS)).collect()
    stored = spark.createDataFrame([r for r in whole if r["tag_id"] == "A" and r["sequence"] == 1])
    rest = replay(spark, facts, "position", lambda s: keyed.timed(s, "tag_id", folds.SECTIONS, initial=sections.resumed(stored))).collect()
    assert sorted(map(tuple, rest)) == sorted(tuple(r) for r in whole if (r["tag_id"], r["sequence"]) != ("A", 1)) and len(whole) > 3


def usage(spark, *given):
    at = lambda s: dt.datetime.fromisoformat(f"2026-01-{s}:00")
    return spark.createDataFrame([(tag, at(ts), at(seen), kind, key, seconds) for tag, ts, seen, kind, key, seconds in given], "tag_id string, ts timestamp, seen timestamp, kind string, page_key string, seconds double")


def test_closed_days(spark):
    """A day ends at four; days that nobody used come too; what is seen too late is told apart; the open day isn't given out."""
    given = usage(spark, ("A", "01T10:00", "01T10:00", "scan", "p1", None), ("A", "02T03:59", "02T03:59", "scan", "p1", None), ("A", "02T03:00", "02T03:59", "audio", None, 2.5), ("B", "01T12:00", "01T12:00", "audio", None, -1.0), ("A", "05T10:00", "05T10:00", "book_summary", None, None), ("A", "01T11:00", "05T11:00", "scan", "p9", None), ("A", "06T10:00", "06T10:00", "scan", "p2", None))
    folder = folder_of(spark)
    to_end(keyed.closed_days(feed(given, "seen", folder)), folder, tables.archive_days(folder))
    got = sorted((str(r["period_key"]), r["status"], r["tag_id"], r["pages_scanned"], r["audio_seconds"], r["book_summary_uses"]) for r in tables.stored(spark, f"{folder}/periods", tables.PERIODS).collect())
    assert got == [("2026-01-01", "closed", "A", 1, 2.5, 0), ("2026-01-02", "empty", None, 0, 0.0, 0), ("2026-01-03", "empty", None, 0, 0.0, 0), ("2026-01-04", "empty", None, 0, 0.0, 0), ("2026-01-05", "closed", "A", 0, 0.0, 1)]
    late = tables.stored(spark, f"{folder}/late", tables.LATE).collect()
    assert [(r["tag_id"], str(r["period_key"]), r["kind"]) for r in late] == [("A", "2026-01-01", "scan")]


def test_archive_of_days_runs_twice(spark):
    folder, work = folder_of(spark), None
    work = tables.archive_days(folder)
    day = lambda d, tag: (tag, "closed", dt.date(2026, 1, d), 1, 0.0, 0, 0, None, None)
    for number, days in ((0, [1]), (1, [4]), (1, [4]), (0, [1]), (2, [])):
        work(spark.createDataFrame([day(d, "A") for d in days], keyed.DAYS), number)
    got = sorted((str(r["period_key"]), r["status"]) for r in tables.stored(spark, f"{folder}/periods", tables.PERIODS).collect())
    assert got == [("2026-01-01", "closed"), ("2026-01-02", "empty"), ("2026-01-03", "empty"), ("2026-01-04", "closed")]


PAGES = ["tag_id", "scan_id", "side", "page_id", "page_number", "chapter_number", "clean_text", "speak_text", "tail_fragment"]


@pytest.fixture(scope="module")
def some_reports(spark):
    own = delivered(spark, SF).where("tag_id like '%-0' and seen < 300")
    folder = folder_of(spark)
    own.write.parquet(folder)
    return spark.read.schema(own.schema).parquet(folder)


def test_merged_reports_equal_the_batch_form(spark, some_reports):
    """Also when each batch runs twice, and an old one again after newer ones."""
    folder, work = folder_of(spark), None
    work = tables.merge_reports(folder)
    batches = [some_reports.where(f"seen >= {a} and seen < {b}") for a, b in ((0, 75), (75, 150), (150, 300))]
    for number in (0, 0, 1, 2, 2):
        work(batches[number], number)
    found = ingest(some_reports)[0]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(PAGES).schema)
    got = tables.merged_pages(spark, folder, schema)
    assert rows(got.toPandas(), PAGES) == rows(found.select(PAGES).toPandas(), PAGES) and got.count() > 10


def test_placeholder_is_taken_back_and_a_refused_report_stands_alone(spark):
    """A page without a number is stored as a placeholder; the whole scan, delivered later, numbers it. A report without sides is refused, others aren't."""
    from .test_ingest import page, reports

    alone = reports(spark, ("B", "s1", "t1", [page("left", ("Der Tag begann hier.", 100, 130))]), ("C", "s1", "t1", [page("middle", ("x", 1, 2))]))
    whole = reports(spark, ("B", "s1", "t2", [page("left", ("Der Tag begann hier.", 100, 130)), page("right", ("Alle schliefen.", 100, 130), ("13", 970, 1000))]))
    folder, work = folder_of(spark), None
    work = tables.merge_reports(folder)
    schema = "tag_id string, page_id string, page_number int"
    work(alone, 0)
    before = {(r["tag_id"], r["page_number"]) for r in tables.merged_pages(spark, folder, schema).collect()}
    work(whole, 1)
    after = {(r["tag_id"], r["page_id"], r["page_number"]) for r in tables.merged_pages(spark, folder, schema).collect()}
    assert before == {("B", None)} and after == {("B", "page_0012", 12), ("B", "page_0013", 13)}
    assert tables.stored(spark, f"{folder}/refused", "tag_id string, scan_id string").select("tag_id").first()[0] == "C"


def test_section_that_began_at_a_placeholder_is_found_again(spark):
    """An open section's start is stored by page; once that page has a number, the start is resolved to where it stands now."""
    pages = spark.createDataFrame([("B", 12, "page_0012", "s1", "left", "page_1", 0), ("B", 13, "page_0013", "s1", "right", "page_2", 1)], "tag_id string, page_number int, page_id string, scan_id string, side string, report_page_id string, position int")
    start = spark.createDataFrame([("B", None, "s1_left", "s1", "left", 5)], "tag_id string, page_number int, page_id string, scan_id string, side string, offset int")
    assert [(r["resolved_position"], r["offset"]) for r in sections.resolve(start, pages).collect()] == [(0, 5)]


def test_deliveries_close_after_a_while(spark):
    given = [("B", "s1", "a", 0.0, ["left"], 1), ("B", "s1", "b", 1.0, ["left", "right"], 2), ("B", "s1", "c", 60.0, ["left"], 1), ("B", "s2", "a", 61.0, ["right"], 1)]
    df = spark.createDataFrame(given, "tag_id string, scan_id string, created_at string, seen double, sides array<string>, n_pages int")
    out = replay(spark, and_clock(df, "tag_id", "seen", 2.0).fillna({"scan_id": "clock", "created_at": "", "n_pages": 0}).withColumn("sides", F.coalesce("sides", F.array().cast("array<string>"))), "seen", lambda s: keyed.deliveries(s, 5.0)).collect()
    pages = sorted((r["scan_id"], r["delivery"], r["side"], r["read"]) for r in out if r["what"] == "page")
    assert pages == [("s1", 1, "left", True), ("s1", 1, "left", True), ("s1", 2, "left", False), ("s1", 2, "right", True), ("s2", 1, "right", True)]
    assert [(r["scan_id"], r["n_stored"]) for r in out if r["what"] == "closed"] == [("s1", 2)]


def test_mail_is_handled_once(spark):
    """A batch that runs twice, a message listed again, and a mailbox that was reset."""
    folder, work = folder_of(spark), None
    work = tables.handle_mail(folder)
    given = {0: [(1, 10), (1, 11), (1, 11)], 1: [(1, 10), (1, 12)], 2: [(2, 10)]}
    for number in (0, 1, 1, 2, 0):
        work(spark.createDataFrame(given[number], tables.MAIL), number)
    assert sorted((r["uid_validity"], r["uid"]) for r in tables.stored(spark, f"{folder}/handled", tables.MAIL).collect()) == [(1, 10), (1, 11), (1, 12), (2, 10)]


def test_deliveries_keep_few_states_and_no_lines(spark):
    """Scans share a bounded number of states, whatever their number, and their reports are made without cutting lines."""
    given = spark.range(3000).select(F.lit("B").alias("tag_id"), F.concat(F.lit("s"), "id").alias("scan_id"), F.lit("a").alias("created_at"), (F.col("id") * 0.001).alias("seen"), F.array(F.lit("left")).alias("sides"), F.lit(1).alias("n_pages"))
    folder, counts = folder_of(spark), {}
    clocked = and_clock(given, "tag_id", "seen", 60.0).fillna({"scan_id": "clock", "created_at": "", "n_pages": 0}).withColumn("sides", F.coalesce("sides", F.array().cast("array<string>")))

    def count(part, number):
        for r in part.groupBy("what").count().collect():
            counts[r["what"]] = counts.get(r["what"], 0) + r["count"]

    ran = to_end(keyed.deliveries(feed(clocked, "seen", folder), 5.0), folder, count)
    assert counts == {"page": 3000, "closed": 3000}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, ran.recentProgress) if p["stateOperators"]]
    assert max(kept) <= 512 and kept[-1] <= 1
    plan = delivered(spark, SF, lines=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "UTF-32" not in plan


def test_batches_leave_no_shuffles_and_drafts_no_boxes(spark, some_reports):
    """Shuffle files of a feed and of each batch go with it, and the session's setting is as before. Drafts keep no boxes, and no pages are joined to themselves."""
    shuffles = lambda: {name for name in map(str, files(spark)) if "shuffle_" in name}
    before, setting = shuffles(), spark.conf.get(SWEEP, None)
    folder = folder_of(spark)
    to_end(feed(some_reports, "seen", folder), folder, tables.merge_reports(folder))
    assert shuffles() <= before and spark.conf.get(SWEEP, None) == setting
    assert "bbox" not in spark.read.parquet(f"{folder}/drafts").schema["lines"].dataType.simpleString()
    assert "Join" not in ingest(some_reports)[0]._jdf.queryExecution().optimizedPlan().toString()


def files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    found = env.blockManager().diskBlockManager().getAllFiles().iterator()
    while found.hasNext():
        yield found.next().getName()


def test_reports_in_ranges_are_the_same(spark):
    """Pages dealt by book and scan before lines are cut make the same reports, each range after the one before."""
    own = delivered(spark, SF, ranges=5).where("tag_id like '%-0'")
    placed = own.select("tag_id", "seen", "created_at", F.sha2(F.to_json("pages"), 256).alias("digest"), F.spark_partition_id().alias("at"))
    got = placed.toPandas()
    want = delivered(spark, SF).where("tag_id like '%-0'").select("tag_id", "seen", "created_at", F.sha2(F.to_json("pages"), 256).alias("digest")).toPandas()
    columns = ["tag_id", "seen", "created_at", "digest"]
    assert rows(got, columns) == rows(want, columns) and len(got) > 10
    ends = [(min(zip(g["tag_id"], g["seen"])), max(zip(g["tag_id"], g["seen"]))) for _, g in got.groupby("at")]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
