"""Streaming queries over stored rows: each view is written to the shared folder as files of a stream, run to its end, and the sink is read."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import DAY_START_HOUR
from ..operators import sections
from ..plans.queries import _book_pages, _spoken
from ..plans.records import _reports
from ..plans.views import table, v_pages, v_usage
from ..session import shared_dir, swept, written
from . import folds, keyed, status, tables

STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FILES = 4


def query(f):
    STREAMS[f.__name__] = f
    return f


def folder_of(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"


def feed(rows: DataFrame, order: str, folder: str, dealt: bool = False) -> DataFrame:
    """Rows in ``order`` as a stream of several micro-batches. Each range of the order is a file; their times, by which the source takes them, are set to follow it.
    ``dealt``: partitions are ranges of the order already, and a batch takes as many of their files as make FILES batches."""
    spark = rows.sparkSession
    own = rows if dealt else rows.repartitionByRange(FILES, order).sortWithinPartitions(order)
    with swept(spark):
        own.write.option("compression", tables.CODEC).parquet(f"{folder}/in")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(f"{folder}/in").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in files.listStatus(path(f"{folder}/in")) if f.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        files.setTimes(path(name), 1_000_000_000_000 + 1000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-len(names) // FILES))).parquet(f"{folder}/in")


def to_end(made: DataFrame, folder: str, store: Callable[[DataFrame, int], None], mode: str = "append"):
    """Run a stream until its source is at its end; returns the query, which has ended."""
    with swept(made.sparkSession):
        ran = made.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    ran.awaitTermination()
    return ran


def replay(spark: SparkSession, rows: DataFrame, order: str, work: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Rows in ``order`` as a stream of several micro-batches through ``work``; what the sink holds at the end."""
    folder = folder_of(spark)
    made = work(feed(rows, order, folder))

    def store(part: DataFrame, number: int) -> None:
        # The same batch may be run again: it overwrites what it wrote.
        part.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    to_end(made, folder, store, mode)
    return spark.read.schema(made.schema).parquet(f"{folder}/out/*")


def and_clock(rows: DataFrame, key: str, order: str, after: float) -> DataFrame:
    """``rows`` and one of a clock, ``after`` seconds beyond the last, by which watermarks move on when nothing else comes."""
    last = rows.agg((F.max(order) + after).alias(order)).where(F.col(order).isNotNull())
    return rows.unionByName(last.withColumn(key, F.lit(CLOCK_KEY)), allowMissingColumns=True)


CLOCK_KEY = "clock"


def daily_windows(events: DataFrame) -> DataFrame:
    """Events and positive audio seconds per book and reporting day, a day's window beginning at four."""
    day = F.window("ts", "1 day", "1 day", f"{DAY_START_HOUR} hours")
    return events.groupBy(day.alias("w"), "tag_id").agg(F.count("*").alias("n"), F.round(F.sum(F.when((F.col("kind") == "audio") & (F.col("seconds") > 0), F.col("seconds")).otherwise(0.0)), 3).alias("audio_seconds")).select(F.to_date("w.start").alias("period_key"), "tag_id", "n", "audio_seconds")


@query
def stream_usage_window(spark, sf_dir):
    rows = v_usage(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return replay(spark, rows, "ts", daily_windows, "complete")


def guard_rows(spark, sf_dir) -> DataFrame:
    """Left pages of books with some scans repeated and some delivered out of order."""
    p = F.col("page_number")
    left = v_pages(spark, sf_dir).where("side = 'left'").select("tag_id", "scan_id", p.cast("double").alias("seq"), F.array(p, p + 1).alias("numbers"))
    again = left.where("seq % 20 = 1").select("tag_id", F.concat(F.lit("again_"), "scan_id").alias("scan_id"), (F.col("seq") + 0.5).alias("seq"), "numbers")
    back = left.where("seq % 34 = 1").select("tag_id", F.concat(F.lit("back_"), "scan_id").alias("scan_id"), (F.col("seq") + 10.5).alias("seq"), "numbers")
    return left.unionByName(again).unionByName(back)


@query
def sequence_guard(spark, sf_dir):
    return folds.batch(guard_rows(spark, sf_dir), "tag_id", folds.GUARD)


@query
def stream_sequence_guard(spark, sf_dir):
    return replay(spark, guard_rows(spark, sf_dir), "seq", keyed.guarded)


def tail_rows(spark, sf_dir) -> DataFrame:
    return _spoken(spark, sf_dir).select("tag_id", "side", "tail_fragment", (F.regexp_extract("created_at", r":(\d\d):", 1).cast("double")).alias("seq"))


@query
def stream_pending_tail(spark, sf_dir):
    return replay(spark, tail_rows(spark, sf_dir), "seq", lambda s: folds.stream(s, "tag_id", folds.PENDING_TAIL))


@query
def stream_sections(spark, sf_dir):
    facts = sections.page_facts(sections.assembly_order(_book_pages(spark, sf_dir)))
    return replay(spark, facts, "position", lambda s: folds.stream(s, "tag_id", folds.SECTIONS))


def panel_rows(spark, sf_dir) -> DataFrame:
    """Panel events of a user: presses, releases and steps, close together in time."""
    names = F.array(*map(F.lit, (*folds.CHORD, "encoder_button")))
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "down").when(F.col("event_type") == "view", "down").when(F.col("event_type") == "signup", "step").otherwise("up")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("panel"), (k * 0.02).alias("t"), kind.alias("event_type"), F.get(names, (k % 4).cast("int")).alias("control"), F.when(k % 2 == 0, 1).otherwise(-1).alias("delta"))


@query
def chord_actions(spark, sf_dir):
    return folds.batch(panel_rows(spark, sf_dir), "panel", folds.CHORDS)


@query
def stream_chord(spark, sf_dir):
    """A press without release or another event acts when its window is over."""
    rows = and_clock(panel_rows(spark, sf_dir), "panel", "t", 1.0)
    return replay(spark, rows, "t", lambda s: keyed.timed(s, "panel", folds.CHORDS))


def stored_sections(spark, sf_dir) -> DataFrame:
    """The first half of each book's sections, as stored ones."""
    bounds = sections.boundaries(sections.assembly_order(_book_pages(spark, sf_dir)))
    half = bounds.groupBy("tag_id").agg(F.floor(F.max("sequence") / 2).alias("half"))
    return bounds.join(half, "tag_id").where("sequence <= half").drop("half")


@query
def stream_sections_resumed(spark, sf_dir):
    """A stream without its checkpoint, begun after stored sections and fed with all pages."""
    facts = sections.page_facts(sections.assembly_order(_book_pages(spark, sf_dir)))
    return replay(spark, facts, "position", lambda s: keyed.timed(s, "tag_id", folds.SECTIONS, initial=sections.resumed(stored_sections(spark, sf_dir))))


@query
def stream_book_deleted(spark, sf_dir):
    """Each book is deleted after half of its pages and made anew from its first page."""
    facts = sections.page_facts(sections.assembly_order(_book_pages(spark, sf_dir))).withColumn("control", F.lit(None).cast("string"))
    half = facts.groupBy("tag_id").agg(F.floor(F.count("*") / 2).cast("double").alias("half"))
    every = facts.join(half, "tag_id")
    first = every.where("position < half").withColumn("seq", F.col("position").cast("double"))
    gone = half.withColumn("seq", F.col("half") + 0.5).withColumn("control", F.lit(folds.FORGET))
    again = every.withColumn("seq", F.col("half") + 1 + F.col("position"))
    rows = first.unionByName(gone, allowMissingColumns=True).unionByName(again).drop("half")
    return replay(spark, rows, "seq", lambda s: keyed.timed(s, "tag_id", replace(folds.SECTIONS, order=("seq",))))


FEED_SECONDS, FEED_GRACE = 86_400, 21_600


def feed_rows(spark, sf_dir) -> DataFrame:
    """Frames and starts of the feeds of users."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("feed"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "signup").alias("is_start"))


@query
def stream_silent_feeds(spark, sf_dir):
    """Feeds that fell silent, as soon as the clock has passed their time; those that may still go on aren't reported."""
    return replay(spark, feed_rows(spark, sf_dir), "ts", lambda s: keyed.silent_feeds(s.withWatermark("ts", "0 seconds"), "feed", FEED_SECONDS, FEED_GRACE))


@query
def silent_feeds(spark, sf_dir):
    """All pauses and ends of feeds in the table."""
    return keyed.silent_feeds(feed_rows(spark, sf_dir), "feed", FEED_SECONDS, FEED_GRACE)


def seen_usage(spark, sf_dir) -> DataFrame:
    """Usage as it is seen: at once, but three days later for one page key."""
    ts = F.col("ts").cast("timestamp")
    return v_usage(spark, sf_dir).where("kind is not null").withColumn("ts", ts).withColumn("seen", F.when(F.col("page_key") == "42", ts + F.expr("INTERVAL 3 DAYS")).otherwise(ts))


@query
def stream_closed_days(spark, sf_dir):
    """Reporting days, each given out once when it is over, with those between that nobody used; late events by themselves."""
    folder = folder_of(spark)
    to_end(keyed.closed_days(feed(seen_usage(spark, sf_dir), "seen", folder)), folder, tables.archive_days(folder))
    late = tables.stored(spark, f"{folder}/late", tables.LATE).groupBy(F.lit("late").alias("status"), "period_key", "tag_id").agg(F.count("*").alias("pages_scanned"))
    return tables.stored(spark, f"{folder}/periods", tables.PERIODS).drop(tables.BATCH).unionByName(late, allowMissingColumns=True)


def delivered(spark, sf_dir, lines: bool = True, ranges: int | None = None) -> DataFrame:
    """Reports as they arrive: of a scan that has a left page a report of that alone, a second later the whole one."""
    whole = _reports(spark, sf_dir, lines, ranges).withColumn("seen", F.substring("scan_id", 6, 10).cast("double") * 10 + 1)
    # Both are made of the one row, so that its lines are cut once.
    left = F.struct(F.concat(F.lit("s"), "scan_id").alias("created_at"), (F.col("seen") - 1).alias("seen"), F.filter("pages", lambda p: p["slot"] == "LEFT").alias("pages"))
    each = whole.select("tag_id", "scan_id", "language", F.inline(F.array(F.struct("created_at", "seen", "pages"), left)))
    return each.where("size(pages) > 0").select(whole.columns)


@query
def stream_report_ingest(spark, sf_dir):
    """Reports through ingestion as they arrive."""
    folder = folder_of(spark)
    # Books are scanned one after another, so a batch holds reports of some books and not of all.
    ranges = max(FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    to_end(feed(delivered(spark, sf_dir, ranges=ranges), "seen", folder, dealt=True), folder, tables.merge_reports(folder))
    columns = "tag_id string, scan_id string, side string, page_id string, page_number int, chapter_number int, chapter_heading string, clean_text string"
    return tables.merged_pages(spark, folder, columns).select([c.split()[0] for c in columns.split(", ")])


@query
def stream_report_redelivery(spark, sf_dir):
    """Which pages are read out when, while reports arrive, and what is stored once a scan is closed."""
    sides = F.transform("pages", lambda p: F.lower(p["slot"]))
    # Which sides a report holds doesn't hang on its lines, so none are cut; the clock and the feed's ranges ask for the rows again.
    rows = written(delivered(spark, sf_dir, lines=False).select("tag_id", "scan_id", "created_at", "seen", sides.alias("sides"), F.size("pages").alias("n_pages")), "delivered")
    out = replay(spark, and_clock(rows, "tag_id", "seen", 10.0).fillna({"scan_id": CLOCK_KEY, "created_at": "", "n_pages": 0}).withColumn("sides", F.coalesce("sides", F.array().cast("array<string>"))), "seen", lambda s: keyed.deliveries(s, 5.0))
    closed = out.where("what = 'closed'").select("tag_id", "scan_id", "n_stored")
    return out.where("what = 'page'").select("tag_id", "scan_id", "delivery", "side", "read").join(closed, ["tag_id", "scan_id"])


def mailbox(spark, sf_dir) -> DataFrame:
    """Listings of a mailbox: messages, some of them listed again forty days later, and some under new numbers after a reset."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("uid_validity"), F.col("o_orderkey").alias("uid"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    again = orders.where("uid % 4 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
    reset = orders.where("uid % 8 = 0").withColumn("uid_validity", F.col("uid_validity") + 3)
    return orders.unionByName(again).unionByName(reset)


@query
def stream_mail(spark, sf_dir):
    """Messages that a mailbox lists again and again, each handled once; a reset mailbox numbers anew."""
    folder = folder_of(spark)
    seen = feed(mailbox(spark, sf_dir), "ts", folder)
    # Within ten days Spark's own state knows what was seen; the ledger knows for ever.
    to_end(seen.withWatermark("ts", "10 days").dropDuplicatesWithinWatermark(["uid_validity", "uid"]), folder, tables.handle_mail(folder))
    return tables.stored(spark, f"{folder}/handled", tables.MAIL).select("uid_validity", "uid")


@query
def stream_batch_status(spark, sf_dir):
    """What callbacks and the listener told of the batches in which mail was handled."""
    folder = folder_of(spark)
    log = status.ProgressLog(f"{folder}/progress")
    spark.streams.addListener(log)
    try:
        to_end(feed(mailbox(spark, sf_dir), "ts", folder), folder, status.observed(tables.handle_mail(folder), folder))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    told = status.events(spark, folder).groupBy(F.lit("callback").alias("source"), "status").agg(F.sum("n_rows").alias("n_rows"))
    logged = status.progress(spark, f"{folder}/progress").groupBy(F.lit("listener").alias("source"), "status").agg(F.sum("n_input").alias("n_rows"))
    return told.unionByName(logged)
