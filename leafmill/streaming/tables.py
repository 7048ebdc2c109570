"""Sinks of micro-batches that may run again: what a batch writes lies in a folder of its number, and it reads only what batches before it wrote.

So a batch that is run twice, after a failure or in a new application, leaves the tables as they are after one run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stitch
from ..plans import ingest

BATCH = "_batch"
#: Of files that hold texts: they take about half of what Spark's default makes of them.
CODEC = "zstd"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def put(part: DataFrame, folder: str, number: int) -> DataFrame:
    """Write a batch's rows, in place of those of an earlier run of it, and return them as they are stored."""
    path = f"{folder}/{BATCH}={number}"
    part.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def stored(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, with the number of their batch."""
    whole = f"{schema}, {BATCH} int"
    rows = spark.read.schema(whole).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], whole)
    return rows if before is None else rows.where(F.col(BATCH) < before)


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


# --- closed reporting days

PERIODS = "status string, period_key date, tag_id string, pages_scanned bigint, audio_seconds double, chapter_summary_uses bigint, book_summary_uses bigint"
LATE = "tag_id string, period_key date, kind string, ts timestamp"


def archive_days(folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """For keyed.closed_days(): ``periods`` gets each closed day once, also those between that nobody used, with a null tag and zeros; ``late`` the late events."""

    def work(part: DataFrame, number: int) -> DataFrame:
        spark = part.sparkSession
        rows = put(part, f"{folder}/given", number)
        put(rows.where("status = 'late'").select("tag_id", "period_key", "kind", "ts"), f"{folder}/late", number)
        closed = rows.where("status = 'closed'").select([c.split()[0] for c in PERIODS.split(", ")])
        last = stored(spark, f"{folder}/periods", PERIODS, number).agg(F.max("period_key").alias("last"))
        span = closed.agg(F.min("period_key").alias("first"), F.max("period_key").alias("until")).crossJoin(last)  # one row each
        days = span.where("until is not null").select(F.explode(F.sequence(F.coalesce(F.date_add("last", 1), F.col("first")), F.col("until"))).alias("period_key"))
        none = days.join(closed.select("period_key").distinct(), "period_key", "left_anti")
        zeros = none.select(F.lit("empty").alias("status"), "period_key", F.lit(None).cast("string").alias("tag_id"), *[F.lit(0).cast(t).alias(c) for c, t in (x.split() for x in PERIODS.split(", ")[3:])])
        return put(closed.unionByName(zeros), f"{folder}/periods", number)

    return work


# --- reports as they arrive


def merge_reports(folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """Reports through ingestion: lines of new reports are read once and kept as drafts; books that got a report are finished and stitched anew from the
    last report of each of their scans, which takes back placeholders, carried tails and inferred numbers that no longer hold. Refused pages are listed and
    leave the others alone."""

    def work(part: DataFrame, number: int) -> DataFrame:
        spark = part.sparkSession
        new = put(ingest.drafted(ingest.deliveries(part)[0]), f"{folder}/drafts", number)
        put(new.where("lines is null").select("tag_id", "scan_id", "side"), f"{folder}/refused", number)
        books = put(part.select("tag_id").distinct(), f"{folder}/books", number)
        own = stored(spark, f"{folder}/drafts", ddl(new), number + 1).where("lines is not null").join(books, "tag_id", "left_semi")
        # A scan's pages are those of its last report.
        newest = F.max(F.struct("created_at", BATCH)).over(Window.partitionBy("tag_id", "scan_id"))
        own = own.withColumn("_newest", newest).where(F.struct("created_at", BATCH) == F.col("_newest")).drop("_newest", BATCH)
        pages = stitch.without_placeholders(ingest.stitched(ingest.finished(own)))
        return put(stitch.latest(pages, ["tag_id", "page_id"], ["created_at", "scan_id"]), f"{folder}/pages", number)

    return work


def merged_pages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The pages of each book as its last batch left them."""
    versions = stored(spark, f"{folder}/books", "tag_id string").groupBy("tag_id").agg(F.max(BATCH).alias(BATCH))
    return stored(spark, f"{folder}/pages", schema).join(versions, ["tag_id", BATCH]).drop(BATCH)


# --- mail

MAIL = "uid_validity bigint, uid bigint"


def handle_mail(folder: str, handle: Callable[[DataFrame], DataFrame] = lambda new: new) -> Callable[[DataFrame, int], DataFrame]:
    """Messages (uid_validity, uid, ...) not handled before go through ``handle`` once and into the ledger ``handled``. Numbers count within their generation of
    the mailbox, so after a reset they are new. ``handle`` must itself bear to run again for a batch that failed."""

    def work(part: DataFrame, number: int) -> DataFrame:
        done = stored(part.sparkSession, f"{folder}/handled", MAIL, number).select("uid_validity", "uid")
        new = part.dropDuplicates(["uid_validity", "uid"]).join(done, ["uid_validity", "uid"], "left_anti")
        return put(handle(new), f"{folder}/handled", number)

    return work
