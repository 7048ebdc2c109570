"""Usage statistics per reporting day and book.

Input rows: tag_id, ts (local wall clock), kind, page_key, seconds. Kinds: scan, audio, chapter_summary, book_summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import duration, period_start, reporting_day

MEASURES = ("pages_scanned", "audio_seconds", "chapter_summary_uses", "book_summary_uses")


def measures() -> list[Column]:
    """Distinct page keys, positive seconds, and counts by kind."""
    key = F.when(F.col("kind") == "scan", F.nullif(F.trim("page_key"), F.lit("")))
    return [
        F.count_distinct(key).alias("pages_scanned"),
        F.round(F.coalesce(F.sum(F.when((F.col("kind") == "audio") & (F.col("seconds") > 0), F.col("seconds"))), F.lit(0.0)), 3).alias("audio_seconds"),
        F.count_if(F.col("kind") == "chapter_summary").alias("chapter_summary_uses"),
        F.count_if(F.col("kind") == "book_summary").alias("book_summary_uses"),
    ]


def daily(events: DataFrame) -> DataFrame:
    """A row per (period_key, tag_id). Events with an empty tag are left out; so are books of which a day holds nothing that counts."""
    own = events.withColumn("tag_id", F.upper(F.trim("tag_id"))).where(F.col("tag_id") != "").withColumn("period_key", reporting_day(F.col("ts")))
    counts = ((F.col("kind") == "scan") & (F.trim("page_key") != "")) | ((F.col("kind") == "audio") & (F.col("seconds") > 0)) | F.col("kind").isin("chapter_summary", "book_summary")
    return own.where(counts).groupBy("period_key", "tag_id").agg(*measures())


def with_totals(usage: DataFrame) -> DataFrame:
    """Rows of each book and, with a null tag, of each period's total."""
    sums = [F.sum(m).alias(m) for m in MEASURES if m != "audio_seconds"] + [F.round(F.sum("audio_seconds"), 3).alias("audio_seconds")]
    return usage.groupingSets([["period_key", "tag_id"], ["period_key"]], "period_key", "tag_id").agg(*sums).select("period_key", "tag_id", *MEASURES)


def labelled(usage: DataFrame, books: DataFrame) -> DataFrame:
    """``usage`` with "title (tag)" where the book has a title, else its tag."""
    titles = books.select("tag_id", F.nullif(F.col("title"), F.lit("")).alias("_title"))
    return usage.join(titles, "tag_id", "left").withColumn("label", F.coalesce(F.concat(F.col("_title"), F.lit(" ("), F.col("tag_id"), F.lit(")")), F.col("tag_id"))).drop("_title")


def closed_periods(usage: DataFrame, today: Column, archived: DataFrame) -> DataFrame:
    """Days to report: from the day after the last archived one, or the first with usage, or yesterday, up to yesterday."""
    known = usage.where(F.col("period_key") < today).agg(F.min("period_key").alias("first"))
    last = archived.agg(F.max("period_key").alias("last"))
    span = known.crossJoin(last)  # one row each
    since = F.coalesce(F.date_add("last", 1), F.col("first"), F.date_sub(today, 1))
    days = span.where(since < today).select(F.explode(F.sequence(since, F.date_sub(today, 1))).alias("period_key"))
    return days.join(archived.select("period_key").distinct(), "period_key", "left_anti").select("period_key", period_start(F.col("period_key")).alias("starts_at"), period_start(F.date_add("period_key", 1)).alias("ends_at"))


def gap_filled(usage: DataFrame, periods: DataFrame) -> DataFrame:
    """A row per period and book, and one with a null tag and zeros for a period without usage."""
    zero = [F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES]
    return periods.join(usage, "period_key", "left").select("period_key", "starts_at", "ends_at", "tag_id", *zero)


def report(usage: DataFrame, books: DataFrame) -> DataFrame:
    """The report of each period as lines (period_key, position, label, pages, audio, sections, book): books by tag, then the total."""
    lines = labelled(with_totals(usage), books)
    total = F.col("tag_id").isNull()
    order = Window.partitionBy("period_key").orderBy(F.col("tag_id").asc_nulls_last())
    return lines.select("period_key", F.row_number().over(order).alias("position"), "tag_id", F.when(total, "Gesamt").otherwise(F.col("label")).alias("label"), "pages_scanned", duration(F.col("audio_seconds")).alias("audio"), "chapter_summary_uses", "book_summary_uses")


def archived(usage: DataFrame, archive: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(live, archive) after the move of one period."""
    return usage.where(F.col("period_key") != day), archive.unionByName(usage.where(F.col("period_key") == day))
