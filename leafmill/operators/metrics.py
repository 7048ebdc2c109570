"""Smaller measures: timings, availability, contrast bounds, neighbour distances, gaps in a feed, and sets of keys seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def total_seconds(timings: Column) -> Column:
    """Sum of a map of timings; none is 0."""
    return F.coalesce(F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), F.lit(0.0))


def latest_source(files: DataFrame, group: str) -> DataFrame:
    """(group, version, available, source) from rows (group, source, exists, modified): the greatest time, and the preferred source
    if all its files exist, else the fallback."""
    each = files.groupBy(group, "source").agg(F.bool_and("exists").alias("available"), F.max("modified").alias("version"))
    rank = F.struct(F.when(F.col("available"), 0).otherwise(1).alias("a"), F.when(F.col("source") == "preferred", 0).otherwise(1).alias("s"))
    return each.groupBy(group).agg(F.min_by(F.struct("version", "available", "source"), rank).alias("b")).select(group, "b.*")


def contrast_bounds(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The 5th and 95th percentile of each group, linearly interpolated."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return rows.groupBy(group).agg(p.alias("p")).select(group, F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """A grey value with [low, high] spread over 0 to 255; a flat image stays as it is."""
    return F.when(high <= low, value).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - low) * 255.0 / (high - low))))


def grid(columns: int, rows: int, spacing: float) -> Column:
    """Corners (x, y) of a planar grid, row by row."""
    at = lambda k, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * k)
    return F.flatten(F.transform(at(spacing, rows), lambda y: F.transform(at(spacing, columns), lambda x: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))))


def neighbour_distance(points: DataFrame, group: str, default: float = 10.0) -> DataFrame:
    """(group, distance): the median distance of points (row, col, x, y) to their right and lower neighbours, ``default`` without any."""
    here = points.select(group, F.explode(F.array(F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c")), F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")))).alias("n"), "x", "y")
    there = points.select(group, F.col("row").alias("r"), F.col("col").alias("c"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    both = here.select(group, "n.r", "n.c", "x", "y").join(there, [group, "r", "c"])
    found = both.groupBy(group).agg(F.median(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("d"))
    return points.select(group).distinct().join(found, group, "left").select(group, F.coalesce("d", F.lit(default)).alias("distance"))


def stale_gaps(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, since, until) of pauses of a feed longer than ``seconds``."""
    w = Window.partitionBy(key).orderBy("ts")
    own = events.select(key, F.lag("ts").over(w).alias("since"), F.col("ts").alias("until"))
    return own.where(F.col("until") - F.col("since") > F.expr(f"INTERVAL {seconds} SECONDS"))


def new_keys(events: DataFrame, group: str, day: str, key: str) -> DataFrame:
    """(group, day, n): keys that a group shows on a day for the first time."""
    first = events.groupBy(group, key).agg(F.min(day).alias(day))
    return first.groupBy(group, day).agg(F.count("*").alias("n"))


def empty_scans(pages: DataFrame) -> DataFrame:
    """Scans none of whose pages has anything to say."""
    said = F.bool_or(T.trim(F.coalesce("speak_text", F.lit(""))) != "")
    return pages.groupBy("tag_id", "scan_id").agg(said.alias("said")).where("not said").select("tag_id", "scan_id")


def preferred_first(names: Column, preferred: Column) -> Column:
    """Names in order of preference, the others after them as they come."""
    ranked = F.transform(names, lambda x, i: F.struct(F.coalesce(F.nullif(F.array_position(preferred, x), F.lit(0).cast("bigint")), F.lit(2**31).cast("bigint")).alias("p"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(ranked), lambda r: r["x"])


def recap_label(start: Column, end: Column, chapter_id: Column) -> Column:
    """Label of a section's recap: its pages, or its id where they aren't known."""
    pages = F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat(F.lit("kapitel-zusammenfassung:"), F.coalesce(pages, chapter_id))


def progress_label(start: Column, end: Column) -> Column:
    """Label of a recap of what is read of an open section."""
    known = F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat(F.lit("kapitel-zusammenfassung-temporaer"), F.coalesce(known, F.lit("")))


def scan_name(ts: Column) -> Column:
    return F.concat(F.lit("scan_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def archived_day(file_name: Column) -> Column:
    """The day of an archive file, null where its name isn't one."""
    stem = F.regexp_extract(file_name, r"^(\d{4}-\d{2}-\d{2})\.json$", 1)
    return F.nullif(stem, F.lit("")).try_cast("date")


def wav_seconds(frames: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.try_divide(frames, rate))


def is_inside(path: Column, root: Column) -> Column:
    """Whether a normalised path lies under a root: no parent steps, and the root followed by a separator."""
    return path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def batch_counters(batches: DataFrame, group: str) -> DataFrame:
    """Spoken batches (text, queued_at, ready_at) per group: blocks, characters, and the first latency."""
    return batches.groupBy(group).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.min_by(F.col("ready_at") - F.col("queued_at"), "queued_at").alias("first_latency"))
