"""Sinks: keyed upserts, nested reports, archives, deletion and a latest view, all on partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import TEXT_KINDS
from ..operators.stitch import latest


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` added, or put in place of those with equal keys; of several new ones the last by ``ingest_seq`` counts."""
    return stored.join(latest(new, keys, ["ingest_seq"]).select(*keys), keys, "left_anti").unionByName(latest(new, keys, ["ingest_seq"]), allowMissingColumns=True)


def write_books(rows: DataFrame, path: str, book: str = "tag_id") -> None:
    """Overwrite the partitions of the books that ``rows`` holds, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(book).parquet(path)


def delete_book(rows: DataFrame, tag: str, book: str = "tag_id") -> DataFrame:
    return rows.where(F.col(book) != tag)


def report(pages: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One nested document per book: pages with their blocks, reading chunks in order, and the combined text."""
    own = blocks.where(F.col("kind").isin(*TEXT_KINDS)).groupBy("tag_id", "page_id").agg(F.sort_array(F.collect_list(F.struct("paragraph", "kind", "text"))).alias("layout_blocks"))
    page = pages.join(own, ["tag_id", "page_id"], "left").groupBy("tag_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "page_id", "layout_blocks"))).alias("pages"))
    said = chunks.groupBy("tag_id").agg(F.sort_array(F.collect_list(F.struct("position", "text", "complete"))).alias("reading_chunks"))
    both = page.join(said, "tag_id", "left")
    return both.withColumn("combined_text", F.array_join(F.transform("reading_chunks", lambda c: c["text"]), "\n"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def archive_period(spark: SparkSession, live: DataFrame, day: str, path: str) -> DataFrame:
    """Append one period to the archive, partitioned by day, and return what stays live."""
    live.where(F.col("period_key") == F.lit(day).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_key").parquet(path)
    return live.where(F.col("period_key") != F.lit(day).cast("date"))


def latest_view(scans: DataFrame, book: str = "tag_id") -> DataFrame:
    """The last scan of each book."""
    return latest(scans, [book], ["created_at", "scan_id"])


#: Folders of a capture that nothing reads after recognition.
TRANSIENT = ("raw", "rectified", "case", "ocr", "debug")


def expired(artifacts: DataFrame, mode: str, stage: str, event: str) -> DataFrame:
    """Artifacts (scan_id, kind) that a cleanup removes after an event: none in mode "debug". After recognition, if that is the configured
    stage, transient folders and the recognition output; after ingestion everything of the scan."""
    if mode not in ("debug", "production") or stage not in ("after-ocr", "after-ingest"):
        raise ValueError(f"unknown cleanup {mode!r}, {stage!r}")
    if mode == "debug" or (event == "after-ocr" and stage != "after-ocr"):
        return artifacts.where(F.lit(False))
    return artifacts.where(F.col("kind").isin(*TRANSIENT, "ocr_output")) if event == "after-ocr" else artifacts


def write_documents(rows: DataFrame, library: str, ending: str = "json") -> int:
    """Write each row (tag_id, kind, key, document) as <library>/<tag_id>/<kind>/<key>.<ending>, under a temporary name until it is whole; the
    last of equal keys counts (by ingest_seq, where there is one). Returns the number of files."""
    from collections.abc import Iterator

    import pyarrow as pa
    import pyarrow.fs as fs

    keys = ["tag_id", "kind", "key"]
    own = latest(rows, keys, ["ingest_seq"]) if "ingest_seq" in rows.columns else rows
    root = library.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            store, at = fs.FileSystem.from_uri(root)
            for tag, kind, key, document in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{at}/{tag}/{kind}"
                store.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{key}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as out:
                    out.write((document or "").encode())
                store.move(temporary, f"{folder}/{key}.{ending}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return own.select(*keys, "document").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def average_confidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ocr_line_count, avg_confidence) of recognised lines."""
    return lines.groupBy(*keys).agg(F.count("*").alias("ocr_line_count"), F.avg("confidence").alias("avg_confidence"))


def capture_report(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """One nested document per scan: pages (tag_id, scan_id, page_id, slot, rotation_deg, orientation_reason, timings) with their lines, the
    number of these and their average confidence, 0.0 without lines, and the sums of the pages' timings."""
    from ..operators.metrics import total_seconds

    keys = ["tag_id", "scan_id", "page_id"]
    every = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_index", "text", "confidence"))).alias("ocr_lines"))
    both = pages.join(every, keys, "left").join(average_confidence(lines, keys), keys, "left")
    page = F.struct("page_id", "slot", "rotation_deg", "orientation_reason", F.coalesce("ocr_line_count", F.lit(0)).alias("ocr_line_count"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), "ocr_lines", total_seconds(F.col("timings")).alias("seconds"))
    own = both.select("tag_id", "scan_id", page.alias("page")).groupBy("tag_id", "scan_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    return own.withColumn("total_seconds", F.aggregate("pages", F.lit(0.0), lambda a, p: a + p["seconds"]))


def enhancement_manifest(pages: DataFrame, mode: str, denoise: bool) -> DataFrame:
    """One nested document per scan: how page images were enhanced, and where the results are; pages by id."""
    page = F.struct("page_id", "source_path", "ocr_output_path", "timings")
    return pages.select("tag_id", "scan_id", "page_id", page.alias("page")).groupBy("tag_id", "scan_id").agg(F.sort_array(F.collect_list(F.struct("page_id", F.to_json("page").alias("page")))).alias("p")).select(
        "tag_id", "scan_id", F.lit(mode).alias("ocr_input_mode"), F.lit(denoise).alias("denoise_enabled"), F.transform("p", lambda x: x["page"]).alias("pages")
    )


def evict(tables: dict[str, DataFrame], tag: str, book: str = "tag_id") -> dict[str, DataFrame]:
    """All tables of a library without a book: its pages, chapters, summaries and aliases, and the state that depends on it."""
    return {name: delete_book(rows, tag, book) for name, rows in tables.items()}
