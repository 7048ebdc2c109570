"""From recognition reports to finished pages, for all books at once; the steps and their order are those of single-report ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.language import LABELS, language
from ..operators import stitch, structure
from ..sources.readers import report_pages, sided_pages


def deliveries(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, readings): of scans that are delivered in parts, the left page first and both pages later, the last report; and for each
    delivery (tag_id, scan_id, delivery, side, read) whether its page is read out, which is so when no delivery before it held that side."""
    order = Window.partitionBy("tag_id", "scan_id").orderBy("created_at")
    numbered = reports.withColumn("delivery", F.row_number().over(order))
    last = numbered.groupBy("tag_id", "scan_id").agg(F.max_by(F.struct(*reports.columns), "delivery").alias("r")).select("r.*")
    sides = report_pages(numbered)[0].select("tag_id", "scan_id", "delivery", "side")
    first = F.min("delivery").over(Window.partitionBy("tag_id", "scan_id", "side"))
    return last, sides.withColumn("read", F.col("delivery") == first)


def drafted(reports: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All pages of reports (tag_id, scan_id, created_at, language, pages) with their lines and numbers; those that are refused have null ``lines``. Where lines
    lie on the page is asked for here alone, so their boxes aren't kept; ``foot`` is the line to drop if the page's number is inferred later."""
    every = sided_pages(reports.withColumn("language", language(F.col("language"))))
    every = every.withColumn("file_lines", F.lit(None).cast("array<string>")) if texts is None else every.withColumn("text_path", F.when(F.col("known"), F.col("page.text_path"))).join(texts.select("text_path", "file_lines"), "text_path", "left")
    lines = structure.page_lines(F.col("page.ocr_lines"), F.col("file_lines"), F.col("page.paragraphs"))
    own = every.withColumn("lines", F.when(F.col("known"), lines)).withColumn("n", structure.page_number(F.col("lines"), F.col("page.page_number")))
    foot = F.when(F.col("n.number").isNull(), structure.footer_artifact(F.col("lines")))
    plain = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["index"].alias("index")))
    own = own.withColumn("foot", foot).withColumn("lines", plain)
    return own.select("tag_id", "scan_id", "created_at", "language", "side", F.col("page.page_id").alias("report_page_id"), "lines", F.col("n.position").alias("number_position"), F.col("n.number").alias("page_number"), "foot", F.col("page.layout_blocks").alias("blocks"))


def drafts(reports: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, refused) of reports (tag_id, scan_id, created_at, language, pages): lines and numbers of each page. Pages without a side or
    without any text are refused. ``texts``: (text_path, file_lines) of the text files that reports name; they are asked where a page has no lines of its own."""
    every = drafted(reports, texts)
    return every.where("lines is not null"), every.where("lines is null").select("tag_id", "scan_id", "side")


def finished(pages: DataFrame) -> DataFrame:
    """Drafts with numbers inferred, and with markers, clean text, tail and spoken text."""
    numbered = stitch.spread_numbers(pages)
    foot = F.when(F.col("inferred"), F.col("foot"))
    own = numbered.withColumn("lines", structure.without(F.col("lines"), F.col("number_position"), foot))
    own = own.withColumn("chapter_markers", structure.chapter_markers(F.col("lines"))).withColumn("clean_text", structure.clean_text(F.col("lines")))
    tail = structure.tail_fragment(F.col("clean_text"), F.col("chapter_markers"))
    ends = structure.remapped(structure.paragraph_ends(F.col("blocks")), F.col("lines"))
    own = own.withColumn("tail_fragment", tail["fragment"]).withColumn("speak_text", structure.speak_text(F.col("lines"), F.col("chapter_markers"), ends, F.col("language"), LABELS))
    own = own.withColumn("speak_text", T.without_suffix(F.col("speak_text"), F.col("tail_fragment")))
    first = F.get("chapter_markers", F.lit(0))
    identity = T.page_id(F.col("page_number"), F.col("report_page_id"), F.col("scan_id"), F.col("side"))
    return own.withColumn("page_id", identity).withColumn("chapter_number", first["chapter_number"]).withColumn("chapter_heading", first["chapter_heading"]).drop("lines", "blocks", "number_position", "foot")


def stitched(pages: DataFrame) -> DataFrame:
    """Finished pages with tails carried from page to page."""
    own = stitch.carry_to_next(stitch.readout(pages))
    # A target without a number takes the tail that the book holds pending.
    waiting = stitch.pending_tail(own)
    none = F.count("page_number").over(stitch.Window.partitionBy(*stitch.SPREAD)) == 0
    first = F.row_number().over(stitch.Window.partitionBy(*stitch.SPREAD).orderBy(F.when(F.col("side") == "left", 0).otherwise(1))) == 1
    takes = F.col("_takes") & F.col("pending").isNotNull()
    waiting = waiting.withColumn("_takes", none & first).withColumn("speak_text", F.when(takes, T.with_prefix(F.col("pending"), F.col("speak_text"))).otherwise(F.col("speak_text"))).drop("_takes", "pending", "carried")
    return stitch.carried_in_spread(waiting)


def ingest(reports: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, refused): finished and stitched pages of the last report of each scan, placeholders of pages numbered later left out, the last
    version of each page."""
    found, refused = drafts(deliveries(reports)[0], texts)
    pages = stitch.without_placeholders(stitched(finished(found)))
    return stitch.latest(pages, ["tag_id", "page_id"], ["created_at", "scan_id"]), refused
