"""Registered queries on stored documents, reports, device and tool lines, labels and small measures; oracle_records.py holds their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import language as L
from ..functions import numbers as N
from ..functions import speech as S
from ..functions import text as T
from ..operators import identity, layout, metrics, structure, summaries
from ..session import shared_dir, ship
from ..sources import library, readers, recognisers, sinks
from ..streaming import folds
from . import ingest
from .queries import PAGE, Query, _cleaned, _summaries, usage_daily
from .views import page_lines, table, v_lines, v_page_lines, v_pages, v_turns, v_words

RECORDS: dict[str, Query] = {}
KINDS = ("raw", "rectified", "case", "ocr", "debug", "ocr_output", "page")


def query(f: Query) -> Query:
    RECORDS[f.__name__] = f
    return f


def _library(spark: SparkSession) -> str:
    ship(spark)
    return f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}/library-{uuid.uuid4().hex[:12]}"


# --- stored documents


@query
def library_pages(spark, sf_dir):
    """Turns written as one document each and read back in storage order."""
    own = v_turns(spark, sf_dir).withColumn("page_id", T.page_id(F.col("page_number"), F.col("report_page_id"), F.col("scan_id"), F.col("side")))
    key = F.coalesce(readers.lookup_key(F.col("page_number")), F.concat_ws("_", "scan_id", "side"))
    root = _library(spark)
    sinks.write_documents(own.select("tag_id", F.lit("pages").alias("kind"), key.alias("key"), F.to_json(F.struct("page_id", "scan_id", "created_at", "side", "clean_text", "page_number")).alias("document")), root)
    return readers.stored_order(readers.pages(spark, root)).select("tag_id", "scan_id", "side", "page_id", "page_number", "clean_text", "position")


@query
def library_versions(spark, sf_dir):
    """Turns as documents of a library, in two committed versions; the second replaces those of the right side."""
    own = v_turns(spark, sf_dir).select("tag_id", F.lit("pages").alias("kind"), F.col("created_at").alias("key"), F.col("clean_text").alias("document"), "side")
    root = _library(spark)
    library.save(own, root, "txt")
    library.save(own.where("side = 'right'").withColumn("document", F.concat("document", F.lit(" (2)"))), root, "txt")
    return library.load(spark, root).select("tag_id", "key", "version", "document")


@query
def library_chapters(spark, sf_dir):
    own = _summaries(spark, sf_dir).withColumn("n", F.regexp_extract("chapter_id", r"(\d+)$", 1).cast("int")).withColumn("start_page", F.when(F.col("n") % 3 != 0, 20 - F.col("n")))
    root = _library(spark)
    sinks.write_documents(own.select("tag_id", F.lit("chapters").alias("kind"), F.col("chapter_id").alias("key"), F.to_json(F.struct("chapter_id", "created_at", "start_page")).alias("document")), root)
    return readers.chapters(spark, root).select("tag_id", "chapter_id", "start_page", "position")


@query
def page_lookup(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("page_"), k.cast("string"))).otherwise((k % 12000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", readers.lookup_key(key).alias("stored_key"))


@query
def book_aliases(spark, sf_dir):
    """Alias files of books, with one more alias each, and whether a book has a wanted one."""
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("tag_id"), (F.col("s_suppkey") % 40).alias("s"))
    lines = own.groupBy("tag_id").agg(F.sort_array(F.collect_list(F.concat(F.lit(" u"), F.col("s").cast("string"), F.lit(" ")))).alias("l"))
    root = _library(spark)
    sinks.write_documents(lines.select("tag_id", F.lit("state").alias("kind"), F.lit("aliases").alias("key"), F.concat(F.array_join("l", "\n"), F.lit("\n\n"), F.get("l", F.lit(0))).alias("document")), root, "txt")
    known = identity.aliases(readers.alias_lines(spark, root))
    more = identity.with_aliases(known, lines.select("tag_id", F.explode(F.array(F.lit("U7"), F.concat(F.lit("X"), "tag_id"))).alias("alias")))
    wanted = identity.books_with_alias(known, spark.createDataFrame([("U7",), ("U11",)], "alias string")).withColumn("wanted", F.lit(True))
    return more.join(wanted, "tag_id", "left").select("tag_id", "alias", F.coalesce("wanted", F.lit(False)).alias("wanted"))


# --- reports


def _reports(spark, sf_dir, lines: bool = True, ranges: int | None = None) -> DataFrame:
    """Scans of two pages as reports; the number of every page is to be found. Without ``lines``, for what asks of a page only that it is there, none is cut.
    In so many ``ranges`` by book and scan if given: pages are dealt and sorted before their lines are cut, which take several times the room of the text."""
    own = v_pages(spark, sf_dir)
    if ranges:
        own = own.repartitionByRange(ranges, "tag_id", "scan_id").sortWithinPartitions("tag_id", "scan_id")
    pages = page_lines(own) if lines else own
    none = lambda kind: F.lit(None).cast(kind)
    ocr = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), F.lit(0.9).alias("confidence"), x["bbox"].alias("bbox"), none("map<string,string>").alias("metadata"))) if lines else none(f"array<{readers.OCR_LINE}>")
    page = F.struct(
        F.when(F.col("side") == "left", "page_1").otherwise("page_2").alias("page_id"), F.upper("side").alias("slot"), F.lit("").alias("side"), none("int").alias("page_number"), F.concat_ws("/", "tag_id", F.col("page_number").cast("string")).alias("text_path"),
        none("array<string>").alias("paragraphs"), none(f"array<{readers.BLOCK}>").alias("layout_blocks"), ocr.alias("ocr_lines"), F.col("page_number").alias("true_number"),
    )
    return pages.select("tag_id", "scan_id", "language", page.alias("page")).groupBy("tag_id", "scan_id").agg(F.first("language").alias("language"), *[F.first(F.when(F.col("page.page_id") == p, F.col("page")), ignorenulls=True).alias(p) for p in ("page_1", "page_2")]).select("tag_id", "scan_id", F.concat(F.lit("t"), "scan_id").alias("created_at"), "language", F.array_compact(F.array("page_1", "page_2")).alias("pages"))


@query
def report_lines(spark, sf_dir):
    """Lines of report pages from the first source that has any: recognised, text file, paragraphs; pages without a side or text are refused."""
    n = lambda p: p["true_number"] % 9
    blank = F.array(F.struct(F.lit(" ").alias("text"), F.lit(0.0).alias("confidence"), F.lit(None).cast(readers.POINTS).alias("bbox"), F.lit(None).cast("map<string,string>").alias("metadata")))
    changed = F.transform("pages", lambda p: p.withField("ocr_lines", F.when(n(p) < 4, blank).otherwise(p["ocr_lines"])).withField("paragraphs", F.when(n(p) == 2, F.array(F.lit(" "), F.lit("P"))).when(n(p) == 1, F.array(F.lit("Q")))).withField("slot", F.when(n(p) == 8, "middle").otherwise(p["slot"])))
    texts = v_page_lines(spark, sf_dir).where("page_number % 9 in (0, 1)").select(F.concat_ws("/", "tag_id", F.col("page_number").cast("string")).alias("text_path"), F.array(F.lit("F"), F.lit(""), F.lit("G")).alias("file_lines"))
    good, bad = ingest.drafts(_reports(spark, sf_dir).withColumn("pages", changed), texts)
    first = F.get("lines", F.lit(0))
    return good.select("tag_id", "scan_id", "side", F.size("lines").alias("n_lines"), first["text"].alias("head")).unionByName(bad.select("tag_id", "scan_id", "side", F.lit(-1).alias("n_lines"), F.lit(None).cast("string").alias("head")))


@query
def report_ingest(spark, sf_dir):
    """Whole reports through ingestion."""
    pages = ingest.ingest(_reports(spark, sf_dir))[0]
    return pages.select("tag_id", "scan_id", "side", "page_id", "page_number", "chapter_number", "chapter_heading", "clean_text")


@query
def report_redelivery(spark, sf_dir):
    """Scans delivered twice, the left page first: which pages are read out when, and that the last report is what is stored."""
    both = _reports(spark, sf_dir, lines=False)
    left = both.withColumn("pages", F.filter("pages", lambda p: p["slot"] == "LEFT")).where("size(pages) > 0").withColumn("created_at", F.concat(F.lit("s"), "scan_id"))
    last, readings = ingest.deliveries(both.unionByName(left))
    kept = last.select("tag_id", "scan_id", F.size("pages").alias("n_stored"))
    return readings.join(kept, ["tag_id", "scan_id"])


@query
def run_report(spark, sf_dir):
    t = v_turns(spark, sf_dir).withColumn("page_id", F.concat_ws("_", "scan_id", "side"))
    blocks = t.select("tag_id", "page_id", F.lit(1).alias("paragraph"), F.when(F.col("side") == "left", "paragraph").otherwise("page_number").alias("kind"), F.col("clean_text").alias("text"))
    chunks = t.select("tag_id", "created_at", "clean_text").select("tag_id", F.col("created_at").alias("position"), F.col("clean_text").alias("text"), F.lit(True).alias("complete"))
    made = sinks.report(t.select("tag_id", "page_id", "page_number"), blocks, chunks)
    n_blocks = F.aggregate("pages", F.lit(0), lambda a, p: a + F.coalesce(F.size(p["layout_blocks"]), F.lit(0)))
    return made.select("tag_id", F.size("pages").alias("n_pages"), F.when(n_blocks < 0, 0).otherwise(n_blocks).alias("n_blocks"), F.size("reading_chunks").alias("n_chunks"), F.sha2("combined_text", 256).alias("digest"))


@query
def capture_report(spark, sf_dir):
    """Scans with the number of their lines and their confidence; every eleventh page has none."""
    page_id = F.when(F.col("side") == "left", "page_1").otherwise("page_2").alias("page_id")
    pages = v_pages(spark, sf_dir).select("tag_id", "scan_id", page_id, F.col("side").alias("slot"), F.lit(0).alias("rotation_deg"), F.lit("default").alias("orientation_reason"), F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.col("page_number") * 0.25).alias("timings"))
    lines = v_lines(spark, sf_dir).where("page_number % 11 <> 0").select("tag_id", "scan_id", page_id, "line_index", "text", "confidence")
    made = sinks.capture_report(pages, lines).select("tag_id", "scan_id", "total_seconds", F.explode("pages").alias("p"))
    return made.select("tag_id", "scan_id", F.round("total_seconds", 6).alias("total_seconds"), "p.page_id", "p.ocr_line_count", F.round("p.avg_confidence", 9).alias("avg_confidence"))


@query
def enhancement_manifest(spark, sf_dir):
    pages = v_turns(spark, sf_dir).select("tag_id", "scan_id", F.col("side").alias("page_id"), F.concat_ws("/", "tag_id", "scan_id", "side").alias("source_path"), F.concat(F.lit("ocr/"), "side", F.lit(".png")).alias("ocr_output_path"), F.create_map(F.lit("s"), F.lit(1.5)).alias("timings"))
    # Turns may repeat a side within a scan; a page is one image.
    made = sinks.enhancement_manifest(pages.dropDuplicates(["tag_id", "scan_id", "page_id"]), "gray", False)
    return made.select("tag_id", "scan_id", "ocr_input_mode", "denoise_enabled", F.array_join(F.transform("pages", lambda p: F.get_json_object(p, "$.source_path")), ",").alias("sources"))


@query
def usage_archive(spark, sf_dir):
    live = sinks.archive_period(spark, usage_daily(spark, sf_dir), "2024-01-10", path := f"{_library(spark)}-archive")
    stored = spark.read.parquet(path).select(F.col("period_key").cast("date").alias("period_key"), "tag_id", F.lit(True).alias("archived"))
    return live.select("period_key", "tag_id", F.lit(False).alias("archived")).unionByName(stored)


@query
def latest_scan(spark, sf_dir):
    return sinks.latest_view(v_turns(spark, sf_dir)).select("tag_id", "scan_id", "created_at")


@query
def book_deletion(spark, sf_dir):
    left = sinks.evict({"pages": v_turns(spark, sf_dir), "chapters": _summaries(spark, sf_dir)}, "3")
    each = [rows.groupBy("tag_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, rows in left.items()]
    return each[0].unionByName(each[1])


@query
def cleanup_plan(spark, sf_dir):
    own = v_turns(spark, sf_dir).select("tag_id", "scan_id").distinct().select("tag_id", "scan_id", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    return sinks.expired(own, "production", "after-ocr", "after-ocr")


# --- recognisers, devices, tools


@query
def recognised_lines(spark, sf_dir):
    """Lines of pages in the result shapes of four recognisers: parallel arrays, legacy entries, objects, and texts alone."""
    own = v_page_lines(spark, sf_dir).select(F.concat_ws("|", "tag_id", F.col("page_number").cast("string")).alias("page_id"), "page_number", "lines")
    texts, boxes = F.transform("lines", lambda x: F.concat(F.lit(" "), x["text"])), F.transform("lines", lambda x: x["bbox"])
    scores = F.transform(F.transform("lines", lambda x: T.normalize_space(x["text"])), lambda t: T.n_words(t) / 8.0)
    quoted = lambda t: F.btrim(F.to_json(F.array(t)), F.lit("[]"))
    legacy = F.concat(F.lit("["), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("["), F.to_json(x["bbox"]), F.lit(",["), quoted(x["text"]), F.lit(",0.25]]"))), ","), F.lit("]"))
    objects = F.to_json(F.struct(F.transform("lines", lambda x: F.struct(x["text"].alias("text"), F.lit(0.75).alias("score"), x["bbox"].alias("box"))).alias("lines")))
    n = F.col("page_number") % 4
    result = F.when(n == 0, F.to_json(F.struct(texts.alias("txts"), scores.alias("scores"), boxes.alias("boxes")))).when(n == 1, legacy).when(n == 2, objects).otherwise(F.to_json(F.struct(texts.alias("rec_texts"))))
    return readers.recognised(own.select("page_id", result.alias("result"))).select("page_id", "line_index", "text", "confidence", F.size("bbox").alias("n_points"))


@query
def recognised_by_name(spark, sf_dir):
    """Texts of documents as a recogniser's plain output, read by the table function of that name."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.col("text").alias("result"))
    return recognisers.recognise(own, " Lines").select("page_id", "line_index", F.length("text").alias("n_chars"), F.sha1("text").alias("digest"))


@query
def line_order(spark, sf_dir):
    """Lines made of words, in the recogniser's order."""
    own = layout.lines_from_words(v_words(spark, sf_dir), PAGE)
    return layout.grouped_order(own, PAGE).select(*PAGE, "block_num", "par_num", "line_num", "position")


@query
def image_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    names = [("links", "rechts", "a", "b"), ("img_1", "img_2", "img_3", "img_4"), ("left", "x", "seite_rechts", "right")]
    name = F.get(F.get(F.array(*[F.array(*map(F.lit, n)) for n in names]), (F.floor(k / 4) % 3).cast("int")), (k % 4).cast("int"))
    return readers.image_pair(table(spark, sf_dir, "customer").select(F.concat(F.lit("/case/"), F.floor(k / 4).cast("string"), F.lit("/"), name, F.lit(".png")).alias("path")))


@query
def ini_values(spark, sf_dir):
    """Each nation's file, with sections of its customers' segments."""
    k = F.col("n_nationkey")
    lines = F.array(F.concat(F.lit("[nation "), k.cast("string"), F.lit("]")), F.concat(F.lit(" Name = "), "n_name"), F.lit("; note"), F.concat(F.lit("Key="), k.cast("string"), F.lit("=x")), F.lit(""))
    own = table(spark, sf_dir, "nation").select(F.concat(F.lit("conf/"), "n_name").alias("file"), F.posexplode(lines).alias("position", "line"))
    return readers.key_values(own, file="file").drop("file")


@query
def pin_levels(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.when(k % 6 == 0, "no level").otherwise(F.concat((k % 40).cast("string"), F.lit(": ip pu | "), F.when(k % 2 == 0, "hi").otherwise("lo"), F.lit(" // GPIO")))
    return readers.pin_levels(table(spark, sf_dir, "orders").select(line.alias("line"))).groupBy("pin", "level").agg(F.count("*").alias("n"))


@query
def box_measures(spark, sf_dir):
    own = v_page_lines(spark, sf_dir).select(*PAGE, "lines", F.posexplode_outer("lines").alias("i", "l"))
    box, below = F.col("l.bbox"), F.get("lines", F.col("i") + 1)["bbox"]
    return own.select(*PAGE, "i", G.top(box).alias("top"), G.bottom(box).alias("bottom"), G.left(box).alias("left"), G.right(box).alias("right"), G.height(box).alias("height"), G.width(box).alias("width"), G.center_y(box).alias("center"), G.gap(box, below).alias("gap"))


@query
def mail_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    senders = F.when(k % 5 == 0, F.array(F.lit("a@x"), F.lit("b@x"))).otherwise(F.array(F.lit(" A@X ")))
    subject = F.when(k % 3 == 0, " SAVE this").when(k % 3 == 1, "save that").otherwise("load")
    files = F.when(k % 7 == 0, F.array(F.lit("../x"))).when(k % 7 == 1, F.array(F.lit("a"), F.lit("b"))).when(k % 7 == 2, F.array(F.lit(".."))).otherwise(F.array(F.lit("book.txt")))
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.mail_is_accepted(senders, F.lit("a@x"), subject, files).alias("accepted"))


@query
def mail_unprocessed(spark, sf_dir):
    """Messages not yet handled in their mailbox generation; numbers of an older generation don't count."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("uid_validity"), F.col("o_orderkey").alias("uid"))
    done = orders.where("uid % 4 < 2").withColumn("uid_validity", F.when(F.col("uid") % 8 == 0, F.col("uid_validity") + 1).otherwise(F.col("uid_validity")))
    return identity.unprocessed(orders, done)


@query
def language_profiles(spark, sf_dir):
    codes = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " DE ").when(F.col("o_orderkey") % 3 == 1, "En").alias("code"))
    return codes.select("o_orderkey", L.profile(F.col("code")).alias("p")).select("o_orderkey", "p.*")


# --- pages and text


@query
def page_kinds(spark, sf_dir):
    """Pages that are one heading or a block of a marker, and the open end of each."""
    own = _cleaned(spark, sf_dir).withColumn("t", structure.clean_text(F.col("lines")))
    tail = structure.tail_fragment(F.col("t"), F.col("chapter_markers"))
    return own.select("tag_id", "true_number", structure.is_heading_only(F.col("t"), F.col("chapter_markers")).alias("heading_only"), structure.is_marker_block(F.col("t"), F.col("chapter_markers")).alias("marker_block"), tail.alias("x")).select("tag_id", "true_number", "heading_only", "marker_block", "x.reason", "x.fragment")


@query
def marker_union(spark, sf_dir):
    """Markers of several detectors put together: equal ones count once, the last, by line."""
    k = F.col("conv_id")
    marker = lambda line, number, kind: F.struct(line.cast("int").alias("line_index"), number.cast("int").alias("chapter_number"), F.lit(None).cast("string").alias("chapter_heading"), F.lit(1).alias("consumed_line_count"), F.lit(kind).alias("detection_kind"))
    every = F.array(marker(k % 5, k % 3, "first"), marker(k % 4, k % 3, "second"), marker(k % 5, k % 2, "third")).cast(f"array<{structure.MARKER}>")
    own = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return own.select("conv_id", F.posexplode(structure.distinct_markers(every)).alias("position", "m")).select("conv_id", "position", "m.line_index", "m.chapter_number", "m.detection_kind")


@query
def line_remap(spark, sf_dir):
    """Line numbers of a report as places among the lines left, here without every third."""
    own = v_page_lines(spark, sf_dir, ["index"]).withColumn("kept", F.filter("lines", lambda x, i: i % 3 != 1))
    # The places are a column of their own, as Spark compiles no generator of an expression with lambdas.
    own = own.select(*PAGE, structure.remapped(F.transform("lines", lambda x: x["index"]), F.col("kept")).alias("places"))
    return own.select(*PAGE, F.posexplode_outer("places").alias("i", "place")).where("place is not null")


@query
def quoted_dialogue(spark, sf_dir):
    t, n = F.col("text"), F.col("page_number") % 4
    said = F.when(n == 0, F.concat(F.lit("„"), t, F.lit(".“"))).when(n == 1, F.concat(F.lit("»"), t, F.lit("!«"))).when(n == 2, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    return v_lines(spark, sf_dir).select(*PAGE, "line_index", T.is_quoted_dialogue(said).alias("dialogue"))


@query
def spoken_german(spark, sf_dir):
    t = F.concat(F.lit("Dr. "), F.col("text"), F.lit(" Notre-Dame, Dr."))
    return table(spark, sf_dir, "documents").select("doc_id", T.spoken_german(t).alias("text"))


@query
def blank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_blank_lines(F.regexp_replace("text", "\n", " \n \n\n  ")).alias("text"))


@query
def page_labels(spark, sf_dir):
    own = v_turns(spark, sf_dir)
    n = F.col("page_number")
    return own.select(
        "tag_id", "scan_id", "side", "created_at", T.page_label(F.col("side"), n, F.col("report_page_id")).alias("label"), T.page_id(n, F.when(F.col("side") == "left", F.col("report_page_id")), F.col("scan_id"), F.col("side")).alias("page_id"),
        T.truncated(F.col("clean_text")).alias("short"), metrics.recap_label(n, n + 2, F.col("scan_id")).alias("recap"), metrics.progress_label(n, n + 1).alias("progress"),
    )


@query
def time_formats(spark, sf_dir):
    v = F.col("value")
    pause = F.when(F.col("event_id") % 3 == 0, F.concat(F.floor(v).cast("string"), F.lit("ms"))).when(F.col("event_id") % 3 == 1, F.concat(F.floor(v).cast("string"), F.lit(".5 S"))).otherwise("soon")
    name = F.when(F.col("event_id") % 4 == 0, "notes.json").otherwise(F.concat(F.date_format("ts", "yyyy-MM-"), F.lpad((F.col("event_id") % 40).cast("string"), 2, "0"), F.lit(".json")))
    return table(spark, sf_dir, "events").select("event_id", metrics.scan_name(F.col("ts")).alias("scan_name"), S.break_seconds(pause).alias("seconds"), metrics.archived_day(name).alias("day"))


@query
def number_formats(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    samples = N.scaled_samples(F.array((k * 37 % 65536 - 32768).cast("int"), (k % 11 - 5).cast("int")), F.lit(1.5), F.lit(16))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(samples, ",").alias("samples"), N.length_scale((k % 40) / 10).alias("length_scale"), N.words_per_minute((k % 40) / 10).alias("wpm"), N.lead_wait(v, F.lit(3.0), F.lit(1.5)).alias("wait"), F.round(metrics.wav_seconds(k, k % 5 * 8000), 9).alias("wav"),
        F.round(metrics.stretched(k % 256, F.lit(40), F.lit(200)), 9).alias("grey"),
    )


@query
def grid_corners(spark, sf_dir):
    """Corners of a planar grid at the scale of each part's price."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.posexplode(metrics.grid(4, 3, 2.5)).alias("i", "p"))
    return own.select("p_partkey", "i", F.round(F.col("p")["x"] * F.col("p_retailprice"), 6).alias("x"), F.round(F.col("p")["y"] * F.col("p_retailprice"), 6).alias("y"))


@query
def paths_inside(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.when(k % 4 == 0, "/media/sounds/a.wav").when(k % 4 == 1, "/media/soundscape/a.wav").when(k % 4 == 2, "/media/sounds/../x").otherwise("/media/sounds")
    root = F.when(k % 3 == 0, "/media/sounds/").otherwise("/media/sounds")
    return table(spark, sf_dir, "customer").select("c_custkey", metrics.is_inside(path, root).alias("inside"))


@query
def device_order(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.col("s_suppkey").cast("string"))).alias("names"))
    return own.select("s_nationkey", F.array_join(metrics.preferred_first(F.col("names"), F.array(F.lit("77"), F.lit("20"), F.lit("3"))), ",").alias("names"))


# --- measures, summaries, folds


@query
def orientation_best(spark, sf_dir):
    own = v_lines(spark, sf_dir).where("line_index < 4").select(*PAGE, (F.col("line_index") * 90).alias("rotation_deg"), (F.length("text") % 6 / 10).alias("score"))
    return layout.best_candidate(own, PAGE).select(*PAGE, "rotation_deg", "score")


@query
def orientation_swap(spark, sf_dir):
    turns = v_turns(spark, sf_dir).groupBy("tag_id", "scan_id").agg(F.max(F.when(F.col("side") == "left", F.col("clean_text"))).alias("l"), F.max(F.when(F.col("side") == "right", F.col("clean_text"))).alias("r"))
    orientation = F.when(F.col("tag_id").cast("bigint") % 2 == 0, "reader1").otherwise("reader2")
    return turns.select("tag_id", "scan_id", layout.side_by_orientation(orientation, F.col("l"), F.col("r")).alias("s")).select("tag_id", "scan_id", F.col("s.left").alias("left_text"), F.col("s.right").alias("right_text"))


@query
def page_rotation(spark, sf_dir):
    k = F.col("c_custkey")
    stem = F.get(F.array(*[F.lit(x) for x in ("Links", "right", "scan", None, "seite_rechts")]), (k % 5).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", readers.rotation_of(stem, F.concat(F.lit("page_"), (k % 3).cast("string")), F.lit(90), F.lit(270)).alias("rotation"))


@query
def timings_total(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), F.round("value", 3)))).alias("m"))
    return own.select("user_id", F.round(metrics.total_seconds(F.col("m")), 6).alias("seconds"))


@query
def source_version(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "preferred").otherwise("fallback").alias("source"), (F.col("event_id") % 97 != 0).alias("exists"), F.col("event_id").alias("modified"))
    return metrics.latest_source(files, "user_id")


@query
def speech_counters(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "text", F.col("turn").cast("double").alias("queued_at"), (F.col("turn") + F.length("text") / 8.0).alias("ready_at"), "role")
    return metrics.batch_counters(said.where("role <> 'system'"), "conv_id")


@query
def fps_mean(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return own.select("user_id", F.round(N.ewma(F.col("v")), 6).alias("fps"))


@query
def latest_summarised(spark, sf_dir):
    chapters = _summaries(spark, sf_dir)
    stored = chapters.where("substring(chapter_id, -1) in ('2', '4')").select("tag_id", F.lit("chapter").alias("summary_type"), F.array("chapter_id").alias("source_chapter_ids"))
    other = chapters.select("tag_id", F.lit("book").alias("summary_type"), F.array("chapter_id").alias("source_chapter_ids"))
    return summaries.latest_summarised(chapters, stored.unionByName(other))


@query
def summary_pairs(spark, sf_dir):
    chapters = _summaries(spark, sf_dir)
    stored = chapters.where("substring(chapter_id, -1) in ('1', '3', '5')").withColumn("text", F.concat(F.lit("Kurz: "), F.substring("text", 1, 20)))
    return summaries.paired(chapters, stored)


@query
def prompts(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role <> 'system'")
    en, n = F.when(F.col("conv_id") % 2 == 0, "en").otherwise("de"), F.col("turn") + 1
    ask = lambda kind: summaries.prompt(kind, en, T.page_range(n, n + 1, en), T.format_pages(n / 2), T.target_words(n / 2), F.col("text"))
    return own.select("conv_id", "turn", *[ask(kind).alias(kind) for kind in ("chapter", "book", "progress", "shortening")])


@query
def generator_answers(spark, sf_dir):
    """Texts and states of a generator's answers: parts put together, cut off, refused, or not JSON at all."""
    own = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    parts = F.array(F.struct(F.concat(F.lit(" "), F.col("text")).alias("text")), F.struct(F.lit(" ").alias("text")), F.struct(F.col("role").alias("text")))
    reason = F.when(t % 4 == 0, "max_tokens").when(t % 4 == 1, "STOP").when(t % 4 == 2, "Safety").otherwise("STOP")
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"), reason.alias("finishReason"))).alias("candidates"), F.struct(F.when(t % 5 == 0, "OTHER").alias("blockReason")).alias("promptFeedback")))
    answer = F.when(t == 6, "{}").otherwise(answer)
    return own.select("conv_id", "turn", "role", summaries.response_text(answer).alias("r"), summaries.response_state(answer).alias("s")).select("conv_id", "turn", "role", "r.text", "r.complete", "s.truncated", "s.retry")


@query
def metadata_merge(spark, sf_dir):
    k = F.col("c_custkey")
    old = F.map_from_entries(F.filter(F.array(F.when(k % 2 == 0, F.struct(F.lit("a").alias("key"), F.lit("old").alias("value"))), F.struct(F.lit("b").alias("key"), k.cast("string").alias("value"))), lambda x: x.isNotNull()))
    merged = summaries.merged_metadata(old, F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("new"), F.lit("c"), F.lit("new")))
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.element_at(merged, x).alias(x) for x in "abc"])


@query
def debounced_buttons(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("button"), (F.col("event_id") * 0.001).alias("t"), (F.col("value") > 40).alias("pressed"))
    return folds.batch(rows, "button", folds.DEBOUNCE)


@query
def quadrature_steps(spark, sf_dir):
    n = F.floor(F.col("value")).cast("int") % 4
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("encoder"), F.col("event_id").cast("double").alias("t"), (n > 1).cast("int").alias("a"), ((n == 1) | (n == 2)).cast("int").alias("b"))
    return folds.batch(rows, "encoder", folds.QUADRATURE)
