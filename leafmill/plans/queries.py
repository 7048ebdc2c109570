"""Registered queries of the book domain; plans/oracle.py holds their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import speech as S
from ..functions import text as T
from ..functions.language import LABELS
from ..operators import identity, layout, metrics, sections, speech, stitch, structure, summaries, usage
from ..sources import readers
from .views import table, v_books, v_lines, v_page_lines, v_pages, v_turns, v_usage, v_words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAGE = ("tag_id", "page_number")
TODAY = "2024-01-25"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- usage


@query
def usage_daily(spark, sf_dir):
    return usage.daily(v_usage(spark, sf_dir))


@query
def usage_totals_rollup(spark, sf_dir):
    return usage.with_totals(usage_daily(spark, sf_dir))


@query
def usage_label_join(spark, sf_dir):
    return usage.labelled(usage_daily(spark, sf_dir), v_books(spark, sf_dir)).select("period_key", "tag_id", "label")


def _archive(spark):
    return spark.sql("SELECT DATE'2024-01-05' AS period_key")


@query
def usage_closed_periods(spark, sf_dir):
    return usage.closed_periods(usage_daily(spark, sf_dir), F.lit(TODAY).cast("date"), _archive(spark))


@query
def usage_gap_fill(spark, sf_dir):
    daily = usage_daily(spark, sf_dir)
    return usage.gap_filled(daily, usage.closed_periods(daily, F.lit(TODAY).cast("date"), _archive(spark)))


@query
def usage_report(spark, sf_dir):
    return usage.report(usage_daily(spark, sf_dir), v_books(spark, sf_dir))


@query
def usage_duration_fmt(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.duration(F.col("value") * 1000 - 500).alias("duration"))


# --- text


@query
def norm_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("text"))


@query
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query
def sentence_complete(spark, sf_dir):
    return v_lines(spark, sf_dir).select(*PAGE, "line_index", T.is_complete(F.col("text")).alias("complete"))


@query
def isolated_letters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.without_isolated_letters(F.col("text")).alias("text"))


@query
def consonant_fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.without_consonant_pairs(F.col("text")).alias("text"))


@query
def orphan_percent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.without_orphan_percent(T.normalize_space(F.col("text"))).alias("text"))


@query
def spaced_letters(spark, sf_dir):
    spread = F.regexp_replace("text", r"(\p{L})(?=\p{L})", "$1 ")
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_spaced_letters(spread).alias("text"))


@query
def upper_heading_title(spark, sf_dir):
    """Every line of all documents, every other one in capitals; engines differ on that of ß, so it is spelt out."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    line = F.when((F.col("doc_id") + F.col("position")) % 2 == 0, F.upper(F.replace("line", F.lit("ß"), F.lit("SS")))).otherwise(F.col("line"))
    return lines.select("doc_id", "position", T.normalize_upper_heading(T.normalize_space(line)).alias("text"))


@query
def heading_predicates(spark, sf_dir):
    t = F.col("text")
    return v_lines(spark, sf_dir).select(*PAGE, "line_index", T.is_heading_line(t).alias("heading_line"), T.is_heading_shape(t).alias("heading_shape"), T.is_layout_heading(t, F.lit(1)).alias("layout_heading"), T.is_speech_heading(t).alias("speech_heading"), T.is_title_cased(t).alias("title_cased"), T.is_upper_heading(t).alias("upper_heading"))


@query
def tag_normalize(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace("c_name", "#", "-")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.tag_id(F.concat(F.lit(" "), name, F.lit(" "))).alias("tag_id"), T.reader_uid(F.regexp_replace("c_name", "#", ":")).alias("uid"))


@query
def paragraph_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.paragraph_text(F.split("text", "\n")).alias("text"))


# --- structure


@query
def paragraph_islands(spark, sf_dir):
    lines = layout.islands(v_lines(spark, sf_dir), PAGE)
    return lines.groupBy(*PAGE, "paragraph").agg(F.count("*").alias("n_lines"), F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"))


@query
def layout_paragraphs(spark, sf_dir):
    return layout.paragraphs(v_lines(spark, sf_dir), PAGE).select(*PAGE, "paragraph", "kind", "text")


@query
def change_point_groups(spark, sf_dir):
    lines = v_lines(spark, sf_dir).withColumn("block_num", F.floor(F.col("line_index") / 3).cast("int") % 2).withColumn("par_num", F.lit(1))
    return layout.engine_groups(lines, PAGE).groupBy(*PAGE, "paragraph").agg(F.count("*").alias("n_lines"), F.min("line_index").alias("first_line"))


@query
def page_number_line(spark, sf_dir):
    return layout.page_number_line(v_lines(spark, sf_dir), PAGE).where("is_number").select(*PAGE, "line_index", "text")


@query
def page_number_pick(spark, sf_dir):
    picked = structure.page_number(F.col("lines"), F.lit(None).cast("int"))
    return v_page_lines(spark, sf_dir).select(*PAGE, picked.alias("p")).select(*PAGE, "p.position", F.col("p.number").alias("detected"))


@query
def footer_artifact(spark, sf_dir):
    return v_page_lines(spark, sf_dir).select(*PAGE, structure.footer_artifact(F.col("lines")).alias("position"))


def _cleaned(spark, sf_dir):
    """Pages with numbers found or inferred, and the lines left without number and footer."""
    pages = v_page_lines(spark, sf_dir).withColumnRenamed("page_number", "true_number")
    found = pages.withColumn("n", structure.page_number(F.col("lines"), F.lit(None).cast("int"))).withColumn("page_number", F.when(F.col("n.number") > 0, F.col("n.number")))
    numbered = stitch.spread_numbers(found)
    foot = F.when(F.col("inferred"), structure.footer_artifact(F.col("lines")))
    return numbered.withColumn("lines", structure.without(F.col("lines"), F.col("n.position"), foot)).withColumn("chapter_markers", structure.chapter_markers(F.col("lines")))


@query
def chapter_markers(spark, sf_dir):
    each = _cleaned(spark, sf_dir).select("tag_id", "true_number", F.explode_outer("chapter_markers").alias("m")).where("m is not null")
    return each.select("tag_id", "true_number", "m.*")


@query
def spread_number_infer(spark, sf_dir):
    pages = v_turns(spark, sf_dir)
    return stitch.spread_numbers(pages).select("tag_id", "scan_id", "side", "page_number", "inferred")


@query
def roman_parse(spark, sf_dir):
    """Words of all documents that read as a number, Roman or not."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("position", "word"))
    return words.select("doc_id", "position", "word", N.chapter_number(F.col("word")).alias("number")).where("number is not null")


@query
def cardinals(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("n"), N.cardinal(n, F.lit("de")).alias("german"), N.cardinal(n, F.lit("en")).alias("english"))


@query
def plausibility_score(spark, sf_dir):
    pages = v_lines(spark, sf_dir).groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), " ").alias("text"), F.avg("confidence").alias("c"))
    return pages.select(*PAGE, F.round(layout.plausibility(F.col("text"), F.col("c")), 6).alias("detector"), F.round(layout.plausibility(F.col("text"), F.col("c"), "capture"), 6).alias("capture"))


@query
def word_to_line(spark, sf_dir):
    return layout.lines_from_words(v_words(spark, sf_dir), PAGE).select(*PAGE, "block_num", "line_num", "text", "left", "top", "right", "bottom", F.round("confidence", 9).alias("confidence"), "n_words")


@query
def reading_order(spark, sf_dir):
    pages = v_turns(spark, sf_dir).withColumn("page_id", F.concat_ws("_", "scan_id", "side"))
    return layout.reading_order(pages, ["tag_id"]).select("tag_id", "page_id", "position")


# --- stitching


def _spoken(spark, sf_dir):
    """Turns as finished pages, with tails taken off the spoken text."""
    pages = v_turns(spark, sf_dir).withColumn("chapter_markers", F.array().cast(f"array<{structure.MARKER}>"))
    tail = structure.tail_fragment(F.col("clean_text"), F.col("chapter_markers"))
    pages = pages.withColumn("t", tail).withColumn("tail_fragment", F.col("t.fragment"))
    return pages.withColumn("speak_text", T.without_suffix(T.trim(F.col("clean_text")), F.col("tail_fragment"))).drop("t")


@query
def tail_fragment(spark, sf_dir):
    none = F.array().cast(f"array<{structure.MARKER}>")
    return v_pages(spark, sf_dir).select(*PAGE, structure.tail_fragment(F.col("text"), none).alias("t")).select(*PAGE, "t.reason", "t.fragment")


@query
def tail_carry_spread(spark, sf_dir):
    return stitch.carry_in_spread(_spoken(spark, sf_dir)).select("tag_id", "scan_id", "fragment", "left_speak", "right_speak")


@query
def tail_carry_next(spark, sf_dir):
    return stitch.carry_to_next(_spoken(spark, sf_dir)).select("tag_id", "scan_id", "side", "page_number", "carried", "speak_text")


@query
def pending_tail_locf(spark, sf_dir):
    return stitch.pending_tail(_spoken(spark, sf_dir)).select("tag_id", "scan_id", "side", "pending")


@query
def hyphen_bridge(spark, sf_dir):
    w = Window.partitionBy("tag_id", "page_number").orderBy("line_index")
    pairs = v_lines(spark, sf_dir).withColumn("right", F.lead("text").over(w)).where(F.col("right").isNotNull())
    return pairs.select(*PAGE, "line_index", T.bridge(F.col("text"), F.col("right")).alias("b")).select(*PAGE, "line_index", "b.left", "b.right")


@query
def placeholder_antijoin(spark, sf_dir):
    pages = v_turns(spark, sf_dir)
    later = pages.where("page_number is null and cast(tag_id as bigint) % 2 = 0").withColumn("page_number", F.lit(900) + F.length("scan_id"))
    return stitch.without_placeholders(pages.unionByName(later)).select("tag_id", "scan_id", "side", "report_page_id", "page_number")


@query
def latest_page_version(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("page_key"), "event_id", "value")
    return stitch.latest(e, ["user_id", "page_key"], ["event_id"])


@query
def page_speech(spark, sf_dir):
    pages = _cleaned(spark, sf_dir)
    spoken = structure.speak_text(F.col("lines"), F.col("chapter_markers"), F.array().cast("array<int>"), F.col("language"), LABELS)
    return pages.select("tag_id", "true_number", structure.clean_text(F.col("lines")).alias("clean_text"), spoken.alias("speak_text"))


# --- sections


def _book_pages(spark, sf_dir):
    """Pages of books in assembly order, with a chapter line on some."""
    p = F.col("page_number")
    label = F.when(F.col("language") == "de", "Kapitel ").otherwise("Chapter ")
    marked = (p % 50).isin(13, 20, 45)
    clean = F.concat(F.when(marked, F.concat(label, F.floor(p / 10).cast("string"), F.lit("\n"))).otherwise(""), F.trim("text"))
    marker = F.struct(F.lit(0).alias("line_index"), F.floor(p / 10).cast("int").alias("chapter_number"), F.lit(None).cast("string").alias("chapter_heading"), F.lit(1).alias("consumed_line_count"), F.lit("explicit_label").alias("detection_kind"))
    pages = v_pages(spark, sf_dir).withColumn("clean_text", clean).withColumn("chapter_markers", F.when(marked, F.array(marker)).otherwise(F.array().cast(f"array<{structure.MARKER}>")))
    return pages.withColumn("created_at", F.lit("2026-01-01")).withColumn("page_id", F.format_string("page_%04d", "page_number")).withColumn("report_page_id", F.lit(None).cast("string"))


def _flat(rows):
    """Lists as text, which any engine compares alike."""
    return rows.withColumn("page_ids", F.array_join("page_ids", ",")).withColumn("page_numbers", F.array_join(F.transform("page_numbers", lambda n: n.cast("string")), ","))


@query
def assembly_order(spark, sf_dir):
    pages = v_turns(spark, sf_dir).withColumn("page_id", F.concat_ws("_", "scan_id", "side"))
    return sections.assembly_order(pages).select("tag_id", "page_id", "position")


@query
def marker_offsets(spark, sf_dir):
    lines = F.split("text", "\n")
    at = F.explode(F.sequence(F.lit(0), F.size(lines) - 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", at.alias("line_index"))
    return docs.select("doc_id", "line_index", structure.marker_offset(F.col("text"), F.col("line_index")).alias("offset"))


@query
def fallback_offsets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sections.fallback_offset(F.regexp_replace("text", r"\n", "\n\n")).alias("offset"))


@query
def section_bounds(spark, sf_dir):
    return sections.boundaries(sections.assembly_order(_book_pages(spark, sf_dir)))


@query
def section_text(spark, sf_dir):
    pages = sections.assembly_order(_book_pages(spark, sf_dir))
    return _flat(sections.section_text(pages, sections.boundaries(pages)))


@query
def pending_content(spark, sf_dir):
    pages = sections.assembly_order(_book_pages(spark, sf_dir))
    return _flat(sections.section_text(pages, sections.pending(pages, sections.boundaries(pages)))).select("tag_id", "text", "page_ids", "page_numbers")


@query
def boundary_resolve(spark, sf_dir):
    pages = sections.assembly_order(_book_pages(spark, sf_dir))
    wanted = pages.select("tag_id", F.when(F.col("page_number") % 2 == 0, F.col("page_number")).alias("page_number"), "page_id", "scan_id", "side", F.lit(0).alias("offset"))
    return sections.resolve(wanted, pages).select("tag_id", "page_id", "resolved_position")


@query
def chapter_sequence(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tag_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("chapter_"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("draft"), F.lit("_x"))).alias("chapter_id"))
    return sections.next_sequence(orders)


# --- summaries and speech


def _summaries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").cast("string").alias("tag_id"), F.format_string("chapter_%04d", F.col("turn") + 1).alias("chapter_id"), F.lit("2026-01-01").alias("created_at"), F.lit("2026-02-03T04:05:06Z").alias("updated_at"), "text")


@query
def summary_fingerprint(spark, sf_dir):
    return summaries.fingerprint(_summaries(spark, sf_dir)).select("tag_id", F.size("source_chapter_ids").cast("bigint").alias("n"), "fingerprint")


@query
def summary_cache_valid(spark, sf_dir):
    t, n = F.col("turn"), F.col("conv_id")
    meta = F.map_from_entries(F.filter(F.array(
        F.when(n % 3 > 0, F.struct(F.lit("language").alias("key"), F.when(n % 2 == 0, "de").otherwise("en").alias("value"))),
        F.struct(F.lit("target_pages").alias("key"), F.when(t % 5 == 0, "x").otherwise("1.5").alias("value")),
        F.struct(F.lit("generation_complete").alias("key"), F.when(t % 4 == 0, "false").otherwise("true").alias("value")),
        F.struct(F.lit("length_policy_version").alias("key"), F.lit(str(summaries.LENGTH_POLICY_VERSION)).alias("value")),
        F.struct(F.lit("target_words").alias("key"), F.lit("375").alias("value")),
    ), lambda x: x.isNotNull()))
    rows = table(spark, sf_dir, "conversations").withColumn("m", meta)
    return rows.select("conv_id", "turn", summaries.is_valid(F.col("m"), F.lit("de"), F.lit(1.5), T.target_words(F.lit(1.5))).alias("valid"))


@query
def latest_chapter(spark, sf_dir):
    return summaries.latest_chapter(_summaries(spark, sf_dir).withColumn("chapter_id", F.when(F.col("chapter_id") == "chapter_0003", "loose").otherwise(F.col("chapter_id"))))


@query
def summary_stub(spark, sf_dir):
    return summaries.summarised(_summaries(spark, sf_dir).withColumn("target_words", F.lit(25)))


@query
def page_range_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 30)
    end = F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 30)
    return o.select("o_orderkey", T.page_range(start, end, F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("de")).alias("label"), T.format_pages(F.col("o_orderkey") % 50 / 10).alias("pages"), T.target_words(F.col("o_orderkey") % 50 / 10).alias("words"))


@query
def ssml_basic(spark, sf_dir):
    return _book_pages(spark, sf_dir).select(*PAGE, S.ssml(F.regexp_replace("clean_text", "^(Kapitel \\d+)\n", "$1.\n\n")).alias("ssml"))


@query
def ssml_enhanced(spark, sf_dir):
    return _book_pages(spark, sf_dir).select(*PAGE, S.enhanced_ssml(F.col("clean_text")).alias("ssml"))


@query
def ssml_to_text(spark, sf_dir):
    return ssml_enhanced(spark, sf_dir).select(*PAGE, S.plain_speech(F.col("ssml")).alias("text"))


@query
def speech_pack_bytes(spark, sf_dir):
    chunks = speech.packed_speech(F.col("text"), "google-gemini-flash", speech.SUMMARY_BYTES)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(chunks).alias("position", "chunk"))


@query
def pack_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(speech.packed_chars(F.split("text", "\n"), 1000)).alias("position", "batch"))


@query
def reading_stream(spark, sf_dir):
    paragraphs = v_pages(spark, sf_dir).select("tag_id", F.col("page_number").alias("page_position"), F.format_string("page_%04d", "page_number").alias("page_id"), F.lit(1).alias("paragraph"), "text")
    return speech.reading_stream(paragraphs).select("tag_id", "position", "text", "complete", F.array_join("source_pages", ",").alias("source_pages"))


# --- identity and devices


def _tags(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("scan"), F.when(k % 7 == 0, "iso14443a").otherwise("iso15693").alias("technology"), F.concat(F.lit("U"), (k % 97).cast("string")).alias("uid")).distinct()


@query
def alias_resolution(spark, sf_dir):
    alias = spark.range(0, 97, 5).select(F.concat(F.lit("BOOK"), F.col("id").cast("string")).alias("tag_id"), F.concat(F.lit("U"), F.col("id").cast("string")).alias("alias"))
    books = spark.range(0, 97, 3).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("tag_id"))
    return identity.resolve(_tags(spark, sf_dir), alias, books)


@query
def language_consistency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("tag_id"), F.nullif(F.col("lang"), F.lit("de")).alias("language"))
    books = docs.select("tag_id").distinct().withColumn("language", F.when(F.col("tag_id").endswith("1"), "en"))
    return identity.inconsistent_books(docs, books)


@query
def book_upsert(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("tag_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("seen_at"), F.when(F.col("user_id") % 2 == 0, "de").otherwise("en").alias("language"))
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tag_id"), F.lit("2023-05-06T00:00:00").alias("created_at"), F.lit("2023-06-07T00:00:00").alias("last_seen_at"), F.when(F.col("c_custkey") % 3 == 0, "de").when(F.col("c_custkey") % 3 == 1, "en").alias("language"))
    return identity.upsert_books(stored, seen)[0]


@query
def nfc_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.concat(F.lit("READER id="), (k % 3).cast("string"), F.lit(" tag14443a="), (k % 2).cast("string"), F.lit(" uid14443a=aa:"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" tag15693=1 uid15693=e0-"), F.lpad((k % 50).cast("string"), 2, "0"))
    lines = table(spark, sf_dir, "orders").select(k.alias("line_id"), F.when(k % 10 == 0, "IDLE").otherwise(line).alias("line"))
    return identity.reader_tags(lines)


@query
def nmcli_parse(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.concat_ws(":", F.concat(F.lit("net\\:"), F.col("c_custkey").cast("string")), F.concat(F.lit("uuid-"), k.cast("string")), F.when(k % 2 == 0, "802-11-wireless").otherwise("ethernet"), F.lit("wlan0"))
    return readers.network_profiles(table(spark, sf_dir, "customer").select(line.alias("line")))


@query
def box_top3(spark, sf_dir):
    boxes = v_lines(spark, sf_dir).select(*PAGE, F.col("line_index").alias("box_id"), "confidence", (F.col("right") - F.col("left")).cast("double").alias("width"), F.lit(30.0).alias("height"), (F.col("top") + 15).cast("double").alias("center_y"), F.lit(1000.0).alias("image_width"), F.lit(1500.0).alias("image_height"))
    return layout.top_boxes(boxes, PAGE)


@query
def orientation_vote(spark, sf_dir):
    crops = v_lines(spark, sf_dir).where("line_index < 3").select(*PAGE, F.when(F.length("text") % 4 == 0, 180).otherwise(0).alias("label"), (0.4 + (F.length("text") % 7) / 10).alias("confidence"))
    return layout.orientation_vote(crops, PAGE).select(*PAGE, "n", "accepted", "rotation_deg")


@query
def orientation_locf(spark, sf_dir):
    scans = v_pages(spark, sf_dir).where("side = 'left'").select("tag_id", "scan_id", F.when(F.length("text") % 5 == 0, "reader1").when(F.length("text") % 5 == 1, "reader2").alias("vote"))
    return layout.orientation_carried(scans).select("tag_id", "scan_id", "orientation")


@query
def volume_levels(spark, sf_dir):
    """A ladder of levels for each part: as many as its size and one more, over a span that its price gives, and the level nearest to a wanted one."""
    size, span = F.col("p_size").cast("int"), F.floor(F.col("p_retailprice") / 10).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", size.alias("low"), (size + span).alias("high"), (size + 1).alias("n"), (size + F.floor(span / 3).cast("int")).alias("wanted"))
    rows = rows.withColumn("levels", N.volume_ladder(F.col("low"), F.col("high"), F.col("n")))
    return rows.select("p_partkey", "n", F.array_join("levels", ",").alias("levels"), N.nearest_level(F.col("levels"), F.col("wanted")).alias("nearest"))


# --- measures


@query
def contrast_bounds(spark, sf_dir):
    return metrics.contrast_bounds(table(spark, sf_dir, "documents"), "lang", "n_chars").select("lang", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def stale_gaps(spark, sf_dir):
    return metrics.stale_gaps(table(spark, sf_dir, "events"), "user_id", 86400)


@query
def new_page_keys(spark, sf_dir):
    events = v_usage(spark, sf_dir).where("kind = 'scan'").withColumn("day", N.reporting_day(F.col("ts")))
    return metrics.new_keys(events, "tag_id", "day", "page_key")


@query
def neighbour_distance(spark, sf_dir):
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select((k % 50).alias("board"), (k % 7).alias("row"), (k % 11).alias("col"), (k % 7 * 10 + k % 50 % 3).cast("double").alias("x"), (k % 11 * 12).cast("double").alias("y")).distinct()
    return metrics.neighbour_distance(points, "board").select("board", F.round("distance", 6).alias("distance"))


@query
def empty_scans(spark, sf_dir):
    pages = v_pages(spark, sf_dir).withColumn("speak_text", F.when(F.col("page_number") % 40 < 6, F.lit(" \n")).otherwise(F.col("text")))
    return metrics.empty_scans(pages)
