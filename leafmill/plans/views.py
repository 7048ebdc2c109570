"""Inputs of the book domain, derived from the flat tables; plans/oracle.py derives the same ones in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box

PAGE_CHARS, LINE_CHARS = 600, 60
#: Decoders take it off the front of a text in UTF-32, and only there.
BOM = bytearray(b"\x00\x00\xfe\xff")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 64 documents in a row those of one language as a book, so books grow in number and not in size; cut into pages, odd ones left, two make a scan."""
    book = F.concat(F.upper("lang"), F.lit("-"), F.floor(F.col("doc_id") / 64).cast("string"))
    # Pages are cut out of texts whose characters have four bytes each: a substring of text walks all characters before it.
    wide, n = F.encode("text", "UTF-32"), F.length("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", wide.alias("wide"), n.alias("n"), "lang", book.alias("tag_id"))
    last = F.greatest(F.ceil(F.col("n") / PAGE_CHARS).cast("int") - 1, F.lit(0))
    cut = docs.withColumn("slice", F.explode(F.sequence(F.lit(0), last)))
    page = F.substring(F.col("wide"), F.col("slice") * (4 * PAGE_CHARS) + 1, F.lit(4 * PAGE_CHARS))
    cut = cut.withColumn("text", F.decode(F.concat(F.lit(BOM), page), "UTF-32")).drop("wide")
    number = F.row_number().over(Window.partitionBy("tag_id").orderBy("doc_id", "slice"))
    pages = cut.withColumn("page_number", number)
    return pages.select(
        "tag_id",
        F.format_string("scan_%06d", F.floor((F.col("page_number") + 1) / 2)).alias("scan_id"),
        F.when(F.col("page_number") % 2 == 1, "left").otherwise("right").alias("side"),
        "page_number",
        F.when(F.col("lang") == "de", "de").otherwise("en").alias("language"),
        "text",
    )


LINE_KEYS = ("tag_id", "scan_id", "side", "page_number", "language")


def _lined(pages: DataFrame) -> DataFrame:
    """Pages as arrays of lines: hyphens where a line cuts a word, chapter lines on some pages, a number or a misread one at the foot.

    ``ends`` has a bit for each of the ``n`` lines, the first one's highest: whether it ends a sentence. A page has about a dozen lines, so a long holds them.
    Every page has a line at its foot, so no array is empty. Lay no filter on the arrays, nor an inner generator, from which Spark infers one: pushed below
    the steps here, it would cut a page's text into lines anew for every line.
    """
    # Single blanks, of which a page has a hundred, are left as they are.
    text = F.trim(F.regexp_replace("text", r"\s+(?<!(?<!\s) )", " "))
    # Breaks are set within the page's text, which holds none by now; pieces lose the blanks at their ends, and none is empty.
    broken = F.regexp_replace(text, rf"(?s).{{{LINE_CHARS}}}(?!\z)", "$0\n")
    # Letters around a break are looked for only where there is one.
    body = F.regexp_replace(broken, r"\n(?<=\p{L}\n)(?=\p{L})", "-\n")
    body = F.replace(F.replace(body, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))

    p = F.col("page_number")
    label = F.when(F.col("language") == "de", "Kapitel ").otherwise("Chapter ")
    chapter = F.floor(p / 10).cast("string")
    head = F.when((p % 50).isin(13, 45), F.concat(label, chapter)).when(p % 50 == 20, chapter)
    foot = F.when(p % 7 == 3, F.lit("I2")).otherwise(p.cast("string"))
    texts = F.split(F.concat_ws("\n", head, F.nullif(body, F.lit("")), foot), "\n")
    own = pages.select(*LINE_KEYS, texts.alias("texts"))
    ends = F.aggregate("texts", F.lit(0).cast("bigint"), lambda bits, t: bits * 2 + t.endswith(".").cast("bigint"))
    return own.select(*LINE_KEYS, "texts", F.size("texts").alias("n"), ends.alias("ends"))


def _top(i: Column) -> Column:
    """A line's top depends on its place and on how many lines before it end a sentence."""
    return (40 * (i + 1) + 80 * F.bit_count(F.call_function("shiftright", F.col("ends"), F.col("n") - i))).cast("int")


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line."""
    each = _lined(v_pages(spark, sf_dir)).select(*LINE_KEYS, "n", "ends", F.posexplode_outer("texts").alias("line_index", "text"))
    top, n = _top(F.col("line_index")), F.length("text")
    return each.select(*LINE_KEYS, "line_index", "text", F.lit(10).alias("left"), top.alias("top"), (10 + 10 * n).alias("right"), (top + 30).alias("bottom"), (0.5 + (n % 50) / 100).alias("confidence"))


def v_page_lines(spark: SparkSession, sf_dir: str, fields: Sequence[str] = ("text", "bbox", "index")) -> DataFrame:
    """A row per page with its lines as an array, as reports hold them. Boxes take most of the time, so name the fields that you need."""
    return page_lines(v_pages(spark, sf_dir), fields)


def page_lines(pages: DataFrame, fields: Sequence[str] = ("text", "bbox", "index")) -> DataFrame:
    """Pages of v_pages() as rows of v_page_lines()."""

    def edges(i):
        # Asked for twice, so that Spark leaves ``ends`` a column: put into the lambda, it would be found anew for every line.
        return [_top(i).cast("double").alias("top"), (_top(i) + 30).cast("double").alias("bottom")] if "bbox" in fields else []

    placed = F.transform("texts", lambda t, i: F.struct(t.alias("text"), i.cast("int").alias("index"), *edges(i)))

    def item(x):
        own = {"text": x["text"], "index": x["index"]}
        if "bbox" in fields:
            own["bbox"] = box(F.lit(10.0), x["top"], (10 + 10 * F.length(x["text"])).cast("double"), x["bottom"])
        return F.struct(*[own[f].alias(f) for f in fields])

    return _lined(pages).select(*LINE_KEYS, F.transform(placed, item).alias("lines"))


def v_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as words with boxes and confidences from 0 to 100; some are below zero."""
    lines = v_lines(spark, sf_dir)
    each = lines.select("tag_id", "page_number", "line_index", "top", F.posexplode(F.split("text", " ")).alias("w", "text"))
    return each.select(
        "tag_id", "page_number", F.lit(1).alias("page_num"), F.floor(F.col("line_index") / 4).cast("int").alias("block_num"), F.lit(1).alias("par_num"), F.col("line_index").alias("line_num"),
        F.col("w").alias("word_num"), (10 + 70 * F.col("w")).alias("left"), "top", (10 * F.length("text")).alias("width"), F.lit(30).alias("height"),
        F.when(F.length("text") % 9 == 8, -1.0).otherwise((F.length("text") * 7 % 100).cast("double")).alias("conf"), "text",
    )


def v_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in {"view": "scan", "click": "audio", "signup": "chapter_summary", "purchase": "book_summary"}.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("tag_id"), "ts", F.try_element_at(kind, F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").alias("page_key"), F.col("value").alias("seconds")
    )


def v_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of every other book."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tag_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))


def v_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: a turn is a page, the user's left and the assistant's right; every third page has no number, every fourth no full stop."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    t = F.col("turn")
    cut = F.when(t % 4 == 1, F.substring(F.col("text"), F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    return turns.select(
        F.col("conv_id").cast("string").alias("tag_id"), F.format_string("scan_%04d", F.floor(t / 2)).alias("scan_id"), F.when(F.col("role") == "user", "left").otherwise("right").alias("side"),
        F.when(t % 3 != 2, t + 1).cast("int").alias("page_number"), F.concat(F.lit("page_"), F.col("turn") % 2 + 1).alias("report_page_id"), F.format_string("2026-01-01T00:%02d:00Z", F.col("turn")).alias("created_at"), cut.alias("clean_text"),
    )
