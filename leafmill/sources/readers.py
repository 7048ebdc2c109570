"""Sources: stored documents, reports, and the line formats of devices and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

POINTS = "array<array<double>>"
# Names of page images, the preferred ones first.
LEFT_STEMS, RIGHT_STEMS = ("left", "page_left", "links", "seite_links"), ("right", "page_right", "rechts", "seite_rechts")
OCR_LINE = f"struct<text:string,confidence:double,bbox:{POINTS},metadata:map<string,string>>"
BLOCK = f"struct<kind:string,text:string,line_indices:array<int>,bbox:{POINTS}>"
REPORT = (
    "ocr_dir string, orientation_mode string, ocr_language string, "
    f"pages array<struct<page_id:string,slot:string,side:string,page_number:int,source_path:string,text_path:string,rotation_deg:int,orientation_reason:string,ocr_line_count:int,avg_confidence:double,paragraphs:array<string>,layout_blocks:array<{BLOCK}>,ocr_lines:array<{OCR_LINE}>,timings:map<string,double>>>, "
    "pipeline_timings map<string,double>"
)
MARKER = "struct<line_index:int,chapter_number:int,chapter_heading:string,consumed_line_count:int,detection_kind:string>"
PAGE = f"page_id string, scan_id string, created_at string, side string, clean_text string, speak_text string, page_number int, chapter_number int, chapter_heading string, chapter_markers array<{MARKER}>, tail_fragment string, source_report_path string, metadata map<string,string>"
BOOK = "tag_id string, created_at string, last_seen_at string, title string, author string, language string"
CHAPTER = "chapter_id string, created_at string, completed_at string, text_path string, page_ids array<string>, page_numbers array<int>, chapter_number int, chapter_heading string, start_page int, end_page int, metadata map<string,string>"
SUMMARY = "summary_id string, created_at string, updated_at string, summary_type string, text string, source_chapter_ids array<string>, metadata map<string,string>"


def documents(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON document per file, with its path. Unknown keys are dropped, missing ones are null; a malformed file is an error unless ``strict`` is off."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return read.withColumn("path", F.col("_metadata.file_path"))


def tag_of(path: Column) -> Column:
    """The book of a file stored under library/<tag>/<kind>/…"""
    return F.regexp_extract(path, r"([^/]+)/(?:state|scans|pages|chapters|summaries)/[^/]+(?:/[^/]+)?$", 1)


def pages(spark: SparkSession, library: str) -> DataFrame:
    """All stored pages of all books."""
    return documents(spark, f"{library.rstrip('/')}/*/pages/*.json", PAGE).withColumn("tag_id", tag_of(F.col("path")))


def stored_order(pages: DataFrame) -> DataFrame:
    """``pages`` with ``position`` in their book: numbered ones by number, then the others by id, and by scan where ids are shared."""
    order = Window.partitionBy("tag_id").orderBy(F.col("page_number").asc_nulls_last(), "page_id", "scan_id", "side")
    return pages.withColumn("position", F.row_number().over(order) - 1)


def chapters(spark: SparkSession, library: str) -> DataFrame:
    """All stored chapters of all books, with ``position`` by start page, those without one last, then by id."""
    own = documents(spark, f"{library.rstrip('/')}/*/chapters/*.json", CHAPTER).withColumn("tag_id", tag_of(F.col("path")))
    order = Window.partitionBy("tag_id").orderBy(F.col("start_page").asc_nulls_last(), "chapter_id")
    return own.withColumn("position", F.row_number().over(order) - 1)


def alias_lines(spark: SparkSession, library: str) -> DataFrame:
    """(tag_id, line) of the books' alias files."""
    return spark.read.text(f"{library.rstrip('/')}/*/state/*.txt").select(tag_of(F.col("_metadata.file_path")).alias("tag_id"), F.col("value").alias("line"))


def sided_pages(reports: DataFrame) -> DataFrame:
    """A row per page of each report with its ``side``, and whether that is ``known``: left or right."""
    each = reports.select(*[c for c in reports.columns if c != "pages"], F.posexplode("pages").alias("position", "page"))
    side = F.lower(F.trim(F.coalesce(F.nullif(F.col("page.slot"), F.lit("")), F.col("page.side"), F.lit(""))))
    return each.withColumn("side", side).withColumn("known", F.col("side").isin("left", "right"))


def report_pages(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, refused): a row per page of each report with its ``side``; pages whose side is neither left nor right are refused."""
    marked = sided_pages(reports)
    return marked.where("known").drop("known"), marked.where("not known").drop("known")


def lookup_key(key: Column) -> Column:
    """Page numbers, as numbers or digits, are stored under at least four digits; other keys as they are."""
    n = key.cast("string").try_cast("int")
    return F.when(key.cast("string").rlike(r"^\d+$") & n.isNotNull(), F.format_string("%04d", n)).otherwise(key.cast("string"))


# --- recognisers: several result shapes, one line shape



def recognised(rows: DataFrame, key: str = "page_id", value: str = "result") -> DataFrame:
    """(key, line_index, text, confidence, bbox) from JSON results of any known shape: objects with text, score and box, parallel arrays, or
    legacy entries [box, [text, score]]. Blank lines are dropped, a missing score is 0, a missing box is empty."""
    variant = F.parse_json(F.col(value))
    own = rows.select(key, variant.alias("v"))

    def first(*paths: str, kind: str) -> Column:
        return F.coalesce(*[F.try_variant_get("v", p, kind) for p in paths])

    # A path that isn't there costs much more than one that is, so fields are asked of objects and places of arrays alone. A lambda isn't compiled, and one
    # over the texts would read scores and boxes of a result anew for each, so what stands beside each other is zipped and entries are read as rows.
    # A result with texts has no entries, one without has no scores and boxes; what lies beyond the texts has none and is dropped.
    none = lambda kind: F.array().cast(f"array<{kind}>")
    own = own.withColumn("listed", F.try_variant_get("v", "$", "array<variant>"))
    own = own.withColumn("texts", F.when(F.col("listed").isNull(), first("$.txts", "$.rec_texts", "$.texts", kind="array<string>")))
    plain = F.col("texts").isNotNull()
    scores = F.when(plain, first("$.scores", "$.rec_scores", kind="array<double>"))
    boxes = F.when(plain, first("$.boxes", "$.dt_polys", "$.rec_polys", kind=f"array<{POINTS}>"))
    entries = F.when(F.col("listed").isNotNull(), F.col("listed")).when(~plain, F.try_variant_get("v", "$.lines", "array<variant>"))
    beside = {"text": (F.col("texts"), "string"), "confidence": (scores, "double"), "bbox": (boxes, POINTS), "entry": (entries, "variant")}
    zipped = own.select(key, *[F.coalesce(c, none(kind)).alias(name) for name, (c, kind) in beside.items()]).select(key, F.arrays_zip(*beside).alias("x"))
    each = zipped.select(key, F.posexplode_outer("x").alias("line_index", "x")).select(key, "line_index", "x.*")
    each = each.withColumn("is_array", F.try_variant_get("entry", "$", "array<variant>").isNotNull())

    def value_of(name: str, kind: str, fields: tuple, places: tuple) -> Column:
        get = lambda paths: F.coalesce(*[F.try_variant_get("entry", p, kind) for p in paths])
        return F.coalesce(F.col(name), F.when(F.col("is_array"), get(places)).otherwise(get(fields)))

    # The outer generator of one row keeps Spark from laying the filter below it, where the text would be read once more.
    text = F.trim(value_of("text", "string", ("$.text", "$.txt"), ("$[1][0]", "$[1]")))
    each = each.select("*", F.explode_outer(F.array(text)).alias("own")).where("own <> ''")
    confidence = value_of("confidence", "double", ("$.confidence", "$.score"), ("$[1][1]", "$[2]"))
    bbox = value_of("bbox", POINTS, ("$.bbox", "$.box"), ("$[0]",))
    return each.select(key, "line_index", F.col("own").alias("text"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.coalesce(bbox, F.array().cast(POINTS)).alias("bbox"))


# --- tools and devices


def terse_fields(line: Column) -> Column:
    """Fields parted by ":"; a backslash takes the next character literally."""
    marked = F.replace(F.replace(line, F.lit("\\\\"), F.lit("\x01")), F.lit("\\:"), F.lit("\x02"))
    plain = lambda x: F.replace(F.replace(F.regexp_replace(x, r"\\(.)", "$1"), F.lit("\x02"), F.lit(":")), F.lit("\x01"), F.lit("\\"))
    return F.transform(F.split(marked, ":"), plain)


def network_profiles(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, uuid, kind, device) of terse lines with four fields that are wireless profiles."""
    own = lines.select(terse_fields(F.col(line)).alias("f")).where((F.size("f") == 4) & F.get("f", F.lit(2)).isin("802-11-wireless", "wifi"))
    return own.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("name", "uuid", "kind"))], F.nullif(F.get("f", F.lit(3)), F.lit("")).alias("device"))


def pin_levels(lines: DataFrame, line: str = "line") -> DataFrame:
    """(pin, level) of lines such as ``17: ip pu | hi // GPIO17 = input``."""
    pattern = r"(?i)^\s*(\d+)\s*:.*?\b(hi|lo)\b"
    return lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).cast("int").alias("pin"), (F.lower(F.regexp_extract(line, pattern, 2)) == "hi").alias("level"))


def key_values(lines: DataFrame, line: str = "line", file: str | None = None) -> DataFrame:
    """(file, section, key, value) of ini texts with rows (file, position, line); comments and blank lines don't count. Without ``file`` all rows are one text."""
    own = lines.where(~F.col(line).rlike(r"^\s*(?:[#;].*)?$"))
    own = own.withColumn("_file", F.col(file) if file else F.lit(0))
    head = F.nullif(F.regexp_extract(line, r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    known = own.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("_file").orderBy("position")))
    names = [F.col("_file").alias(file)] if file else []
    return known.where(F.col(line).contains("=")).select(*names, "section", F.lower(F.trim(F.substring_index(line, "=", 1))).alias("key"), F.trim(F.substring(line, F.instr(line, "=") + 1, F.length(line))).alias("value"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(directory, slot, path) of a case's two page images: those named left and right, in either language, else the first two."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").option("recursiveFileLookup", True).load(path).select("path")
    return image_pair(found)


def image_pair(paths: DataFrame) -> DataFrame:
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    place = lambda names: F.array_position(F.array(*map(F.lit, names)), stem)
    slot = F.when(place(LEFT_STEMS) > 0, place(LEFT_STEMS)).when(place(RIGHT_STEMS) > 0, 100 + place(RIGHT_STEMS))
    own = paths.select("path", F.regexp_replace("path", r"/[^/]+$", "").alias("directory"), slot.alias("named"))
    w = Window.partitionBy("directory")
    left, right = F.min(F.when(F.col("named") < 100, F.struct("named", "path"))).over(w), F.min(F.when(F.col("named") > 100, F.struct("named", "path"))).over(w)
    ranked = own.withColumn("l", left["path"]).withColumn("r", right["path"]).withColumn("rank", F.row_number().over(w.orderBy("path")))
    named = F.col("l").isNotNull() & F.col("r").isNotNull()
    side = F.when(named & (F.col("path") == F.col("l")), "left").when(named & (F.col("path") == F.col("r")), "right").when(~named & (F.col("rank") == 1), "left").when(~named & (F.col("rank") == 2), "right")
    return ranked.select("directory", side.alias("slot"), "path").where("slot is not null")


def rotation_of(stem: Column, page_id: Column, left: Column, right: Column) -> Column:
    """A page's rotation: by its file's name, else by its id, else 0."""
    name = F.lower(F.coalesce(stem, F.lit("")))
    return F.when(name.isin(*LEFT_STEMS), left).when(name.isin(*RIGHT_STEMS), right).when(page_id == "page_1", left).when(page_id == "page_2", right).otherwise(0)


def speak_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), X.normalize_space), lambda x: x != "")
