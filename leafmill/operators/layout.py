"""Lines of a page into paragraphs, words into lines, and page-level scores.

Line rows: page keys, line_index, text, left, top, right, bottom, confidence, and, where the recogniser gives them, engine, block_num, par_num.
Windows are partitioned by page; a page is small whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import box

TEXT_KINDS = ("paragraph", "chapter_heading")


def page_number_line(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """``lines`` with ``is_number``: the first line, or else the last, if it is all digits, four at most."""
    w = Window.partitionBy(*page)
    order = w.orderBy("top", "left", "line_index")
    digits = T.trim(F.col("text")).rlike(r"(?U)^\d{1,4}$")
    # One order serves for both ends, so the lines of a page are sorted once.
    first, last = F.lag(F.lit(1)).over(order).isNull(), F.lead(F.lit(1)).over(order).isNull()
    marked = lines.withColumn("_digits", digits).withColumn("_first", first & F.col("_digits")).withColumn("_last", last & F.col("_digits")).drop("_digits")
    return marked.withColumn("is_number", F.col("_first") | (F.col("_last") & ~F.max("_first").over(w))).drop("_first", "_last")


def islands(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """``lines`` with ``paragraph``, counted from 1 in reading order. A paragraph begins where the gap above a line exceeds 1.4 mean heights,
    or 1.2 heights of the line above if that looks like a heading."""
    w = Window.partitionBy(*page)
    order = w.orderBy("top", "left", "line_index")
    high = F.greatest(F.col("bottom") - F.col("top"), F.lit(0))
    heading = T.is_layout_heading(F.col("text"), F.lit(1))
    own = lines.withColumn("_before", F.lag(F.struct(F.col("bottom").alias("bottom"), high.alias("high"), heading.alias("heading"))).over(order)).withColumn("_mean", F.avg(high).over(w))
    most = F.when(F.col("_before.heading"), F.greatest(F.lit(1), F.col("_before.high")) * 1.2).otherwise(F.col("_mean") * 1.4)
    begins = F.when(F.col("top") - F.col("_before.bottom") > most, 1).otherwise(0)
    return own.withColumn("_begins", begins).withColumn("paragraph", (1 + F.sum("_begins").over(order)).cast("int")).drop("_before", "_mean", "_begins")


def engine_groups(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """``lines`` with ``paragraph`` by runs of equal (block_num, par_num) in reading order."""
    order = Window.partitionBy(*page).orderBy("top", "left", "line_index")
    key = F.struct("block_num", "par_num")
    changed = F.when(F.lag(key).over(order).isNotNull() & ~F.lag(key).over(order).eqNullSafe(key), 1).otherwise(0)
    return lines.withColumn("_changed", changed).withColumn("paragraph", (1 + F.sum("_changed").over(order)).cast("int")).drop("_changed")


def paragraphs(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """A row per paragraph: page keys, paragraph, kind, text, bbox, line_indices; paragraphs without text are left out.

    The page-number line is no part of them. Pages whose lines all come from an engine that numbers blocks use its numbers.
    """
    text_lines = page_number_line(lines, page).where(~F.col("is_number"))
    if "engine" in lines.columns:
        numbered = text_lines.withColumn("_numbered", F.min(F.coalesce(F.col("engine") == "tesseract", F.lit(False))).over(Window.partitionBy(*page)))
        grouped = engine_groups(numbered.where("_numbered"), page).unionByName(islands(numbered.where("not _numbered"), page))
    else:
        grouped = islands(text_lines, page)
    item = F.struct("top", "left", "line_index", "text")
    out = grouped.groupBy(*page, "paragraph").agg(
        F.sort_array(F.collect_list(item)).alias("_lines"),
        box(F.min("left"), F.min("top"), F.max("right"), F.max("bottom")).alias("bbox"),
    )
    # The outer generator of one row keeps Spark from laying the filter below it, where the text would be made once more.
    text = T.paragraph_text(F.transform("_lines", lambda x: x["text"]))
    out = out.select("*", F.explode_outer(F.array(text)).alias("text")).where("text <> ''")
    kind = F.when(T.is_layout_heading(F.col("text"), F.size("_lines")), "chapter_heading").otherwise("paragraph")
    return out.select(*page, "paragraph", kind.alias("kind"), "text", "bbox", F.transform("_lines", lambda x: x["line_index"]).alias("line_indices"))


def lines_from_words(words: DataFrame, page: Sequence[str]) -> DataFrame:
    """Words of a recogniser as lines, by (page_num, block_num, par_num, line_num). Blank words and those of negative confidence don't count."""
    keys = [*page, "page_num", "block_num", "par_num", "line_num"]
    own = words.where((F.col("conf") >= 0) & (T.trim(F.col("text")) != ""))
    item = F.struct("word_num", "left", "text")
    return own.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: T.trim(x["text"])), " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        (F.avg("conf") / 100).alias("confidence"),
        F.count("*").alias("n_words"),
    )


def grouped_order(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """Lines made of words with ``position`` on their page: by page, block, paragraph and line of the recogniser, then by place."""
    order = Window.partitionBy(*page).orderBy("page_num", "block_num", "par_num", "line_num", "top", "left")
    return lines.withColumn("position", F.row_number().over(order) - 1)


def reading_order(pages: DataFrame, group: Sequence[str]) -> DataFrame:
    """``pages`` with ``position``: by number if there are several and all have one, else left before right, then by id."""
    w = Window.partitionBy(*group)
    numbered = pages.withColumn("_all", F.min(F.col("page_number").isNotNull()).over(w) & (F.count("*").over(w) > 1))
    side = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(99)
    order = w.orderBy(F.when(F.col("_all"), F.col("page_number")).otherwise(side), F.when(F.col("_all"), F.lit("")).otherwise(F.col("page_id")))
    return numbered.withColumn("position", F.row_number().over(order)).drop("_all")


def plausibility(text: Column, mean_confidence: Column, style: str = "detector") -> Column:
    """How much a page reads like text: confidence, share of words with two letters in a row, share of letters, and bonuses for punctuation
    and lower case. The two styles weigh these differently; a page without text has no plausibility at all."""
    valid = T.once(T.normalize_space(text), lambda t: F.regexp_count(t, F.lit("[A-Za-zÄÖÜäöüß]{2}[^ ]*")) / F.greatest(T.n_words(t), F.lit(1)))
    t = T.trim(text)
    letters = T.n_letters(t) / F.greatest(F.length(t), F.lit(1))
    marks, lower = F.when(t.rlike("[.?!,:;]"), 1.0).otherwise(0.0), F.when(t.rlike(r"\p{Ll}"), 1.0).otherwise(0.0)
    a, b, c, d, e = (0.60, 0.25, 0.05, 0.2, 0.1) if style == "detector" else (0.60, 0.24, 0.08, 0.08, 0.08)
    return F.when(t == "", float("-inf")).otherwise(mean_confidence * a + valid * b + letters * c + marks * d + lower * e)


def best_candidate(candidates: DataFrame, page: Sequence[str]) -> DataFrame:
    """Of each page's orientation candidates the one of greatest score; the smaller rotation wins ties."""
    return candidates.groupBy(*page).agg(F.max_by(F.struct("rotation_deg", "score"), F.struct("score", -F.col("rotation_deg"))).alias("best")).select(*page, "best.*")


def orientation_vote(crops: DataFrame, page: Sequence[str], least: float = 0.55, margin: float = 0.35) -> DataFrame:
    """A rotation per page from the crops' labels, weighted by confidence: null unless three crops, two of them sure, and the margin decide."""
    sure = (F.col("confidence") >= least) & F.col("label").isin(0, 180)
    out = crops.groupBy(*page).agg(
        F.count("*").alias("n"),
        F.count_if(sure).alias("accepted"),
        F.coalesce(F.sum(F.when(sure & (F.col("label") == 0), F.col("confidence"))), F.lit(0.0)).alias("upright"),
        F.coalesce(F.sum(F.when(sure & (F.col("label") == 180), F.col("confidence"))), F.lit(0.0)).alias("turned"),
    )
    apart = F.col("upright") - F.col("turned")
    decided = (F.col("n") >= 3) & (F.col("accepted") >= 2)
    return out.withColumn("rotation_deg", F.when(decided & (apart > margin), 0).when(decided & (apart < -margin), 180))


def orientation_carried(scans: DataFrame, book: str = "tag_id", order: str = "scan_id", default: str = "reader2") -> DataFrame:
    """``scans`` (vote may be null) with ``orientation``: the vote, else the book's last one before, else the default."""
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scans.withColumn("orientation", F.coalesce(F.last("vote", ignorenulls=True).over(w), F.lit(default)))


def side_by_orientation(orientation: Column, left: Column, right: Column) -> Column:
    """(left, right) of a spread; reader1 holds it turned around. Any other value than reader1 and reader2 is an error."""
    turned = F.when(orientation == "reader1", True).when(orientation == "reader2", False).otherwise(F.raise_error(F.lit("unknown orientation")).cast("boolean"))
    return F.struct(F.when(turned, right).otherwise(left).alias("left"), F.when(turned, left).otherwise(right).alias("right"))


def top_boxes(boxes: DataFrame, page: Sequence[str], most: int = 3) -> DataFrame:
    """Up to ``most`` text boxes of a page in order of confidence times width, none whose centre lies within max(12, height / 20) of a better one;
    returned by height on the page. Boxes narrower than 12 % of the image, or less than three times as wide as high, don't count.

    Which boxes stay depends on those taken before, so each page's list is folded; it holds one page's boxes.
    """
    wide = (F.col("width") >= 0.12 * F.col("image_width")) & (F.col("width") >= 3 * F.greatest(F.col("height"), F.lit(1.0)))
    item = F.struct((-F.col("confidence") * F.col("width")).alias("rank"), F.col("box_id").alias("box_id"), F.col("center_y").alias("y"), (F.greatest(F.lit(12.0), F.col("image_height") / 20)).alias("near"))
    listed = boxes.where(wide).groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("all"))
    kind = listed.schema["all"].dataType.simpleString()

    def take(acc: Column, x: Column) -> Column:
        free = (F.size(acc) < most) & ~F.exists(acc, lambda y: F.abs(y["y"] - x["y"]) < x["near"])
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    taken = listed.select(*page, F.aggregate("all", F.array().cast(kind), take).alias("taken"))
    by_y = F.sort_array(F.transform("taken", lambda x: F.struct(x["y"].alias("y"), x["box_id"].alias("box_id"))))
    return taken.select(*page, F.posexplode(by_y).alias("position", "b")).select(*page, "position", "b.box_id", F.col("b.y").alias("center_y"))
