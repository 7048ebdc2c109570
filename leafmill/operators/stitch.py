"""Text that runs on over a page end: numbers of a spread, tails carried within a spread, to the next page, and over unnumbered pages.

Page rows: tag_id, scan_id, side, page_number (null if unknown), report_page_id, created_at, clean_text, speak_text, tail_fragment, chapter_markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import is_heading_only, is_marker_block

SPREAD = ("tag_id", "scan_id")


def spread_numbers(pages: DataFrame) -> DataFrame:
    """``pages`` with the number of the one unnumbered page of a two-page spread inferred from the other; ``inferred`` says so. Numbers below 1 aren't given."""
    w = Window.partitionBy(*SPREAD)
    n, known = F.count("*").over(w), F.count("page_number").over(w)
    other = F.max("page_number").over(w)
    other_side = F.max(F.when(F.col("page_number").isNotNull(), F.col("side"))).over(w)
    guess = F.when((F.col("side") == "left") & (other_side == "right"), other - 1).when((F.col("side") == "right") & (other_side == "left"), other + 1)
    guess = F.when((n == 2) & (known == 1) & F.col("page_number").isNull() & (guess >= 1), guess)
    return pages.withColumn("_guess", guess.cast("int")).withColumn("inferred", F.col("_guess").isNotNull()).withColumn("page_number", F.coalesce("page_number", "_guess")).drop("_guess")


def normalized_tail(speak: Column, tail: Column) -> Column:
    """(tail_fragment, speak_text): the tail that the spoken text really ends with, and the text without it."""
    said = T.trim(speak)
    own = F.nullif(T.trim(tail), F.lit(""))
    effective = F.when(own.isNotNull() & said.endswith(own), own).otherwise(F.coalesce(T.trailing_fragment(said), own))
    return F.struct(F.coalesce(effective, tail).alias("tail_fragment"), F.when(effective.isNotNull(), T.without_suffix(speak, effective)).otherwise(speak).alias("speak_text"))


def readout(pages: DataFrame) -> DataFrame:
    """Right pages with a tail, and left pages that are alone in their scan, with tail and spoken text made consistent."""
    alone = (F.count("*").over(Window.partitionBy(*SPREAD)) == 1) & (F.col("side") == "left")
    applies = alone | ((F.col("side") == "right") & (F.coalesce(F.col("tail_fragment"), F.lit("")) != ""))
    own = pages.withColumn("_applies", applies).withColumn("_n", normalized_tail(F.col("speak_text"), F.col("tail_fragment")))
    for c in ("tail_fragment", "speak_text"):
        own = own.withColumn(c, F.when(F.col("_applies"), F.col("_n")[c]).otherwise(F.col(c)))
    return own.drop("_applies", "_n")


def carry_to_next(pages: DataFrame) -> DataFrame:
    """``pages`` whose spoken text begins with the tail of the stored page before, if that is a right page with a tail. Page 1 has none before it.

    A scan has one target: its lowest numbered left page, else its lowest numbered page. The previous page is found by lag along
    the numbers, which shares the partitioning by book with the other steps."""
    target = F.row_number().over(Window.partitionBy(*SPREAD).orderBy(F.col("page_number").isNull(), F.col("side") != "left", "page_number"))
    by_number = Window.partitionBy("tag_id").orderBy(F.col("page_number").asc_nulls_last(), "scan_id", "side")
    before = F.lag(F.struct("page_number", "side", "tail_fragment")).over(by_number)
    own = pages.withColumn("_target", target == 1).withColumn("_before", before)
    fits = F.col("_target") & (F.col("page_number") > 1) & (F.col("_before.page_number") == F.col("page_number") - 1) & (F.col("_before.side") == "right") & (F.coalesce(F.col("_before.tail_fragment"), F.lit("")) != "")
    return own.withColumn("carried", F.coalesce(fits, F.lit(False))).withColumn("speak_text", F.when(F.col("carried"), T.with_prefix(F.col("_before.tail_fragment"), F.col("speak_text"))).otherwise(F.col("speak_text"))).drop("_target", "_before")


def pending_tail(pages: DataFrame) -> DataFrame:
    """``pages`` with ``pending``: the tail of the book's last right page before, in scan order. A right page without a tail clears it."""
    w = Window.partitionBy("tag_id").orderBy("created_at", "scan_id", F.when(F.col("side") == "left", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("side") == "right", F.struct(F.nullif(T.trim(F.col("tail_fragment")), F.lit("")).alias("t"))), ignorenulls=True).over(w)
    return pages.withColumn("_held", held).withColumn("pending", F.col("_held.t")).drop("_held")


#: What a spread asks of its pages.
SPREAD_PAGE = ("page_number", "clean_text", "speak_text", "tail_fragment", "chapter_markers")


def _sides(page: Column) -> list[Column]:
    """The left and right page of a spread, and how many there are of each."""
    left, right = F.col("side") == "left", F.col("side") == "right"
    return [F.max_by(page, left), F.max_by(page, right), F.count_if(left), F.count_if(right)]


def _moved(both: DataFrame) -> DataFrame:
    """``both``, with pages ``l`` and ``r``, and with fragment, left_speak and right_speak."""
    left, right = F.col("l.speak_text"), F.col("r.speak_text")
    found = F.coalesce(T.trailing_fragment(left), F.col("l.tail_fragment"))
    blocked = (T.trim(right) == "") | is_marker_block(T.trim(F.col("l.clean_text")), F.col("l.chapter_markers")) | is_heading_only(T.trim(F.col("r.clean_text")), F.col("r.chapter_markers"))
    moved = both.withColumn("fragment", F.when(~blocked, F.nullif(found, F.lit(""))))
    has = F.col("fragment").isNotNull()
    new_left = F.when(has, T.without_suffix(left, F.col("fragment"))).otherwise(left)
    new_right = F.when(has, T.with_prefix(F.col("fragment"), right)).otherwise(right)
    spread = moved.withColumn("_b", T.bridge(new_left, new_right))
    return spread.withColumn("left_speak", F.col("_b.left")).withColumn("right_speak", F.col("_b.right")).drop("_b")


def carry_in_spread(pages: DataFrame) -> DataFrame:
    """A row per spread with both pages: tag_id, scan_id, fragment, left_speak, right_speak, after the tail moved from left to right and a cut word was bridged.

    Nothing moves if the right page has nothing to say, is a heading only, or the left one is a chapter announcement only."""
    page = F.struct(*SPREAD_PAGE)
    both = pages.groupBy(*SPREAD).agg(*[c.alias(n) for c, n in zip(_sides(page), ("l", "r", "nl", "nr"), strict=True)]).where("nl > 0 and nr > 0")
    return _moved(both).select(*SPREAD, "fragment", "left_speak", "right_speak")


def carried_in_spread(pages: DataFrame) -> DataFrame:
    """``pages`` with the spoken text that carry_in_spread() gives them, found beside each page, so no page is shuffled or made again for it."""
    w = Window.partitionBy(*SPREAD)
    page = F.struct(*SPREAD_PAGE)
    both = pages.select("*", *[c.over(w).alias(n) for c, n in zip(_sides(page), ("l", "r", "nl", "nr"), strict=True)])
    paired = (F.col("nl") > 0) & (F.col("nr") > 0) & F.col("tag_id").isNotNull() & F.col("scan_id").isNotNull()
    said = F.when(paired, F.when(F.col("side") == "left", F.col("left_speak")).otherwise(F.col("right_speak")))
    return _moved(both).withColumn("speak_text", F.coalesce(said, F.col("speak_text"))).select(pages.columns)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last version of each key: an upsert of an append-only log."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order]))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def without_placeholders(pages: DataFrame) -> DataFrame:
    """Pages but for unnumbered ones that a numbered page of the same scan, side and report id replaces."""
    same = ("tag_id", "scan_id", "side", "report_page_id")
    numbers = F.expr("page_number is not null and trim(report_page_id) <> '' and tag_id is not null and scan_id is not null and side is not null")
    both = pages.withColumn("_replaced", F.count_if(numbers).over(Window.partitionBy(*same)) > 0)
    return both.where(~F.col("_replaced") | F.col("page_number").isNotNull()).select(pages.columns)


def storage_order() -> list[Column]:
    """Numbered pages by number, then the others by id."""
    return [F.col("page_number").asc_nulls_last(), F.col("page_id")]
