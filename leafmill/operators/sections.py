"""Sections of a book: windows of 10 to 20 pages that end at a chapter marker or, without one, at the last complete paragraph.

Where a section ends depends on where the one before ended. With sections of two pages or more only its first page matters, so each page has one
successor; chains are followed within blocks of pages, and blocks are joined by pointer doubling, so no task holds a book. Functions over blocks get numbers
only, a few bytes a page; offsets are computed before, and texts are cut after, by plain DataFrame operations.

Page rows: tag_id, scan_id, side, page_number, page_id, created_at, clean_text, chapter_markers.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship, written
from .structure import marker_offset

MIN_PAGES, MAX_PAGES = 10, 20
BOUNDARIES = "tag_id string, sequence int, start_position int, start_offset int, end_position int, end_offset int, next_position int, next_offset int, boundary_kind string"


def assembly_order(pages: DataFrame) -> DataFrame:
    """``pages`` with ``position`` from 0: by time, scan, left before right, numbered first, number, id."""
    side = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    order = Window.partitionBy("tag_id").orderBy("created_at", "scan_id", side, F.col("page_number").isNull(), F.coalesce("page_number", F.lit(0)), "page_id")
    return pages.withColumn("position", F.row_number().over(order) - 1)


def fallback_offset(text: Column) -> Column:
    """End of the last paragraph that ends a sentence and has another after it, else of the last sentence, else of the text."""
    paragraph = F.regexp_extract(text, r"""(?Us)^(.*[.!?…](?:["'»”)\]]+)?)\s*\n\s*\n""", 1)
    sentence = F.regexp_extract(text, rf"(?s)^(.*{T.SECTION_END})", 1)
    n = F.length(text)
    return F.when(T.trim(text) == "", n).when(paragraph != "", F.length(paragraph)).when(sentence != "", F.length(sentence)).otherwise(n)


def page_facts(pages: DataFrame) -> DataFrame:
    """(tag_id, position, markers, fallback, resume): offsets at which a section may end on a page, and where the next begins then."""
    text = F.col("clean_text")
    end = fallback_offset(text)
    blank = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"(?U)^[\s\x1c-\x1f]*", 0))
    markers = F.transform(F.col("chapter_markers"), lambda m: marker_offset(text, m["line_index"]))
    return pages.select("tag_id", "position", F.coalesce(markers, F.array().cast("array<int>")).alias("markers"), end.alias("fallback"), (end + blank).alias("resume"))


def boundaries_of(markers: list, fallback: list, resume: list, start: tuple[int, int] = (0, 0), sequence: int = 1, least: int = MIN_PAGES, most: int = MAX_PAGES) -> Iterable[tuple]:
    """Sections of one book, as far as they are closed: (sequence, start, end, next start, kind)."""
    page, offset = start
    n = len(markers)
    while True:
        found = None
        for i in range(page + least - 1, min(n, page + most)):
            for at in markers[i]:
                if i > page or at > offset:
                    found = ((i, at), (i, at), "chapter_marker")
                    break
            if found:
                break
        if not found:
            if n - page < most:
                return
            i = page + most - 1
            found = ((i, fallback[i]), (i, resume[i]), "fallback_last_complete_paragraph")
        end, follows, kind = found
        if follows <= (page, offset):  # a section of one page that can't end before it began
            return
        yield sequence, (page, offset), end, follows, kind
        sequence, (page, offset) = sequence + 1, follows


#: Pages of a block, whose sections one task finds.
BLOCK = 1 << 12
JUMPS = "tag_id string, block int, entry int, to_block int, to_entry int, to_offset int, n int"


def next_starts(markers: list, fallback: list, resume: list, least: int, most: int) -> list[tuple[int, int, int, int, str] | None]:
    """For a section that begins on each page: (end page, end offset, page and offset where the next begins, kind), or None while it is open. With two pages at
    least, where on its page it begins doesn't matter."""
    n, out, marked = len(markers), [], len(markers)
    following = [n] * (n + 1)  # the first page with a marker from each page on
    for p in range(n - 1, -1, -1):
        marked = p if len(markers[p]) else marked
        following[p] = marked
    for p in range(n):
        i = following[min(p + least - 1, n)]
        if i < p + most and i < n:
            out.append((i, int(markers[i][0]), i, int(markers[i][0]), "chapter_marker"))
        elif p + most <= n:
            i = p + most - 1
            out.append((i, int(fallback[i]), i, int(resume[i]), "fallback_last_complete_paragraph"))
        else:
            out.append(None)
    return out


def in_blocks(facts: DataFrame, most: int, block: int) -> DataFrame:
    """Page facts with the block that each page is in, and pages at the beginning of a block once more as what lies ahead of the block before."""
    own = facts.withColumn("block", F.floor(F.col("position") / block).cast("int"))
    ahead = own.where((F.col("block") > 0) & (F.col("position") % block < most)).withColumn("block", F.col("block") - 1)
    return own.unionByName(ahead)


def block_jumps(blocks: DataFrame, most: int, least: int, block: int) -> DataFrame:
    """Of a section that enters a block on one of its first pages: the block, page and offset at which its successors leave it, and how many they are."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        first, number = int(part["position"].iloc[0]), int(part["block"].iloc[0])
        own = (number + 1) * block - first
        rows = []
        if len(part) > own:  # else the book ends here, and nothing leaves
            jumps = next_starts(part["markers"].tolist(), part["fallback"].tolist(), part["resume"].tolist(), least, most)
            leaves: list[tuple[int, int, int] | None] = [None] * own
            for p in range(own - 1, -1, -1):
                if (j := jumps[p]) is not None:
                    after = (j[2], j[3], 0) if j[2] >= own else leaves[j[2]]
                    leaves[p] = after and (after[0], after[1], after[2] + 1)
            rows = [(part["tag_id"].iloc[0], number, e, number + 1, x[0] - own, x[1], x[2]) for e, x in enumerate(leaves[:most]) if x]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in JUMPS.split(", ")])

    return blocks.groupBy("tag_id", "block").applyInPandas(run, JUMPS)


def entries(jumps: DataFrame, books: DataFrame) -> DataFrame:
    """(tag_id, block, entry, offset, sequence) of books (tag_id): where the first section that begins in a block begins, by pointer doubling over the blocks of a book: each
    round joins the jumps of twice as many blocks."""
    reached = books.select("tag_id", F.lit(0).alias("block"), F.lit(0).alias("entry"), F.lit(0).alias("offset"), F.lit(1).alias("sequence"))
    while not (jumps := written(jumps, "jumps")).isEmpty():
        here = jumps.select("tag_id", "block", "entry", "to_block", "to_entry", "to_offset", "n")
        on = reached.join(here, ["tag_id", "block", "entry"]).select("tag_id", F.col("to_block").alias("block"), F.col("to_entry").alias("entry"), F.col("to_offset").alias("offset"), (F.col("sequence") + F.col("n")).alias("sequence"))
        reached = written(reached.unionByName(on), "entries")
        then = here.select("tag_id", F.col("block").alias("to_block"), F.col("entry").alias("to_entry"), F.col("to_block").alias("b"), F.col("to_entry").alias("e"), F.col("to_offset").alias("o"), F.col("n").alias("m"))
        jumps = here.join(then, ["tag_id", "to_block", "to_entry"]).select("tag_id", "block", "entry", F.col("b").alias("to_block"), F.col("e").alias("to_entry"), F.col("o").alias("to_offset"), (F.col("n") + F.col("m")).alias("n"))
    return reached


def boundaries(pages: DataFrame, least: int = MIN_PAGES, most: int = MAX_PAGES, block: int = BLOCK) -> DataFrame:
    """Boundaries of all closed sections; ``pages`` has positions. Sections have two pages at least and no more pages than a block.

    A book is dealt to tasks by blocks. What enters a block on each of its first ``most`` pages leaves it at one place, so blocks are joined like pointers, in as many
    rounds as the logarithm of a book's blocks; books of one block need none.
    """
    if not 2 <= least <= most <= block:
        raise ValueError(f"sections of {least} to {most} pages in blocks of {block}")
    spark = pages.sparkSession
    ship(spark)
    facts = written(page_facts(pages), "facts")
    long = facts.where(F.col("position") >= block).select("tag_id").distinct()
    begins = None
    if not long.isEmpty():
        several = facts.join(long, "tag_id", "left_semi")
        begins = entries(block_jumps(in_blocks(several, most, block), most, least, block), long).where("block > 0")

    def found(part: pd.DataFrame, begin: pd.DataFrame | None = None) -> pd.DataFrame:
        rows = []
        if len(part):
            part = part.sort_values("position")
            first, number = int(part["position"].iloc[0]), int(part["block"].iloc[0])
            own = (number + 1) * block - first
            jumps = next_starts(part["markers"].tolist(), part["fallback"].tolist(), part["resume"].tolist(), least, most)
            known = begin is not None and len(begin)
            # A book begins on its first page; where no section enters a block, none is closed in it.
            page, offset, sequence = (int(begin[c].iloc[0]) for c in ("entry", "offset", "sequence")) if known else (0 if number == 0 else own, 0, 1)
            while page < min(own, len(jumps)) and (j := jumps[page]) is not None:
                rows.append((part["tag_id"].iloc[0], sequence, first + page, offset, first + j[0], j[1], first + j[2], j[3], j[4]))
                page, offset, sequence = j[2], j[3], sequence + 1
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BOUNDARIES.split(", ")])

    if begins is None:
        whole = facts.withColumn("block", F.lit(0))
        return whole.groupBy("tag_id").applyInPandas(lambda book: found(book), BOUNDARIES)
    return in_blocks(facts, most, block).groupBy("tag_id", "block").cogroup(begins.groupBy("tag_id", "block")).applyInPandas(found, BOUNDARIES)


def slices(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Text of each page within a span (tag_id, sequence, start_position, start_offset, end_position, end_offset), empty ones left out."""
    each = spans.withColumn("position", F.explode(F.sequence("start_position", "end_position")))
    both = each.join(pages.select("tag_id", "position", "page_id", "page_number", "clean_text"), ["tag_id", "position"])
    begin = F.when(F.col("position") == F.col("start_position"), F.col("start_offset")).otherwise(0)
    end = F.when(F.col("position") == F.col("end_position"), F.least("end_offset", F.length("clean_text"))).otherwise(F.length("clean_text"))
    cut = F.when(end > begin, T.trim(F.substring(F.col("clean_text"), begin + 1, end - begin))).otherwise("")
    return both.withColumn("slice", cut).where("slice <> ''")


def section_text(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """A row per section: its text, page ids and numbers in order, spans and counts."""
    keys = ["tag_id", "sequence", "start_position", "end_position", *[c for c in ("boundary_kind",) if c in spans.columns]]
    item = F.struct("position", "slice", "page_id", "page_number")
    out = slices(pages, spans).groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("p"))
    numbers = F.filter(F.transform("p", lambda x: x["page_number"]), lambda x: x.isNotNull())
    return out.select(
        *keys,
        F.format_string("chapter_%04d", "sequence").alias("chapter_id"),
        T.trim(F.array_join(F.transform("p", lambda x: x["slice"]), "\n\n")).alias("text"),
        F.transform("p", lambda x: x["page_id"]).alias("page_ids"),
        numbers.alias("page_numbers"),
        F.get(numbers, F.lit(0)).alias("start_page"),
        F.element_at(F.when(F.size(numbers) > 0, numbers), -1).alias("end_page"),
        (F.col("end_position") - F.col("start_position") + 1).alias("page_span"),
        F.size("p").alias("content_page_count"),
    )


def pending(pages: DataFrame, closed: DataFrame) -> DataFrame:
    """Text after each book's last closed section, as spans for section_text()."""
    last = closed.groupBy("tag_id").agg(F.max_by(F.struct("next_position", "next_offset", "sequence"), "sequence").alias("b"))
    ends = pages.groupBy("tag_id").agg(F.max_by(F.struct("position", F.length("clean_text").alias("n")), "position").alias("e"))
    both = ends.join(last, "tag_id", "left")
    return both.select(
        "tag_id",
        (F.coalesce("b.sequence", F.lit(0)) + 1).alias("sequence"),
        F.coalesce("b.next_position", F.lit(0)).alias("start_position"),
        F.coalesce("b.next_offset", F.lit(0)).alias("start_offset"),
        F.col("e.position").alias("end_position"),
        F.col("e.n").alias("end_offset"),
    )


def resolve(boundaries: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored boundaries (tag_id, page_number, page_id, scan_id, side, offset) with the position of their page: the first that has
    the number, else the id, else scan and side, else the report's id."""
    out, found = boundaries, []
    for k, (own, theirs) in enumerate(((["page_number"], ["page_number"]), (["page_id"], ["page_id"]), (["scan_id", "side"], ["scan_id", "side"]), (["page_id"], ["report_page_id"]))):
        first = pages.groupBy(F.col("tag_id").alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(theirs)]).agg(F.min("position").alias(f"_p{k}"))
        same = F.col("tag_id") == F.col("_t")
        for i, c in enumerate(own):
            same = same & (F.col(c) == F.col(f"_k{i}"))
        out = out.join(first, same, "left").drop("_t", *[f"_k{i}" for i in range(len(own))])
        found.append(f"_p{k}")
    return out.withColumn("resolved_position", F.coalesce(*found)).drop(*found)


def next_sequence(chapters: DataFrame) -> DataFrame:
    """(tag_id, next_sequence): one more than the greatest number that ends an id, or than the number of chapters where none does."""
    n = F.regexp_extract("chapter_id", r"(\d+)$", 1).try_cast("int")
    got = chapters.groupBy("tag_id").agg(F.coalesce(F.max(n), F.lit(0)).alias("m"), F.count("*").cast("int").alias("k"))
    return got.select("tag_id", (F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("k")) + 1).alias("next_sequence"))


def resumed(chapters: DataFrame) -> DataFrame:
    """(tag_id, state): where a stream of pages goes on after stored sections (tag_id, sequence, next_position, next_offset)."""
    last = chapters.groupBy("tag_id").agg(F.max_by(F.struct("next_position", "next_offset", "sequence"), "sequence").alias("b"))
    state = F.struct(F.array().cast("array<int>").alias("pages"), F.col("b.next_position").alias("first"), F.col("b.next_offset").alias("offset"), (F.col("b.sequence") + 1).alias("sequence"))
    return last.select("tag_id", F.to_json(state).alias("state"))
