"""Page numbers, footers, chapter markers, and the cleaned and spoken text of a page.

Pages here are rows with ``lines``: an array of (text, bbox, index), in the order of the report. A page is one row, so these are Column functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import bottom, center_y
from ..functions.numbers import cardinal, chapter_number

# Fixed values.
PAGE_NUMBER = r"(?U)^[\[(]?\s*(\d{1,4})\s*[\])]?$"
CHAPTER_LINE = r"(?iU)^(?:(?:kapitel|chapter)\s+)?(\d{1,3}|[ivxlcdm]+)(?:\s*[:.-]\s*(.+))?$"
EXPLICIT_LABEL = r"(?iU)^(kapitel|chapter)\b"
FOOTER_CHARS = r"^[0-9IiLlOoSsZzBbGgQq]{1,4}$"
BLOCK_KINDS = ("explicit_label", "explicit_inline_heading", "explicit_following_heading", "heading_only_page")

LINES = "array<struct<text:string,bbox:array<array<double>>,index:int>>"
MARKER = "struct<line_index:int,chapter_number:int,chapter_heading:string,consumed_line_count:int,detection_kind:string>"


def page_lines(ocr_lines: Column, file_lines: Column | None = None, paragraphs: Column | None = None) -> Column:
    """Lines of a page: those recognised, else those of its text file, else its paragraphs; blank ones are dropped, their index stays.
    Null where no source has a line."""

    def kept(c: Column, text, bbox) -> Column:
        every = F.transform(c, lambda x, i: F.struct(T.normalize_space(text(x)).alias("text"), bbox(x).alias("bbox"), i.alias("index")))
        found = F.filter(every, lambda x: x["text"] != "").cast(LINES)
        return F.when(F.size(found) > 0, found)

    nothing = lambda x: F.lit(None).cast("array<array<double>>")
    sources = [kept(ocr_lines, lambda x: x["text"], lambda x: x["bbox"])]
    sources += [kept(c, lambda x: x, nothing) for c in (file_lines, paragraphs) if c is not None]
    return F.coalesce(*sources)


def _lowest(lines: Column) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(lines, lambda x: bottom(x["bbox"]))), F.lit(0.0)))


def page_number(lines: Column, explicit: Column) -> Column:
    """(position, number): the explicit number and the line that spells it, or of all lines that are a number the lowest on the page.

    Of equally low ones the greater number wins, then the first. ``position`` counts from 0 and is null without a line."""

    def found(lowest: Column) -> Column:
        # Only what looks like a number is read as one: each cast that fails costs an exception.
        numeral = lambda t: F.when(t.rlike(PAGE_NUMBER), F.regexp_extract(t, PAGE_NUMBER, 1).try_cast("int"))
        every = F.transform(lines, lambda x, i: F.struct(numeral(x["text"]).alias("number"), x["bbox"].alias("bbox"), (-i).alias("at")))
        numbered = F.filter(every, lambda x: x["number"].isNotNull())
        return F.array_max(F.transform(numbered, lambda x: F.struct((center_y(x["bbox"]) / lowest).alias("low"), x["number"].alias("number"), x["at"].alias("at"))))

    best = T.once(T.once(_lowest(lines), found), lambda b: F.struct((-b["at"]).cast("int").alias("position"), b["number"].alias("number")))
    spelt = F.array_position(F.transform(lines, lambda x: x["text"]), explicit.cast("string"))
    given = F.struct(F.when(spelt > 0, (spelt - 1).cast("int")).alias("position"), explicit.cast("int").alias("number"))
    return F.when(explicit.isNotNull(), given).otherwise(best)


def footer_artifact(lines: Column) -> Column:
    """Position of the last line near the foot of the page that looks like a misread number; null if there is none."""
    at = lambda lowest: F.transform(lines, lambda x, i: F.when(x["text"].rlike(FOOTER_CHARS) & (bottom(x["bbox"]) / lowest >= 0.93), i))
    return F.array_max(T.once(_lowest(lines), at))


def without(lines: Column, *positions: Column) -> Column:
    """Lines that stand at none of these positions; null positions count for nothing."""
    return T.once(F.array_compact(F.array(*positions)), lambda gone: F.filter(lines, lambda x, i: ~F.array_contains(gone, i)))


def chapter_markers(lines: Column) -> Column:
    """Chapter markers of the cleaned lines in order: labels and numbers, a heading that follows a label, or a page that is one heading."""
    return T.once(F.transform(lines, lambda x: x["text"]), _markers)


def _markers(texts: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        heading = F.nullif(T.normalize_space(F.regexp_extract(t, CHAPTER_LINE, 2)), F.lit(""))
        label = t.rlike(EXPLICIT_LABEL)
        after = F.get(texts, i + 1)
        follows = heading.isNull() & label & F.coalesce(T.is_heading_line(after), F.lit(False)) & after.isNotNull()
        kind = F.when(heading.isNotNull(), "explicit_inline_heading").when(follows, "explicit_following_heading").when(label, "explicit_label").otherwise("number_only")
        return F.when(
            t.rlike(CHAPTER_LINE),
            F.struct(i.alias("line_index"), chapter_number(F.regexp_extract(t, CHAPTER_LINE, 1)).alias("chapter_number"), F.coalesce(heading, F.when(follows, after)).alias("chapter_heading"), F.when(follows, 2).otherwise(1).alias("consumed_line_count"), kind.alias("detection_kind")),
        ).cast(MARKER)

    def with_heading_page(labelled: Column) -> Column:
        numbers = F.flatten(F.transform(labelled, lambda m: F.sequence(m["line_index"], m["line_index"] + m["consumed_line_count"] - 1)))
        free = lambda used: F.filter(F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: ~F.array_contains(used, x["i"]) & (x["t"] != ""))
        return T.once(T.once(numbers, free), lambda rest: added(labelled, rest))

    def added(labelled: Column, rest: Column) -> Column:
        only = F.get(rest, F.lit(0))
        heading_page = (F.size(rest) == 1) & T.is_heading_line(only["t"]) & T.is_heading_shape(only["t"])
        alone = F.struct(only["i"].alias("line_index"), F.lit(None).cast("int").alias("chapter_number"), only["t"].alias("chapter_heading"), F.lit(1).alias("consumed_line_count"), F.lit("heading_only_page").alias("detection_kind")).cast(MARKER)
        return F.when(heading_page, F.concat(labelled, F.array(alone))).otherwise(labelled)

    every = T.once(F.filter(F.transform(texts, one), lambda m: m.isNotNull()), with_heading_page)
    return distinct_markers(every)


def distinct_markers(markers: Column) -> Column:
    """Markers by line; of those equal in line, number and heading the last one stays."""
    same = lambda a, b: (a["line_index"] == b["line_index"]) & a["chapter_number"].eqNullSafe(b["chapter_number"]) & a["chapter_heading"].eqNullSafe(b["chapter_heading"])

    def kept(every: Column) -> Column:
        last = F.filter(every, lambda m, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda x: same(x, m)))
        return F.array_sort(last, lambda a, b: a["line_index"] - b["line_index"])

    return T.once(markers, kept)


def clean_text(lines: Column) -> Column:
    return T.clean_lines(F.transform(lines, lambda x: x["text"]))


def is_heading_only(text: Column, markers: Column) -> Column:
    m = F.get(markers, F.lit(0))
    return F.coalesce((F.size(markers) == 1) & m["chapter_heading"].isNotNull() & m["chapter_number"].isNull() & (T.normalize_space(text) == T.normalize_space(m["chapter_heading"])), F.lit(False))


def is_marker_block(text: Column, markers: Column) -> Column:
    m = F.get(markers, F.lit(0))
    n = F.size(F.filter(F.split(text, "\n"), lambda x: T.normalize_space(x) != ""))
    return F.coalesce((F.size(markers) == 1) & (m["line_index"] == 0) & (n > 0) & (n <= m["consumed_line_count"]) & m["detection_kind"].isin(*BLOCK_KINDS), F.lit(False))


def tail_fragment(text: Column, markers: Column) -> Column:
    """(reason, fragment): what is left open at the end of a page, and why or why not."""
    t = T.trim(text)
    fragment = T.trailing_fragment(t)
    ended = F.right(t, F.lit(4)).rlike(T.PAGE_END)
    has_end = t.rlike(T.PAGE_END)
    reason = (
        F.when(t == "", "empty_clean_text").when(is_heading_only(t, markers), "heading_only_text").when(is_marker_block(t, markers), "chapter_marker_block_only")
        .when(ended, "ends_with_sentence_terminator").when(has_end, "fragment_after_last_sentence_terminator").when(T.is_artifact(t), "ocr_tail_artifact").otherwise("no_sentence_terminator_found")
    )
    kept = F.when(reason.isin("fragment_after_last_sentence_terminator", "no_sentence_terminator_found") & ~F.coalesce(T.is_artifact(fragment), F.lit(False)), fragment)
    return F.struct(reason.alias("reason"), kept.alias("fragment"))


def speak_text(lines: Column, markers: Column, paragraph_ends: Column, language: Column, labels: dict[str, str]) -> Column:
    """The page as it is read out: bare chapter numbers are announced in words, capitals become title case, blank lines follow headings and paragraphs."""
    n = F.size(lines)
    label = F.when(language == "en", labels["en"]).otherwise(labels["de"])
    numbers = F.filter(markers, lambda m: (m["detection_kind"] == "number_only") & m["chapter_number"].isNotNull())

    def rendered(x: Column, i: Column) -> Column:
        marker = F.get(F.filter(numbers, lambda m: m["line_index"] == i), F.lit(0))
        announced = F.array(F.lit("\x01"), F.concat(label, F.lit(" "), cardinal(marker["chapter_number"], language), F.lit(".")), F.lit(""))
        blank = (T.is_upper_heading(x["text"]) | F.array_contains(paragraph_ends, i)) & (i < n - 1)
        plain = T.normalize_upper_heading(x["text"])
        return F.when(marker.isNotNull(), announced).when(blank, F.array(plain, F.lit(""))).otherwise(F.array(plain))

    def put_together(every: Column) -> Column:
        """A mark asks for a blank line unless one stands there; a hyphen before a lower-case start joins two lines. What is done with a
        line depends on its neighbours alone, so all are rendered at once and joined once."""
        at = lambda i: F.coalesce(F.get(every, i), F.lit(""))
        cut = lambda x, y: F.rtrim(x).endswith("-") & (y != "") & T.starts_lower(F.ltrim(y))

        def piece(x: Column, i: Column) -> Column:
            before, here = (i > 0) & cut(at(i - 1), x), cut(x, at(i + 1))
            text = F.when(before, F.ltrim(x)).otherwise(x)
            text = F.when(here, F.substring(F.rtrim(text), F.lit(1), F.length(F.rtrim(text)) - 1)).otherwise(text)
            mark = F.when((i > 0) & (at(i - 1) != ""), "\n").otherwise("")
            return F.when(x == "\x01", mark).otherwise(F.concat(F.when(before | (i == 0), "").otherwise("\n"), text))

        return F.array_join(F.transform(every, piece), "")

    said = T.trim(T.once(F.flatten(F.transform(lines, rendered)), put_together))
    spaced = T.collapse_spaced_letters(said)
    return F.when(language == "de", T.spoken_german(spaced)).otherwise(spaced)


def paragraph_ends(blocks: Column) -> Column:
    """Greatest line index of each paragraph or heading block."""
    own = F.filter(blocks, lambda b: b["kind"].isin("paragraph", "chapter_heading"))
    return F.coalesce(F.array_compact(F.transform(own, lambda b: F.array_max(b["line_indices"]))), F.array().cast("array<int>"))


def remapped(positions: Column, lines: Column) -> Column:
    """Report line indices as positions in ``lines``; those of lines that are gone are dropped."""
    at = lambda indices: F.transform(positions, lambda p: (F.array_position(indices, p) - 1).cast("int"))
    return F.filter(T.once(F.transform(lines, lambda x: x["index"]), at), lambda x: x >= 0)


def marker_offset(text: Column, line_index: Column) -> Column:
    """Characters before a line of a text: each line before it and its break."""
    before = F.slice(F.split(text, "\n"), F.lit(1), line_index)
    return F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1)
