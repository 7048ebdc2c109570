"""Text repair and sentence functions as Column expressions; all stay in the JVM.

Regular expressions are Unicode-aware ("(?U)"). Five notions of "sentence end" coexist on purpose; each has its own name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expressions and word lists of the data contract.
#: White space of Unicode and the four separators of ASCII.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Runs of these but for single blanks. Most characters are passed over at the first test, and what is in order isn't written anew.
DISORDER = r"(?![!-~])(?: (?U:[\s\x1c-\x1f]+)|(?U:[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*))"
SEGMENT = r"""[^.!?]*[.!?]["'»«”“)]*|[^.!?]+$"""
COMPLETE = r"""[.!?][\s"'»«”“)]*$"""
PAGE_END = r"""[.!?…](?:["'»”)\]]+)?(?=\s|$)"""
PLAYBACK_END = r"""[.!?…](?:["'«»”)\]]+)?(?=\s|$)"""
PARAGRAPH_END = r"""[.!?…](?:["'»”)\]]+)?\s*$"""
SECTION_END = r"""[.!?…](?:["'»”)\]]+)?"""
ARTIFACT = r"^[\[(][^\])]{1,14}[\])]$"
HEADING_BLOCKLIST = ("inhalt", "inhaltsverzeichnis", "prolog", "epilog")
VOWELS = "aeiouäöüAEIOUÄÖÜ"
NOT_UPPER = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with ``c`` computed once, however often f refers to it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space at its ends, which alone are looked at."""
    return F.btrim(c, F.lit(BLANKS))


def normalize_space(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), DISORDER, " "))


def words(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(normalize_space(c), " "), lambda w: w != "")


def n_words(t: Column) -> Column:
    """How many words a text has whose white space is normal already."""
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + (t != "").cast("int")


def n_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def word_count(c: Column) -> Column:
    """Words with inner hyphens and apostrophes count once."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\w+(?:[-’']\w+)*\b"))


def tag_id(c: Column) -> Column:
    """Upper-cased book key, null where it is empty, "." or "..", or holds other characters than letters, digits, ".", "_", "-"."""
    t = trim(c)
    return F.when(t.rlike(r"^[A-Za-z0-9._-]+\z") & ~t.isin(".", ".."), F.upper(t))


def reader_uid(c: Column) -> Column:
    return tag_id(F.regexp_replace(F.upper(trim(c)), "[:\\- ]", ""))


def sentences(c: Column) -> Column:
    """Sentences in order; every terminator ends one, closers go with it, and what is left is the last."""
    return F.filter(F.transform(F.regexp_extract_all(normalize_space(c), F.lit(SEGMENT), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def is_complete(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(COMPLETE)


def is_artifact(c: Column) -> Column:
    t = trim(c)
    return t.rlike(ARTIFACT) & t.rlike(r"(?U)\d")


def trailing_fragment(c: Column, end: str = PAGE_END) -> Column:
    """What stands after the last sentence end; null if nothing does, or if an end lies within the last four characters."""
    t = trim(F.coalesce(c, F.lit("")))
    rest = trim(F.regexp_replace(t, rf"(?Us)^.*{end}", ""))
    return F.when((t == "") | F.right(t, F.lit(4)).rlike(end), None).otherwise(F.nullif(rest, F.lit("")))


def without_suffix(c: Column, suffix: Column) -> Column:
    """The text, trimmed, without ``suffix`` at its end; the text as it is where suffix is null or empty."""
    t = trim(c)
    cut = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(suffix)), r"(?U)[\s\x1c-\x1f]+\z", "")
    return F.when(suffix.isNull() | (suffix == ""), c).when(t.endswith(suffix), cut).otherwise(t)


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def with_prefix(fragment: Column, c: Column) -> Column:
    """A carried fragment before a text; a word cut by a hyphen is joined. Empty fragments and artifacts are left out."""
    f, t = trim(F.coalesce(fragment, F.lit(""))), trim(c)
    glued = F.concat(F.substring(f, F.lit(1), F.length(f) - 1), t)
    return F.when((f == "") | is_artifact(f), t).when(t == "", f).when(f.endswith("-") & starts_lower(t), glued).otherwise(F.concat(f, F.lit(" "), t))


def bridge(left: Column, right: Column) -> Column:
    """(left, right) with a hyphenated word at the end of ``left`` moved before ``right``, if that begins in lower case."""
    a, b = trim(left), trim(right)
    word = F.regexp_extract(a, r"(?U)([^\s-]+-)\s*$", 1)
    moves = (word != "") & starts_lower(b)
    kept = F.regexp_replace(F.substring(a, F.lit(1), F.length(a) - F.length(word)), r"(?U)\s+\z", "")
    return F.struct(F.when(moves, kept).otherwise(a).alias("left"), F.when(moves, F.concat(F.substring(word, F.lit(1), F.length(word) - 1), b)).otherwise(b).alias("right"))


def merge_hyphens(lines: Column) -> Column:
    """Lines joined by blanks; a hyphen before a lower-case start is removed with the break."""
    trimmed = F.filter(F.transform(lines, lambda x: trim(F.coalesce(x, F.lit("")))), lambda x: x != "")

    def join(so_far: Column, x: Column) -> Column:
        return F.when(so_far == "", x).when(so_far.endswith("-") & starts_lower(x), F.concat(F.substring(so_far, F.lit(1), F.length(so_far) - 1), x)).otherwise(F.concat(so_far, F.lit(" "), x))

    return F.aggregate(trimmed, F.lit(""), join)


def collapse_spaced_letters(c: Column) -> Column:
    """"K a p i t e l" becomes "Kapitel": runs of three or more letters that stand alone lose the gaps between them, however wide."""
    gap, letter = r"[^\S\r\n]", r"\p{L}"
    # Possessive, so the run is walked without a stack, whatever its length.
    run = rf"(?U)(?<!\w){letter}(?:{gap}++{letter}(?!\w)){{2,}}+"

    # Whatever holds a run holds this, which is found faster.
    two = rf"(?U){gap}{letter}{gap}++{letter}(?!\w)"

    def closed(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(run), F.lit(0))
        joined = F.array_join(F.flatten(F.zip_with(F.split(t, run, -1), runs, lambda x, y: F.array(x, F.regexp_replace(F.coalesce(y, F.lit("")), rf"(?U){gap}+", "")))), "")
        return F.when(t.rlike(two), joined).otherwise(t)

    return once(c, closed)


def title_case(c: Column) -> Column:
    """Each run of letters with its first in upper and the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def is_upper_heading(c: Column) -> Column:
    own = lambda t: t.rlike(r"\p{L}") & ~t.rlike(NOT_UPPER) & n_words(normalize_space(t)).between(2, 10) & (F.length(t) <= 80)
    return once(trim(c), own)


def normalize_upper_heading(c: Column) -> Column:
    t = trim(c)
    lead = F.regexp_extract(c, r"(?U)^\s*", 0)
    tail = F.regexp_extract(c, r"(?U)\s*\z", 0)
    return F.when(is_upper_heading(c), F.concat(lead, title_case(t), tail)).otherwise(c)


def _without_words(c: Column, word: str) -> Column:
    """Words joined by blanks, but for those that are ``word`` as a whole."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_space(c), rf"(?<![^ ])(?:{word})(?![^ ])", ""), " {2,}", " "))


def without_isolated_letters(c: Column) -> Column:
    return _without_words(c, r"\p{L}")


def without_consonant_pairs(c: Column) -> Column:
    """Without two-letter lower-case words that hold no vowel."""
    small, other = rf"[\p{{Ll}}&&[^{VOWELS}]]", rf"[\p{{L}}&&[^\p{{Lu}}\p{{Lt}}{VOWELS}]]"
    return _without_words(c, f"{small}{other}|{other}{small}")


def without_orphan_percent(c: Column) -> Column:
    """Without percent signs that follow no digit, a blank between aside."""
    return F.regexp_replace(c, r"(?U)(?<!\d)(?<!\d )%", "")


def paragraph_text(lines: Column) -> Column:
    """Lines of a paragraph as repaired running text."""
    t = once(collapse_spaced_letters(merge_hyphens(lines)), normalize_upper_heading)
    return normalize_space(without_orphan_percent(without_consonant_pairs(without_isolated_letters(t))))


def spoken_german(c: Column) -> Column:
    doctor = F.regexp_replace(c, r"(?U)(?<!\w)Dr\.(?=\s|$)", "Doktor")
    return F.regexp_replace(doctor, r"(?U)(?<![\w-])Notre-Dame(?![\w-])", "Notre Damm")


def is_heading_line(c: Column) -> Column:
    own = lambda t: (t != "") & (F.length(t) <= 80) & ~t.rlike("[.!?…:;]$") & (n_words(t) <= 8) & ~F.lower(t).isin(*HEADING_BLOCKLIST)
    return once(normalize_space(c), own)


def is_heading_shape(c: Column) -> Column:
    """Four of five letters are capitals, or at most five words all begin with one."""

    def own(t: Column) -> Column:
        few = (n_words(t) <= 5) & ~t.rlike(r"(?:^| )[^\p{Lu} ]")
        return t.rlike(r"\p{L}") & (few | (F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) * 10 >= n_letters(t) * 8))

    return once(normalize_space(c), own)


def is_layout_heading(c: Column, n_lines: Column) -> Column:
    enough = lambda t: F.regexp_count(t, F.lit(r"(?<![^ ])\p{Lu}")) * 10 >= F.greatest(n_words(t), F.lit(1)) * 6
    return (n_lines <= 2) & (F.length(c) <= 80) & ~c.rlike("[.!?,;:]$") & once(normalize_space(c), enough)


def is_speech_heading(c: Column) -> Column:
    return (F.length(c) <= 80) & (n_words(normalize_space(c)) <= 10) & ~c.rlike(r"""[.!?…]["'«»”)\]]?$""")


def is_title_cased(c: Column) -> Column:
    """At least two words with letters, the first letter of each a capital."""
    own = lambda t: t.rlike(r"^[^\p{L}]*+\p{L}[^ ]*+ [^\p{L}]*+\p{L}") & ~t.rlike(r"(?<![^ ])[^\p{L} ]*+[\p{L}&&[^\p{Lu}]]")
    return once(normalize_space(c), own)


def is_quoted_dialogue(c: Column) -> Column:
    return c.rlike(r'^(?:"[^"\n]+"|„[^“\n]+“|»[^«\n]+«)\z') & c.rlike(r'[.!?…]["“«]\z')


def clean_lines(lines: Column) -> Column:
    """Lines that aren't empty, one below the other."""
    return trim(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def collapse_blank_lines(c: Column) -> Column:
    """Lines trimmed; runs of blank ones become one."""
    lines = F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), trim), "\n")
    return trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def target_words(pages: Column, per_page: int = 250) -> Column:
    return F.greatest(F.lit(25), F.bround(F.greatest(F.lit(0.1), pages) * per_page).cast("int"))


def format_pages(pages: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", F.greatest(F.lit(0.1), pages).cast("double")), r"\.0$", "")


def page_range(start: Column, end: Column, language: Column) -> Column:
    """"pages 3-5" and its shorter forms, in German or English."""
    s, e = start.cast("string"), end.cast("string")

    def said(none: str, to: str, since: str, one: str, many: str) -> Column:
        return (
            F.when(s.isNull() & e.isNull(), none).when(s.isNull(), F.concat(F.lit(f"{to} "), e)).when(e.isNull(), F.concat(F.lit(f"{since} "), s))
            .when(start == end, F.concat(F.lit(f"{one} "), s)).otherwise(F.concat(F.lit(f"{many} "), s, F.lit("-"), e))
        )

    return F.when(language == "en", said("without page number", "through page", "from page", "page", "pages")).otherwise(said("ohne Seitenzahl", "bis Seite", "ab Seite", "Seite", "Seiten"))


def truncated(c: Column, most: int = 96) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def page_label(side: Column, number: Column, page_id: Column) -> Column:
    return F.concat_ws(":", side, F.coalesce(number.cast("string"), page_id))


def page_id(number: Column, report_id: Column, scan_id: Column, side: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("page_%04d", number)).otherwise(F.coalesce(F.nullif(normalize_space(report_id), F.lit("")), F.concat_ws("_", scan_id, side)))
