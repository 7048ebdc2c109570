"""Spoken markup: plain and enhanced SSML, and its reduction to text with pauses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_quoted_dialogue, is_speech_heading, is_title_cased, normalize_space, once, trim

# Pauses in milliseconds, the pitch of a question's last word, and expressions of sentence ends, line ends and questions.
ANNOUNCEMENT, HEADING, SENTENCE, PARAGRAPH = 1350, 700, 900, 2000
PITCH = "+3st"
QUESTION = r"""(?s)^(.*?)([A-Za-zÄÖÜäöüß]+)(\?(?:["'«»”)\]]*)?)$"""
SENTENCE_BOUNDARY = r"""(?U)(?:(?<=[.!?…])|(?<=[.!?…]["'«»”)]))\s+(?=[A-ZÄÖÜ0-9"„“»])"""
LINE_END = r"""([.?](?:["'«»”)\]]*)?)[ \t]*\n"""


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def pause(ms: int) -> str:
    return f'<break time="{ms}ms"/>'


def ssml(text: Column, label: str = "Kapitel") -> Column:
    """A spoken page: chapter announcements that stand as a block of their own get a pause before and after."""
    t = escape(trim(text))
    name = re.escape(label.strip() or "Kapitel")
    mark = "\x01"
    announced = rf"(?imU)(^{name} [^\n]+?\.)\n(?:\s*\n)+"
    marked = F.regexp_replace(t, announced, rf"{mark}$1{mark}{mark}")
    before = F.regexp_replace(marked, rf"(?U)^\s*{mark}(?!{mark})", "")
    body = F.regexp_replace(F.regexp_replace(before, rf"(?U)\s*{mark}{mark}\s*{mark}(?!{mark})", pause(ANNOUNCEMENT)), rf"{mark}{mark}", pause(ANNOUNCEMENT))
    body = F.regexp_replace(body, rf"(?U)\s*{mark}", pause(ANNOUNCEMENT))
    return F.when(t == "", "<speak></speak>").otherwise(F.concat(F.lit("<speak>"), body, F.lit("</speak>")))


def paragraphs(text: Column) -> Column:
    """Paragraphs of a page; one that is a quoted dialogue sentence takes in what follows it."""
    marked = F.regexp_replace(trim(text), LINE_END, "$1\n\n")
    parts = F.filter(F.transform(F.split(marked, r"(?U)\n\s*\n+"), normalize_space), lambda p: p != "")

    def joined(every: Column) -> Column:
        before = lambda i: F.get(every, i - 1)
        marks = F.transform(every, lambda p, i: F.concat(F.when(i == 0, "").when(is_quoted_dialogue(before(i)), " ").otherwise("\x01"), p))
        return F.when(F.size(every) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(marks, ""), "\x01"))

    return once(parts, joined)


def sentence_markup(s: Column) -> Column:
    """A sentence; the last word of a question is raised."""
    question = QUESTION
    raised = F.concat(F.lit("<s>"), escape(F.regexp_extract(s, question, 1)), F.lit(f'<prosody pitch="{PITCH}">'), F.regexp_extract(s, question, 2), F.lit("</prosody>"), escape(F.regexp_extract(s, question, 3)), F.lit("</s>"))
    return F.when(s.contains("?") & s.rlike(question), raised).otherwise(F.concat(F.lit("<s>"), escape(s), F.lit("</s>")))


def enhanced_ssml(text: Column, label: str = "Kapitel") -> Column:
    """Paragraphs, sentences, emphasised headings and graded pauses; the plain form where the words would not be the same."""
    name = re.escape(label.strip() or "Kapitel")

    def stressed(p: Column, ms: Column) -> Column:
        return F.concat(F.lit('<s><emphasis level="moderate">'), escape(p), F.lit('</emphasis></s><break time="'), ms.cast("string"), F.lit('ms"/>'))

    def prose(p: Column) -> Column:
        said = F.transform(F.filter(F.transform(F.split(p, SENTENCE_BOUNDARY), trim), lambda s: s != ""), sentence_markup)
        # Each sentence but the last of a paragraph is followed by a pause, the last by a longer one.
        return once(said, lambda each: F.concat(F.lit("<p>"), F.array_join(each, pause(SENTENCE)), F.when(F.size(each) > 0, pause(PARAGRAPH)).otherwise(""), F.lit("</p>")))

    def one(p: Column) -> Column:
        announced = p.rlike(rf"(?iU)^{name}\s+.+[.!?]\z")
        rest = F.when(is_title_cased(p), ANNOUNCEMENT).otherwise(HEADING)
        return F.when(announced, stressed(p, F.lit(ANNOUNCEMENT))).when(is_speech_heading(p), stressed(p, rest)).otherwise(prose(p))

    def whole(t: Column) -> Column:
        return once(F.array_join(F.transform(paragraphs(t), one), ""), lambda body: checked(t, body))

    def checked(t: Column, body: Column) -> Column:
        spoken = F.regexp_replace(unescape(F.regexp_replace(body, "<[^>]+>", "")), r"(?U)\s+", "")
        same = (spoken == F.regexp_replace(t, r"(?U)\s+", "")) & ~t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
        return F.when(t == "", "<speak></speak>").when(same, F.concat(F.lit("<speak>"), body, F.lit("</speak>"))).otherwise(ssml(t, label))

    return once(trim(text), whole)


def plain_speech(markup: Column) -> Column:
    """SSML as text: a pause below 0.35 s is a comma, below 0.8 s or of unknown length a line end, else a blank line."""

    def mark(tag: Column) -> Column:
        return once(break_seconds(F.regexp_extract(tag, 'time="([^"]*)"', 1)), lambda s: F.when(s < 0.35, ", ").when(s.isNull() | (s < 0.8), "\n").otherwise("\n\n"))

    def put_together(m: Column) -> Column:
        pauses = F.transform(F.regexp_extract_all(m, F.lit("<break[^>]*>"), F.lit(0)), mark)
        texts = F.transform(F.split(m, "<break[^>]*>"), lambda t: unescape(unescape(F.regexp_replace(t, "<[^>]+>", ""))))
        return F.array_join(F.flatten(F.zip_with(texts, pauses, lambda t, x: F.array(t, F.coalesce(x, F.lit(""))))), "")

    said = once(markup, put_together)
    one_blank = F.regexp_replace(F.regexp_replace(said, r"[ \t\r\f\x0b]+", " "), r" *\n *", "\n")
    return trim(F.regexp_replace(one_blank, r"\n{3,}", "\n\n"))


def break_seconds(time: Column) -> Column:
    """Seconds of a break's time, in "ms" or "s"; null if it is neither."""
    number = F.regexp_extract(F.lower(F.trim(time)), r"^(\d+(?:\.\d+)?)\s*(ms|s)$", 1)
    unit = F.regexp_extract(F.lower(F.trim(time)), r"^(\d+(?:\.\d+)?)\s*(ms|s)$", 2)
    return F.when(unit == "ms", number.try_cast("double") / 1000).when(unit == "s", number.try_cast("double"))
