"""Summaries as derived data: which are still valid, what they depend on, and how a generator is asked for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

LENGTH_POLICY_VERSION = 1
#: A summary may be longer than asked for by this factor.
SLACK = 1.1
# Reasons for which an answer is refused for good.
REFUSALS = ("SAFETY", "RECITATION", "PROHIBITED_CONTENT")
#: What a generator is asked for, by kind and language; places are the range of pages, their number, words and text.
TEMPLATES = {
    ("chapter", "de"): "Fasse den folgenden Abschnitt (%s, %s Seiten) in etwa %d Woertern zusammen.\n\n%s",
    ("chapter", "en"): "Summarise the following section (%s, %s pages) in about %d words.\n\n%s",
    ("book", "de"): "Fasse das Buch anhand seiner Abschnitte (%s, %s Seiten) in etwa %d Woertern zusammen.\n\n%s",
    ("book", "en"): "Summarise the book from its sections (%s, %s pages) in about %d words.\n\n%s",
    ("progress", "de"): "Fasse zusammen, was bisher gelesen wurde (%s, %s Seiten), in etwa %d Woertern.\n\n%s",
    ("progress", "en"): "Summarise what has been read so far (%s, %s pages) in about %d words.\n\n%s",
    ("shortening", "de"): "Kuerze die folgende Zusammenfassung (%s, %s Seiten) auf hoechstens %d Woerter.\n\n%s",
    ("shortening", "en"): "Shorten the following summary (%s, %s pages) to at most %d words.\n\n%s",
}


def sequence_key(chapter_id: Column, created_at: Column) -> Column:
    """Numbered chapters by number, then the others by time."""
    n = F.regexp_extract(chapter_id, r"^chapter_(\d+)$", 1).try_cast("int")
    return F.struct(F.when(n.isNotNull(), 0).otherwise(1).alias("c"), F.coalesce(n, F.lit(0)).alias("n"), F.when(n.isNull(), created_at).otherwise("").alias("t"), chapter_id.alias("id"))


def latest_chapter(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("tag_id").agg(F.max_by("chapter_id", sequence_key(F.col("chapter_id"), F.col("created_at"))).alias("chapter_id"))


def latest_summarised(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """The latest chapter that has a summary of its own."""
    have = summaries.where("summary_type = 'chapter'").select("tag_id", F.explode("source_chapter_ids").alias("chapter_id")).distinct()
    return latest_chapter(chapters.join(have, ["tag_id", "chapter_id"], "left_semi"))


def is_valid(metadata: Column, language: Column, target_pages: Column, target_words: Column) -> Column:
    """Whether a stored summary may be used: language (null is German), pages, completeness, length policy and words all agree."""
    pages = F.element_at(metadata, "target_pages").try_cast("double")
    same = [
        F.coalesce(F.element_at(metadata, "language"), F.lit("de")) == language,
        F.abs(pages - F.greatest(F.lit(0.1), target_pages)) < 1e-6,
        F.element_at(metadata, "generation_complete") == "true",
        F.element_at(metadata, "length_policy_version").try_cast("int") == LENGTH_POLICY_VERSION,
        F.element_at(metadata, "target_words").try_cast("int") == target_words,
    ]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return F.coalesce(out, F.lit(False))


def fingerprint(summaries: DataFrame) -> DataFrame:
    """(tag_id, source_chapter_ids, fingerprint) over a book's chapter summaries in chapter order: SHA-256 of id, time and text, each ended by a NUL."""
    item = F.struct(sequence_key(F.col("chapter_id"), F.col("created_at")).alias("k"), F.concat("chapter_id", F.lit("\0"), "updated_at", F.lit("\0"), "text", F.lit("\0")).alias("said"), "chapter_id")
    got = summaries.groupBy("tag_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    return got.select("tag_id", F.transform("all", lambda x: x["chapter_id"]).alias("source_chapter_ids"), F.sha2(F.array_join(F.transform("all", lambda x: x["said"]), ""), 256).alias("fingerprint"))


def stale_books(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Books whose stored book summary is missing or was made from other chapter summaries."""
    return current.join(stored.select("tag_id", F.col("source_chapter_ids").alias("_ids"), F.col("fingerprint").alias("_f")), "tag_id", "left").where(~(F.col("_f").eqNullSafe(F.col("fingerprint")) & F.col("_ids").eqNullSafe(F.col("source_chapter_ids")))).drop("_ids", "_f")


def extractive(text: str, words: int) -> str:
    """The default generator: leading sentences up to the number of words asked for, at least one."""
    out: list[str] = []
    n = 0
    for sentence in text.replace("\n", " ").split(". "):
        n += len(sentence.split())
        if out and n > words:
            break
        out.append(sentence.strip())
    said = ". ".join(out)
    return said if said.endswith((".", "!", "?")) or not said else said + "."


def summarised(chapters: DataFrame, generate: Callable[[str, int], str] = extractive, shorten: Callable[[str, int], str] | None = None) -> DataFrame:
    """(tag_id, chapter_id, summary, status) for rows (tag_id, chapter_id, text, target_words): generated, shortened once if too long, and
    marked "too_long" if it stays so. The generator is any function of text and words; it runs in batches on the executors."""
    ship(chapters.sparkSession)
    again = shorten or generate

    def count(s: str) -> int:
        return len(s.split())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tag, chapter, text, words in batch[["tag_id", "chapter_id", "text", "target_words"]].itertuples(index=False):
                said = generate(text or "", int(words))
                if count(said) > words * SLACK:
                    said = again(said, int(words))
                rows.append((tag, chapter, said, "ok" if count(said) <= words * SLACK else "too_long"))
            yield pd.DataFrame(rows, columns=["tag_id", "chapter_id", "summary", "status"])

    return chapters.mapInPandas(run, "tag_id string, chapter_id string, summary string, status string")


def merged_metadata(old: Column, new: Column) -> Column:
    """Keys of ``new`` where ``old`` has none."""
    return F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)), old)


def prompt(kind: str, language: Column, label: Column, pages: Column, words: Column, text: Column) -> Column:
    """What a generator is asked, in the book's language: kind is chapter, book, progress or shortening."""
    said = lambda code: F.format_string(TEMPLATES[kind, code], label, pages, words, text)
    return F.when(language == "en", said("en")).otherwise(said("de"))


def response_text(response: Column) -> Column:
    """(text, complete, blocked) of a generator's JSON answer: the parts of its first candidate that has any, trimmed of blank runs."""
    kind = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>>"
    parsed = F.from_json(response, kind)
    parts = lambda c: F.filter(F.transform(c["content"]["parts"], lambda p: T.trim(F.coalesce(p["text"], F.lit("")))), lambda x: x != "")
    said = F.transform(parsed["candidates"], lambda c: F.struct(F.array_join(parts(c), "\n\n").alias("text"), c["finishReason"].alias("reason")))
    first = F.get(F.filter(said, lambda x: F.trim(x["text"]) != ""), F.lit(0))
    return F.struct(F.nullif(T.collapse_blank_lines(first["text"]), F.lit("")).alias("text"), F.coalesce(first["reason"] == "STOP", F.lit(False)).alias("complete"), parsed["promptFeedback"]["blockReason"].isNotNull().alias("blocked"))


def response_state(response: Column) -> Column:
    """(truncated, retry): whether an answer ran into its limit, and whether it may be asked for again without one: not if it was refused."""
    kind = "struct<candidates:array<struct<finishReason:string>>,promptFeedback:struct<blockReason:string>>"
    parsed = F.from_json(response, kind)
    reasons = F.coalesce(F.transform(parsed["candidates"], lambda c: F.upper(F.coalesce(c["finishReason"], F.lit("")))), F.array().cast("array<string>"))
    refused = F.coalesce(parsed["promptFeedback"]["blockReason"], F.lit("")) != ""
    return F.struct(F.array_contains(reasons, "MAX_TOKENS").alias("truncated"), (~(refused | F.arrays_overlap(reasons, F.array(*map(F.lit, REFUSALS))))).alias("retry"))


def paired(chapters: DataFrame, stored: DataFrame) -> DataFrame:
    """(tag_id, chapter_id, chapter_text, summary): each chapter with its summary, by id and never by place; null where there is none."""
    own = stored.select("tag_id", "chapter_id", F.col("text").alias("summary"))
    return chapters.select("tag_id", "chapter_id", F.col("text").alias("chapter_text")).join(own, ["tag_id", "chapter_id"], "left")


def incremental(chapters: DataFrame, stored: DataFrame) -> DataFrame:
    """Chapters without a stored summary."""
    return chapters.join(stored.select("tag_id", "chapter_id").distinct(), ["tag_id", "chapter_id"], "left_anti")


def numbered(chapters: DataFrame) -> DataFrame:
    """Chapters with their ordinal in the book."""
    order = Window.partitionBy("tag_id").orderBy(sequence_key(F.col("chapter_id"), F.col("created_at")))
    return chapters.withColumn("ordinal", F.row_number().over(order))
