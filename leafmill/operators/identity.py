"""Which book a reader sees: tag parsing, alias resolution, and consistency of a book's language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def aliases(lines: DataFrame) -> DataFrame:
    """(tag_id, alias) from rows (tag_id, line) of alias files; blank lines and repetitions don't count."""
    return lines.select("tag_id", T.tag_id(F.col("line")).alias("alias")).where("alias is not null").distinct()


def with_aliases(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` (tag_id, alias) with those of ``new`` that it hasn't."""
    return known.unionByName(new.select("tag_id", "alias").distinct().join(known, ["tag_id", "alias"], "left_anti"))


def books_with_alias(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Books of which one alias is wanted."""
    return known.join(wanted.select("alias"), "alias", "left_semi").select("tag_id").distinct()


def reader_tags(status: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, position, technology, uid, reader_id) of status lines "READER id=1 tag14443a=1 uid14443a=… tag15693=0", or, without these
    fields, "tag=1 uid=… tech=…". Absent tags and lines whose reader isn't a number don't count; repeated tags count once, the first."""
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("v")))
    # The last value of a repeated field counts.
    field = lambda name: F.element_at(F.when(F.exists("p", lambda x: x["k"] == name), F.filter("p", lambda x: x["k"] == name)), -1)["v"]
    own = status.where(F.col("line").startswith("READER ")).withColumn("p", pairs).withColumn("reader_id", F.coalesce(field("id"), F.lit("0")).try_cast("int")).where("reader_id is not null")
    new_style = F.coalesce(field("tag14443a").isNotNull() | field("tag15693").isNotNull(), F.lit(False))
    seen = lambda flag, uid: (flag == "1") & (uid != "") & (uid != "-")
    made = [F.when(seen(field(f"tag{c}"), field(f"uid{c}")), F.struct(F.lit(t).alias("technology"), T.reader_uid(field(f"uid{c}")).alias("uid"))) for t, c in (("iso14443a", "14443a"), ("iso15693", "15693"))]
    old = F.when(~new_style & seen(field("tag"), field("uid")) & field("tech").isin("ISO14443A", "ISO15693"), F.struct(F.lower(field("tech")).alias("technology"), T.reader_uid(field("uid")).alias("uid")))
    each = own.select(key, "reader_id", F.posexplode(F.array(*made, old)).alias("position", "t")).where("t is not null and t.uid is not null").select(key, "position", "t.technology", "t.uid", "reader_id")
    return each.groupBy(key, "technology", "uid", "reader_id").agg(F.min("position").alias("position"))


def resolve(tags: DataFrame, alias: DataFrame, books: DataFrame, scan: str = "scan") -> DataFrame:
    """(scan, tag_id, rule) of what a scan's tags name: an ISO 14443A tag, else a known alias, else a book's own key, else the only unknown ISO 15693 tag."""
    known = alias.groupBy("alias").agg(F.min("tag_id").alias("owner"))
    own = tags.join(known.withColumnRenamed("alias", "uid"), "uid", "left").join(books.select(F.col("tag_id").alias("uid"), F.lit(True).alias("book")).distinct(), "uid", "left")
    rule = F.when(F.col("technology") == "iso14443a", 1).when(F.col("owner").isNotNull(), 2).when(F.col("book"), 3).otherwise(4)
    named = F.when(rule == 2, F.col("owner")).otherwise(F.col("uid"))
    ranked = own.select(scan, "uid", rule.alias("rule"), named.alias("named"))
    best = ranked.groupBy(scan).agg(F.min_by("named", F.struct("rule", "uid")).alias("tag_id"), F.min("rule").alias("rule"), F.count_distinct("uid").alias("n"))
    sure = (F.col("rule") < 4) | (F.col("n") == 1)
    return best.select(scan, F.when(sure, F.col("tag_id")).alias("tag_id"), F.when(sure, F.col("rule")).alias("rule"))


def inconsistent_books(pages: DataFrame, books: DataFrame) -> DataFrame:
    """(tag_id, language, n_pages) of books with pages of another language; null languages are German."""
    own = books.select("tag_id", F.coalesce("language", F.lit("de")).alias("language"))
    wrong = pages.select("tag_id", F.coalesce("language", F.lit("de")).alias("page_language")).join(own, "tag_id").where("page_language <> language")
    return wrong.groupBy("tag_id", "language").agg(F.count("*").alias("n_pages"))


def upsert_books(books: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, refused): books with those seen (tag_id, seen_at, language) added or refreshed; a language that differs is refused, a missing one is filled by German only."""
    new = seen.groupBy("tag_id").agg(F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"), F.min("language").alias("_language"))
    both = books.join(new, "tag_id", "full")
    clash = F.col("created_at").isNotNull() & F.col("_language").isNotNull() & (F.coalesce("language", F.lit("de")) != F.col("_language"))
    language = F.when(F.col("created_at").isNull(), F.col("_language")).when(F.col("language").isNull() & (F.col("_language") == "de"), "de").otherwise(F.col("language"))
    fresh = F.when(clash, F.col("last_seen_at")).otherwise(F.greatest("last_seen_at", "_last"))
    out = both.select("tag_id", F.coalesce("created_at", "_first").alias("created_at"), fresh.alias("last_seen_at"), language.alias("language"))
    return out, both.where(clash).select("tag_id", "language", F.col("_language").alias("refused_language"))


def mail_is_accepted(senders: Column, allowed: Column, subject: Column, attachments: Column) -> Column:
    """Sender set equals the allowed one, the subject asks to save, and there is one attachment with a plain file name."""
    same = F.array_sort(F.array_distinct(F.transform(senders, lambda s: F.lower(F.trim(s))))) == F.array(F.lower(F.trim(allowed)))
    name = F.get(attachments, F.lit(0))
    plain = ~name.rlike(r"[/\\\x00]") & ~name.isin("", ".", "..")
    return F.coalesce(same & F.lower(F.ltrim(subject)).startswith("save ") & (F.size(attachments) == 1) & plain, F.lit(False))


def unprocessed(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages not yet handled in their mailbox generation (uid_validity)."""
    return messages.join(done.select("uid_validity", "uid").distinct(), ["uid_validity", "uid"], "left_anti")
