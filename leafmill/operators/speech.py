"""Packing of spoken text, and the reading stream of sentences over page ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import speech as S
from ..functions import text as T

DEFAULT_BYTES, SUMMARY_BYTES = 3800, 900


def speech_units(text: Column) -> Column:
    """Sentences as they are read out, trimmed; the whole text if it has no end."""
    t = T.trim(text)
    marked = F.regexp_replace(t, rf"(?U)({T.PLAYBACK_END})", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), T.trim), lambda u: u != "")


def rendered_size(text: Column, backend: str, label: str) -> Column:
    """Bytes of what the voice is sent."""
    if backend == "google-standard-enhanced":
        text = S.enhanced_ssml(text, label)
    elif backend in ("google", "google-neural2", "say"):
        text = S.ssml(text, label)
    return F.octet_length(text)


def packed_speech(text: Column, backend: str = "google", most: int = DEFAULT_BYTES, label: str = "Kapitel") -> Column:
    """A text in chunks whose rendering has at most ``most`` bytes: sentences packed greedily, a too long one word by word.

    Whole texts that fit, and voices without a limit, give one chunk; an empty text gives none. A single word is never cut.
    """
    t = T.trim(text)
    none = F.array().cast("array<string>")
    fits = lambda c: rendered_size(c, backend, label) <= most
    glued = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))
    pushed = lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def by_word(acc: Column, w: Column) -> Column:
        full = (acc["now"] != "") & ~fits(glued(acc["now"], w))
        return F.when(full, state(pushed(acc), w)).otherwise(state(acc["done"], glued(acc["now"], w)))

    def by_unit(acc: Column, u: Column) -> Column:
        cut = F.aggregate(T.words(u), state(pushed(acc), F.lit("")), by_word)
        return F.when(fits(glued(acc["now"], u)), state(acc["done"], glued(acc["now"], u))).when(fits(u), state(pushed(acc), u)).otherwise(cut)

    folded = F.aggregate(speech_units(t), state(none, F.lit("")), by_unit)
    limited = backend in ("google", "google-standard-enhanced", "google-neural2", "google-gemini-flash")
    whole = fits(t) if limited else F.lit(True)
    return F.when(t == "", none).when(whole, F.array(t)).otherwise(pushed(folded))


def packed_chars(texts: Column, most: int, separator: str = " ") -> Column:
    """Texts packed greedily into batches of at most ``most`` characters, separators counted; a longer text is a batch of its own."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        room = (acc["now"] != "") & (F.length(acc["now"]) + len(separator) + F.length(x) > most)
        grown = F.when(acc["now"] == "", x).otherwise(F.concat(acc["now"], F.lit(separator), x))
        return F.struct(F.when(room, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(room, x).otherwise(grown).alias("now"))

    out = F.aggregate(F.filter(texts, lambda x: x != ""), F.struct(none.alias("done"), F.lit("").alias("now")), step)
    return F.when(out["now"] == "", out["done"]).otherwise(F.concat(out["done"], F.array(out["now"])))


def reading_stream(paragraphs: DataFrame, book: str = "tag_id") -> DataFrame:
    """Sentences of a book over paragraph and page ends: (book, position, text, complete, source_pages).

    Rows: book, page_position, page_id, paragraph, text. A paragraph without an end runs on into the next. Runs of paragraphs that
    run on are found by a running count of paragraphs that close, so only such a run is put together, never a whole book."""
    order = Window.partitionBy(book).orderBy("page_position", "paragraph")
    own = paragraphs.withColumn("text", T.normalize_space(F.col("text"))).where("text <> ''")
    closes = F.when(F.col("text").rlike(T.COMPLETE), 1).otherwise(0)
    own = own.withColumn("_closes", closes).withColumn("_run", F.coalesce(F.sum("_closes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    item = F.struct("page_position", "paragraph", "page_id", "text")
    runs = own.groupBy(book, "_run").agg(F.sort_array(F.collect_list(item)).alias("p"))
    length = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["text"]) + 1))
    runs = runs.withColumn("starts", F.aggregate("p", F.array(F.lit(1)), length)).withColumn("t", F.array_join(F.transform("p", lambda x: x["text"]), " "))
    raw = F.regexp_extract_all("t", F.lit(T.SEGMENT), F.lit(0))
    ends = F.aggregate(raw, F.array(F.lit(1)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    runs = runs.withColumn("raw", raw).withColumn("at", ends)
    each = runs.select(book, "_run", "p", "starts", "at", F.posexplode("raw").alias("i", "raw"))
    text = F.trim("raw")
    begin = F.get("at", F.col("i")) + F.length("raw") - F.length(F.ltrim("raw"))
    stop = F.get("at", F.col("i")) + F.length(F.rtrim("raw"))
    touched = F.filter(F.transform("p", lambda x, k: F.struct(F.get("starts", k).alias("a"), F.get("starts", k + 1).alias("b"), x["page_id"].alias("page"))), lambda x: (x["a"] < stop) & (x["b"] > begin))
    out = each.where(text != "").select(book, "_run", "i", text.alias("text"), T.is_complete(text).alias("complete"), F.array_distinct(F.transform(touched, lambda x: x["page"])).alias("source_pages"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(book).orderBy("_run", "i"))).drop("_run", "i")
