"""Chat formatting with typed content parts, by DataFrame functions alone.

A visitor walks the parts of a turn in order: text is escaped, images, audio and documents become placeholders, and each
attachment is recorded with its turn, reference and expanded token count. Turns are then rendered with control strings, which
escaping keeps out of texts, so the output can be split and read back exactly. The loss mask covers the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template. Every one begins with "<|", which no escaped text holds.
OPEN, HEAD_END, END = "<|turn:", "|>\n", "<|end|>\n"
#: Expanded token counts: pixels a side of an image patch, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 768

PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """Backslashes become \\b and "<|" becomes \\p, so the result holds no control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    """The inverse: in an escaped text every backslash begins a pair, so "\\p" is never part of another."""
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """Roles end at "|>", so there that is escaped too, as \\q."""
    return F.replace(escape(role), F.lit("|>"), F.lit("\\q"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\q"), F.lit("|>")))


def text_part(text: Column) -> Column:
    """A plain text as an array of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens that stand for an attachment; unknown sizes count as one patch, second or page. Text parts have none."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(1)) / PATCH)
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("bigint")
    )


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")).isin("image", "audio", "document")


def visit(parts: Column) -> Column:
    """The content of a turn: escaped texts and placeholders in order. Null parts and parts of unknown kind count as text.

    Neighbouring texts are escaped as one: where "<" ends one and "|" begins the next, the pair is escaped across the seam.
    """
    numbered = F.transform(F.coalesce(parts, F.array().cast(PARTS)), lambda p, i: F.struct(is_attachment(p).alias("attached"), p["kind"].alias("kind"), i.alias("i"), F.coalesce(p["text"], F.lit("")).alias("text")))
    kept = F.filter(numbered, lambda p: p["attached"] | (p["text"] != ""))
    beside = lambda p, q: F.coalesce(~p["attached"] & ~q["attached"] & p["text"].endswith("<") & q["text"].startswith("|"), F.lit(False))

    def one(every: Column, p: Column, k: Column) -> Column:
        before, after = beside(F.get(every, k - 1), p), beside(p, F.get(every, k + 1))
        text = F.substring(p["text"], F.when(before, 2).otherwise(1), F.length(p["text"]) - before.cast("int") - after.cast("int"))
        return F.when(p["attached"], F.concat(F.lit("<|"), p["kind"], F.lit(":"), p["i"].cast("string"), F.lit("|>"))).otherwise(F.concat(escape(text), F.when(after, F.lit("\\p")).otherwise(F.lit(""))))

    # The array of one names the kept parts, so they are made once and not for each part.
    return F.get(F.transform(F.array(kept), lambda every: F.array_join(F.transform(every, lambda p, k: one(every, p, k)), "")), F.lit(0))


def unescaped(parts: Column) -> Column:
    """The content of a turn before escaping, by which turns tied in number and role are ordered."""
    one = lambda p: F.when(is_attachment(p), F.concat(p["kind"], F.lit(":"), F.coalesce(p["uri"], F.lit("")))).otherwise(F.coalesce(p["text"], F.lit("")))
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), one), "")


def read_parts(content: Column, attached: Column) -> Column:
    """The inverse of visit(): (kind, text, uri, tokens) of each part of a turn's content, given its attachments. Neighbouring text parts come back as one, empty ones not at all."""
    mark = r"<\|(?:image|audio|document):\d+\|>"
    texts = F.transform(F.split(content, mark, -1), lambda t: F.struct(F.lit("text").alias("kind"), unescape(t).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("bigint").alias("tokens")))
    spots = F.transform(F.regexp_extract_all(content, F.lit(r"<\|(?:image|audio|document):(\d+)\|>"), F.lit(1)), lambda n: F.get(F.filter(attached, lambda a: a["part"] == n.cast("int")), F.lit(0)))
    between = F.transform(spots, lambda a: F.struct(a["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    every = F.flatten(F.transform(texts, lambda t, i: F.array_compact(F.array(t, F.get(between, i)))))
    return F.filter(every, lambda p: (p["kind"] != "text") | (p["text"] != ""))


def attachments(parts: Column) -> Column:
    """(part, kind, uri, tokens) of each attachment of a turn, in order; ``part`` is the number in its placeholder."""
    every = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens")))
    return F.coalesce(F.filter(every, is_attachment), F.array().cast("array<struct<part:int,kind:string,uri:string,tokens:bigint>>"))


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """A row per conversation: conv_id, formatted, loss, attachments, n_tokens.

    ``loss`` lists the assistant's contents: start in ``formatted`` (code points from 0), ordinal of the turn, begin within the turn's rendering, and length.
    Turns are ordered by turn, then role and content as it was before escaping; repeated rows are turns of their own. Null roles and texts are empty;
    rows with a null conv_id are one conversation. An empty table gives no rows; other columns are ignored.
    """
    own = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        visit(F.col(parts)).alias("_content"),
        unescaped(F.col(parts)).alias("_raw"),
        attachments(F.col(parts)).alias("_attached"),
    )
    head = F.concat(F.lit(OPEN), escape_role(F.col("_role")), F.lit(HEAD_END))
    own = own.withColumn("_head", F.length(head)).withColumn("_text", F.concat(head, F.col("_content"), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_raw", "_content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_at", F.row_number().over(order) - 1).withColumn("_start", F.coalesce(F.sum(F.length("_text").cast("bigint")).over(before), F.lit(0)))
    spoken = F.when(F.col("_role") == "assistant", F.struct(F.col("_at").alias("turn"), (F.col("_start") + F.col("_head")).alias("start"), F.col("_head").alias("begin"), F.length("_content").alias("length")))
    attached = F.transform("_attached", lambda a: F.struct(F.col("_at").alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    grouped = own.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_text"))).alias("_texts"),
        F.sort_array(F.collect_list(spoken)).alias("loss"),
        F.sort_array(F.flatten(F.collect_list(attached))).alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])
    return grouped.select("conv_id", F.array_join(F.transform("_texts", lambda t: t["_text"]), "").alias("formatted"), "loss", "attachments", tokens.alias("attachment_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) recovered from ``formatted`` and ``loss`` alone; turns are (role, text)."""
    rendered = F.split(F.substring(F.col("formatted"), F.lit(1), F.length("formatted") - len(END)), r"<\|end\|>\n", -1)
    rendered = F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(rendered)
    out = formatted.select("conv_id", "loss", F.length("formatted").alias("formatted_chars"), rendered.alias("_rendered"))

    def turn(r: Column) -> Column:
        stop = F.instr(r, "|>")
        role = F.substring(r, F.lit(len(OPEN) + 1), stop - len(OPEN) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(r, stop + len(HEAD_END), F.length(r))).alias("text"))

    spoken = F.transform("loss", lambda x: unescape(F.substring(F.element_at("_rendered", x["turn"] + 1), x["begin"] + 1, x["length"])))
    return out.select("conv_id", F.transform("_rendered", turn).alias("turns"), spoken.alias("loss_texts"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the output."""
    rows = read_back(formatted)
    spoken = F.array_join("loss_texts", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(spoken).cast("bigint").alias("loss_chars"),
        F.sha2(spoken, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint"),
    )
