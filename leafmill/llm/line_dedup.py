"""Line deduplication within edit distance, by DataFrame functions alone: the segment-partition join.

Lines are compared by two hashes; equal ones collapse before anything is shuffled. For near-equal ones a line is cut into
threshold + 1 segments, of which any line within the threshold holds one unchanged, near its place. Each line emits its
segments, and the substrings that a shorter or equally long partner's segments could be (multi-match-aware positions). What meets at a key
is verified by a banded bit-parallel automaton: one word of 2 * threshold + 1 diagonals for each number of errors.

A key that many lines share, as lines of one pattern do, forms no pairs. What the key leaves open of a line are gaps, each with the errors
that may lie in it; these are halved, and a half without errors joins what is alike, until few lines share a key, or until the gaps are
closed: so few characters are open that all lines of the key are within the threshold. Of these the least place decides, by an
aggregation, so no group of lines is ever compared pair by pair, and the levels are no more than the logarithm of a line's length.

Of lines that are equal or within the threshold, the first in order of (doc_id, position) stays; a line is dropped if an equal
or near line stands before it. Lines shorter than ``min_chars`` always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up

MIN_CHARS = 20
THRESHOLD = 1
#: Keys with more members than this are refined before pairs are formed.
HEAVY = 32
#: Halvings of a gap at once, at a threshold of 1.
SPLITS = 3
#: Halvings by which the alike ends of two lines are found before they are verified.
HALVINGS = 10
#: Rows of 64 bits of a sieve, two to the power of this; that many rows at most are broadcast, whatever the data.
SIEVE_ROWS = 18
#: Parts into which the copies of one line are dealt.
SALTS = 16

LAST = 2**63 - 1
GAPS = "array<struct<a:int,b:int,errors:int,left:int,right:int,closed:boolean>>"


def segment(length: Column, i: int, n: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of n; lengths differ by one at most."""
    start = F.floor(length * i / n)
    return (start + 1).cast("int"), (F.floor(length * (i + 1) / n) - start).cast("int")


def _key(what: str, length: Column, i: int, text: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(what), length, F.lit(i), F.substring(text, start, size))


def roles(threshold: int) -> list[tuple[int, int, int]]:
    """(extra, segment, shift) of the keys of a line: it is ``extra`` longer than the partner whose segment it may hold, moved by ``shift``."""
    t = threshold
    return [(extra, i, shift) for extra in range(t + 1) for i in range(t + 1) for shift in range(max(-i, extra - (t - i)), min(i, extra + (t - i)) + 1)]


def segment_keys(text: Column, length: Column, threshold: int, what: str = "line") -> Column:
    """Keys (key, role) of a text: its segments, and the substrings that segments of an equally long or shorter partner could be.

    Substrings that its own segments stand for are not repeated; a key is null where the text is too short for it."""
    out = []
    for role, (extra, i, shift) in enumerate(roles(threshold)):
        start, size = segment(length - extra, i, threshold + 1)
        key = _key(what, length - extra, i, text, start + shift, size)
        inside = (start + shift >= 1) & (start + shift + size - 1 <= length)
        out.append(F.struct((key if extra == shift == 0 else F.when(inside, key)).alias("key"), F.lit(role).cast("tinyint").alias("role")))
    return F.array(*out)


def _gap(a: Column, b: Column, errors, left, right, closed=False) -> Column:
    """Characters a to b of the shorter line are open; the longer one's text is moved by ``left`` before and by ``right`` after them."""
    columns = (a, b, *(x if isinstance(x, Column) else F.lit(x) for x in (errors, left, right)))
    return F.struct(*[c.cast("int").alias(n) for c, n in zip(columns, ("a", "b", "errors", "left", "right"), strict=True)], (closed if isinstance(closed, Column) else F.lit(closed)).alias("closed"))


def gaps_of(role: Column, length: Column, threshold: int) -> Column:
    """(length of the shorter line, gaps) that a segment's key leaves open: up to i errors before segment i, the others after it."""
    out = F.lit(None)
    for k, (extra, i, shift) in enumerate(roles(threshold)):
        short = length - extra
        start, size = segment(short, i, threshold + 1)
        gaps = [_gap(F.lit(0), start - 1, i, 0, shift)] * (i > 0) + [_gap(start - 1 + size, short, threshold - i, shift, extra)] * (i < threshold)
        out = F.when(role == k, F.struct(short.cast("int").alias("short"), F.array(*gaps).cast(GAPS).alias("gaps"))).otherwise(out)
    return out


def _costs(g: Column) -> Column:
    """The most errors that a gap's characters can hold."""
    return F.greatest(g["b"] - g["a"], g["b"] - g["a"] + g["right"] - g["left"])


def _possible(g: Column) -> Column:
    moved = g["right"] - g["left"]
    return (g["b"] - g["a"] + moved >= 0) & (F.abs(moved) <= g["errors"]) & (~g["closed"] | (_costs(g) <= g["errors"]))


def halved(g: Column, threshold: int) -> Column:
    """Ways (arrays of gaps) in which the errors of a gap may lie in its halves; of a gap of one character before it, after it, on either side or in it."""
    a, b, e, left, right = (g[n] for n in ("a", "b", "errors", "left", "right"))
    one = b - a == 1
    middle = (a + F.floor((b - a) / 2)).cast("int")
    # What is without errors joins the run before or after it, which is moved alike.
    ways = [F.array(_gap(F.when(one, a).otherwise(middle), F.when(one, a).otherwise(b), e, left, right, one)), F.array(_gap(F.when(one, b).otherwise(a), F.when(one, b).otherwise(middle), e, left, right, one)), F.when(one, F.array(_gap(a, b, e, left, right, True)))]
    for i in range(1, threshold):
        for moved in range(-threshold, threshold + 1):
            both = F.array(_gap(a, F.when(one, a).otherwise(middle), i, left, moved, one), _gap(F.when(one, b).otherwise(middle), b, e - i, moved, right, one))
            ways.append(F.when((e > i) & (F.abs(left - moved) <= i) & (F.abs(right - moved) <= e - i), both))
    open_ones = F.filter(F.array(*[w.cast(GAPS) for w in ways]), lambda w: w.isNotNull() & F.forall(w, _possible))
    done = _gap(a, b, e, left, right, True)
    return F.when(g["closed"], F.array(F.array(g).cast(GAPS))).when(a == b, F.filter(F.array(F.array(done).cast(GAPS)), lambda w: F.forall(w, _possible))).otherwise(open_ones)


def refined(gaps: Column, threshold: int) -> Column:
    """All ways to halve every gap of a key."""
    none = F.array(F.array().cast(GAPS))
    return F.aggregate(gaps, none, lambda acc, g: F.flatten(F.transform(acc, lambda before: F.transform(halved(g, threshold), lambda way: F.concat(before, way)))))


def gap_key(text: Column, short: Column, gaps: Column) -> Column:
    """Names what two lines have alike outside of the gaps, and where these are."""
    ends = lambda i: F.coalesce(F.get(gaps["b"], i - 1), F.lit(0))
    runs = F.transform(gaps, lambda g, i: F.substring(text, ends(i) + g["left"] + 1, g["a"] - ends(i)))
    last = F.element_at(gaps, -1)
    return F.xxhash64(F.lit("gaps"), short, gaps["a"], gaps["b"], gaps["errors"], runs, F.substring(text, last["b"] + last["right"] + 1, short - last["b"]))


def may_be_within(a: Column, b: Column, threshold: int) -> Column:
    """A cheap necessary condition: of twice as many finer segments of ``a`` all but ``threshold`` stand in ``b``, near their place."""
    n, found = 2 * (threshold + 1), F.lit(0)
    for i in range(n):
        start, size = segment(F.length(a), i, n)
        same = F.lit(False)
        for shift in range(-threshold, threshold + 1):
            same = same | ((start + shift >= 1) & (F.substring(a, start, size) == F.substring(b, F.greatest(start + shift, F.lit(1)), size)))
        found = found + F.when(same, 1).otherwise(0)
    return found >= n - threshold


def _alike(a: Column, b: Column, last: bool) -> Column:
    """So many first (or last) characters are alike in both texts, found by halving: less than a part in 2 ** HALVINGS of them is missed."""
    n = F.least(F.length(a), F.length(b))

    def longer(found: Column, parts: Column) -> Column:
        size = F.ceil(n / parts).cast("int")
        begin = -(found + size) if last else found + 1
        return F.when((found + size <= n) & (F.substring(a, begin, size) == F.substring(b, begin, size)), found + size).otherwise(found)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(1, HALVINGS + 1)]), F.lit(0), longer)


def trimmed(a: Column, b: Column) -> Column:
    """Texts (a, b) without what is alike at their beginnings and ends, which their edit distance doesn't depend on."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    for last in (False, True):
        known = F.transform(F.array(pair), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), _alike(p["a"], p["b"], last).alias("n")))  # noqa: B023
        left = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n) if last else F.substring(x, n + 1, F.length(x))  # noqa: B023, E731
        pair = F.get(F.transform(known, lambda p: F.struct(left(p["a"], p["n"]).alias("a"), left(p["b"], p["n"]).alias("b"))), F.lit(0))  # noqa: B023
    return pair


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two texts is at most ``threshold``; the automaton reads what trimming leaves of them.

    Bit j of ``r{e}`` says that with at most e errors the texts can be aligned so far with their places j - threshold apart. A
    character of a match keeps the diagonal, an error keeps it or moves to a neighbour.
    """
    t, mask = threshold, (1 << (2 * threshold + 1)) - 1

    def closed(rows: list[Column]) -> Column:
        for e in range(1, t + 1):
            rows[e] = rows[e].bitwiseOR(rows[e - 1]).bitwiseOR(F.shiftleft(rows[e - 1], 1).bitwiseAND(F.lit(mask)))
        return F.struct(*[r.cast("bigint").alias(f"r{e}") for e, r in enumerate(rows)])

    start = closed([F.lit(1 << t).cast("bigint"), *[F.lit(0).cast("bigint")] * t])

    def walk(chars: Column) -> Column:
        """Over arrays of characters a and b, both computed once."""

        def step(state: Column, x: Column) -> Column:
            match = sum((F.when(F.get(chars["b"], x["i"] + (j - t)) == x["c"], F.lit(1 << j)).otherwise(0) for j in range(2 * t + 1)), F.lit(0)).cast("bigint")
            rows = [state["r0"].bitwiseAND(match)]
            for e in range(1, t + 1):
                before = state[f"r{e - 1}"]
                rows.append(state[f"r{e}"].bitwiseAND(match).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)))
            return closed(rows)

        return F.aggregate(F.transform(chars["a"], lambda c, i: F.struct(c.alias("c"), i.alias("i"))), start, step)[f"r{t}"]

    apart = F.length(b) - F.length(a) + t
    def judged(rest: Column) -> Column:
        """Over what trimming leaves; where that is nothing of one text, all of the other's are errors, no more than ``apart`` allows."""
        chars = F.array(F.struct(F.split(rest["a"], "").alias("a"), F.split(rest["b"], "").alias("b")))
        end = F.get(F.transform(chars, walk), F.lit(0))
        ended = F.call_function("shiftright", end, apart.cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.when((F.length(rest["a"]) == 0) | (F.length(rest["b"]) == 0), True).otherwise(ended)

    return F.when((apart < 0) | (apart > 2 * t), False).otherwise(F.get(F.transform(F.array(trimmed(a, b)), judged), F.lit(0)))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, pos, line, h1, h2) of each line long enough; ``doc`` is the id, or the greatest number for null."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.length("line") >= min_chars).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.hash("line"))


def _meet(keys: DataFrame) -> DataFrame:
    """Pairs (a1, a2, b1, b2) of different lines that meet at a key: own segments with one another, and with substrings of longer lines."""
    left = keys.where("own").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    right = keys.select("key", F.col("own").alias("b_own"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    once = F.struct("a1", "a2") < F.struct("b1", "b2")
    other = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    return left.join(right, "key").where(F.when(F.col("b_own"), once).otherwise(other)).select("a1", "a2", "b1", "b2").distinct()


def _shared(emitted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of keys that more than one line has: a count by key, summed map-side, finds these, and only their rows are dealt out again."""
    shared = emitted.groupBy("key").agg(F.min("h1").alias("l1"), F.max("h1").alias("g1"), F.min("h2").alias("l2"), F.max("h2").alias("g2")).where("l1 < g1 or l2 < g2")
    return emitted.join(scratch.save(shared.select("key"), "shared"), "key").distinct()


def _slot(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit((1 << SIEVE_ROWS) - 1))


def sifted(rows: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with the flag ``name``: false if the number in ``column`` is surely none of ``wanted``. A bitmap of bounded size is broadcast; where it is too
    small for what is wanted more rows are flagged, and the join that follows decides."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.select(_slot(F.col(column)).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    found = rows.withColumn("slot", _slot(F.col(column))).join(F.broadcast(bitmap), "slot", "left")
    return found.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("slot", "bits")


def _texts(lines: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, line) of the lines of ``ends`` (h1, h2). Lines pass a sieve before they are shuffled; one that stands in many documents is dealt to SALTS
    tasks, each of which passes on one copy."""
    salted = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = sifted(lines.select("h1", "h2", "line", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int").alias("salt")), "h1", ends, "maybe").where("maybe").drop("maybe")
    return scratch.save(spread.join(salted.hint("merge"), ["h1", "h2", "salt"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line")), "texts")


def refine(keys: DataFrame, lines: DataFrame, scratch: Scratch, threshold: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(pairs, groups) of rows (h1, h2, role) of keys that more than HEAVY lines share: pairs of lines that meet at refined keys, and
    rows (key, h1, h2, own) of keys whose gaps are closed: each line of such a key is near to all whose ``own`` text is shortest there."""
    texts = _texts(lines, scratch.save(keys.select("h1", "h2").distinct(), "held"), scratch)
    state = gaps_of(F.col("role"), F.length("line"), threshold)
    rows = keys.join(texts, ["h1", "h2"]).select("h1", "h2", state.alias("s")).select("h1", "h2", "s.short", "s.gaps")
    pairs, groups = None, None
    while True:
        ways = F.array("gaps")
        for _ in range(SPLITS if threshold == 1 else 1):
            ways = F.flatten(F.transform(ways, lambda g: refined(g, threshold)))
        new = rows.select("h1", "h2", "short", F.explode(F.array_distinct(ways)).alias("gaps")).join(texts, ["h1", "h2"])
        own = F.forall("gaps", lambda g: (g["left"] == 0) & (g["right"] == 0))
        closed = F.aggregate("gaps", F.lit(0), lambda n, g: n + _costs(g)) <= threshold
        new = new.select("h1", "h2", "short", "gaps", gap_key(F.col("line"), F.col("short"), F.col("gaps")).alias("key"), own.alias("own"), closed.alias("closed"))
        new = scratch.save(new, "fine")
        count = new.groupBy("key").agg(F.count("*").alias("m"), F.bool_and("closed").alias("done"), F.bool_or("own").alias("any")).where("m > 1 and any").withColumn("heavy", F.col("m") > HEAVY)
        met = scratch.save(look_up(new, count, ["key"], "m", new.count(), F.col("h1"), "inner"), "met")
        few = _meet(met.where("not done and not heavy"))
        same = met.where("done").select("key", "h1", "h2", "own")
        pairs, groups = (few, same) if pairs is None else (pairs.unionByName(few), groups.unionByName(same))
        rows = met.where("not done and heavy").select("h1", "h2", "short", "gaps")
        if rows.isEmpty():
            return pairs, groups


def near_pairs(lines: DataFrame, scratch: Scratch, threshold: int) -> tuple[DataFrame, DataFrame | None]:
    """(a1, a2, b1, b2) of pairs of different lines within the threshold, and groups as refine() gives them; together all such lines."""
    sized = lines.select("h1", "h2", "line", F.length("line").alias("n"))
    emitted = sized.select("h1", "h2", F.inline(segment_keys(F.col("line"), F.col("n"), threshold))).where("key is not null")
    keys = scratch.save(_shared(emitted, scratch), "keys")
    heavy = scratch.save(keys.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HEAVY).withColumn("heavy", F.lit(True)), "heavy")
    # Rows of keys that are surely light aren't dealt out to find that.
    marked = sifted(keys, "key", heavy, "maybe")
    light = marked.where("not maybe").drop("maybe").withColumn("heavy", F.lit(None).cast("boolean"))
    keys = scratch.save(light.unionByName(look_up(marked.where("maybe").drop("maybe"), heavy, ["key"], "m", keys.count(), F.col("h1"))), "marked")
    own = F.col("role").isin([k for k, (extra, _, shift) in enumerate(roles(threshold)) if extra == shift == 0])
    pairs = _meet(keys.where("heavy is null").withColumn("own", own))
    many, groups = keys.where("heavy").select("h1", "h2", "role"), None
    if not many.isEmpty():
        more, groups = refine(many.distinct(), lines, scratch, threshold)
        pairs = pairs.unionByName(more).distinct()
    pairs = scratch.save(pairs, "pairs")
    ends = scratch.save(pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).distinct(), "ends")
    texts = _texts(lines, ends, scratch)
    both = pairs.join(texts.toDF("a1", "a2", "a"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "b"), ["b1", "b2"])
    a, b = F.col("a"), F.col("b")
    return both.where(F.when(may_be_within(a, b, threshold), within(a, b, threshold)).otherwise(False)).select("a1", "a2", "b1", "b2"), groups


def earlier_in_groups(groups: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(a1, a2, theirs): of each line the least place of a line that it is near to in a group, if that is before its own."""
    placed = scratch.save(groups.distinct().join(known.select("h1", "h2", "first"), ["h1", "h2"]), "placed")
    least = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("first").alias("any_first"), F.min(F.when(F.col("own"), F.col("first"))).alias("own_first"))
    both = look_up(placed, least, ["key"], "m", placed.count(), F.col("h1"), "inner")
    theirs = F.when(F.col("own"), F.col("any_first")).otherwise(F.col("own_first"))
    return both.where(theirs < F.col("first")).select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), theirs.alias("theirs"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that stay, and with n_lines and n_dropped_lines added.

    All other columns are kept, whatever their names; columns named n_lines or n_dropped_lines are replaced. A null text stays null with no lines. Rows with equal id and text
    count as one document, so they keep the same lines; rows with a null id come last in order. An empty table stays empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = lines_of(own, min_chars)
    place = F.struct("doc", "text_hash", "pos")
    known = scratch.save(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "known")
    near, groups = near_pairs(lines, scratch, threshold)
    near = scratch.save(near, "near")
    both = near.unionByName(near.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    earlier = both.join(known.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("theirs")), ["b1", "b2"]).groupBy("a1", "a2").agg(F.min("theirs").alias("theirs"))
    if groups is not None:
        earlier = earlier.unionByName(earlier_in_groups(groups, known, scratch)).groupBy("a1", "a2").agg(F.min("theirs").alias("theirs"))
    judged = known.join(earlier.withColumnRenamed("a1", "h1").withColumnRenamed("a2", "h2"), ["h1", "h2"], "left")
    judged = judged.withColumn("whole", F.coalesce(F.col("theirs") < F.col("first"), F.lit(False))).where("n > 1 or whole").select("h1", "h2", "n", "first", "whole")
    judged = scratch.save(judged, "judged")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scratch.keep_only(judged)
    found = look_up(lines.select("doc", "text_hash", "pos", "h1", "h2"), judged, ["h1", "h2"], "n", total, F.xxhash64("doc", "pos"), "inner")
    gone = found.where(F.col("whole") | (F.col("first") != place)).groupBy("doc", "text_hash").agg(F.array_distinct(F.collect_list("pos")).alias("gone"))
    # The input row travels as one column, so no name of its columns can clash.
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.struct("*").alias("row"))
    out = keyed.join(gone, ["doc", "text_hash"], "left")
    whole, gone = F.col("row")[text].cast("string"), F.col("gone")
    n = F.coalesce(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0))

    def kept(own: Column) -> Column:
        """Of lines, split once, and the places of those that go, what stays."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(own["lines"]) - 1), own["gone"])
        return F.array_join(F.transform(stay, lambda i: F.get(own["lines"], i)), "\n")

    cut = F.get(F.transform(F.array(F.struct(F.split(whole, "\n").alias("lines"), gone.alias("gone"))), kept), F.lit(0))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped_lines")]
    columns = [F.when(gone.isNull(), F.col("row")[c]).otherwise(cut).alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return out.select(*columns, n.cast("bigint").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped_lines"))
