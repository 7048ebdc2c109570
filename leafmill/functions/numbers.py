"""Roman numerals, cardinals in words, durations, and the reporting day."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
GERMAN_UNITS = "null eins zwei drei vier fuenf sechs sieben acht neun zehn elf zwoelf dreizehn vierzehn fuenfzehn sechzehn siebzehn achtzehn neunzehn".split()
GERMAN_TENS = "zwanzig dreissig vierzig fuenfzig sechzig siebzig achtzig neunzig".split()
ENGLISH_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ENGLISH_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DAY_START_HOUR = 4


@lru_cache(2)
def cardinals(language: str) -> list[str]:
    """0 to 999 in words, built up from the words below a hundred."""
    german = language != "en"
    units, tens = (GERMAN_UNITS, GERMAN_TENS) if german else (ENGLISH_UNITS, ENGLISH_TENS)
    below = list(units)
    for t in tens:
        below.append(t)
        below += [f"{'ein' if u == 'eins' else u}und{t}" if german else f"{t}-{u}" for u in units[1:10]]
    out = list(below)
    for u in units[1:10]:
        hundred = f"{'ein' if u == 'eins' else u}hundert" if german else f"{u} hundred"
        out.append(hundred)
        out += [f"{hundred}{'' if german else ' '}{x}" for x in below[1:]]
    return out


def cardinal(n: Column, language: Column) -> Column:
    """Numbers from 0 to 999 in words, others as digits."""
    said = lambda code: F.get(F.array(*map(F.lit, cardinals(code))), n.cast("int"))
    return F.when(n.between(0, 999), F.when(language == "en", said("en")).otherwise(said("de"))).otherwise(n.cast("string"))


def chapter_number(c: Column) -> Column:
    """Digits, or Roman numerals read leniently: a sign below the greatest so far to its right is subtracted. Else null."""
    t = F.upper(F.trim(c))
    signs = F.filter(F.split(F.reverse(t), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def step(acc: Column, x: Column) -> Column:
        v = F.element_at(F.create_map(*[F.lit(y) for kv in ROMAN.items() for y in kv]), x)
        return F.struct(F.when(v < acc["top"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"), F.greatest(acc["top"], v).alias("top"))

    roman = F.aggregate(F.when(t.rlike("^[IVXLCDM]+$"), signs), start, step)["total"]
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.rlike("^[IVXLCDM]+$"), F.nullif(roman, F.lit(0)))


def duration(seconds: Column) -> Column:
    """HH:MM:SS, half seconds to even; negative counts as none, and hours may exceed 24."""
    s = F.greatest(F.lit(0), F.bround(seconds).cast("bigint"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def reporting_day(local: Column) -> Column:
    """The day that a local wall-clock time belongs to; days begin at four."""
    return F.to_date(local - F.expr(f"INTERVAL {DAY_START_HOUR} HOURS"))


def local_time(instant: Column, zone: str = "Europe/Berlin") -> Column:
    """Wall-clock time of an instant, for sessions in UTC."""
    return F.from_utc_timestamp(instant, zone)


def period_start(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T04:00:00"))


def volume_ladder(low: Column, high: Column, n: Column) -> Column:
    """``n`` levels from low to high at equal distances, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(low + (high - low) * i / (n - 1)).cast("int"))


def nearest_level(levels: Column, value: Column) -> Column:
    """Index of the level nearest to ``value``; of equally near ones the lower index."""
    ranked = F.transform(levels, lambda x, i: F.struct(F.abs(x - value).alias("d"), i.alias("i")))
    return F.array_min(ranked)["i"]


def scaled_samples(samples: Column, factor: Column, bits: Column) -> Column:
    """PCM samples times ``factor``, rounded half to even and clipped to the width."""
    top = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bits - 1).cast("int"))
    return F.transform(samples, lambda x: F.greatest(-top, F.least(top - 1, F.bround(x * factor).cast("bigint"))))


def lead_wait(streamed: Column, elapsed: Column, ahead: Column) -> Column:
    return F.greatest(F.lit(0.0), streamed - elapsed - ahead)


def ewma(values: Column, keep: float = 0.8) -> Column:
    """Exponentially weighted mean in order, seeded by the first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.coalesce(acc * keep + x * (1 - keep), x.cast("double")))


def length_scale(speed: Column) -> Column:
    """How much longer speech takes at a speed, which counts as a tenth at least."""
    return F.bround(1.0 / F.greatest(speed, F.lit(0.1)), 3)


def words_per_minute(speed: Column, base: int = 175) -> Column:
    return F.greatest(F.lit(80), F.floor(base * F.greatest(speed, F.lit(0.1))).cast("int"))
