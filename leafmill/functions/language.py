"""The languages that books may have, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code, language code of speech, label of chapters, name of the language in requests.
PROFILES = {"de": ("de-DE", "Kapitel", "German"), "en": ("en-US", "Chapter", "English")}
DEFAULT = "de"
LABELS = {code: label for code, (_, label, _) in PROFILES.items()}


def language(code: Column) -> Column:
    """A code as it is stored; null is the default, an unknown one an error."""
    own = F.lower(F.trim(F.coalesce(code, F.lit(DEFAULT))))
    return F.when(own.isin(*PROFILES), own).otherwise(F.raise_error(F.concat(F.lit("unknown language "), own)).cast("string"))


def profile(code: Column) -> Column:
    """(code, speech_code, chapter_label, summary_language) of a code."""
    own = language(code)
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for c, p in PROFILES.items() for x in (c, p[k])]), own)
    return F.struct(own.alias("code"), pick(0).alias("speech_code"), pick(1).alias("chapter_label"), pick(2).alias("summary_language"))
