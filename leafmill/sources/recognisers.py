"""Recognisers by name: each a table function from what a recogniser gave for a page to its lines.

Results of the known recognisers are read by readers.recognised() with native functions. Others are added with ``register``: a class whose ``eval`` takes a value and
yields (line_index, text, confidence). Nothing is recognised here; values are given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .readers import recognised

LINES = "line_index int, text string, confidence double"
#: Names of recognisers whose results are read natively.
NATIVE = ("paddle", "rapidocr", "rapid", "tesseract")

_known: dict[str, Callable] = {}


def register(name: str) -> Callable[[type], type]:
    """Class decorator: make a table function known by a name, which doesn't mind case and blanks around it."""

    def add(handler: type) -> type:
        key = name.strip().lower()
        if key in NATIVE:
            raise ValueError(f"{name!r} is read natively")
        _known[key] = F.udtf(handler, returnType=LINES, useArrow=True)
        return handler

    return add


def recognise(rows: DataFrame, name: str, key: str = "page_id", value: str = "result") -> DataFrame:
    """(key, line_index, text, confidence) of rows (key, value) by the recogniser of that name; blank lines are left out, null values have none, an unknown name raises."""
    chosen = name.strip().lower()
    if chosen in NATIVE:
        return recognised(rows, key, value).select(key, "line_index", "text", "confidence")
    if chosen not in _known:
        raise ValueError(f"unknown recogniser {name!r}; known are {', '.join(sorted([*NATIVE, *_known]))}")
    ship(rows.sparkSession)
    given = rows.select(key, value).where(F.col(value).isNotNull())
    return given.lateralJoin(_known[chosen](F.col(value).outer())).select(key, "line_index", F.trim("text").alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).where("text <> ''")


@register("lines")
class PlainLines:
    """Plain text, a line a line, as tools print it."""

    def eval(self, value: str):
        for i, line in enumerate(value.split("\n")):
            yield i, line, None
