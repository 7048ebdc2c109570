"""Behaviour that depends on the decision before: one step function each, used alike in batch and in Structured Streaming.

A fold has a start state, which is plain JSON data, and a step from (state, row) to (state, output rows). ``batch`` applies it per key to sorted
rows; ``stream`` keeps the state between micro-batches. Late rows are never dropped: a step decides what they mean. A fold in which something
falls due without a row says when (``due``) and what then (``expire``); keyed.py sets timers for that, and ``batch`` lets all fall due at the end.
A row whose ``control`` is FORGET begins its key anew.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sections import MAX_PAGES, MIN_PAGES, boundaries_of
from ..session import ship


FORGET = "forget"


@dataclass(frozen=True)
class Fold:
    start: dict
    step: Callable[[dict, dict], tuple[dict, list[tuple]]]
    output: str  # DDL of output rows, without the key
    order: tuple[str, ...]
    due: Callable[[dict], float | None] | None = None  # the next time at which something falls due
    expire: Callable[[dict, float], tuple[dict, list[tuple]]] | None = None

    def fresh(self) -> dict:
        return json.loads(json.dumps(self.start))

    def advance(self, state: dict, rows: pd.DataFrame) -> tuple[dict, list[tuple]]:
        """The rows of one key in order."""
        out: list[tuple] = []
        for row in rows.sort_values(list(self.order), kind="stable").to_dict("records"):
            if row.get("control") == FORGET:
                state = self.fresh()
                continue
            state, made = self.step(state, row)
            out += made
        return state, out

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.output.split(", ")]


def batch(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """The fold over all rows of each key in order."""
    ship(rows.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group[key].iloc[0]
        state, out = fold.advance(fold.fresh(), group)
        if fold.expire:
            out += fold.expire(state, math.inf)[1]
        return pd.DataFrame([(name, *m) for m in out], columns=[key, *fold.columns])

    return rows.groupBy(key).applyInPandas(run, f"{key} string, {fold.output}")


def stream(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """The fold over a stream: rows of one micro-batch in order, after those of the batches before. Nothing falls due here; see keyed.timed()."""
    ship(rows.sparkSession)

    def run(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = fold.advance(json.loads(held.get[0]) if held.exists else fold.fresh(), pd.concat(list(parts)))
        held.update((json.dumps(state),))
        yield pd.DataFrame([(name[0], *m) for m in out], columns=[key, *fold.columns])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, {fold.output}", "state string", "append", GroupStateTimeout.NoTimeout)


# --- repeated and backward page turns

#: Seconds in which other parts of a scan that was held may come.
HELD_FOR = 600.0

def guard_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """Whether a delivered part of a scan is read out. A repeated or backward scan is held back once; the scan after it is let through.
    A scan that was held stays so for HELD_FOR, in which its other parts may come; held ones are kept with the time, added to in place."""
    scan, numbers = row["scan_id"], sorted(int(n) for n in row["numbers"])
    said = lambda what: [(row["seq"], scan, what)]
    if not numbers:
        return state, said("allow")
    since = state["held"].get(scan)
    if since is not None and row["seq"] - since < HELD_FOR:
        return state, said("held")
    if scan == state["scan"]:
        return state | {"pages": sorted({*state["pages"], *numbers})}, said("allow")
    repeat, backward = state["repeat"], state["backward"]
    state = state | {"repeat": False, "backward": False}
    taken = state | {"scan": scan, "pages": numbers}
    if backward:
        return taken, said("allow")
    if not repeat and {*numbers} & {*state["pages"]}:
        state["held"][scan] = float(row["seq"])
        return state | {"repeat": True}, said("repeat")
    if state["pages"] and numbers[0] < min(state["pages"]):
        state["held"][scan] = float(row["seq"])
        return state | {"backward": True}, said("backward")
    return taken, said("allow")


GUARD = Fold({"scan": None, "pages": [], "repeat": False, "backward": False, "held": {}}, guard_step, "seq double, scan_id string, decision string", ("seq", "scan_id"))


# --- the open tail of a book's last right page


def tail_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    out = [(row["seq"], row["side"], state["tail"])]
    if row["side"] == "right":
        tail = row["tail_fragment"]
        state = {"tail": tail.strip() or None if isinstance(tail, str) else None}
    return state, out


PENDING_TAIL = Fold({"tail": None}, tail_step, "seq double, side string, pending string", ("seq",))


# --- sections as pages arrive


def section_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """Pages since the open section's start are held; a section is given out as soon as it is closed. Pages before those, which a stream that
    begins after stored sections gets again, are passed over."""
    if row["position"] < state["first"] + len(state["pages"]):
        return state, []
    state = {**state, "pages": [*state["pages"], [[int(m) for m in row["markers"]], int(row["fallback"]), int(row["resume"])]]}
    out = []
    while True:
        pages, first = state["pages"], state["first"]
        marks, fallback, resume = [p[0] for p in pages], [p[1] for p in pages], [p[2] for p in pages]
        made = next(iter(boundaries_of(marks, fallback, resume, (0, state["offset"]), state["sequence"], MIN_PAGES, MAX_PAGES)), None)
        if made is None:
            return state, out
        sequence, start, end, follows, kind = made
        out.append((sequence, first + start[0], start[1], first + end[0], end[1], first + follows[0], follows[1], kind))
        state = {"pages": pages[follows[0] :], "first": first + follows[0], "offset": follows[1], "sequence": sequence + 1}


SECTIONS = Fold({"pages": [], "first": 0, "offset": 0, "sequence": 1}, section_step, "sequence int, start_position int, start_offset int, end_position int, end_offset int, next_position int, next_offset int, boundary_kind string", ("position",))


# --- the front panel

CHORD = ("start_stop_nfc", "book_summary", "chapter_summary")
ACTIONS = {"start_stop_nfc": "START_STOP", "book_summary": "BOOK_SUMMARY", "chapter_summary": "CHAPTER_SUMMARY", "encoder_button": "ENCODER_BUTTON"}
CHORD_SECONDS, DEBOUNCE_SECONDS = 0.18, 0.025


def chord_due(state: dict) -> float | None:
    return min(state["down"].values()) + CHORD_SECONDS if state["down"] else None


def chord_expire(state: dict, now: float) -> tuple[dict, list[tuple]]:
    """Single presses whose window is over act at its end."""
    gone = sorted((t, c) for c, t in state["down"].items() if now - t >= CHORD_SECONDS - 1e-9)
    return {"down": {c: t for c, t in state["down"].items() if (t, c) not in gone}}, [(t + CHORD_SECONDS, ACTIONS[c], 0) for t, c in gone]


def chord_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """Three controls pressed within the window ask for deletion; a single one acts when it is released or the window is over."""
    now, kind, control = row["t"], row["event_type"], row["control"]
    state, out = chord_expire(state, now)
    down = dict(state["down"])
    if kind == "up":
        if down.pop(control, None) is not None:
            out.append((now, ACTIONS[control], 0))
    elif kind == "step":
        out.append((now, "VOLUME_DELTA", int(row["delta"])))
    elif control in CHORD:
        down[control] = now
        if all(c in down for c in CHORD):
            down = {}
            out.append((now, "DELETE_BOOK_REQUEST", 0))
    elif control in ACTIONS:
        out.append((now, ACTIONS[control], 0))
    return {"down": down}, out


CHORDS = Fold({"down": {}}, chord_step, "t double, action string, delta int", ("t",), chord_due, chord_expire)


def debounce_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """A level counts once it has held for the debounce time; rows are samples (t, pressed)."""
    pressed, now = bool(row["pressed"]), row["t"]
    if state["raw"] is None:
        return {"raw": pressed, "stable": pressed, "since": now}, []
    if pressed != state["raw"]:
        return state | {"raw": pressed, "since": now}, []
    if pressed == state["stable"] or now - state["since"] < DEBOUNCE_SECONDS:
        return state, []
    return state | {"stable": pressed}, [(now, "down" if pressed else "up")]


DEBOUNCE = Fold({"raw": None, "stable": None, "since": 0.0}, debounce_step, "t double, event_type string", ("t",))

#: Quarter steps between two phase pairs (a, b): one forwards, one backwards, none for no or a double change.
RING = ((0, 0), (0, 1), (1, 1), (1, 0))


def quadrature_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """Four quarter steps are a detent; rows are samples (t, a, b)."""
    at = RING.index((int(row["a"]), int(row["b"])))
    if state["at"] is None:
        return state | {"at": at}, []
    turn = (at - state["at"]) % 4
    quarter = state["quarter"] + (1 if turn == 1 else -1 if turn == 3 else 0)
    whole = int(quarter / 4)
    return {"at": at, "quarter": quarter - 4 * whole}, [(row["t"], 1 if whole > 0 else -1)] * abs(whole)


QUADRATURE = Fold({"at": None, "quarter": 0}, quadrature_step, "t double, delta int", ("t",))
