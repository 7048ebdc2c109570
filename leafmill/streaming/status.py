"""Callbacks on streams: what happened to each batch, as tables, and functions to be called with it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from .tables import put, stored

EVENTS = "batch int, status string, n_rows bigint, error string"


def observed(
    work: Callable[[DataFrame, int], DataFrame | None],
    folder: str,
    status: Callable[[str], None] | None = None,
    result: Callable[[int, DataFrame | None], None] | None = None,
    failure: Callable[[int, BaseException], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``work`` of a foreachBatch sink with a table ``events`` of batches: done, with the rows that ``work`` returns, or failed, with the error. A batch that
    runs again replaces its row. ``status`` gets a line a batch, ``result`` the number and rows of one that is done, ``failure`` the error of one that isn't, which
    then goes on to the query. A callback that fails is a failure of the batch."""

    def note(spark: SparkSession, number: int, what: str, n: int, error: str | None) -> None:
        put(spark.createDataFrame([(number, what, n, error)], EVENTS), f"{folder}/events", number)
        if status:
            status(f"batch {number}: {what}, {n} rows" + (f", {error}" if error else ""))

    def run(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        try:
            made = work(part, number)
            n = 0 if made is None else made.count()
            if result:
                result(number, made)
        except BaseException as e:
            note(spark, number, "failed", 0, f"{type(e).__name__}: {e}"[:500])
            if failure:
                failure(number, e)
            raise
        note(spark, number, "done", n, None)

    return run


def events(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/events", EVENTS).select([c.split()[0] for c in EVENTS.split(", ")])


PROGRESS = "query string, batch bigint, n_input bigint, milliseconds bigint, status string, error string"


class ProgressLog(StreamingQueryListener):
    """Progress and end of all queries of a session as small files in a folder, read with progress()."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _write(self, name: str, row: dict) -> None:
        store, top = fs.FileSystem.from_uri(self.folder)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/.{name}") as out:
            out.write(json.dumps(row).encode())
        store.move(f"{top}/.{name}", f"{top}/{name}.json")

    def onQueryStarted(self, event) -> None:
        self._write(f"{event.id}-started-{uuid.uuid4().hex[:8]}", {"query": str(event.id), "status": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(f"{p.id}-{p.batchId:08d}", {"query": str(p.id), "batch": p.batchId, "n_input": p.numInputRows, "milliseconds": p.batchDuration, "status": "progress"})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(f"{event.id}-ended-{uuid.uuid4().hex[:8]}", {"query": str(event.id), "status": "failed" if event.exception else "ended", "error": (event.exception or "")[:10_000] or None})


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(f"{folder.rstrip('/')}/*.json")
