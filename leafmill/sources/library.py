"""A library of documents by key, written as a data source with a commit: readers see a version as a whole or not at all.

Layout: documents as files ``<tag_id>/<kind>/<key>.<job>.<ending>``, never overwritten; ``_manifests/<job>/`` a Parquet file per task that lists what it wrote;
``_versions/<number>.json`` a committed version, which names its manifests. A task that is killed, or a job that fails, leaves no version, so readers stay on
the one before; ``vacuum`` removes what such jobs left. Only the names of manifests, one a task, pass the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

FORMAT = "leafmill-library"
ROWS = "tag_id string, kind string, key string, document string"
LISTED = pa.schema([(c, pa.string()) for c in ("tag_id", "kind", "key", "name")])


@dataclass
class Written(WriterCommitMessage):
    manifest: str | None
    n: int


def quoted(part: str | None) -> str:
    """A key as the name of a file: what could lead out of its folder, hide it or clash with the job's mark is percent-encoded."""
    return "".join(c if c.isalnum() or c in "-_ " else "".join(f"%{b:02X}" for b in c.encode()) for c in part or "") or "%"


class LibraryWriter(DataSourceArrowWriter):
    def __init__(self, path: str, ending: str):
        self.path, self.ending, self.job = path.rstrip("/"), ending, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = fs.FileSystem.from_uri(self.path)
        attempt, rows = uuid.uuid4().hex[:12], []
        for batch in iterator:
            for tag, kind, key, document in zip(*(batch.column(c).to_pylist() for c in ("tag_id", "kind", "key", "document")), strict=True):
                folder = f"{quoted(tag)}/{quoted(kind)}"
                store.create_dir(f"{top}/{folder}", recursive=True)
                # Attempts of one task write files of their own; only the winner's are listed.
                name = f"{folder}/{quoted(key)}.{self.job}-{attempt}.{self.ending}"
                with store.open_output_stream(f"{top}/{name}") as out:
                    out.write((document or "").encode())
                rows.append((tag, kind, key, name))
        if not rows:
            return Written(None, 0)
        store.create_dir(f"{top}/_manifests/{self.job}", recursive=True)
        manifest = f"_manifests/{self.job}/{attempt}.parquet"
        pq.write_table(pa.table([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=LISTED), f"{top}/{manifest}", filesystem=store)
        return Written(manifest, len(rows))

    def commit(self, messages: list[Written | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{top}/_versions", recursive=True)
        version = max(versions(self.path), default=0) + 1
        body = {"job": self.job, "documents": sum(m.n for m in messages if m), "manifests": [m.manifest for m in messages if m and m.manifest]}
        whole, target = f"{top}/_versions/.{self.job}", f"{top}/_versions/{version:08d}.json"
        with store.open_output_stream(whole) as out:
            out.write(json.dumps(body).encode())
        if store.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(f"version {version} was committed by another job")
        store.move(whole, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{top}/_manifests/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/_manifests/{self.job}")


class LibrarySource(DataSource):
    """Options: path, a URI of the shared store, and ending of the files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> LibraryWriter:
        if overwrite:
            raise ValueError("a library is added to; use mode append")
        return LibraryWriter(self.options["path"], self.options.get("ending", "json"))


def versions(path: str) -> dict[int, dict]:
    """Committed versions by number."""
    store, top = fs.FileSystem.from_uri(path.rstrip("/"))
    found = {}
    for f in store.get_file_info(fs.FileSelector(f"{top}/_versions", allow_not_found=True)):
        if f.base_name.endswith(".json") and not f.base_name.startswith("."):
            with store.open_input_stream(f.path) as stream:
                found[int(f.base_name.removesuffix(".json"))] = json.loads(stream.read())
    return found


def save(rows: DataFrame, path: str, ending: str = "json") -> None:
    """Add rows (tag_id, kind, key, document) as a new version; one row a key. All of them are there afterwards, or none."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(LibrarySource)
    rows.select([c.split()[0] for c in ROWS.split(", ")]).write.format(FORMAT).option("path", path).option("ending", ending).mode("append").save()


def listed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(tag_id, kind, key, name, version) of the documents of a version, by default the last: of each key the one written last."""
    known = {n: v for n, v in versions(path).items() if version is None or n <= version}
    out = spark.createDataFrame([], "tag_id string, kind string, key string, name string, version int")
    for n, v in sorted(known.items()):
        if v["manifests"]:
            own = spark.read.schema("tag_id string, kind string, key string, name string").parquet(*[f"{path.rstrip('/')}/{m}" for m in v["manifests"]])
            out = out.unionByName(own.withColumn("version", F.lit(n)))
    return out.groupBy("tag_id", "kind", "key").agg(F.max_by("name", F.struct("version", "name")).alias("name"), F.max("version").alias("version"))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(tag_id, kind, key, version, document). A document that its manifest names and that isn't there raises."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(path.rstrip("/"))
        for batch in batches:
            texts = []
            for name in batch.column(4).to_pylist():
                with store.open_input_stream(f"{top}/{name}") as stream:
                    texts.append(stream.read().decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], ["tag_id", "kind", "key", "version", "document"])

    return listed(spark, path, version).select("tag_id", "kind", "key", "version", "name").mapInArrow(run, "tag_id string, kind string, key string, version int, document string")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete manifests and documents of jobs without a version, of which none may be running; returns how many documents went."""
    store, top = fs.FileSystem.from_uri(path.rstrip("/"))
    jobs = {v["job"] for v in versions(path).values()}
    gone = 0
    for f in store.get_file_info(fs.FileSelector(top, recursive=True)):
        inside = f.path.removeprefix(f"{top}/").lstrip("/")
        if f.type == fs.FileType.File and not inside.startswith("_versions/"):
            job = inside.split("/")[1] if inside.startswith("_manifests/") else f.base_name.split(".")[1].split("-")[0]
            if job not in jobs:
                store.delete_file(f.path)
                gone += not inside.startswith("_manifests/")
    return gone
