"""Files that tasks write themselves, committed as a whole: written under names of their attempt, listed in a manifest, then renamed.

The manifest, a Parquet table, is committed by Spark and so names the files of winning attempts only; files of lost attempts are in none and
go with the temporary folder. A second job renames what the manifest lists and writes the final manifest. Either job may be repeated: ``commit``
on a folder whose driver died goes on where that one stopped. Readers trust nothing: a file that isn't what its row says raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession

from .common import delete

MANIFEST = "shard int, part int, name string, temporary string, n_bytes bigint, n_records bigint, sha1 string"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.rstrip("/"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Checked:
    """A stream that is read to its end and then must have the size and the digest of its manifest row."""

    def __init__(self, stream, row: dict):
        self.stream, self.row, self.size, self.digest = stream, row, 0, hashlib.sha1()

    def read(self, n: int) -> bytes:
        piece = self.stream.read(n)
        self.size += len(piece)
        self.digest.update(piece)
        return piece

    def close(self, n_records: int | None = None) -> None:
        while self.read(1 << 20):
            pass
        if (self.size, self.digest.hexdigest()) != (self.row["n_bytes"], self.row["sha1"]):
            raise ValueError(f"{self.row['name']} isn't the file that the manifest names: {self.size} bytes, {self.row['n_bytes']} expected")
        if n_records not in (None, self.row["n_records"]):
            raise ValueError(f"{self.row['name']} has {n_records} records, {self.row['n_records']} expected")


class Output:
    """A file being written in a task's temporary folder; ``row`` is its line of the manifest once it is closed."""

    def __init__(self, temporary: str, name: str, attempt: str, shard: int, part: int):
        self.store, at = opened(temporary)
        self.store.create_dir(at, recursive=True)
        self.name, self.path, self.shard, self.part = name, f"{name}.{attempt}", shard, part
        self.stream = self.store.open_output_stream(f"{at}/{self.path}", compression=None)
        self.size, self.n, self.digest = 0, 0, hashlib.sha1()

    def write(self, data: bytes, records: int = 1) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.n += records

    def close(self) -> tuple:
        self.stream.close()
        return (self.shard, self.part, self.name, self.path, self.size, self.n, self.digest.hexdigest())


def temporary_of(folder: str) -> str:
    return f"{folder.rstrip('/')}/_temporary"


def commit(spark: SparkSession, folder: str, made: Callable[[], DataFrame], schema: str = MANIFEST) -> DataFrame:
    """Run ``made``, whose tasks write files to ``temporary_of(folder)`` and return manifest rows, rename the files and return the final manifest.

    If a driver died before, what it finished is kept: after a whole first job only the renaming is done, else all begins anew; the caller
    must give the same rows. A folder with a final manifest is refused, and so is a file in the way that isn't the one to be renamed.
    """
    top = folder.rstrip("/")
    first, final = f"{top}/_manifest-temporary", f"{top}/manifest"
    if exists(spark, f"{final}/_SUCCESS"):
        raise FileExistsError(f"{top} is written already")
    delete(spark, final)
    if not exists(spark, f"{first}/_SUCCESS"):
        delete(spark, first)
        delete(spark, temporary_of(top))
        made().write.parquet(first)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, at = opened(top)
            for row in batch.to_pylist():
                source, target = f"{at}/_temporary/{row['temporary']}", f"{at}/{row['name']}"
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    try:
                        store.move(source, target)
                    except OSError:
                        if store.get_file_info(target).type == fs.FileType.NotFound:  # else another attempt was first
                            raise
                else:
                    with store.open_input_stream(target, compression=None) as stream:
                        Checked(stream, row).close()
            yield batch

    spark.read.schema(schema).parquet(first).mapInArrow(rename, schema).write.parquet(final)
    delete(spark, temporary_of(top))
    delete(spark, first)
    return manifest(spark, top, schema)


def manifest(spark: SparkSession, folder: str, schema: str = MANIFEST) -> DataFrame:
    """The files of a committed folder; one that isn't committed raises."""
    final = f"{folder.rstrip('/')}/manifest"
    if not exists(spark, f"{final}/_SUCCESS"):
        raise FileNotFoundError(f"{folder} has no committed manifest")
    return spark.read.schema(schema).parquet(final)
