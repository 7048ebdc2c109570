"""Shared plumbing: scratch tables in the cluster's shared folder, skew-safe look-ups, Arrow batches."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..session import shared_dir, ship

#: A key is hot when it holds at least 1 / HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1000
#: Rows in an Arrow batch handed to Python; texts may be long, so the default of 10,000 rows is too many.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Send the code to the workers, and keep Arrow batches of whole texts small; a smaller limit of the session stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def need_whole_numbers(df: DataFrame, *columns: str) -> None:
    """Raise TypeError, before any job runs, unless these columns are of an integer type."""
    for c in columns:
        kind = df.select(c).schema[0].dataType
        if not isinstance(kind, (IntegralType, NullType)):
            raise TypeError(f"column {c} must hold whole numbers, not {kind.simpleString()}")


class Scratch:
    """Tables written once to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._made: list[tuple[DataFrame, str]] = []
        self._count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{name}-{self._count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._made.append((out, path))
        return out

    def free(self) -> None:
        """Let Spark delete the shuffle files of plans that are done with; else they stay until the driver happens to collect garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame, free: bool = True) -> None:
        """Delete tables that no later job reads, and free shuffle files."""
        self._delete([x for x in self._made if any(x[0] is t for t in tables)])
        if free:
            self.free()

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all other tables, once the result needs these alone."""
        self._delete([x for x in self._made if not any(x[0] is t for t in tables)])
        self.free()

    def _delete(self, gone: list) -> None:
        self._made = [x for x in self._made if not any(x is g for g in gone)]
        for _, path in gone:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def own_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are; other applications that share the folder have their own."""
    return f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}"


def purge(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; call it once their results are stored elsewhere."""
    delete(spark, own_folder(spark))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def look_up(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, which has one row a key and in ``weight`` the number of left rows of that key.

    Keys with at least total / HOT_SHARE rows, HOT_SHARE keys at most, are broadcast; their left rows get a salt from
    ``spread`` and so are dealt evenly in the shuffle join that serves all other keys. No row is dropped. Null keys find nothing.
    """
    extra = [c for c in right.columns if c not in keys and c != weight]
    bar = max(1, -(-total // HOT_SHARE))
    hot = right.where(F.col(weight) >= bar).select(*keys, F.struct(*extra).alias("_hot"))
    cold = right.where(F.col(weight) < bar).select(*keys, F.lit(0).alias("_salt"), F.struct(*extra).alias("_cold"))
    out = left.join(F.broadcast(hot), keys, "left")
    anyway = F.col("_hot").isNotNull()
    for k in keys:
        anyway = anyway | F.col(k).isNull()
    out = out.withColumn("_salt", F.when(anyway, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    out = out.join(cold, [*keys, "_salt"], "left")
    got = F.coalesce("_hot", "_cold")
    if how == "inner":
        out = out.where(got.isNotNull())
    elif how == "anti":
        return out.where(got.isNull()).drop("_hot", "_cold", "_salt")
    return out.select(*[c for c in out.columns if c not in ("_hot", "_cold", "_salt")], *[got[c].alias(c) for c in extra])
