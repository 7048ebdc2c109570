"""A local session with the settings that this library assumes; on a cluster bring your own."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEAFMILL_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one of a local session; a cluster must name one."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="leafmill-"))
    return _own_dir[0]


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, read again: it cuts lineage, is made once, and survives lost executors."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go once it is done, and not when the driver happens to collect its garbage. A stream that begins within it
    keeps to that until its end."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run where it isn't installed; once per application."""
    import tempfile
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="leafmill-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
