"""Session settings, shared storage and code shipping."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def build(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings this library expects: adaptive plans, Arrow, UTC."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; own and temporary only in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/corpusmill/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "table", options: dict | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and any executor can read it.

    ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialize`` wrote, once all that was made of them is written itself."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def lean(spark: SparkSession) -> SparkSession:
    """Arrow batches below the default 10,000 rows, as whole texts and recordings are long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))
    return spark


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now rather than at its next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the workers if they wouldn't find it by themselves."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    known = [Path(p).resolve() for p in (os.environ.get("PYTHONPATH") or "").split(":") if p]
    if sc in _SHIPPED or root in known or Path.cwd().resolve() == root:
        return
    target = Path(tempfile.mkdtemp(prefix="corpusmill-code-")) / "corpusmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "corpusmill").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc)
