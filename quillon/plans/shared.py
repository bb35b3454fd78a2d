"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: folders written by ``staged`` and not deleted yet, oldest first
_folders: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own where it is unset, which only a local master can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    Shuffle files of the write are deleted when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _folders.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system."""
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
        if path in _folders:
            _folders.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote for these frames, which nothing may read afterwards."""
    for df in frames:
        delete(df.sparkSession, df.staged_in)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``build`` returns and delete everything that was staged on the way."""
    mark = len(_folders)
    out = staged(build(), name)
    delete(spark, *[p for p in _folders[mark:] if p != out.staged_in])
    return out


def release(spark: SparkSession) -> None:
    """Delete all staged tables, once the results that read them are written."""
    delete(spark, *list(_folders))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the rows that go to a Python worker at a time: texts are long, and the default counts rows, not bytes."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a stored table by key to tasks of about ``rows`` rows where the session's partitions would have more; its rows are counted from metadata."""
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > partitions(df.sparkSession) else df


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to be none of ``columns`` (whose case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
