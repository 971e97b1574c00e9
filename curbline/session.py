"""Shared storage and lineage helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="curbline-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    folder = f"{shared_dir(spark)}/curbline-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession) -> int:
    """Remove what this application stored with :func:`fresh_path` and :func:`cut`.

    For the end of a job, when no frame built on it is needed any more. Returns
    the number of folders.
    """
    folders = _written.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(folders)


def settle(spark: SparkSession) -> None:
    """Have the driver drop what finished steps left: plans, broadcast tables and, by Spark's cleaner, shuffle files.

    For the steps of a long chain of jobs; otherwise they stay until the driver's heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Store the frame as Parquet in the shared folder and read it back.

    Later branches then read the same rows, only the columns they need, with
    known sizes; a lost executor costs a read, not the work before it.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[stored] = path
    return stored


def discard(stored: DataFrame) -> None:
    """Remove the rows of a frame that :func:`cut` returned, for a step that needs neither it nor a frame built on it any more."""
    spark = stored.sparkSession
    folder = _stored.pop(stored).rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[spark.sparkContext.applicationId].remove(folder)
