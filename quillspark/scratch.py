"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_roots: dict[str, str] = {}  # by application, where spark.checkpoint.dir is unset


def shared_root(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; below a temporary one only where that is unset and all runs in this one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_roots.get(app) or _own_roots.setdefault(app, tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return base.rstrip("/") + "/quillspark"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have what lies at a path, which is there already, deleted when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    delete_at_end(spark, path)
    return path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file to any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
