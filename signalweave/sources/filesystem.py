"""Small files through Spark's file systems, so that sinks reach any store that Spark can write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _place(path: str, spark: SparkSession | None = None):
    spark = spark or SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Create or replace one file."""
    system, where = _place(path, spark)
    out = system.create(where, True)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def exists(path: str, spark: SparkSession | None = None) -> bool:
    system, where = _place(path, spark)
    return system.exists(where)


def folders(path: str, spark: SparkSession | None = None) -> list[str]:
    """Names of the folders in a folder, sorted; none where it does not exist."""
    system, where = _place(path, spark)
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()) if system.exists(where) else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``), or, in a local session without one, on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="signalweave-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
