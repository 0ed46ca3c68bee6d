"""Helpers shared by the text operators: shared storage, hashing folds, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``: fixed values.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) a folder of this
    machine is made and remembered for the session.
    """
    conf = spark.conf
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="signalweave-")
        conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders by column ``by`` if given, and read it back.

    Cuts the lineage, so that the loss of an executor costs no more than a
    reread, and fixes what later passes see.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._signalweave_path = path
    _made.append(path)
    return out


#: Tables written by this process and not deleted yet.
_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are made inside, at its end: results that read them must be written by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def release(df: DataFrame, folder: str = "") -> None:
    """Delete a table made by :func:`materialize`, or a folder of it, that nothing reads any more.

    Spark removes shuffle files once the driver has collected what refers to them; with a folder, this asks it to.
    """
    path = getattr(df, "_signalweave_path", None)
    if path:
        _delete(df.sparkSession, f"{path}/{folder}" if folder else path)
        if folder:
            df.sparkSession._jvm.System.gc()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0).cast("bigint"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return freed memory to the system: all Python workers of an executor share its memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def worker_cache(owner: str) -> dict:
    """A dictionary of the operator ``owner`` that lives over all tasks that the Python worker does for it.

    Spark gives a worker to one operator after another. At the first call by another owner, what the last one kept goes.
    """
    import sys
    import types

    kept = sys.modules.setdefault("signalweave_worker_cache", types.ModuleType("signalweave_worker_cache")).__dict__
    if kept.get("owner") != owner:
        kept |= {"owner": owner, "held": {}}
        give_back()
    return kept["held"]


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to ``size`` bytes of text in its second column, or one row if that has more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end
