"""Positions in a global order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.filesystem import scratch

#: Counts (one for each task and group that meet) up to which they are sent to all tasks; more are joined by a shuffle.
BROADCAST_COUNTS = 200_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(
    rows: DataFrame, order: Sequence[Column], by: Sequence[str] = (), place: str = "place", size: str | None = None,
    store: Callable[[DataFrame, str], DataFrame] = stored, parts: int | None = None,
) -> DataFrame:
    """Add ``place``, the 0-based position in the given order within the groups of the columns ``by`` (null is a group), and ``size``, the group's rows.

    The rows are dealt by ranges of (by, order) and sorted inside them; the sums over the ranges before
    give each range its first position. Groups and runs of ties of any size are spread over the ranges;
    rows that tie in all of ``order`` get neighbouring positions in any order. An empty table stays empty.
    """
    taken = {c.lower() for c in rows.columns}
    tie, part, at, first, before = (next(n for n in (base + "_" * k for k in range(len(taken) + 1)) if n not in taken) for base in ("_tie", "_part", "_at", "_first", "_before"))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*[F.col(c) for c in by], *order, F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(tie)
    dealt = store(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranges")
    counts = dealt.groupBy(part, *by).agg(F.count("*").alias("_n"), F.min(at).alias(first))
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    total = F.sum("_n").over(group)
    counts = counts.withColumn(before, F.coalesce(F.sum("_n").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = store(counts.withColumn("_total", total).drop("_n"), "offsets")
    few = counts.count() <= BROADCAST_COUNTS
    other = counts.select(F.col(part).alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], first, before, F.col("_total"))
    same = F.col(part) == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = dealt.join(F.broadcast(other) if few else other, same)
    found = [(F.col(at) - F.col(first) + F.col(before)).alias(place)] + ([F.col("_total").alias(size)] if size else [])
    return out.select(*rows.columns, *found)
