"""Event tables (rows E1-E7) and pairing of start and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EVENTS_SCHEMA


def make_events(spark: SparkSession, onset: list[float], duration=0.0, type="event", value="") -> DataFrame:  # noqa: A002
    """Events sorted by onset; single values are repeated for all."""
    n = len(onset)
    wide = [x if isinstance(x, (list, tuple)) else [x] * n for x in (duration, type, value)]
    if any(len(x) != n for x in wide):
        raise ValueError("onset, duration, type and value differ in length")
    return spark.createDataFrame(list(zip(map(float, onset), map(float, wide[0]), *wide[1:], strict=True)), EVENTS_SCHEMA).orderBy("onset")


def get_events(events: DataFrame, *types: str) -> DataFrame:
    """Events of the given types, or all."""
    return events.filter(F.col("type").isin(*types)) if types else events


def with_defaults(events: DataFrame) -> DataFrame:
    """Any table with onset as events; absent columns take their defaults."""
    if "onset" not in events.columns:
        raise ValueError("events need an onset column")
    default = {"duration": F.lit(0.0), "type": F.lit("event"), "value": F.lit("")}
    for name, value in default.items():
        events = events if name in events.columns else events.withColumn(name, value)
    return events.select(F.col("onset").cast("double"), F.col("duration").cast("double"), F.col("type").cast("string"), F.col("value").cast("string")).orderBy("onset")


def add_events(events: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables, sorted by onset."""
    return events.unionByName(more).orderBy("onset")


def remove_events(events: DataFrame, types: list[str] | None = None, indices: list[int] | None = None) -> DataFrame:
    """E5: without the given types and positions (from 1, by onset); with neither, no event stays."""
    if types is None and indices is None:
        return events.limit(0)
    kept = events
    if indices is not None:
        order = Window.orderBy("onset", *[c for c in events.columns if c != "onset"])
        kept = kept.withColumn("position", F.row_number().over(order)).filter(~F.col("position").isin(*indices)).drop("position")
    return kept.filter(~F.col("type").isin(*types)) if types else kept


def count_events(events: DataFrame) -> int:
    """E6."""
    return events.count()


class EventQuery:
    """A lazy chain of filters; Catalyst merges them into one predicate."""

    def __init__(self, events: DataFrame):
        self.events = events

    def type(self, *types: str) -> EventQuery:
        return EventQuery(self.events.filter(F.col("type").isin(*types)))

    def value(self, *values: str) -> EventQuery:
        return EventQuery(self.events.filter(F.col("value").isin(*values)))

    def resolve(self) -> DataFrame:
        return self.events


def pair_events(events: DataFrame, start: list[str] | str, end: str, by: list[str] | None = None, min_length: float | None = None) -> DataFrame:
    """Each start event with the onset of the next strictly later end event (end_onset).

    Starts without a later end, or nearer to it than ``min_length`` seconds, are dropped.
    ``by`` names the keys of a recording. Onsets are walked from behind with the least end
    seen so far, and the result joins back by onset.
    """
    starts = [start] if isinstance(start, str) else start
    # the next end at or after; those at the very onset don't count
    order = Window.partitionBy(*(by or [])).orderBy("onset")
    ends = F.when(F.col("type") == end, F.col("onset"))
    table = events.withColumn("group_onset", F.dense_rank().over(order)).withColumn("end_here", ends)
    per = table.groupBy(*(by or []), "group_onset").agg(F.max("end_here").alias("end_at"))
    behind = Window.partitionBy(*(by or [])).orderBy(F.desc("group_onset")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("end_onset", F.min("end_at").over(behind)).drop("end_at")
    found = table.join(per, [*(by or []), "group_onset"]).filter(F.col("type").isin(*starts) & F.col("end_onset").isNotNull()).drop("group_onset", "end_here")
    if min_length is not None:
        found = found.filter(F.col("end_onset") - F.col("onset") >= min_length)
    return found
