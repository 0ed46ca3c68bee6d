"""Structured Streaming forms of windowed operators (an extension; batch results agree on complete data).

A stream has ts (timestamp), channel and value, or ts, user keys and an event type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_average(stream: DataFrame, width: str = "10 seconds", step: str | None = None, late: str = "30 seconds", by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """W1, W12 over event time: n, mean and rms per window; rows later than ``late`` are dropped."""
    frame = F.window("ts", width, step) if step else F.window("ts", width)
    found = stream.withWatermark("ts", late).groupBy(frame, *by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean", "rms")


def artifact_sessions(stream: DataFrame, threshold: float, gap: str = "1 second", late: str = "30 seconds", by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """EP5, W8: stretches above ``threshold``; a pause of ``gap`` ends one."""
    hits = stream.withWatermark("ts", late).filter(F.abs("value") > threshold)
    found = hits.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("extent"), F.max(F.abs("value")).alias("peak"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "extent", "peak")


def label_samples(stream: DataFrame, channels: DataFrame) -> DataFrame:
    """Stream rows with the metadata of their channel (a stream-static join)."""
    return stream.join(F.broadcast(channels), "channel", "left")


def pair_starts(stream: DataFrame, start: str, end: str, by: str = "user_id", late: str = "30 seconds") -> DataFrame:
    """J2 on a stream: by key, each start with the next later end; open starts are kept as state."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, kind in zip(rows["ts"], rows["event_type"], strict=True):
            if kind == end:
                out += [(key[0], pd.Timestamp(t), ts) for t in waiting if pd.Timestamp(t) < ts]
                waiting = [t for t in waiting if pd.Timestamp(t) >= ts]
            if kind == start:
                waiting.append(ts.isoformat())
        state.update((waiting,))
        if out:
            yield pd.DataFrame(out, columns=[by, "start_ts", "end_ts"])

    kind = stream.schema[by].dataType.simpleString()
    return stream.withWatermark("ts", late).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, start_ts timestamp, end_ts timestamp", "waiting array<string>", "append", "NoTimeout")
