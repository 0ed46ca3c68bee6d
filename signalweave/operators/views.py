"""Tables behind plots (rows V1-V10, J5); drawing is left to the caller."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import keys_of
from .select import time_of


def trace(signals: DataFrame, rate: float | None, channel: str) -> DataFrame:
    """V1: time, amplitude of one channel."""
    return signals.filter(F.col("channel") == channel).select(time_of(F.col("sample"), rate).alias("time"), F.col("value").alias("amplitude"))


def stacked_traces(signals: DataFrame, rate: float | None, offset: float | None = None) -> DataFrame:
    """V2: channel, time, value, shifted: channels one above the other, 1.5 times the largest absolute value apart."""
    names = signals.select("channel").distinct()
    places = names.withColumn("place", F.row_number().over(Window.orderBy("channel"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    size = signals.agg(F.max(F.abs("value")).alias("top"))
    rows = signals.join(F.broadcast(places), "channel").join(F.broadcast(size))
    step = F.lit(float(offset)) if offset is not None else 1.5 * F.col("top")
    return rows.select("channel", time_of(F.col("sample"), rate).alias("time"), "value", (F.col("value") + (F.col("n") - F.col("place")) * step).alias("shifted"))


def topomap(values: DataFrame, positions: DataFrame, resolution: int = 64, radius: float = 1.0, power: float = 2.0) -> DataFrame:
    """X, y, value on a grid inside the head, by inverse distance from electrodes (channel, value; channel, pos_x, pos_y).

    A grid point on an electrode takes its value. Three electrodes are needed. The grid times the
    electrodes is small and fixed.
    """
    sites = values.join(positions, "channel").select("value", "pos_x", "pos_y").filter("value IS NOT NULL AND pos_x IS NOT NULL")
    if sites.count() < 3:
        raise ValueError("three electrodes with positions are needed")
    at = lambda c: F.lit(-radius) + F.col(c) * F.lit(2 * radius / (resolution - 1))
    grid = values.sparkSession.range(resolution).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
    grid = grid.select("i", "j", at("i").alias("x"), at("j").alias("y")).filter(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= radius * radius)
    rows = grid.join(F.broadcast(sites))
    distance = F.sqrt((F.col("x") - F.col("pos_x")) ** 2 + (F.col("y") - F.col("pos_y")) ** 2)
    weight = F.pow(F.greatest(distance, F.lit(1e-12)), F.lit(-power))
    found = rows.withColumn("d", distance).groupBy("i", "j", "x", "y").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("mean"), F.min_by("value", "d").alias("nearest"), F.min("d").alias("d"))
    return found.select("x", "y", F.when(F.col("d") < 1e-10, F.col("nearest")).otherwise(F.col("mean")).alias("value"))


def topomap_series(signals: DataFrame, positions: DataFrame, rate: float, times: list[float], **options) -> DataFrame:
    """V5: a topomap per time."""
    out = None
    for t in times:
        values = signals.filter(F.col("sample") == round(t * rate) + 1).groupBy("channel").agg(F.avg("value").alias("value"))
        one = topomap(values, positions, **options).withColumn("time", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out


def layout(nodes: list, kind: str = "circle", edges: list[tuple] | None = None, seed: int = 42, rounds: int = 50) -> pd.DataFrame:
    """V7: node, x, y on a circle, a grid, or by springs."""
    n = len(nodes)
    if kind == "grid":
        width = math.ceil(math.sqrt(n))
        return pd.DataFrame({"node": nodes, "x": [float(i % width) for i in range(n)], "y": [float(-(i // width)) for i in range(n)]})
    turn = 2 * np.pi * np.arange(n) / max(n, 1)
    at = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    if kind == "spring":
        place = {v: i for i, v in enumerate(nodes)}
        pull = np.zeros((n, n))
        for a, b, w in edges or []:
            pull[place[a], place[b]] = pull[place[b], place[a]] = abs(w)
        at = np.random.default_rng(seed).normal(size=(n, 2))
        ideal = 1 / math.sqrt(max(n, 1))
        for step in range(rounds):
            gap = at[:, None] - at[None]
            size = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
            force = (gap / size[..., None] * (ideal**2 / size - pull * size**2 / ideal)[..., None]).sum(axis=1)
            length = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
            at = at + force / length * np.minimum(length, 0.1 * (1 - step / rounds))
    elif kind != "circle":
        raise ValueError("kind must be circle, grid or spring")
    return pd.DataFrame({"node": nodes, "x": at[:, 0], "y": at[:, 1]})


def network_view(network: DataFrame, metric: DataFrame, column: str, kind: str = "circle", threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """V7: nodes (node, x, y, size from 3 to 10 by a metric) and edges (src, dst, weight above ``threshold``)."""
    spark = network.sparkSession
    nodes = [r[0] for r in network.select("src").distinct().orderBy("src").collect()]
    once = network.filter((F.col("src") < F.col("dst")) & (F.abs("weight") > threshold))
    edges = [(r[0], r[1], r[2]) for r in once.select("src", "dst", "weight").collect()] if kind == "spring" else None
    places = spark.createDataFrame(layout(nodes, kind, edges))
    w = Window.partitionBy()
    share = F.coalesce(F.try_divide(F.col(column) - F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)), F.lit(0.5))
    return places.join(metric.select("node", (3 + 7 * share).alias("size")), "node", "left"), once


def mean_connectivity(dynamic: DataFrame, pair: tuple | None = None) -> DataFrame:
    """V9: window, value: mean over pairs, or one pair."""
    if pair:
        dynamic = dynamic.filter((F.col("a") == min(pair)) & (F.col("b") == max(pair)))
    return dynamic.groupBy("window").agg(F.avg("value").alias("value"))


def percent_axis(curve: DataFrame) -> DataFrame:
    """The curve with percent, 0 at its first and 100 at its last sample."""
    keys = [c for c in keys_of(curve) if c in ("rec", "channel")]
    w = Window.partitionBy(*keys)
    return curve.withColumn("percent", F.coalesce(100 * F.try_divide((F.col("sample") - F.min("sample").over(w)).cast("double"), (F.max("sample").over(w) - F.min("sample").over(w)).cast("double")), F.lit(0.0)))
