"""Operators along the samples of a series, as native windows; least distances by a scan over blocks (rows W1, W8-W18, F6, P16)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import along, keys_of, per_series, whole
from . import blocks


def moving_average(signals: DataFrame, width: int = 5) -> DataFrame:
    """Centred mean of ``width`` samples; NULL where the window is cut or misses a value.

    Series shorter than the window stay as they are.
    """
    ahead = width // 2
    frame = along(signals).rowsBetween(-(width - 1 - ahead), ahead)
    mean = F.when(F.count("value").over(frame) == width, F.avg("value").over(frame))
    return signals.withColumn("value", F.when(F.count("*").over(whole(signals)) < width, F.col("value")).otherwise(mean))


def _shrinking(signals: DataFrame, width: int):
    return along(signals).rowsBetween(-(width // 2), width // 2)


def moving_rms(signals: DataFrame, width: int) -> DataFrame:
    """Root mean square over a centred window that shrinks at the edges."""
    return signals.withColumn("value", F.sqrt(F.avg(F.col("value") * F.col("value")).over(_shrinking(signals, width))))


def moving_mav(signals: DataFrame, width: int) -> DataFrame:
    """Mean absolute value over a centred window that shrinks at the edges."""
    return signals.withColumn("value", F.avg(F.abs("value")).over(_shrinking(signals, width)))


def teager_kaiser(signals: DataFrame) -> DataFrame:
    """x[i]^2 - x[i-1] x[i+1], 0 at both ends."""
    w = along(signals)
    energy = F.col("value") * F.col("value") - F.lag("value").over(w) * F.lead("value").over(w)
    ends = F.lag("sample").over(w).isNull() | F.lead("sample").over(w).isNull()
    return signals.withColumn("value", F.when(ends, F.lit(0.0)).otherwise(energy))


def gradient(signals: DataFrame) -> DataFrame:
    """Difference from the sample before; NULL for the first."""
    return signals.withColumn("value", F.col("value") - F.lag("value").over(along(signals)))


def zscore(signals: DataFrame) -> DataFrame:
    """By the population standard deviation; 1 where that is 0."""
    w = whole(signals)
    spread = F.coalesce(F.nullif(F.stddev_pop("value").over(w), F.lit(0.0)), F.lit(1.0))
    return signals.withColumn("value", (F.col("value") - F.avg("value").over(w)) / spread)


def detrend(signals: DataFrame, kind: str = "linear") -> DataFrame:
    """remove the mean, or the least-squares line over the sample index.

    The few sums a series needs are aggregated and joined back.
    """
    keys = keys_of(signals)
    if kind == "constant":
        return signals.withColumn("value", F.col("value") - F.avg("value").over(whole(signals)))
    if kind != "linear":
        raise ValueError("kind must be constant or linear")
    fit = signals.groupBy(*keys).agg(F.regr_slope("value", "sample").alias("slope"), F.regr_intercept("value", "sample").alias("offset"))
    line = F.col("offset") + F.col("slope") * F.col("sample")
    return signals.join(fit, keys).withColumn("value", F.col("value") - line).select(*signals.columns)


def stride(signals: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample from the first, renumbered; no filter."""
    kept = signals.filter((F.col("sample") - 1) % factor == 0)
    return kept.withColumn("sample", F.floor((F.col("sample") - 1) / factor).cast("long") + 1)


def accepted(spots: np.ndarray, distance: int, free: int = 0) -> np.ndarray:
    """Of ascending positions, the first from ``free`` on, then always the next one at least ``distance`` later."""
    kept, at = [], int(np.searchsorted(spots, free))
    while at < spots.size:
        kept.append(spots[at])
        at = int(np.searchsorted(spots, spots[at] + distance))
    return np.asarray(kept, np.int64)


def _exits(spots: np.ndarray, first: int, distance: int) -> dict[str, np.ndarray]:
    """What a block does to the first free position: one exit for each spot that may be the first accepted one.

    The position before was accepted ahead of the block, so nothing is free later than ``first + distance - 1``.
    """
    following = np.searchsorted(spots, spots + distance)
    exits = np.append(spots + distance, blocks.UNCHANGED)
    for i in range(spots.size - 1, -1, -1):
        if following[i] < spots.size:
            exits[i] = exits[following[i]]
    reached = int(np.searchsorted(spots, first + distance - 1))
    return {"bounds": spots[:reached], "exits": exits[: reached + 1]}


def spaced(signals: DataFrame, flag: Callable[[np.ndarray], np.ndarray], distance: int, more: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None, out: str = "value double") -> DataFrame:
    """Flagged samples kept in order with at least ``distance`` between them, with the columns ``out``.

    ``flag`` and the functions ``more`` (one for each column of ``out`` but value) see the values of a stretch and decide by a sample and its two neighbours; no end of a series is flagged.
    A long series is cut into blocks. Which samples a block accepts depends on one number, the first position that is free when it
    starts; each block is a step function of it, the functions are scanned, and the blocks then choose from their own start.
    """
    more = more or {}
    size = max(blocks.SAMPLES, distance)
    found = blocks.lengths(signals)

    def rows(x: np.ndarray, at: np.ndarray, base: int) -> dict[str, np.ndarray]:
        return {"sample": at + 1, "value": x[at - base]} | {c: fn(x)[at - base] for c, fn in more.items()}

    if found[1] < 2 * size:

        def pick(x: np.ndarray) -> dict[str, np.ndarray]:
            made = rows(x, accepted(np.flatnonzero(flag(x)), distance), 0)
            return {"at": made.pop("sample")} | made

        return per_series(signals, pick, f"at long, {out}").drop("sample").withColumnRenamed("at", "sample")

    cut = blocks.cut(signals, found, size, 1)
    grid = cut.grid

    def spots(row) -> tuple[np.ndarray, np.ndarray, int]:
        x = np.array(row["values"], np.float64)
        first, end = grid.own(row["block"], row["n"])
        at = np.flatnonzero(flag(x)) + row["at"]
        return x, at[(at >= first) & (at < end)], first

    def summary(row) -> dict:
        _, at, first = spots(row)
        return {k: v.tolist() for k, v in _exits(at, first, distance).items()}

    def choose(row) -> dict[str, np.ndarray]:
        x, at, _ = spots(row)
        return rows(x, accepted(at, distance, row["state"]), row["at"])

    steps = blocks.each(cut.table, summary, [*cut.keys, "block"], "bounds array<long>, exits array<long>")
    states = blocks.stepped(steps, cut.keys, grid.last(found[1]) + 1)
    return blocks.spread(blocks.meet(cut.table, states, [*cut.keys, "block"]), choose, cut.keys, f"sample long, {out}")


def peaks(signals: DataFrame, threshold: float = 0.0, min_distance: int = 1) -> DataFrame:
    """Samples above both neighbours and ``threshold``, kept in order with ``min_distance`` between them."""
    if min_distance <= 1:
        w = along(signals)
        return signals.withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w)).filter("value > a AND value > b").filter(F.col("value") > threshold).drop("a", "b")

    def top(x: np.ndarray) -> np.ndarray:
        flags = np.zeros(x.size, bool)
        flags[1:-1] = (x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & (x[1:-1] > threshold)
        return flags

    return spaced(signals, top, min_distance)


def crossings(signals: DataFrame, threshold: float, direction: str = "rising", min_distance: int = 1) -> DataFrame:
    """Samples at which the series crosses ``threshold``, with rising (boolean)."""
    w = along(signals)
    rows = signals.withColumn("before", F.lag("value").over(w))
    up = (F.col("before") < threshold) & (F.col("value") >= threshold)
    down = (F.col("before") >= threshold) & (F.col("value") < threshold)
    wanted = {"rising": up, "falling": down, "both": up | down}[direction]
    if min_distance <= 1:
        return rows.filter(wanted).withColumn("rising", up).drop("before")

    def rise(x: np.ndarray) -> np.ndarray:
        return np.append(False, (x[:-1] < threshold) & (x[1:] >= threshold))

    def fall(x: np.ndarray) -> np.ndarray:
        return np.append(False, (x[:-1] >= threshold) & (x[1:] < threshold))

    flag = {"rising": rise, "falling": fall, "both": lambda x: rise(x) | fall(x)}[direction]
    return spaced(signals, flag, min_distance, {"rising": rise}, "value double, rising boolean")


def islands(rows: DataFrame, flag: Column, gap: int = 1) -> DataFrame:
    """Stretches of flagged samples; gaps of up to ``gap`` samples are bridged.

    Per stretch: start, end, extent (flagged samples), sum_abs, peak (largest absolute value).
    """
    keys = keys_of(rows)
    order = Window.partitionBy(*keys).orderBy("sample")
    hits = rows.filter(flag).withColumn("new", (F.col("sample") - F.lag("sample").over(order) > gap).cast("int"))
    hits = hits.withColumn("island", F.sum(F.coalesce("new", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return hits.groupBy(*keys, "island").agg(
        F.min("sample").alias("start"), F.max("sample").alias("end"), F.count("*").alias("extent"),
        F.sum(F.abs("value")).alias("sum_abs"), F.max(F.abs("value")).alias("peak"),
    ).drop("island")


def segments_between(signals: DataFrame, starts: DataFrame) -> DataFrame:
    """Cut at the samples ``starts`` (sample): segment k holds the samples from the k-th to the next, both included."""
    order = Window.orderBy("first")
    cuts = starts.select(F.col("sample").alias("first")).withColumn("last", F.lead("first").over(order)).withColumn("segment", F.row_number().over(order)).filter("last IS NOT NULL")
    spots = cuts.select("segment", F.explode(F.sequence("first", "last")).alias("sample"))
    return signals.join(spots, "sample").select(*keys_of(signals), "segment", "sample", "value")


def adjust_p(rows: DataFrame, p: str = "p", method: str = "BH", by: list[str] | None = None) -> DataFrame:
    """Adjusted p-values in p_adjusted; NULL p-values don't count."""
    keys = by or []
    known = F.col(p).isNotNull()
    group = Window.partitionBy(*keys, known)
    n = F.count("*").over(group)
    tie = [c for c in rows.columns if c != p]
    up = Window.partitionBy(*keys, known).orderBy(F.col(p), *tie)
    rank = F.row_number().over(up)
    rows = rows.withColumn("n_", n).withColumn("rank_", rank)
    if method == "bonferroni":
        found = F.least(F.lit(1.0), F.col(p) * F.col("n_"))
    elif method == "BH":
        found = F.least(F.lit(1.0), F.min(F.col(p) * F.col("n_") / F.col("rank_")).over(Window.partitionBy(*keys, known).orderBy(F.desc("rank_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    elif method == "holm":
        found = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("n_") - F.col("rank_") + 1)).over(Window.partitionBy(*keys, known).orderBy("rank_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        raise ValueError("method must be BH, holm or bonferroni")
    return rows.withColumn("p_adjusted", F.when(known, found)).drop("n_", "rank_")


def significant_windows(rows: DataFrame, alpha: float = 0.05, min_duration: float = 0.0, rate: float = 1.0) -> DataFrame:
    """Runs of samples with p below ``alpha`` that last ``min_duration`` seconds: start, end, min_p."""
    keys = [c for c in rows.columns if c not in ("sample", "p")]
    order = Window.partitionBy(*keys).orderBy("sample")
    hits = rows.filter(F.col("p") < alpha).withColumn("island", F.col("sample") - F.row_number().over(order))
    found = hits.groupBy(*keys, "island").agg(F.min("sample").alias("start"), F.max("sample").alias("end"), F.min("p").alias("min_p")).drop("island")
    return found.filter((F.col("end") - F.col("start")) / rate >= min_duration)


