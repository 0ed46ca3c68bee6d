"""Connectivity between channels (rows C1-C9, J4).

Sums over samples of products of two channels are products of matrices of a block of samples (:func:`block_sums`), so
rows do not multiply by the number of pairs. Rank correlations and cross spectra pair channels by an equi-join
on sample, or on segment and frequency; ranks of long pairs are positions in a global order, and discordant samples are counted in strips of it. Only pairs a < b are computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed, stored
from ..model import corr, keys_of, per_series
from .blocks import in_one_block, kinds_of, lengths, meet
from .filters import apply_sections, band_limits, both_ways, butterworth
from .fourier import analytic_signal
from .spectral import analytic, segment_spectra


def pairs(signals: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Rows of channels a < b that agree on the columns ``on`` (nulls are equal): a, b, then each column twice (x_..., y_...)."""
    left = signals.select(*on, F.col("channel").alias("a"), *[F.col(c).alias(f"x_{c}") for c in columns])
    right = signals.select(*on, F.col("channel").alias("b"), *[F.col(c).alias(f"y_{c}") for c in columns])
    return meet(left, right, on).filter("a < b")


#: Samples of a block whose channels meet in one matrix.
BLOCK = 4096
#: Places of a strip of a permutation, at least; longer pairs have longer strips, so that the cells of all strips are no more than the samples.
SAMPLES = 1 << 14


def block_sums(signals: DataFrame, columns: list[str], measure: Callable[..., dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """keys, a, b and, for channels a < b, the sums ``names`` over all samples.

    ``measure`` gets a matrix (sample, channel) of each of ``columns``, NaN where missing, for one block of samples, and
    returns a matrix (channel, channel) of each sum.
    """
    keys = keys_of(signals, "channel")
    kinds = "".join(f"`{k}` {signals.schema[k].dataType.simpleString()}, " for k in keys)
    channel = signals.schema["channel"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        channels = sorted(frame["channel"].unique())
        column = frame["channel"].map({c: i for i, c in enumerate(channels)}).to_numpy()
        _, row = np.unique(frame["sample"].to_numpy(), return_inverse=True)
        tables = []
        for c in columns:
            x = np.full((row.max() + 1, len(channels)), np.nan)
            x[row, column] = frame[c].to_numpy(float)
            tables.append(x)
        i, j = np.triu_indices(len(channels), 1)
        found = {k: v[i, j].astype(float) for k, v in measure(*tables).items()}
        head = {k: [frame[k].iloc[0]] * i.size for k in keys}
        named = np.array(channels, object)
        return pd.DataFrame(head | {"a": pd.Series(named[i], dtype=object), "b": pd.Series(named[j], dtype=object)} | found)[[*keys, "a", "b", *names]]

    rows = signals.select(*keys, "channel", "sample", *columns)
    parts = rows.groupBy(*keys, F.floor((F.col("sample") - 1) / BLOCK)).applyInPandas(run, f"{kinds}a {channel}, b {channel}, {', '.join(f'{n} double' for n in names)}")
    return parts.groupBy(*keys, "a", "b").agg(*[F.sum(n).alias(n) for n in names])


def _moments(x: np.ndarray) -> dict[str, np.ndarray]:
    known = ~np.isnan(x)
    m = known.astype(float)
    with np.errstate(all="ignore"):
        level = np.nan_to_num(np.nansum(x, axis=0) / m.sum(axis=0))
        z = np.where(known, x - level, 0.0)  # near 0, so that squares keep their digits
        n, shift, squares = m.T @ m, z.T @ m, (z * z).T @ m
        sx = shift + n * level[:, None]
        share = lambda p, q: np.nan_to_num(p * q / n)
        inner = z.T @ z - share(shift, shift.T)
        own = squares - share(shift, shift)
    return {"n": n, "sx": sx, "sy": sx.T, "xy": inner + share(sx, sx.T), "xx": own + share(sx, sx), "yy": (own + share(sx, sx)).T}


def moments(signals: DataFrame) -> DataFrame:
    """keys, a, b, n, and the sums of deviations cxy, cxx and cyy over the samples that both channels have."""
    rows = block_sums(signals, ["value"], _moments, ["n", "sx", "sy", "xy", "xx", "yy"]).filter("n > 0")
    centred = lambda p, s, t: (F.col(p) - F.col(s) * F.col(t) / F.col("n")).alias(f"c{p}")
    return rows.select(*keys_of(signals, "channel"), "a", "b", "n", centred("xy", "sx", "sy"), centred("xx", "sx", "sx"), centred("yy", "sy", "sy"))


def mirror(edges: DataFrame, conjugate: bool = False) -> DataFrame:
    """Both directions of each edge; of a complex one the other direction is the conjugate."""
    other = edges.select(*[F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in edges.columns])
    if conjugate:
        other = other.withColumn("im", -F.col("im"))
    return edges.unionByName(other)


def correlation(signals: DataFrame, method: str = "pearson") -> DataFrame:
    """A, b, value over the samples that both channels have."""
    keys = keys_of(signals, "channel")
    if method == "pearson":
        value = F.try_divide(F.col("cxy"), F.sqrt(F.greatest(F.col("cxx"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("cyy"), F.lit(0.0))))
        return moments(signals).select(*keys, "a", "b", value.alias("value"))
    if method not in ("spearman", "kendall"):
        raise ValueError("method must be pearson, spearman or kendall")
    both = pairs(signals, [*keys, "sample"], ["value"]).filter("x_value IS NOT NULL AND y_value IS NOT NULL")
    on = [*keys, "a", "b"]
    found = lengths(signals)
    if not in_one_block(found):
        both = both.select(*on, F.col("x_value").alias("x"), F.col("y_value").alias("y"))
        return _spearman(both, on) if method == "spearman" else _kendall(both, on, found[1])
    if method == "spearman":
        group = Window.partitionBy(*on)
        for c in ("x_value", "y_value"):
            tie = Window.partitionBy(*on, c)
            both = both.withColumn(f"r_{c}", F.rank().over(group.orderBy(c)) + (F.count("*").over(tie) - 1) / 2.0)
        return both.groupBy(*on).agg(corr("r_x_value", "r_y_value").alias("value"))
    kinds = kinds_of(both, on)

    def tau(frame: pd.DataFrame) -> pd.DataFrame:
        found = kendall(frame["x_value"].to_numpy(float), frame["y_value"].to_numpy(float))
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in on} | {"value": [found]})

    return both.groupBy(*on).applyInPandas(tau, f"{kinds}, value double")


def _spearman(both: DataFrame, on: list[str]) -> DataFrame:
    """Correlation of mean ranks. Positions come from ranges of the order; the rows of a tie, which may fill many ranges, share the mean of theirs by one count for each value."""
    for c in ("x", "y"):
        rows = placed(both, [F.col(c)], on, "_place")
        # positions of a tie are consecutive, so their mean is that of the first and the last
        ties = rows.groupBy(*on, c).agg(((F.min("_place") + F.max("_place")) / 2.0).alias(f"r{c}"))
        both = meet(rows.drop("_place"), ties, [*on, c])
    return both.groupBy(*on).agg(corr("rx", "ry").alias("value"))


def _kendall(both: DataFrame, on: list[str], longest: int) -> DataFrame:
    """tau-b of pairs of any length.

    Places by (x, y) and by (y, place by x) make two samples discordant exactly where the orders differ, ties or not, so they are the inversions of a permutation.
    It is cut into strips of ``side`` places both ways. Two samples in one strip are counted where it is sorted, by x and by y, those of one cell only once; two that
    share no strip are counted from the numbers in the cells. A strip holds ``side`` rows whatever the ties, and there are at most as many cells as samples.
    """
    side = max(SAMPLES, math.isqrt(longest) + 1)
    rows = placed(both, [F.col("x"), F.col("y")], on, "px")
    rows = placed(rows, [F.col("y"), F.col("px")], on, "py")
    strip = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    rows = rows.select(*on, "px", "py", strip("px").alias("i"), strip("py").alias("j"))
    kinds = kinds_of(both, on)

    def upright(frame: pd.DataFrame) -> pd.DataFrame:
        """Cells of a strip of x, with all inversions of the strip in the first, less those inside cells."""
        frame = frame.sort_values("px")
        cells = [(j, len(c), inversions(c["py"].to_numpy())) for j, c in frame.groupby("j")]
        own = inversions(frame["py"].to_numpy()) - sum(c[2] for c in cells)
        head = {k: [frame[k].iloc[0]] * len(cells) for k in on}
        return pd.DataFrame(head | {"i": frame["i"].iloc[0], "j": [c[0] for c in cells], "n": [c[1] for c in cells], "turned": [own] + [0] * (len(cells) - 1)})

    def level(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in on} | {"turned": [inversions(frame.sort_values("px")["py"].to_numpy())]})

    cells = stored(rows.groupBy(*on, "i").applyInPandas(upright, f"{kinds}, i long, j long, n long, turned long"), "cells")
    levels = rows.groupBy(*on, "j").applyInPandas(level, f"{kinds}, turned long").groupBy(*on).agg(F.sum("turned").alias("along_y"))
    # Samples in strips of x before and in strips of y beyond, for each cell of the grid.
    most = cells.groupBy(*on).agg(F.max("i").alias("i"), F.max("j").alias("j"))
    grid = most.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), "i")).alias("i"), "j").select(*on, "i", F.explode(F.sequence(F.lit(0).cast("long"), "j")).alias("j"))
    full = meet(grid, cells.select(*on, "i", "j", "n"), [*on, "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*on, "j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.coalesce(F.sum("before").over(Window.partitionBy(*on, "i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = full.withColumn("before", before).withColumn("beyond", beyond).groupBy(*on).agg(F.sum(F.col("n") * F.col("beyond")).alias("apart"))
    upright_sums = cells.groupBy(*on).agg(F.sum("turned").alias("along_x"), F.sum("n").alias("n"))

    def tied(*columns: str) -> DataFrame:
        counts = both.groupBy(*on, *columns).agg(F.count("*").alias("c"))
        return counts.groupBy(*on).agg(F.sum(F.expr("c * (c - 1) div 2")).alias("tied_" + "".join(columns)))

    out = upright_sums
    for table in (levels, apart, tied("x"), tied("y"), tied("x", "y")):
        out = meet(out, table, on)
    every = F.expr("n * (n - 1) div 2")
    discordant = F.col("along_x") + F.col("along_y") + F.col("apart")
    difference = every - F.col("tied_x") - F.col("tied_y") + F.col("tied_xy") - 2 * discordant
    under = F.sqrt((every - F.col("tied_x")).cast("double") * (every - F.col("tied_y")).cast("double"))
    return out.select(*on, F.when(under > 0, difference / under).otherwise(F.lit(float("nan"))).alias("value"))


def inversions(values: np.ndarray) -> int:
    """Pairs of which the earlier is the larger one, by merging."""

    def merged(part: np.ndarray) -> tuple[np.ndarray, int]:
        if part.size < 2:
            return part, 0
        half = part.size // 2
        left, a = merged(part[:half])
        right, b = merged(part[half:])
        swaps = int((left.size - np.searchsorted(left, right, side="right")).sum())
        return np.sort(part, kind="stable"), a + b + swaps

    return merged(values)[1]


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b; the order of y within x is counted by merging, so time is n log n."""
    n = x.size
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ties = lambda v: int(sum(c * (c - 1) // 2 for c in np.unique(v, return_counts=True)[1].tolist()))
    all_pairs = n * (n - 1) // 2
    tied_x, tied_y = ties(x), ties(y)
    tied_both = int(sum(c * (c - 1) // 2 for c in np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].tolist())) if n else 0
    discordant = inversions(y)
    concordant = all_pairs - tied_x - tied_y + tied_both - discordant
    under = np.sqrt(float(all_pairs - tied_x) * float(all_pairs - tied_y))
    return (concordant - discordant) / under if under else float("nan")


def cross_spectrum(signals: DataFrame, rate: float, size: int = 256, overlap: int | None = None) -> DataFrame:
    """A, b, frequency, re, im of the mean of X_a conj(X_b) over segments, for a <= b."""
    step = size - (size // 2 if overlap is None else overlap)
    spectra = segment_spectra(signals, size, step)
    keys = keys_of(signals, "channel")
    on = [*keys, "segment", "bin"]
    left = spectra.select(*on, F.col("channel").alias("a"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    right = spectra.select(*on, F.col("channel").alias("b"), F.col("re").alias("br"), F.col("im").alias("bi"))
    both = left.join(right, on).filter("a <= b")
    found = both.groupBy(*keys, "a", "b", "bin").agg(F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), F.avg(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("im"))
    return found.select(*keys, "a", "b", (F.col("bin") * (rate / size)).alias("frequency"), "re", "im")


def coherence(signals: DataFrame, rate: float, size: int = 256, overlap: int | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """|S_ab|^2 / (S_aa S_bb) for a < b, per frequency; NULL where a power is 0."""
    spectra = cross_spectrum(signals, rate, size, overlap)
    if band:
        spectra = spectra.filter(F.col("frequency").between(*band))
    keys = keys_of(signals, "channel")
    own = spectra.filter("a = b").select(*keys, F.col("a").alias("c"), "frequency", F.col("re").alias("power"))
    out = spectra.filter("a < b")
    for side, name in (("a", "pa"), ("b", "pb")):
        out = out.join(own.withColumnsRenamed({"c": side, "power": name}), [*keys, side, "frequency"])
    value = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("pa") * F.col("pb"))
    return out.select(*keys, "a", "b", "frequency", value.alias("value"))


def band_phase(signals: DataFrame, rate: float, band: tuple[float, float]) -> DataFrame:
    """Analytic signal of the band-passed series, as re and im."""
    sections = butterworth(4, band_limits(rate, band), "pass")

    def run(x: np.ndarray) -> dict:
        z = analytic(both_ways(sections, x))
        return {"re": z.real, "im": z.imag}

    if in_one_block(lengths(signals)):
        return per_series(signals, run, "re double, im double")
    return analytic_signal(stored(apply_sections(signals, sections), "filtered"))


def _imaginary(re: np.ndarray, im: np.ndarray, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over samples of ``fn`` of the imaginary part of z_a conj(z_b), channel by channel."""
    return np.stack([np.nansum(fn(im[:, [k]] * re - re[:, [k]] * im), axis=0) for k in range(re.shape[1])])


def _both(re: np.ndarray) -> np.ndarray:
    known = (~np.isnan(re)).astype(float)
    return known.T @ known


def _locking(re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
    with np.errstate(all="ignore"):
        z = (re + 1j * im) / np.hypot(re, im)
    n = _both(z.real)
    product = np.nan_to_num(z).T @ np.nan_to_num(z).conj()
    return {"n": n, "re": product.real, "im": product.imag}


def plv(signals: DataFrame, rate: float, band: tuple[float, float]) -> DataFrame:
    """C4: length of the mean unit vector of the phase difference."""
    rows = block_sums(band_phase(signals, rate, band), ["re", "im"], _locking, ["n", "re", "im"])
    return rows.select(*keys_of(signals, "channel"), "a", "b", F.try_divide(F.hypot("re", "im"), F.col("n")).alias("value"))


def pli(signals: DataFrame, rate: float, band: tuple[float, float]) -> DataFrame:
    """Absolute mean sign of the phase difference."""
    rows = block_sums(band_phase(signals, rate, band), ["re", "im"], lambda re, im: {"n": _both(re), "s": _imaginary(re, im, np.sign)}, ["n", "s"])
    return rows.select(*keys_of(signals, "channel"), "a", "b", F.try_divide(F.abs("s"), F.col("n")).alias("value"))


def wpli(signals: DataFrame, rate: float, band: tuple[float, float]) -> DataFrame:
    """The phase difference's sign weighted by the imaginary part; NULL where that is 0 throughout."""
    rows = block_sums(band_phase(signals, rate, band), ["re", "im"], lambda re, im: {"s": _imaginary(re, im, lambda x: x), "t": _imaginary(re, im, np.abs)}, ["s", "t"])
    return rows.select(*keys_of(signals, "channel"), "a", "b", F.try_divide(F.abs("s"), F.col("t")).alias("value"))


def connectivity(signals: DataFrame, method: str, rate: float | None = None, band: tuple[float, float] | None = None, size: int = 256) -> DataFrame:
    """A, b, value by name; coherence is averaged over frequency."""
    if method in ("pearson", "spearman", "kendall", "correlation"):
        return correlation(signals, "pearson" if method == "correlation" else method)
    if rate is None:
        raise ValueError("a sampling rate is needed")
    if method == "coherence":
        return coherence(signals, rate, size, band=band).groupBy(*keys_of(signals, "channel"), "a", "b").agg(F.avg("value").alias("value"))
    if band is None:
        raise ValueError(f"{method} needs a frequency band")
    table = {"plv": plv, "pli": pli, "wpli": wpli}
    if method not in table:
        raise ValueError(f"unknown method {method!r}")
    return table[method](signals, rate, band)


def windowed(signals: DataFrame, size: int = 256, step: int = 64) -> DataFrame:
    """The signals with a key ``window`` (from 1) for each full sliding window a sample is in."""
    n = F.max("sample").over(Window.partitionBy(*keys_of(signals)))
    at = F.col("sample") - 1
    rows = signals.withColumn("n", n)
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / F.lit(step))).cast("long")
    last = F.least(F.floor(at / F.lit(step)), F.floor((F.col("n") - size) / F.lit(step))).cast("long")
    rows = rows.withColumn("window", F.explode(F.when(first <= last, F.sequence(first + 1, last + 1))))
    return rows.select("window", *keys_of(signals), (F.col("sample") - (F.col("window") - 1) * step).alias("sample"), "value")


def sliding_connectivity(signals: DataFrame, rate: float, size: int = 256, step: int = 64, method: str = "correlation", band: tuple[float, float] | None = None) -> DataFrame:
    """Window, time (its middle in seconds), a, b, value."""
    found = connectivity(windowed(signals, size, step), method, rate, band, max(8, size // 4))
    start = (F.col("window") - 1) * step + 1
    return found.withColumn("time", (start + start + size - 2) / 2.0 / rate)


def temporal_stability(dynamic: DataFrame, metric: str = "correlation") -> DataFrame:
    """Per window, how alike its edges are to those of the next: correlation, or 1 - distance / edges."""
    following = dynamic.select((F.col("window") - 1).alias("window"), "a", "b", F.col("value").alias("next_value"))
    both = dynamic.join(following, ["window", "a", "b"])
    if metric == "correlation":
        value = corr("value", "next_value")
    elif metric == "distance":
        value = 1 - F.sqrt(F.sum((F.col("value") - F.col("next_value")) ** 2)) / F.count("*")
    else:
        raise ValueError("metric must be correlation or distance")
    return both.groupBy("window").agg(value.alias("stability"))


def full_matrix(edges: DataFrame, diagonal: float = 1.0) -> DataFrame:
    """A, b, value for every ordered pair of channels, ``diagonal`` for a channel with itself."""
    ends = edges.select(F.col("a").alias("c")).union(edges.select("b")).distinct()
    same = ends.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(float(diagonal)).alias("value"))
    return edges.select("a", "b", "value").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).union(same)
