"""Muscle activity operators (rows M1-M12)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import along, keys_of, per_series, ratio, whole
from .filters import butterworth_filter
from .sequence import islands, moving_mav, moving_rms, teager_kaiser
from .spectral import amplitude, hilbert, segment_spectra


def rectify(signals: DataFrame) -> DataFrame:
    """M1."""
    return signals.withColumn("value", F.abs("value"))


def envelope(signals: DataFrame, rate: float, cutoff: float = 6.0, method: str = "lowpass") -> DataFrame:
    """M2: by low-pass of the rectified signal, moving RMS over rate / cutoff samples, or the analytic amplitude."""
    if method == "lowpass":
        return butterworth_filter(rectify(signals), rate, high=cutoff)
    if method == "rms":
        return moving_rms(signals, max(1, int(rate // cutoff)))
    if method != "hilbert":
        raise ValueError("method must be lowpass, rms or hilbert")
    return amplitude(hilbert(signals))


def mvc(signals: DataFrame, width: int = 50, method: str = "max") -> DataFrame:
    """M3: keys, mvc: the largest windowed mean of the rectified signal, or its mean or median."""
    size = rectify(signals)
    if method == "max":
        size = moving_mav(size, width)
    value = {"max": F.max("value"), "mean": F.avg("value"), "median": F.median("value")}[method]
    return size.groupBy(*keys_of(signals)).agg(value.alias("mvc"))


def normalize(signals: DataFrame, width: int = 50, method: str = "max") -> DataFrame:
    """M3: in percent of the series' own MVC."""
    keys = keys_of(signals)
    out = signals.join(mvc(signals, width, method), keys)
    return out.withColumn("value", 100 * ratio(F.col("value"), F.col("mvc"))).select(*signals.columns)


def activation(signals: DataFrame, baseline: int = 100, k: float = 3.0, off_k: float | None = None, method: str = "single") -> DataFrame:
    """M4: the signals with ``on``: above mean + k sd of the first max(10 %, ``baseline``) samples.

    ``double`` switches off only at or below mean + off_k sd, ``tkeo`` looks at the Teager-Kaiser energy.
    """
    rows = rectify(teager_kaiser(signals)) if method == "tkeo" else signals
    w = whole(signals)
    n = F.count("*").over(w)
    rows = rows.withColumn("early", F.col("sample") <= F.greatest(F.floor(n / 10), F.lit(baseline)))
    early = F.when(F.col("early"), F.col("value"))
    rows = rows.withColumn("level", F.avg(early).over(w)).withColumn("spread", F.stddev_pop(early).over(w)).drop("early")
    high = F.col("value") > F.col("level") + k * F.col("spread")
    if method != "double":
        return rows.withColumn("on", high).drop("level", "spread")
    low = F.col("value") <= F.col("level") + (k / 2 if off_k is None else off_k) * F.col("spread")
    switch = F.when(high, F.lit(True)).when(low, F.lit(False))
    last = F.last(switch, ignorenulls=True).over(along(signals).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("on", F.coalesce(last, F.lit(False))).drop("level", "spread")


def bursts(signals: DataFrame, rate: float, min_duration: float = 0.05, **options) -> DataFrame:
    """M4: keys, start, end (samples) of activations that last ``min_duration`` seconds."""
    rows = activation(signals, **options)
    found = islands(rows.select(*signals.columns, F.col("on").cast("double").alias("re")), F.col("re") == 1)
    return found.filter((F.col("end") - F.col("start") + 1) / F.lit(float(rate)) >= min_duration).select(*keys_of(signals), "start", "end")


def cocontraction(signals: DataFrame, first: str, second: str, method: str = "overlap") -> DataFrame:
    """M5: sample, value: ratio (smaller over larger), overlap 2 min / (a + b), or wasted (smaller)."""
    both = signals.filter(F.col("channel").isin(first, second)).groupBy("sample").agg(F.max(F.when(F.col("channel") == first, F.abs("value"))).alias("a"), F.max(F.when(F.col("channel") == second, F.abs("value"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    value = {"ratio": ratio(low, high), "overlap": ratio(2 * low, F.col("a") + F.col("b")), "wasted": low}[method]
    return both.select("sample", F.coalesce(value, F.lit(0.0)).alias("value"))


def spectral_frequencies(signals: DataFrame, rate: float, size: int = 256, step: int | None = None) -> DataFrame:
    """M6: keys, segment, median_frequency, mean_frequency, peak_frequency of each segment."""
    rows = segment_spectra(signals, size, step or size // 2)
    keys = [c for c in rows.columns if c not in ("bin", "re", "im")]
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    rows = rows.withColumn("f", F.col("bin") * (rate / size)).withColumn("p", power)
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("p").over(order)).withColumn("all", F.sum("p").over(Window.partitionBy(*keys)))
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") >= F.col("all") / 2, F.col("f"))).alias("median_frequency"),
        ratio(F.sum(F.col("f") * F.col("p")), F.sum("p")).alias("mean_frequency"), F.max_by("f", "p").alias("peak_frequency"),
    )


def fatigue(frequencies: DataFrame, column: str = "median_frequency", method: str = "slope") -> DataFrame:
    """M7: keys, fatigue (in %): fall of the line over all segments, or of the last quarter, against the first value or quarter."""
    keys = [c for c in frequencies.columns if c not in ("segment", "median_frequency", "mean_frequency", "peak_frequency")]
    if method == "slope":
        found = frequencies.groupBy(*keys).agg(F.regr_slope(column, "segment").alias("slope"), F.count("*").alias("n"), F.min_by(column, "segment").alias("first"))
        return found.select(*keys, (100 * ratio(F.col("slope") * F.col("n"), F.col("first"))).alias("fatigue"))
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("segment"))
    quarter = F.greatest(F.floor(n / 4), F.lit(1))
    rows = frequencies.withColumn("early", place <= quarter).withColumn("late", place > n - quarter)
    found = rows.groupBy(*keys).agg(F.avg(F.when(F.col("early"), F.col(column))).alias("a"), F.avg(F.when(F.col("late"), F.col(column))).alias("b"))
    return found.select(*keys, (100 * ratio(F.col("a") - F.col("b"), F.col("a"))).alias("fatigue"))


def time_features(signals: DataFrame) -> DataFrame:
    """M8: mav, rms, wl, zc, ssc, iemg, var per series; zero crossings and slope changes must pass 0.01 of the mav."""
    w, keys = along(signals), keys_of(signals)
    rows = signals.withColumn("before", F.lag("value").over(w)).withColumn("after", F.lead("value").over(w)).withColumn("limit", 0.01 * F.avg(F.abs("value")).over(whole(signals)))
    step = F.abs(F.col("value") - F.col("before"))
    crossing = (F.col("value") * F.col("before") < 0) & (step >= F.col("limit"))
    a, b = F.col("value") - F.col("before"), F.col("value") - F.col("after")
    change = (a * b > 0) & ((F.abs(a) >= F.col("limit")) | (F.abs(b) >= F.col("limit")))
    return rows.groupBy(*keys).agg(
        F.avg(F.abs("value")).alias("mav"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.sum(step).alias("wl"),
        F.count_if(crossing).alias("zc"), F.count_if(change).alias("ssc"), F.sum(F.abs("value")).alias("iemg"), F.var_samp("value").alias("var"),
    )


def features(signals: DataFrame, rate: float, size: int = 256) -> DataFrame:
    """M8: time features with the mean over segments of mnf, mdf and pkf."""
    keys = keys_of(signals)
    spectral = spectral_frequencies(signals, rate, size).groupBy(*keys).agg(F.avg("mean_frequency").alias("mnf"), F.avg("median_frequency").alias("mdf"), F.avg("peak_frequency").alias("pkf"))
    return time_features(signals).join(spectral, keys, "left")


def activation_timing(signals: DataFrame, rate: float, **options) -> DataFrame:
    """M9: keys, n_bursts, mean_duration (s), duty (% of the recording)."""
    keys = keys_of(signals)
    found = bursts(signals, rate, **options).groupBy(*keys).agg(F.count("*").alias("n_bursts"), F.avg(F.col("end") - F.col("start") + 1).alias("mean_samples"), F.sum(F.col("end") - F.col("start") + 1).alias("active"))
    sizes = signals.groupBy(*keys).agg(F.count("*").alias("n"))
    out = sizes.join(found, keys, "left")
    return out.select(*keys, F.coalesce("n_bursts", F.lit(0)).alias("n_bursts"), (F.col("mean_samples") / F.lit(float(rate))).alias("mean_duration"), (100.0 * F.coalesce("active", F.lit(0)) / F.col("n")).alias("duty"))


def spectral_compression(frequencies: DataFrame, n: int = 5) -> DataFrame:
    """M9: median frequency of the first ``n`` segments over that of the last."""
    keys = [c for c in frequencies.columns if c not in ("segment", "median_frequency", "mean_frequency", "peak_frequency")]
    up, down = Window.partitionBy(*keys).orderBy("segment"), Window.partitionBy(*keys).orderBy(F.desc("segment"))
    rows = frequencies.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down))
    return rows.groupBy(*keys).agg(ratio(F.avg(F.when(F.col("i") <= n, F.col("median_frequency"))), F.avg(F.when(F.col("j") <= n, F.col("median_frequency")))).alias("compression"))


def spikes(signals: DataFrame, share: float = 0.3) -> DataFrame:
    """M9: samples that are local peaks of the Teager-Kaiser energy above a share of its largest value."""
    energy = teager_kaiser(signals)
    w = along(signals)
    rows = energy.withColumn("top", F.max("value").over(whole(signals))).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    return rows.filter((F.col("value") > share * F.col("top")) & (F.col("value") > F.col("a")) & (F.col("value") > F.col("b"))).drop("top", "a", "b")


def firing(signals: DataFrame, rate: float, share: float = 0.3) -> DataFrame:
    """M9: keys, n_spikes, firing_rate (Hz), interval_cv."""
    keys = keys_of(signals)
    found = spikes(signals, share).withColumn("gap", F.col("sample") - F.lag("sample").over(along(signals)))
    sums = found.groupBy(*keys).agg(F.count("*").alias("n_spikes"), ratio(F.stddev_samp("gap"), F.avg("gap")).alias("interval_cv"))
    sizes = signals.groupBy(*keys).agg(F.max("sample").alias("n"))
    return sizes.join(sums, keys, "left").select(*keys, F.coalesce("n_spikes", F.lit(0)).alias("n_spikes"), (F.coalesce("n_spikes", F.lit(0)) * float(rate) / F.col("n")).alias("firing_rate"), "interval_cv")


def spike_average(signals: DataFrame, rate: float, seconds: float = 0.005, share: float = 0.3) -> DataFrame:
    """M9: keys, offset (samples from a spike), value: the mean shape around spikes."""
    half = max(1, round(seconds * rate))
    keys = keys_of(signals)
    spots = spikes(signals, share).select(*keys, F.col("sample").alias("at")).withColumn("sample", F.explode(F.sequence(F.col("at") - half, F.col("at") + half)))
    return signals.join(spots, [*keys, "sample"]).groupBy(*keys, (F.col("sample") - F.col("at")).alias("offset")).agg(F.avg("value").alias("value"))


# ---------------------------------------------------------------- time warping
def warp(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Least summed absolute difference over monotone alignments, and the alignment; rows run as minima over diagonals."""
    n, m = x.size, y.size
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        cost[i, j] = np.abs(x[i - 1] - y[j - 1]) + np.minimum(np.minimum(cost[i - 1, j], cost[i, j - 1]), cost[i - 1, j - 1])
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i, j))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
    return float(cost[n, m]), path[::-1]


def warp_costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of :func:`warp` between each row of ``x`` and y; the rows share the walk over diagonals, of which three are kept."""
    n, m = x.shape[1], y.size
    x, y = np.ascontiguousarray(x.T), y[::-1, None]
    before, last = np.full((2, n + 1, x.shape[1]), np.inf)  # by i; the diagonals d - 2 and d - 1
    before[0] = 0
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1)
        now = np.full(before.shape, np.inf)
        least = np.minimum(np.minimum(last[low - 1 : high], last[low : high + 1]), before[low - 1 : high])
        now[low : high + 1] = np.abs(x[low - 1 : high] - y[m - d + low : m - d + high + 1]) + least
        before, last = last, now
    return last[n] if n + m > 1 else np.full(x.shape[1], 0.0 if n + m == 0 else np.inf)


#: Vectors that share a walk.
TOGETHER = 512


def warp_distances(vectors: DataFrame, references: DataFrame) -> DataFrame:
    """Id, reference, distance of each vector (id, values) to each of a few references; vectors of equal length are warped together."""
    table = [(r[0], np.asarray(r[1], float)) for r in references.select("id", "values").collect()]
    kind, other = (t.schema["id"].dataType.simpleString() for t in (vectors, references))

    def run(batches):
        for batch in batches:
            sizes = batch["values"].map(len).to_numpy()
            for size in np.unique(sizes):
                alike = batch[sizes == size]
                for at in range(0, len(alike), TOGETHER):
                    some = alike.iloc[at : at + TOGETHER]
                    x = np.stack([np.asarray(v, float) for v in some["values"]])
                    for k, ref in table:
                        yield pd.DataFrame({"id": some["id"].to_numpy(), "reference": [k] * len(x), "distance": warp_costs(x, ref)})

    return vectors.select("id", "values").mapInPandas(run, f"id {kind}, reference {other}, distance double")


def to_percent(signals: DataFrame, points: int = 101) -> DataFrame:
    """Each series at ``points`` evenly spaced places of its length."""
    return per_series(signals, lambda x: np.interp(np.linspace(0, x.size - 1, points), np.arange(x.size), x))


def classify_fatigue(index: Column) -> Column:
    """M9: a label for a fatigue index in percent."""
    size = F.abs(index)
    return F.when(size < 10, "none").when(size < 20, "mild").when(size < 30, "moderate").otherwise("severe")
