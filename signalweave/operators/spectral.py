"""Spectra and time-frequency transforms (rows T1-T11, V6).

Samples are gathered natively into overlapping segments, one array each; numpy transforms
Arrow batches of these arrays, and sums over them are native again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import along, keys_of, per_series
from . import fourier
from .blocks import convolve, in_one_block, lengths, with_halo

#: Frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0)}


def window_values(kind: str, n: int) -> np.ndarray:
    """Symmetric window of n points."""
    t = np.linspace(0, 1, n)
    table = {
        "hann": lambda: 0.5 - 0.5 * np.cos(2 * np.pi * t),
        "hamming": lambda: 0.54 - 0.46 * np.cos(2 * np.pi * t),
        "blackman": lambda: 0.42 - 0.5 * np.cos(2 * np.pi * t) + 0.08 * np.cos(4 * np.pi * t),
        "rect": lambda: np.ones(n),
    }
    if kind not in table:
        raise ValueError(f"window must be one of {sorted(table)}")
    return table[kind]()


def segments(signals: DataFrame, size: int, step: int) -> DataFrame:
    """keys, segment (from 0), values: full segments of ``size`` samples every ``step``."""
    keys = keys_of(signals)
    rows = signals.withColumn("n", F.max("sample").over(Window.partitionBy(*keys)))
    at = F.col("sample") - 1
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / F.lit(step))).cast("long")
    last = F.least(F.floor(at / F.lit(step)), F.floor((F.col("n") - size) / F.lit(step))).cast("long")
    rows = rows.withColumn("segment", F.explode(F.when(first <= last, F.sequence(first, last))))
    ordered = F.array_sort(F.collect_list(F.struct("sample", "value")))
    return rows.groupBy(*keys, "segment").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def transform_segments(values: Column, weights: np.ndarray) -> Column:
    """Array of (re, im) of the one-sided FFT of weighted arrays of one length."""

    @F.pandas_udf("re array<double>, im array<double>")
    def fft(values: pd.Series) -> pd.DataFrame:
        if not len(values):
            return pd.DataFrame({"re": [], "im": []})
        found = np.fft.rfft(np.stack([np.asarray(v, float) for v in values]) * weights, axis=1)
        return pd.DataFrame({"re": list(found.real), "im": list(found.imag)})

    return fft(values)


def segment_spectra(signals: DataFrame, size: int, step: int, window: str = "hann") -> DataFrame:
    """keys, segment, bin (from 0), re, im of each segment's windowed FFT."""
    parts = segments(signals, size, step)
    keys = [c for c in parts.columns if c != "values"]
    found = parts.select(*keys, transform_segments(F.col("values"), window_values(window, size)).alias("f"))
    return found.select(*keys, F.posexplode(F.arrays_zip("f.re", "f.im")).alias("bin", "c")).select(*keys, "bin", F.col("c.re").alias("re"), F.col("c.im").alias("im"))


def fft_magnitude(signals: DataFrame) -> DataFrame:
    """Absolute FFT of each whole series; the sample is the bin from 1."""
    if in_one_block(found := lengths(signals)):
        return per_series(signals, lambda x: np.abs(np.fft.fft(x)))
    return fourier.spectrum(signals, lambda k, x, n: {"sample": k + 1, "value": np.abs(x)}, "sample long, value double", known=found)


def _density(size: int, rate: float, window: str) -> Column:
    scale = rate * float(np.sum(window_values(window, size) ** 2))
    double = F.when((F.col("bin") == 0) | (F.col("bin") == size // 2), 1.0).otherwise(2.0)
    return (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * double / F.lit(scale)


def spectrogram(signals: DataFrame, rate: float, size: int = 256, overlap: float = 0.5, window: str = "hann") -> DataFrame:
    """Keys, time, frequency, power of each segment; inner bins are doubled."""
    step = max(1, int(size * (1 - overlap)))
    rows = segment_spectra(signals, size, step, window)
    start = F.col("segment") * step + 1
    keys = [c for c in rows.columns if c not in ("segment", "bin", "re", "im")]
    return rows.select(*keys, "segment", ((start + start + size - 1) / 2.0 / rate).alias("time"), (F.col("bin") * (rate / size)).alias("frequency"), _density(size, rate, window).alias("power"))


def welch(signals: DataFrame, rate: float, size: int = 256, window: str = "hann") -> DataFrame:
    """T5: power per frequency, averaged over half-overlapping segments."""
    rows = segment_spectra(signals, size, size // 2, window)
    keys = [c for c in rows.columns if c not in ("segment", "bin", "re", "im")]
    return rows.groupBy(*keys, "bin").agg(F.avg(_density(size, rate, window)).alias("power")).select(*keys, (F.col("bin") * (rate / size)).alias("frequency"), "power")


def band_power(signals: DataFrame, rate: float, bands: dict[str, tuple[float, float]] | None = None, size: int = 256, relative: bool = False) -> DataFrame:
    """Welch power summed over each band, edges included on both sides; ``relative`` to the sum over bands."""
    psd = welch(signals, rate, size)
    keys = [c for c in psd.columns if c not in ("frequency", "power")]
    names = bands or BANDS
    hits = F.array(*[F.when(F.col("frequency").between(*edges), F.lit(name)) for name, edges in names.items()])
    found = psd.withColumn("band", F.explode(F.array_compact(hits))).groupBy(*keys, "band").agg(F.sum("power").alias("power"))
    if relative:
        found = found.withColumn("power", F.try_divide(F.col("power"), F.sum("power").over(Window.partitionBy(*keys))))
    return found


def morlet(frequency: float, rate: float, cycles: float = 7.0, norm: str = "L2") -> np.ndarray:
    """Complex Morlet wavelet over six standard deviations on each side."""
    sigma = cycles / (2 * np.pi * frequency)
    half = int(np.ceil(6 * sigma * rate))
    t = np.arange(-half, half + 1) / rate
    wave = np.exp(2j * np.pi * frequency * t) * np.exp(-(t**2) / (2 * sigma**2))
    return wave / (np.sum(np.abs(wave)) if norm == "L1" else np.sqrt(np.sum(np.abs(wave) ** 2)))


def same_convolution(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    size = 1 << (x.size + kernel.size - 2).bit_length()
    full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(kernel, size))
    return full[(kernel.size - 1) // 2 :][: x.size]


def wavelet(signals: DataFrame, rate: float, frequencies: list[float], cycles: float = 7.0, norm: str = "L2") -> DataFrame:
    """T4: keys, sample, frequency, power, phase of the Morlet transform."""
    waves = [morlet(f, rate, cycles, norm) for f in frequencies]

    def run(x: np.ndarray) -> dict:
        found = [same_convolution(x, w) for w in waves]
        return {"at": np.tile(np.arange(1, x.size + 1), len(waves)), "frequency": np.repeat(np.array(frequencies, float), x.size), "power": np.abs(np.concatenate(found)) ** 2, "phase": np.angle(np.concatenate(found))}

    def part(x: np.ndarray, first: bool, last: bool, start: int, stop: int) -> dict:
        found = np.concatenate([convolve(x, w)[start + (w.size - 1) // 2 : stop + (w.size - 1) // 2] for w in waves])
        return {"at": np.tile(np.arange(1, stop - start + 1), len(waves)), "frequency": np.repeat(np.array(frequencies, float), stop - start), "power": np.abs(found) ** 2, "phase": np.angle(found)}

    reach = max((w.size // 2 for w in waves), default=0)
    return with_halo(signals, reach, run, part, "at long, frequency double, power double, phase double", spreads=True).drop("sample").withColumnRenamed("at", "sample")


def wavelet_band_power(signals: DataFrame, rate: float, bands: dict[str, tuple[float, float]] | None = None, steps: int = 5) -> DataFrame:
    """T6 by wavelet: mean power over samples and frequencies of each band."""
    names = {k: (lo, min(hi, rate / 2 * 0.99)) for k, (lo, hi) in (bands or BANDS).items() if lo < rate / 2}
    frequencies = {k: np.linspace(*v, steps).tolist() for k, v in names.items()}
    rows = wavelet(signals, rate, sorted({f for v in frequencies.values() for f in v}))
    hits = F.array(*[F.when(F.col("frequency").isin(*v), F.lit(k)) for k, v in frequencies.items()])
    return rows.withColumn("band", F.explode(F.array_compact(hits))).groupBy(*[c for c in keys_of(signals)], "band").agg(F.avg("power").alias("power"))


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the FFT; even and odd lengths."""
    n = x.size
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def hilbert(signals: DataFrame) -> DataFrame:
    """Keys, sample, re, im of the analytic signal."""

    def run(x: np.ndarray) -> dict:
        z = analytic(x)
        return {"re": z.real, "im": z.imag}

    if in_one_block(found := lengths(signals)):
        return per_series(signals, run, "re double, im double")
    return fourier.analytic_signal(signals, found)


def amplitude(complex_signals: DataFrame) -> DataFrame:
    """T8."""
    return complex_signals.withColumn("value", F.hypot("re", "im")).drop("re", "im")


def phase(complex_signals: DataFrame) -> DataFrame:
    """T8."""
    return complex_signals.withColumn("value", F.atan2("im", "re")).drop("re", "im")


def periodogram(signals: DataFrame, rate: float) -> DataFrame:
    """|X|^2 / n over the first half of the bins: keys, frequency, power."""

    def run(x: np.ndarray) -> dict:
        half = max(1, x.size // 2)
        return {"frequency": np.arange(half) * rate / x.size, "power": np.abs(np.fft.fft(x)[:half]) ** 2 / x.size}

    def visit(k: np.ndarray, x: np.ndarray, n: int) -> dict:
        low = k < max(1, n // 2)
        return {"frequency": k[low] * rate / n, "power": np.abs(x[low]) ** 2 / n}

    if in_one_block(found := lengths(signals)):
        return per_series(signals, run, "frequency double, power double").drop("sample")
    return fourier.spectrum(signals, visit, "frequency double, power double", known=found)


def in_decibels(power: Column) -> Column:
    """V6, T10."""
    return 10 * F.log10(power + 1e-10)


def first_window_psd(signals: DataFrame, rate: float, size: int = 256) -> DataFrame:
    """Spectrum in dB of the first window, padded with zeros: keys, frequency, power."""

    def run(x: np.ndarray) -> dict:
        part = x[:size]
        padded = np.zeros(size)
        padded[: part.size] = part * window_values("hann", part.size)
        found = np.abs(np.fft.rfft(padded)[: size // 2]) ** 2 / size
        return {"frequency": np.arange(size // 2) * rate / size, "power": 10 * np.log10(found + 1e-10)}

    return per_series(signals, run, "frequency double, power double").drop("sample")


def derivative_pair(signals: DataFrame) -> DataFrame:
    """The browser code's stand-in for an analytic signal: half the difference of the neighbours, 0 at the ends."""
    w = along(signals)
    im = F.coalesce((F.lead("value").over(w) - F.lag("value").over(w)) / 2, F.lit(0.0))
    return signals.select(*keys_of(signals), "sample", F.col("value").alias("re"), im.alias("im"))
