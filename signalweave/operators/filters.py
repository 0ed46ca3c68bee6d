"""Filters, resampling and re-referencing (rows F1-F5, F7-F12).

Filters work on blocks of a series. A recursive filter treats each block as an affine map of its state: blocks are summarised from
a zero state, a scan over the summaries gives each its state, and a second pass filters it from there, forward and then backward. FIR
filters get their neighbours' edges with each block. Coefficients are designed once on the driver. Referencing is a native window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import stored
from ..model import Recording, along, keys_of, per_series
from . import fourier
from .blocks import carried, convolve, cut, each, in_one_block, lengths, meet, spread, with_halo
from .sequence import stride

BLOCK = 256
#: Samples beyond a block whose influence on a spline is below 1e-36.
HALO = 64


# ---------------------------------------------------------------- design
def butterworth(order: int, edges: tuple[float, ...], kind: str) -> np.ndarray:
    """Second-order sections (rows b0 b1 b2 1 a1 a2) of a digital Butterworth filter.

    ``edges`` are shares of the Nyquist frequency, strictly between 0 and 1. The analog prototype's
    poles are moved to the warped edges and mapped by the bilinear transform.
    """
    if order < 1 or not all(0 < e < 1 for e in edges) or (len(edges) == 2 and edges[0] >= edges[1]):
        raise ValueError("edges must rise and lie between 0 and the Nyquist frequency")
    if (kind in ("low", "high")) != (len(edges) == 1) or kind not in ("low", "high", "pass", "stop"):
        raise ValueError("kind must be low or high with one edge, pass or stop with two")
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warped = 2 * np.tan(np.pi * np.array(edges) / 2)
    zeros: np.ndarray = np.zeros(0, complex)
    if kind == "low":
        poles = poles * warped[0]
    elif kind == "high":
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    else:
        width, middle = warped[1] - warped[0], warped[0] * warped[1]
        half = (poles if kind == "pass" else 1 / poles) * width / 2
        root = np.sqrt(half * half - middle + 0j)
        poles = np.concatenate((half + root, half - root))
        zeros = np.zeros(order, complex) if kind == "pass" else np.concatenate((np.full(order, 1j), np.full(order, -1j))) * np.sqrt(middle)
    digital_poles = (2 + poles) / (2 - poles)
    digital_zeros = np.concatenate(((2 + zeros) / (2 - zeros), -np.ones(poles.size - zeros.size)))
    sections = _pair(digital_zeros, digital_poles)
    # gain 1 where the filter should pass
    at = {"low": 0.0, "high": np.pi, "pass": 2 * np.arctan(np.sqrt(warped.prod()) / 2), "stop": 0.0}[kind]
    z = np.exp(-1j * at * np.arange(3))
    gain = np.prod([abs((s[:3] @ z) / (s[3:] @ z)) for s in sections])
    sections[0, :3] /= gain
    return sections


def _pair(zeros: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """Sections of two poles and two zeros each; conjugates stay together, the poles nearest the circle come last."""

    def couples(roots: np.ndarray) -> list[tuple[complex, complex]]:
        up = sorted([r for r in roots if r.imag > 1e-9], key=lambda r: abs(r))
        real = sorted([r.real for r in roots if abs(r.imag) <= 1e-9], key=abs)
        out = [(r, np.conj(r)) for r in up]
        out += [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
        return out

    p, z = couples(poles), couples(zeros)
    p.sort(key=lambda c: abs(c[0]))
    rows = []
    for pair in reversed(p):
        near = min(range(len(z)), key=lambda i: abs(z[i][0] - pair[0]))
        rows.append(np.concatenate((np.poly(z.pop(near)).real, np.poly(pair).real)))
    odd = len(poles) % 2
    if odd:  # a single pole and zero: drop the common root at 0
        for r in rows:
            if abs(r[2]) < 1e-15 and abs(r[5]) < 1e-15:
                r[2] = r[5] = 0.0
    return np.array(rows[::-1])


def sections_of(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """sections of a filter given by its polynomials."""
    b, a = np.trim_zeros(np.atleast_1d(b).astype(float), "f"), np.atleast_1d(a).astype(float)
    size = max(b.size, a.size)
    zeros = np.concatenate((np.roots(b), np.zeros(size - b.size)))
    poles = np.concatenate((np.roots(a), np.zeros(size - a.size)))
    out = _pair(zeros, poles)
    out[0, :3] *= b[0] / a[0]
    return out


def fir_design(order: int, edges: tuple[float, ...], kind: str) -> np.ndarray:
    """Hamming-windowed FIR taps (order + 1 of them; one more for an odd high or stop), gain 1 in the pass band."""
    if kind in ("high", "stop") and order % 2:
        order += 1
    n = np.arange(order + 1) - order / 2
    low = lambda f: f * np.sinc(f * n)
    unit = np.sinc(n)
    ideal = {"low": lambda: low(edges[0]), "high": lambda: unit - low(edges[0]), "pass": lambda: low(edges[1]) - low(edges[0]), "stop": lambda: unit - low(edges[1]) + low(edges[0])}[kind]()
    taps = ideal * (0.54 + 0.46 * np.cos(2 * np.pi * n / order))
    at = {"low": 0.0, "stop": 0.0, "high": 1.0, "pass": sum(edges) / 2}[kind]
    return taps / abs(np.sum(taps * np.exp(-1j * np.pi * at * n)))


# ---------------------------------------------------------------- application
@lru_cache(maxsize=256)
def _section_blocks(section: tuple[float, ...], size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a section's state step, and its outputs and last state over ``size`` samples as matrices of input and state."""
    b0, b1, b2, _, a1, a2 = section
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    enter = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    response = np.array([b0] + [(p @ enter)[0] for p in powers[: size - 1]])
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    inside = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    return powers, inside, np.array([p[0] for p in powers[:size]]), np.array([p @ enter for p in powers[:size]])[::-1].T


def run_section(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section over ``x`` from ``state``, in short runs: within a run the output is a matrix product. Also the last state."""
    size = min(BLOCK, max(1, x.size))
    powers, inside, from_state, to_state = _section_blocks(tuple(map(float, section)), size)
    out = np.empty_like(x)
    for at in range(0, x.size, size):
        part = x[at : at + size]
        m = part.size
        out[at : at + m] = inside[:m, :m] @ part + from_state[:m] @ state
        state = powers[m] @ state + to_state[:, size - m :] @ part
    return out, state


def run_cascade(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections in turn over ``x``; the state has two numbers for each."""
    ends = []
    for k, s in enumerate(sections):
        x, end = run_section(s, x, state[2 * k : 2 * k + 2])
        ends.append(end)
    return x, np.concatenate(ends)


def steady_state(sections: np.ndarray) -> np.ndarray:
    """The state that a constant input of 1 keeps."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out += [(gain - b0) * level, (b2 - a2 * gain) * level]
        level *= gain
    return np.array(out)


def _extended(x: np.ndarray, pad: int, before: bool = True, after: bool = True) -> np.ndarray:
    """Odd reflections of ``pad`` samples at the ends."""
    parts = [2 * x[0] - x[pad:0:-1]] if before else []
    return np.concatenate([*parts, x, *([2 * x[-1] - x[-2 : -pad - 2 : -1]] if after else [])])


def both_ways(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """forward and backward over ``x`` extended by odd reflection, each from the steady state of its first value.

    A recursive filter carries a missing value over the whole series, so a series with one is missing throughout; fill
    it first (``missing.handle``).
    """
    pad = min(6 * len(sections), x.size - 1)
    if x.size < 2 or np.isnan(x).any():
        return np.full(x.size, np.nan) if np.isnan(x).any() else x.copy()
    y, steady = _extended(x, pad), steady_state(sections)
    for _ in range(2):
        y = run_cascade(sections, y, steady * y[0])[0][::-1]
    return y[pad : pad + x.size]


def apply_sections(signals: DataFrame, sections: np.ndarray) -> DataFrame:
    """:func:`both_ways` of every series, the long ones block by block."""
    found = lengths(signals)
    if in_one_block(found):
        return per_series(signals, lambda x: both_ways(sections, x))
    blocks = cut(signals, found)
    steady = steady_state(sections)
    one_step = np.stack([run_cascade(sections, np.zeros(1), u)[1] for u in np.eye(steady.size)]).T

    powers: dict[int, np.ndarray] = {}

    def power(m: int) -> np.ndarray:
        if m not in powers:
            powers[m] = np.linalg.matrix_power(one_step, m)
        return powers[m]

    usual, keys, grid = 6 * len(sections), blocks.keys, blocks.grid
    most = grid.last(found[1]) + 1
    summary = "m long, made array<double>, start array<double>"

    def extended(row: pd.Series) -> np.ndarray:
        return _extended(np.array(row["values"], np.float64), min(usual, row["n"] - 1), row["block"] == 0, row["block"] == grid.last(row["n"]))

    def summarise(y: np.ndarray, first: bool) -> dict:
        return {"m": y.size, "made": run_cascade(sections, y, np.zeros(steady.size))[1].tolist(), "start": (steady * y[0]).tolist() if first else None}

    def forward(row: pd.Series) -> dict:
        y = run_cascade(sections, extended(row), np.array(row["state"], float))[0]
        return {"values": y.tolist()} | summarise(y[::-1], row["block"] == grid.last(row["n"]))

    def backward(row: pd.Series) -> dict[str, np.ndarray]:
        y = run_cascade(sections, np.array(row["values"], float)[::-1], np.array(row["state"], float))[0][::-1]
        first, end = grid.own(row["block"], row["n"])
        pad = min(usual, row["n"] - 1) if first == 0 else 0
        return {"sample": np.arange(first + 1, end + 1), "value": y[pad : pad + end - first]}

    sound = blocks.table.filter(~F.col("missing") & (F.col("n") > 1))
    first = each(sound, lambda row: summarise(extended(row), row["block"] == 0), [*keys, "block"], summary)
    ahead = meet(sound, carried(first, keys, power, most), [*keys, "block"])
    ahead = stored(each(ahead, forward, [*keys, "block", "n"], f"values array<double>, {summary}"), "forward")
    end = F.greatest(F.floor(F.col("n") / F.lit(grid.size)) - 1, F.lit(0))
    back = carried(ahead.select(*keys, (end - F.col("block")).alias("block"), "m", "made", "start"), keys, power, most)
    back = meet(ahead.withColumn("_turned", end - F.col("block")), back.withColumnRenamed("block", "_turned"), [*keys, "_turned"])
    out = spread(back, backward, keys, "sample long, value double")
    rest = blocks.table.filter(F.col("missing") | (F.col("n") < 2)).select(*out.columns[:-2], (F.col("at") + 1).alias("_first"), "missing", F.posexplode("values").alias("_k", "value"))
    return out.unionByName(rest.select(*out.columns[:-2], (F.col("_first") + F.col("_k")).alias("sample"), F.when(~F.col("missing"), F.col("value")).alias("value")))


def _edges(rate: float, low: float | None, high: float | None, kind: str | None) -> tuple[tuple[float, ...], str]:
    kind = kind or ("pass" if low and high else "high" if low else "low")
    used = [f for f in (low, high) if f is not None]
    if not used:
        raise ValueError("low or high is needed")
    return tuple(f / (rate / 2) for f in used), kind


def butterworth_filter(signals: DataFrame, rate: float, low: float | None = None, high: float | None = None, order: int = 4, kind: str | None = None) -> DataFrame:
    """zero-phase Butterworth filter; ``low`` and ``high`` are the edges in Hz."""
    return apply_sections(signals, butterworth(order, *_edges(rate, low, high, kind)))


def fir_filter(signals: DataFrame, rate: float, low: float | None = None, high: float | None = None, order: int = 100, kind: str | None = None) -> DataFrame:
    """zero-phase FIR filter (forward and backward)."""
    taps = fir_design(order, *_edges(rate, low, high, kind))

    both = np.convolve(taps, taps[::-1])
    reach = taps.size - 1

    def run(x: np.ndarray) -> np.ndarray:
        pad = min(3 * taps.size, x.size - 1)
        y = _extended(x, pad) if pad > 0 else x
        return np.convolve(y, both, "same")[pad : pad + x.size] if y.size >= both.size else np.convolve(y, both)[taps.size - 1 + pad :][: x.size]

    def part(x: np.ndarray, first: bool, last: bool, start: int, stop: int) -> np.ndarray:
        y = _extended(x, reach, first, last)
        at = start + (reach if first else 0)
        return convolve(y, both)[at + reach : at + reach + stop - start]

    return with_halo(signals, reach, run, part)


def notch_filter(signals: DataFrame, rate: float, frequency: float = 50.0, bandwidth: float = 2.0, harmonics: int = 1) -> DataFrame:
    """band stops of order 4 around the frequency and its harmonics below Nyquist."""
    stops = [butterworth(4, ((frequency * h - bandwidth / 2) / (rate / 2), (frequency * h + bandwidth / 2) / (rate / 2)), "stop") for h in range(1, harmonics + 1) if frequency * h + bandwidth / 2 < rate / 2]
    return apply_sections(signals, np.concatenate(stops)) if stops else signals


def band_limits(rate: float, band: tuple[float, float]) -> tuple[float, float]:
    """a band as shares of Nyquist, held between 0.01 and 0.99."""
    low, high = (float(np.clip(f / (rate / 2), 0.01, 0.99)) for f in band)
    if low >= high:
        raise ValueError("the band is empty")
    return low, high


def windowed_sinc(signals: DataFrame, rate: float, low: float | None = None, high: float | None = None, taps: int = 101, kind: str | None = None) -> DataFrame:
    """one pass of a Hamming-windowed sinc with zeros beyond the edges."""
    kernel = fir_design(taps - 1, *_edges(rate, low, high, kind))

    middle = (kernel.size - 1) // 2

    def run(x: np.ndarray) -> np.ndarray:
        return np.convolve(x, kernel)[middle:][: x.size]

    def part(x: np.ndarray, first: bool, last: bool, start: int, stop: int) -> np.ndarray:
        return convolve(x, kernel)[start + middle : stop + middle]

    return with_halo(signals, kernel.size // 2, run, part)


# ---------------------------------------------------------------- resampling
def resample(signals: DataFrame, rate: float, target: float, method: str = "linear") -> DataFrame:
    """F8: to ``target`` Hz over the same duration, ends included; linear, spline (natural) or fft.

    The bend of a spline at a sample feels another one k samples away by a factor of (2 - sqrt(3)) ** k, so with ``HALO`` samples on each side
    a block's own part of the tridiagonal system has the solution of the whole one to the last digit.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    if target == rate:
        return signals

    def run(x: np.ndarray) -> np.ndarray:
        size = max(1, round(x.size / rate * target))
        at = np.linspace(0, x.size - 1, size)
        if method == "linear":
            return np.interp(at, np.arange(x.size), x)
        if method == "spline":
            return _spline(x, at)
        spectrum = np.fft.rfft(x)
        kept = np.zeros(size // 2 + 1, complex)
        n = min(kept.size, spectrum.size)
        kept[:n] = spectrum[:n]
        return np.fft.irfft(kept, size) * (size / x.size)

    if method not in ("linear", "spline", "fft"):
        raise ValueError("method must be linear, spline or fft")
    if in_one_block(found := lengths(signals)):
        return per_series(signals, run)
    if method == "fft":
        return fourier.resampled(signals, found, lambda n: max(1, round(n / rate * target)))
    blocks = cut(signals, found, halo=HALO)
    grid = blocks.grid

    def part(row: pd.Series) -> dict[str, np.ndarray]:
        n, (first, end) = row["n"], grid.own(row["block"], row["n"])
        x = np.full(len(row["values"]), np.nan) if method == "spline" and row["missing"] else np.array(row["values"], np.float64)
        size = max(1, round(n / rate * target))
        step = (n - 1) / (size - 1) if size > 1 else float(n)
        k = np.arange(max(0, int(first / step) - 1), min(size, int(end / step) + 2)) if step else np.arange(size)
        at = np.where((k == size - 1) & (k > 0), n - 1, k * step)
        k, at = k[(at >= first) & (at < end)], at[(at >= first) & (at < end)] - row["at"]
        return {"sample": k + 1, "value": np.interp(at, np.arange(x.size), x) if method == "linear" else _spline(x, at)}

    return spread(blocks.table, part, blocks.keys, "sample long, value double")


def _spline(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through x at 0, 1, ...; the tridiagonal system is solved by elimination."""
    n = x.size
    if n < 3:
        return np.interp(at, np.arange(n), x)
    bend, upper = np.zeros(n), np.zeros(n)
    right = 6 * (x[2:] - 2 * x[1:-1] + x[:-2])
    partial = np.zeros(n)
    for i in range(1, n - 1):
        pivot = 4 - upper[i - 1]
        upper[i] = 1 / pivot
        partial[i] = (right[i - 1] - partial[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        bend[i] = partial[i] - upper[i] * bend[i + 1]
    k = np.clip(at.astype(int), 0, n - 2)
    t = at - k
    return x[k] * (1 - t) + x[k + 1] * t + ((1 - t) ** 3 - (1 - t)) * bend[k] / 6 + (t**3 - t) * bend[k + 1] / 6


def resample_linear(signals: DataFrame, rate: float, target: float) -> DataFrame:
    """F8, linear, with native functions: each new sample reads its two neighbours from a window."""
    keys = keys_of(signals)
    n = F.max("sample").over(Window.partitionBy(*keys))
    rows = signals.withColumn("n", n).withColumn("next_value", F.lead("value").over(along(signals)))
    rows = rows.withColumn("size", F.greatest(F.bround(F.col("n") / F.lit(float(rate)) * target).cast("long"), F.lit(1)))
    gap = F.when(F.col("size") > 1, (F.col("n") - 1) / (F.col("size") - 1).cast("double")).otherwise(F.lit(1.0) * F.col("n"))
    # new samples k with sample - 1 <= k * gap < sample
    first = F.ceil((F.col("sample") - 1) / F.col("gap") - 1e-9)
    last = F.when(F.col("sample") == F.col("n"), F.col("size") - 1).otherwise(F.least(F.ceil(F.col("sample") / F.col("gap") - 1e-9) - 1, F.col("size") - 1))
    rows = rows.withColumn("gap", gap).withColumn("k", F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long")))))
    share = F.col("k") * F.col("gap") - (F.col("sample") - 1)
    value = F.col("value") + F.when(F.col("next_value").isNotNull(), share * (F.col("next_value") - F.col("value"))).otherwise(0.0)
    return rows.select(*keys, (F.col("k") + 1).alias("sample"), value.alias("value"))


def decimate(signals: DataFrame, rate: float, factor: int, order: int = 8) -> DataFrame:
    """low-pass at 0.8 of the new Nyquist frequency, then every ``factor``-th sample."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    return signals if factor == 1 else stride(butterworth_filter(signals, rate, high=0.8 * rate / factor / 2, order=order), factor)


def upsample(signals: DataFrame, rate: float, factor: int, method: str = "linear") -> DataFrame:
    """F10."""
    return resample(signals, rate, rate * factor, method)


# ---------------------------------------------------------------- referencing
def rereference(signals: DataFrame, kind: str = "average", channels: list[str] | None = None, exclude: list[str] | None = None, keep: bool = True) -> DataFrame:
    """subtract, at each sample, the mean over channels (less ``exclude``) or over the reference ``channels``.

    ``rest`` is taken as average. With ``keep`` off the reference channels are dropped.
    """
    if kind in ("average", "rest"):
        counted = ~F.col("channel").isin(*exclude) if exclude else F.lit(True)
    elif kind in ("channel", "channels"):
        if not channels:
            raise ValueError("reference channels are needed")
        counted = F.col("channel").isin(*channels)
    else:
        raise ValueError("kind must be average, rest, channel or channels")
    across = Window.partitionBy(*keys_of(signals, "channel"), "sample")
    out = signals.withColumn("value", F.col("value") - F.avg(F.when(counted, F.col("value"))).over(across))
    return out if keep or kind in ("average", "rest") else out.filter(~F.col("channel").isin(*channels))


def rereference_recording(recording: Recording, kind: str = "average", channels: list[str] | None = None, exclude: list[str] | None = None, keep: bool = True) -> Recording:
    """:func:`rereference` of a recording, which remembers the new reference and the one before."""
    signals = rereference(recording.signals, kind, channels, exclude, keep)
    name = "+".join(channels) if kind in ("channel", "channels") else "REST" if kind == "rest" else kind
    table = recording.channels
    if table is not None and not keep and kind in ("channel", "channels"):
        table = table.filter(~F.col("channel").isin(*channels))
    return recording.with_signals(signals, channels=table, reference=name, metadata=recording.metadata | {"previous_reference": recording.reference})


def current_reference(recording: Recording) -> str | None:
    """P15."""
    return recording.reference


def is_average_referenced(recording: Recording) -> bool:
    """P15."""
    return recording.reference == "average"
