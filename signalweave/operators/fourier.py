"""Fourier transforms of whole series, by many tasks.

The four-step transform: a series of n = n1 * n2 samples is an n1 x n2 matrix. Columns are transformed, multiplied by twiddle factors,
exchanged for rows, and these transformed. A task holds a bundle of columns or of rows, about ``16 * sqrt(n)`` values. The way back takes the same steps in turn, so that a filter in the
frequency domain costs three exchanges. A length without balanced divisors (a prime) is transformed as Bluestein's convolution with a chirp, of
the next power of two above twice the length; the chirp's transform is made by the same tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import placed, stored
from ..model import keys_of
from . import blocks
from .blocks import kinds_of, lengths, meet

#: How far the divisors of a length may be from its root.
BALANCE = 8

Visit = Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]]


@lru_cache(maxsize=4096)
def layout(n: int, short: int) -> tuple[int, int, bool]:
    """Rows and columns of the matrix, and whether it is that of a chirp transform; a length below ``short`` is one row."""
    if n < short:
        return 1, n, False
    for n1 in range(isqrt(n), max(1, isqrt(n) // BALANCE) - 1, -1):
        if n % n1 == 0 and n1 > 1:
            return n1, n // n1, False
    power = (2 * n - 2).bit_length()
    return 1 << power // 2, 1 << power - power // 2, True


class Plan:
    """The matrix of a series of n samples and its bundles."""

    def __init__(self, n: int, samples: int):
        self.n = n
        self.n1, self.n2, self.chirp = layout(n, 2 * samples)
        self.size = self.n1 * self.n2
        held = max(samples, 16 * isqrt(self.size))
        self.wide, self.high = max(1, held // self.n1), max(1, held // self.n2)

    def columns(self, g: int) -> np.ndarray:
        return np.arange(g * self.wide, min(self.n2, (g + 1) * self.wide))

    def rows(self, h: int) -> np.ndarray:
        return np.arange(h * self.high, min(self.n1, (h + 1) * self.high))

    def positions(self, g: int) -> np.ndarray:
        """Positions in the series of a bundle of columns."""
        return np.arange(self.n1)[:, None] * self.n2 + self.columns(g)[None, :]

    def bins(self, h: int) -> np.ndarray:
        """Frequencies of a bundle of rows after a direct transform."""
        return self.rows(h)[:, None] + self.n1 * np.arange(self.n2)[None, :]

    def twiddle(self, k1: np.ndarray, j2: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (k1[:, None] * j2[None, :] % self.size) / self.size)

    def chirp_at(self, m: np.ndarray) -> np.ndarray:
        return np.exp(1j * np.pi * (m * m % (2 * self.n)) / self.n)


def _columns(signals: DataFrame, known: DataFrame, even: bool, samples: int) -> tuple[DataFrame, list[str]]:
    """keys, n, g, at, re, im: bundles of columns; and the keys (a stand-in where there are none)."""
    keys = keys_of(signals)
    by = keys or ["_series"]
    rows, known = (signals, known) if keys else (signals.withColumn("_series", F.lit(0)), known.withColumn("_series", F.lit(0)))

    def plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [Plan(int(n), samples) for n in frame["n"]]
            yield frame.assign(_n2=np.array([p.n2 for p in made], np.int64), _wide=np.array([p.wide for p in made], np.int64))

    known = known.mapInPandas(plans, f"{kinds_of(known, known.columns)}, _n2 long, _wide long")
    few = known.count() <= blocks.BROADCAST_SERIES
    rows = meet(rows, F.broadcast(known) if few else known, by)
    rows = rows.withColumn("_at", F.col("sample") - F.col("_low")) if even else placed(rows, [F.col("sample")], by, "_at")
    re, im = ("re", "im") if "re" in signals.columns else ("value", None)
    rows = rows.withColumn("g", F.floor(F.col("_at") % F.col("_n2") / F.col("_wide")))
    parts = F.collect_list(F.struct(F.col("_at").alias("at"), F.col(re).cast("double").alias("re"), (F.col(im) if im else F.lit(0.0)).cast("double").alias("im")))
    table = rows.groupBy(*by, "n", "g").agg(parts.alias("_parts"))
    return table.select(*by, "n", "g", F.col("_parts.at").alias("at"), F.col("_parts.re").alias("re"), F.col("_parts.im").alias("im")), by


def _frame(keys: list[str], row: pd.Series, size: int, columns: dict) -> pd.DataFrame:
    return pd.DataFrame({k: [row[k]] * size for k in keys} | columns)


def _split(matrix: np.ndarray, step: int, axis: int) -> list[np.ndarray]:
    return [part for part in np.split(matrix, range(step, matrix.shape[axis], step), axis=axis)]


def _down(keys: list[str], row: pd.Series, plan: Plan, g: int, x: np.ndarray) -> pd.DataFrame:
    """Messages to the bundles of rows from a bundle of columns in natural order."""
    turn = plan.twiddle(np.arange(plan.n1), plan.columns(g))
    at = plan.positions(g)
    if plan.chirp:
        inside = at < plan.n
        x = np.where(inside, x * np.conj(plan.chirp_at(np.where(inside, at, 0))), 0)
        back = plan.size - at
        chirp = np.where(inside, plan.chirp_at(np.where(inside, at, 0)), np.where(back < plan.n, plan.chirp_at(np.where(back < plan.n, back, 0)), 0))
        other = _split(np.fft.fft(chirp, axis=0) * turn, plan.high, 0)
    parts = _split(np.fft.fft(x, axis=0) * turn, plan.high, 0)
    found = {"n": plan.n, "h": np.arange(len(parts)), "g": g, "re": [p.real.ravel() for p in parts], "im": [p.imag.ravel() for p in parts]}
    found |= {"cre": [p.real.ravel() for p in other], "cim": [p.imag.ravel() for p in other]} if plan.chirp else {"cre": None, "cim": None}
    return _frame(keys, row, len(parts), found)


def _gathered(frame: pd.DataFrame, name: str, plan: Plan, h: int) -> np.ndarray:
    """A bundle of rows from its messages."""
    rows = plan.rows(h).size
    return np.concatenate([(re + 1j * im).reshape(rows, -1) for re, im in zip(frame[f"{name}re"], frame[f"{name}im"], strict=True)], axis=1)


def _up(keys: list[str], row: pd.Series, plan: Plan, h: int, y: np.ndarray) -> pd.DataFrame:
    """Messages to the bundles of columns from a bundle of rows in the frequency domain."""
    parts = _split(np.fft.ifft(y, axis=1) * np.conj(plan.twiddle(plan.rows(h), np.arange(plan.n2))), plan.wide, 1)
    return _frame(keys, row, len(parts), {"n": plan.n, "g": np.arange(len(parts)), "h": h, "re": [p.real.ravel() for p in parts], "im": [p.imag.ravel() for p in parts]})


def _natural(frame: pd.DataFrame, plan: Plan, g: int) -> np.ndarray:
    """A bundle of columns in natural order from its messages."""
    width = plan.columns(g).size
    y = np.concatenate([(re + 1j * im).reshape(-1, width) for re, im in zip(frame["re"], frame["im"], strict=True)], axis=0)
    return np.fft.ifft(y, axis=0)


def spectrum(signals: DataFrame, visit: Visit, out: str, gain: Callable[[np.ndarray, int], np.ndarray] | None = None, inverse: bool = False, known: tuple[DataFrame, int, bool] | None = None) -> DataFrame:
    """keys and the columns ``out``, from the transform of each whole series.

    ``visit`` gets 0-based bins, their complex values and n, and returns arrays for ``out``. With ``gain``, a factor of bin and n, the
    spectrum is multiplied by it and transformed back, and ``visit`` gets 0-based positions and values instead. ``inverse`` makes
    the first transform an inverse one. ``signals`` have a value, or re and im; ``known`` gives lengths (keys, _low, n) of series
    with zeros left out. A missing value makes all of a series missing.
    """
    known, _, even = known or lengths(signals)
    samples = blocks.SAMPLES
    table, keys = _columns(signals, known, even, samples)
    table = stored(table, "columns")
    kinds, names = kinds_of(table, keys), [c.strip().split(" ")[0] for c in out.split(",")]
    kept = [k for k in keys if k != "_series"]
    to_rows = f"{kinds}, n long, h long, g long, re array<double>, im array<double>, cre array<double>, cim array<double>"
    to_columns = f"{kinds}, n long, g long, h long, re array<double>, im array<double>"
    kept_kinds = kinds_of(table, kept)
    result = f"{kept_kinds}{', ' if kept_kinds else ''}{out}"

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                plan, g = Plan(int(row["n"]), samples), int(row["g"])
                x = np.zeros((plan.n1, plan.columns(g).size), complex)
                at = np.array(row["at"])
                value = np.array(row["re"], float) + 1j * np.array(row["im"], float)
                x[at // plan.n2, at % plan.n2 - g * plan.wide] = np.conj(value) if inverse else value
                yield _down(keys, row, plan, g, x)

    def visited(row: pd.Series, at: np.ndarray, value: np.ndarray, n: int) -> pd.DataFrame:
        found = visit(at.ravel(), value.ravel(), n)
        return _frame(kept, row, len(found[names[0]]), {c: found[c] for c in names})

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return np.conj(x) / n if inverse else x

    def at_rows(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("g")
            row = frame.iloc[0]
            plan, h = Plan(int(row["n"]), samples), int(row["h"])
            y = np.fft.fft(_gathered(frame, "", plan, h), axis=1)
            if plan.chirp:
                return _up(keys, row, plan, h, y * np.fft.fft(_gathered(frame, "c", plan, h), axis=1))
            bins = plan.bins(h)
            y = turned(y, plan.n)
            return visited(row, bins, y, plan.n) if last else _up(keys, row, plan, h, y * gain(bins, plan.n))

        return run

    def at_columns(last: bool, again: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("h")
            row = frame.iloc[0]
            plan, g = Plan(int(row["n"]), samples), int(row["g"])
            at, y = plan.positions(g), _natural(frame, plan, g)
            if not plan.chirp:
                return visited(row, at, y, plan.n)
            inside = at < plan.n
            y = y * np.conj(plan.chirp_at(np.where(inside, at, 0)))
            y = np.conj(y) / plan.n if again else turned(y, plan.n)
            if last:
                return visited(row, at[inside], y[inside], plan.n)
            return _down(keys, row, plan, g, np.where(inside, np.conj(y * gain(np.where(inside, at, 0), plan.n)), 0))

        return run

    first = table.mapInPandas(start, to_rows)
    by_row, by_column = [*keys, "n", "h"], [*keys, "n", "g"]
    # which kinds of length there are: the direct ones have no chirp in their messages
    sizes = known.select("n").distinct().limit(10_000).collect()
    chirps = {layout(r[0], 2 * samples)[2] for r in sizes} if len(sizes) < 10_000 else {True, False}
    found = []
    if False in chirps:
        rows = first.filter("cre IS NULL").groupBy(*by_row)
        found.append(rows.applyInPandas(at_rows(True), result) if gain is None else rows.applyInPandas(at_rows(False), to_columns).groupBy(*by_column).applyInPandas(at_columns(True), result))
    if True in chirps:
        columns = first.filter("cre IS NOT NULL").groupBy(*by_row).applyInPandas(at_rows(True), to_columns).groupBy(*by_column)
        if gain is not None:
            columns = columns.applyInPandas(at_columns(False), to_rows).groupBy(*by_row).applyInPandas(at_rows(True), to_columns).groupBy(*by_column)
        found.append(columns.applyInPandas(at_columns(True, again=gain is not None), result))
    if not found:  # no series
        return signals.sparkSession.createDataFrame([], result)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def analytic_gain(k: np.ndarray, n: int) -> np.ndarray:
    """Bin 0 and, of an even length, the middle one stay, the others below the middle double, those above go."""
    return np.where((k == 0) | (2 * k == n), 1.0, np.where(2 * k < n, 2.0, 0.0))


def analytic_signal(signals: DataFrame, known: tuple[DataFrame, int, bool] | None = None) -> DataFrame:
    """keys, sample, re, im."""
    return spectrum(signals, lambda at, z, n: {"sample": at + 1, "re": z.real, "im": z.imag}, "sample long, re double, im double", gain=analytic_gain, known=known)


def resampled(signals: DataFrame, known: tuple[DataFrame, int, bool], new_size: Callable[[int], int]) -> DataFrame:
    """keys, sample, value: each series at ``new_size(n)`` samples, by cutting its spectrum or adding zeros to it; amplitudes are kept."""
    def kept(k: np.ndarray, x: np.ndarray, n: int) -> dict:
        size = new_size(n)
        low = k <= min(n // 2, size // 2)
        k, x = k[low], x[low] * (size / n)
        both = (k > 0) & (2 * k != size)  # the mirrored bins of a real series; the middle one of an even length is its own mirror
        x = np.where((k == 0) | (2 * k == size), x.real, x)
        bins, values = np.concatenate([k, size - k[both]]), np.concatenate([x, np.conj(x[both])])
        return {"sample": bins + 1, "n": np.full(bins.size, size), "re": values.real, "im": values.imag}

    spectra = stored(spectrum(signals, kept, "sample long, n long, re double, im double", known=known), "spectra")
    sizes = spectra.groupBy(*keys_of(signals)).agg(F.first("n").alias("n")).withColumn("_low", F.lit(1).cast("long"))
    out = spectrum(spectra.drop("n"), lambda at, z, n: {"sample": at + 1, "value": z.real}, "sample long, value double", inverse=True, known=(stored(sizes, "sizes"), known[1], True))
    return out
