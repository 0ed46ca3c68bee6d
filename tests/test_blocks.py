"""Operators on series cut into blocks give what they give on whole series, and no task sees a whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalweave.operators import blocks, filters, spectral

LENGTHS = {"a": 1000, "b": 997, "c": 131, "d": 60, "e": 20, "f": 2, "g": 1, None: 640}


@pytest.fixture(scope="module")
def series(spark):
    """Series of many lengths (a null key too), one with a missing value, one with gaps in its numbers."""
    rng = np.random.default_rng(0)
    rows = [(c, i + 5, float(v)) for c, n in LENGTHS.items() for i, v in enumerate(np.cumsum(rng.normal(size=n)) + 3)]
    rows += [("h", i + 1, None if i == 333 else float(i % 7)) for i in range(500)]
    return spark.createDataFrame(rows, "channel string, sample long, value double").repartition(5).cache()


def small(monkeypatch, samples=64, scan=3):
    monkeypatch.setattr(blocks, "SAMPLES", samples)
    monkeypatch.setattr(blocks, "SCAN", scan)


def compared(signals, operator, monkeypatch, samples=64, scan=3, atol=1e-9):
    """The operator on whole series and in blocks."""
    whole = operator(signals).toPandas()
    small(monkeypatch, samples, scan)
    cut = operator(signals)
    plan = cut._jdf.queryExecution().toString()
    got = cut.toPandas()
    assert list(got.columns) == list(whole.columns)
    names = [c for c in whole.columns if c not in ("value", "power", "phase", "re", "im")]
    whole, got = (x.sort_values(names).reset_index(drop=True) for x in (whole, got))
    pd.testing.assert_frame_equal(whole[names], got[names], check_dtype=False)
    for c in set(whole.columns) - set(names):
        a, b = whole[c].to_numpy(float), got[c].to_numpy(float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        scale = max(1.0, np.nanmax(np.abs(a)))
        assert np.nanmax(np.abs(a - b)) <= atol * scale, (c, np.nanmax(np.abs(a - b)))
    return plan


@pytest.mark.parametrize("edges, order, kind", [((0.02, 0.3), 4, "pass"), ((0.1,), 3, "low"), ((0.005,), 2, "high"), ((0.2, 0.22), 4, "stop")])
def test_recursive_filters_in_blocks(series, monkeypatch, edges, order, kind):
    sections = filters.butterworth(order, edges, kind)
    compared(series, lambda s: filters.apply_sections(s, sections), monkeypatch)


def test_recursive_filter_without_keys_and_with_gaps(series, monkeypatch):
    one = series.filter("channel = 'a'").select((F.col("sample") * 2 + F.when(F.col("sample") > 400, 9).otherwise(0)).alias("sample"), "value")
    compared(one, lambda s: filters.butterworth_filter(s, 100.0, 1.0, 20.0), monkeypatch)


def test_scan_of_many_levels(series, monkeypatch):
    plan = compared(series.filter("channel IN ('a', 'b')"), lambda s: filters.notch_filter(s, 100.0, 20.0), monkeypatch, samples=40, scan=2)
    assert plan


@pytest.mark.parametrize("taps", [20, 101, 130])
def test_fir_filters_in_blocks(series, monkeypatch, taps):
    compared(series, lambda s: filters.fir_filter(s, 100.0, 5.0, 20.0, order=taps), monkeypatch)


@pytest.mark.parametrize("taps", [21, 101, 100])
def test_windowed_sinc_in_blocks(series, monkeypatch, taps):
    compared(series, lambda s: filters.windowed_sinc(s, 100.0, high=20.0, taps=taps), monkeypatch)


def test_wavelets_in_blocks(series, monkeypatch):
    loud = lambda rows: rows.withColumn("phase", F.when(F.col("power") > 1e-6, F.cos("phase")))
    compared(series, lambda s: loud(spectral.wavelet(s, 100.0, [5.0, 20.0], cycles=5.0)), monkeypatch, atol=1e-8)


# ---------------------------------------------------------------- transforms
@pytest.mark.parametrize("samples", [16, 60])
def test_transforms_by_four_steps(series, monkeypatch, samples):
    """Lengths with divisors near the root (1000, 640, 60) and without (997, 131), and one with a missing value."""
    from signalweave.operators import fourier

    compared(series, spectral.fft_magnitude, monkeypatch, samples)
    assert {n: fourier.layout(n, 2 * samples)[2] for n in (1000, 640, 997)} == {1000: False, 640: False, 997: True}


def test_analytic_signals_by_four_steps(series, monkeypatch):
    compared(series, spectral.hilbert, monkeypatch, 40)


def test_periodograms_by_four_steps(series, monkeypatch):
    compared(series.filter("channel <> 'h'"), lambda s: spectral.periodogram(s, 100.0).withColumn("frequency", F.round("frequency", 9)), monkeypatch, 40)


@pytest.mark.parametrize("target", [50.0, 73.0, 130.0, 200.0])
def test_resampling_by_four_steps(series, monkeypatch, target):
    compared(series.filter("channel <> 'h'"), lambda s: filters.resample(s, 100.0, target, "fft"), monkeypatch, 40)


def test_phases_in_blocks(series, monkeypatch):
    from signalweave.operators import connectivity

    compared(series.filter("channel IN ('a', 'b', 'c')"), lambda s: connectivity.band_phase(s, 100.0, (8.0, 13.0)), monkeypatch, 64)


@pytest.mark.parametrize("method", ["linear", "spline"])
@pytest.mark.parametrize("target", [17.0, 73.0, 100.5, 330.0])
def test_resampling_in_blocks(series, monkeypatch, method, target):
    compared(series.filter("channel <> 'g'"), lambda s: filters.resample(s, 100.0, target, method), monkeypatch, 80)


def test_spline_equals_dense_solve():
    x = np.cumsum(np.random.default_rng(2).normal(size=40))
    system, right = np.eye(40), np.zeros(40)
    for i in range(1, 39):
        system[i, i - 1 : i + 2], right[i] = (1, 4, 1), 6 * (x[i + 1] - 2 * x[i] + x[i - 1])
    bend, at = np.linalg.solve(system, right), np.linspace(0, 39, 101)
    k = np.minimum(at.astype(int), 38)
    a, b, t = x[k], x[k + 1], at - k
    expected = a + t * (b - a - bend[k] / 3 - bend[k + 1] / 6) + t**2 * bend[k] / 2 + t**3 * (bend[k + 1] - bend[k]) / 6
    assert np.allclose(filters._spline(x, at), expected, atol=1e-12)


# ---------------------------------------------------------------- least distances
@pytest.mark.parametrize("distance, scan", [(2, 3), (5, 2), (40, 3), (64, 2), (150, 3)])
def test_peaks_with_a_least_distance_in_blocks(series, monkeypatch, distance, scan):
    from signalweave.operators import sequence

    compared(series, lambda s: sequence.peaks(s, -1e9, distance), monkeypatch, 40, scan)


@pytest.mark.parametrize("direction", ["rising", "falling", "both"])
def test_crossings_with_a_refractory_time_in_blocks(series, monkeypatch, direction):
    from signalweave.operators import sequence

    compared(series, lambda s: sequence.crossings(s, 3.0, direction, 17), monkeypatch, 40)


def test_spaced_choice_depends_on_far_blocks(spark, monkeypatch):
    """A peak at every other sample: whether one is accepted depends on the very first peak, over blocks without end."""
    from signalweave.operators import sequence

    rows = [("a", i, float(i % 2)) for i in range(1, 1200)]
    small(monkeypatch, 32, 2)
    got = sorted(r["sample"] for r in sequence.peaks(spark.createDataFrame(rows, "channel string, sample long, value double"), 0.5, 7).collect())
    kept, last = [], -10
    for i in range(3, 1199, 2):
        if i - last >= 7:
            kept.append(i)
            last = i
    assert got == kept


# ---------------------------------------------------------------- rank correlations
@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlations_of_split_pairs(spark, monkeypatch, method):
    """Ties that fill many strips, values that are all equal, missing values, a pair of one sample, two recordings (one without a name)."""
    from signalweave.operators import connectivity

    rng = np.random.default_rng(5)
    base = np.cumsum(rng.normal(size=700))
    made = {"a": base, "b": np.where(rng.random(700) < 0.6, 1.0, np.round(base)), "c": -base + rng.normal(size=700), "d": np.full(700, 2.0), "e": np.array([3.0])}
    rows = [(r, c, i + 1, None if (c, i % 50) == ("c", 7) else float(v)) for r in ("x", None) for c, x in made.items() for i, v in enumerate(x if r else x[:90])]
    signals = spark.createDataFrame(rows, "rec string, channel string, sample long, value double").repartition(5).cache()
    monkeypatch.setattr(connectivity, "SAMPLES", 20)
    whole = connectivity.correlation(signals.filter("rec IS NOT NULL").drop("rec"), method).toPandas()
    small(monkeypatch, 64)
    got = connectivity.correlation(signals.filter("rec IS NOT NULL").drop("rec"), method)
    got = got.toPandas()
    pd.testing.assert_frame_equal(*[t.sort_values(["a", "b"]).reset_index(drop=True) for t in (whole, got)], check_exact=False, atol=1e-12)
    if method == "kendall":
        both = connectivity.correlation(signals, method).toPandas()
        one = both[both["rec"].isna() & (both["a"] == "a") & (both["b"] == "b")]["value"].item()
        assert np.isclose(one, connectivity.kendall(made["a"][:90], made["b"][:90]), atol=1e-12)
