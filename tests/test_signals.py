"""Operators on signals against closed forms and numpy."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalweave.model import Recording
from signalweave.operators import artifacts, connectivity, decomposition, emg, epochs, events, filters, missing, network, select, sequence, spectral, stats, views

RATE = 100.0


def signal(spark, **channels):
    rows = [(c, i + 1, None if v is None else float(v)) for c, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, sample long, value double")


def values(df, channel="a"):
    return [r["value"] for r in df.filter(F.col("channel") == channel).orderBy("sample").collect()]


T = np.arange(1000) / RATE
SINE = np.sin(2 * np.pi * 5 * T)


@pytest.fixture(scope="module")
def two(spark):
    return signal(spark, a=SINE, b=0.8 * SINE).cache()


def test_epochs_average_and_baseline(spark, two):
    ev = events.make_events(spark, [1.0, 3.0, 5.0, 7.0], 0.0, "stimulus", "A")
    cut = epochs.extract(two, ev, RATE, -0.2, 0.3)
    assert cut.select("epoch").distinct().count() == 4
    mean = values(epochs.average(cut))
    assert np.allclose(mean, SINE[80:131])
    base = epochs.extract(two, ev, RATE, -0.2, 0.3, baseline=(-0.2, 0.0))
    first = base.filter("epoch = 1 AND channel = 'a' AND sample <= 21").agg(F.avg("value")).first()[0]
    assert abs(first) < 1e-12


def test_epochs_out_of_bounds_and_rejection(spark):
    x = SINE.copy()
    x[299:310] = 1000
    s = signal(spark, a=x)
    ev = events.make_events(spark, [0.1, 1.0, 3.0, 5.0, 9.9])
    assert epochs.extract(s, ev, RATE, -0.2, 0.3).select("epoch").distinct().count() == 3
    kept = epochs.extract(s, ev, RATE, -0.2, 0.3, reject=100.0)
    assert sorted(r[0] for r in kept.select("epoch").distinct().collect()) == [1, 2]


def test_variable_length_epochs(spark):
    s = signal(spark, a=np.random.default_rng(1).normal(size=1000))
    ev = events.add_events(events.make_events(spark, [1.0, 3.0, 5.0], 0.0, "start"), events.make_events(spark, [1.3, 3.5, 5.2], 0.0, "response"))
    cut = epochs.extract(s, ev, RATE, 0.0, "response", event_type="start")
    assert [r["n"] for r in cut.groupBy("epoch").agg(F.count("*").alias("n")).orderBy("epoch").collect()] == [31, 51, 21]


def test_events(spark):
    ev = events.make_events(spark, [3.0, 1.0, 2.0], 0.0, ["a", "b", "a"], "v")
    assert [r["onset"] for r in ev.collect()] == [1.0, 2.0, 3.0]
    assert events.remove_events(ev, ["a"]).count() == 1
    assert events.remove_events(ev, None, [1, 2]).count() == 1
    assert events.remove_events(ev).count() == 0
    assert events.EventQuery(ev).type("a").value("v").resolve().count() == 2
    assert events.with_defaults(spark.createDataFrame([(1.0,)], "onset double")).first()["type"] == "event"
    with pytest.raises(ValueError):
        events.make_events(spark, [1.0], [1.0, 2.0])


def test_missing_values(spark):
    s = signal(spark, a=[None, 1, None, 3, None], b=[None] * 5)
    assert values(missing.interpolate(s)) == [1, 1, 2, 3, 3]
    assert values(missing.interpolate(s), "b") == [None] * 5
    assert values(missing.fill_last(s)) == [1, 1, 1, 3, 3]
    assert values(missing.fill_mean(s)) == [2, 1, 2, 3, 2]
    assert values(missing.fill_edges(s)) == [1, 1, None, 3, 3]
    assert values(missing.fill_edges(s, "zero")) == [0, 1, None, 3, 0]
    assert missing.summary(s).filter("channel = 'a'").first()["n_na"] == 3
    assert missing.has_missing(s)
    with pytest.raises(ValueError):
        missing.replace(s, "omit")
    with pytest.raises(ValueError):
        missing.handle(s, "unknown")


def test_along_samples(spark):
    s = signal(spark, a=[0, 1, 4, 9, 16, 25])
    assert values(sequence.moving_average(s, 3)) == [None, 5 / 3, 14 / 3, 29 / 3, 50 / 3, None]
    assert values(sequence.moving_average(s, 7)) == [0, 1, 4, 9, 16, 25]
    assert values(sequence.teager_kaiser(s)) == [0, 1, 7, 17, 31, 0]
    assert np.allclose(values(sequence.detrend(signal(spark, a=[1, 3, 5, 7]))), 0)
    assert np.allclose(values(sequence.zscore(signal(spark, a=[2, 2, 2]))), 0)
    p = sequence.peaks(signal(spark, a=[0, 2, 0, 3, 0, 1, 0]), 0.5)
    assert [r["sample"] for r in p.orderBy("sample").collect()] == [2, 4, 6]
    far = sequence.peaks(signal(spark, a=[0, 2, 0, 3, 0, 1, 0]), 0.5, 3)
    assert [r["sample"] for r in far.orderBy("sample").collect()] == [2, 6]
    c = sequence.crossings(signal(spark, a=[0, 1, 0, 1]), 0.5, "both")
    assert [(r["sample"], r["rising"]) for r in c.orderBy("sample").collect()] == [(2, True), (3, False), (4, True)]


def test_islands_bridge_gaps(spark):
    s = signal(spark, a=[0, 5, 5, 0, 5, 0, 0, 0, 5])
    found = sequence.islands(s, F.col("value") > 1, 2).orderBy("start").collect()
    assert [(r["start"], r["end"], r["extent"]) for r in found] == [(2, 5, 3), (9, 9, 1)]


def test_adjusted_p(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.05, 0.5, 0.6, 0.7, 0.8, 0.9, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    bh = {r["i"]: r["p_adjusted"] for r in sequence.adjust_p(df).collect()}
    bonferroni = {r["i"]: r["p_adjusted"] for r in sequence.adjust_p(df, method="bonferroni").collect()}
    assert bh[10] is None and np.isclose(bh[0], 0.1) and np.isclose(bonferroni[1], 0.2)
    assert all(bh[i] <= bonferroni[i] + 1e-12 for i in range(10))


def test_filters(spark):
    t = np.arange(1000) / 500
    s = signal(spark, a=np.sin(2 * np.pi * 10 * t) + 0.5 * np.sin(2 * np.pi * 50 * t))
    low = np.array(values(filters.butterworth_filter(s, 500.0, high=20.0)))
    assert np.abs(low - np.sin(2 * np.pi * 10 * t))[100:-100].max() < 0.02
    notched = np.array(values(filters.notch_filter(s, 500.0, 50.0)))
    assert np.abs(notched - np.sin(2 * np.pi * 10 * t))[200:-200].max() < 0.05
    fir = np.array(values(filters.fir_filter(s, 500.0, high=25.0)))
    assert np.abs(fir - np.sin(2 * np.pi * 10 * t))[200:-200].max() < 0.05
    with pytest.raises(ValueError):
        filters.butterworth(4, (1.2,), "low")


@pytest.mark.parametrize("kind,edges", [("low", (0.2,)), ("high", (0.3,)), ("pass", (0.1, 0.3)), ("stop", (0.1, 0.3))])
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_butterworth_response(kind, edges, order):
    sections = filters.butterworth(order, edges, kind)
    at = lambda f: np.prod([abs((s[:3] @ np.exp(-1j * np.pi * f * np.arange(3))) / (s[3:] @ np.exp(-1j * np.pi * f * np.arange(3)))) for s in sections])
    for e in edges:
        assert np.isclose(at(e), np.sqrt(0.5), atol=1e-6)
    assert np.all(np.abs(np.roots(sections[0][3:])) < 1)
    passing = {"low": 1e-9, "high": 1.0, "stop": 1e-9, "pass": 2 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * 0.05) * np.tan(np.pi * 0.15)))}[kind]
    assert np.isclose(at(passing), 1, atol=1e-6)


def test_section_blocks_equal_recursion():
    section = filters.butterworth(2, (0.1,), "low")[0]
    x = np.random.default_rng(2).normal(size=1000)
    y, z = np.zeros(1000), np.zeros(2)
    for i, v in enumerate(x):
        y[i] = section[0] * v + z[0]
        z = np.array([section[1] * v - section[4] * y[i] + z[1], section[2] * v - section[5] * y[i]])
    assert np.allclose(filters.run_section(section, x, np.zeros(2))[0], y)


def test_resampling_and_reference(spark, two):
    assert np.allclose(values(filters.resample_linear(two, RATE, 50.0)), values(filters.resample(two, RATE, 50.0)))
    spline = np.array(values(filters.resample(two, RATE, 200.0, "spline")))
    assert spline.size == 2000 and np.abs(spline - np.sin(2 * np.pi * 5 * np.linspace(0, 9.99, 2000)))[10:-10].max() < 1e-3
    assert len(values(filters.decimate(two, RATE, 4))) == 250
    ref = filters.rereference(two)
    assert np.allclose(values(ref), 0.1 * SINE)
    only = filters.rereference(two, "channel", ["b"], keep=False)
    assert np.allclose(values(only), 0.2 * SINE) and only.filter("channel = 'b'").isEmpty()


def test_spectra(spark):
    t = np.arange(1000) / 500
    s = signal(spark, a=np.sin(2 * np.pi * 10 * t) + 0.5 * np.sin(2 * np.pi * 30 * t))
    psd = spectral.welch(s, 500.0).orderBy(F.desc("power")).first()
    assert abs(psd["frequency"] - 10) < 2
    share = spectral.band_power(s, 500.0, relative=True).agg(F.sum("power")).first()[0]
    assert np.isclose(share, 1)
    amplitude = np.array(values(spectral.amplitude(spectral.hilbert(signal(spark, a=np.sin(2 * np.pi * 10 * t))))))
    assert np.allclose(amplitude[50:-50], 1, atol=1e-2)
    power = spectral.wavelet(s, 500.0, [10.0, 20.0, 30.0]).groupBy("frequency").agg(F.avg("power").alias("p")).orderBy("frequency").collect()
    assert power[0]["p"] > power[2]["p"] > power[1]["p"]
    assert np.allclose(values(spectral.fft_magnitude(s)), np.abs(np.fft.fft(np.sin(2 * np.pi * 10 * t) + 0.5 * np.sin(2 * np.pi * 30 * t))))


def test_connectivity(spark):
    rng = np.random.default_rng(3)
    t = np.arange(1000) / RATE
    x = np.sin(2 * np.pi * 10 * t)
    s = signal(spark, a=x, b=np.sin(2 * np.pi * 10 * t - np.pi / 4), c=rng.normal(size=1000)).cache()
    of = lambda df: {(r["a"], r["b"]): r["value"] for r in df.collect()}
    plv, pli, wpli = of(connectivity.plv(s, RATE, (8, 12))), of(connectivity.pli(s, RATE, (8, 12))), of(connectivity.wpli(s, RATE, (8, 12)))
    assert plv["a", "b"] > 0.99 and pli["a", "b"] > 0.99 and wpli["a", "b"] > 0.99 and plv["a", "c"] < 0.9
    corr = of(connectivity.correlation(s))
    assert np.isclose(corr["a", "b"], np.cos(np.pi / 4), atol=1e-2)
    assert all(0 <= r["value"] <= 1 + 1e-9 for r in connectivity.coherence(s, RATE, 64).collect())
    y = rng.integers(0, 5, 60).astype(float)
    z = rng.integers(0, 5, 60).astype(float)
    sign = np.sign(y[:, None] - y) * np.sign(z[:, None] - z)
    brute = sign.sum() / np.sqrt((np.sign(y[:, None] - y) ** 2).sum() * (np.sign(z[:, None] - z) ** 2).sum())
    assert np.isclose(connectivity.kendall(y, z), brute)


def graph(spark, *edges):
    rows = [(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_networks(spark):
    k3 = graph(spark, ("1", "2"), ("2", "3"), ("1", "3"))
    assert all(r["clustering"] == 1 for r in network.clustering(k3).collect())
    assert all(np.isclose(r["clustering"], 1) for r in network.clustering(k3, True).collect())
    assert network.efficiency(k3).first()[0] == 1
    star = graph(spark, *[("hub", str(i)) for i in range(4)])
    rows = {r["node"]: r for r in network.node_metrics(star).collect()}
    assert np.isclose(rows["hub"]["betweenness"], 1) and rows["hub"]["eigenvector"] > rows["1"]["eigenvector"] and rows["1"]["betweenness"] == 0
    split = graph(spark, ("1", "2"), ("2", "3"), ("1", "3"), ("4", "5"), ("5", "6"), ("4", "6"))
    parts = spark.createDataFrame([(str(i), i > 3) for i in range(1, 7)], "node string, community boolean")
    assert np.isclose(network.modularity(split, parts).first()[0], 0.5)
    found = {r["node"]: r["cluster"] for r in network.clusters(split, 2).collect()}
    assert found["1"] == found["2"] == found["3"] != found["4"]
    d = {(r["src"], r["dst"]): r["distance"] for r in network.path_lengths(graph(spark, ("1", "2"), ("2", "3"), ("3", "4"))).collect()}
    assert d["1", "4"] == 3 and d["1", "3"] == 2
    assert np.isinf(network.distances(np.zeros((2, 2)))[0, 1])
    total = network.laplacian(k3).groupBy("src").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-12 for r in total)
    degrees = network.rewire(network.matrix_of(split.toPandas())[1], np.random.default_rng(1)).sum(axis=1)
    assert (degrees == 2).all()


def epoched(spark, data, conditions):
    rows = [(e + 1, conditions[e], t + 1, str(c + 1), float(data[t, c, e])) for t in range(data.shape[0]) for c in range(data.shape[1]) for e in range(data.shape[2])]
    return spark.createDataFrame(rows, "epoch int, condition int, sample long, channel string, value double")


def test_statistics(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(50, 2, 20))
    data[20:30, :, 10:] += 3
    e = epoched(spark, data, [0] * 10 + [1] * 10).cache()
    t = {(r["sample"], r["channel"]): r for r in stats.with_p(stats.t_test(e, 1, 0)).collect()}
    a, b = data[25, 0, 10:], data[25, 0, :10]
    va, vb = a.var(ddof=1) / 10, b.var(ddof=1) / 10
    assert np.isclose(t[26, "1"]["t"], (a.mean() - b.mean()) / np.sqrt(va + vb)) and t[26, "1"]["p"] < 0.001
    f = {(r["sample"], r["channel"]): r["f"] for r in stats.anova(e).collect()}
    pooled = (a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2 * 0.2)
    assert np.isclose(f[26, "1"], pooled**2)
    best = stats.cluster_permutation(e, 1, 0, 100).orderBy(F.desc(F.abs("statistic"))).first()
    assert best["p"] <= 0.05 and 19 <= best["first_sample"] <= 22 and 29 <= best["last_sample"] <= 32
    ci = stats.bootstrap_ci(e, 100, condition=1).collect()
    assert sum(r["low"] <= r["mean"] <= r["high"] for r in ci) >= 98
    _, clusters = stats.spm(stats.t_test(e.filter("channel = '1'").drop("channel"), 1, 0, equal_var=True))
    top = clusters.orderBy(F.desc("extent")).first()
    assert top["start"] >= 20 and top["end"] <= 31 and 0 < top["p"] < 1
    d = stats.effect_size(e, 1, 0).filter("sample = 26 AND channel = '1'").first()
    assert d["low"] < d["d"] < d["high"]


def test_permutations_by_blocks():
    """The shares of all blocks add up to the chosen ones, and each epoch is chosen as often as in shuffled labels."""
    n, size, chosen = 1000, 64, np.full(4000, 300)
    shares = np.stack([stats.shares_of_block(b, size, n, chosen, 5) for b in range(16)])
    assert (shares.sum(axis=0) == 300).all() and (shares[-1] <= 40).all()
    expected = 300 * np.r_[np.full(15, 64), 40] / n
    assert np.allclose(shares.mean(axis=1), expected, atol=0.3)
    # the variance of a hypergeometric number, and the covariance of two
    k = 64 / n
    assert np.isclose(shares[3].var(), 300 * k * (1 - k) * 700 / 999, rtol=0.1)
    assert np.isclose(np.cov(shares[0], shares[9])[0, 1], -300 * k * k * 700 / 999, rtol=0.4)


def test_draws_equal_plain_sums(spark, monkeypatch):
    """Sums over blocks of few epochs, some values missing and some absent, equal those over all epochs with the same weights."""
    monkeypatch.setattr(stats, "EPOCHS", 4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(23, 6))
    v[3, 2] = v[7, 5] = np.nan
    rows = [(e * 7, e % 2, 10 + p // 2, "ab"[p % 2], None if np.isnan(v[e, p]) else float(v[e, p])) for e in range(23) for p in range(6) if (e, p) != (11, 0)]
    v[11, 0] = np.nan
    d = spark.createDataFrame(rows, "epoch long, condition int, sample long, channel string, value double")
    blocks, samples, channels, n, n_first, size = stats._epoch_blocks(d, 1)
    assert (samples, channels, n, n_first, size) == ([10, 11, 12], ["a", "b"], 23, 11, 4)
    weights = lambda b, m: np.random.default_rng([3, b]).random((6, m))
    out = stats._drawn_sums(blocks, size, 6, 5, weights, lambda k, s, c: pd.DataFrame({"draw": [k], "s": [s], "c": [c]}), "draw long, s array<double>, c array<double>")
    order = [e for e in range(23) if e % 2 == 1] + [e for e in range(23) if e % 2 == 0]
    w = np.hstack([weights(b, min(4, 23 - 4 * b)) for b in range(6)])
    for r in out.collect():
        assert np.allclose(r["s"], w[r["draw"]] @ np.nan_to_num(v[order])) and np.allclose(r["c"], w[r["draw"]] @ ~np.isnan(v[order]))


def test_labels_are_four_connected():
    over = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [0, 1, 0]], bool)
    label = stats.label_clusters(over)
    assert label[0, 0] == label[0, 2] != label[3, 1] and label[2, 0] == 0 and label.max() == 2


def test_decomposition(spark):
    rng = np.random.default_rng(5)
    src = np.stack([np.sign(np.sin(np.arange(600) / 9)), rng.uniform(-1, 1, 600)])
    mixed = np.array([[1.0, 0.5], [0.3, 1.0]]) @ src
    s = signal(spark, a=mixed[0], b=mixed[1]).cache()
    model = decomposition.ica(s)
    got = np.array([[r["value"] for r in model.sources.filter(F.col("channel") == k).orderBy("sample").collect()] for k in (1, 2)])
    corr = np.abs(np.corrcoef(np.vstack((src, got)))[:2, 2:])
    assert corr.max(axis=1).min() > 0.95
    back = decomposition.remove_components(model, [])
    assert np.allclose(values(back), mixed[0], atol=1e-8)
    assert decomposition.classify_components(model.sources, RATE).count() == 2
    w, h, share = decomposition.nmf(np.abs(rng.random((4, 2)) @ rng.random((2, 50))), 2)
    assert share > 99 and np.allclose(np.linalg.norm(w, axis=0), 1)
    table = decomposition.synergy_table(s, 2, "pca")
    same = decomposition.synergy_similarity(table, table).filter("left = right").collect()
    assert all(np.isclose(r["similarity"], 1) for r in same)
    assert decomposition.match_synergies(decomposition.synergy_similarity(table, table)).count() == 2


def test_components_come_from_blocks(spark, monkeypatch):
    """Sources and what is rebuilt from them need no aggregation over samples: a task projects its blocks. Samples that lack a channel are left out."""
    monkeypatch.setattr(decomposition, "BLOCK", 64)
    rng = np.random.default_rng(9)
    x = np.array([[1.0, 0.5, 0.1], [0.3, 1.0, 0.2], [0.2, 0.1, 1.0]]) @ rng.uniform(-1, 1, (3, 500)) + [[5], [0], [-2]]
    lacking = [*x[1]]
    lacking[100] = None
    s = signal(spark, a=x[0], b=lacking, c=x[2])
    model = decomposition.ica(s)
    full = np.delete(x, 100, axis=1)
    for k in (1, 2, 3):
        assert np.allclose(values(model.sources.withColumn("channel", F.col("channel").cast("string")), str(k)), model.unmixing[k - 1] @ (full - model.mean[:, None]), atol=1e-9)
    kept = model.mixing.copy()
    kept[:, 1] = 0
    rebuilt = decomposition.remove_components(model, [2])
    assert np.allclose(values(rebuilt, "c"), (kept @ model.unmixing @ (full - model.mean[:, None]) + model.mean[:, None])[2], atol=1e-9)
    for made in (model.sources, rebuilt):
        plan = made._jdf.queryExecution().toString()
        assert "Aggregate" not in plan and "Exchange" not in plan


def test_artifacts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4, 500))
    x[0, 100:110] = 100
    s = signal(spark, a=x[0], b=x[1], c=x[2], d=x[3] * 1e-4).cache()
    found = artifacts.detect_artifacts(s, RATE).filter("channel = 'a' AND peak > 50").first()
    assert found["onset"] == 1.0 and found["offset"] == 1.1
    assert [r["channel"] for r in artifacts.bad_channels(s, "flat").filter("bad").collect()] == ["d"]
    fixed = artifacts.interpolate_bad(s, ["d"])
    assert np.allclose(values(fixed, "d"), x[:3].mean(axis=0))
    clean = artifacts.clean_recording(Recording(s, RATE), ("bad_channels",))
    assert clean.metadata["interpolated_channels"]


def test_muscle(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=1000) * 0.1
    x[500:700] += 5
    s = signal(spark, a=x, b=np.abs(x))
    burst = emg.bursts(s.filter("channel = 'a'"), RATE, 0.5, k=5.0).collect()
    assert len(burst) == 1 and burst[0]["start"] == 501 and burst[0]["end"] == 700
    double = emg.bursts(s.filter("channel = 'a'"), RATE, 0.5, k=5.0, off_k=2.0, method="double").collect()
    assert double[0]["start"] == 501
    assert np.isclose(max(values(emg.normalize(emg.rectify(s)), "b")), 100, atol=10)
    assert emg.time_features(s).filter("channel = 'a'").first()["iemg"] > 0
    assert emg.warp(np.array([0, 1, 2.0]), np.array([0, 0, 1, 2.0]))[0] == 0
    assert len(values(emg.to_percent(s))) == 101
    both = emg.cocontraction(s, "a", "b").agg(F.min("value"), F.max("value")).first()
    assert np.isclose(both[0], 1) and np.isclose(both[1], 1)
    assert emg.firing(s, RATE).count() == 2


def test_warping_together(spark):
    """Vectors that share a walk have the distances they have alone, whatever their lengths; a walk takes less time than its vectors one by one."""
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=(1, 5, 9, 9)[i % 4]).tolist() for i in range(12)}
    references = {"p": rng.normal(size=9).tolist(), "q": rng.normal(size=3).tolist()}
    tables = [spark.createDataFrame(list(t.items()), f"id {k}, values array<double>") for t, k in ((vectors, "long"), (references, "string"))]
    found = {(r["id"], r["reference"]): r["distance"] for r in emg.warp_distances(*tables).collect()}
    assert found == {(i, k): emg.warp(np.array(v), np.array(y))[0] for i, v in vectors.items() for k, y in references.items()}
    x, y = rng.normal(size=(200, 64)), rng.normal(size=64)
    start = time.perf_counter()
    together = emg.warp_costs(x, y)
    middle = time.perf_counter()
    alone = [emg.warp(v, y)[0] for v in x[:50]]
    assert together[:50].tolist() == alone
    assert middle - start < time.perf_counter() - middle


def test_selection(spark, two):
    assert select.time_window(two, RATE, 0.5, 1.0).agg(F.max("sample")).first()[0] == 51
    assert select.pick_channels(two, ["b", "a", "b"]).count() == 3000
    with pytest.raises(ValueError):
        select.pick_channels(two, ["zz"])
    assert select.bind_channels(two, two).select("channel").distinct().count() == 4
    assert select.bind_time(two, two).agg(F.max("sample")).first()[0] == 2000
    chans = select.channel_table(spark, [("a", "Fz"), ("b", None)])
    assert sorted(r["label"] for r in select.channel_labels(chans).collect()) == ["Ch2", "Fz"]
    assert select.apply_montage(chans).filter("label = 'Fz'").first()["pos_z"] is not None
    first = select.wide(two, ["a", "b"], RATE).orderBy("time").first()
    assert first["time"] == 0


def test_recording(two):
    rec = Recording(two, RATE)
    assert rec.n_channels() == 2 and rec.n_samples() == 1000 and rec.duration() == 10
    more = rec.add_assay("z", sequence.zscore(two), 50.0)
    assert more.assays == ("raw", "z") and more.assay_rates() == {"raw": RATE, "z": 50.0}
    assert more.assay("z").count() == 2000 and "Recording" in repr(more)
    with pytest.raises(ValueError):
        Recording(two, -1.0)
    with pytest.raises(ValueError):
        Recording(two).rate()


def test_views(spark):
    pos = spark.createDataFrame([("a", 0.0, 0.5, 0.0), ("b", 0.5, 0.0, 0.0), ("c", -0.5, -0.5, 0.0)], "channel string, pos_x double, pos_y double, pos_z double")
    val = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "channel string, value double")
    grid = views.topomap(val, pos, 16)
    assert all(np.isclose(r["value"], 1) for r in grid.collect())
    with pytest.raises(ValueError):
        views.topomap(val.limit(2), pos)
    for kind in ("circle", "grid", "spring"):
        assert len(views.layout(["a", "b", "c"], kind, [("a", "b", 1.0)])) == 3


def test_workflows(spark):
    from signalweave.model import Recording
    from signalweave.operators import events
    from signalweave.plans import workflows

    rng = np.random.default_rng(3)
    s = signal(spark, a=rng.normal(size=1500), b=rng.normal(size=1500), c=rng.normal(size=1500)).cache()
    marks = events.make_events(spark, [1.0, 2.5, 4.0, 6.0, 8.0, 10.0], 0.0, ["x", "y"] * 3, "")
    recording = Recording(s, 100.0, events=marks)
    for name in workflows.WORKFLOWS:
        tables = workflows.run(name, recording)
        assert list(tables) == [m for m, required, _ in workflows.WORKFLOWS[name] if required and m in workflows.METHODS]
        assert all(not t.isEmpty() for k, t in tables.items() if k not in ("onsetDetection", "synergyVAF"))
    more = workflows.run("eegERP", recording, ("clusterPermutation", "effectSize"), clusterPermutation={"n": 20})
    assert set(more) >= {"clusterPermutation", "effectSize", "ttest"} and more["ttest"].filter("p < 0 OR p > 1").isEmpty()
    with pytest.raises(ValueError, match="unknown"):
        workflows.run("none", recording)


def test_references_are_remembered(spark):
    from signalweave.model import Recording

    x = filters.rereference_recording(Recording(signal(spark, a=[1.0, 2.0], b=[3.0, 5.0]), 10.0), "channel", ["a"], keep=False)
    assert filters.current_reference(x) == "a" and not filters.is_average_referenced(x)
    assert [r["value"] for r in x.signals.orderBy("sample").collect()] == [2.0, 3.0] and x.metadata["previous_reference"] is None


def test_missing_values_in_recursive_filters(spark):
    x = filters.butterworth_filter(signal(spark, a=[1.0, None, 2.0, 3.0], b=[1.0, 1.0, 1.0, 1.0]), 10.0, high=2.0)
    assert x.filter("channel = 'a' AND value IS NOT NULL").isEmpty() and x.filter("channel = 'b'").count() == 4


def test_unnormalised_betweenness_counts_both_directions():
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1
    assert network.betweenness(star, False).tolist() == [6, 0, 0, 0] and network.betweenness(star).tolist() == [1, 0, 0, 0]


def test_pseudoinverse_and_orthogonalization():
    m = np.array([[1.0, 2.0], [2.0, 4.0], [0.0, 1.0]])
    p = decomposition.pseudoinverse(m)
    assert np.allclose(m @ p @ m, m)
    q = decomposition.orthogonalize(m[:2] + np.eye(2))
    assert np.allclose(q @ q.T, np.eye(2))


def test_mixed_rates_and_annotations_in_edf(spark, tmp_path):
    """A slower channel is read at the rate of the fastest."""
    from signalweave.model import Recording
    from signalweave.sources import binary

    fast, slow = np.arange(40.0), np.array([0.0, 10.0, 20.0, 30.0])
    head = lambda *v: b"".join(str(x)[:w].ljust(w).encode() for x, w in v)
    data = head(("0", 8), ("X", 80), ("X", 80), ("01.01.00", 8), ("00.00.00", 8), (256 * 3, 8), ("", 44), (2, 8), (1, 8), (2, 4))
    for pair, w in (("fs", 16), (("", ""), 80), (("uV", "uV"), 8), ((-32768, -32768), 8), ((32767, 32767), 8), ((-32768, -32768), 8), ((32767, 32767), 8), (("", ""), 80), ((20, 2), 8), (("", ""), 32)):
        data += head(*[(v, w) for v in pair])
    for k in range(2):
        data += fast[20 * k : 20 * k + 20].astype("<i2").tobytes() + slow[2 * k : 2 * k + 2].astype("<i2").tobytes()
    (tmp_path / "mixed.edf").write_bytes(data)
    back = binary.read_edf(spark, str(tmp_path / "mixed.edf"))
    assert back.sampling_rate == 20.0
    values = {r["sample"]: r["value"] for r in back.signals.filter("channel = 's'").collect()}
    assert len(values) == 40 and values[1] == 0 and values[11] == 10 and np.isclose(values[6], 5)
    assert isinstance(back, Recording) and [r["value"] for r in back.signals.filter("channel = 'f'").orderBy("sample").collect()] == fast.tolist()


def test_synergies_by_blocks_of_samples(spark, monkeypatch):
    """Sums over blocks explain what the factorisation of the whole matrix does; missing samples are left out; no block is special."""
    rng = np.random.default_rng(7)
    x = np.abs(rng.random((5, 2))) @ np.abs(rng.normal(size=(2, 900))) + 0.05 * rng.random((5, 900))
    names = ["p", "q", "r", "s", "t"]
    rows = [(c, j + 1, None if (i, j) == (2, 400) else float(x[i, j])) for i, c in enumerate(names) for j in range(900)]
    signals = spark.createDataFrame(rows, "channel string, sample long, value double").repartition(6)
    full = np.delete(x, 400, axis=1)
    monkeypatch.setattr(decomposition, "BLOCK", 100)
    blocks = decomposition.sample_blocks(signals)
    assert blocks.names == names and blocks.table.count() == 9
    assert np.allclose(decomposition.correlations(blocks), np.corrcoef(full), atol=1e-12)
    fitted = decomposition.factorize(blocks, [1, 2, 3])
    for k in (1, 2, 3):
        dense = decomposition.nmf(full, k)[2]
        w, share = fitted[k]
        assert share > dense - 0.05 and np.allclose(np.linalg.norm(w, axis=0), 1) and (w >= 0).all()
        assert np.isclose(share, decomposition.explained(full, w @ decomposition.activations_of(full.T, w).T), atol=1e-6)
    chosen = [r["n"] for r in decomposition.optimal_synergies(signals, 3).collect() if r["chosen"]]
    assert chosen == [min(k for k in fitted if fitted[k][1] >= 90)]
    table = decomposition.synergy_table(signals, 2)
    h = decomposition.synergy_activations(signals, table).toPandas().pivot(index="synergy", columns="sample", values="value").to_numpy()
    w = table.toPandas().pivot(index="channel", columns="synergy", values="weight").to_numpy()
    assert h.shape == (2, 899) and np.isclose(decomposition.explained(full, w @ h), fitted[2][1], atol=1e-3)
    nothing = decomposition.optimal_synergies(signals.filter("channel = 'r' AND sample = 401"), 2).collect()
    assert [(r["n"], r["explained"], r["chosen"]) for r in nothing] == [(1, 0.0, False), (2, 0.0, False)]
