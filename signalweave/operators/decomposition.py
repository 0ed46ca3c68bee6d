"""Component and synergy decomposition (rows D1-D9).

Moments between channels are native sums; factorizations of these small matrices run
in numpy. Applying a matrix to the signals is a join with its entries and a sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import stored
from ..model import corr, per_series
from .connectivity import mirror, moments


def covariance(signals: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Channels, means and covariance; n_channels^2 numbers reach the driver."""
    both = mirror(moments(signals.select("channel", "sample", "value")).select("a", "b", F.try_divide(F.col("cxy"), F.col("n") - 1).alias("value")))
    own = signals.groupBy("channel").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance")).collect()
    names = sorted(r["channel"] for r in own)
    at = {c: i for i, c in enumerate(names)}
    mean, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in own:
        mean[at[r["channel"]]], cov[at[r["channel"]], at[r["channel"]]] = r["mean"] or 0.0, r["variance"] or 0.0
    for r in both.collect():
        cov[at[r["a"]], at[r["b"]]] = r["value"] or 0.0
    return names, mean, cov


def project(blocks: SampleBlocks, matrix: np.ndarray, out_names: list, means: np.ndarray, offsets: np.ndarray | None = None) -> DataFrame:
    """channel, sample, value of ``matrix @ (x - means) + offsets``, for each sample that has all channels, by the tasks that hold the blocks."""
    kind = "int" if isinstance(out_names[0], int) else blocks.kind
    names, offsets = np.array(out_names, None if kind == "int" else object), np.zeros(len(out_names)) if offsets is None else offsets

    def run(frames):
        for frame in frames:
            for samples, values in zip(frame["samples"], frame["values"], strict=True):
                if len(samples):
                    made = (np.reshape(values, (-1, len(means))) - means) @ matrix.T + offsets
                    yield pd.DataFrame({"channel": np.tile(names, len(made)), "sample": np.repeat(samples, len(names)), "value": made.ravel()})

    return blocks.table.mapInPandas(run, f"channel {kind}, sample long, value double")


@dataclass
class Components:
    """Sources (channel = component number), with unmixing and mixing matrices over ``names``, the channels of ``blocks``."""

    sources: DataFrame
    names: list
    mean: np.ndarray
    unmixing: np.ndarray
    mixing: np.ndarray
    blocks: SampleBlocks


def pca(signals: DataFrame, n: int | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Channels, eigenvalues (descending) and vectors of the covariance; each vector's largest entry is positive."""
    names, _, cov = covariance(signals)
    values, vectors = np.linalg.eigh(cov)
    order = values.argsort()[::-1][:n]
    vectors = vectors[:, order]
    return names, values[order], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1, 1)


def pca_table(signals: DataFrame, n: int | None = None) -> DataFrame:
    names, values, vectors = pca(signals, n)
    rows = [(k + 1, c, float(values[k]), float(vectors[i, k])) for k in range(len(values)) for i, c in enumerate(names)]
    return signals.sparkSession.createDataFrame(rows, f"component int, channel {signals.schema['channel'].dataType.simpleString()}, eigenvalue double, loading double")


def ica(signals: DataFrame, n: int | None = None, rounds: int = 200, tolerance: float = 1e-6, seed: int = 1) -> Components:
    """Symmetric FastICA with tanh on whitened data.

    Each round needs two sums over samples; tasks take them over stored blocks of samples, so no channel is gathered
    on the driver and no task holds more than a block.
    """
    names, mean, cov = covariance(signals)
    values, vectors = np.linalg.eigh(cov)
    order = [k for k in values.argsort()[::-1] if values[k] > 1e-12 * max(values.max(), 1e-300)][:n]
    white = (vectors[:, order] / np.sqrt(values[order])).T
    blocks = sample_blocks(signals)
    rng = np.random.default_rng(seed)
    w = np.linalg.qr(rng.normal(size=(len(order), len(order))))[0]
    k = len(order)

    def orthogonal(m: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(m)
        return u @ v

    for _ in range(rounds):

        def sums(x: np.ndarray, w=w) -> np.ndarray:
            z = white @ (x.T - mean[:, None])
            g = np.tanh(w @ z)
            return np.concatenate([(g @ z.T).ravel(), (1 - g * g).sum(axis=1), [z.shape[1]]])

        total = sum(blocks.each(sums), np.zeros(k * k + k + 1))  # k^2 numbers per task
        n_all = max(1.0, total[-1])
        first, slope = total[: k * k].reshape(k, k) / n_all, total[k * k : -1] / n_all
        new = orthogonal(first - slope[:, None] * w)
        change = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max(initial=0.0)
        w = new
        if change < tolerance:
            break
    unmixing = w @ white
    return Components(project(blocks, unmixing, list(range(1, k + 1)), mean), names, mean, unmixing, np.linalg.pinv(unmixing), blocks)


def remove_components(model: Components, components: list[int]) -> DataFrame:
    """The signals rebuilt without some components."""
    kept = model.mixing.copy()
    kept[:, [c - 1 for c in components]] = 0.0
    return project(model.blocks, kept @ model.unmixing, model.names, model.mean, model.mean)


def classify_components(sources: DataFrame, rate: float, kurtosis: float = 3.0, autocorrelation: float = 0.9, high_power: float = 0.5) -> DataFrame:
    """D3: component, kurtosis, autocorrelation (lag 1), high_power (share above 30 Hz), artifact."""
    order = Window.partitionBy("channel").orderBy("sample")
    rows = sources.withColumn("before", F.lag("value").over(order))
    n = F.count("value")
    moments = rows.groupBy("channel").agg(((F.kurtosis("value") + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3).alias("kurtosis"), F.abs(corr("value", "before")).alias("autocorrelation"))

    def share(x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2
        f = np.fft.rfftfreq(x.size, 1 / rate)
        return np.array([power[f > 30].sum() / power.sum() if power.sum() > 0 else 0.0])

    high = per_series(sources, share).select("channel", F.col("value").alias("high_power"))
    out = moments.join(high, "channel")
    flag = (F.abs("kurtosis") > kurtosis) | (F.col("autocorrelation") > autocorrelation) | (F.col("high_power") > high_power)
    return out.select(F.col("channel").alias("component"), "kurtosis", "autocorrelation", "high_power", flag.alias("artifact"))


# ---------------------------------------------------------------- synergies
def nmf(data: np.ndarray, k: int, rounds: int = 300, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (channels, k) with unit columns, activations (k, samples) and the share of variance explained (in %)."""
    rng = np.random.default_rng([seed, k])
    x = np.maximum(data, 0)
    w, h = rng.random((len(x), k)) + 0.1, rng.random((k, x.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
    size = np.maximum(np.linalg.norm(w, axis=0), 1e-12)
    w, h = w / size, h * size[:, None]
    return w, h, explained(x, w @ h)


def explained(x: np.ndarray, fitted: np.ndarray) -> float:
    total = ((x - x.mean()) ** 2).sum()
    return float(100 * (1 - ((x - fitted) ** 2).sum() / total)) if total > 0 else 0.0


#: Samples of a block of the matrix (sample, channel).
BLOCK = 4096


@dataclass
class SampleBlocks:
    """The samples that all channels have, as stored blocks of rows. ``table``: samples array<long>, values array<double> (sample after sample)."""

    names: list
    table: DataFrame
    kind: str

    def each(self, fn: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """One vector from each task: the sum of ``fn`` (samples, channels) over its blocks. Vectors are as long as matrices of channels, never of samples."""
        c = len(self.names)

        def run(frames):
            total = None
            for frame in frames:
                for values in frame["values"]:
                    found = fn(np.reshape(values, (-1, c)))
                    total = found if total is None else total + found
            if total is not None:
                yield pd.DataFrame({"sums": [total.tolist()]})

        return [np.array(r["sums"]) for r in self.table.select("values").mapInPandas(run, "sums array<double>").collect()]


def sample_blocks(signals: DataFrame) -> SampleBlocks:
    """Cut the matrix of a recording into blocks of samples. Samples with a missing value in any channel are left out."""
    known = signals.select("channel", "sample", "value").filter("channel IS NOT NULL")
    names = sorted(r["channel"] for r in known.select("channel").distinct().collect())
    at = {c: i for i, c in enumerate(names)}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        samples, row = np.unique(frame["sample"].to_numpy(), return_inverse=True)
        x = np.full((samples.size, len(at)), np.nan)
        x[row, frame["channel"].map(at).to_numpy()] = frame["value"].to_numpy(float)
        full = ~np.isnan(x).any(axis=1)
        return pd.DataFrame({"samples": [samples[full].tolist()], "values": [x[full].ravel().tolist()]})

    blocks = known.groupBy(F.floor((F.col("sample") - 1) / BLOCK)).applyInPandas(run, "samples array<long>, values array<double>")
    return SampleBlocks(names, stored(blocks, "samples"), signals.schema["channel"].dataType.simpleString())


def _descend(fitted: np.ndarray, target: np.ndarray, gram: np.ndarray, sweeps: int) -> np.ndarray:
    """Least squares under non-negativity, one column at a time: ``fitted @ gram`` comes near ``target``. Columns that nothing depends on stay."""
    fitted = fitted.copy()
    for _ in range(sweeps):
        before = fitted.copy()
        for j in range(len(gram)):
            if gram[j, j] > 1e-12:
                fitted[:, j] = np.maximum(fitted[:, j] + (target[:, j] - fitted @ gram[:, j]) / gram[j, j], 0.0)
        if np.abs(fitted - before).max(initial=0.0) <= 1e-7 * np.abs(fitted).max(initial=0.0):
            break
    return fitted


def activations_of(x: np.ndarray, weights: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Activations (samples, k) of samples by given weights; they depend on nothing else, so a lost task is simply run again."""
    gram, target = weights.T @ weights, x @ weights
    start = np.maximum(target @ np.linalg.pinv(gram), 0.0)
    return _descend(start, target, gram, sweeps)


def factorize(blocks: SampleBlocks, ranks: list[int], rounds: int = 60, tolerance: float = 1e-4, starts: int = 3, seed: int = 1) -> dict[int, tuple[np.ndarray, float]]:
    """For each number of synergies the weights (channels, k) with unit columns and the share of variance explained (in %).

    Alternating non-negative least squares. The weights are sent to the tasks, which fit the activations of their blocks and
    return the products that the next weights need; all ranks, and the ``starts`` of each, share a pass, and the best start of a rank stays. No activation is kept between passes, so
    neither the driver nor a task holds more than a block. Negative values count as 0; a start ends when its share grows by less than ``tolerance``.
    """
    c = len(blocks.names)
    parts = blocks.each(lambda x: np.array([len(x), np.maximum(x, 0).sum(), (np.maximum(x, 0) ** 2).sum()]))
    n, level, squares = sum(parts, np.zeros(3))
    spread = squares - level**2 / (n * c) if n else 0.0
    now = {(k, i): np.random.default_rng([seed, k, i]).random((c, k)) + 0.1 for k in ranks for i in range(starts)}
    now = {k: w / np.linalg.norm(w, axis=0) for k, w in now.items()}
    if not spread > 0:
        return {k: (now[k, 0], 0.0) for k in ranks}
    best: dict[tuple[int, int], tuple[np.ndarray, float]] = {k: (w, -np.inf) for k, w in now.items()}
    for _ in range(rounds):

        def products(x: np.ndarray, now=now) -> np.ndarray:
            x = np.maximum(x, 0)
            fits = [(x, activations_of(x, w)) for w in now.values()]
            return np.concatenate([np.concatenate([(x.T @ h).ravel(), (h.T @ h).ravel()]) for x, h in fits])

        sums, at, grown = sum(blocks.each(products)), 0, {}
        for one, w in now.items():
            k = one[0]
            cross, inner = sums[at : at + c * k].reshape(c, k), sums[at + c * k : at + c * k + k * k].reshape(k, k)
            at += c * k + k * k
            share = 100 * (1 - (squares - 2 * (w * cross).sum() + ((w.T @ w) * inner).sum()) / spread)
            if share > best[one][1] + tolerance:
                fitted = _descend(w, cross, inner, 20)
                grown[one] = fitted / np.maximum(np.linalg.norm(fitted, axis=0), 1e-12)
            if share > best[one][1]:
                best[one] = w, float(share)
        now = grown
        if not now:
            break
    return {k: max((best[k, i] for i in range(starts)), key=lambda b: b[1]) for k in ranks}


def synergy_activations(signals: DataFrame, synergies: DataFrame) -> DataFrame:
    """Synergy, sample, value: the activations of a table (synergy, channel, weight), by the tasks that hold the samples."""
    blocks = sample_blocks(signals)
    rows = synergies.collect()  # channels times synergies
    numbers = sorted({r["synergy"] for r in rows})
    weights = np.zeros((len(blocks.names), len(numbers)))
    for r in rows:
        weights[blocks.names.index(r["channel"]), numbers.index(r["synergy"])] = r["weight"]

    def run(frames):
        for frame in frames:
            for samples, values in zip(frame["samples"], frame["values"], strict=True):
                h = activations_of(np.maximum(np.reshape(values, (-1, len(weights))), 0), weights)
                yield pd.DataFrame({"synergy": np.tile(numbers, len(h)), "sample": np.repeat(samples, len(numbers)), "value": h.ravel()})

    return blocks.table.mapInPandas(run, "synergy int, sample long, value double")


def correlations(blocks: SampleBlocks) -> np.ndarray:
    """Correlations of all channels over the samples that all have; moments are taken about the means."""
    c = len(blocks.names)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x - level
        return np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])

    n, sums = 0.0, np.zeros(c)
    for part in blocks.each(lambda x: np.append(x.sum(axis=0), len(x))):
        n, sums = n + part[-1], sums + part[:-1]
    level = sums / max(n, 1.0)
    total = sum(blocks.each(moments), np.zeros(1 + c + c * c))
    cov = total[1 + c :].reshape(c, c) - np.outer(total[1 : 1 + c], total[1 : 1 + c]) / max(n, 1.0)
    with np.errstate(all="ignore"):
        size = np.sqrt(np.diag(cov))
        return cov / np.outer(size, size)


def synergy_table(signals: DataFrame, k: int, method: str = "nmf", seed: int = 1) -> DataFrame:
    """Synergy, channel, weight by nmf, pca or factor analysis (varimax)."""
    if method == "pca":
        names, _, weights = pca(signals, k)
    elif method in ("nmf", "factor"):
        blocks = sample_blocks(signals)
        names, weights = blocks.names, factorize(blocks, [k], seed=seed)[k][0] if method == "nmf" else factor_analysis(correlations(blocks), k)
    else:
        raise ValueError("method must be nmf, pca or factor")
    rows = [(j + 1, c, float(weights[i, j])) for j in range(k) for i, c in enumerate(names)]
    return signals.sparkSession.createDataFrame(rows, f"synergy int, channel {signals.schema['channel'].dataType.simpleString()}, weight double")


def factor_analysis(corr: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Principal-axis factors of a correlation matrix, rotated by varimax."""
    shared = 1 - 1 / np.maximum(np.diag(np.linalg.pinv(corr)), 1.0)
    for _ in range(rounds):
        reduced = corr.copy()
        np.fill_diagonal(reduced, shared)
        values, vectors = np.linalg.eigh(reduced)
        load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
        new = np.minimum((load**2).sum(axis=1), 1.0)
        if np.abs(new - shared).max() < 1e-8:
            break
        shared = new
    return varimax(load)


def varimax(load: np.ndarray, rounds: int = 100) -> np.ndarray:
    turn, before = np.eye(load.shape[1]), 0.0
    for _ in range(rounds):
        now = load @ turn
        u, s, v = np.linalg.svd(load.T @ (now**3 - now * (now**2).mean(axis=0)))
        turn = u @ v
        if s.sum() < before * (1 + 1e-10):
            break
        before = s.sum()
    return load @ turn


def optimal_synergies(signals: DataFrame, largest: int, threshold: float = 90.0, seed: int = 1) -> DataFrame:
    """N, explained (in %), chosen: the smallest n that explains ``threshold``; all n are fitted in the same passes."""
    fitted = factorize(sample_blocks(signals), list(range(1, largest + 1)), seed=seed)
    least = min((n for n, (_, share) in fitted.items() if share >= threshold), default=None)
    rows = [(n, share, n == least) for n, (_, share) in fitted.items()]
    return signals.sparkSession.createDataFrame(rows, "n long, explained double, chosen boolean")


def synergy_similarity(left: DataFrame, right: DataFrame, metric: str = "cosine") -> DataFrame:
    """Left, right, similarity of all synergies of two tables (synergy, channel, weight)."""
    both = left.select(F.col("synergy").alias("left"), "channel", F.col("weight").alias("x")).join(right.select(F.col("synergy").alias("right"), "channel", F.col("weight").alias("y")), "channel")
    dot = F.sum(F.col("x") * F.col("y"))
    table = {"cosine": F.try_divide(dot, F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))), "correlation": corr("x", "y"), "dot": dot}
    if metric not in table:
        raise ValueError(f"metric must be one of {sorted(table)}")
    return both.groupBy("left", "right").agg(table[metric].alias("similarity"))


def match_synergies(similarity: DataFrame) -> DataFrame:
    """Greedy matching, the most similar pair first; a few synergies, so on the driver."""
    rows = sorted(similarity.collect(), key=lambda r: (-abs(r["similarity"] or 0.0), r["left"], r["right"]))
    used_left, used_right, out = set(), set(), []
    for r in rows:
        if r["left"] not in used_left and r["right"] not in used_right:
            used_left.add(r["left"])
            used_right.add(r["right"])
            out.append((r["left"], r["right"], r["similarity"]))
    return similarity.sparkSession.createDataFrame(out, "left int, right int, similarity double")


def pseudoinverse(matrix: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Moore-Penrose inverse; singular values up to ``tolerance`` of the largest count as 0."""
    return np.linalg.pinv(matrix, rcond=tolerance)


def orthogonalize(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to ``matrix``: its singular vectors with unit singular values."""
    left, _, right = np.linalg.svd(matrix, full_matrices=False)
    return left @ right
