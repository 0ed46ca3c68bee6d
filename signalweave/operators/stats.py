"""Statistics over epochs (rows H1-H10).

Moments are native aggregations over epochs; p-values come from Arrow functions on
them. Permutations and bootstrap draws are numbered, seeded by their number and spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.ranks import placed, stored
from ..model import keys_of
from .sequence import islands

#: Columns that describe an epoch rather than a series.
EPOCH_KEYS = ("epoch", "condition", "event_type", "event_value", "event_onset", "rep")
#: Most epochs of a block, whose random weights are made together.
EPOCHS = 256


def _points(epochs: DataFrame) -> list[str]:
    return [*keys_of(epochs, *EPOCH_KEYS), "sample"]


def _one_rep(epochs: DataFrame) -> DataFrame:
    """Replicates of an epoch averaged."""
    if "rep" not in epochs.columns:
        return epochs
    return epochs.groupBy(*[c for c in epochs.columns if c not in ("rep", "value")]).agg(F.avg("value").alias("value"))


def t_test(epochs: DataFrame, first, second=None, mu: float = 0.0, equal_var: bool = False) -> DataFrame:
    """H1: t and df at each point, of condition ``first`` against ``mu`` or against condition ``second``
    (Welch, or pooled with ``equal_var``). NULL where the statistic has no finite value."""
    points, c = _points(epochs), F.col("condition")
    rows = _one_rep(epochs)
    x = F.when(c == first, F.col("value"))
    if second is None:
        m = rows.groupBy(*points).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
        return m.select(*points, F.try_divide(F.col("m") - mu, F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    y = F.when(c == second, F.col("value"))
    m = rows.groupBy(*points).agg(F.avg(x).alias("m1"), F.var_samp(x).alias("v1"), F.count(x).alias("n1"), F.avg(y).alias("m2"), F.var_samp(y).alias("v2"), F.count(y).alias("n2"))
    a, b = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v2"), F.col("n2"))
    if equal_var:
        df = (F.col("n1") + F.col("n2") - 2).cast("double")
        pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), df)
        se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1").cast("double")) + F.try_divide(F.lit(1.0), F.col("n2").cast("double"))))
    else:
        se = F.sqrt(a + b)
        df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, (F.col("n1") - 1).cast("double")) + F.try_divide(b * b, (F.col("n2") - 1).cast("double")))
    return m.select(*points, F.try_divide(F.col("m1") - F.col("m2"), se).alias("t"), df.alias("df"))


def paired_t_test(epochs: DataFrame, pairs: DataFrame) -> DataFrame:
    """H1, paired: t and df of the differences of the epochs in ``pairs`` (epoch1, epoch2) that both have a value."""
    points = _points(epochs)
    rows = _one_rep(epochs).select("epoch", *points, "value")
    a = rows.join(pairs.select(F.col("epoch1").alias("epoch"), "epoch2"), "epoch").select(*points, F.col("epoch2").alias("partner"), F.col("value").alias("x"))
    b = rows.select(F.col("epoch").alias("partner"), *points, F.col("value").alias("y"))
    d = a.join(b, ["partner", *points]).withColumn("d", F.col("x") - F.col("y"))
    m = d.groupBy(*points).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("d").alias("n"))
    return m.select(*points, F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("df"))


def with_p(tests: DataFrame, alternative: str = "two.sided") -> DataFrame:
    """t and df with their p-value."""
    return tests.withColumn("p", dist.t_pvalue(F.col("t"), F.col("df"), alternative))


def anova(epochs: DataFrame, group: str = "condition") -> DataFrame:
    """H2: f, df1, df2 at each point, from the moments of each group."""
    points = _points(epochs)
    g = _one_rep(epochs).groupBy(*points, group).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v")).filter("n > 0")
    sums = g.groupBy(*points).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    return sums.select(*points, F.try_divide(F.try_divide(between, df1), F.try_divide(F.col("within"), df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))


def anova_with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", dist.f_pvalue(F.col("f"), F.col("df1"), F.col("df2")))


def effect_size(epochs: DataFrame, first, second=None, pooled: bool = True) -> DataFrame:
    """H4: Cohen's d at each point with a 95 % interval (low, high)."""
    points, c = _points(epochs), F.col("condition")
    rows = _one_rep(epochs)
    x = F.when(c == first, F.col("value"))
    if second is None:
        m = rows.groupBy(*points).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
        d = F.try_divide(F.col("m"), F.col("s"))
        m = m.withColumn("d", d).withColumn("se", F.sqrt(1 / F.col("n") + F.col("d") * F.col("d") / (2 * F.col("n"))))
    else:
        y = F.when(c == second, F.col("value"))
        m = rows.groupBy(*points).agg(F.avg(x).alias("m1"), F.var_samp(x).alias("v1"), F.count(x).alias("n1"), F.avg(y).alias("m2"), F.var_samp(y).alias("v2"), F.count(y).alias("n2"))
        both = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), (F.col("n1") + F.col("n2") - 2).cast("double"))
        m = m.withColumn("d", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(both if pooled else F.col("v2"))))
        n1, n2 = F.col("n1"), F.col("n2")
        m = m.withColumn("se", F.sqrt((n1 + n2) / (n1 * n2) + F.col("d") * F.col("d") / (2 * (n1 + n2))))
    return m.select(*points, "d", (F.col("d") - 1.96 * F.col("se")).alias("low"), (F.col("d") + 1.96 * F.col("se")).alias("high"))


def _epoch_blocks(rows: DataFrame, first=None) -> tuple[DataFrame, list, list, int, int, int]:
    """Blocks of epochs: block, i, p, v: arrays of the number of the epoch in the block, of the point (time by channel) and of the value, stored.

    Epochs are numbered over the whole table, those of condition ``first`` before the others. Also the samples and channels that make up the points, the numbers of
    epochs and of those of ``first``, and the epochs of a block, fewer the more points there are.
    """
    spark = rows.sparkSession
    if "channel" not in rows.columns:
        rows = rows.withColumn("channel", F.lit("1"))
    # one number per sample and per channel of an epoch
    samples, channels = (sorted(x) for x in rows.agg(F.collect_set("sample"), F.collect_set("channel")).first())
    kind = rows.schema["channel"].dataType.simpleString()
    places = [F.broadcast(spark.createDataFrame(list(zip(x, range(len(x)), strict=True)), f"{c} {k}, _{c} long")) for c, x, k in (("sample", samples, "long"), ("channel", channels, kind))]
    mine = F.col("condition") == first if first is not None else F.lit(True)
    numbered = placed(rows.select("epoch", mine.alias("mine")).distinct(), [F.desc("mine"), F.asc("epoch")], place="number")
    n, n_first = numbered.agg(F.count("*"), F.count_if("mine")).first()
    size = int(np.clip((1 << 20) // max(1, len(samples) * len(channels)), 1, EPOCHS))
    rows = rows.select("epoch", "sample", "channel", "value").join(numbered.drop("mine"), "epoch").join(places[0], "sample").join(places[1], "channel")
    cell = F.struct((F.col("number") % size).alias("i"), (F.col("_sample") * len(channels) + F.col("_channel")).alias("p"), F.col("value").cast("double").alias("v"))
    packed = rows.groupBy(F.floor(F.col("number") / F.lit(size)).alias("block")).agg(F.collect_list(cell).alias("c"))
    return stored(packed.select("block", "c.i", "c.p", "c.v"), "epochs"), samples, channels, n, n_first, size


def _drawn_sums(blocks: DataFrame, size: int, points: int, draws: int, weights, finish, out: str) -> DataFrame:
    """``finish(draw, sums, counts)`` for each draw from 0 to ``draws``.

    sums are those of the values over epochs, times ``weights(block, m)``, a matrix of draws by the m epochs of a block; counts those of the
    weights where values are not missing. Each task makes the weights of its own epochs only and adds these up as a product of matrices, so that draws times points leave it,
    whatever the number of epochs.
    """

    step = max(1, (1 << 20) // points)

    def partial(batches):
        sums, counts = np.zeros((draws + 1, points)), np.zeros((draws + 1, points))
        some = False
        for batch in batches:
            for block, i, p, value in zip(batch["block"], batch["i"], batch["p"], batch["v"], strict=True):
                v = np.full((size, points), np.nan)
                v[np.array(i), np.array(p)] = np.array(value, float)
                v = v[: max(i) + 1]
                w = weights(int(block), len(v))
                known = ~np.isnan(v)
                sums += w @ np.where(known, v, 0.0)
                counts += w.sum(axis=1)[:, None] if known.all() else w @ known
                some = True
        for k in range(0, draws + 1 if some else 0, step):
            at = np.arange(k, min(k + step, draws + 1))
            yield pd.DataFrame({"draw": at, "sums": list(sums[at]), "counts": list(counts[at])})

    # draws go to a task in groups, fewer in each the more points there are
    groups = min(draws + 1, max(32, draws * points // 500_000))

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([finish(int(k), np.sum(part["sums"].to_list(), axis=0), np.sum(part["counts"].to_list(), axis=0)) for k, part in frame.groupby("draw")])

    return blocks.mapInPandas(partial, "draw long, sums array<double>, counts array<double>").groupBy(F.col("draw") % groups).applyInPandas(total, out)


def shares_of_block(block: int, size: int, n: int, chosen: np.ndarray, seed: int) -> np.ndarray:
    """For each draw, how many of ``chosen`` out of n, drawn without replacement, fall in a block of ``size``.

    The range of blocks is halved until the block is left; how many fall in the left half is a hypergeometric number that depends on the
    seed and the half alone, so that all tasks agree on it, and the shares of all blocks add up to ``chosen``.
    """
    low, high = 0, -(-n // size)
    while high - low > 1:
        middle = (low + high) // 2
        left, right = (middle - low) * size, min(n, high * size) - middle * size
        mine = np.random.default_rng([seed, low, high]).hypergeometric(left, right, chosen)
        low, high, chosen = (low, middle, mine) if block < middle else (middle, high, chosen - mine)
    return chosen


def bootstrap_ci(epochs: DataFrame, n_draws: int = 1000, level: float = 0.95, condition=None, seed: int = 1) -> DataFrame:
    """H5: mean, se and interval of each point over resampled epochs.

    Draw k takes each epoch as often as a Poisson(1) number that depends on k and the epoch's block, so draws are sums that combine before
    the shuffle; no array of all epochs is built.
    """
    rows = _one_rep(epochs)
    rows = rows if condition is None else rows.filter(F.col("condition") == condition)
    points = _points(rows)
    blocks, samples, channels, _, _, size = _epoch_blocks(rows)

    def means(draw: int, sums: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            return pd.DataFrame({"draw": draw, "sample": np.repeat(samples, len(channels)), "channel": np.tile(channels, len(samples)), "m": np.where(counts > 0, sums / counts, np.nan)})

    kind = rows.schema["channel"].dataType.simpleString() if "channel" in rows.columns else "string"
    weights = lambda block, m: np.vstack([np.zeros(m), np.random.default_rng([seed, block]).poisson(1.0, (n_draws, m))])
    drawn = _drawn_sums(blocks, size, len(samples) * len(channels), n_draws, weights, means, f"draw long, sample long, channel {kind}, m double").filter("draw > 0 AND NOT isnan(m)")
    tail = (1 - level) / 2
    band = drawn.groupBy(*points).agg(F.stddev_samp("m").alias("se"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return rows.groupBy(*points).agg(F.avg("value").alias("mean")).join(band, points)


# ---------------------------------------------------------------- cluster permutation
def label_clusters(over: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected regions of a boolean (time, channel) map, 0 outside; regions grow from run to run."""
    label = np.zeros(over.shape, int)
    parent: list[int] = [0]

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in np.argwhere(over):
        near = [root(label[p, q]) for p, q in ((i - 1, j), (i, j - 1)) if p >= 0 and q >= 0 and label[p, q]]
        if near:
            label[i, j] = keep = min(near)
            for k in near:
                parent[k] = keep
        else:
            parent.append(len(parent))
            label[i, j] = len(parent) - 1
    roots = np.array([root(k) for k in range(len(parent))])
    _, numbers = np.unique(roots[label], return_inverse=True)
    return numbers.reshape(over.shape) if (label == 0).any() else numbers.reshape(over.shape) + 1


def t_of_sums(drawn: np.ndarray, n: int, n_first: int | None, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """t at each point from sums over epochs; 0 where undefined.

    ``drawn`` are the sums over the first ``n_first`` of two groups, or with flipped signs if there is one;
    ``total`` and ``squares`` the sums of all values and of their squares.
    """
    with np.errstate(all="ignore"):
        if n_first is None:
            t = drawn / n / np.sqrt((squares - drawn**2 / n) / (n - 1) / n)
        else:
            m = n - n_first
            rest = total - drawn
            v = (squares - drawn**2 / n_first - rest**2 / m) / (n - 2)
            t = (drawn / n_first - rest / m) / np.sqrt(v * (1 / n_first + 1 / m))
    return np.where(np.isfinite(t), t, 0.0)


def cluster_sums(t: np.ndarray, limit: float, tail: int) -> tuple[list[float], np.ndarray]:
    sums, marks, count = [], np.zeros(t.shape, int), 0
    for sign in ((1, -1) if tail == 0 else (np.sign(tail),)):
        label = label_clusters(sign * t > limit)
        for k in range(1, label.max(initial=0) + 1):
            count += 1
            marks[label == k] = count
            sums.append(float(t[label == k].sum()))
    return sums, marks


def cluster_permutation(epochs: DataFrame, first, second=None, n_permutations: int = 1000, alpha: float = 0.05, tail: int = 0, seed: int = 1, limit: float | None = None) -> DataFrame:
    """H3: cluster, statistic (sum of t), p, first_sample, last_sample, n_points.

    Clusters of the t map above the t quantile at ``alpha`` (or above ``limit``) are held against the largest
    cluster of each permutation: labels shuffled (a hypergeometric number of them in each block of epochs), or signs flipped for one condition. A permutation's t map follows from
    sums over epochs, which each task takes of its own epochs. A point with a missing value in any epoch has t 0. Without epochs
    there are no clusters.
    """
    rows = _one_rep(epochs)
    wanted = [first] if second is None else [first, second]
    rows = rows.filter(F.col("condition").isin(*wanted)) if "condition" in rows.columns else rows
    blocks, samples, channels, n, n_first, size = _epoch_blocks(rows, None if second is None else first)
    # as many numbers as a map has points
    point = ["sample", *(["channel"] if "channel" in rows.columns else [])]
    v = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    known = rows.groupBy(*point).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(v).alias("k")).toPandas().sort_values(point)
    total, squares = np.full((len(samples), len(channels)), np.nan), np.full((len(samples), len(channels)), np.nan)
    place = {x: i for i, x in enumerate(samples)}, {x: i for i, x in enumerate(channels)}
    for _, row in known[known["k"] == n].iterrows():
        at = place[0][row["sample"]], place[1][row["channel"]] if "channel" in row else 0
        total[at], squares[at] = row["s"], row["q"]
    total, squares = total.ravel(), squares.ravel()
    groups = None if second is None else n_first
    if limit is None:
        limit = dist.t_quantile(1 - alpha / (2 if tail == 0 else 1), max(1, n - (1 if second is None else 2)))

    def weights(block: int, m: int) -> np.ndarray:
        rng = np.random.default_rng([seed, block])
        if second is None:
            return np.vstack([np.ones(m), rng.choice([-1.0, 1.0], (n_permutations, m))])
        mine = shares_of_block(block, size, n, np.full(n_permutations, n_first), seed)
        drawn = rng.permuted(np.tile(np.arange(m), (n_permutations, 1)), axis=1) < mine[:, None]
        return np.vstack([np.arange(block * size, block * size + m) < n_first, drawn]).astype(float)

    def clusters(draw: int, sums: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        t = t_of_sums(np.where(np.isnan(total), np.nan, sums), n, groups, total, squares).reshape(len(samples), len(channels))
        found, marks = cluster_sums(t, limit, tail)
        if draw:
            return pd.DataFrame({"draw": [draw], "cluster": [0], "statistic": [max(map(abs, found), default=0.0)], "first_sample": [0], "last_sample": [0], "n_points": [0]})
        places = [np.argwhere(marks == k)[:, 0] for k in range(1, len(found) + 1)]
        return pd.DataFrame({"draw": 0, "cluster": np.arange(1, len(found) + 1), "statistic": found, "first_sample": [samples[at.min()] for at in places], "last_sample": [samples[at.max()] for at in places], "n_points": [at.size for at in places]})

    drawn = _drawn_sums(blocks, size, len(samples) * len(channels), n_permutations, weights, clusters, "draw long, cluster int, statistic double, first_sample int, last_sample int, n_points int")
    drawn = stored(drawn, "draws")
    counted = drawn.filter("draw > 0").agg(F.collect_list("statistic").alias("null_sums"))  # n_permutations numbers
    mine = drawn.filter("draw = 0").drop("draw")
    return mine.join(F.broadcast(counted)).withColumn("p", F.expr("size(filter(null_sums, x -> x >= abs(statistic))) / size(null_sums)")).drop("null_sums")


# ---------------------------------------------------------------- one-dimensional parametric maps
def fwhm(rows: DataFrame, value: str) -> DataFrame:
    """Fwhm of each map: sqrt(4 ln 2 var(x) / var(step)), between 1 and the length."""
    keys = [c for c in rows.columns if c in ("rec", "channel")]
    x = F.coalesce(F.col(value), F.lit(0.0))
    step = x - F.lag(x).over(Window.partitionBy(*keys).orderBy("sample"))
    found = rows.withColumn("x", x).withColumn("step", step).groupBy(*keys).agg(F.var_samp("x").alias("vx"), F.var_samp("step").alias("vs"), F.count("*").alias("n"))
    width = F.coalesce(F.sqrt(4 * float(np.log(2)) * F.try_divide(F.col("vx"), F.col("vs"))), F.col("n").cast("double"))
    return found.select(*keys, F.greatest(F.lit(1.0), F.least(width, F.col("n").cast("double"))).alias("fwhm"), "n")


def spm(tests: DataFrame, value: str = "t", alpha: float = 0.05, two_tailed: bool = True) -> tuple[DataFrame, DataFrame]:
    """H7-H9: the map with its threshold, and its clusters (start, end, extent, peak, p).

    The threshold is the quantile at alpha over the number of resolution elements (length
    over fwhm). A cluster's p is 1 - (1 - exp(-extent / fwhm)) ^ elements.
    """
    sizes = fwhm(tests, value)
    keys = [c for c in sizes.columns if c not in ("fwhm", "n")]
    limits = []
    freedom = tests.groupBy(*keys).agg(*([F.max("df").alias("df1"), F.lit(0.0).alias("df2")] if value == "t" else [F.max("df1").alias("df1"), F.max("df2").alias("df2")]))
    for row in (sizes.join(freedom, keys) if keys else sizes.join(freedom)).collect():  # one row per map
        share = alpha / (2 if two_tailed and value == "t" else 1) / max(1.0, row["n"] / row["fwhm"])
        limit = dist.t_quantile(1 - share, row["df1"]) if value == "t" else dist.f_quantile(1 - share, row["df1"], row["df2"])
        limits.append((*[row[k] for k in keys], row["fwhm"], row["n"] / row["fwhm"], limit))
    kinds = "".join(f"{k} {tests.schema[k].dataType.simpleString()}, " for k in keys)
    table = F.broadcast(tests.sparkSession.createDataFrame(limits, f"{kinds}fwhm double, resels double, threshold double"))
    curve = tests.join(table, keys) if keys else tests.join(table)
    size = F.abs(value) if two_tailed and value == "t" else F.col(value)
    over = islands(curve.select(*keys, "sample", F.col(value).alias("value"), size.alias("re"), F.col("threshold").alias("im")), F.col("re") > F.col("im"))
    found = over.join(table, keys) if keys else over.join(table)
    return curve, found.withColumn("p", 1 - F.pow(1 - F.exp(-F.col("extent") / F.col("fwhm")), F.greatest(F.lit(1.0), F.col("resels")))).drop("resels")


# ---------------------------------------------------------------- the browser code's variants
#: The error function by a polynomial in 1 / (1 + p x).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def with_normal_p(tests: DataFrame, value: str = "t") -> DataFrame:
    """Two-sided p of a statistic by the normal distribution, whatever its degrees of freedom."""
    x = F.abs(F.col(value)) / float(np.sqrt(2))
    u = 1 / (1 + ERF_P * x)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * u
    return tests.withColumn("p", series * F.exp(-x * x))


def threshold_runs(tests: DataFrame, value: str = "t", limit: float = 2.0) -> DataFrame:
    """Runs of samples with a statistic beyond ``limit`` on either side: start, end and its sum."""
    keys = [c for c in tests.columns if c in ("rec", "channel")]
    order = Window.partitionBy(*keys).orderBy("sample")
    hits = tests.filter(F.abs(F.col(value)) > limit).withColumn("run", F.col("sample") - F.row_number().over(order))
    return hits.groupBy(*keys, "run").agg(F.min("sample").alias("start"), F.max("sample").alias("end"), F.sum(value).alias("stat")).drop("run")
