"""Artifacts and bad channels (rows EP5-EP7, EP9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import along, keys_of, ratio, whole
from .sequence import islands

#: Scale of the median absolute deviation for a normal distribution.
MAD_SCALE = 1.4826


def median_and_mad(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact median and scaled MAD per group, in two aggregations."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("middle"))
    joined = rows.join(middle, by) if by else rows.join(F.broadcast(middle))
    return joined.groupBy(*by, "middle").agg((F.median(F.abs(F.col(value) - F.col("middle"))) * MAD_SCALE).alias("mad"))


def detect_artifacts(signals: DataFrame, rate: float, method: str = "amplitude", threshold: float | None = None, window: float = 0.1) -> DataFrame:
    """EP5: stretches with large values or steps: keys, onset and offset (seconds), extent, peak.

    The threshold of a series is its median plus 5 scaled MADs, unless given. Stretches nearer
    than ``window`` seconds are one.
    """
    if method == "amplitude":
        size = F.abs("value")
    elif method == "gradient":
        size = F.coalesce(F.abs(F.col("value") - F.lag("value").over(along(signals))), F.lit(0.0))
    else:
        raise ValueError("method must be amplitude or gradient")
    keys = keys_of(signals)
    rows = signals.withColumn("value", size)
    if threshold is None:
        limits = median_and_mad(rows, "value", keys).select(*keys, (F.col("middle") + 5 * F.col("mad")).alias("limit"))
        rows = rows.join(limits, keys).filter(F.col("value") > F.col("limit")).select(*keys, "sample", "value")
    else:
        rows = rows.filter(F.col("value") > threshold)
    found = islands(rows, F.lit(True), round(window * rate))
    return found.select(*keys, ((F.col("start") - 1) / F.lit(float(rate))).alias("onset"), (F.col("end") / F.lit(float(rate))).alias("offset"), "extent", "peak")


def bad_channels(signals: DataFrame, method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """EP6: channel, score, bad. ``zscore``: variance against the median in MADs; ``correlation``:
    mean absolute correlation with all channels less 1/n; ``flat``: variance against the median."""
    if method == "correlation":
        from .connectivity import correlation

        pairs = correlation(signals)
        both = pairs.select("a", "b", "value").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        n = signals.select("channel").distinct().count()
        score = both.groupBy(F.col("a").alias("channel")).agg((F.sum(F.abs("value")) / n).alias("score"))
        return score.withColumn("bad", F.col("score") < (0.4 if threshold is None else threshold))
    spread = signals.groupBy("channel").agg(F.var_samp("value").alias("variance"))
    if method == "flat":
        middle = spread.agg(F.median("variance").alias("middle"))
        out = spread.join(F.broadcast(middle)).withColumn("score", ratio(F.col("variance"), F.col("middle")))
        return out.select("channel", "score", (F.col("variance") < (0.01 if threshold is None else threshold) * F.col("middle")).alias("bad"))
    if method != "zscore":
        raise ValueError("method must be zscore, correlation or flat")
    limits = median_and_mad(spread, "variance", [])
    out = spread.join(F.broadcast(limits)).withColumn("score", F.abs(F.col("variance") - F.col("middle")) / (F.col("mad") + 1e-10))
    return out.select("channel", "score", (F.col("score") > (3.0 if threshold is None else threshold)).alias("bad"))


def interpolate_bad(signals: DataFrame, bad: list[str], positions: DataFrame | None = None) -> DataFrame:
    """EP7: replace bad channels by the mean of the good ones, weighted by inverse distance where positions
    (channel, pos_x, pos_y, pos_z) are given."""
    keys = keys_of(signals, "channel")
    good = signals.filter(~F.col("channel").isin(*bad))
    if positions is None:
        mean = good.groupBy(*keys, "sample").agg(F.avg("value").alias("value"))
        targets = signals.sparkSession.createDataFrame([(b,) for b in bad], f"channel {signals.schema['channel'].dataType.simpleString()}")
        made = mean.withColumn("channel", F.explode(F.array(*[F.lit(b) for b in bad]))) if bad else mean.join(targets)
    else:
        g, b = positions.filter(~F.col("channel").isin(*bad)).alias("g"), positions.filter(F.col("channel").isin(*bad)).alias("b")
        distance = F.sqrt(sum((F.col(f"g.{p}") - F.col(f"b.{p}")) ** 2 for p in ("pos_x", "pos_y", "pos_z")))
        # electrodes only: a few hundred rows
        weights = g.join(F.broadcast(b), F.lit(True)).select(F.col("g.channel").alias("channel"), F.col("b.channel").alias("target"), (1 / (distance + 1e-10)).alias("w"))
        rows = good.join(weights, "channel")
        made = rows.groupBy(*keys, "target", "sample").agg((F.sum(F.col("w") * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), F.col("w")))).alias("value")).withColumnRenamed("target", "channel")
    return good.unionByName(made.select(*signals.columns))


def robust_scale(signals: DataFrame) -> DataFrame:
    """Each series less its median, in scaled MADs; unchanged scale where the MAD is 0."""
    keys = keys_of(signals)
    limits = median_and_mad(signals, "value", keys)
    scale = F.coalesce(F.nullif(F.col("mad"), F.lit(0.0)), F.lit(1.0))
    return signals.join(limits, keys).withColumn("value", (F.col("value") - F.col("middle")) / scale).select(*signals.columns)


def share_of_peak(signals: DataFrame) -> DataFrame:
    """Each sample as a share of its series' largest absolute value."""
    return signals.withColumn("value", ratio(F.col("value"), F.max(F.abs("value")).over(whole(signals))))


def clean_recording(recording, steps: tuple[str, ...] = ("bad_channels", "ica"), threshold: float | None = None):
    """EP9: find and interpolate bad channels, then remove artifact components. Returns a new recording."""
    from .decomposition import classify_components, ica, remove_components

    signals = recording.signals
    notes = dict(recording.metadata)
    if "bad_channels" in steps:
        bad = [r[0] for r in bad_channels(signals, threshold=threshold).filter("bad").select("channel").collect()]
        signals = interpolate_bad(signals, bad) if bad else signals
        notes["interpolated_channels"] = bad
    if "ica" in steps:
        model = ica(signals)
        flagged = [r[0] for r in classify_components(model.sources, recording.rate()).filter("artifact").select("component").collect()]
        signals = remove_components(model, flagged) if flagged else signals
        notes["removed_components"] = flagged
    return recording.with_signals(signals, metadata=notes)


