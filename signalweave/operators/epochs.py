"""Epochs around events and averages over them (rows J1, EP1-EP4, EP8, W7, A1-A4, A7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import keys_of, ratio, rint
from .events import pair_events


def onset_sample(onset: Column, rate: float) -> Column:
    """The sample (from 1) nearest an onset in seconds."""
    return rint(onset * rate) + 1


def extract(
    signals: DataFrame,
    events: DataFrame,
    rate: float,
    tmin: float = -0.2,
    tmax: float | str = 0.8,
    event_type: list[str] | str | None = None,
    baseline: tuple[float, float] | None = None,
    reject: float | None = None,
    min_length: float | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """EP1: samples around each event: keys, epoch, event_type, event_value, event_onset, sample (in the epoch), value.

    An epoch that leaves the recording is dropped whole. ``tmax`` may name an end event type;
    each epoch then lasts to the next such event (J2). ``reject`` drops epochs with an absolute value
    above it. Epochs are numbered by onset over those that remain. ``by`` are keys shared by
    signals and events (such as rec). Events are exploded to samples and joined on them, so the
    interval join is an equi-join.
    """
    by = by or []
    pre = abs(round(tmin * rate))
    wanted = [event_type] if isinstance(event_type, str) else event_type
    if isinstance(tmax, str):
        starts = wanted or [r[0] for r in events.select("type").distinct().collect()]
        picked = pair_events(events, starts, tmax, by, min_length)
        picked = picked.withColumn("post", rint((F.col("end_onset") - F.col("onset")) * rate)).withColumn("longest", F.max("post").over(Window.partitionBy()))
    else:
        picked = events.filter(F.col("type").isin(*wanted)) if wanted else events
        picked = picked.withColumn("post", F.lit(round(tmax * rate)).cast("long")).withColumn("longest", F.col("post"))
    sizes = signals.groupBy(*by).agg(F.max("sample").alias("n_samples"))
    picked = picked.join(sizes, by) if by else picked.withColumn("n_samples", F.lit(sizes.first()[0]).cast("long"))
    picked = picked.withColumn("at", onset_sample(F.col("onset"), rate))
    picked = picked.filter((F.col("at") - pre >= 1) & (F.col("at") + F.col("longest") <= F.col("n_samples")))
    order = Window.partitionBy(*by).orderBy("onset", "type", "value")
    picked = picked.withColumn("epoch", F.row_number().over(order))
    spots = picked.select(*by, "epoch", F.col("type").alias("event_type"), F.col("value").alias("event_value"), F.col("onset").alias("event_onset"), F.explode(F.sequence(F.col("at") - pre, F.col("at") + F.col("post"))).alias("sample"), (F.col("at") - pre - 1).alias("before"))
    keys = keys_of(signals)
    out = signals.join(spots, [*by, "sample"]).withColumn("sample", F.col("sample") - F.col("before")).drop("before")
    out = out.select(*keys, "epoch", "event_type", "event_value", "event_onset", "sample", "value")
    if baseline is not None:
        out = baseline_correct(out, rate, tmin, baseline)
    if reject is not None:
        out = reject_epochs(out, reject, by=by)
        out = out.withColumn("epoch", F.dense_rank().over(Window.partitionBy(*by).orderBy("epoch"))) if by else _renumber(out)
    return out


def _renumber(epochs: DataFrame) -> DataFrame:
    """Number epochs 1..n; the numbering is made on the few epochs and joined back."""
    numbers = epochs.select("epoch").distinct().withColumn("number", F.row_number().over(Window.orderBy("epoch")))
    return epochs.join(numbers, "epoch").withColumn("epoch", F.col("number")).drop("number").select(*epochs.columns)


def epoch_time(rate: float, tmin: float) -> Column:
    """EP2: seconds from the event of a sample of an epoch."""
    return (F.col("sample") - 1 - abs(round(tmin * rate))) / F.lit(float(rate))


def _baseline_samples(rate: float, tmin: float, window: tuple[float, float]) -> Column:
    time = epoch_time(rate, tmin)
    return (time >= window[0] - 1e-9) & (time <= window[1] + 1e-9)


def baseline_correct(epochs: DataFrame, rate: float, tmin: float, window: tuple[float, float], method: str = "mean") -> DataFrame:
    """EP3: subtract the mean or median of the baseline window from each series of an epoch."""
    inside = F.when(_baseline_samples(rate, tmin, window), F.col("value"))
    keys = keys_of(epochs)
    if method == "mean":
        return epochs.withColumn("value", F.col("value") - F.avg(inside).over(Window.partitionBy(*keys)))
    if method != "median":
        raise ValueError("method must be mean or median")
    level = epochs.groupBy(*keys).agg(F.median(inside).alias("level"))
    return epochs.join(level, keys).select(*keys, "sample", (F.col("value") - F.col("level")).alias("value"))


def epoch_scores(epochs: DataFrame, method: str = "amplitude", by: list[str] | None = None) -> DataFrame:
    """What EP4 compares with its threshold, per epoch: largest absolute value, largest step, or variance.

    The steps run over all samples of an epoch, channel after channel.
    """
    group = [*(by or []), "epoch"]
    if method == "amplitude":
        return epochs.groupBy(*group).agg(F.max(F.abs("value")).alias("score"))
    if method == "variance":
        return epochs.groupBy(*group).agg(F.var_samp("value").alias("score"))
    if method != "gradient":
        raise ValueError("method must be amplitude, gradient or variance")
    rest = [c for c in ("rep", "channel") if c in epochs.columns]
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*group).orderBy(*rest, "sample")))
    return epochs.withColumn("step", step).groupBy(*group).agg(F.max("step").alias("score"))


def reject_epochs(epochs: DataFrame, threshold: float, method: str = "amplitude", by: list[str] | None = None) -> DataFrame:
    """EP4: without the epochs whose score is above ``threshold``."""
    bad = epoch_scores(epochs, method, by).filter(F.col("score") > threshold)
    return epochs.join(bad, [*(by or []), "epoch"], "left_anti")


def bad_epochs(epochs: DataFrame, threshold: float, method: str = "amplitude", by: list[str] | None = None) -> DataFrame:
    """EP4 with remove off: the epochs that would go."""
    return epoch_scores(epochs, method, by).filter(F.col("score") > threshold)


def sliding(signals: DataFrame, rate: float, window: float, step: float | None = None) -> DataFrame:
    """Windows of ``window`` seconds (both ends included) every ``step`` (half by default), as epochs.

    Windows that run over the end are dropped. Each sample is exploded to the windows it lies in.
    """
    width = round(window * rate)
    hop = max(1, round((step if step is not None else window / 2) * rate))
    keys = keys_of(signals)
    rows = signals.withColumn("n", F.max("sample").over(Window.partitionBy(*keys)))
    at = F.col("sample") - 1
    first = F.greatest(F.lit(0), F.ceil((at - width) / F.lit(hop))).cast("long")
    last = F.least(F.floor(at / F.lit(hop)), F.floor((F.col("n") - 1 - width) / F.lit(hop))).cast("long")
    rows = rows.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.select(*keys, (F.col("k") + 1).cast("int").alias("epoch"), (at - F.col("k") * hop + 1).cast("long").alias("sample"), "value")


def average(epochs: DataFrame, by: str | list[str] | None = None) -> DataFrame:
    """A2: mean over epochs, per condition with ``by``."""
    extra = [by] if isinstance(by, str) else (by or [])
    keys = [c for c in keys_of(epochs) if c not in ("epoch", "event_type", "event_value", "event_onset", "condition")]
    return epochs.groupBy(*dict.fromkeys([*keys, *extra]), "sample").agg(F.avg("value").alias("value"))


def grand_average(*tables: DataFrame) -> DataFrame:
    """A3: mean of two or more signal tables of equal shape."""
    if len(tables) < 2:
        raise ValueError("two or more tables are needed")
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys_of(tables[0]), "sample").agg(F.avg("value").alias("value"))


def average_band(epochs: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """A4, V3: mean over epochs with a band of z standard errors; n is the number of epochs."""
    keys = [c for c in keys_of(epochs) if c not in ("epoch", "event_type", "event_value", "event_onset", "condition")]
    found = epochs.groupBy(*keys, "sample").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    half = F.lit(z) * F.col("sd") / F.sqrt("n")
    return found.select(*keys, "sample", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def channel_summary(signals: DataFrame) -> DataFrame:
    """A1: min, max, mean, sd and median of each channel, missing values left out; replicates and epochs are averaged first."""
    if {"epoch", "rep"} & set(signals.columns):
        keys = keys_of(signals, "epoch", "rep", "event_type", "event_value", "event_onset", "condition")
        signals = signals.groupBy(*keys, "sample").agg(F.avg("value").alias("value"))
    return signals.groupBy(*keys_of(signals)).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"))


def extract_floor(signals: DataFrame, events: DataFrame, rate: float, tmin: float, tmax: float) -> DataFrame:
    """EP8: the variant of the browser code: positions are floored and the end is excluded."""
    pre, post = int(-tmin * rate // 1), int(tmax * rate // 1)
    n = signals.agg(F.max("sample")).first()[0] or 0
    at = F.floor(F.col("onset") * rate)
    picked = events.withColumn("at", at).filter((F.col("at") - pre >= 0) & (F.col("at") + post <= n))
    picked = picked.withColumn("epoch", F.row_number().over(Window.orderBy("onset", "type", "value")))
    spots = picked.select("epoch", (F.col("at") - pre).alias("before"), F.explode(F.sequence(F.col("at") - pre + 1, F.col("at") + post)).alias("sample"))
    return signals.join(spots, "sample").select(*keys_of(signals), "epoch", (F.col("sample") - F.col("before")).alias("sample"), "value")


def coefficient_of_variation(epochs: DataFrame) -> DataFrame:
    """Spread over the mean of each sample across epochs; NULL where the mean is 0."""
    keys = [c for c in keys_of(epochs) if c not in ("epoch", "event_type", "event_value", "event_onset")]
    return epochs.groupBy(*keys, "sample").agg(ratio(F.stddev_samp("value"), F.avg("value")).alias("value"))
