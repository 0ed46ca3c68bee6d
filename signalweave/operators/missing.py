"""Missing values (rows A5, W2-W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import along, keys_of, whole


def summary(signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5: n_na, n_total and pct_na per series (or per ``by``)."""
    keys = keys_of(signals) if by is None else by
    missing = F.count_if(F.col("value").isNull())
    return signals.groupBy(*keys).agg(missing.alias("n_na"), F.count("*").alias("n_total"), (F.lit(100.0) * missing / F.count("*")).alias("pct_na"))


def has_missing(signals: DataFrame) -> bool:
    return not signals.filter(F.col("value").isNull()).isEmpty()


def _around(signals: DataFrame):
    """Running frames up to each sample, and from behind down to it: the last value of each is the nearest.

    A frame that starts at the current row would be evaluated anew for every row.
    """
    before = along(signals).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys_of(signals)).orderBy(F.desc("sample")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return before, after


def fill_zero(signals: DataFrame) -> DataFrame:
    return signals.withColumn("value", F.coalesce("value", F.lit(0.0)))


def fill_mean(signals: DataFrame) -> DataFrame:
    return signals.withColumn("value", F.coalesce("value", F.avg("value").over(whole(signals))))


def fill_last(signals: DataFrame) -> DataFrame:
    """Last value carried forward; leading gaps take the first value."""
    before, after = _around(signals)
    return signals.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(before), F.last("value", ignorenulls=True).over(after)))


def interpolate(signals: DataFrame) -> DataFrame:
    """Linear over the sample index, ends extended; series with fewer than two values stay as they are."""
    before, after = _around(signals)
    known = F.when(F.col("value").isNotNull(), F.struct("sample", "value"))
    low, high = F.last(known, ignorenulls=True).over(before), F.last(known, ignorenulls=True).over(after)
    rows = signals.withColumn("low", low).withColumn("high", high).withColumn("n_known", F.count("value").over(whole(signals)))
    slope = (F.col("high.value") - F.col("low.value")) / F.nullif(F.col("high.sample") - F.col("low.sample"), F.lit(0))
    line = F.col("low.value") + slope * (F.col("sample") - F.col("low.sample"))
    filled = F.coalesce("value", F.when(F.col("n_known") >= 2, F.coalesce(line, F.col("low.value"), F.col("high.value"))))
    return rows.withColumn("value", filled).drop("low", "high", "n_known")


def omit(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("value").isNotNull())


METHODS = {"interpolate": interpolate, "omit": omit, "zero": fill_zero, "mean": fill_mean, "locf": fill_last, "none": lambda s: s}


def handle(signals: DataFrame, method: str = "interpolate") -> DataFrame:
    """Dispatch by name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    return METHODS[method](signals)


def replace(signals: DataFrame, method: str = "interpolate") -> DataFrame:
    """As :func:`handle`, but the shape must stay, so ``omit`` is refused."""
    if method == "omit":
        raise ValueError("omit would change the number of samples")
    return handle(signals, method)


def fill_edges(signals: DataFrame, method: str = "extend") -> DataFrame:
    """Fill only before the first and after the last value, by these values or by zero."""
    if method not in ("extend", "zero"):
        raise ValueError("method must be extend or zero")
    before, after = _around(signals)
    previous, following = F.last("value", ignorenulls=True).over(before), F.last("value", ignorenulls=True).over(after)
    edge = previous.isNull() | following.isNull()
    value = F.lit(0.0) if method == "zero" else F.coalesce(previous, following)
    some = F.count("value").over(whole(signals)) > 0
    return signals.withColumn("value", F.when(edge & some, value).otherwise(F.col("value")))
