"""The data model: recordings as long-form DataFrames.

``signals``: key columns (any of rec, assay, epoch, rep, channel), sample (from 1), value.
``channels``: channel, label, type, unit, reference, status, pos_x, pos_y, pos_z.
``events``: onset, duration (seconds), type, value.

A missing value is NULL; NaN is turned into NULL when data enter. Operators take and return such
DataFrames; :class:`Recording` bundles them for chained use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EVENTS_SCHEMA = "onset double, duration double, type string, value string"
CHANNELS_SCHEMA = "channel string, label string, type string, unit string, reference string, status string, pos_x double, pos_y double, pos_z double"
#: Columns that are not keys of a series.
PAYLOAD = ("sample", "value", "re", "im")


def keys_of(signals: DataFrame, *without: str) -> list[str]:
    """The columns that tell one series from another."""
    return [c for c in signals.columns if c not in PAYLOAD and c not in without]


def along(signals: DataFrame, *without: str) -> WindowSpec:
    """Window over each series in order of its samples."""
    return Window.partitionBy(*keys_of(signals, *without)).orderBy("sample")


def whole(signals: DataFrame, *without: str) -> WindowSpec:
    return Window.partitionBy(*keys_of(signals, *without))


def clean(value: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def corr(x: str, y: str) -> Column:
    """Correlation over the rows that have both, NULL where one of them is constant (Spark's own raises an error there)."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(known, F.col(x)), F.when(known, F.col(y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def rint(value: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(value.cast("double")).cast("long")


def per_series(signals: DataFrame, fn: Callable[[np.ndarray], np.ndarray | dict[str, np.ndarray]], out: str = "value double", renumber: bool = True) -> DataFrame:
    """Apply a numpy function to each whole series, in order of its samples.

    For recursive filters and transforms that need all samples at once. ``fn`` gets the
    values (NaN where missing) and returns an array, or one for each column of ``out``. One
    series has to fit one task.
    """
    keys = keys_of(signals)
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    kinds = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sample")
        found = fn(frame["value"].to_numpy(np.float64, na_value=np.nan))
        found = found if isinstance(found, dict) else {names[0]: found}
        size = len(found[names[0]])
        head = {k: np.repeat(frame[k].to_numpy()[:1], size) for k in keys}  # keeps its type where nothing is found
        samples = np.arange(1, size + 1) if renumber else frame["sample"].to_numpy()
        return pd.DataFrame(head | {"sample": samples} | found)[[*keys, "sample", *names]]

    return signals.groupBy(*keys).applyInPandas(run, f"{kinds}{', ' if kinds else ''}sample long, {out}")


def to_vectors(signals: DataFrame) -> DataFrame:
    """One row per series with its values in sample order (values array<double>)."""
    ordered = F.array_sort(F.collect_list(F.struct("sample", "value")))
    return signals.groupBy(*keys_of(signals)).agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def from_vectors(vectors: DataFrame) -> DataFrame:
    keys = [c for c in vectors.columns if c != "values"]
    return vectors.select(*keys, F.posexplode("values").alias("sample", "value")).withColumn("sample", F.col("sample").cast("long") + 1)


@dataclass(frozen=True)
class Recording:
    """An immutable bundle of a recording's tables. Operators return a new one."""

    signals: DataFrame
    sampling_rate: float | None = None
    channels: DataFrame | None = None
    events: DataFrame | None = None
    assays: tuple[str, ...] = ("raw",)
    reference: str | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.sampling_rate is not None and not self.sampling_rate > 0:
            raise ValueError("sampling_rate must be positive or None")

    def rate(self) -> float:
        if self.sampling_rate is None:
            raise ValueError("a sampling rate is needed")
        return self.sampling_rate

    def with_signals(self, signals: DataFrame, **changes) -> Recording:
        return replace(self, signals=signals, **changes)

    def assay(self, name: str | None = None) -> DataFrame:
        """Signals of one assay; the first is the default."""
        if "assay" not in self.signals.columns:
            return self.signals
        return self.signals.filter(F.col("assay") == (name or self.assays[0])).drop("assay")

    def add_assay(self, name: str, signals: DataFrame, sampling_rate: float | None = None) -> Recording:
        """Append an assay (or replace it)."""
        mine = self.signals if "assay" in self.signals.columns else self.signals.withColumn("assay", F.lit(self.assays[0]))
        kept = mine.filter(F.col("assay") != name)
        rates = dict(self.metadata.get("assay_rates", {}))
        if sampling_rate:
            rates[name] = sampling_rate
        return replace(self, signals=kept.unionByName(signals.withColumn("assay", F.lit(name)), allowMissingColumns=True), assays=tuple(dict.fromkeys((*self.assays, name))), metadata=self.metadata | {"assay_rates": rates})

    def assay_rates(self) -> dict[str, float | None]:
        return {a: self.metadata.get("assay_rates", {}).get(a, self.sampling_rate) for a in self.assays}

    def n_channels(self) -> int:
        return self.signals.select("channel").distinct().count()

    def n_samples(self) -> int:
        return self.signals.agg(F.max("sample")).first()[0] or 0

    def duration(self) -> float:
        return self.n_samples() / self.rate()

    def apply(self, operator: Callable[..., DataFrame], *args, **kwargs) -> Recording:
        """The recording with ``operator(signals, ...)`` for its signals."""
        return self.with_signals(operator(self.signals, *args, **kwargs))

    def __repr__(self) -> str:
        return f"Recording(sampling_rate={self.sampling_rate}, assays={list(self.assays)}, columns={self.signals.columns})"
