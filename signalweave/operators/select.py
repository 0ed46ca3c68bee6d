"""Selection, channel metadata and combination of recordings (rows P1-P14, J3, J6, J7, U1, S19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CHANNELS_SCHEMA, keys_of, rint

#: Positions of the international 10-20 system on the unit sphere (x right, y front, z up).
MONTAGE = {
    "FP1": (-0.309, 0.951, 0.0), "FP2": (0.309, 0.951, 0.0), "F7": (-0.809, 0.588, 0.0), "F3": (-0.545, 0.673, 0.5),
    "FZ": (0.0, 0.719, 0.695), "F4": (0.545, 0.673, 0.5), "F8": (0.809, 0.588, 0.0), "T3": (-1.0, 0.0, 0.0),
    "C3": (-0.707, 0.0, 0.707), "CZ": (0.0, 0.0, 1.0), "C4": (0.707, 0.0, 0.707), "T4": (1.0, 0.0, 0.0),
    "T5": (-0.809, -0.588, 0.0), "P3": (-0.545, -0.673, 0.5), "PZ": (0.0, -0.719, 0.695), "P4": (0.545, -0.673, 0.5),
    "T6": (0.809, -0.588, 0.0), "O1": (-0.309, -0.951, 0.0), "OZ": (0.0, -1.0, 0.0), "O2": (0.309, -0.951, 0.0),
}


def subset(signals: DataFrame, samples: tuple[int, int] | list[int] | None = None, channels: list | None = None) -> DataFrame:
    """Samples (first and last, or a list) and channels; samples are renumbered from 1."""
    if isinstance(samples, tuple):
        signals = signals.filter(F.col("sample").between(*samples)).withColumn("sample", F.col("sample") - (samples[0] - 1))
    elif samples is not None:
        signals = signals.filter(F.col("sample").isin(*samples)).withColumn("sample", F.row_number().over(Window.partitionBy(*keys_of(signals)).orderBy("sample")).cast("long"))
    return signals.filter(F.col("channel").isin(*channels)) if channels is not None else signals


def time_window(signals: DataFrame, rate: float, tmin: float, tmax: float) -> DataFrame:
    """Samples from tmin to tmax seconds, both included, renumbered."""
    first = max(1, round(tmin * rate) + 1)
    return subset(signals, (first, round(tmax * rate) + 1))


def time_of(sample: Column, rate: float | None) -> Column:
    """Seconds of a sample; without a rate the sample itself."""
    return sample.cast("double") if rate is None else (sample - 1) / F.lit(float(rate))


def sample_of(seconds: Column, rate: float) -> Column:
    """Nearest sample, from 1."""
    return rint(seconds * rate) + 1


def shape(signals: DataFrame) -> DataFrame:
    """P5: samples and channels."""
    return signals.agg(F.max("sample").alias("n_samples"), F.count_distinct("channel").alias("n_channels"))


def wide(signals: DataFrame, channels: list, rate: float | None = None) -> DataFrame:
    """One column per channel, time first; of replicates and epochs the first."""
    for key in ("epoch", "rep"):
        if key in signals.columns:
            signals = signals.filter(F.col(key) == 1)
    out = signals.groupBy("sample").pivot("channel", channels).agg(F.first("value"))
    return out.select(time_of(F.col("sample"), rate).alias("time"), *[F.col(f"`{c}`") for c in channels])


def pick_channels(signals: DataFrame, channels: list, known: list | None = None) -> DataFrame:
    """The named channels in the given order (column position); a repeated name gives its series again."""
    have = known if known is not None else [r[0] for r in signals.select("channel").distinct().collect()]
    if absent := [c for c in channels if c not in have]:
        raise ValueError(f"channels not found: {absent}")
    order = signals.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(channels)], f"channel {signals.schema['channel'].dataType.simpleString()}, position int")
    return signals.join(F.broadcast(order), "channel").select(*keys_of(signals), "position", "sample", "value")


def drop_channels(signals: DataFrame, channels: list) -> DataFrame:
    """Without the named channels; unknown names are ignored."""
    return signals.filter(~F.col("channel").isin(*channels))


def rename_channels(table: DataFrame, names: dict[str, str], column: str = "channel") -> DataFrame:
    """P10: rename; channels without an entry keep their name. Renaming is a projection."""
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return table.withColumn(column, out)


def channel_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Channel metadata; short rows are filled with NULL."""
    width = len(CHANNELS_SCHEMA.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], CHANNELS_SCHEMA)


def channel_labels(channels: DataFrame) -> DataFrame:
    """Labels, with Ch1..n where there is none."""
    place = F.row_number().over(Window.orderBy("channel"))
    return channels.withColumn("label", F.coalesce("label", F.concat(F.lit("Ch"), place)))


def channels_by_type(channels: DataFrame, *types: str) -> DataFrame:
    """P11."""
    return channels.filter(F.col("type").isin(*types))


def set_channel_field(channels: DataFrame, field: str, values: dict[str, str]) -> DataFrame:
    """Set type, unit, reference or status of labelled channels."""
    out = F.col(field)
    for label, value in values.items():
        out = F.when(F.col("label") == label, F.lit(value)).otherwise(out)
    return channels.withColumn(field, out)


def set_positions(channels: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions (label, x, y, z) by label; of a repeated label the first counts."""
    one = positions.dropDuplicates(["label"])
    found = channels.drop("pos_x", "pos_y", "pos_z").join(one, "label", "left")
    return found.withColumnsRenamed({"x": "pos_x", "y": "pos_y", "z": "pos_z"}).select(*channels.columns)


def apply_montage(channels: DataFrame) -> DataFrame:
    """Positions of the 10-20 system by upper-cased label; others stay without."""
    spark = channels.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in MONTAGE.items()], "key string, x double, y double, z double")
    found = channels.drop("pos_x", "pos_y", "pos_z").join(F.broadcast(table), F.upper("label") == F.col("key"), "left").drop("key")
    return found.withColumnsRenamed({"x": "pos_x", "y": "pos_y", "z": "pos_z"}).select(*channels.columns)


def bind_channels(left: DataFrame, right: DataFrame, suffix: str = "_2") -> DataFrame:
    """Channels of both; those of ``right`` get a suffix. Both need the same number of samples."""
    sizes = left.agg(F.max("sample").alias("n")).union(right.agg(F.max("sample"))).distinct().count()
    if sizes != 1:
        raise ValueError("recordings differ in length")
    return left.unionByName(right.withColumn("channel", F.concat("channel", F.lit(suffix))))


def bind_time(left: DataFrame, right: DataFrame) -> DataFrame:
    """``right`` after ``left``; its samples follow the last of ``left``."""
    n = left.agg(F.max("sample").alias("shift"))
    moved = right.join(F.broadcast(n)).withColumn("sample", F.col("sample") + F.col("shift")).drop("shift")
    return left.unionByName(moved)


def bind_events(left: DataFrame, right: DataFrame, seconds: float) -> DataFrame:
    """Events of ``right`` shifted by the length of ``left``."""
    return left.unionByName(right.withColumn("onset", F.col("onset") + seconds)).orderBy("onset")


def signal_slice(signals: DataFrame, rate: float, start: float, end: float, channels: list | None = None, factor: int = 1) -> DataFrame:
    """Seconds from start to end of some channels, every ``factor``-th sample."""
    import math

    first, last = math.floor(start * rate) + 1, math.ceil(end * rate)
    kept = signals.filter(F.col("sample").between(first, last) & ((F.col("sample") - first) % factor == 0))
    return kept.filter(F.col("channel").isin(*channels)) if channels else kept
