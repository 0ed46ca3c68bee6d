"""CSV and BIDS tables, Parquet store (rows S1-S4, S11, S13-S15, K1, K2, K7, K8, K10, K14)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Recording, clean
from ..operators.events import with_defaults
from ..operators.select import wide
from .filesystem import exists, folders, read_bytes, write_bytes


def _path_columns(df: DataFrame, names: list[str]) -> list[str]:
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns not found: {absent}")
    return names


def read_csv(spark: SparkSession, path: str, layout: str = "wide", time_col: str | None = None, channel_cols: list[str] | None = None, sampling_rate: float | None = None, sep: str = ",") -> Recording:
    """A recording from a wide table (a column per channel) or a long one (channel, value, and time or sample).

    Without a rate it follows from the times: one over their mean step. Long channels are cut to the
    shortest.
    """
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    time = time_col or ("time" if "time" in df.columns else None)
    if layout == "wide":
        names = channel_cols or [c for c in df.columns if c not in (time, "sample")]
        _path_columns(df, names)
        # the order of lines is the order of samples unless there is a time
        order = F.col(time) if time else F.monotonically_increasing_id()
        df = df.withColumn("sample", F.row_number().over(Window.orderBy(order)).cast("long"))
        rate = sampling_rate or _rate(df, time)
        signals = df.unpivot("sample", [F.col(f"`{c}`").cast("double").alias(c) for c in names], "channel", "value").select("channel", "sample", clean(F.col("value")).alias("value"))
        return Recording(signals, rate)
    if layout != "long":
        raise ValueError("layout must be wide or long")
    _path_columns(df, ["channel", "value"])
    order = F.col(time) if time else F.col("sample") if "sample" in df.columns else F.monotonically_increasing_id()
    df = df.withColumn("sample", F.row_number().over(Window.partitionBy("channel").orderBy(order)).cast("long"))
    first = df.agg(F.min("channel")).first()[0]
    rate = sampling_rate or _rate(df.filter(F.col("channel") == first), time)
    shortest = df.groupBy("channel").count().agg(F.min("count").alias("shortest"))
    signals = df.join(F.broadcast(shortest)).filter("sample <= shortest").select(F.col("channel").cast("string"), "sample", clean(F.col("value")).alias("value"))
    return Recording(signals, rate)


def _rate(df: DataFrame, time: str | None) -> float:
    if time:
        low, high, n = df.agg(F.min(time), F.max(time), F.count(time)).first()
        if n > 1 and high > low:
            return float((n - 1) / (high - low))
    raise ValueError("the sampling rate is neither given nor follows from a time column")


def write_csv(recording: Recording, path: str, layout: str = "wide", include_time: bool = True) -> None:
    """K1: a wide or long table; of replicates and epochs the first."""
    if layout == "wide":
        names = [r[0] for r in recording.signals.select("channel").distinct().orderBy("channel").collect()]
        out = wide(recording.signals, names, recording.sampling_rate)
        out = out if include_time else out.drop("time")
    else:
        out = recording.signals.select("channel", "sample", "value")
        if include_time and recording.sampling_rate:
            out = out.withColumn("time", (F.col("sample") - 1) / recording.sampling_rate)
    out.write.mode("overwrite").csv(path, header=True)


def read_events_csv(spark: SparkSession, path: str, onset_col: str = "onset", duration_col: str = "duration", type_col: str = "type", value_col: str = "value", sep: str = ",") -> DataFrame:
    """S3: events; absent columns take their defaults."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, nullValue="n/a")
    _path_columns(df, [onset_col])
    return with_defaults(df.withColumnsRenamed({onset_col: "onset", duration_col: "duration", type_col: "type", value_col: "value"}))


def write_events_csv(events: DataFrame, path: str) -> None:
    """K2."""
    events.select("onset", "duration", "type", "value").write.mode("overwrite").csv(path, header=True)


def read_positions_csv(spark: SparkSession, path: str, name_col: str = "name", x_col: str = "x", y_col: str = "y", z_col: str = "z") -> DataFrame:
    """Label, x, y, z; without names the label is NULL."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    _path_columns(df, [x_col, y_col, z_col])
    label = F.col(name_col).cast("string") if name_col in df.columns else F.lit(None).cast("string")
    return df.select(label.alias("label"), *[F.col(c).cast("double").alias(n) for c, n in ((x_col, "x"), (y_col, "y"), (z_col, "z"))])


def write_positions_csv(channels: DataFrame, path: str) -> None:
    """K2."""
    channels.select(F.col("label").alias("name"), F.col("pos_x").alias("x"), F.col("pos_y").alias("y"), F.col("pos_z").alias("z")).write.mode("overwrite").csv(path, header=True)


# ---------------------------------------------------------------- Parquet store
def save(recording: Recording, path: str, mode: str = "errorifexists") -> None:
    """A recording as Parquet tables, signals partitioned by channel, so that reading some channels prunes the rest."""
    spark = recording.signals.sparkSession
    by = [c for c in ("assay", "channel") if c in recording.signals.columns]
    recording.signals.write.mode(mode).partitionBy(*by).parquet(f"{path}/signals")
    for name in ("channels", "events"):
        if (part := getattr(recording, name)) is not None:
            part.write.mode(mode).parquet(f"{path}/{name}")
    meta = {"sampling_rate": recording.sampling_rate, "assays": list(recording.assays), "reference": recording.reference, "metadata": recording.metadata, "tables": [n for n in ("channels", "events") if getattr(recording, n) is not None]}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode(mode).parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Recording:
    """A saved recording; nothing is read until it is used."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    signals = spark.read.parquet(f"{path}/signals")
    signals = signals.withColumn("channel", F.col("channel").cast("string"))
    order = [c for c in signals.columns if c not in ("sample", "value")]
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}
    return Recording(signals.select(*order, "sample", "value"), meta["sampling_rate"], assays=tuple(meta["assays"]), reference=meta["reference"], metadata=meta["metadata"], **tables)


def add_assay(path: str, name: str, signals: DataFrame) -> None:
    """K7: write or replace one assay of a saved recording; only its partitions change."""
    signals.withColumn("assay", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assay", "channel").parquet(f"{path}/signals")


def is_lazy(recording: Recording) -> bool:
    """Whether the signals are still a plan over files rather than kept in memory."""
    return not recording.signals.is_cached


def realize(recording: Recording) -> Recording:
    """Keep the signals in memory once they are computed."""
    return recording.with_signals(recording.signals.cache())


# ---------------------------------------------------------------- BIDS
def bids_name(subject: str, session: str | None = None, task: str | None = None, run: str | None = None) -> str:
    parts = [("sub", subject), ("ses", session), ("task", task), ("run", run)]
    return "_".join(f"{k}-{v}" for k, v in parts if v)


def bids_folder(root: str, subject: str, session: str | None = None, modality: str = "eeg") -> str:
    return "/".join([root, f"sub-{subject}", *([f"ses-{session}"] if session else []), modality])


def list_subjects(root: str) -> list[str]:
    """S14."""
    return [d[4:] for d in folders(root) if d.startswith("sub-")]


def list_sessions(root: str, subject: str) -> list[str]:
    """S14."""
    return [d[4:] for d in folders(f"{root}/sub-{subject}") if d.startswith("ses-")]


def validate_bids(root: str) -> dict:
    """Valid, errors and warnings of a dataset's layout."""
    errors, warnings = [], []
    description = f"{root}/dataset_description.json"
    if not exists(description):
        errors.append("dataset_description.json is missing")
    else:
        fields = json.loads(read_bytes(SparkSession.getActiveSession(), description))
        if not fields.get("Name"):
            errors.append("dataset_description.json has no Name")
        if not fields.get("BIDSVersion"):
            warnings.append("dataset_description.json has no BIDSVersion")
    subjects = list_subjects(root)
    if not subjects:
        errors.append("there is no subject folder")
    for s in subjects:
        homes = [f"{root}/sub-{s}", *[f"{root}/sub-{s}/ses-{x}" for x in list_sessions(root, s)]]
        if not any(set(folders(h)) & {"eeg", "emg", "ieeg", "meg", "motion", "beh"} for h in homes):
            warnings.append(f"sub-{s} has no folder of a known modality")
    return {"valid": not errors, "errors": errors, "warnings": warnings}


def _tsv(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t", nullValue="n/a") if exists(path, spark) else None


def write_bids(recording: Recording, root: str, subject: str, task: str, session: str | None = None, run: str | None = None, modality: str = "eeg", name: str = "dataset") -> str:
    """K8: an EDF file with its channels, events and electrodes tables, sidecar and dataset description."""
    from .binary import write_edf

    folder, base = bids_folder(root, subject, session, modality), bids_name(subject, session, task, run)
    spark = recording.signals.sparkSession
    # one recording's metadata: a row per channel or event
    table = lambda rows, kind: write_bytes(spark, f"{folder}/{base}_{kind}.tsv", rows.toPandas().to_csv(sep="\t", index=False, na_rep="n/a").encode())
    write_edf(recording, f"{folder}/{base}_{modality}.edf")
    channels = recording.channels
    if channels is None:
        channels = recording.signals.select("channel").distinct().select("channel", F.col("channel").alias("label"), F.lit("EEG").alias("type"), F.lit("uV").alias("unit"))
    table(channels.select(F.col("label").alias("name"), F.col("type"), F.col("unit").alias("units")), "channels")
    if recording.events is not None:
        table(recording.events.select("onset", "duration", F.col("type").alias("trial_type"), "value"), "events")
    if "pos_x" in channels.columns:
        table(channels.select(F.col("label").alias("name"), F.col("pos_x").alias("x"), F.col("pos_y").alias("y"), F.col("pos_z").alias("z")), "electrodes")
    sidecar = {"TaskName": task, "SamplingFrequency": recording.sampling_rate, "RecordingDuration": recording.duration()}
    write_bytes(spark, f"{folder}/{base}_{modality}.json", json.dumps(sidecar).encode())
    if not exists(f"{root}/dataset_description.json", spark):
        write_bytes(spark, f"{root}/dataset_description.json", json.dumps({"Name": name, "BIDSVersion": "1.8.0"}).encode())
    return f"{folder}/{base}_{modality}.edf"


def read_bids(spark: SparkSession, root: str, subject: str, task: str, session: str | None = None, run: str | None = None, modality: str = "eeg", load_events: bool = True) -> Recording:
    """The recording file with its channel, event and electrode tables left-joined by name."""
    from .binary import read_bdf, read_edf

    folder, base = bids_folder(root, subject, session, modality), bids_name(subject, session, task, run)
    readers = {"edf": read_edf, "bdf": read_bdf}
    kind = next((k for k in readers if exists(f"{folder}/{base}_{modality}.{k}", spark)), None)
    if kind is None:
        raise FileNotFoundError(f"no recording {base}_{modality} in {folder}")
    recording = readers[kind](spark, f"{folder}/{base}_{modality}.{kind}")
    channels = recording.channels
    table = _tsv(spark, f"{folder}/{base}_channels.tsv")
    if table is not None:
        more = table.dropDuplicates(["name"]).select(F.col("name").alias("label"), F.col("type").cast("string").alias("type2"), (F.col("units") if "units" in table.columns else F.lit(None)).cast("string").alias("unit2"))
        channels = channels.join(more, "label", "left").withColumn("type", F.coalesce("type2", "type")).withColumn("unit", F.coalesce("unit2", "unit")).drop("type2", "unit2").select(*channels.columns)
    electrodes = _tsv(spark, f"{folder}/{base}_electrodes.tsv")
    if electrodes is not None:
        from ..operators.select import set_positions

        channels = set_positions(channels, electrodes.select(F.col("name").alias("label"), *[F.col(c).cast("double") for c in "xyz"]))
    events = recording.events
    found = _tsv(spark, f"{folder}/{base}_events.tsv") if load_events else None
    if found is not None:
        events = with_defaults(found.withColumnsRenamed({"trial_type": "type"}))
    return Recording(recording.signals, recording.sampling_rate, channels, events, metadata={"bids": {"subject": subject, "session": session, "task": task, "run": run}})
