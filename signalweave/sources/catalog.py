"""Experiment catalogue as Parquet tables (rows S16-S18, K11-K13).

One folder per table, partitioned by experiment, so a lookup or a delete touches only that
experiment's files.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Recording

#: The catalogue's tables and columns.
TABLES = {
    "experiments": "experiment_id string, subject_id string, session_id string, task string, recording_date date, sampling_rate double, n_channels int, n_samples bigint, duration_seconds double, file_path string, created_at timestamp, metadata string",
    "channels": "channel_id string, experiment_id string, channel_index int, label string, channel_type string, unit string, reference string, pos_x double, pos_y double, pos_z double, sampling_rate double",
    "events": "event_id string, experiment_id string, onset_seconds double, duration_seconds double, event_type string, event_value string, sample_index bigint",
    "signal_chunks": "chunk_id string, experiment_id string, channel_index int, start_sample bigint, end_sample bigint, data array<double>",
    "epochs": "epoch_id string, experiment_id string, epoch_index int, event_type string, event_value string, tmin double, tmax double, baseline_corrected boolean, rejected boolean",
    "annotations": "annotation_id string, experiment_id string, start_seconds double, end_seconds double, description string, annotator string, created_at timestamp",
}


def chunk_signals(signals: DataFrame, size: int = 10_000) -> DataFrame:
    """Keys, start_sample, end_sample, data: arrays of up to ``size`` samples in order."""
    keys = [c for c in signals.columns if c not in ("sample", "value")]
    chunk = F.floor((F.col("sample") - 1) / size).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("sample", "value")))
    found = signals.groupBy(*keys, chunk.alias("chunk")).agg(F.min("sample").alias("start_sample"), F.max("sample").alias("end_sample"), F.transform(ordered, lambda x: x["value"]).alias("data"))
    return found.drop("chunk")


def unchunk_signals(chunks: DataFrame) -> DataFrame:
    """One row per sample again."""
    keys = [c for c in chunks.columns if c not in ("start_sample", "end_sample", "data")]
    rows = chunks.select(*keys, "start_sample", F.posexplode("data").alias("at", "value"))
    return rows.select(*keys, (F.col("start_sample") + F.col("at")).alias("sample"), "value")


def find_experiments(experiments: DataFrame, subject_id: str | None = None, task: str | None = None, date_range: tuple[str, str] | None = None) -> DataFrame:
    """Experiments by subject, task and date, the latest first."""
    if subject_id is not None:
        experiments = experiments.filter(F.col("subject_id") == subject_id)
    if task is not None:
        experiments = experiments.filter(F.col("task") == task)
    if date_range is not None:
        experiments = experiments.filter(F.col("recording_date").between(*[F.lit(d).cast("date") for d in date_range]))
    return experiments.orderBy(F.desc("created_at"))


def statistics(experiments: DataFrame, channels: DataFrame, events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Number of rows of four tables, of subjects and of tasks."""
    out = experiments.agg(F.count("*").alias("n_experiments"), F.count_distinct("subject_id").alias("n_subjects"), F.count_distinct("task").alias("n_tasks"))
    for name, part in (("n_channels", channels), ("n_events", events), ("n_chunks", chunks)):
        out = out.join(F.broadcast(part.agg(F.count("*").alias(name))))  # single rows
    return out


class Catalog:
    """A catalogue in a folder; tables appear as they are first written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], TABLES[name])
        found = self.spark.read.schema(TABLES[name]).parquet(self._path(name))
        return found.select(*[c.strip().split(" ")[0] for c in TABLES[name].split(", ")])

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = [c.strip().split(" ") for c in TABLES[name].split(", ")]
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])
        rows.write.mode("append").partitionBy("experiment_id").parquet(self._path(name))

    def register(self, recording: Recording, experiment_id: str, subject_id: str | None = None, session_id: str | None = None, task: str | None = None, recording_date: str | None = None, store_signals: bool = False, chunk_size: int = 10_000) -> str:
        """Add an experiment with its channels and events, and its signals in chunks."""
        if self.has(experiment_id):
            raise ValueError(f"experiment {experiment_id!r} exists")
        spark, signals = self.spark, recording.assay()
        n = recording.n_samples()
        head = (experiment_id, subject_id, session_id, task, recording_date, recording.sampling_rate, recording.n_channels(), n, n / recording.sampling_rate if recording.sampling_rate else None, json.dumps(recording.metadata))
        table = spark.createDataFrame([head], "experiment_id string, subject_id string, session_id string, task string, recording_date string, sampling_rate double, n_channels int, n_samples bigint, duration_seconds double, metadata string")
        self._append("experiments", table.withColumn("created_at", F.current_timestamp()))
        names = signals.select("channel").distinct()
        index = names.withColumn("channel_index", F.row_number().over(Window.orderBy("channel")))
        channels = index if recording.channels is None else index.join(recording.channels, "channel", "left").withColumnRenamed("type", "channel_type")
        channels = channels if "label" in channels.columns else channels.withColumn("label", F.col("channel"))
        self._append("channels", channels.withColumn("experiment_id", F.lit(experiment_id)).withColumn("channel_id", F.concat_ws("_", F.lit(experiment_id), F.lit("ch"), "channel_index")).withColumn("sampling_rate", F.lit(recording.sampling_rate)))
        if recording.events is not None:
            events = recording.events.withColumn("i", F.row_number().over(Window.orderBy("onset")))
            self._append("events", events.select(F.concat_ws("_", F.lit(experiment_id), F.lit("ev"), "i").alias("event_id"), F.lit(experiment_id).alias("experiment_id"), F.col("onset").alias("onset_seconds"), F.col("duration").alias("duration_seconds"), F.col("type").alias("event_type"), F.col("value").alias("event_value"), (F.col("onset") * F.lit(recording.sampling_rate)).cast("long").alias("sample_index")))
        if store_signals:
            chunks = chunk_signals(signals.select("channel", "sample", "value"), chunk_size).join(index, "channel")
            self._append("signal_chunks", chunks.withColumn("experiment_id", F.lit(experiment_id)).withColumn("chunk_id", F.concat_ws("_", F.lit(experiment_id), "channel_index", "start_sample")))
        return experiment_id

    def has(self, experiment_id: str) -> bool:
        return not self.table("experiments").filter(F.col("experiment_id") == experiment_id).isEmpty()

    def query(self, **filters) -> DataFrame:
        return find_experiments(self.table("experiments"), **filters)

    def load(self, experiment_id: str, load_signals: bool = True) -> Recording:
        """The recording of an experiment; without its signals an empty table stands in."""
        mine = lambda name: self.table(name).filter(F.col("experiment_id") == experiment_id)
        head = mine("experiments").first()
        if head is None:
            raise ValueError(f"no experiment {experiment_id!r}")
        channels = mine("channels").select(F.coalesce("label", F.concat(F.lit("Ch"), "channel_index")).alias("channel"), "label", F.col("channel_type").alias("type"), "unit", "reference", F.lit(None).cast("string").alias("status"), "pos_x", "pos_y", "pos_z", "channel_index")
        events = mine("events").select(F.col("onset_seconds").alias("onset"), F.col("duration_seconds").alias("duration"), F.col("event_type").alias("type"), F.col("event_value").alias("value")).orderBy("onset")
        signals = self.spark.createDataFrame([], "channel string, sample long, value double")
        if load_signals:
            rows = unchunk_signals(mine("signal_chunks").select("channel_index", "start_sample", "end_sample", "data"))
            signals = rows.join(channels.select("channel", "channel_index"), "channel_index").select("channel", "sample", "value")
        return Recording(signals, head["sampling_rate"], channels.drop("channel_index"), events, metadata=json.loads(head["metadata"] or "{}"))

    def statistics(self) -> DataFrame:
        return statistics(*[self.table(t) for t in ("experiments", "channels", "events", "signal_chunks")])

    def delete(self, experiment_id: str, confirm: bool = True) -> None:
        """Drop the experiment's partitions of all tables."""
        if confirm and not self.has(experiment_id):
            raise ValueError(f"no experiment {experiment_id!r}")
        for name in TABLES:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self._path(name), f"experiment_id={experiment_id}"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
