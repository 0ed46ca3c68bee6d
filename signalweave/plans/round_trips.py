"""Queries that write view A to a format and read it back (rows S1-S16, K1-K14); the SQL is view A as the format keeps it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Recording
from ..sources import binary, matlab, tables
from ..sources.catalog import Catalog
from ..sources.filesystem import scratch
from .registry import RATE, A, M, markers, positions, query, r, view_a


def recording(spark: SparkSession, sf: str, **parts) -> Recording:
    return Recording(view_a(spark, sf), RATE, events=markers(spark, sf), **parts)


def placed(spark: SparkSession, sf: str) -> Recording:
    """View A with channel metadata."""
    at = positions(spark).select("channel", F.col("channel").alias("label"), F.lit("EMG").alias("type"), F.lit("mV").alias("unit"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("status"), "pos_x", "pos_y", "pos_z")
    return recording(spark, sf, channels=at)


def trip(key: str, sql: str, write: Callable[[Recording, str], object], read: Callable[[SparkSession, str], DataFrame], suffix: str = "", of=recording) -> None:
    """Register: ``of`` the tables is written below a new path, and the query is what is read from it."""

    @query(sql, key)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch(spark, key) + suffix
        write(of(spark, sf), path)
        return read(spark, path)


#: Every channel at every sample: what a table with a column for each channel holds.
GRID = f"{A}, g AS (SELECT channel, sample, value FROM (SELECT DISTINCT channel FROM a) CROSS JOIN (SELECT DISTINCT sample FROM a) LEFT JOIN a USING (channel, sample))"
ZEROS = f"WITH {GRID} SELECT channel, sample, {r('coalesce(value, 0)', 'value')} FROM g"
EVENTS = f"WITH {M} SELECT {r('onset', 'onset')}, {r('duration', 'duration')}, type, value FROM m"
WHOLE = f"WITH {A} SELECT channel, sample, {r('value', 'value')} FROM a"


def quantized(steps: int) -> str:
    """View A in whole seconds, zeros where nothing is, each channel in ``steps`` steps over its range."""
    rows = f"{A}, s AS (SELECT unnest(generate_series(1, CAST(ceil((SELECT max(sample) FROM a) / 100.0) * 100 AS BIGINT))) AS sample), g AS (SELECT channel, sample, coalesce(value, 0) AS v FROM (SELECT DISTINCT channel FROM a) CROSS JOIN s LEFT JOIN a USING (channel, sample))"
    limits = "l AS (SELECT channel, least(0, min(v)) AS lo, greatest(0, max(v)) AS hi FROM g GROUP BY channel)"
    low = -(steps + 1) // 2
    return f"WITH {rows}, {limits} SELECT channel, sample, {r(f'(round_even((v - lo) / (hi - lo) * {steps} + ({low}), 0) - ({low})) * ((hi - lo) / {steps}) + lo', 'value')} FROM g JOIN l USING (channel)"


# ---------------------------------------------------------------- text tables
trip("csv_wide_round_trip", f"WITH {GRID} SELECT channel, sample, {r('value', 'value')} FROM g", tables.write_csv, lambda spark, p: tables.read_csv(spark, p).signals)
trip("csv_long_round_trip", f"WITH {A}, n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM a GROUP BY channel)) SELECT channel, sample, {r('value', 'value')} FROM a, n WHERE sample <= n", lambda x, p: tables.write_csv(x, p, "long"), lambda spark, p: tables.read_csv(spark, p, "long").signals)
trip("csv_sampling_rate", "SELECT 100.0::DOUBLE AS rate", tables.write_csv, lambda spark, p: spark.createDataFrame([(tables.read_csv(spark, p).sampling_rate,)], "rate double"))
trip("events_csv_round_trip", EVENTS, lambda x, p: tables.write_events_csv(x.events, p), tables.read_events_csv)
trip("positions_csv_round_trip", "SELECT * FROM (VALUES ('click', 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('error', 0.5, 0.2, 0.1), ('purchase', -1.0, 0.0, 0.0), ('signup', 0.0, -1.0, 0.5), ('view', 1.0, 0.0, 0.0)) t(label, x, y, z)", lambda x, p: tables.write_positions_csv(x.channels, p), tables.read_positions_csv, of=placed)

# ---------------------------------------------------------------- binary recordings
trip("edf_round_trip", quantized(65535), binary.write_edf, lambda spark, p: binary.read_edf(spark, p).signals, ".edf")
trip("edf_annotations", f"WITH {M} SELECT {r('onset', 'onset')}, {r('duration', 'duration')}, 'annotation' AS type, type AS value FROM m", lambda x, p: binary.write_edf(x, p, annotate=True), lambda spark, p: binary.read_edf(spark, p).events, ".edf")
trip("edf_time_window", f"SELECT channel, sample - 250 AS sample, value FROM ({quantized(65535)}) WHERE channel IN ('click', 'view') AND sample BETWEEN 251 AND 475", binary.write_edf, lambda spark, p: binary.read_edf(spark, p, ["click", "view"], 2.5, 4.75).signals, ".edf")
trip("bdf_round_trip", quantized(16777215), binary.write_bdf, lambda spark, p: binary.read_bdf(spark, p).signals, ".bdf")
trip("gdf_round_trip", quantized(65535), binary.write_gdf, lambda spark, p: binary.read_gdf(spark, p).signals, ".gdf")
trip("brainvision_round_trip", f"WITH {GRID} SELECT channel, sample, {r('CAST(CAST(coalesce(value, 0) AS FLOAT) AS DOUBLE)', 'value')} FROM g", binary.write_brainvision, lambda spark, p: binary.read_brainvision(spark, p).signals, ".vhdr")
trip("brainvision_integers", f"WITH {GRID} SELECT channel, sample, {r('round_even(coalesce(value, 0) / 0.1::DOUBLE, 0) * 0.1::DOUBLE', 'value')} FROM g", lambda x, p: binary.write_brainvision(x, p, "INT_32"), lambda spark, p: binary.read_brainvision(spark, p).signals, ".vhdr")
trip("brainvision_markers", f"WITH {M} SELECT {r('round_even(onset * 100.0, 0) / 100.0', 'onset')}, 0.01::DOUBLE AS duration, type, value FROM m", binary.write_brainvision, lambda spark, p: binary.read_brainvision(spark, p).events, ".vhdr")
trip("mat_round_trip", ZEROS, matlab.write_mat, lambda spark, p: matlab.read_mat(spark, p).signals, ".mat")
trip("mat_eeg_round_trip", ZEROS, lambda x, p: matlab.write_mat(x, p, True), lambda spark, p: matlab.read_mat(spark, p).signals, ".mat")
trip("mat_eeg_events", f"WITH {M} SELECT {r('onset', 'onset')}, {r('duration', 'duration')}, 'event' AS type, value FROM m", lambda x, p: matlab.write_mat(x, p, True), lambda spark, p: matlab.read_mat(spark, p).events, ".mat")

# ---------------------------------------------------------------- store, BIDS, catalogue
trip("store_round_trip", WHOLE, tables.save, lambda spark, p: tables.load(spark, p).signals)


@query(f"WITH {A} SELECT channel, CASE WHEN sample % 2 = 0 THEN 'even' ELSE 'raw' END AS assay, sample, {r('CASE WHEN sample % 2 = 0 THEN 2 * value ELSE value END', 'value')} FROM a")
def store_add_assay(spark, sf):
    path, rows = scratch(spark, "assays"), view_a(spark, sf)
    tables.save(recording(spark, sf).with_signals(rows.filter("sample % 2 = 1").withColumn("assay", F.lit("raw"))), path)
    tables.add_assay(path, "even", rows)
    tables.add_assay(path, "even", rows.filter("sample % 2 = 0").withColumn("value", 2 * F.col("value")))  # replaces
    return tables.load(spark, path).signals.select("channel", "assay", "sample", "value")


@query("SELECT * FROM (VALUES ('loaded', true), ('realized', false)) t(state, lazy)")
def store_is_lazy(spark, sf):
    path = scratch(spark, "lazy")
    tables.save(recording(spark, sf), path)
    loaded = tables.load(spark, path)
    out = [("loaded", tables.is_lazy(loaded))]
    kept = tables.realize(loaded)
    out.append(("realized", tables.is_lazy(kept)))
    kept.signals.unpersist()
    return spark.createDataFrame(out, "state string, lazy boolean")


def bids(x: Recording, p: str) -> None:
    tables.write_bids(x, p, "01", "rest", session="a")


trip("bids_round_trip", quantized(65535), bids, lambda spark, p: tables.read_bids(spark, p, "01", "rest", session="a").signals, of=placed)
trip("bids_events", EVENTS, bids, lambda spark, p: tables.read_bids(spark, p, "01", "rest", session="a").events, of=placed)
trip("bids_channels", "SELECT channel, 'EMG' AS type, 'mV' AS unit, pos_x, pos_y, pos_z FROM (VALUES ('click', 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('error', 0.5, 0.2, 0.1), ('purchase', -1.0, 0.0, 0.0), ('signup', 0.0, -1.0, 0.5), ('view', 1.0, 0.0, 0.0)) t(channel, pos_x, pos_y, pos_z)", bids, lambda spark, p: tables.read_bids(spark, p, "01", "rest", session="a").channels.select("channel", "type", "unit", "pos_x", "pos_y", "pos_z"), of=placed)
trip(
    "bids_listing", "SELECT '01' AS subject, 'a' AS session, true AS valid, 0::BIGINT AS errors, 0::BIGINT AS warnings", bids,
    lambda spark, p: spark.createDataFrame([(s, x, v["valid"], len(v["errors"]), len(v["warnings"])) for v in [tables.validate_bids(p)] for s in tables.list_subjects(p) for x in tables.list_sessions(p, s)], "subject string, session string, valid boolean, errors long, warnings long"), of=placed,
)


def registered(x: Recording, p: str) -> Catalog:
    catalog = Catalog(x.signals.sparkSession, p)
    catalog.register(x, "one", "s1", task="rest", recording_date="2024-01-02", store_signals=True, chunk_size=500)
    catalog.register(x, "two", "s2", task="go")
    return catalog


trip("catalog_load", WHOLE, registered, lambda spark, p: Catalog(spark, p).load("one").signals)
trip("catalog_load_events", EVENTS, registered, lambda spark, p: Catalog(spark, p).load("two").events)
trip("catalog_load_channels", f"WITH {A} SELECT channel, channel AS label FROM (SELECT DISTINCT channel FROM a)", registered, lambda spark, p: Catalog(spark, p).load("two").channels.select("channel", "label"))
trip("catalog_date_query", "SELECT 'one' AS experiment_id, 's1' AS subject_id, DATE '2024-01-02' AS recording_date", registered, lambda spark, p: Catalog(spark, p).query(date_range=("2024-01-01", "2024-12-31")).select("experiment_id", "subject_id", "recording_date"))
_N = f"{A}, {M}, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT channel FROM a)), k AS (SELECT count(*) AS n FROM (SELECT DISTINCT channel, (sample - 1) // 500 FROM a)), e AS (SELECT count(*) AS n FROM m)"
trip("catalog_register", f"WITH {_N} SELECT 2::BIGINT AS n_experiments, 2::BIGINT AS n_subjects, 2::BIGINT AS n_tasks, 2 * c.n AS n_channels, 2 * e.n AS n_events, k.n AS n_chunks FROM c, k, e", registered, lambda spark, p: Catalog(spark, p).statistics())


def delete_first(x: Recording, p: str) -> None:
    registered(x, p).delete("one")


trip("catalog_delete", f"WITH {_N} SELECT 1::BIGINT AS n_experiments, 1::BIGINT AS n_subjects, 1::BIGINT AS n_tasks, c.n AS n_channels, e.n AS n_events, 0::BIGINT AS n_chunks FROM c, e", delete_first, lambda spark, p: Catalog(spark, p).statistics())


@query("SELECT count(*) AS n FROM (VALUES ('annotations'), ('channels'), ('epochs'), ('events'), ('experiments'), ('signal_chunks')) t(name)")
def catalog_tables(spark, sf):
    catalog = Catalog(spark, scratch(spark, "empty"))
    return spark.createDataFrame([(n,) for n in ("annotations", "channels", "epochs", "events", "experiments", "signal_chunks") if catalog.table(n).isEmpty()], "name string").agg(F.count("*").alias("n"))
