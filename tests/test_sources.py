"""Round trips through files, the store, the catalogue and streams."""

import io
import json
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalweave.model import Recording
from signalweave.operators import events, select
from signalweave.sources import binary, catalog, matlab, tables


@pytest.fixture(scope="module")
def recording(spark):
    t = np.arange(500) / 250
    rows = [(c, i + 1, float(v)) for k, c in enumerate(("Fp1", "Fp2", "Cz"), 1) for i, v in enumerate(50 * np.sin(2 * np.pi * k * t))]
    chans = select.channel_table(spark, [(c, c, "EEG", "uV", None, None, 0.1, 0.2, 0.3) for c in ("Fp1", "Fp2", "Cz")])
    ev = events.make_events(spark, [0.1, 0.5, 0.8], 0.0, ["stimulus", "stimulus", "response"], ["1", "2", "1"])
    return Recording(spark.createDataFrame(rows, "channel string, sample long, value double"), 250.0, chans, ev)


def same(a: Recording, b: Recording, atol: float) -> None:
    rows = a.signals.join(b.signals.select("channel", "sample", F.col("value").alias("other")), ["channel", "sample"])
    n, worst = rows.agg(F.count("*"), F.max(F.abs(F.col("value") - F.col("other")))).first()
    assert n == a.signals.count() and worst <= atol
    assert np.isclose(a.sampling_rate, b.sampling_rate)


def test_edf_and_bdf(spark, recording, tmp_path):
    binary.write_edf(recording, f"{tmp_path}/x.edf")
    same(recording, binary.read_edf(spark, f"{tmp_path}/x.edf"), 0.01)
    binary.write_bdf(recording, f"{tmp_path}/x.bdf")
    same(recording, binary.read_bdf(spark, f"{tmp_path}/x.bdf"), 1e-4)
    part = binary.read_edf(spark, f"{tmp_path}/x.edf", ["Cz"], 0.5, 1.0)
    assert part.signals.count() == 125
    with pytest.raises(Exception, match="not found"):
        binary.read_edf(spark, f"{tmp_path}/x.edf", ["nope"]).signals.count()


def test_annotations():
    data = np.frombuffer("+1.5\x150.25\x14go\x14\x00+2\x14stop\x14\x00".encode().ljust(32, b"\0"), "<i2")
    assert binary.annotations(data, 16) == [(1.5, 0.25, "go"), (2.0, 0.0, "stop")]


@pytest.mark.parametrize("kind,atol", [("IEEE_FLOAT_32", 1e-4), ("IEEE_FLOAT_64", 1e-12), ("INT_16", 0.051)])
def test_brainvision(spark, recording, tmp_path, kind, atol):
    binary.write_brainvision(recording, f"{tmp_path}/x.vhdr", kind)
    back = binary.read_brainvision(spark, f"{tmp_path}/x.vhdr")
    same(recording, back, atol)
    assert [(round(r["onset"], 3), r["type"]) for r in back.events.collect()] == [(0.1, "stimulus"), (0.5, "stimulus"), (0.8, "response")]


def test_gdf(spark, recording, tmp_path):
    binary.write_gdf(recording, f"{tmp_path}/x.gdf")
    back = binary.read_gdf(spark, f"{tmp_path}/x.gdf")
    same(recording, back, 0.01)
    assert [round(r["onset"], 3) for r in back.events.collect()] == [0.1, 0.5, 0.8]


@pytest.mark.parametrize("eeg", [False, True])
def test_matlab(spark, recording, tmp_path, eeg):
    matlab.write_mat(recording, f"{tmp_path}/x.mat", eeg)
    back = matlab.read_mat(spark, f"{tmp_path}/x.mat")
    same(recording, back, 0.0)
    if eeg:
        assert [round(r["onset"], 3) for r in back.events.collect()] == [0.1, 0.5, 0.8]
    packed = open(f"{tmp_path}/x.mat", "rb").read()
    assert set(matlab.parse(packed)) == ({"EEG"} if eeg else {"data", "srate", "labels"})


def test_bids(spark, recording, tmp_path):
    root = str(tmp_path / "set")
    tables.write_bids(recording, root, "01", "rest")
    back = tables.read_bids(spark, root, "01", "rest")
    same(recording, back, 0.01)
    assert back.events.count() == 3 and back.channels.filter("pos_x = 0.1").count() == 3
    assert tables.list_subjects(root) == ["01"] and tables.list_sessions(root, "01") == []
    assert tables.validate_bids(root)["valid"]
    os.remove(f"{root}/dataset_description.json")
    assert not tables.validate_bids(root)["valid"]


def test_csv(spark, recording, tmp_path):
    for layout in ("wide", "long"):
        tables.write_csv(recording, f"{tmp_path}/{layout}", layout)
        same(recording, tables.read_csv(spark, f"{tmp_path}/{layout}", layout), 1e-9)
    tables.write_events_csv(recording.events, f"{tmp_path}/ev")
    assert tables.read_events_csv(spark, f"{tmp_path}/ev").count() == 3
    tables.write_positions_csv(recording.channels, f"{tmp_path}/pos")
    assert tables.read_positions_csv(spark, f"{tmp_path}/pos").filter("x = 0.1").count() == 3
    with pytest.raises(ValueError, match="rate"):
        tables.write_csv(recording, f"{tmp_path}/bare", "wide", include_time=False)
        tables.read_csv(spark, f"{tmp_path}/bare")


def test_store(spark, recording, tmp_path):
    tables.save(recording, f"{tmp_path}/rec")
    back = tables.load(spark, f"{tmp_path}/rec")
    same(recording, back, 0.0)
    assert tables.is_lazy(back) and not tables.is_lazy(tables.realize(back))


def test_catalogue(spark, recording, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    c.register(recording, "e1", "s1", task="rest", recording_date="2024-01-02", store_signals=True, chunk_size=200)
    c.register(recording, "e2", "s2", task="go")
    same(recording, c.load("e1"), 0.0)
    assert [r["experiment_id"] for r in c.query(task="rest", date_range=("2024-01-01", "2024-12-31")).collect()] == ["e1"]
    assert c.statistics().first().asDict() == {"n_experiments": 2, "n_subjects": 2, "n_tasks": 2, "n_channels": 6, "n_events": 6, "n_chunks": 9}
    with pytest.raises(ValueError):
        c.register(recording, "e1")
    c.delete("e1")
    assert not c.has("e1") and c.table("signal_chunks").count() == 0
    with pytest.raises(ValueError):
        c.load("e1")


def test_streams(spark, tmp_path):
    from signalweave.streaming import live

    rows = [(i, "a" if i % 2 else "b", float(i % 10)) for i in range(100)]
    source = spark.createDataFrame(rows, "i long, channel string, value double").withColumn("ts", F.timestamp_seconds(F.col("i"))).drop("i")
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    q = live.windowed_average(stream, "10 seconds").writeStream.format("memory").queryName("live_avg").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("live_avg").agg(F.sum("n")).first()[0]
    assert got == 100
    batch = live.windowed_average(source, "10 seconds")
    assert batch.exceptAll(spark.table("live_avg")).isEmpty()
    assert live.artifact_sessions(source, 8.0).count() > 0


def test_registry_smoke(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---------------------------------------------------------------- ranges of records
def test_a_time_window_reads_only_its_records(spark, recording, tmp_path, monkeypatch):
    """Ranges of one record each; of two seconds and two channels no other byte of the data is read."""
    import json

    from signalweave.sources import records

    long = recording.with_signals(recording.signals.unionByName(recording.signals.withColumn("sample", F.col("sample") + 500)).unionByName(recording.signals.withColumn("sample", F.col("sample") + 1000)))
    binary.write_edf(long, path := f"{tmp_path}/w.edf")
    layout = binary._edf_layout(f"file:{path}", os.path.getsize(path), False, ["Cz"], 2.0, 3.5)
    whole = binary._edf_layout(f"file:{path}", os.path.getsize(path), False, ["Cz"], None, None)
    monkeypatch.setattr(records, "RANGE_BYTES", 1)
    read = []
    monkeypatch.setattr(records, "read_range", lambda p, a, n, f=records.read_range: read.append((a, n)) or f(p, a, n))
    reader = records.RecordReader({"files": json.dumps([layout])})
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(2, 3), (3, 4)]
    batches = [b.to_pandas() for p in parts for b in reader.read(p)]
    assert sorted(read) == [(layout["offset"] + k * layout["record"], layout["record"]) for k in (2, 3)]
    found = np.concatenate([b["value"] for b in batches])
    reader = records.RecordReader({"files": json.dumps([whole])})
    everything = np.concatenate([b.to_pandas()["value"] for p in reader.partitions() for b in reader.read(p)])
    assert len(everything) == 1500 and np.array_equal(found, everything[500:875]) and [b["sample"].iloc[0] for b in batches] == [1, 251]


@pytest.mark.parametrize("size", [1, 8 << 20])
def test_mixed_rates_by_ranges(spark, tmp_path, monkeypatch, size):
    """A slow channel between two fast ones comes at the fast rate, the same from ranges of one record as from the whole file."""
    from signalweave.sources import records

    monkeypatch.setattr(records, "RANGE_BYTES", size)
    rng = np.random.default_rng(3)
    counts, n = [8, 3, 8], 6
    data = [rng.integers(-1000, 1000, (n, c)) for c in counts]
    pad = lambda v, w: str(v)[:w].ljust(w).encode()
    head = pad("0", 8) + pad("", 160) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * 4, 8) + pad("", 44) + pad(n, 8) + pad(2, 8) + pad(3, 4)
    for w, column in zip(binary.SIGNAL_FIELDS, (["a", "b", "c"], [""] * 3, ["uV"] * 3, [-100] * 3, [100] * 3, [-1000] * 3, [1000] * 3, [""] * 3, counts, [""] * 3), strict=True):
        head += b"".join(pad(v, w) for v in column)
    raw = head + b"".join(d[k].astype("<i2").tobytes() for k in range(n) for d in data)
    (tmp_path / "m.edf").write_bytes(raw)
    got = binary.read_edf(spark, f"{tmp_path}/m.edf").signals.toPandas().sort_values(["channel", "sample"])
    _, plain, rate, _ = binary._edf_rows(raw, False, None, None, None)
    assert rate == 4.0 and np.allclose(got["value"], np.concatenate([x for _, x in plain])) and got["sample"].tolist() == list(range(1, 49)) * 3
    part = binary.read_edf(spark, f"{tmp_path}/m.edf", ["b", "a"], 2.5, 7.0).signals.toPandas().sort_values(["channel", "sample"])
    assert np.allclose(part["value"], np.concatenate([x[10:28] for name, x in plain if name in "ab"]))


def test_files_of_many_pieces(spark, recording, tmp_path, monkeypatch):
    """Pieces of a few samples, a channel with gaps and one that ends early: every format holds zeros where nothing is."""
    from signalweave.sources import records

    for module in (binary, matlab):
        monkeypatch.setattr(module, "PIECE_VALUES", 70)
    gaps = recording.with_signals(recording.signals.filter("NOT (channel = 'Fp2' AND sample > 301) AND NOT (channel = 'Cz' AND sample BETWEEN 40 AND 60)"))
    expected = recording.signals.select("channel", "sample", F.when(F.expr("(channel = 'Fp2' AND sample > 301) OR (channel = 'Cz' AND sample BETWEEN 40 AND 60)"), 0.0).otherwise(F.col("value")).alias("value"))
    whole = recording.with_signals(expected)
    for name, write, read, atol in (
        ("e.edf", lambda x, p: binary.write_edf(x, p, annotate=True), binary.read_edf, 0.01), ("b.bdf", binary.write_bdf, binary.read_bdf, 1e-4), ("g.gdf", binary.write_gdf, binary.read_gdf, 0.01),
        ("v.vhdr", binary.write_brainvision, binary.read_brainvision, 1e-4), ("m.mat", matlab.write_mat, matlab.read_mat, 1e-12), ("s.mat", lambda x, p: matlab.write_mat(x, p, True), matlab.read_mat, 1e-12),
    ):
        write(gaps, f"{tmp_path}/{name}")
        back = read(spark, f"{tmp_path}/{name}")
        same(whole, back, atol)
        if name != "m.mat" and name != "b.bdf":
            assert [round(r["onset"], 3) for r in back.events.collect()] == [0.1, 0.5, 0.8], name
    assert records.seekable(spark, f"{tmp_path}/e.edf")


def test_a_worker_holds_one_piece(spark, recording, tmp_path, monkeypatch):
    """A group of cells becomes one piece before the next one comes; ranges are read in parts, and no job runs for the rate of a file."""
    from signalweave.sources import records

    names = ["Cz", "Fp1", "Fp2"]
    body = records.pieces(recording.signals, names, 1, 500, 60, lambda at, data: data.tobytes())
    assert "FlatMapGroupsInPandas" in body._jdf.queryExecution().toString()
    made = {r["piece"]: np.frombuffer(r["data"]).reshape(3, 60) for r in body.collect()}
    wide = recording.signals.groupBy("sample").pivot("channel").agg(F.first("value")).orderBy("sample").toPandas()
    assert np.allclose(np.hstack([made[k] for k in range(9)])[:, :500], wide[names].to_numpy().T)
    binary.write_edf(recording, f"{tmp_path}/r.edf")
    spark.sparkContext.setJobGroup("rate of a file", "")
    back = binary.read_edf(spark, f"{tmp_path}/r.edf")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rate of a file")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert back.sampling_rate == 250.0 and not jobs
    reader = records.RecordReader({"files": json.dumps(binary._edf_layouts(spark, f"{tmp_path}/r.edf", False, None, None, None))})
    read = lambda: pd.concat([b.to_pandas() for p in reader.partitions() for b in reader.read(p)]).sort_values(["channel", "sample"])
    whole = read()
    monkeypatch.setattr(records, "HELD_BYTES", 1)
    asked = []
    monkeypatch.setattr(records, "read_range", lambda path, start, length, read=records.read_range: asked.append(length) or read(path, start, length))
    assert read().to_numpy().tolist() == whole.to_numpy().tolist() and max(asked) == 250 * 3 * 2


@pytest.mark.parametrize("compressed", [False, True])
def test_matlab_files_are_read_in_parts(spark, tmp_path, monkeypatch, compressed):
    """Heads are read without the values, and values part by part, of plain and of compressed variables; ranges meet without a gap."""
    x = np.random.default_rng(3).normal(size=(20_000, 3))
    parts = [matlab._packed(k, v) for k, v in {"data": x, "small": x[:5], "srate": 250.0, "labels": ["a", "b", "c"]}.items()]
    if compressed:
        parts = [struct.pack("<II", matlab.COMPRESSED, len(z)) + z for z in map(zlib.compress, parts)]
    (tmp_path / "x.mat").write_bytes(b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts))
    read = []

    class Counted(io.FileIO):
        def read(self, size=-1):
            read.append(size)
            return super().read(size)

    with Counted(tmp_path / "x.mat") as f:
        found = matlab.content(f, None, None, None, None)
        assert found.data.values is None and found.data.shape == x.shape and found.rate == 250.0
        assert 0 <= min(read) and (compressed or sum(read) < 5000)
        monkeypatch.setattr(matlab, "HELD_VALUES", 700)
        read.clear()
        assert max(map(len, found.rows(f, 0, x.size))) == 700 and 0 <= min(read) and max(read) <= 1 << 16
    assert (matlab.parse((tmp_path / "x.mat").read_bytes())["data"] == x).all()
    monkeypatch.setattr(matlab, "RANGE_BYTES", 8 * 7001)
    back = matlab.read_mat(spark, f"{tmp_path}/x.mat")
    got = back.signals.toPandas().sort_values(["channel", "sample"])
    assert back.signals.rdd.getNumPartitions() == (1 if compressed else 9)
    assert back.sampling_rate == 250.0 and got["channel"].tolist() == [c for c in "abc" for _ in x] and (got["value"].to_numpy() == x.T.ravel()).all()
    turned = matlab.read_mat(spark, f"{tmp_path}/x.mat", transpose=True).signals.filter("channel = 'Ch2'").orderBy("sample").toPandas()
    assert (turned["value"].to_numpy() == x[1]).all()
