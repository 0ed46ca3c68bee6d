"""Binary recording formats: EDF, BDF, GDF and BrainVision (rows S5-S10, K3-K6).

Files are read by ranges of their records (:mod:`.records`), each by a task of its own. In stores without a seeking reader, and where channels are
stored one after another, files of a glob are read as (path, content), one task per file. Writers pack pieces of a file in tasks; a row per channel
and per event, for headers and event tables, passes through the driver.
"""

from __future__ import annotations

import configparser
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Recording
from .filesystem import read_bytes, write_bytes
from .records import PIECE_VALUES, even, highest_rate, pieces, read_range, read_records, seekable, shape, unpack, write_pieces

SIGNALS = "path string, channel string, sample long, value double, rate double"
#: Widths of the fields of the EDF file header and, per signal, of its signal headers.
FILE_FIELDS = (8, 80, 80, 8, 8, 8, 44, 8, 8, 4)
SIGNAL_FIELDS = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files that match."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


# ---------------------------------------------------------------- EDF and BDF
def edf_header(data: bytes) -> dict:
    cut, at = [], 0
    for w in FILE_FIELDS:
        cut.append(data[at : at + w].decode("latin-1").strip())
        at += w
    n = int(cut[9])
    columns = []
    for w in SIGNAL_FIELDS:
        columns.append([data[at + i * w : at + (i + 1) * w].decode("latin-1").strip() for i in range(n)])
        at += n * w
    keys = ("label", "transducer", "unit", "phys_min", "phys_max", "dig_min", "dig_max", "filter", "samples", "reserved")
    head = dict(zip(keys, columns, strict=True))
    for k in keys[3:7]:
        head[k] = [float(v) for v in head[k]]
    head["samples"] = [int(v) for v in head["samples"]]
    return head | {"patient": cut[1], "recording": cut[2], "date": cut[3], "time": cut[4], "size": int(cut[5]), "records": int(cut[7]), "seconds": float(cut[8]), "n": n}


def edf_digital(data: bytes, head: dict, wide: bool, first: int = 0, last: int | None = None) -> list[np.ndarray]:
    """Stored integers of each signal for records first to last (exclusive)."""
    width = 3 if wide else 2
    per = sum(head["samples"])
    records = head["records"] if head["records"] >= 0 else (len(data) - head["size"]) // (per * width)
    last = records if last is None else min(last, records)
    raw = np.frombuffer(data, np.uint8, max(0, last - first) * per * width, head["size"] + first * per * width)
    if wide:
        three = raw.reshape(-1, 3).astype(np.int32)
        values = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
        values = np.where(values >= 1 << 23, values - (1 << 24), values)
    else:
        values = raw.view("<i2").astype(np.int32)
    table = values.reshape(-1, per)
    ends = np.cumsum(head["samples"])
    return [table[:, e - s : e].ravel() for e, s in zip(ends, head["samples"], strict=True)]


def annotations(stored: np.ndarray, samples: int) -> list[tuple[float, float, str]]:
    """Onset, duration and text of the time-stamped lists in an annotation signal (int16)."""
    out = []
    for record in stored.astype("<i2").reshape(-1, samples):
        for entry in record.tobytes().split(b"\x00"):
            parts = entry.decode("utf-8", "replace").split("\x14")
            if len(parts) < 2 or not parts[0]:
                continue
            when = parts[0].split("\x15")
            for text in parts[1:]:
                if text:
                    out.append((float(when[0]), float(when[1]) if len(when) > 1 and when[1] else 0.0, text))
    return out


def _edf_rows(content: bytes, wide: bool, wanted: list[str] | None, start: float | None, end: float | None) -> tuple[dict, list[tuple[str, np.ndarray]], float, list]:
    if wide and content[:1] != b"\xff":
        raise ValueError("not a BDF file")
    head = edf_header(content)
    skip = {"EDF Annotations", "BDF Annotations", *(["Status"] if wide else [])}
    seconds = head["seconds"] or 1.0
    first = int((start or 0.0) // seconds)
    last = None if end is None else int(np.ceil(end / seconds))
    stored = edf_digital(content, head, wide, first, last)
    picked = [i for i in range(head["n"]) if head["label"][i] not in skip and (wanted is None or head["label"][i] in wanted)]
    if wanted and (absent := [w for w in wanted if w not in head["label"]]):
        raise ValueError(f"channels not found: {absent}")
    rate = max((head["samples"][i] / seconds for i in picked), default=1.0)
    out = []
    for i in picked:
        scale = (head["phys_max"][i] - head["phys_min"][i]) / ((head["dig_max"][i] - head["dig_min"][i]) or 1.0)
        x = (stored[i] - head["dig_min"][i]) * scale + head["phys_min"][i]
        own = head["samples"][i] / seconds
        if own != rate and x.size:  # S8: to the fastest channel
            size = round(x.size / own * rate)
            x = np.interp(np.arange(size) / rate, np.arange(x.size) / own, x)
        low = round(((start or 0.0) - first * seconds) * rate)
        high = x.size if end is None else min(x.size, round((end - first * seconds) * rate))
        out.append((head["label"][i], x[low:high]))
    notes = [a for i in range(head["n"]) if head["label"][i] == "EDF Annotations" for a in annotations(edf_digital(content, head, wide)[i], head["samples"][i])]
    return head, out, rate, notes


def _layout(path: str, size: int, offset: int, records: int, seconds: float, labels: list[str], kinds: list[str], counts: list[int], limits: list[tuple[float, float, float]], skip: set[str], wanted: list[str] | None, start: float | None, end: float | None) -> dict:
    """A file for :func:`read_records`; ``limits``: low, scale and add of each channel. All channels come at the rate of the fastest one."""
    if wanted and (absent := [w for w in wanted if w not in labels]):
        raise ValueError(f"channels not found: {absent}")
    widths = [c * (3 if k == "i3" else np.dtype(k).itemsize) for k, c in zip(kinds, counts, strict=True)]
    record, seconds = sum(widths), seconds or 1.0
    picked = [i for i, x in enumerate(labels) if x not in skip and (wanted is None or x in wanted)]
    channels = [{"label": labels[i], "at": sum(widths[:i]), "kind": kinds[i], "count": counts[i], "low": limits[i][0], "scale": limits[i][1], "add": limits[i][2]} for i in picked]
    rate = max((counts[i] / seconds for i in picked), default=1.0)
    whole = (size - offset) // record if record else 0
    return {"path": path, "offset": offset, "record": record, "records": min(records, whole) if records >= 0 else whole, "seconds": seconds, "rate": rate, "start": start, "end": end, "channels": channels}


def _edf_head(path: str) -> dict:
    return edf_header(read_range(path, 0, 256 * (1 + int(read_range(path, 252, 4)))))


def _edf_layout(path: str, size: int, wide: bool, wanted: list[str] | None, start: float | None, end: float | None) -> dict:
    if wide and read_range(path, 0, 1) != b"\xff":
        raise ValueError("not a BDF file")
    h = _edf_head(path)
    skip = {"EDF Annotations", "BDF Annotations", *(["Status"] if wide else [])}
    limits = [(a, (d - c) / ((b - a) or 1.0), c) for a, b, c, d in zip(h["dig_min"], h["dig_max"], h["phys_min"], h["phys_max"], strict=True)]
    return _layout(path, size, h["size"], h["records"], h["seconds"], h["label"], ["i3" if wide else "<i2"] * h["n"], h["samples"], limits, skip, wanted, start, end)


def _edf_layouts(spark: SparkSession, path: str, wide: bool, channels: list[str] | None, start: float | None, end: float | None) -> list[dict] | None:
    """The layouts of all files that match, or none if their store has no seeking reader."""
    found = seekable(spark, path)
    return [_edf_layout(p, n, wide, channels, start, end) for p, n in found] if found is not None else None


def edf_signals(spark: SparkSession, path: str, wide: bool = False, channels: list[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Path, channel, sample, value, rate of all files that match; of a time window and chosen channels only these are read and unpacked."""
    if (layouts := _edf_layouts(spark, path, wide, channels, start, end)) is not None:
        return read_records(spark, layouts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                _, rows, rate, _ = _edf_rows(bytes(content), wide, channels, start, end)
                for label, x in rows:
                    yield pd.DataFrame({"path": where, "channel": label, "sample": np.arange(1, x.size + 1), "value": x, "rate": rate})

    return files(spark, path).mapInPandas(run, SIGNALS)


def edf_events(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Path, onset, duration, type, value of the annotations of all files that match."""
    kinds = "path string, onset double, duration double, type string, value string"
    if (found := seekable(spark, path)) is not None:
        ranges = []
        for p, size in found:
            h = _edf_head(p)
            counts = [s for s in h["samples"]]
            width = sum(counts) * (3 if wide else 2)
            records = (size - h["size"]) // width if width else 0
            at = [(2 * sum(counts[:i]), counts[i]) for i in range(h["n"]) if h["label"][i] == "EDF Annotations"] if not wide else []
            step = max(1, (8 << 20) // max(1, width))
            ranges += [(p, h["size"], width, k, min(k + step, records), a, c) for a, c in at for k in range(0, records, step)]

        def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for where, offset, width, a, b, at, count in batch.itertuples(index=False):
                    notes = annotations(unpack(read_range(where, offset + a * width, (b - a) * width), width, at, "<i2", count), count)
                    yield pd.DataFrame([(where, o, d, "annotation", t) for o, d, t in notes], columns=["path", "onset", "duration", "type", "value"])

        table = spark.createDataFrame(ranges, "path string, offset long, width long, a long, b long, at long, count long")
        return table.repartition(max(1, min(len(ranges), 10_000))).mapInPandas(unpacked, kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                notes = _edf_rows(bytes(content), wide, [], None, None)[3]
                yield pd.DataFrame([(where, o, d, "annotation", t) for o, d, t in notes], columns=["path", "onset", "duration", "type", "value"])

    return files(spark, path).mapInPandas(run, "path string, onset double, duration double, type string, value string")


def edf_channels(spark: SparkSession, path: str) -> DataFrame:
    """path, channel, label, unit, transducer and limits from the headers; the data are not read."""
    if (found := seekable(spark, path)) is not None:
        heads = [(p, _edf_head(p)) for p, _ in found]
        rows = [(p, c, c, "EEG", u, t, a, b) for p, h in heads for c, u, t, a, b in zip(h["label"], h["unit"], h["transducer"], h["phys_min"], h["phys_max"], strict=True)]
        return spark.createDataFrame(rows, "path string, channel string, label string, type string, unit string, transducer string, phys_min double, phys_max double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                h = edf_header(bytes(content))
                yield pd.DataFrame({"path": where, "channel": h["label"], "label": h["label"], "type": "EEG", "unit": h["unit"], "transducer": h["transducer"], "phys_min": h["phys_min"], "phys_max": h["phys_max"]})

    return files(spark, path).mapInPandas(run, "path string, channel string, label string, type string, unit string, transducer string, phys_min double, phys_max double")


def _recording(spark: SparkSession, path: str, signals: DataFrame, channels: DataFrame, events: DataFrame | None, layouts: list[dict] | None) -> Recording:
    rate = signals.agg(F.max("rate")).first()[0] if layouts is None else highest_rate(layouts)
    full = channels.filter(~F.col("channel").isin("EDF Annotations", "Status")).select("channel", "label", "type", "unit", *[F.lit(None).cast("string").alias(c) for c in ("reference", "status")], *[F.lit(None).cast("double").alias(c) for c in ("pos_x", "pos_y", "pos_z")])
    return Recording(signals.select("channel", "sample", "value"), rate, full, events.select("onset", "duration", "type", "value") if events is not None else None)


def read_edf(spark: SparkSession, path: str, channels: list[str] | None = None, start: float | None = None, end: float | None = None) -> Recording:
    """One EDF file."""
    return _recording(spark, path, edf_signals(spark, path, False, channels, start, end), edf_channels(spark, path), edf_events(spark, path), _edf_layouts(spark, path, False, channels, start, end))


def read_bdf(spark: SparkSession, path: str, channels: list[str] | None = None, start: float | None = None, end: float | None = None) -> Recording:
    """One BDF file."""
    return _recording(spark, path, edf_signals(spark, path, True, channels, start, end), edf_channels(spark, path), None, _edf_layouts(spark, path, True, channels, start, end))


def _annotation_records(recording: Recording, records: int, seconds: float) -> tuple[dict[int, bytes], int]:
    """The events' entries by record, and the bytes of the annotation signal in each record: its start, then the entries. The events, a row each, are read here."""
    entries: dict[int, list[str]] = {}
    for e in recording.events.orderBy("onset").collect() if recording.events is not None else []:
        k = min(records - 1, max(0, int(e["onset"] / seconds)))
        entries.setdefault(k, []).append(f"{e['onset']:+.10g}\x15{e['duration'] or 0.0:.10g}\x14{e['type']}\x14\x00")
    packed = {k: "".join(x).encode() for k, x in entries.items()}
    head = max(len(f"+{k * seconds:g}") for k in {0, records - 1, records // 2, *(10**p for p in range(len(str(records))) if 10**p < records)}) + 12
    width = max(map(len, packed.values()), default=0) + head
    return packed, width + width % 2


def _write_edf(recording: Recording, path: str, wide: bool, patient: str, name: str, annotate: bool = False) -> None:
    rows = recording.assay().select("channel", "sample", "value")
    names, low, high, first, samples = shape(rows)
    rate = recording.rate()
    per = max(1, round(rate))
    records, n = -(-samples // per), len(names)
    high = np.where(high > low, high, low + 1)
    short = lambda v: np.array([float(f"{x:.8g}"[:8]) for x in v])
    low, high = short(low), short(high)
    dig_low, dig_high = (-(1 << 23), (1 << 23) - 1) if wide else (-(1 << 15), (1 << 15) - 1)
    pad = lambda v, w: str(v)[:w].ljust(w).encode("latin-1", "replace")
    number = lambda v: f"{v:.8g}"
    fields = [[str(x) for x in names], [""] * n, ["uV"] * n, [*map(number, low)], [*map(number, high)], [dig_low] * n, [dig_high] * n, [""] * n, [per] * n, [""] * n]
    notes, width = _annotation_records(recording, records, per / rate) if annotate and not wide else ({}, 0)
    if width:
        fields = [[*f, x] for f, x in zip(fields, ("EDF Annotations", "", "", -1, 1, dig_low, dig_high, "", width // 2, ""), strict=True)]
    kind = "24BIT" if wide else "EDF+C" if annotate else ""
    m = n + (width > 0)
    head = (b"\xffBIOSEMI" if wide else pad("0", 8)) + pad(patient, 80) + pad(name, 80) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * (m + 1), 8) + pad(kind, 44) + pad(records, 8) + pad(f"{per / rate:g}", 8) + pad(m, 4)
    head += b"".join(pad(v, w) for w, column in zip(SIGNAL_FIELDS, fields, strict=True) for v in column)
    many = max(1, PIECE_VALUES // max(1, per * n))
    span = (high - low)[:, None]

    def pack(at: int, data: np.ndarray) -> bytes:
        stored = np.clip(np.rint((data - low[:, None]) / span * (dig_high - dig_low) + dig_low), dig_low, dig_high).astype(np.int32)
        count = min(many, records - at // per)
        blocks = np.ascontiguousarray(stored.reshape(n, many, per).transpose(1, 0, 2)[:count])
        if wide:
            return blocks.astype("<i4").ravel().view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        if not width:
            return blocks.astype("<i2").tobytes()
        lists = [f"+{k * per / rate:g}\x14\x14\x00".encode() + notes.get(k, b"") for k in range(at // per, at // per + count)]
        return b"".join(b.tobytes() + x.ljust(width, b"\0") for b, x in zip(blocks.astype("<i2"), lists, strict=True))

    record = per * n * (3 if wide else 2) + width
    write_pieces(recording.signals.sparkSession, path, head, pieces(rows, names, first, samples, many * per, pack), even(records, many, record))


def write_edf(recording: Recording, path: str, patient: str = "X", name: str = "X", annotate: bool = False) -> None:
    """K3: records of one second, the last one padded with zeros; each channel scaled to its own range.

    Missing values are stored as 0. With ``annotate`` the types of the events become annotations (EDF+).
    """
    _write_edf(recording, path, False, patient, name, annotate)


def write_bdf(recording: Recording, path: str, patient: str = "X", name: str = "X") -> None:
    """K4."""
    _write_edf(recording, path, True, patient, name)


# ---------------------------------------------------------------- BrainVision
#: Sample types of the format.
BRAINVISION_TYPES = {"INT_16": "i2", "INT_32": "i4", "IEEE_FLOAT_32": "f4", "IEEE_FLOAT_64": "f8"}


def _ini(text: str) -> configparser.ConfigParser:
    parser = configparser.ConfigParser(interpolation=None, strict=False, delimiters=("=",), comment_prefixes=(";",), allow_no_value=True)
    parser.optionxform = str
    parser.read_string("\n".join(x for x in text.splitlines() if x.startswith("[") or "=" in x))
    return parser


def read_brainvision(spark: SparkSession, path: str, channels: list[str] | None = None) -> Recording:
    """A header (.vhdr) with its data and marker files in the same folder."""
    text = lambda p: read_bytes(spark, p).decode("utf-8", "replace")
    head = _ini(text(path))
    common, binary = head["Common Infos"], head["Binary Infos"] if head.has_section("Binary Infos") else {}
    folder, base = path.rsplit("/", 1)[0], path.rsplit("/", 1)[-1].removesuffix(".vhdr")
    named = lambda key, default: f"{folder}/{common.get(key, default).replace('$b', base)}"
    n = int(common["NumberOfChannels"])
    rate = 1e6 / float(common["SamplingInterval"])
    rows = [(head["Channel Infos"].get(f"Ch{i + 1}", "") or "").split(",") for i in range(n)]
    labels = [r[0].replace("\\1", ",") or f"Ch{i + 1}" for i, r in enumerate(rows)]
    gains = [float(r[2]) if len(r) > 2 and r[2] else 1.0 for r in rows]
    units = [r[3] if len(r) > 3 and r[3] else "uV" for r in rows]
    if channels and (absent := [c for c in channels if c not in labels]):
        raise ValueError(f"channels not found: {absent}")
    kind = ("<" if binary.get("UseBigEndianOrder", "NO").upper() != "YES" else ">") + BRAINVISION_TYPES[binary.get("BinaryFormat", "INT_16")]
    mixed = common.get("DataOrientation", "MULTIPLEXED").upper() != "VECTORIZED"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                flat = np.frombuffer(bytes(content), kind).astype(float)
                table = flat.reshape(-1, n).T if mixed else flat.reshape(n, -1)
                for label, gain, x in zip(labels, gains, table, strict=True):
                    if channels is None or label in channels:
                        yield pd.DataFrame({"path": where, "channel": label, "sample": np.arange(1, x.size + 1), "value": x * gain, "rate": rate})

    data = named("DataFile", f"{base}.eeg")
    if mixed and (found := seekable(spark, data)) is not None:
        limits = [(0.0, g, 0.0) for g in gains]
        signals = read_records(spark, [_layout(p, size, 0, -1, 1 / rate, labels, [kind] * n, [1] * n, limits, set(), channels, None, None) for p, size in found])
    else:
        signals = files(spark, data).mapInPandas(run, SIGNALS)
    markers = []
    if common.get("MarkerFile"):
        for line in text(named("MarkerFile", f"{base}.vmrk")).splitlines():
            if m := re.match(r"Mk\d+=([^,]*),([^,]*),(\d+),(\d+)", line):
                markers.append(((int(m[3]) - 1) / rate, int(m[4]) / rate, m[1], m[2]))
    events = spark.createDataFrame(markers, "onset double, duration double, type string, value string").orderBy("onset")
    table = [(label, label, "EEG", unit) + (None,) * 5 for label, unit in zip(labels, units, strict=True)]
    return Recording(signals.select("channel", "sample", "value"), rate, spark.createDataFrame(table, "channel string, label string, type string, unit string, reference string, status string, pos_x double, pos_y double, pos_z double"), events)


def write_brainvision(recording: Recording, path: str, binary_format: str = "IEEE_FLOAT_32") -> None:
    """K6: header, data and markers; integers are stored in steps of 0.1 and declared so."""
    rows = recording.assay().select("channel", "sample", "value")
    names, _, _, first, samples = shape(rows)
    base = path.removesuffix(".vhdr")
    stem = base.rsplit("/", 1)[-1]
    step = 0.1 if binary_format.startswith("INT") else 1.0
    kind = "<" + BRAINVISION_TYPES[binary_format]
    spark, many = recording.signals.sparkSession, max(1, PIECE_VALUES // max(1, len(names)))

    def pack(at: int, data: np.ndarray) -> bytes:
        stored = np.rint(data / step) if step != 1.0 else data
        return np.ascontiguousarray(stored[:, : samples - at].T).astype(kind).tobytes()

    write_pieces(spark, f"{base}.eeg", b"", pieces(rows, names, first, samples, many, pack), even(samples, many, len(names) * np.dtype(kind).itemsize))
    channel_lines = "\n".join(f"Ch{i}={n.replace(',', chr(92) + '1')},,{step:g},uV" for i, n in enumerate(map(str, names), 1))
    write_bytes(spark, f"{base}.vhdr", (f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile={stem}.eeg\nMarkerFile={stem}.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels={len(names)}\nSamplingInterval={1e6 / recording.rate():.10g}\n[Binary Infos]\nBinaryFormat={binary_format}\n[Channel Infos]\n{channel_lines}\n").encode())
    events = recording.events.orderBy("onset").collect() if recording.events is not None else []
    lines = [f"Mk{i}={e['type']},{e['value']},{round(e['onset'] * recording.rate()) + 1},{max(1, round((e['duration'] or 0) * recording.rate()))},0" for i, e in enumerate(events, 1)]
    write_bytes(spark, f"{base}.vmrk", ("Brain Vision Data Exchange Marker File, Version 1.0\n[Common Infos]\nDataFile=" + f"{stem}.eeg\n[Marker Infos]\n" + "\n".join(lines) + "\n").encode())


# ---------------------------------------------------------------- GDF
#: Numbers of the sample types of the format.
GDF_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<i8", 16: "<f4", 17: "<f8"}


def gdf_header(data: bytes) -> dict:
    """Header of version 2: fixed fields, then one column after another over the channels."""
    if data[:3] != b"GDF":
        raise ValueError("not a GDF file")
    version = float(data[4:8].decode("latin-1"))
    blocks = int.from_bytes(data[184:186], "little") * 256 if version >= 1.92 else int.from_bytes(data[184:192], "little")
    records = int(np.frombuffer(data, "<i8", 1, 236)[0])
    top, bottom = np.frombuffer(data, "<u4", 2, 244)
    n = int(np.frombuffer(data, "<u2", 1, 252)[0])
    at, cut = 256, {}
    late = version >= 1.92
    layout = [("label", 16, None), ("transducer", 80, None), ("unit", 8 if not late else 6, None), ("code", 0 if not late else 2, None), ("phys_min", 8, "<f8"), ("phys_max", 8, "<f8"), ("dig_min", 8, "<f8" if late else "<i8"), ("dig_max", 8, "<f8" if late else "<i8"), ("filter", 80 if not late else 68, None), ("edges", 0 if not late else 12, None), ("samples", 4, "<u4"), ("kind", 4, "<u4")]
    for name, width, kind in layout:
        part = data[at : at + width * n]
        cut[name] = np.frombuffer(part, kind).astype(float).tolist() if kind else [part[i * width : (i + 1) * width].decode("latin-1").strip("\x00 ") for i in range(n)]
        at += width * n
    return cut | {"version": version, "size": blocks, "records": records, "seconds": float(top) / float(bottom or 1), "n": n}


def _gdf_rows(content: bytes, wanted: list[str] | None, start: float | None, end: float | None) -> tuple[list, float]:
    h = gdf_header(content)
    kinds = [np.dtype(GDF_TYPES[int(k)]) for k in h["kind"]]
    samples = [int(s) for s in h["samples"]]
    record = np.dtype([(str(i), k, (s,)) for i, (k, s) in enumerate(zip(kinds, samples, strict=True))])
    count = h["records"] if h["records"] >= 0 else (len(content) - h["size"]) // record.itemsize
    table = np.frombuffer(content, record, count, h["size"])
    picked = [i for i in range(h["n"]) if wanted is None or h["label"][i] in wanted]
    if wanted and (absent := [w for w in wanted if w not in h["label"]]):
        raise ValueError(f"channels not found: {absent}")
    per = max((samples[i] for i in picked), default=1)
    rate, out = per / (h["seconds"] or 1.0), []
    for i in picked:
        scale = (h["phys_max"][i] - h["phys_min"][i]) / ((h["dig_max"][i] - h["dig_min"][i]) or 1.0)
        x = (table[str(i)].astype(float).ravel() - h["dig_min"][i]) * scale + h["phys_min"][i]
        if samples[i] != per:
            x = np.interp(np.arange(count * per) / per, np.arange(x.size) / samples[i], x)
        low, high = round((start or 0) * rate), x.size if end is None else round(end * rate)
        out.append((h["label"][i], x[low:high]))
    return out, rate


def _gdf_head(path: str) -> dict:
    return gdf_header(read_range(path, 0, 256 * (1 + int.from_bytes(read_range(path, 252, 2), "little"))))


def _gdf_events(tail: bytes) -> list[tuple[float, float, str, str]]:
    """The event table after the data: a row per event."""
    n = int.from_bytes(tail[1:4], "little") if len(tail) >= 8 else 0
    if not n:
        return []
    rate, at, kind = float(np.frombuffer(tail, "<f4", 1, 4)[0]), np.frombuffer(tail, "<u4", n, 8), np.frombuffer(tail, "<u2", n, 8 + 4 * n)
    return [((float(a) - 1) / rate, 0.0, f"{k}", "") for a, k in zip(at, kind, strict=True)]


def read_gdf(spark: SparkSession, path: str, channels: list[str] | None = None, start: float | None = None, end: float | None = None) -> Recording:
    """Slower channels are interpolated to the fastest. Events follow the data, as onsets and type numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows, rate = _gdf_rows(bytes(content), channels, start, end)
                for label, x in rows:
                    yield pd.DataFrame({"path": where, "channel": label, "sample": np.arange(1, x.size + 1), "value": x, "rate": rate})

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in map(bytes, batch["content"]):
                h = gdf_header(content)
                width = sum(np.dtype(GDF_TYPES[int(k)]).itemsize * int(s) for k, s in zip(h["kind"], h["samples"], strict=True))
                tail = content[h["size"] + max(0, h["records"]) * width :]
                yield pd.DataFrame(_gdf_events(tail), columns=["onset", "duration", "type", "value"])

    if (found := seekable(spark, path)) is not None:
        layouts, events = [], []
        for p, size in found:
            h = _gdf_head(p)
            kinds = [GDF_TYPES[int(k)] for k in h["kind"]]
            limits = [(a, (d - c) / ((b - a) or 1.0), c) for a, b, c, d in zip(h["dig_min"], h["dig_max"], h["phys_min"], h["phys_max"], strict=True)]
            one = _layout(p, size, h["size"], h["records"], h["seconds"], h["label"], kinds, [int(s) for s in h["samples"]], limits, set(), channels, start, end)
            layouts.append(one)
            after = one["offset"] + one["records"] * one["record"]
            events += _gdf_events(read_range(p, after, size - after) if h["records"] >= 0 else b"")
        signals = read_records(spark, layouts)
        events = spark.createDataFrame(events, "onset double, duration double, type string, value string")
        names = spark.createDataFrame([(c["label"], c["label"], "EEG", "uV") for c in layouts[0]["channels"]], "channel string, label string, type string, unit string")
        return _recording(spark, path, signals, names, events.orderBy("onset"), layouts)
    source = files(spark, path)
    signals = source.mapInPandas(run, SIGNALS)
    names = signals.select("channel").distinct().select("channel", F.col("channel").alias("label"), F.lit("EEG").alias("type"), F.lit("uV").alias("unit"))
    events = source.mapInPandas(marks, "onset double, duration double, type string, value string").orderBy("onset")
    return _recording(spark, path, signals, names, events, None)


def write_gdf(recording: Recording, path: str) -> None:
    """K5: version 2.20 with 16-bit samples and an event table; types that are numbers keep them, others get a number by name."""
    import zlib

    rows = recording.assay().select("channel", "sample", "value")
    names, low, high, first, samples = shape(rows)
    per, n = max(1, round(recording.rate())), len(names)
    records, many = -(-samples // per), max(1, PIECE_VALUES // max(1, per * n))
    high = np.where(high > low, high, low + 1)

    def pack(at: int, data: np.ndarray) -> bytes:
        stored = np.rint((data - low[:, None]) / (high - low)[:, None] * 65535 - 32768).astype("<i2")
        return stored.reshape(n, many, per).transpose(1, 0, 2)[: records - at // per].tobytes()

    pad = lambda v, w: str(v)[:w].encode("latin-1", "replace").ljust(w, b"\x00")
    head = bytearray(256)
    head[:8] = b"GDF 2.20"
    head[184:186] = (n + 1).to_bytes(2, "little")
    head[236:244] = np.array([records], "<i8").tobytes()
    head[244:252] = np.array([1, 1], "<u4").tobytes()
    head[252:254] = np.array([n], "<u2").tobytes()
    columns = b"".join(pad(c, 16) for c in names) + bytes(80 * n) + b"".join(pad("uV", 6) for _ in names) + np.full(n, 4275, "<u2").tobytes()
    columns += low.astype("<f8").tobytes() + high.astype("<f8").tobytes() + np.full(n, -32768.0, "<f8").tobytes() + np.full(n, 32767.0, "<f8").tobytes()
    columns += bytes(68 * n) + bytes(12 * n) + np.full(n, per, "<u4").tobytes() + np.full(n, 3, "<u4").tobytes() + bytes(32 * n)
    events = recording.events.orderBy("onset").collect() if recording.events is not None else []
    code = lambda t: int(t) & 0xFFFF if re.fullmatch(r"\d+", t or "") else zlib.crc32((t or "").encode()) & 0x7FFF
    table = b"\x01" + len(events).to_bytes(3, "little") + np.array([recording.rate()], "<f4").tobytes()
    table += np.array([round(e["onset"] * recording.rate()) + 1 for e in events], "<u4").tobytes() + np.array([code(e["type"]) for e in events], "<u2").tobytes()
    write_pieces(recording.signals.sparkSession, path, bytes(head) + columns, pieces(rows, names, first, samples, many * per, pack), even(records, many, per * n * 2), table)
