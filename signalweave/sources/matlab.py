"""MATLAB 5 files, plain or with an EEG structure (rows S12, K9)."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..model import Recording
from .binary import files
from .records import PIECE_VALUES, RANGE_BYTES, even, open_file, pieces, seekable, shape, write_pieces

#: Numbers of the format's data types and array classes.
DATA_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
CELL, STRUCT, CHAR, DOUBLE, COMPRESSED, MATRIX = 1, 2, 4, 6, 15, 14
RATE_NAMES = ("srate", "fs", "sampling_rate", "samplerate", "sr", "sfreq", "fsample")


# ---------------------------------------------------------------- reading
#: Numbers of a matrix of at most so many bytes are kept where its head is read, values of a larger one are left in the file.
SMALL_BYTES = 1 << 16
#: Values that are unpacked at a time.
HELD_VALUES = 100_000


@dataclass(frozen=True)
class Numbers:
    """A numeric array: ``count`` values of a numpy type from byte ``at`` on, by columns, and the values themselves if they are few."""

    shape: tuple[int, ...]
    kind: str
    at: int
    count: int
    values: np.ndarray | None

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))


class Inflated:
    """A compressed element of a file as a stream of its bytes; only what is read is held, and there is no way back."""

    def __init__(self, f, size: int):
        self.f, self.left, self.unpacker, self.held, self.at = f, size, zlib.decompressobj(), b"", 0

    def tell(self) -> int:
        return self.at

    def read(self, size: int) -> bytes:
        found = []
        while size > 0:
            if not self.held:
                raw = self.unpacker.unconsumed_tail
                if not raw:
                    raw = self.f.read(min(self.left, 1 << 16))
                    self.left -= len(raw)
                self.held = self.unpacker.decompress(raw, 1 << 16) if raw else self.unpacker.flush()
                if not self.held and not raw:
                    break
                continue
            part, self.held = self.held[:size], self.held[size:]
            size, self.at = size - len(part), self.at + len(part)
            found.append(part)
        return b"".join(found)

    def seek(self, at: int) -> None:
        while self.at < at and self.read(min(at - self.at, 1 << 20)):
            pass


def _tag(f, order: str) -> tuple[int, int, int] | None:
    """Type and size of the element at hand, and where the next one starts; the file is then at its content."""
    raw = f.read(4)
    if len(raw) < 4:
        return None
    (kind,) = struct.unpack(order + "I", raw)
    if kind >> 16:  # a short element keeps its content in the tag
        return kind & 0xFFFF, kind >> 16, f.tell() + 4
    raw = f.read(4)
    if len(raw) < 4:
        return None
    (size,) = struct.unpack(order + "I", raw)
    return kind, size, f.tell() + size + (-size % 8 if kind != COMPRESSED else 0)


def _content_of(f, order: str) -> tuple[int, bytes]:
    kind, size, after = _tag(f, order)
    found = f.read(size)
    f.seek(after)
    return kind, found


def _numbers(kind: int, content: bytes, order: str) -> np.ndarray:
    return np.frombuffer(content, order + DATA_TYPES[kind])


def _array(f, order: str, end: int) -> tuple[str, object]:
    """Name and value of the array up to byte ``end``."""
    if f.tell() >= end:
        return "", Numbers((0, 0), "f8", end, 0, np.zeros((0, 0)))
    flags = _numbers(*_content_of(f, order), order)[0]
    kind, dims = int(flags) & 0xFF, tuple(int(d) for d in _numbers(*_content_of(f, order), order))
    name = _content_of(f, order)[1].decode("latin-1")

    def nested() -> Iterator[object]:
        while f.tell() < end and (tag := _tag(f, order)) is not None:
            yield _array(f, order, f.tell() + tag[1])[1]
            f.seek(tag[2])

    if kind == CHAR:
        letters = "".join(map(chr, _numbers(*_content_of(f, order), order))) if f.tell() < end else ""
        table = np.array(list(letters)).reshape(dims, order="F") if letters else np.zeros((0, 0), str)
        rows = ["".join(r) for r in table]
        return name, rows[0] if len(rows) == 1 else rows if rows else ""
    if kind == CELL:
        return name, list(nested())
    if kind == STRUCT:
        width, names = int(_numbers(*_content_of(f, order), order)[0]), _content_of(f, order)[1]
        fields = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)]
        values = list(nested())
        rows = [dict(zip(fields, values[i : i + len(fields)], strict=False)) for i in range(0, len(values), max(1, len(fields)))]
        return name, rows[0] if len(rows) == 1 else rows
    if f.tell() >= end:
        return name, Numbers(dims, "f8", end, 0, np.zeros(dims))
    stored, size, _ = _tag(f, order)
    found = order + DATA_TYPES[stored]
    at, count = f.tell(), size // np.dtype(found).itemsize
    few = np.frombuffer(f.read(size), found).astype(float).reshape(dims, order="F") if size <= SMALL_BYTES else None
    return name, Numbers(dims, found, at, count, few)


def variables(f) -> dict[str, tuple[object, tuple[int, int] | None]]:
    """Variables of a version 5 file: arrays as :class:`Numbers`, text as str, cells as lists, structures as (lists of) dicts; and the place and size of the compressed element that has it."""
    order = _order(f)
    out: dict[str, tuple[object, tuple[int, int] | None]] = {}
    while (tag := _tag(f, order)) is not None:
        kind, size, after = tag
        source, packed, end = f, None, f.tell() + size
        if kind == COMPRESSED:
            source, packed = Inflated(f, size), (f.tell(), size)
            kind, size, _ = _tag(source, order)
            end = source.tell() + size
        if kind == MATRIX:
            name, value = _array(source, order, end)
            out[name] = value, packed
        f.seek(after)
    return out


def _order(f) -> str:
    f.seek(126)
    return "<" if f.read(2) == b"IM" else ">"


def parse(data: bytes) -> dict:
    """Variables of a version 5 file: numbers as arrays, text as str, cells as lists, structures as (lists of) dicts."""
    f = io.BytesIO(data)

    def plain(value, packed: tuple[int, int] | None):
        if isinstance(value, dict):
            return {k: plain(v, packed) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v, packed) for v in value]
        if not isinstance(value, Numbers) or value.values is not None:
            return value.values if isinstance(value, Numbers) else value
        return np.concatenate([x for _, x in unpacked(f, value, packed, 0, value.count)]).reshape(value.shape, order="F")

    return {k: plain(v, packed) for k, (v, packed) in variables(f).items()}


def unpacked(f, data: Numbers, packed: tuple[int, int] | None, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions and values of an array from ``first`` up to ``last``, ``HELD_VALUES`` at a time."""
    width = np.dtype(data.kind).itemsize
    f.seek(packed[0] if packed else data.at + first * width)
    if packed:
        f = Inflated(f, packed[1])
        f.seek(data.at + first * width)
    for k in range(first, last, HELD_VALUES):
        yield k, np.frombuffer(f.read(width * min(HELD_VALUES, last - k)), data.kind).astype(float)


def _number(value) -> float | None:
    return float(value.values.ravel()[0]) if isinstance(value, Numbers) and value.values is not None and value.size == 1 else None


def _rows(value) -> list:
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


@dataclass(frozen=True)
class Content:
    """What a file holds: the array of its values (channels are its rows if ``turned``, else its columns), rate, labels and events."""

    data: Numbers
    packed: tuple[int, int] | None
    turned: bool
    rate: float | None
    labels: list[str]
    events: list[tuple]

    def rows(self, f, first: int, last: int) -> Iterator[pd.DataFrame]:
        names, many = np.array(self.labels, object), max(1, self.data.shape[0])
        for k, x in unpacked(f, self.data, self.packed, first, last):
            column, row = np.divmod(np.arange(k, k + x.size), many)
            channel, sample = (row, column) if self.turned else (column, row)
            yield pd.DataFrame({"channel": names[channel], "sample": sample + 1, "value": x})


def content(f, data_var: str | None, sr_var: str | None, channel_var: str | None, transpose: bool | None) -> Content:
    """The content of a file; values are left in it."""
    read = variables(f)
    found = {k: v for k, (v, _) in read.items()}
    name = next((k for k, v in found.items() if isinstance(v, dict) and "data" in v and "srate" in v), None)
    events, labels = [], None
    if name is not None and data_var is None:
        whole = found[name]
        data, rate, turned = whole["data"], _number(whole["srate"]), True
        labels = [str(c.get("labels", f"Ch{i}")) for i, c in enumerate(_rows(whole.get("chanlocs")), 1)] or None
        for e in _rows(whole.get("event")):
            events.append(((_number(e["latency"]) - 1) / rate, (_number(e.get("duration")) or 0.0) / rate, "event", str(_text(e.get("type", "")))))
    else:
        matrices = {k: v for k, v in found.items() if isinstance(v, Numbers) and len(v.shape) == 2 and v.size > 1}
        if data_var is not None and data_var not in matrices:
            raise ValueError(f"no matrix {data_var!r}")
        if not matrices:
            raise ValueError("there is no matrix in the file")
        name = data_var or max(matrices, key=lambda k: matrices[k].size)
        data = matrices[name]
        turned = bool(transpose or (transpose is None and data.shape[1] > 10 * data.shape[0]))
        rates = {k.lower(): _number(v) for k, v in found.items()}
        rate = _number(found[sr_var]) if sr_var else next((rates[n] for n in RATE_NAMES if rates.get(n)), None)
        named = found.get(channel_var or "labels", found.get("channels"))
        labels = [str(_text(x)).strip() for x in named] if isinstance(named, list) else None
    if not isinstance(data, Numbers) or len(data.shape) != 2 or data.count != data.size:
        raise ValueError("the data are not a full matrix")
    n = data.shape[0] if turned else data.shape[1]
    labels = labels if labels and len(labels) == n else [f"Ch{i + 1}" for i in range(n)]
    return Content(data, read[name][1], turned, rate, labels, events)


def _text(value):
    return value.values if isinstance(value, Numbers) else value


def read_mat(spark: SparkSession, path: str, data_var: str | None = None, sr_var: str | None = None, channel_var: str | None = None, transpose: bool | None = None) -> Recording:
    """The largest matrix (or ``data_var``) as signals, channels in columns; far more columns than rows are turned.

    A structure with ``data`` and ``srate`` is read with its channel labels and events. Its latencies
    are samples from 1, as they are written. Tasks walk over the heads of the variables, seek to their range of the values and unpack a part of it at a time. A compressed
    variable can't be entered in the middle, so one task inflates it, piece by piece. In stores that pyarrow cannot seek in a task takes a whole file. Rates and labels reach the driver, events stay with the tasks.
    """
    options = (data_var, sr_var, channel_var, transpose)
    sizes = seekable(spark, path)
    names = [p for p, _ in sizes] if sizes is not None else None
    source = spark.createDataFrame([(p, None) for p in names], "path string, content binary").repartition(len(names)) if names is not None else files(spark, path)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for where, held in zip(batch["path"], batch["content"], strict=True):
                with open_file(where) if names is not None else io.BytesIO(held) as f:
                    yield where, f, content(f, *options)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for where, _, c in opened(batches):
            yield pd.DataFrame({"path": [where], "shape": [list(c.data.shape)], "kind": [c.data.kind], "at": [c.data.at], "count": [c.data.count], "packed": [c.packed and list(c.packed)], "turned": [c.turned], "rate": [c.rate], "labels": [c.labels]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, f, c in opened(batches):
            yield from c.rows(f, 0, c.data.count)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, c in opened(batches):
            yield pd.DataFrame(c.events, columns=["onset", "duration", "type", "value"])

    kinds = "channel string, sample long, value double"
    found = source.mapInPandas(heads, "path string, shape array<long>, kind string, at long, count long, packed array<long>, turned boolean, rate double, labels array<string>").collect()
    rows = [(r["path"], Content(Numbers(tuple(r["shape"]), r["kind"], r["at"], r["count"], None), r["packed"] and tuple(r["packed"]), r["turned"], r["rate"], r["labels"], [])) for r in found]
    events = source.mapInPandas(marks, "onset double, duration double, type string, value string").orderBy("onset")
    if names is None:
        return Recording(source.mapInPandas(whole, kinds), rows[0][1].rate, events=events)
    parts = []
    for i, (_, c) in enumerate(rows):
        step = max(1, c.data.count if c.packed else RANGE_BYTES // np.dtype(c.data.kind).itemsize)
        parts += [(i, k, min(k + step, c.data.count)) for k in range(0, c.data.count, step)]

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                file, first, last = parts[k]
                with open_file(rows[file][0]) as f:
                    yield from rows[file][1].rows(f, first, last)

    return Recording(spark.range(0, len(parts), 1, max(1, min(len(parts), 10_000))).mapInPandas(ranges, kinds), rows[0][1].rate, events=events)


# ---------------------------------------------------------------- writing
def _element(kind: int, content: bytes) -> bytes:
    return struct.pack("<II", kind, len(content)) + content + bytes(-len(content) % 8)


def _head(kind: int, dims: tuple, name: str) -> bytes:
    return _element(6, struct.pack("<II", kind, 0)) + _element(5, np.array(dims, "<i4").tobytes()) + _element(1, name.encode("latin-1"))


def _opened(name: str, dims: tuple[int, int]) -> bytes:
    """A matrix of doubles up to its values, which follow by columns."""
    head, size = _head(DOUBLE, dims, name), 8 * dims[0] * dims[1]
    return struct.pack("<II", MATRIX, len(head) + 8 + size) + head + struct.pack("<II", 9, size)


def _packed(name: str, value) -> bytes:
    """A matrix element for an array, text, list (cell) or dict (structure); a list of dicts is a structure array."""
    head = lambda kind, dims: _head(kind, dims, name)
    if isinstance(value, str):
        body = head(CHAR, (min(1, len(value)), len(value))) + _element(17, np.array([ord(c) & 0xFFFF for c in value], "<u2").tobytes())
    elif isinstance(value, dict) or (isinstance(value, list) and value and isinstance(value[0], dict)):
        rows = value if isinstance(value, list) else [value]
        fields = list(rows[0])
        body = head(STRUCT, (1, len(rows))) + _element(5, np.array([32], "<i4").tobytes()) + _element(1, b"".join(f.encode()[:31].ljust(32, b"\0") for f in fields))
        body += b"".join(_packed("", r[f]) for r in rows for f in fields)
    elif isinstance(value, list):
        body = head(CELL, (1, len(value))) + b"".join(_packed("", v) for v in value)
    else:
        array = np.atleast_2d(np.asarray(value, "<f8"))
        body = head(DOUBLE, array.shape) + _element(9, array.tobytes(order="F"))
    return _element(MATRIX, body)


def write_mat(recording: Recording, path: str, eeg: bool = False) -> None:
    """K9: data (samples by channels), srate and labels, or an EEG structure with channel labels and events."""
    rows = recording.assay().select("channel", "sample", "value")
    names, _, _, first, samples = shape(rows)
    labels, n, rate = [str(x) for x in names], len(names), recording.rate()
    spark = recording.signals.sparkSession
    header = b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM"
    if eeg:  # channels by samples: all channels of a sample lie together
        many = max(1, PIECE_VALUES // max(1, n))
        events = recording.events.orderBy("onset").collect() if recording.events is not None else []
        marks = [{"latency": e["onset"] * rate + 1, "duration": (e["duration"] or 0.0) * rate, "type": e["value"] or e["type"] or ""} for e in events]
        others = {"srate": rate, "nbchan": n, "pnts": samples, "chanlocs": [{"labels": x} for x in labels], "event": marks}
        fields = b"".join(f.encode().ljust(32, b"\0") for f in ("data", *others))
        before = _head(STRUCT, (1, 1), "EEG") + _element(5, np.array([32], "<i4").tobytes()) + _element(1, fields) + _opened("", (n, samples))
        after = b"".join(_packed("", v) for v in others.values())
        before = struct.pack("<II", MATRIX, len(before) + 8 * n * samples + len(after)) + before
        body = pieces(rows, names, first, samples, many, lambda at, data: data[:, : samples - at].T.astype("<f8").tobytes())
        write_pieces(spark, path, header + before, body, even(samples, many, 8 * n), after)
    else:  # samples by channels: a channel after the other
        many = max(1, PIECE_VALUES // max(1, n))
        runs, length = -(-samples // many), even(samples, many, 8)
        body = pieces(rows, names, first, samples, many, lambda at, data: data[:, : samples - at].astype("<f8").tobytes(), runs=True)
        write_pieces(spark, path, header + _opened("data", (samples, n)), body, lambda piece: length(piece % runs), _packed("srate", rate) + _packed("labels", labels))
