"""Files of fixed-length records, read by byte ranges and written by many tasks.

:class:`RecordSource` is a data source with one partition for each byte range: a task seeks to its records and reads these alone, so a
file of any size is spread over tasks, and only the records of a time window and the channels asked for are unpacked. The other way, tasks pack pieces of a file, Spark
writes them as part files, and the parts are appended to the header in order by the file system's streams; no process holds more than a buffer of the file.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .filesystem import _place, scratch

#: Bytes of a range, of the part of it that a task holds at a time, and values of a written piece.
RANGE_BYTES, HELD_BYTES, PIECE_VALUES = 8 << 20, 1 << 20, 1 << 17
#: Schemes whose files tasks can seek in, and what pyarrow calls them.
SEEKABLE = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
ROWS = "path string, channel string, sample long, value double, rate double"


def open_file(path: str) -> io.BufferedReader:
    """A file in any store that pyarrow can seek in."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    system, name = fs.FileSystem.from_uri(f"{SEEKABLE[scheme]}://{rest.removeprefix('//')}")
    return io.BufferedReader(system.open_input_file(name), 1 << 16)


def read_range(path: str, start: int, length: int) -> bytes:
    """Bytes of a file in any store that pyarrow can seek in."""
    with open_file(path) as f:
        f.seek(start)
        return f.read(length)


def seekable(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """Full names and sizes of the files that match, or none if their store has no seeking reader."""
    system, where = _place(path, spark)
    found = [(str(s.getPath().toString()), int(s.getLen())) for s in system.globStatus(where) or []]
    if not found:
        raise FileNotFoundError(path)
    return found if all(p.partition(":")[0] in SEEKABLE for p, _ in found) else None


def unpack(raw: bytes, record: int, at: int, kind: str, count: int) -> np.ndarray:
    """The values at byte ``at`` of every record: ``count`` of a numpy type, or of 24 bits (``i3``)."""
    table = np.frombuffer(raw, np.uint8).reshape(-1, record)
    width = 3 if kind == "i3" else np.dtype(kind).itemsize
    part = np.ascontiguousarray(table[:, at : at + count * width])
    if kind != "i3":
        return part.view(kind).ravel()
    three = part.reshape(-1, 3).astype(np.int32)
    values = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
    return np.where(values >= 1 << 23, values - (1 << 24), values)


class RecordRange(InputPartition):
    def __init__(self, file: int, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class RecordReader(DataSourceReader):
    """``files``: layouts with path, offset (of the first record), record (bytes), records, seconds (of a record), rate (of the output), start, end (seconds or null) and
    channels: label, at (byte in a record), kind, count, low, scale, add (value = (stored - low) * scale + add)."""

    def __init__(self, options: dict):
        self.files = json.loads(options["files"])

    def _window(self, f: dict) -> tuple[int, int, int, int]:
        """First and last record of the time window, and the positions of its first and last output sample."""
        total = round(f["records"] * f["seconds"] * f["rate"])
        low = round((f["start"] or 0.0) * f["rate"])
        high = total if f["end"] is None else min(total, round(f["end"] * f["rate"]))
        per = f["seconds"] * f["rate"]
        return min(f["records"], int(low / per + 1e-9)), min(f["records"], int(np.ceil(high / per - 1e-9))), low, high

    def partitions(self) -> list[RecordRange]:
        out = []
        for i, f in enumerate(self.files):
            first, last, _, _ = self._window(f)
            step = max(1, RANGE_BYTES // max(1, f["record"]))
            out += [RecordRange(i, k, min(k + step, last)) for k in range(first, last, step)]
        return out or [RecordRange(0, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        f = self.files[partition.file]
        step = max(1, HELD_BYTES // max(1, f["record"]))
        for k in range(partition.first, partition.last, step):
            yield from self._rows(f, k, min(k + step, partition.last))

    def _rows(self, f: dict, first: int, last: int) -> Iterator[pa.RecordBatch]:
        _, _, low, high = self._window(f)
        # a slower channel is drawn to the next record's first value
        mixed = any(round(c["count"]) != round(f["seconds"] * f["rate"]) for c in f["channels"])
        upto = min(f["records"], last + 1) if mixed else last
        raw = read_range(f["path"], f["offset"] + first * f["record"], (upto - first) * f["record"]) if upto > first else b""
        for c in f["channels"]:
            x = unpack(raw, f["record"], c["at"], c["kind"], c["count"]).astype(float) if raw else np.zeros(0)
            per = f["seconds"] * f["rate"]
            a, b = max(low, round(first * per)), min(high, round(last * per))
            if c["count"] == round(per):
                x = x[a - round(first * per) : b - round(first * per)]
            else:
                own = c["count"] / f["seconds"]
                x = np.interp(np.arange(a, b) / f["rate"], (np.arange(x.size) + first * c["count"]) / own, x) if x.size else x
            value = (x - c["low"]) * c["scale"] + c["add"]
            for k in range(0, value.size, 100_000):
                v = value[k : k + 100_000]
                size = len(v)
                columns = [pa.array([f["path"]] * size), pa.array([c["label"]] * size), pa.array(np.arange(size) + (a - low + 1 + k)), pa.array(v), pa.array(np.full(size, float(f["rate"])))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "channel", "sample", "value", "rate"])


class RecordSource(DataSource):
    """``spark.read.format("signalweave_records").option("files", layouts as JSON)``."""

    @classmethod
    def name(cls) -> str:
        return "signalweave_records"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, layouts: list[dict]) -> DataFrame:
    """path, channel, sample, value, rate of files with these layouts."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("signalweave_records").option("files", json.dumps(layouts)).load()


def highest_rate(layouts: list[dict]) -> float | None:
    """The highest rate of the files that have samples in their time windows; only the layouts are looked at."""
    reader = RecordReader({"files": json.dumps(layouts)})
    return max((f["rate"] for f in layouts for _, _, low, high in [reader._window(f)] if f["channels"] and low < high), default=None)


# ---------------------------------------------------------------- writing
def shape(signals: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, int, int]:
    """Channels in order, their lowest and highest value (0 included), the first sample and the number of samples up to the last; a row per channel reaches the driver."""
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    found = signals.groupBy("channel").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.min("sample").alias("a"), F.max("sample").alias("b")).toPandas().sort_values("channel")
    low, high = (np.minimum(found["low"].fillna(0.0), 0.0), np.maximum(found["high"].fillna(0.0), 0.0))
    first = int(found["a"].min()) if len(found) else 1
    return list(found["channel"]), low.to_numpy(float), high.to_numpy(float), first, int(found["b"].max()) - first + 1 if len(found) else 0


def pieces(signals: DataFrame, channels: list[str], first: int, samples: int, step: int, pack: Callable[[int, np.ndarray], bytes], runs: bool = False) -> DataFrame:
    """piece, data: ``pack`` of (position of the first sample, channels x ``step`` matrix), for every ``step`` samples; zeros stand for what is missing, and beyond the end.

    With ``runs`` a channel comes after the other, so a piece of each channel is a piece of its own. A Python worker holds the cells of one piece, however many a task has.
    """
    spark = signals.sparkSession
    kind = signals.schema["channel"].dataType.simpleString()
    numbers = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(channels)], f"channel {kind}, c int"))
    at, n, many = F.col("sample") - first, len(channels), -(-samples // step)
    cells = signals.select("channel", "sample", "value").join(numbers, "channel")
    cells = cells.select(F.floor(at / F.lit(step)).alias("piece"), "c", (at % step).cast("int").alias("k"), F.col("value").cast("double").alias("v"))
    every = spark.range(many).select(F.col("id").alias("piece"), F.lit(-1).alias("c"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("v"))  # so that none is absent

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        piece, known = int(frame["piece"].iloc[0]), frame["c"].to_numpy() >= 0
        block = np.zeros((n, step))
        block[frame["c"].to_numpy()[known], frame["k"].to_numpy()[known]] = np.nan_to_num(frame["v"].to_numpy(np.float64, na_value=np.nan)[known])
        data = pack(piece * step, block)
        size = len(data) // n if runs else 0
        split = [data[c * size : (c + 1) * size] for c in range(n)] if runs else [data]
        return pd.DataFrame({"piece": [c * many + piece for c in range(len(split))], "data": split})

    return cells.unionByName(every).groupBy("piece").applyInPandas(run, "piece long, data binary")


def even(samples: int, step: int, width: int) -> Callable[[int], int]:
    """Bytes of the pieces of ``step`` samples of ``width`` bytes, of which the last one may be shorter."""
    return lambda piece: width * min(step, samples - piece * step)


def write_pieces(spark: SparkSession, path: str, head: bytes, body: DataFrame, length: Callable[[int], int], tail: bytes = b"") -> None:
    """``head``, all pieces in order (piece k has ``length(k)`` bytes) and ``tail`` as one file.

    Spark writes the pieces as lines of part files, in ranges; streams then append them without the line ends.
    """
    parts = scratch(spark, "parts")
    ordered = body.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "piece").sortWithinPartitions("piece")
    ordered.select(F.col("data").cast("string").alias("value")).write.option("compression", "none").text(parts)
    system, folder = _place(parts, spark)
    target, where = _place(path, spark)
    copy = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    out, piece = target.create(where, True), 0
    try:
        out.write(bytearray(head))
        for status in sorted(system.listStatus(folder), key=lambda s: s.getPath().getName()):
            left = int(status.getLen())
            if not status.getPath().getName().startswith("part-") or not left:
                continue
            source = system.open(status.getPath())
            while left > 0:
                size = length(piece)
                copy(source, out, 0, size)
                source.read()
                left, piece = left - size - 1, piece + 1
            source.close()
        for at in range(0, len(tail), 1 << 22):
            out.write(bytearray(tail[at : at + (1 << 22)]))
    finally:
        out.close()
        system.delete(folder, True)
