"""Exact deduplication by Grace hashing.

1. Where a row is read, its text is normalised (white space deleted) and put into an
   open-addressing table of its task. The first row with a content becomes a *run*
   that carries the content; further rows with it only join the run. Copies, however
   many, so leave a task once.
2. A content that many tasks have met is merged in rounds: its runs are dealt into groups of about
   ``FAN``, a table merges each group to one run per content, and so on until ``FAN`` are left. So no
   task reads more than a few copies of a content, however many tasks there are.
3. Runs are partitioned by leading bits of the content's digest, recursively: buckets
   whose distinct contents exceed the memory budget of a table are cut again by
   further bits. Spark's shuffle files are the spill files of the partitioning.
4. Each bucket is read into an open-addressing table that compares complete
   contents. It yields, per run, the row that stays and the size of the group.
5. Rows take the verdict of their run. A run never has more rows than one task read,
   so no key of this join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, partitions

#: Bytes of distinct content that one table holds.
BUCKET_BYTES = 32 << 20
#: Bytes of distinct content for each task that reads buckets.
TASK_BYTES = 64 << 20
#: Bytes of content after which a reading task starts a new table.
LOCAL_BYTES = 64 << 20
#: Runs of one content that meet in a task, in expectation, and hot contents whose digests are sent to all tasks.
FAN, BROADCAST_DIGESTS = 16, 100_000
#: Digest bits of the first partitioning and of each further one.
FIRST_BITS, MORE_BITS, MOST_BITS = 4, 4, 40

KINDS = [("row_id", pa.int64()), ("run_id", pa.int64()), ("doc_id", pa.int64()), ("n_cp", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64()), ("content", pa.binary())]
ROW = "row_id long, run_id long, doc_id long, n_cp long, size long, digest binary, bytes long, content binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, KINDS, strict=True)], names=[n for n, _ in KINDS])


class ContentTable:
    """Open addressing with linear probing; keys are whole contents.

    The digest only chooses the first slot: a slot matches when its content is equal
    byte for byte.
    """

    def __init__(self, capacity: int = 1 << 10):
        self.slots: list[int] = [-1] * capacity
        self.contents: list[bytes] = []
        self.starts: list[int] = []

    def put(self, content: bytes, digest: bytes) -> tuple[int, bool]:
        """The number of ``content`` in this table, and whether it is new."""
        if 3 * len(self.contents) >= 2 * len(self.slots):
            self._grow()
        start = int.from_bytes(digest[8:16], "little")
        slots, mask = self.slots, len(self.slots) - 1
        at = start & mask
        while (k := slots[at]) >= 0:
            if self.contents[k] == content:
                return k, False
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.contents.append(content)
        self.starts.append(start)
        return slots[at], True

    def _grow(self) -> None:
        self.slots = slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for k, start in enumerate(self.starts):
            at = start & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k


def _runs(docs: DataFrame, local_bytes: int) -> DataFrame:
    """Rows of two kinds, told apart by ``size``.

    Without size: a row of the input (row_id, run_id, doc_id). With it: a run
    (run_id, doc_id, row_id and n_cp of its best row, its rows' number, digest, bytes and content).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = first = TaskContext.get().partitionId() << 36
        table, runs, held, spaces = ContentTable(), [], 0, SPACE.encode()
        def close() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(runs), 2000):
                yield _batch([(r[3], first + r[4], r[2], -r[0], r[5], r[6], len(c), c) for r, c in zip(runs[at : at + 2000], table.contents[at : at + 2000], strict=True)])

        number = 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                content = text.encode().translate(None, spaces)
                digest = hashlib.sha256(content).digest()
                if held > local_bytes:
                    yield from close()
                    table, runs, held = ContentTable(), [], 0
                k, new = table.put(content, digest)
                # most code points, then smallest doc_id (null last), then first row
                mine = (-len(text), (doc_id is None, doc_id or 0), doc_id, row)
                if new:
                    runs.append([*mine, number, 1, digest])
                    held += len(content)
                    number += 1
                else:
                    known = runs[k]
                    if mine[:2] < (known[0], known[1]):
                        known[:4] = mine
                    known[5] += 1
                out.append((row, first + runs[k][4], doc_id, None, None, None, None, None))
                row += 1
            yield _batch(out)
        yield from close()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, ROW)


def _merged(hot: DataFrame) -> DataFrame:
    """Runs of each group (digest, group) merged by content, in an open-addressing table per group.

    Rows: per content its merged run, and per run (with no size) the run_id, as ``doc_id``, of the merged run that it is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, merged, inside = None, ContentTable(), [], []

        def close() -> Iterator[pa.RecordBatch]:
            out = [(r[2][1], r[0], r[2][0], -r[1][0], r[3], now[0], len(c), c) for r, c in zip(merged, table.contents, strict=True)]
            for at in range(0, len(out), 100):
                yield _batch(out[at : at + 100])
            for at in range(0, len(inside), 50_000):
                yield _batch([(None, i, into, None, None, None, None, None) for i, into in inside[at : at + 50_000]])

        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "content"}
            contents = batch.column(batch.schema.names.index("content"))
            for i in range(batch.num_rows):
                group = (cols["digest"][i], cols["group"][i])
                if group != now:
                    yield from close()
                    now, table, merged, inside = group, ContentTable(), [], []
                k, new = table.put(contents[i].as_py(), group[0])
                doc, row = cols["doc_id"][i], cols["row_id"][i]
                best = (-cols["n_cp"][i], (doc is None, doc or 0), row)
                if new:
                    merged.append([cols["run_id"][i], best, (doc, row), cols["size"][i]])
                else:
                    if best < merged[k][1]:
                        merged[k][1:3] = best, (doc, row)
                    merged[k][3] += cols["size"][i]
                inside.append((cols["run_id"][i], merged[k][0]))
        yield from close()

    dealt = hot.select("run_id", "digest", "n_cp", "doc_id", "row_id", "size", "group", "content").repartition(partitions(hot), "digest", "group").sortWithinPartitions("digest", "group")
    return dealt.mapInArrow(run, ROW)


def _without_hot(heads: DataFrame, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """Runs with at most ``fan`` of each digest, and per round (run_id, into): the run that a run was merged into."""
    moved: list[DataFrame] = []
    while True:  # a round divides the runs of a content by about ``fan``
        hot = heads.groupBy("digest").agg(F.count("*").alias("runs")).filter(F.col("runs") > fan)
        number = hot.count()
        if not number:
            return heads, moved
        group = F.pmod(F.xxhash64("run_id", F.lit(len(moved))), F.ceil(F.col("runs") / fan)).cast("long").alias("group")
        if number <= BROADCAST_DIGESTS:
            marked = heads.join(F.broadcast(hot), "digest", "left")
        else:  # by digest and run without contents, then by run
            plan = heads.select("run_id", "digest").join(hot, "digest").select("run_id", "runs")
            marked = heads.join(plan, "run_id", "left")
        merged = materialize(_merged(marked.filter("runs IS NOT NULL").select(*heads.columns, group)), "merged")
        moved.append(merged.filter("size IS NULL").select("run_id", F.col("doc_id").alias("into")).filter("run_id <> into"))
        heads = marked.filter("runs IS NULL").select(*heads.columns).union(merged.filter("size IS NOT NULL").select(*heads.columns))


def _bits(depth: int):
    """The leading ``depth`` bits of the digest, as a number."""
    return F.shiftrightunsigned(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), 60 - depth)


def _bucketed(heads: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Add ``bucket``: digest bits, more of them where a bucket's distinct contents exceed the budget. Also returns into how
    many partitions to deal the buckets: they grow with the contents, and each has several buckets, so that partitions are even.

    A bucket that cannot be cut (one content) is left whole. Only sums per bucket are
    looked at, and only their number reaches the driver.
    """
    sizes = heads.groupBy("digest").agg(F.max("bytes").alias("n"))
    depth = FIRST_BITS
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(heads), total // TASK_BYTES)
    while ((total >> depth) > bucket_bytes // 2 or (1 << depth) < 8 * parts) and depth < MOST_BITS:
        depth += 1
    out, cut = heads.withColumn("bucket", F.struct(F.lit(depth).alias("depth"), _bits(depth).alias("bits"))), depth
    while cut + MORE_BITS <= MOST_BITS:
        over = sizes.groupBy(_bits(cut).alias("bits")).agg(F.sum("n").alias("n"), F.count("*").alias("contents")).filter((F.col("n") > bucket_bytes) & (F.col("contents") > 1))
        over = over.select("bits", F.lit(True).alias("over"))
        number = over.count()
        if not number:
            break
        over = F.broadcast(over) if number <= 10_000 else over
        deeper = F.struct(F.lit(cut + MORE_BITS).alias("depth"), _bits(cut + MORE_BITS).alias("bits"))
        out = out.withColumn("bits", _bits(cut)).join(over, "bits", "left")
        out = out.withColumn("bucket", F.when(F.col("over"), deeper).otherwise(F.col("bucket"))).drop("bits", "over")
        cut += MORE_BITS
    return out, parts


def _tables(heads: DataFrame, parts: int) -> DataFrame:
    """Read each bucket into a table; per run: the staying row and the group's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, groups = None, ContentTable(), []

        def close() -> Iterator[pa.RecordBatch]:
            out = [(r, best[2], best[3], size, digest) for best, size, digest, runs in groups for r in runs]
            for at in range(0, len(out), 50_000):
                columns = zip(*out[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["run_id", "keep_id", "keep_row", "group_size", "digest"])

        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "content"}
            contents = batch.column(batch.schema.names.index("content"))
            for i in range(batch.num_rows):
                bucket = (cols["depth"][i], cols["bits"][i])
                if bucket != now:
                    yield from close()
                    now, table, groups = bucket, ContentTable(), []
                k, new = table.put(contents[i].as_py(), cols["digest"][i])
                doc = cols["doc_id"][i]
                # most code points, then smallest doc_id (null last), then first row
                best = (-cols["n_cp"][i], (doc is None, doc or 0), doc, cols["row_id"][i])
                if new:
                    groups.append([best, cols["size"][i], cols["digest"][i], [cols["run_id"][i]]])
                    continue
                group = groups[k]
                if (best[:2], best[3]) < (group[0][:2], group[0][3]):
                    group[0] = best
                group[1] += cols["size"][i]
                group[3].append(cols["run_id"][i])
        yield from close()

    dealt = heads.select("run_id", "digest", "n_cp", "doc_id", "row_id", "size", F.col("bucket.depth").alias("depth"), F.col("bucket.bits").alias("bits"), "content")
    dealt = dealt.repartition(parts, "depth", "bits").sortWithinPartitions("depth", "bits")
    return dealt.mapInArrow(run, "run_id long, keep_id long, keep_row long, group_size long, digest binary")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, local_bytes: int = LOCAL_BYTES, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``. Null counts as empty.
    Of equal texts the row with the most code points stays, then the smallest doc_id (a
    null id last); among repeated rows of that id exactly one is kept. An empty table
    gives an empty result; other columns are not looked at. A text has to fit a task.
    """
    rows = materialize(_runs(docs, local_bytes), "runs")
    heads, moved = _without_hot(rows.filter("size IS NOT NULL"), fan)
    verdicts = materialize(_tables(*_bucketed(heads, bucket_bytes)), "verdicts")
    for into in reversed(moved):
        verdicts = verdicts.union(into.join(verdicts.withColumnRenamed("run_id", "into"), "into").select(*verdicts.columns))
    members = rows.filter("size IS NULL").select("row_id", "run_id", "doc_id")
    out = members.join(verdicts, "run_id")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
