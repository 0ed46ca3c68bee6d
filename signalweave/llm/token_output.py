"""Token-id output as directly addressable codes (DAC).

A segment stores the ids of consecutive documents. Each id is cut into chunks of
``CHUNK_BITS`` bits. Level k holds the k-th chunk of every id that has one, and a
bitmap that says which of them go on to level k + 1. A rank directory (set bits
before each block of ``RANK_BLOCK`` bits) leads from a position of one level to
its position on the next, so any id is read by one probe per level.

Segment bytes: ``b"DAC2"``, then little-endian uint32: documents, ids, chunk
bits, levels; int64 document ids and a bitmap of those that are null (they come first); uint32 ids per document; then per level its
count (uint32), the chunks, and for all but the last level the bitmap and ranks.
Segments are rows of a Parquet table in ascending document order, so that Spark's
commit protocol covers lost executors and any store Spark can write will do. The table is not
compressed, so a segment's bytes lie in the file as they are. :func:`tokens_at` leads from a
position in the corpus to its segment and reads the id by ranks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, slices, worker_cache

MAGIC, CHUNK_BITS, RANK_BLOCK = b"DAC2", 8, 512
#: Ids after which a segment is closed (at the end of a document).
SEGMENT_IDS = 1 << 18
#: Pieces of text whose ids a worker remembers.
MEMO_PIECES = 500_000
#: Bytes of text that are encoded at a time (or one text), and pieces whose ids are gathered at a time.
SLICE, GATHER = 2 << 20, 1 << 18

#: Texts that are not cut into pieces: those with white space other than blank, tab, CR and LF, which may merge with a
#: neighbour, with three or more white spaces in a row, or with two at the end, which make one token.
WHOLE = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \t\r\n]{3}|[ \t\r\n]{2}$"
#: Marks where a text is cut; texts that have it are not cut.
CUT = "\x1f"


# ---------------------------------------------------------------- file format
def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, chunk_bits: int = CHUNK_BITS, null: np.ndarray | None = None) -> bytes:
    """One segment of ``ids`` (uint32), ``lengths[i]`` of them for ``doc_ids[i]``, which is null where ``null`` is set."""
    kind = np.uint8 if chunk_bits <= 8 else np.uint16
    mask, rest, levels = np.uint32((1 << chunk_bits) - 1), np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest >> np.uint32(chunk_bits)
        on = more != 0
        last = not on.any()
        part = struct.pack("<I", rest.size) + (rest & mask).astype(kind).tobytes()
        if not last:
            bits = np.packbits(on, bitorder="little")
            bits = np.pad(bits, (0, -bits.size % (RANK_BLOCK // 8)))
            per = np.bitwise_count(bits.reshape(-1, RANK_BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            part += bits.tobytes() + (np.cumsum(per, dtype=np.uint32) - per).tobytes()
        levels.append(part)
        if last:
            break
        rest = more[on]
    head = MAGIC + struct.pack("<IIII", len(doc_ids), len(ids), chunk_bits, len(levels))
    null = np.zeros(len(doc_ids), bool) if null is None else null
    return head + np.asarray(doc_ids, "<i8").tobytes() + np.packbits(null, bitorder="little").tobytes() + np.asarray(lengths, "<u4").tobytes() + b"".join(levels)


class Segment:
    """Reads a segment: any single id by rank, or all ids at once."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        n_docs, self.n_ids, self.chunk_bits, n_levels = struct.unpack_from("<IIII", data, 4)
        at = 20
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.null = np.unpackbits(np.frombuffer(data, np.uint8, -(-n_docs // 8), at), count=n_docs, bitorder="little").view(bool)
        at += -(-n_docs // 8)
        self.lengths = np.frombuffer(data, "<u4", n_docs, at)
        at += 4 * n_docs
        kind = np.dtype(np.uint8 if self.chunk_bits <= 8 else np.uint16)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for level in range(n_levels):
            (count,) = struct.unpack_from("<I", data, at)
            chunks = np.frombuffer(data, kind, count, at + 4)
            at += 4 + count * kind.itemsize
            bits = ranks = None
            if level < n_levels - 1:
                blocks = -(-count // RANK_BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * RANK_BLOCK // 8, at)
                at += bits.size
                ranks = np.frombuffer(data, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``, without decoding its neighbours."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BLOCK
            first = block * RANK_BLOCK // 8
            before = bits[first : (i >> 3) + 1].copy()
            before[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(before).sum())
            shift += self.chunk_bits
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            whole = chunks.astype(np.uint32)
            if bits is not None:
                whole[np.unpackbits(bits, count=chunks.size, bitorder="little").view(bool)] |= out << np.uint32(self.chunk_bits)
            out = whole
        return out


# ---------------------------------------------------------------- encoding
class PieceEncoder:
    """Encodes texts with the ``tokenizers`` library, each distinct piece once.

    A text is cut before every blank and line feed. Byte-level pre-tokenizers of this kind cut before
    white space that follows other characters, and part two white spaces in a row, so the ids of the pieces in a
    row are the ids of the text; texts for which that may not hold (``WHOLE``) are encoded in one go. Added tokens are found in
    pieces as in texts, as long as they hold no white space and take none from their sides.

    ``special_as_text`` encodes the strings of special tokens in a text like other text; by default they become
    the special ids, as the library does.
    """

    def __init__(self, path: str, memo: int | None = None, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] for t in added)
        # only byte-level pre-tokenizers cut before white space whatever follows
        self.by_pieces = plain and self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        # their tokens are written with one character for each byte
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        self.limit = MEMO_PIECES if memo is None else memo
        self.forget()

    @classmethod
    def of_worker(cls, path: str, special_as_text: bool = False) -> "PieceEncoder":
        """The encoder of this worker process, with what it remembers from earlier tasks."""
        cache, key = worker_cache("token_output"), (path, special_as_text)
        if key not in cache:
            cache[key] = cls(path, special_as_text=special_as_text)
        return cache[key]

    def forget(self) -> None:
        """The remembered pieces: their text, and where their ids are in ``ids``."""
        self.pieces = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def in_rows(self, pieces: pa.Array, row: int = 512) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and their number in each piece, of pieces that start with white space and end without.

        They are encoded in rows, as in a text, and the ids are dealt out by the bytes they stand for.
        """
        ids, sizes = [], []
        bounds = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset) if len(pieces) else np.zeros(1, np.int32)
        data = memoryview(pieces.buffers()[2]) if len(pieces) else memoryview(b"")
        for at in range(0, len(pieces), row):
            cuts = bounds[at : at + row + 1]
            (found,) = self.whole([str(data[cuts[0] : cuts[-1]], "utf-8")])
            ends = np.cumsum(self.bytes_of[found])
            places = np.searchsorted(ends, cuts[1:] - cuts[0])
            if np.array_equal(ends[np.minimum(places, ends.size - 1)], cuts[1:] - cuts[0]):
                ids.append(found)
                sizes.append(np.diff(places, prepend=-1))
            else:
                apart = self.whole(pieces.slice(at, cuts.size - 1).to_pylist())
                ids += apart
                sizes.append(np.fromiter(map(len, apart), np.int64, len(apart)))
        return ids, sizes

    def learn(self, new: pa.Array) -> np.ndarray:
        """Encode and remember ``new`` (distinct pieces); returns their places."""
        row = pc.and_(pc.match_substring_regex(new, r"^[ \n]"), pc.invert(pc.match_substring_regex(new, r"[ \t\r\n]$")))
        inner, rest = new.filter(row), new.filter(pc.invert(row))
        (found, counts), apart = self.in_rows(inner), self.whole(rest.to_pylist())
        found += apart
        sizes = np.concatenate((*counts, np.fromiter(map(len, apart), np.int64, len(apart)))).astype(np.int32)
        self.starts = np.concatenate((self.starts, self.ids.size + np.cumsum(sizes, dtype=np.int64) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, *found))
        places, first = np.empty(len(new), np.int64), len(self.pieces)
        mine = row.to_numpy(zero_copy_only=False)
        places[mine], places[~mine] = first + np.arange(len(inner)), first + len(inner) + np.arange(len(rest))
        self.pieces = pa.concat_arrays([self.pieces, inner, rest])
        return places

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Place of each of the distinct ``pieces`` among those remembered; unknown ones are learned."""
        known = pc.index_in(pieces, value_set=self.pieces)
        if len(self.pieces) + known.null_count > self.limit:  # what is of use now stays
            kept = known.drop_null().to_numpy()
            ids, sizes = self.gather(kept, self.ids, self.starts, self.sizes), self.sizes[kept]
            self.pieces, self.ids, self.sizes = self.pieces.take(pa.array(kept)), ids, sizes
            self.starts = np.cumsum(sizes, dtype=np.int64) - sizes
            known = pc.index_in(pieces, value_set=self.pieces)
        new = pc.is_null(known)
        places = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        places[new.to_numpy(zero_copy_only=False)] = self.learn(pieces.filter(new))
        return places

    @staticmethod
    def gather(places: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of the pieces at ``places``, in a row."""
        out = []
        for at in range(0, places.size, GATHER):
            part = places[at : at + GATHER]
            n = sizes[part]
            ends = np.cumsum(n, dtype=np.int64)
            out.append(ids[np.repeat(starts[part] - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (no nulls) in a row, each with ``end`` after it, and how many each has."""
        hard = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False) if self.by_pieces else np.ones(len(texts), bool)
        soft = texts.filter(pa.array(~hard))
        for white in " \n":
            soft = pc.replace_substring(soft, white, CUT + white)
        cut = pc.split_pattern(soft, CUT)
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode() if len(soft) else pa.array([], pa.string()).dictionary_encode()
        numbers = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        # texts in one go and the end count as further pieces
        more = [*self.whole(texts.filter(pa.array(hard)).to_pylist()), np.array(end, np.uint32)]
        ids, sizes = np.concatenate((self.ids, *more)), np.concatenate((self.sizes, np.fromiter(map(len, more), np.int32, len(more))))
        starts = np.concatenate((self.starts, self.ids.size + np.cumsum(sizes[self.sizes.size :], dtype=np.int64) - sizes[self.sizes.size :]))
        counts = np.ones(len(texts), np.int64)
        counts[~hard] = np.diff(bounds)
        last = np.cumsum(counts + 1) - 1
        pieces = np.empty(int(last[-1]) + 1 if last.size else 0, np.int64)
        pieces[last] = sizes.size - 1
        pieces[last[hard] - 1] = self.sizes.size + np.arange(len(more) - 1)
        pieces[np.repeat((last - counts)[~hard] - bounds[:-1], counts[~hard]) + np.arange(numbers.size)] = numbers
        total = np.concatenate(([0], np.cumsum(sizes[pieces], dtype=np.int64)))[np.concatenate(([0], last + 1))]
        return self.gather(pieces, ids, starts, sizes), np.diff(total)

    def __call__(self, text: str) -> bytes:
        """Little-endian uint32 ids of ``text``."""
        return self.encode(pa.array([text]), [])[0].astype("<u4").tobytes()


def segments(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and return DAC segments in document order.

    Rows: shard int, segment int, first_id long (ids of the shard before this
    segment), n_ids long, data binary. Null text is empty and null doc_ids come first; every
    document ends with ``end_id``. Documents are range-partitioned by doc_id; rows of
    one doc_id stay together in an order fixed by their text. A text of any length is one document and has to fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = PieceEncoder.of_worker(tokenizer_path, special_as_text)
        shard, number, before, total = TaskContext.get().partitionId(), 0, 0, 0
        names, nulls, counts, held = [], [], [], []

        def close() -> pa.RecordBatch:
            data = encode_segment(np.concatenate(names), np.concatenate(counts), np.concatenate(held), null=np.concatenate(nulls))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["shard", "segment", "first_id", "n_ids", "data"])

        for batch in batches:
            for part in slices(batch, SLICE):
                ids, sizes = encoder.encode(pc.fill_null(part.column(1), ""), [end_id])
                pa.default_memory_pool().release_unused()  # other workers share the executor's memory
                doc_ids, null = pc.fill_null(part.column(0), -1).to_numpy(), pc.is_null(part.column(0)).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                at = used = 0
                while at < sizes.size:  # a segment closes after the document that fills it
                    to = min(sizes.size, int(np.searchsorted(ends, used + segment_ids - total)) + 1)
                    names.append(doc_ids[at:to])
                    nulls.append(null[at:to])
                    counts.append(sizes[at:to])
                    held.append(ids[used : ends[to - 1]])
                    total += int(ends[to - 1]) - used
                    at, used = to, int(ends[to - 1])
                    if total >= segment_ids:
                        yield close()
                        number, before, total = number + 1, before + total, 0
                        names, nulls, counts, held = [], [], [], []
        if names:
            yield close()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dealt = plain.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "shard int, segment int, first_id long, n_ids long, data binary")


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the segments as a table in the shared folder; returns it as reread."""
    return materialize(segments(docs, tokenizer_path, end_id), "dac", compression="none")


def read_documents(written: DataFrame) -> DataFrame:
    """One row per document of a written table, decoded from its segments.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                segment = Segment(data.as_py())
                ids = segment.ids().astype("<u4").tobytes()
                ends = np.cumsum(segment.lengths, dtype=np.int64)
                starts = ends - segment.lengths
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ends.size, shard, np.int32)), pa.array(segment.doc_ids.astype(np.int64), mask=segment.null), pa.array(starts + first), pa.array(segment.lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = written.select("shard", "first_id", "data").mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows


def _with_base(rows: DataFrame, written: DataFrame) -> DataFrame:
    """``rows`` with ``base``, the ids of all shards before theirs.

    There is one total per shard, so the running sum over them is as small as the number of tasks.
    """
    totals = written.groupBy("shard").agg(F.sum("n_ids").alias("ids_in_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("ids_in_shard").over(before), F.lit(0)).alias("base"))
    # at most one row for each task of the writing job
    return rows.join(F.broadcast(base), "shard")


def document_index(written: DataFrame) -> DataFrame:
    """:func:`read_documents` with starts counted over all shards."""
    rows = _with_base(read_documents(written), written)
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def segments_at(written: DataFrame, wanted: np.ndarray) -> DataFrame:
    """first (position of the segment's first id), data: the segments that hold one of the sorted positions ``wanted``.

    A first pass reads the segments' numbers and sizes alone. The few segments it finds are named in the filter of the
    second one, so the files and row groups without any of them are not read.
    """
    spark = written.sparkSession
    first = F.col("base") + F.col("first_id")
    places = _with_base(written.select("shard", "segment", "first_id", "n_ids"), written).select("shard", "segment", first.alias("first"), (first + F.col("n_ids")).alias("behind"))
    hit = places.filter(F.exists(F.lit(wanted.tolist()), lambda p: (p >= F.col("first")) & (p < F.col("behind")))) if wanted.size else places.limit(0)
    hits = [tuple(r) for r in hit.select("shard", "segment", "first").collect()]  # at most one for each position
    named = F.col("shard").isin(sorted({h[0] for h in hits})) & F.col("segment").isin(sorted({h[1] for h in hits}))
    few = spark.createDataFrame(hits, "shard int, segment int, first long")
    return written.filter(named).join(F.broadcast(few), ["shard", "segment"]).select("first", "data")


def tokens_at(written: DataFrame, positions: Iterable[int]) -> dict[int, int]:
    """The ids at some positions of the corpus, by rank and without decoding what lies between.

    Only the segments that hold one of the positions are read (:func:`segments_at`); the positions are sent to them, so they should be few.
    """
    wanted = np.unique(np.fromiter(positions, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(data.as_py())
                mine = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + len(segment))]
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array([segment[int(p) - first] for p in mine], pa.int64())], names=["position", "id"])

    rows = segments_at(written, wanted).mapInArrow(run, "position long, id long").collect()
    found = {r["position"]: r["id"] for r in rows}
    if len(found) < wanted.size:
        raise IndexError("a position is outside the corpus")
    return found
