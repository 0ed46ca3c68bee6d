"""Language-model scoring by a probabilistic suffix tree.

A text is a sequence of bytes: its words in lower case with one space before each, and one end.
The tree holds contexts of up to ``DEPTH`` bytes. Training counts, over all training texts,
which byte follows which context; a context is retained when what follows it diverges
enough from what follows the context shorter by a byte. Next-byte distributions are
smoothed towards those of the shorter context. To score, each byte is predicted from
the longest suffix of the bytes before it that is a state of the tree.

The tree grows with the input, so no task holds all of it. Texts are cut into chunks; a chunk
sends its distinct n-grams to shards, dealt by the last ``SHARD`` bytes of the context.
All longer contexts of an n-gram are in its shard, which returns the n-grams'
probabilities to the chunk. Shorter contexts are few and are sent to every task.

Word counts, for the base score, come from all training texts too. Frequent words are sent to
every task; the others are looked up by a join.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release

#: Longest context, in bytes.
DEPTH = 6
#: A context is retained when its occurrences times their divergence from the shorter
#: context (in nats) come to ``LEAST_NATS`` and to this share of all bytes. It is 0, so that a
#: context with the same evidence is retained at every size of the input.
GAIN, LEAST_NATS = 0.0, 4.0
#: Occurrences that the shorter context's distribution counts for, per distinct next byte.
SMOOTHING = 0.5
#: Words whose counts are sent to all tasks; the rest are joined.
BROADCAST_WORDS = 100_000
#: Distinct words a task holds before it passes them on.
HELD = 500_000
#: Bytes that are counted at a time, and bytes of a chunk.
SLICE, CHUNK = 1 << 20, 1 << 23
#: Bytes at the end of a context that choose its shard.
SHARD = 3
#: Shards, or as many as shuffle partitions where these are more. A task has the n-grams of one of its shards in memory at a time.
SHARDS = 128
#: The end of a text; UTF-8 has no such byte.
END = 255
#: Keys: one leading 1 bit, then 8 bits for each symbol, the latest lowest.
BITS = 8
#: Kinds of rows that a chunk makes: counts of words, counts of short n-grams, n-grams for a shard, texts.
WORD, LOW, GRAMS, TEXT = range(4)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def symbols_of(words: list[bytes]) -> np.ndarray:
    """Bytes of the words, a space before each, and END."""
    out = np.empty(sum(map(len, words)) + len(words) + 1, np.uint8)
    out[:-1] = np.frombuffer(b"".join([b" " + w for w in words]), np.uint8)
    out[-1] = END
    return out


def keys_of(sequence: np.ndarray, depth: int | None = None) -> np.ndarray:
    """At each place, the key of the last ``depth`` symbols and the one there.

    Near the start of a text the context is as long as there are symbols before.
    """
    s = sequence.astype(np.uint64)
    key = np.ones(s.size, np.uint64)
    for back in range(DEPTH if depth is None else depth, -1, -1):
        if back == 0:
            key = (key << np.uint64(BITS)) | s
        elif s.size > back:
            key[back:] = (key[back:] << np.uint64(BITS)) | s[:-back]
    return key


def grams(sequences: list[np.ndarray], depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the last ``depth`` symbols and the next one, and their counts."""
    parts = [keys_of(s, depth) for s in sequences]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and their summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")  # parts are sorted, which a stable sort makes use of
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: keys.size])
    return keys[at], np.add.reduceat(np.concatenate([n for _, n in parts])[order], at).astype(np.int64) if at.size else np.zeros(0, np.int64)


def _start(symbols: int) -> np.uint64:
    """The least key of so many symbols."""
    return np.uint64(1 << (BITS * symbols))


def _suffix(key: np.ndarray, symbols: int) -> np.ndarray:
    """The last ``symbols`` symbols of keys that have as many or more, as keys."""
    return (key & (_start(symbols) - np.uint64(1))) | _start(symbols)


# ---------------------------------------------------------------- the tree
def smooth(keys: np.ndarray, n: np.ndarray, below: np.ndarray, share: np.ndarray, first: int = 0, last: int | None = None, least: float = LEAST_NATS, forced: np.ndarray | None = None, every: bool = False) -> dict:
    """Probabilities of the last symbol of distinct n-grams after their longest retained context.

    Handles contexts of ``first`` to ``last`` symbols; ``n`` are training counts (0 where an
    n-gram only occurs in texts to score), ``below`` and ``share`` the smoothed and the plain
    probability after the context of ``first - 1`` symbols. All n-grams with a context
    of ``first`` symbols must be given together. Retained are contexts that pass the divergence
    test or are in ``forced`` (of ``last`` symbols), with all their suffixes, or all contexts if ``every``.
    Returns value, share (after the longest context handled), deep (a context of ``first`` symbols
    is retained) and roots (the retained contexts of ``first`` symbols).
    """
    last = DEPTH if last is None else last
    levels, share = [], share.copy()
    for d in range(first, last + 1):
        at = np.flatnonzero(keys >= _start(d + 1))
        pair, at_one, pair_of = np.unique(_suffix(keys[at], d + 1), return_index=True, return_inverse=True)
        count = np.bincount(pair_of, n[at], pair.size)
        state, state_of = np.unique(pair >> np.uint64(BITS), return_inverse=True)
        total = np.bincount(state_of, count, state.size)
        weight = SMOOTHING * np.maximum(1, np.bincount(state_of, count > 0, state.size))
        plain = count / np.maximum(total, 1)[state_of]
        passed = np.full(state.size, every or d == 0)
        if d and not every:
            seen = np.flatnonzero(count)
            gains = count[seen] * np.log(plain[seen] / share[at[at_one[seen]]])
            passed |= np.bincount(state_of[seen], gains, state.size) >= least
        share[at] = plain[pair_of]
        levels.append((d, at, pair_of, count, state, state_of, total, weight, passed))
    held = forced
    for d, _, _, _, state, _, _, _, passed in reversed(levels):
        if held is not None and held.size:
            passed |= np.isin(state, held)
        held = _suffix(state[passed], d - 1) if d else None
    value, deep = below.astype(float), np.zeros(keys.size, bool)
    for d, at, pair_of, count, _, state_of, total, weight, passed in levels:
        on = passed[state_of][pair_of]
        if d == first:
            deep[at] = on
        of, at = pair_of[on], at[on]
        group = state_of[of]
        value[at] = (count[of] + weight[group] * value[at]) / (total[group] + weight[group])
    return {"value": value, "share": share, "deep": deep, "roots": levels[0][4][levels[0][8]]}


def fit(counts: DataFrame, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """n-gram counts (key, n) and the least gain of a context, for :class:`Scorer`; they have to fit the driver."""
    rows = counts.select("key", "n").toPandas()
    keys, n = merge([(rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))])
    return keys, n, max(LEAST_NATS, gain * float(n.sum()))


class Scorer:
    """Scores a few texts by counts held in memory, without shards."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        self.keys, self.n, self.least = model

    def __call__(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of symbols."""
        places = [keys_of(s) for s in sequences]
        keys, n = merge([(self.keys, self.n), *[(k, np.zeros(k.size, np.int64)) for k in places]])
        value = smooth(keys, n, np.full(keys.size, 1 / 256), np.ones(keys.size), least=self.least)["value"]
        return np.array([np.log10(value[np.searchsorted(keys, k)]).sum() for k in places])


# ---------------------------------------------------------------- chunks and shards
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, byte planes apart, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(a.size, a.itemsize).T).tobytes() for a in arrays), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data, n * sum(sizes), "zstd", asbytes=True), np.uint8).reshape(-1, n)
    cuts = np.cumsum([0, *sizes])
    return [np.ascontiguousarray(planes[a:b].T).view(k).ravel() for a, b, k in zip(cuts[:-1], cuts[1:], kinds, strict=True)]


def _dealt(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Shard and places in ``keys`` of the n-grams that have a context of ``SHARD`` symbols or more."""
    at = np.flatnonzero(keys >= _start(SHARD + 1))
    mixed = _suffix(keys[at] >> np.uint64(BITS), SHARD) * np.uint64(0x9E3779B97F4A7C15)
    shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[part[0]]), at[part]) for part in np.split(order, cuts) if part.size]


def _low(keys: np.ndarray) -> np.ndarray:
    """The n-gram with a context shorter than ``SHARD``."""
    return np.where(keys >= _start(SHARD), _suffix(keys, SHARD), keys)


def _rows(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows with the same value in column ``by``, which are next to each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[by] != held[0][by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count_rows(docs: DataFrame, train_on: Column, shards: int) -> DataFrame:
    """Rows of every kind (kind, chunk, shard, n, data); a ``LOW`` row has its key as chunk. The end is the empty word."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words: Counter = Counter()
        chunk = TaskContext.get().partitionId() << 16
        ids, texts, parts, size = [], [], [], 0
        held: dict[bool, list] = {True: [], False: []}
        waiting = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "chunk", "shard", "n", "data"])

        def out_words() -> Iterator[pa.RecordBatch]:
            items = list(words.items())
            for at in range(0, len(items), 10_000):
                yield batch_of([(WORD, None, None, n, w) for w, n in items[at : at + 10_000]])
            words.clear()

        def add_grams() -> None:
            nonlocal waiting
            for train, sequences in held.items():
                if sequences:
                    keys, n = grams(sequences)
                    parts.append((keys, n if train else np.zeros(keys.size, np.int64)))
            held[True], held[False], waiting = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, parts, size, chunk
            add_grams()
            keys, n = merge(parts)
            raw = pickle.dumps((ids, np.concatenate(texts).tobytes()), protocol=5)
            yield batch_of([(TEXT, chunk, -1, len(raw), pa.compress(raw, "zstd", asbytes=True))])
            low, n_low = merge([(_low(keys), n)])
            low, n_low = low.view(np.int64).tolist(), n_low.tolist()
            for at in range(0, len(low), 10_000):
                yield batch_of([(LOW, k, None, c, None) for k, c in zip(low[at : at + 10_000], n_low[at : at + 10_000], strict=True)])
            for shard, at in _dealt(keys, shards):
                yield batch_of([(GRAMS, chunk, shard, at.size, _pack(keys[at], n[at].astype(np.uint32)))])
            ids, texts, parts, size, chunk = [], [], [], 0, chunk + 1

        for batch in batches:
            for doc_id, text, train in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                mine = words_of(text.as_py())
                if train:
                    words.update(mine)
                    words[b""] += 1
                symbols = symbols_of(mine)
                ids.append(doc_id)
                texts.append(symbols)
                held[bool(train)].append(symbols)
                waiting += symbols.size
                size += symbols.size
                if waiting >= SLICE:
                    add_grams()
                if size >= CHUNK:
                    yield from close()
                if len(words) > HELD:
                    yield from out_words()
        if ids:
            yield from close()
        yield from out_words()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train_on.alias("train")).mapInArrow(run, "kind int, chunk long, shard int, n long, data binary")


def _shard_values(rows: DataFrame, parts: int, low: object, least: float) -> DataFrame:
    """chunk, shard, n, data: log10 probabilities of a chunk's n-grams in a shard, NaN where no context of ``SHARD`` symbols is retained.

    The row without a chunk has the suffixes, shorter by one, of the retained contexts of ``SHARD`` symbols.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["chunk", "shard", "n", "data"], (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        known, value, share = low.value
        for group in _rows(batches, 1):
            parts = [_unpack(data, n, np.uint64, np.uint32) for _, _, n, data in group]
            keys, n = merge(parts)
            at = np.searchsorted(known, _low(keys))
            made = smooth(keys, n, value[at], share[at], SHARD, None, least)
            logs = np.where(made["deep"], np.log10(made["value"]), np.nan).astype(np.float32)
            roots = np.unique(_suffix(made["roots"], SHARD - 1))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, group[0][1], roots.size, _pack(roots)), kinds, strict=True)], names=names)
            for (chunk, shard, size, _), (k, _) in zip(group, parts, strict=True):
                row = (chunk, shard, size, _pack(logs[np.searchsorted(keys, k)]))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    dealt = rows.filter(F.col("kind") == GRAMS).select("chunk", "shard", "n", "data").repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "chunk long, shard int, n long, data binary")


def _chunk_scores(sequences: list[np.ndarray], values: list[tuple], shards: int, low: tuple) -> np.ndarray:
    """log10 probability of each sequence of a chunk, from what the shards returned (shard, n, data)."""
    found, slices, waiting, size = [], [], [], 0
    for k, s in enumerate(sequences):
        waiting.append(keys_of(s))
        size += s.size
        if size >= SLICE or k + 1 == len(sequences):
            keys, where = np.unique(np.concatenate(waiting), return_inverse=True)
            slices.append((keys, where.astype(np.int32), np.cumsum([0, *[w.size for w in waiting[:-1]]])))
            waiting, size = [], 0
    every = np.sort(np.concatenate([x[0] for x in slices]))  # np.unique would build a hash table here, slower and larger
    every = every[np.append(True, every[1:] != every[:-1])]
    known, value = low
    logs = value[np.searchsorted(known, _low(every))]
    of = {shard: (n, data) for shard, n, data in values}
    for shard, at in _dealt(every, shards):
        (mine,) = _unpack(of[shard][1], of[shard][0], np.float32)
        deep = ~np.isnan(mine)
        logs[at[deep]] = mine[deep]
    for keys, where, starts in slices:
        each = logs[np.searchsorted(every, keys)][where]
        found.append(np.add.reduceat(each, starts, dtype=np.float64))
    return np.concatenate(found)


# ---------------------------------------------------------------- scoring
def _frequent(vocabulary: DataFrame, most: int) -> dict[bytes, float]:
    """log10(count + 1) of the words at or above a count that ``most`` words have at most, and that of the end."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    steps = {r[0]: r[1] for r in vocabulary.groupBy(level.alias("level")).count().collect()}  # 8 for each doubling
    taken, least = 0, None
    for step in sorted(steps, reverse=True):
        if taken + steps[step] > most:
            break
        taken, least = taken + steps[step], step
    wanted = F.col("word") == F.lit(b"")
    rows = vocabulary.filter(wanted | (level >= least) if least is not None else wanted).select("word", "c").toPandas()
    return dict(zip(map(bytes, rows["word"]), np.log10(rows["c"].to_numpy(float) + 1).tolist(), strict=True))


def scores(docs: DataFrame, train_on: Column, gain: float = GAIN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Learns from the rows for which ``train_on`` holds. Null texts are empty: one end. Tokens
    are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and an end. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens, with c the training count of a token,
    N all training tokens and V the distinct ones; n_known counts the tokens with c > 0. score is
    the tree's log10 probability of the text. Without training rows all bytes are
    equally likely. Repeated rows are repeated in the result.
    """
    spark, parts = docs.sparkSession, partitions(docs)
    shards = max(SHARDS, parts)
    rows = materialize(_count_rows(docs, train_on, shards), "lm-counts", by="kind")
    vocabulary = materialize(rows.filter(F.col("kind") == WORD).groupBy(F.col("data").alias("word")).agg(F.sum("n").alias("c")), "lm-words")
    release(rows, f"kind={WORD}")
    n_all, n_distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # contexts of fewer than SHARD bytes, and what follows them: as many as the bytes in use allow, whatever the input
    short = rows.filter(F.col("kind") == LOW).groupBy(F.col("chunk").alias("key")).agg(F.sum("n").alias("n")).toPandas()
    low, n_low = merge([(short["key"].to_numpy(np.int64).view(np.uint64), short["n"].to_numpy(np.int64))])
    least, ones = max(LEAST_NATS, gain * float(n_low.sum())), np.ones(low.size)
    full = smooth(low, n_low, ones / 256, ones, 0, SHARD - 1, every=True)
    values = materialize(_shard_values(rows, parts, spark.sparkContext.broadcast((low, full["value"], full["share"])), least), "lm-values")
    release(rows, f"kind={GRAMS}")
    roots = [_unpack(bytes(r["data"]), r["n"], np.uint64)[0] for r in values.filter(F.col("chunk").isNull()).select("n", "data").collect() if r["n"]]
    forced = np.unique(np.concatenate(roots)) if roots else np.zeros(0, np.uint64)
    exact = smooth(low, n_low, ones / 256, ones, 0, SHARD - 1, least, forced)
    sent = spark.sparkContext.broadcast((low, np.log10(exact["value"]), pickle.dumps(_frequent(vocabulary, BROADCAST_WORDS), protocol=5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, value, known = sent.value
        known = pickle.loads(known)
        names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"]
        for (chunk, _, size, data), *returned in _rows(batches, 0):
            ids, symbols = pickle.loads(pa.decompress(data, size, "zstd", asbytes=True))
            texts = symbols.split(bytes([END]))[:-1]
            logs = _chunk_scores([np.frombuffer(t + bytes([END]), np.uint8) for t in texts], [r[1:] for r in returned], shards, (low, value))
            for begin in range(0, len(ids), 10_000):
                columns: list[list] = [[], [], [], [], []]
                rare_words, rare_counts, bounds = [], [], [0]
                for k in range(begin, min(begin + 10_000, len(ids))):
                    words = texts[k].split()
                    found = [known.get(w) for w in words]
                    missing = Counter([w for w, x in zip(words, found, strict=True) if x is None])
                    seen = len(words) - missing.total() + (b"" in known)
                    base = known.get(b"", 0.0) + sum([x for x in found if x is not None])
                    for column, x in zip(columns, ((chunk << 24) + k, ids[k], len(words) + 1, seen, base), strict=True):
                        column.append(x)
                    rare_words += missing.keys()
                    rare_counts += missing.values()
                    bounds.append(len(rare_words))
                pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())], names=["word", "n"])
                rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)
                plain = [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.float64(),), strict=True)]
                yield pa.RecordBatch.from_arrays([*plain, pa.array(logs[begin : begin + 10_000]), rare], names=names)

    texts = rows.filter(F.col("kind") == TEXT).select("chunk", "shard", "n", "data").union(values.filter(F.col("chunk").isNotNull()))
    gathered = texts.repartition(parts, "chunk").sortWithinPartitions("chunk", "shard")
    found = gathered.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, n: int>>")
    found = materialize(found, "lm-scored")
    release(rows)
    release(values)
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    looked = rare.join(vocabulary, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    out = found.drop("rare").join(looked, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_distinct + 1)))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

