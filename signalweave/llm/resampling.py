"""Importance resampling towards a target distribution, by hashed n-grams.

Features are the runs of one to three words of a text, hashed to buckets. Each bucket has a gain, the log ratio of its
smoothed shares in the target and in the corpus; the sum of a text's gains plus Gumbel noise ranks the documents.

A task numbers the words of a slice of its texts and sorts the positions into a suffix array; as no n-gram has more
than three words, suffixes are told apart by three words. Where neighbouring suffixes share n words or more (the
longest common prefix), they belong to one run, an n-gram with all its occurrences: it is hashed
once, continuing the hash of the run of its first n - 1 words, and its bucket is scattered back to the positions.
Bucket counts are summed over all tasks; the second pass adds up the gains of each document's positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import placed
from .common import fresh, materialize, slices

#: Words of the longest feature, hash buckets.
LONGEST, BUCKETS = 3, 10_000
#: Seed of the noise, words that a drawn document has at least, per cent of those documents that are drawn.
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
#: Bytes of text that are sorted together (a longer text is sorted by itself).
SLICE_BYTES = 4 << 20
#: A-Z as a-z; everything below U+0080 but digits and letters as a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters and all characters beyond ASCII."""
    return text.translate(_LETTERS).split()


class Grams:
    """The n-grams of a list of texts: for n = 1 to LONGEST the bucket at each position, or -1 where a text ends before."""

    def __init__(self, texts: list[bytes], buckets: int = BUCKETS):
        words: list[bytes] = []
        starts = [0]
        for text in texts:
            words += words_of(text)
            words.append(b"")  # an end, number 0: no n-gram reaches over it
            starts.append(len(words))
        self.starts = np.array(starts, np.int64)
        number = {w: k for k, w in enumerate(dict.fromkeys([b"", *words]))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.buckets = self._scatter(ids, list(number), buckets)

    @staticmethod
    def _scatter(ids: np.ndarray, vocabulary: list[bytes], buckets: int) -> list[np.ndarray]:
        n, kinds = len(ids), len(vocabulary)
        ahead = [np.concatenate([ids[k:], np.zeros(min(k, n), np.int64)]) for k in range(LONGEST)]
        if kinds**LONGEST < 1 << 63:
            key = ahead[0]
            for more in ahead[1:]:
                key = key * kinds + more
            array = np.argsort(key, kind="stable")
        else:
            array = np.lexsort(ahead[::-1])
        ranked = [a[array] for a in ahead]
        #: words that a suffix shares with the one before it in the array, up to LONGEST
        prefix, same = np.zeros(n, np.int8), np.ones(n, bool)
        same[:1] = False
        for a in ranked:
            same[1:] &= a[1:] == a[:-1]
            prefix += same
        spaced = [b" " + w for w in vocabulary]
        out, whole = [], np.ones(n, bool)
        above, hashes = np.zeros(n, np.int64), [zlib.crc32(b"")]
        for length in range(1, LONGEST + 1):
            whole &= ranked[length - 1] > 0
            opens = (prefix < length) & whole
            run = np.cumsum(opens) - 1  # of the suffixes that have so many words before their text ends
            first = np.flatnonzero(opens)
            text = vocabulary if length == 1 else spaced
            before = map(hashes.__getitem__, above[first].tolist())
            hashes = [zlib.crc32(text[w], h) for w, h in zip(ranked[length - 1][first].tolist(), before, strict=True)]
            found = np.full(n, -1, np.int64)
            codes = np.array(hashes, np.int64) % buckets
            found[array[whole]] = codes[run[whole]]
            out.append(found)
            above = run
        return out

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        """Occurrences of each bucket."""
        return sum(np.bincount(b[b >= 0], minlength=buckets) for b in self.buckets)

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and sum of gains of each text."""
        padded = np.append(gains, 0)  # bucket -1
        total = np.concatenate([[0], np.cumsum(sum(padded[b] for b in self.buckets))])
        features = np.concatenate([[0], np.cumsum(sum((b >= 0).astype(np.int64) for b in self.buckets))])
        words = np.diff(self.starts) - 1
        return words, np.diff(features[self.starts]), np.diff(total[self.starts])


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket in all texts of ``docs``; tasks add up their own, the sums of ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                total += Grams(_texts(part.column(1)), buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.lit(0).alias("k"), F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket in the target and the corpus."""
    s, t, kinds = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + kinds) / ((s + 1) * (t.sum() + kinds)))).astype(np.int64)


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gains of all buckets, from all texts of both tables. Without texts, all shares are equal and all gains 0."""
    return gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of Gumbel noise g that depends on the seed and the id as text (null: empty text)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of each row's features (none: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                found = Grams(_texts(part.column(1)), len(model)).sums(model)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of ``docs``; rank counts the drawn ones from 1, the others have none.

    Of the N rows with ``least_words`` words or more, ``floor(percent * N / 100)`` of highest score are drawn, which is a draw without
    replacement in proportion to exp(weight / 1000); ties go to the smaller doc_id (null last). Null and empty texts have no features and weight 0. Rows that
    repeat an id have the same noise and are weighed and drawn one by one, those that tie in id and score in order of their features.
    Whole texts of any length are read; empty tables give an empty result, and other columns are not looked at.
    """
    scored = weigh(docs, fit(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scored")
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranked = placed(scored.filter(enough), order, place="place", store=materialize)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked.withColumn("rank", rank).drop("place").unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that repeat an id are drawn if one of them is."""
    found = resample(docs, target, percent, least_words, seed).filter("rank IS NOT NULL").select(F.col("doc_id").alias(name := fresh(docs, "drawn"))).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
