"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and of itself, each hashed to a row of an
embedding table. A word's vector is the mean of these rows, a text's the mean over
its words; a softmax over two classes follows. Unseen misspellings share most n-grams with
the words they come from. Both layers are linear, so a trained model is folded to one
number per hash bucket, and a text is scored by a mean of word scores.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BUCKETS, DIMENSIONS = 1 << 17, 4
SHORTEST, LONGEST = 3, 6
#: Labelled rows of each class that are trained on, in expectation; drawn by a hash of the id.
SAMPLE_ROWS = 2500
ROUNDS, BATCH, RATE, DECAY = 6, 64, 0.05, 1e-6
#: Words a worker remembers the scores of; beyond it the memory starts anew.
MEMO_WORDS = 500_000
THRESHOLD = 0.3
#: Texts that a bucket must occur in to count.
LEAST_TEXTS = 3
PUNCTUATION = b".,;:!?\"'()[]{}|-*#%$&"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word itself, bare of punctuation, and of its n-grams between marks for start and end."""
    marked = [b"<" + w.strip(PUNCTUATION) + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    octets = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    owners, keys = [np.arange(len(marked))], [np.fromiter(map(zlib.crc32, marked), np.uint64, len(marked))]
    for n in range(SHORTEST, LONGEST + 1):
        places = max(0, octets.size - n + 1)
        key = np.full(places, n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | octets[k : k + places]
        inside = owner[:places] == owner[n - 1 : n - 1 + places]
        owners.append(owner[:places][inside])
        keys.append(key[inside])
    key = np.concatenate(keys) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate(owners), (key >> np.uint64(40)).astype(np.int64) % BUCKETS


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> dict:
    """Fit on whole texts; returns the folded model: a score per bucket and a bias."""
    bags = [Counter(words_of(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bags)))} if bags else {}
    y = np.asarray(labels, np.float64)
    if not vocabulary or not 0 < y.sum() < y.size:
        rate = float(np.clip(y.mean() if y.size else 0.0, 1e-6, 1 - 1e-6))
        return {"scores": np.zeros(BUCKETS, np.float32), "bias": float(np.log(rate / (1 - rate)))}
    # word -> buckets and text -> words, as rows of sparse matrices of means
    names, parts = list(vocabulary), []
    for at in range(0, len(names), 50_000):
        owner, bucket = features(names[at : at + 50_000])
        order = np.argsort(owner, kind="stable")
        parts.append(((owner[order] + at).astype(np.int32), bucket[order].astype(np.int32)))
    rows, buckets = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = np.bincount(rows, minlength=len(names))
    columns = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[columns] = np.arange(columns.size)
    used = place[buckets]
    share = (1.0 / sizes)[rows]
    doc_rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    doc_words = np.fromiter((vocabulary[w] for b in bags for w in b), np.int64, doc_rows.size)
    totals = np.array([max(1, b.total()) for b in bags])
    doc_share = np.fromiter((n for b in bags for n in b.values()), np.float64, doc_rows.size) / totals[doc_rows]
    # text -> buckets: the product of both, kept as one sparse matrix
    pair_doc, pair_bucket, pair_share = [], [], []
    starts = np.concatenate(([0], np.cumsum(sizes)))
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    for d in range(len(bags)):
        mine = doc_words[bounds[d] : bounds[d + 1]]
        if not mine.size:
            continue
        count = sizes[mine]
        at = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        weight = np.bincount(used[at], share[at] * np.repeat(doc_share[bounds[d] : bounds[d + 1]], count))
        kept = np.flatnonzero(weight)
        pair_doc.append(np.full(kept.size, d, np.int32))
        pair_bucket.append(kept.astype(np.int32))
        pair_share.append(weight[kept].astype(np.float32))
    docs_at = np.array([p[0] for p in pair_doc])
    first = np.concatenate(([0], np.cumsum([p.size for p in pair_bucket])))[:-1]
    pair_bucket, pair_share = np.concatenate(pair_bucket), np.concatenate(pair_share)
    # n-grams that most texts share say little, those of one or two texts nothing: scale by rarity
    seen = np.bincount(pair_bucket, minlength=columns.size)
    rarity = np.where(seen < LEAST_TEXTS, 0.0, np.log((1 + len(bags)) / (1 + seen)) + 0.1)
    pair_share = (pair_share * rarity[pair_bucket].astype(np.float32)).astype(np.float32)
    gain = np.float32(1.0 / np.sqrt(max(1e-12, np.mean(np.add.reduceat(pair_share**2, first)))))
    pair_share *= gain
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (columns.size, DIMENSIONS))
    out = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.log(np.array([1 - y.mean(), y.mean()]))
    target = np.stack([1 - y, y], axis=1)[docs_at]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    ends, step = np.append(first, pair_bucket.size), 0
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(docs_at.size), -(-docs_at.size // BATCH)):
            step += 1
            counts = (ends[1:] - ends[:-1])[part]
            starts_in = np.concatenate(([0], np.cumsum(counts)))[:-1]
            at = np.repeat(ends[:-1][part] - starts_in, counts) + np.arange(counts.sum())
            bucket, weight, row = pair_bucket[at], pair_share[at], np.repeat(np.arange(part.size), counts)
            hidden = np.stack([np.add.reduceat(table[bucket, k] * weight, starts_in) for k in range(DIMENSIONS)], axis=1)
            logits = hidden @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            probs = np.exp(logits)
            probs /= probs.sum(axis=1, keepdims=True)
            error = (probs - target[part]) / part.size
            d_hidden = error @ out.T
            d_table = np.stack([np.bincount(bucket, d_hidden[row, k] * weight, columns.size) for k in range(DIMENSIONS)], axis=1) + DECAY * table
            for (m, v), p, g in zip(moments, (table, out, bias), (d_table, hidden.T @ error, error.sum(axis=0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    scores = np.zeros(BUCKETS)
    scores[columns] = table @ (out[:, 1] - out[:, 0]) * rarity * float(gain)
    return {"scores": scores.astype(np.float32), "bias": float(bias[1] - bias[0])}


class Scorer:
    def __init__(self, model: dict):
        self.scores, self.bias = model["scores"].astype(np.float64), model["bias"]
        self.memo: dict[bytes, float] = {}

    def __call__(self, text: str | None) -> float:
        words, memo = words_of(text), self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list(set(words))
            owner, bucket = features(new)
            means = np.bincount(owner, self.scores[bucket]) / np.bincount(owner)
            memo.update(zip(new, means.tolist(), strict=True))
        logit = self.bias + (sum([memo[w] for w in words]) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Train on labelled rows of ``docs`` for which ``train_on`` holds.

    About ``sample_rows`` rows of each class are drawn by a hash of the id; the sample is
    bounded, so one task trains. The model is a number per bucket, whatever the input. Where the
    draw changed the proportion of the classes, the bias is set back to it. Null labels and ids are left
    out, of repeated labels of an id the highest counts; of documents that repeat an id one is learned from, chosen by a
    hash of its text. Null texts are empty and whole texts are used; without labels of both classes, or on
    empty tables, the score is the share of the labels.
    """
    marks = labels.filter(train_on & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    shares = {k: min(1.0, sample_rows / n) for k, n in counts.items()}
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    kept = marks.filter(unit < F.when(F.col("y") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0)))
    # the sample's labels are few, so the texts need no shuffle
    kept = F.broadcast(kept) if kept.count() <= 10 * sample_rows else kept
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(kept, "doc_id")
    sample = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("draw"), "text"))["text"].alias("text")).select("doc_id", "text", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted({(int(i), t, int(y)) for b in batches for i, t, y in zip(b["doc_id"], b["text"], b["y"], strict=True)})
        yield pd.DataFrame({"model": [pickle.dumps(train([t for _, t, _ in rows], [y for _, _, y in rows]))]})

    made = sample.repartition(1).mapInPandas(run, "model binary").first()  # no row where the sample is empty
    model = pickle.loads(made[0]) if made else train([], [])
    if shares.get(1) and shares.get(0):
        model["bias"] += float(np.log(shares[0] / shares[1]))
    return model


def score(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """``docs`` with the toxicity (0 to 1) of each whole text in the column ``name``.

    Null and empty texts have the score of the bias alone. A text of any length is one mean over its words. Rows
    keep their columns and repeated rows are repeated; ``name`` must not be one of the columns.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name!r} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for part in texts:
            yield pd.Series([scorer(x) for x in part], dtype="float64")

    return docs.withColumn(name, toxicity(F.col("text")))
