"""Language identification by interpolated Kneser-Ney character models.

Training counts character n-grams of each language up to ``ORDER`` and turns them
into interpolated Kneser-Ney probabilities. All languages share one sorted array of
n-gram hashes per order, with a row of log probabilities beside it (one for each
language, smoothing resolved), and one per context with the back-off weights. A text
gets the language of lowest cross-entropy per character. It is rejected where even
that is above what unseen texts of the language show, by a margin that allows for
the length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, worker_cache

#: Longest n-gram, and bits of a symbol in it; a packed n-gram has 64 bits.
ORDER, BITS = 4, 16
#: Training rows of a language, in expectation. A fixed fraction of its rows is drawn by a
#: hash of the id, so that a larger corpus doesn't mean a larger model.
SAMPLE_ROWS = 500
#: Discount of Kneser-Ney smoothing.
DISCOUNT = 0.75
#: One in so many texts is set apart to measure the cross-entropy of unseen texts.
FOLD = 5
#: Nats per character above that mean, and standard errors, before a text is rejected.
SLACK_NATS, SLACK_SIGMAS = 1.0, 5.0
#: Characters that are scored at a time.
SLICE = 1 << 18
UNKNOWN = "und"


class Folding:
    """Maps code points to symbols: 0 for other than letters, 1 for unseen letters, 2 and up as trained.

    Symbols have ``BITS`` bits. Letters beyond that many, which no sample has had yet, share the symbols of others.
    """

    def __init__(self, letters: np.ndarray):
        self.letters = letters
        cache = worker_cache("language_id")
        if "alphabetic" not in cache:
            cache["alphabetic"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.symbol = cache["alphabetic"].astype(np.uint16)
        self.symbol[letters] = np.arange(letters.size) % ((1 << BITS) - 2) + 2

    def __call__(self, text: str) -> np.ndarray:
        """Symbols with runs of 0 collapsed, one before the first and after the last letter."""
        out = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        out = np.concatenate((np.zeros(1, np.uint16), out, np.zeros(1, np.uint16)))
        return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]


def _mix(keys: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of packed n-grams (finaliser of splitmix64)."""
    x = keys ^ np.uint64((order * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(symbols: np.ndarray, order: int) -> np.ndarray:
    """For each position from 1 on: the last ``order`` symbols up to it, in ``BITS`` bits each (0 before the start)."""
    padded = np.concatenate((np.zeros(order, np.uint64), symbols.astype(np.uint64)))
    out = np.zeros(symbols.size - 1, np.uint64)
    for k in range(order):
        back = order - 1 - k
        out |= padded[order + 1 - back : order + symbols.size - back] << np.uint64(BITS * back)
    return out


class HashArray:
    """Sorted 64-bit hashes with a row of values beside each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        # the leading 16 bits give the stretch of the array to search
        self.first = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int64)
        self.steps = max(1, int(np.diff(np.append(self.first, keys.size)).max(initial=1)).bit_length())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where absent: bisection inside the key's stretch."""
        if not self.keys.size:
            return np.full(keys.size, -1)
        top = (keys >> np.uint64(48)).astype(np.int64)
        at = self.first[top]
        last = self.keys.size - 1
        for step in range(self.steps - 1, -1, -1):
            ahead = np.minimum(at + (1 << step), last)
            at = np.where(self.keys[ahead] <= keys, ahead, at)
        at = np.minimum(at, last)
        return np.where(self.keys[at] == keys, at, -1)


def _count(packed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(packed), return_counts=True) if packed else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def train(texts: dict[str, list[str]]) -> dict:
    """Models of all languages with at least one letter in ``texts``, with the limits of rejection.

    The limits come from texts that a model has not seen: every ``FOLD``-th text of a language
    is scored by models of the others. Languages with fewer texts are measured on their own.
    """
    rest = {lang: [t for i, t in enumerate(ts) if i % FOLD or len(ts) < FOLD] for lang, ts in texts.items()}
    apart = {lang: ts[::FOLD] if len(ts) >= FOLD else ts for lang, ts in texts.items()}
    model, held = _models(texts), _models(rest)
    unseen, seen = Scorer(held), Scorer(model)
    means, spreads = [], []
    for lang in model["langs"]:
        for judge, mine in ((unseen, apart[lang]), (seen, texts[lang])):
            if lang not in judge.langs:
                continue
            sums, lengths = judge.sums(mine)
            keep = lengths > 0
            if keep.any():
                break
        j = judge.langs.index(lang)
        entropy = -sums[keep, j] / lengths[keep]
        mean = float(-sums[keep, j].sum() / lengths[keep].sum())
        means.append(mean)
        spreads.append(float(np.sqrt(np.average((entropy - mean) ** 2 * lengths[keep]))))
    model["mean"], model["spread"] = np.array(means), np.array(spreads)
    return model


def _models(texts: dict[str, list[str]]) -> dict:
    points = np.concatenate([np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for ts in texts.values() for t in ts] or [np.zeros(0, np.uint32)])
    values, counts = np.unique(points, return_counts=True)
    letters = [(c, v) for v, c in zip(values.tolist(), counts.tolist(), strict=True) if chr(v).isalpha()]
    fold = Folding(np.array([v for _, v in sorted(letters, key=lambda x: (-x[0], x[1]))], np.uint32))
    symbols = {lang: [s for t in ts if (s := fold(t)).size > 1] for lang, ts in texts.items()}
    langs = sorted(lang for lang, seqs in symbols.items() if seqs)
    size = fold.letters.size + 2
    grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for n in range(1, ORDER + 1):
        grams.append({lang: _count([_packed(s, n) for s in symbols[lang]]) for lang in langs})
    # Kneser-Ney: below the highest order a gram counts once for each symbol seen before it
    model: dict = {"langs": langs, "letters": fold.letters, "tables": [], "weights": []}
    previous: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([grams[n - 1][lang][0] for lang in langs])) if langs else np.zeros(0, np.uint64)
        contexts = np.unique(union >> np.uint64(BITS))
        probs = np.zeros((union.size, len(langs)))
        weights = np.ones((contexts.size, len(langs)))
        for j, lang in enumerate(langs):
            keys, found = grams[n - 1][lang]
            if n < ORDER:
                keys, found = np.unique(grams[n][lang][0] & np.uint64((1 << (BITS * n)) - 1), return_counts=True)
            at = np.searchsorted(union, keys)
            count = np.zeros(union.size)
            count[at] = found
            where = np.searchsorted(contexts, union >> np.uint64(BITS))
            total = np.bincount(where, count, contexts.size)
            kinds = np.bincount(where, count > 0, contexts.size)
            seen = total > 0
            weights[seen, j] = DISCOUNT * kinds[seen] / total[seen]
            if previous is None:
                below = np.full(union.size, 1.0 / size)
            else:
                below = previous[1][np.searchsorted(previous[0], union & np.uint64((1 << (BITS * (n - 1))) - 1)), j]
            share = np.divide(np.maximum(count - DISCOUNT, 0), total[where], out=np.zeros(union.size), where=seen[where])
            probs[:, j] = share + weights[where, j] * below
        previous = (union, probs)
        model["tables"].append((_mix(union, n), np.log(probs).astype(np.float32)))
        model["weights"].append((_mix(contexts, 100 + n), np.log(weights).astype(np.float32)))
    model["floor"] = float(np.log(1.0 / size))
    return model


class Scorer:
    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.fold = Folding(model["letters"])
        self.tables = [HashArray(k, v) for k, v in model["tables"]]
        self.weights = [HashArray(k, v) for k, v in model["weights"]]

    def _scores(self, symbols: np.ndarray) -> np.ndarray:
        """Log probabilities (positions, languages) of the symbols from the second on."""
        packed = _packed(symbols, ORDER)
        left = np.arange(packed.size)
        for n in range(ORDER, 0, -1):
            grams = packed[left] & np.uint64((1 << (BITS * n)) - 1)
            at = self.tables[n - 1].find(_mix(grams, n))
            hit = at >= 0
            if n == ORDER:
                out = np.take(self.tables[n - 1].values, at, axis=0, mode="clip")
                out[~hit] = 0
            else:
                out[left[hit]] += self.tables[n - 1].values[at[hit]]
            left, grams = left[~hit], grams[~hit]
            if not left.size:
                return out
            at = self.weights[n - 1].find(_mix(grams >> np.uint64(BITS), 100 + n))
            known = at >= 0
            out[left[known]] += self.weights[n - 1].values[at[known]]
        out[left] += np.float32(self.model["floor"])
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by language, and its number of scored symbols (0 without a letter)."""
        sums, lengths = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not self.langs:
            return sums, lengths
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        lead = np.zeros(ORDER - 1, np.uint16)

        def flush() -> None:
            # each text brings its own start, so scores don't depend on what else is in the slice
            starts = np.cumsum([0] + [h.size for h in held])[:-1]
            scores = np.concatenate((np.zeros((1, len(self.langs)), np.float32), self._scores(np.concatenate(held))))
            scores[(starts[:, None] + np.arange(ORDER)).ravel()] = 0
            sums[owners] = np.add.reduceat(scores, starts, axis=0, dtype=np.float64)

        for i, text in enumerate(texts):
            if not text:
                continue
            symbols = self.fold(text)
            if symbols.size < 2 or not symbols.any():
                continue
            lengths[i] = symbols.size - 1
            held.append(np.concatenate((lead, symbols)))
            owners.append(i)
            size += symbols.size
            if size >= SLICE:
                flush()
                held, owners, size = [], [], 0
        if held:
            flush()
        return sums, lengths

    def classify(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, cross_entropy and rejected for each text."""
        sums, lengths = self.sums(texts)
        some = (lengths > 0) & bool(self.langs)
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        if not some.any():
            return out
        per = -sums[some] / lengths[some, None]
        best = per.argmin(axis=1)
        low = per[np.arange(best.size), best]
        # share of the best language, from per-character likelihoods over up to 40 characters
        scale = np.minimum(lengths[some], 40)[:, None]
        share = 1 / np.exp((low[:, None] - per) * scale).sum(axis=1)
        limit = self.model["mean"][best] + SLACK_NATS + SLACK_SIGMAS * self.model["spread"][best] / np.sqrt(lengths[some])
        out.loc[some, "lang_pred"] = np.array(self.langs, object)[best]
        out.loc[some, "score"] = share
        out.loc[some, "cross_entropy"] = low
        out.loc[some, "rejected"] = low > limit
        return out


RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def draws(docs: DataFrame) -> DataFrame:
    """lang, text and the hash that decides whether a row is learned from."""
    return docs.select("lang", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(1)).alias("draw"))


def fit(docs: DataFrame, train_on: Column, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Train on a sample of the rows of ``docs`` (doc_id, text, lang) for which ``train_on`` holds.

    About ``sample_rows`` rows of each language are drawn by a hash of the id and the text, rows that repeat both
    once, so ids may be null or repeated. The sample is bounded, so one task can train; the model it returns is as large as the
    sample at most. Null languages and texts are left out; with nothing to learn every text is ``und``.
    """
    rows = draws(docs.filter(train_on & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.approx_count_distinct("draw", 0.02)).alias("share"))
    # otherwise all texts would be shuffled by language; far fewer languages than this exist
    share = F.broadcast(share) if share.count() <= 10_000 else share
    unit = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(share, "lang").filter(unit < F.col("share")).dropDuplicates(["lang", "draw"]).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[str, list[str]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                texts.setdefault(lang, []).append(text)
        made = pickle.dumps(train({k: sorted(v) for k, v in texts.items()}))
        texts.clear()
        give_back()
        yield pd.DataFrame({"model": [made]})

    made = sample.repartition(1).mapInPandas(run, "model binary").first()  # no row where the sample is empty
    return pickle.loads(made[0]) if made else train({})


def classify(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected as fields of the column ``name``.

    lang_pred is a trained language, or ``und`` for texts that are null or have no letter
    (score 0, rejected). Whole texts are scored, ``SLICE`` characters at a time or one text if longer.
    Rows keep their columns and repeated rows are repeated; ``name`` must not be one of the columns.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name!r} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def language(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for part in texts:
            yield scorer.classify(part)

    return docs.withColumn(name, language(F.col("text")))


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose language is identified and not rejected."""
    name = fresh(docs, "language")
    return classify(docs, model, name).filter(~F.col(name)["rejected"]).drop(name)
