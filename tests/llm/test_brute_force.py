"""Models and searches that SQL has no form for, against plain versions of the same definitions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalweave.llm import decontam, language_id, simhash, token_output, toxicity
from signalweave.llm.common import materialize
from signalweave.llm.queries import tokenizer_file

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the old house near the river while the people are watching it"
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er weg von dem alten haus am fluss während die leute ihn beobachten"


# ---------------------------------------------------------------- language ID
class PlainKneserNey:
    """Interpolated Kneser-Ney over tuples of letters, by the textbook recursion; " " stands for what is not a letter."""

    def __init__(self, texts, alphabet):
        self.size, self.order, self.count = len(alphabet) + 2, language_id.ORDER, Counter()
        for t in texts:
            s = (" ",) * (self.order - 1) + self.symbols(t, alphabet)
            for i in range(self.order, len(s)):
                self.count[s[i - self.order + 1 : i + 1]] += 1
        self.levels = {self.order: self.count}
        for n in range(self.order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.follow = {n: defaultdict(list) for n in self.levels}
        for n, grams in self.levels.items():
            for g, c in grams.items():
                self.follow[n][g[:-1]].append(c)

    @staticmethod
    def symbols(text, alphabet):
        letters = "".join((c if c in alphabet else "\x01") if c.isalpha() else " " for c in text.lower())
        return tuple(" " + " ".join(letters.split()) + " ")

    def probability(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / self.size
        seen = self.follow[n].get(gram[:-1])
        below = self.probability(gram[1:])
        if not seen:
            return below
        return (max(self.levels[n][gram] - language_id.DISCOUNT, 0) + language_id.DISCOUNT * len(seen) * below) / sum(seen)


def test_language_scores_equal_plain_kneser_ney():
    texts = {"en": [EN, "The old River!", "a b"], "de": [DE, "Fluß über, dem Haus"]}
    scorer = language_id.Scorer(language_id.train(texts))
    alphabet = {c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()}
    for text in ("the fox übersieht 3 dogs", "Ω unknown — letters ß", EN, "q"):
        sums, lengths = scorer.sums([text])
        symbols = (" ",) * (language_id.ORDER - 1) + PlainKneserNey.symbols(text, alphabet)
        assert lengths[0] == len(symbols) - language_id.ORDER
        for j, lang in enumerate(scorer.langs):
            plain = PlainKneserNey(texts[lang], alphabet)
            expected = sum(np.log(plain.probability(symbols[i - language_id.ORDER + 1 : i + 1])) for i in range(language_id.ORDER, len(symbols)))
            assert np.isclose(sums[0, j], expected, rtol=1e-4), (text, lang)


def test_scripts_of_thousands_of_letters_are_told_apart():
    rng = np.random.default_rng(2)
    scripts = {"han": np.arange(0x4E00, 0x4E00 + 3000), "hangul": np.arange(0xAC00, 0xAC00 + 3000), "ext": np.arange(0x20000, 0x20000 + 3000)}
    weights = 1 / np.arange(1, 3001)
    made = lambda points, n: "".join(chr(p) for p in rng.choice(points, n, p=weights / weights.sum()))
    scorer = language_id.Scorer(language_id.train({k: [made(v, 300) for _ in range(40)] for k, v in scripts.items()}))
    for lang, points in scripts.items():
        found = scorer.classify([made(points, 60) for _ in range(30)])
        assert (found["lang_pred"] == lang).all() and found["rejected"].mean() < 0.1
    assert scorer.classify([EN])["rejected"].all()


def test_scoring_holds_a_slice():
    """Texts of 3 million characters are scored in slices, so what is held beside them is small: workers of an executor share its memory."""
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh "), 3000)) for _ in range(1000)]
    scorer = language_id.Scorer(language_id.train({"a": texts[:5], "b": ["xyz " * 100] * 5, "c": ["uvw " * 100] * 5, "d": ["rst " * 100] * 5}))
    tracemalloc.start()
    whole = scorer.classify(pd.Series(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.equals(pd.concat([scorer.classify(texts[:500]), scorer.classify(texts[500:])], ignore_index=True)) and peak < 32 << 20, peak


def test_language_column_is_not_overwritten(spark):
    d = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, Language string")
    with pytest.raises(ValueError, match="language"):
        language_id.classify(d, language_id.train({}), "language")
    assert language_id.keep_identified(d, language_id.train({"en": [EN]})).columns == d.columns


# ---------------------------------------------------------------- decontamination
def plain_tokens(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def plain_overlaps(docs, items):
    """Every alignment of every document and item."""
    best = {}
    for doc_id, text in docs:
        words = plain_tokens(text)
        for item_id, item_text in items:
            item = plain_tokens(item_text)
            n = len(item)
            if n < decontam.LEAST_RUN:
                continue
            for start in range(1 - n, len(words)):
                same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(item)]
                agreeing = sum(same)
                whole = agreeing >= decontam.LEAST_SHARE * n and (agreeing >= decontam.LEAST_TOKENS or agreeing == n)
                part = any(sum(same[k : k + decontam.STRETCH]) >= decontam.STRETCH_AGREE for k in range(n - decontam.STRETCH + 1))
                if whole or part:
                    old = best.get((doc_id, item_id), (0, 0.0))
                    best[doc_id, item_id] = (max(old[0], agreeing), max(old[1], agreeing / n))
    return best


@pytest.mark.parametrize("most", [96 << 20, 0])
def test_decontamination_finds_every_alignment(spark, most, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([3, 4, 5, 6, 7, 9, 12, 15, 15, 16, 20, 24, 31, 45, 60])]
    items += [(100, items[8][1]), (None, items[9][1]), (12, items[3][1]), (101, "x x x x x x"), (102, None), (103, "two words")]
    docs = []
    for share in (0.5, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0):
        for _, text in items[:15]:
            words = text.split()
            gone = rng.choice(len(words), len(words) - int(np.ceil(share * len(words))), replace=False)
            docs.append(" ".join([*rng.choice(vocabulary, 5), *[f"z{k}" if k in gone else w for k, w in enumerate(words)], *rng.choice(vocabulary, 5)]))
    for step, first in ((4, 0), (4, 3), (3, 1), (5, 2)):
        docs.append(" ".join("sub" if k % step == first else w for k, w in enumerate(items[13][1].split())))
    docs += [None, "", "x " * 300, items[11][1][: len(items[11][1]) // 2], items[14][1].upper()]
    ids = [*range(len(docs) - 6), None, None, 3, 3, 5, 5]
    rows = list(zip(ids, docs, strict=True)) + [(3, docs[3])]
    found = decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): (r["agreeing"], r["share"]) for r in found.collect()}
    expected = plain_overlaps(rows, items)
    assert found.keys() == expected.keys() and len(expected) > 90
    assert all(found[k][0] == v[0] and np.isclose(found[k][1], v[1]) for k, v in expected.items())


@pytest.mark.parametrize("most", [96 << 20, 0])
def test_decontamination_of_repeated_tokens(spark, most, monkeypatch):
    """Runs of one token and of two in turn, long ones too, have every alignment, and hits don't grow with the product of the runs."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(12)
    items = [(0, "a " * 200), (1, "a " * 20), (2, "ha ho " * 30), (3, "x 0 0 0 0 0 0 0 0 0 y 0 0 0 0 0 0 z"), (4, "a a a"), (5, "a a a a a a b"), (6, "b a a a a a a"), (7, "a " * 6), (8, "a " * 7 + "c " * 9)]
    docs = ["a " * 5000, "a " * 20000, "a " * 2000 + "b " + "a " * 150, "ha ho " * 1500, "0 " * 300 + "x " + "0 " * 9 + "y " + "0 " * 6 + "z " + "- 0 " * 40, "a " * 5, "a a", "c " * 40, "b " + "a " * 7 + "c " * 8]
    docs += [" ".join(np.repeat(rng.choice(["a", "b", "c", "0"], 60), rng.integers(1, 15, 60))) for _ in range(12)]
    rows = list(enumerate(docs))
    found = decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): (r["agreeing"], round(r["share"], 9)) for r in found.collect()}
    expected = plain_overlaps(rows, items)
    assert found == {k: (a, round(b, 9)) for k, (a, b) in expected.items()} and len(found) > 30


# ---------------------------------------------------------------- toxicity
def test_toxicity_equals_a_dense_pass():
    """A text's score is the sigmoid of the mean over its words of the mean over their buckets."""
    rng = np.random.default_rng(4)
    good, bad = EN.split(), "vile stupid hateful trash idiot scum".split()
    texts = [" ".join([*rng.choice(good, 12), *rng.choice(bad, 3 * (i % 2))]) for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    score = toxicity.Scorer(model)

    def buckets(word):
        import zlib

        w = b"<" + word.lower().encode().strip(toxicity.PUNCTUATION) + b">"
        keys = [zlib.crc32(w)]
        for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            for at in range(len(w) - n + 1):
                key = n
                for octet in w[at : at + n]:
                    key = (key << 8 | octet) & (1 << 64) - 1
                keys.append(key)
        return [((k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40) % toxicity.BUCKETS for k in keys]

    for text in [*texts[:5], "St*pid, hatefull scumbag!", "", None, "é", "idiot " * 5000]:
        words = (text or "").split()
        logit = model["bias"] + (np.mean([np.mean([model["scores"][b] for b in buckets(w)]) for w in words]) if words else 0)
        assert np.isclose(score(text), 1 / (1 + np.exp(-logit)), atol=1e-6)
    assert score("hatefull stupidd scumm") > 0.5 > score("the quick fox")


def test_toxicity_column_is_not_overwritten(spark):
    d = spark.createDataFrame([(1, "a", 1.0)], "doc_id long, text string, score double")
    with pytest.raises(ValueError, match="score"):
        toxicity.score(d, toxicity.train([], []), "score")


# ---------------------------------------------------------------- token ids
def test_token_ids_equal_the_plain_library(spark):
    """The library as it comes, without settings; special strings in a text are what it makes of them."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>  <|endoftext|>\n\ny", " <|endof text|>", "tab\there  two\r\n", "a b c", "it's 12,345 naïve 日本語 😀", None, "", EN * 20, "  lead", "trail  "]
    encode = token_output.PieceEncoder(tokenizer_file())
    for text in texts * 2:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, "null id"), (-1, "minus one"), (3, texts[3]), (3, "another")]
    written = token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_file())
    found = token_output.document_index(written).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    ids = {(i, t): [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    lengths = Counter((r["doc_id"], r["n_tokens"]) for r in found)
    assert lengths == Counter((i, len(ids[i, t])) for i, t in rows)
    at = sorted((r["start"], r["n_tokens"]) for r in found)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    stream = token_output.tokens_at(written, range(sum(len(ids[r]) for r in rows)))
    by_start = {r["start"]: r for r in found}
    for start, r in by_start.items():
        mine = [stream[p] for p in range(start, start + r["n_tokens"])]
        assert mine in [ids[i, t] for i, t in rows if i == r["doc_id"]]
    with pytest.raises(IndexError):
        token_output.tokens_at(written, [len(stream)])


def test_lookups_read_the_named_segments_alone(spark, capsys):
    """The scan is filtered by the numbers of the segments that hold the positions; others aren't decoded."""
    docs = spark.createDataFrame([(i, f"{EN} number {i}") for i in range(60)], "doc_id long, text string").repartition(4)
    written = materialize(token_output.segments(docs, tokenizer_file(), segment_ids=100), "dac", compression="none")
    places = token_output._with_base(written.drop("data"), written).orderBy("base", "first_id").collect()
    assert len(places) > 10
    position = places[7]["base"] + places[7]["first_id"] + 1
    found = token_output.segments_at(written, np.array([position]))
    assert [r["first"] for r in found.collect()] == [position - 1]
    found.explain("formatted")
    pushed = [line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line and "segment" in line]
    assert any(f"EqualTo(shard,{places[7]['shard']})" in line and f"EqualTo(segment,{places[7]['segment']})" in line for line in pushed), pushed
    index = token_output.document_index(written).orderBy("start").collect()
    encode = token_output.PieceEncoder(tokenizer_file())
    ids = [i for r in index for i in [*np.frombuffer(encode(f"{EN} number {r['doc_id']}"), "<u4").tolist(), 0]]
    assert token_output.tokens_at(written, [0, position, len(ids) - 1]) == {p: ids[p] for p in (0, position, len(ids) - 1)}
    assert token_output.tokens_at(written, []) == {}


# ---------------------------------------------------------------- SimHash links
def test_simhash_components_with_a_giant_and_a_hot_posting(spark):
    """2000 fingerprints: a long chain, a crowd under one posting, and noise, against all pairs."""
    rng = np.random.default_rng(9)
    chain = [int(rng.integers(0, 1 << 63))]
    while len(chain) < 700:
        step = 0
        for b in rng.choice(64, 4, replace=False):
            step |= 1 << int(b)
        chain.append(chain[-1] ^ step)
    crowd = [(0xABCDEF01 << 32) | int(x) for x in rng.integers(0, 1 << 20, 700)]
    noise = [int(x) for x in rng.integers(0, 1 << 63, 600)]
    fps = np.unique(np.array(chain + crowd + noise, np.uint64))
    parent = list(range(fps.size))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(fps.size):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    expected = {}
    for i in range(fps.size):
        expected.setdefault(root(i), set()).add(int(fps.view(np.int64)[i]))
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    groups = defaultdict(set)
    for r in simhash.components(simhash.links(d)).collect():
        groups[r["component"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)
    assert all(min(g) == c for c, g in groups.items())


def test_postings_that_go_over_many_batches(spark):
    """One posting, cut over Arrow batches, is linked as a whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.createDataFrame([(k,) for k in range(300)], "fp long")
        found = simhash.components(simhash.links(d))
        assert found.count() == 300 and found.select("component").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_word_rule_of_the_plain_versions():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\tb c") == ["a", "b c"]


# ---------------------------------------------------------------- similar shingle sets
@pytest.mark.parametrize("group", [512, 8])
def test_similar_sets_in_large_groups(spark, group, monkeypatch):
    """One crowd of near copies, pairs that only its outer members link, and a crowd that shares half its words but no copies."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(13)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(vocabulary, 120))

    def changed(words, n):
        words = list(words)
        for at in rng.choice(len(words), n, replace=False):
            words[at] = str(rng.choice(vocabulary))
        return words

    texts = [" ".join(changed(base, int(rng.integers(0, 3)))) for _ in range(120)]
    walk = base
    for _ in range(40):
        walk = changed(walk, 2)
        texts.append(" ".join(walk))
    half = list(rng.choice(vocabulary, 100))
    texts += [" ".join([*half, *rng.choice(vocabulary, 60)]) for _ in range(80)]
    texts += [" ".join(rng.choice(vocabulary, 50)) for _ in range(30)] + [None, "", "same", "same"]
    shingles = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        shingles.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            near = both and both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both)
            if near or (not shingles[i] and not shingles[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i} and 100 < len(kept) < 160


# ---------------------------------------------------------------- pipeline
def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty documents, repeated and null ids, and no tables left behind but those of the stages."""
    import os

    import corpus_pipeline
    from signalweave.llm.common import shared_dir

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    rng = np.random.default_rng(1)
    made = lambda words: " ".join(rng.choice(words.split(), 40))
    rows = [(i, made(EN if i % 2 else DE), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(3, rows[3][1], "en", "s", 1), (None, made(EN), None, None, None), (None, made(EN), None, None, None), (70, None, None, "s", 0), (71, "", None, "s", 0)]
    for name, docs in (("empty", []), ("odd", rows)):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
        found = corpus_pipeline.run(spark, folder).collect()
        left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
        assert len(left) == 1 and next(iter(left)).startswith("pipeline-")
        ids = Counter(r["doc_id"] for r in found)
        assert (not found) if name == "empty" else (ids[None] >= 2 and 70 not in ids and 71 not in ids and set(ids) <= {r[0] for r in rows})
        starts = sorted((r["start"], r["n_tokens"]) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
