"""Text operators against brute force, with the hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalweave.llm import chat_format, decontam, exact_dedup, language_id, lm_scoring, mixing, queries, simhash, token_output, toxicity, url_filter
from signalweave.llm.common import fold, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, content string, fp string, hash string, plan string, language string"
EN = "the quick brown fox jumps over the lazy dog and then it runs away from the old house near the river while the people are watching it"
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er weg von dem alten haus am fluss während die leute ihn beobachten"


def docs_of(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns whose names operators might use themselves."""
    rows = [((ids or range(len(texts)))[i], t, (langs or [None] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


HARD = [None, "", " \t\n", "a", "A b", "a b", "a  b", "ab", EN, EN + " ", EN.replace("fox", "cat"), "é" * 50, "x " * 30000, "\u00a0\u3000y", None, "ab"]


@pytest.fixture(scope="module")
def hard(spark):
    return docs_of(spark, HARD).cache()


# ---------------------------------------------------------------- language ID
def test_language_id(spark):
    rng = np.random.default_rng(1)
    texts, langs = [], []
    for _ in range(60):
        for lang, words in (("en", EN.split()), ("de", DE.split())):
            texts.append(" ".join(rng.choice(words, 30)))
            langs.append(lang)
    texts += [None, "", "12 34 !!", "q", "the " * 20000]
    langs += ["en", "de", None, None, None]
    d = docs_of(spark, texts, langs)
    model = language_id.fit(d, fold(F.col("doc_id"), 4) != 2)
    assert model["langs"] == ["de", "en"]
    found = {r["doc_id"]: r["language"] for r in language_id.classify(d.drop("language"), model, "language").collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i]["lang_pred"] == langs[i] for i in held)
    assert [found[i]["lang_pred"] for i in (120, 121, 122)] == ["und"] * 3 and all(found[i]["rejected"] for i in (120, 121, 122))
    assert found[124]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in found.values())
    kept = language_id.keep_identified(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} >= set(range(120))
    none = language_id.fit(d.limit(0), F.lit(True))
    assert {r[0]["lang_pred"] for r in language_id.classify(d, none, "z").select("z").collect()} == {"und"}
    assert language_id.classify(d.limit(0), model, "z").count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    model = language_id.train({"en": [EN, EN[::-1]], "de": [DE]})
    scorer = language_id.Scorer(model)
    size = model["letters"].size + 2
    for context in ([0, 5, 3, 2], [7, 7, 7, 7], [0, 0, 0, 0]):
        total = 0.0
        for symbol in range(size):
            total = total + np.exp(scorer._scores(np.array([*context, symbol], np.uint8))[-1].astype(float))
        assert np.allclose(total, 1, atol=1e-4)


def test_language_scores_do_not_depend_on_neighbours():
    scorer = language_id.Scorer(language_id.train({"en": [EN], "de": [DE]}))
    alone = [scorer.sums([t])[0][0] for t in (EN, DE, "fox")]
    together = scorer.sums([EN, DE, "fox"])[0]
    assert np.allclose(alone, together, rtol=1e-5)


def test_samples_with_null_and_repeated_ids(spark):
    """Ids that are all null or all the same neither empty the samples nor let them grow."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(EN.split(), 12)) for _ in range(3000)] + [EN] * 3000
    for i in (None, 7):
        d = spark.createDataFrame([(i, t, "en") for t in texts], "doc_id long, text string, lang string")
        model = language_id.fit(d, F.lit(True), 200)
        assert model["langs"] == ["en"]
        assert language_id.classify(d.limit(50), model, "l").filter("l.lang_pred = 'en'").count() == 50
        drawn = language_id.draws(d).filter(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < 200 / 3001).dropDuplicates(["lang", "draw"]).count()
        assert 140 < drawn < 260
        labels = spark.createDataFrame([(i, 1)], "doc_id long, toxic int")
        assert toxicity.fit(d, labels, F.lit(True), 50)["bias"] is not None


# ---------------------------------------------------------------- exact dedup
def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bucket,local,fan", [(1 << 20, 1 << 20, 16), (64, 32, 2), (64, 1, 3)])
def test_exact_dedup(spark, hard, bucket, local, fan, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 100_000 if fan > 2 else 0)
    found = exact_dedup.exact_duplicates(hard.repartition(3), bucket, local, fan)
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == brute_dedup(list(enumerate(HARD)))


def test_exact_dedup_repeats_and_empty(spark):
    d = docs_of(spark, ["a", "a", "a", "b"], ids=[5, 5, None, None])
    rows = exact_dedup.exact_duplicates(d).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 2
    assert {r["keep_id"] for r in rows if r["group_size"] == 3} == {5}
    assert exact_dedup.exact_duplicates(d.limit(0)).count() == 0


def test_exact_dedup_of_a_content_in_every_task(spark):
    texts = ["same text" if i % 3 else f"text {i // 9}" for i in range(300)]
    d = docs_of(spark, texts).repartition(29)
    found = exact_dedup.exact_duplicates(d, fan=2)
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == brute_dedup(list(enumerate(texts)))


def test_content_table_compares_contents():
    table = exact_dedup.ContentTable(4)
    same = b"\0" * 32
    numbers = [table.put(str(i).encode(), same) for i in range(50)]
    assert numbers == [(i, True) for i in range(50)] and table.put(b"7", same) == (7, False)


# ---------------------------------------------------------------- chat
def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>", "\\l<\\b[\\k", None, "", "x" * 100000]
    rows = [(1, t, ["user", "assistant", None][t % 3], s) for t, s in enumerate(said)] + [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, "us<er", "q")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("written", F.lit(1))
    found = {r["conv_id"]: r for r in chat_format.digests(d).collect()}
    for conv in (1, 2, 3):
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert found[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (found[conv]["loss_sha256"], found[conv]["loss_chars"], found[conv]["n_turns"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss), len(mine))
    assert chat_format.digests(d.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} <|end|> é" * (t % 5)) for t in range(3000)] + [(None, 1, "assistant", "n"), (None, None, "user", "m")]
    found = {r["conv_id"]: r for r in chat_format.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    loss = "".join(r[3] for r in rows[:3000] if r[2] == "assistant")
    assert found[1]["n_turns"] == 3000 and found[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert found[None]["turns_sha256"] == hashlib.sha256(b"user\nm\nassistant\nn\n").hexdigest()


def test_chat_parts(spark):
    parts = [(1, 0, "user", [("text", "see <|image:1|>", None, None), ("image", None, "a.png", 2)]), (1, 1, "assistant", [("audio", None, "b.wav", None), (None, "t", None, None)]), (1, 2, "user", None)]
    row = chat_format.format_messages(spark.createDataFrame(parts, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).first()
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "image", "a.png", 1152), (2, "audio", "b.wav", 50)]
    assert row["expanded_tokens"] == 1202 and row["formatted"].count("<|image:1|>") == 1
    span = row["loss_spans"][0]
    assert row["formatted"][span["start"] : span["end"]] == "<|audio:2|>t"


# ---------------------------------------------------------------- token ids
@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.sampled_from([3, 8, 16]))
def test_segments_round_trip(ids, bits):
    ids = np.array(ids, np.uint32)
    s = token_output.Segment(token_output.encode_segment(np.array([7]), np.array([ids.size]), ids, bits))
    assert np.array_equal(s.ids(), ids) and all(s[i] == ids[i] for i in range(0, ids.size, 97))


PIECES = [" ", "  ", "\n", "\t", "\r\n", "\r", "a", "The", "don't", "'s", "é", "12", "!", "?!", "\u00a0", "\x0b", "\x1f", "\u2003", "<|endoftext|>", "日本", "\U0001f600"]


def plain_ids(text):
    """The library as it comes, without settings."""
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "tokenizer"):
        plain_ids.tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    return plain_ids.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=15).map("".join) | st.text(max_size=30))
def test_pieces_equal_whole_texts(text):
    encoder = token_output.PieceEncoder.of_worker(queries.tokenizer_file())
    assert np.frombuffer(encoder(text), "<u4").tolist() == plain_ids(text)


def test_worker_keeps_nothing_of_the_operator_before(spark):
    """The pipeline's stages get the same Python workers; the encoder must not stay in them while near copies are searched."""
    import weakref

    import pyarrow as pa

    class Rows:
        """Stands for a DataFrame, to have what its workers run."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    kept = weakref.ref(token_output.PieceEncoder.of_worker(queries.tokenizer_file()))
    assert token_output.PieceEncoder.of_worker(queries.tokenizer_file()) is kept()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([EN, None])], names=["doc_id", "text"])
    (made,) = simhash._signatures(Rows(), 5)(iter([batch]))
    assert kept() is None
    assert made.column(1).to_pylist() == [simhash.fingerprint(x, 5) - (1 << 64 if simhash.fingerprint(x, 5) >> 63 else 0) for x in (EN, None)]
    assert token_output.PieceEncoder.of_worker(queries.tokenizer_file())("a b") == np.array(plain_ids("a b"), "<u4").tobytes()


def test_forgotten_pieces_are_encoded_again():
    import pyarrow as pa

    encoder = token_output.PieceEncoder(queries.tokenizer_file(), memo=50)
    rng = np.random.default_rng(5)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice(list("abc "), 6)) for _ in range(20)) for _ in range(5)] + ["", EN, "a\n\n\nb"]
        ids, sizes = encoder.encode(pa.array(texts), [0])
        expected = [[*plain_ids(t), 0] for t in texts]
        assert sizes.tolist() == list(map(len, expected)) and ids.tolist() == sum(expected, [])


def test_special_strings_as_text():
    encoder = token_output.PieceEncoder(queries.tokenizer_file(), special_as_text=True)
    assert 50256 not in np.frombuffer(encoder("a <|endoftext|> b"), "<u4").tolist()


def test_token_output(spark, hard):
    rows = token_output.document_index(token_output.write(hard.repartition(3), queries.tokenizer_file())).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(rows, HARD, strict=True):
        ids = np.array([*plain_ids(text or ""), 0], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert token_output.document_index(token_output.write(hard.limit(0), queries.tokenizer_file())).count() == 0


# ---------------------------------------------------------------- SimHash
def brute_fingerprint(text, shingle=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most and label[i] != label[j]:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    return label


def test_simhash(spark, hard):
    fps = [brute_fingerprint(t) for t in HARD]
    rows = simhash.near_duplicates(hard).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in rows] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in rows] == brute_components(fps)
    kept = simhash.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    assert simhash.near_duplicates(hard.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_links_connect_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    for base in fps[:5]:
        for _ in range(40):
            fps.append(base ^ sum(1 << int(b) for b in set(rng.integers(0, 14, 5))))
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    of = {r["node"] & (1 << 64) - 1: r["component"] for r in found}
    label = brute_components(fps)
    by = defaultdict(set)
    for f, k in zip(fps, label, strict=True):
        by[k].add(f)
    for members in by.values():
        assert len({of.get(f, ("alone", f)) for f in members}) == 1
    assert len({of.get(f, ("alone", f)) for f in fps}) == len(by)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    of = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert all(of[i] == 0 for i in range(61)) and of[101] == 100


def test_drop_near_duplicates_finds_similar_sets(spark):
    """Against brute-force Jaccard similarity: no two rows left are similar, and no row is dropped without a cause."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
                copy[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(copy))
    texts += [None, "", "a b", "a b"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in [(t or "").split() for t in texts]]
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    label = brute_components([brute_fingerprint(t, 5) for t in texts])
    missed = 0
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]) and label[i] != label[j]:
                missed += 1
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()}
    assert missed > 20 and kept == {i for i in range(len(texts)) if label[i] == i}


# ---------------------------------------------------------------- LM scoring
def test_lm_scoring(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BROADCAST_WORDS", 5)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(EN.split(), 25)) for _ in range(40)] + [None, "", "Zz unseen \u00e9", "the " * 30000]
    d = docs_of(spark, texts)
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    rows = {r["doc_id"]: r for r in lm_scoring.scores(d, fold(F.col("doc_id"), 7) != 2).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if train(i):
            c.update(lm_scoring.words_of(t) + [b""])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = lm_scoring.words_of(t) + [b""]
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert np.isclose(r["base_score"], sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r["score"] < 0
    held = [i for i in range(40) if not train(i)]
    assert sum(rows[i]["score"] for i in held) > sum(lm_scoring.symbols_of(lm_scoring.words_of(texts[i])).size * np.log10(1 / 256) for i in held) / 4
    empty = lm_scoring.scores(d, F.lit(False)).filter("doc_id = 41").first()
    assert np.isclose(empty["score"], np.log10(1 / 256)) and empty["n_known"] == 0
    assert lm_scoring.scores(d.limit(0), F.lit(True)).count() == 0


def test_suffix_tree_equals_brute_force(spark):
    seqs = [lm_scoring.symbols_of(lm_scoring.words_of(t)) for t in (EN, EN[40:], DE)]
    keys, n = lm_scoring.grams(seqs)
    model = lm_scoring.fit(spark.createDataFrame(list(zip(keys.tolist(), n.tolist(), strict=True)), "key long, n long"))
    contexts = defaultdict(Counter)
    for s in seqs:
        for p in range(len(s)):
            for k in range(min(p, lm_scoring.DEPTH) + 1):
                contexts[bytes(s[p - k : p])][int(s[p])] += 1
    total = sum(contexts[b""].values())
    kept = {b""}
    for ctx, follow in contexts.items():
        if ctx:
            shorter, m, u = contexts[ctx[1:]], sum(follow.values()), sum(contexts[ctx[1:]].values())
            if sum(k * np.log(k / m / (shorter[x] / u)) for x, k in follow.items()) >= max(lm_scoring.LEAST_NATS, lm_scoring.GAIN * total):
                kept |= {ctx[k:] for k in range(len(ctx) + 1)}

    def prob(ctx, x):
        below = prob(ctx[1:], x) if ctx else 1 / 256
        weight = lm_scoring.SMOOTHING * max(1, len(contexts[ctx]))
        return (contexts[ctx][x] + weight * below) / (sum(contexts[ctx].values()) + weight)

    text = lm_scoring.symbols_of(lm_scoring.words_of("the old dog und ein haus"))
    score = 0.0
    for p in range(len(text)):
        ctx = b""
        while len(ctx) < min(p, lm_scoring.DEPTH) and bytes(text[p - len(ctx) - 1 : p]) in kept:
            ctx = bytes(text[p - len(ctx) - 1 : p])
        score += np.log10(prob(ctx, int(text[p])))
    assert len(kept) > 3 and np.isclose(lm_scoring.Scorer(model)([text])[0], score, atol=1e-4)
    assert all(np.isclose(sum(prob(ctx, x) for x in range(256)), 1) for ctx in list(kept)[:20])


@pytest.mark.parametrize("shards", [1, 128])
def test_lm_shards_equal_one_tree(spark, monkeypatch, shards):
    """Chunks and any number of shards give the scores of a single tree; a byte's evidence does not count for less in a larger corpus."""
    monkeypatch.setattr(lm_scoring, "SHARDS", shards)
    monkeypatch.setattr(lm_scoring, "CHUNK", 600)
    monkeypatch.setattr(lm_scoring, "SLICE", 200)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice((EN + " " + DE).split(), 30)) for _ in range(60)] + [None, "", "é unseen"]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    seqs = [lm_scoring.symbols_of(lm_scoring.words_of(t)) for t in texts]
    keys, n = lm_scoring.grams([s for s, t in zip(seqs, train, strict=True) if t])
    expected = lm_scoring.Scorer((keys, n, lm_scoring.LEAST_NATS))(seqs)
    rows = {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs_of(spark, texts).repartition(3), fold(F.col("doc_id"), 7) != 2).collect()}
    assert np.allclose([rows[i] for i in range(len(texts))], expected, atol=1e-3)
    # 26 other bytes, 200 million times each: the evidence that a context needs is as before
    other = 32 + 64 + np.arange(26, dtype=np.uint64)
    many = np.uint64(1 << 8) | other
    model = lm_scoring.fit(spark.createDataFrame([(int(k), int(c)) for k, c in zip(np.append(keys, many), np.append(n, np.full(26, 200_000_000)), strict=True)], "key long, n long"))
    assert model[2] == lm_scoring.LEAST_NATS


def test_lm_contexts_of_six_bytes():
    """What follows "abcdef" and "xbcdef" differs in the sixth byte before it only."""
    seqs = [np.frombuffer(s * 40, np.uint8) for s in (b"abcdef1 ", b"xbcdef2 ")]
    model = (*lm_scoring.grams(seqs), lm_scoring.LEAST_NATS)
    good, bad = lm_scoring.Scorer(model)([np.frombuffer(s, np.uint8) for s in (b"abcdef1", b"abcdef2")])
    assert good > bad + 0.5


# ---------------------------------------------------------------- decontamination
def test_decontamination(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(vocabulary, 30)) for _ in range(5)] + ["Short, exact Run!", "two words", None, ""]
    filler = lambda n: " ".join(rng.choice(vocabulary, n))
    swapped = items[1].split()
    for k in (4, 13, 22):
        swapped[k] = "other"
    texts = [f"{filler(50)} {items[0].upper()}! {filler(20)}", f"{filler(9)} {' '.join(swapped)}", filler(300), None, "", f"a SHORT exact run b {filler(40)}", "two words", " ".join([items[2]] * 200), " ".join(items[3].split()[5:24]) + " tail"]
    d = docs_of(spark, texts)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(d, b).collect()}
    assert set(found) == {(0, 0), (1, 1), (5, 5), (7, 2), (8, 3)}
    assert found[0, 0]["share"] == 1 and np.isclose(found[1, 1]["share"], 0.9) and found[7, 2]["agreeing"] == 30
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 6}
    assert decontam.overlaps(d, b.limit(0)).count() == 0 and decontam.overlaps(d.limit(0), b).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    d = docs_of(spark, [f"x y {EN} z", "clean text of no interest"])
    b = spark.createDataFrame([(1, EN)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["share"]) for r in decontam.overlaps(d, b).collect()] == [(0, 1, 1.0)]


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_decontamination_of_null_and_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    d = docs_of(spark, [f"x y {EN} z", f"x y {EN} z", "clean text", f"a b {DE}", "x y " + " ".join(["other"] * 30)], ids=[None, 7, 7, 7, None])
    b = spark.createDataFrame([(1, EN), (2, DE)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["share"]) for r in decontam.overlaps(d, b).collect()}
    assert found == {(None, 1, 1.0), (7, 1, 1.0), (7, 2, 1.0)}


# ---------------------------------------------------------------- URLs
def brute_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.split(r"[/?#]", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.split(r"[?#]", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("ranges", [4, 23, 1])
def test_url_filter(spark, ranges, monkeypatch):
    monkeypatch.setattr(url_filter, "partitions", lambda df: ranges)
    rules = url_filter.RULES + [("net", "/es/a/", "allow"), ("net", "/es/a/b", "block"), ("x.y", "", "block"), ("com", "/", "allow"), ("com", "/", "block"), ("a,b", "/", "block"), ("com", "/e\U0010ffff", "block")]
    rng = np.random.default_rng(8)
    hosts = ["com", "example.com", "www.example.com", "a.www.EXAMPLE.com", "badexample.com", "net", "q.net", "x.y", "z.x.y", "y", "", "a..com", "com:80", "com,example", "example,com", "a,b", "c.a,b", "com."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/es/a/", "/es/a/bc", "/fr/1?x#y", "#/en/", "?/en/", "/é", "/es/\U0010ffff", "/e\U0010ffff\U0010ffff", "/e\U0010fffe"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://com/en/", "http://com/" + "x" * 50000]
    urls += list(rng.choice(urls[:100], 30))
    pages = spark.createDataFrame([(i, None if u is None else str(u), "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, salt int")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, url_filter.rules_table(spark, rules)).collect()}
    assert found == {i: brute_url(None if u is None else str(u), rules) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    none = url_filter.judge(pages, url_filter.rules_table(spark).limit(0))
    assert none.filter("verdict <> 'allow' OR rule IS NOT NULL").isEmpty() and none.count() == len(urls)


def test_url_filter_keeps_whole_pages(spark):
    rows = [(1, "http://net/es/", "a"), (None, "http://net/es/", "b"), (None, "http://com/", "c"), (2, "http://com/", "d"), (3, None, "e"), (2, "http://com/", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked string")
    kept = url_filter.keep_allowed(pages, url_filter.rules_table(spark))
    assert kept.columns == pages.columns and sorted(r["blocked"] for r in kept.collect()) == ["d", "d", "e"]


def test_url_filter_with_many_rules(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 3)))
    name = lambda: ".".join(word() for _ in range(rng.integers(1, 4)))
    place = lambda: "/" + "/".join(word() for _ in range(rng.integers(0, 5)))
    rules = [(name(), place(), str(rng.choice(["allow", "block"]))) for _ in range(60_000)]
    urls = [f"http://{name()}{place()}" for _ in range(3000)] + ["http://a.a/a"] * 1000
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = {}
    for h, p, v in rules:
        known[h, p] = max(v, known.get((h, p), ""))

    def brute(url):
        host, path = re.match("http://([^/]*)(.*)", url).groups()
        labels = host.split(".")
        suffixes = [".".join(labels[i:]) for i in range(len(labels))]
        fits = [(len(h) + k, len(h), known[h, path[:k]], h + path[:k]) for h in suffixes for k in range(len(path) + 1) if (h, path[:k]) in known]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert found == {i: brute(u) for i, u in enumerate(urls)}


# ---------------------------------------------------------------- mixing
@pytest.mark.parametrize("bits", [12, 2])
def test_mixing(spark, bits, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", bits)
    rng = np.random.default_rng(9)
    sizes = [int(x) for x in rng.integers(1, 30, 400)]
    texts = ["w " * n for n in sizes] + [None, "", " "]
    sources = [["b", "a", None, "é", "Z"][int(x)] for x in rng.choice(5, 400, p=[0.4, 0.3, 0.1, 0.1, 0.1])] + [None, "a", "empty"]
    d = docs_of(spark, texts, sources=sources)
    rows = mixing.mix(d).collect()
    assert len(rows) == 403 and mixing.mix(d).exceptAll(mixing.mix(d.repartition(5))).isEmpty()
    total, taken, target = Counter(), Counter(), {}
    of = dict(zip(range(403), sources, strict=True))
    for r in rows:
        total[of[r["doc_id"]]] += r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, left, want = set(order), 1.5 * sum(total.values()), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        for s in over:
            want[s] = 2.0 * total[s]
            free.discard(s)
        left = 1.5 * sum(total.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in order:
        assert np.isclose(target[s], want[s]) and abs(taken[s] - want[s]) <= 15
    copies = Counter(r["doc_id"] for r in mixing.apply_mix(d).select("doc_id").collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows) and mixing.apply_mix(d).columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity
def test_toxicity(spark):
    rng = np.random.default_rng(10)
    bad = ["idiot", "moron", "clown", "trash"]
    texts, marks = [], []
    for i in range(300):
        words = list(rng.choice(EN.split(), 30))
        if i % 3 == 0:
            words[3], words[9] = rng.choice(bad, 2)
        texts.append(" ".join(words))
        marks.append(int(i % 3 == 0))
    texts += [None, "", "what an idiott and moronn", "the " * 30000]
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(0, 0, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels, fold(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r["z"] for r in toxicity.score(d, model, "z").collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    pos, neg = [got[i] for i in held if marks[i]], [got[i] for i in held if not marks[i]]
    assert np.mean(np.array(pos)[:, None] > np.array(neg)) > 0.97 and all(0 <= v <= 1 for v in got.values())
    assert got[302] > got[303] and got[300] == got[301]
    flat = toxicity.fit(d, labels.limit(0), F.lit(True))
    assert len({r[0] for r in toxicity.score(d, flat, "z").select("z").collect()}) == 1
    assert toxicity.score(d.limit(0), model, "z").count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    item = " ".join(rng.choice(EN.split(), 20))
    texts = [" ".join(rng.choice(EN.split(), 60)) for _ in range(60)]
    texts += [texts[0], texts[1] + ".", f"{texts[2][:100]} {item} {texts[3][:100]}", None, "123", ""]
    d = docs_of(spark, texts, ["en"] * 66, [f"s{i % 3}" for i in range(66)]).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(now)
    ids = [Counter(r["doc_id"] for r in x.select("doc_id").collect()) for x in kept]
    assert set(ids[0]) == set(range(63))
    fps = {i: brute_fingerprint(texts[i], 5) for i in range(63)}
    comp = brute_components([fps[i] for i in range(63)])
    assert set(ids[1]) == {i for i in range(63) if comp[i] == i} and 60 not in ids[1]
    assert set(ids[2]) == set(ids[1]) - {62}
    assert all(x.columns == d.columns for x in kept[:4])
    assert ids[4] == ids[3] and max(ids[3].values()) <= 2
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.exceptAll(kept[4]).isEmpty() and whole.count() == kept[4].count()


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
