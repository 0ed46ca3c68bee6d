"""Line deduplication, importance resampling and the Merkle manifest against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import line_dedup, merkle, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line_row string, lines_gone string, rank string, number string, a string, place string, row string, drawn string"


def docs_of(spark, rows, parts=3):
    """Documents (doc_id, text, source) with extra columns whose names operators might use themselves."""
    full = [(i, t, None if k % 7 == 3 else "en", s, None if t is None else len(t), *["x"] * 8) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


# ---------------------------------------------------------------- line dedup
def plain_lines(rows, least_chars=20, least_docs=3):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc_id)
    keep = {k: max(d, key=lambda x: (x is not None, x)) for k, d in holders.items() if len(d) >= least_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


A, B, C = "This line is a footer of all", "All rights reserved by noone", "nineteen code point"
LINES = [
    (1, f"{A}\nown one\n{B}\n{A}", "s"), (2, f"  {A.upper()}\t\n\n{C}", "s"), (3, f"{A}", "s"), (4, f"{B}\r\n{B}\n{A}\n{A}\n", "s"), (5, f"x\n{B}", "s"), (6, f"{C}\n{C}é\n{B[:-1]}", "s"),
    (7, None, None), (8, "", "s"), (9, "\n", "s"), (10, "\n\n", "s"), (11, "É" * 19 + "\n" + "É" * 20, "s"), (12, "É" * 20, "s"), (13, "é" * 20 + "\n" + "É" * 20 + "\x0b", "s"),
    (14, "same line in only two docs\nsame line in only two docs\nsame line in only two docs", "s"), (15, "same line in only two docs", "s"),
    (16, " " + A, "s"), (17, f"{C}é", "s"), (18, f"{C}é　", "s"), (3, f"{A}\nrepeats an id", "s"), (3, f"{A}", "s"), (None, f"{A}\nno id\n{B}", "s"), (None, f"{B}", "s"), (None, None, "s"),
    (20, "\n".join(f"line number {i % 900:04d} of a long text" for i in range(20000)), "s"), (21, "\n".join(f"line number {i:04d} of a long text" for i in range(0, 900, 3)), "s"),
    (22, "\n".join(f"line number {i:04d} of a long text" for i in range(0, 900, 2)), "s"),
]


@pytest.mark.parametrize("most", [200_000, 3])
def test_lines_equal_plain_version(spark, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
    d = docs_of(spark, LINES)
    found = line_dedup.dedup_lines(d, counts=("n_lines", "n_dropped"))
    assert found.columns == [*d.columns, "n_lines", "n_dropped"]
    rows = found.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    assert Counter(map(tuple, rows)) == plain_lines(LINES)
    assert found.filter("text IS NULL").count() == 2  # a null text stays null
    assert {r.n_dropped for r in found.filter("doc_id = 4").collect()} == {2}  # the second footer goes from 4, which has the largest id of the first


@pytest.mark.parametrize("most", [200_000, 5])
def test_lines_of_a_hot_kind(spark, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        lines = [A] if i % 3 == 0 else []
        lines += [f"common sentence number {k}" + " " * int(rng.integers(3)) for k in rng.integers(0, 60, 4)] + [f"unique to this one {i}"]
        rows.append((i, "\n".join(lines), "s"))
    found = line_dedup.dedup_lines(docs_of(spark, rows), 10, 5, ("n", "gone")).select("doc_id", "n", "gone", "text").collect()
    assert Counter(map(tuple, found)) == plain_lines(rows, 10, 5)


def test_lines_of_empty_tables(spark):
    d = docs_of(spark, LINES)
    assert line_dedup.dedup_lines(d.limit(0)).collect() == []
    text_ids = spark.createDataFrame([(str(i), f"{A}\n{i}") for i in range(3)], "doc_id string, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(text_ids).collect()) == ["0", "1", f"{A}\n2"]


# ---------------------------------------------------------------- importance resampling
def plain_features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain_resample(rows, target, percent=5, least=20):
    features = [(r[0], *plain_features(r[1])) for r in rows]
    s, t = Counter(b for f in features for b in f[2]), Counter(b for x in target for b in plain_features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000))))
    out = []
    for doc_id, words, buckets in features:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def texts_to_weigh():
    rng = np.random.default_rng(5)
    words = [*"the of And to in x1 déjà vu 中文 naïve Z".split(), *(f"w{i}" for i in range(200))]
    rows = [(i, "".join(w + str(rng.choice([" ", "-", "\n", ". ", "__", "\x7f"])) for w in rng.choice(words, rng.integers(0, 60))), "s") for i in range(300)]
    return rows + [(400 + i, rows[7][1], "s") for i in range(40)] + [
        (500, None, None), (501, "", "s"), (502, " ... !", "s"), (503, "one", "s"), (504, "One two", "s"), (505, "a " * 30000, "s"), (506, "a a a b a a a b a a a b " * 9, "s"), (507, " ".join(f"long{i}" for i in range(20000)), "s"),
        (None, "no id " * 20, "s"), (None, None, "s"), (7, rows[7][1], "s"), (7, "other text of the id " * 9, "s"),
    ]


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_resampling_equals_plain_version(spark, size, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", size)
    rows, target = texts_to_weigh(), ["the of x1 w5 w6", "W5 w6 w7 w5 w6 w7", None, "", "déjà vu 中文"]
    d, b = docs_of(spark, rows), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    found = resampling.resample(d, b).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, found)) == plain_resample(rows, target)
    drawn = resampling.draw(d, b)
    assert drawn.columns == d.columns and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in found if r.rank}


def test_suffix_array_of_wide_vocabularies(monkeypatch):
    """Words too many for one 64-bit key are sorted by columns, with the same buckets."""
    rng = np.random.default_rng(1)
    ids = np.append(rng.integers(1, 40, 500), 0)
    narrow = resampling.Grams._scatter(ids, [b"", *(b"w%d" % i for i in range(1, 40))], 1000)
    wide = resampling.Grams._scatter(ids, [b"", *(b"w%d" % i for i in range(1, 40)), *[b"-"] * (1 << 21)], 1000)
    for n, (x, y) in enumerate(zip(narrow, wide, strict=True), 1):
        expected = [zlib.crc32(b" ".join(b"w%d" % i for i in ids[k : k + n])) % 1000 if k + n <= 500 else -1 for k in range(501)]
        assert x.tolist() == y.tolist() == expected


def test_resampling_of_empty_tables(spark):
    d, b = docs_of(spark, texts_to_weigh()[:50]), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(d.limit(0), b).collect() == []
    found = resampling.resample(d, b, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 51))
    assert resampling.fit(d.limit(0), b).tolist() == [0] * 10000


# ---------------------------------------------------------------- Merkle manifest
def plain_leaf(row):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


def plain_proofs(leaves):
    """The root and, for each leaf, the steps to it."""
    level, paths, where = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at - at % 3 : at - at % 3 + 3]
            paths[i].append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
            where[i] = at // 3
        level = [hashlib.sha256("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append(row)
    trees = {}
    for source, mine in by_source.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[source] = (mine, *plain_proofs([plain_leaf(r) for r in mine]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = plain_proofs([trees[s][1] for s in order])
    out = []
    for k, s in enumerate(order):
        mine, subroot, paths = trees[s]
        for row, path in zip(mine, paths, strict=True):
            path = path + above[k]
            h = leaf = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                h = plain_leaf((*row[:4], row[4] and row[4].replace("\n", "")))
            for place, others in path:
                h = hashlib.sha256("".join(others[:place] + [h] + others[place:]).encode()).hexdigest()
            proof = hashlib.sha256("".join(x for _, others in path for x in others).encode()).hexdigest()
            out.append((row[0], leaf, subroot, root, proof, h, h == root))
    return Counter(out)


def rows_to_prove():
    rng = np.random.default_rng(9)
    sources = ["hot"] * 90 + ["b", "é", "z", "", "a", "B"] * 5 + [None] * 4 + ["lone"]
    rows = [(int(i), str(rng.choice(["a\nb", "x", "", "\n", "tout à fait\n"])) + str(i), s) for i, s in zip(rng.permutation(len(sources)) + 95, sources, strict=True)]
    return rows + [(1, None, "hot"), (2, "", None), (None, "no\nid", "hot"), (None, None, "hot"), (100, "again\n", "hot"), (rows[0][0], rows[0][1], "hot"), (7, "y\n" * 50000, "b")]


@pytest.mark.parametrize("span", [1, 2, 7])
def test_manifest_equals_plain_version(spark, span):
    d = docs_of(spark, rows_to_prove())
    rows = [tuple(r) for r in d.select(*merkle.COVERED).collect()]
    found = merkle.digests(d, span)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == plain_manifest(rows)
    roots = {(r.source, r.subroot, r.root) for r in merkle.manifest(d, span).collect()}
    assert len(roots) == 9 and len({r[2] for r in roots}) == 1


def test_manifests_of_small_tables(spark):
    d = docs_of(spark, rows_to_prove())
    assert merkle.digests(d.limit(0)).collect() == []
    for n in (1, 2, 3, 4):
        few = docs_of(spark, [(i, "t\n", "s") for i in range(n)])
        rows = [tuple(r) for r in few.select(*merkle.COVERED).collect()]
        assert Counter(map(tuple, merkle.digests(few).collect())) == plain_manifest(rows)


def test_any_change_is_found(spark):
    d = docs_of(spark, rows_to_prove()).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for column in ("source", "lang", "n_chars", "text", "doc_id"):
        changed = merkle.leaf_of({c: F.col(c) for c in merkle.COVERED} | {column: F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("0"))})
        assert not merkle.verify(merkle.proofs(d, changed)).filter("verified").count()
    assert not merkle.verify(merkle.proofs(d)).filter("NOT verified").count()
