"""Benchmark decontamination by spaced-seed hashing.

A mask is laid over every window of tokens; the tokens at its kept positions are
hashed together and the others ignored, so substituted tokens spoil only the windows
that keep them. Hashes of documents are joined with those of the benchmark. Each hit
fixes an alignment of document and item, along which all tokens of the item are compared with
those around the hit. Everything is made of DataFrame functions.

Hits carry no text. Windows inside a run of one repeated token have equal hashes and are one seed with a reach, so that two
runs meet in one row, an interval of alignments. Alignments are made distinct first, and then the tokens of a document
come back once for each item that it met.

An alignment of an item of n tokens that counts as contained hits several seeds. Of the n - 4 windows of five tokens, W have three agreeing ones;
windows at an end hold a token less often, so 5 * 0.6 * n - 20 <= 2 * (n - 4) + 3 * W, or W >= (n - 12) / 3. Up to three windows share a seed, which leaves
(n - 12) / 9 seeds. A stretch of 16 with three disagreeing tokens has at most three windows without, so nine with, and three seeds. Alignments with fewer are not looked at.

The masks keep every choice of three among five tokens that starts with the first. An alignment on which
60 % of the tokens agree has three agreeing ones among some five in a row, as not every
five can have two, and so is hit at least once, wherever the substitutions are.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Masks: kept positions of up to five tokens in a row are 1.
MASKS = tuple("".join("1" if i in (0, *rest) else "0" for i in range(rest[-1] + 1)) for rest in combinations(range(1, 5), 2))
#: Least share of an item's tokens that must agree along the alignment, and least number.
LEAST_SHARE, LEAST_TOKENS = 0.6, 5
#: A stretch of an item leaks too: so many agreeing tokens among so many in a row.
STRETCH, STRETCH_AGREE = 16, 13
#: Items with fewer tokens carry no evidence.
LEAST_RUN = 3
#: Seeds that every alignment of a longer item hits, up to which they are counted.
MOST_SEEDS = 3
#: Bytes of the benchmark's hashes and tokens that are sent to all tasks; more are joined by shuffles.
BROADCAST_BYTES = 96 << 20
#: Documents with hits whose keys are sent to all tasks, so that no other document's tokens are shuffled.
BROADCAST_ROWS = 500_000
#: Parts of each hash in a join by shuffle: a hash of a third of all windows is met by so many tasks.
SALTS = 32


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits of the lower-cased text (null: none)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _masked(words: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """Array of the masked hashes of the windows at ``at`` (0-based), null where a mask reaches beyond the end.

    The mask's number is hashed too.
    """
    hashes = [(len(m), F.xxhash64(F.lit(k), *[F.get(words, at + i) for i, keep in enumerate(m) if keep == "1"])) for k, m in enumerate(masks)]
    return F.array(*[F.when(at + n <= F.size(words), x) for n, x in hashes])


def _seeds(rows: DataFrame, words: str, masks: tuple[str, ...], *columns: str) -> DataFrame:
    """columns, at, reach and hash of the masked windows of the array ``words``.

    A seed stands for the windows at ``at`` to ``at + reach``, which all have this hash. reach is 0 but in runs of a token that are longer than the
    longest mask, whose windows are one seed for each mask.
    """
    least, most = min(map(len, masks)), max(map(len, masks))
    last = F.size(words) - least
    token = lambda i: F.get(F.col(words), i)

    def inside(i: Column) -> Column:
        """Whether the windows of all masks at i and i - 1 lie in one run."""
        run = (i > 0) & (i + most <= F.size(words))
        for k in range(most):
            run &= token(i + k) == token(i - 1)
        return run

    at = F.when(last >= 0, F.sequence(F.lit(0), last))
    spots = rows.select(*columns, words, F.explode(at).alias("at")) if words not in columns else rows.select(*columns, F.explode(at).alias("at"))
    found = spots.filter(~inside(F.col("at"))).select(*columns, "at", F.lit(0).alias("reach"), F.explode(_masked(F.col(words), F.col("at"), masks)).alias("hash"))
    # the windows before the first and at the last of each run of inner ones
    before = F.filter(at, lambda i: inside(i + 1) & ~inside(i))
    ends = F.filter(at, lambda i: inside(i) & ~inside(i + 1))
    runs = rows.select(*columns, *([] if words in columns else [words]), F.explode(F.arrays_zip(before.alias("a"), ends.alias("b"))).alias("run"))
    at = F.col("run")["a"]
    runs = runs.select(*columns, at.alias("at"), (F.col("run")["b"] - at).alias("reach"), F.explode(_masked(F.col(words), at, masks)).alias("hash"))
    return found.union(runs).filter("hash IS NOT NULL")


def _agreeing(words: Column, item: Column, start: Column) -> Column:
    """The number of agreeing tokens of an alignment that counts as contained, null of another one."""
    total = lambda bits: F.aggregate(bits, F.lit(0), lambda a, x: a + x)
    n = F.size(item)

    def judged(same: Column) -> Column:
        agreeing = total(same)
        whole = (agreeing / n >= LEAST_SHARE) & ((agreeing >= LEAST_TOKENS) | (agreeing == n))
        stretches = F.transform(F.sequence(F.lit(1), n - STRETCH + 1), lambda k: total(F.slice(same, k, F.lit(STRETCH))))
        part = F.when((n >= STRETCH) & (agreeing >= STRETCH_AGREE), F.array_max(stretches) >= STRETCH_AGREE).otherwise(False)
        return F.when(whole | part, agreeing)

    same = F.transform(item, lambda w, k: F.coalesce(F.get(words, start + k) == w, F.lit(False)).cast("int"))
    return F.get(F.transform(F.array(same), judged), 0)


def least_seeds(n: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """The seeds that every contained alignment of an item of n tokens hits; 1 where other masks are used."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_SEEDS), F.ceil((n - 12) / F.lit(9.0)))).cast("int") if masks == MASKS else F.lit(1)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, item_id, agreeing, share: one row per document and benchmark item that it contains.

    agreeing is the number of tokens that agree on the best alignment (at most one per
    token of the item), share its part of the item. A document contains an item when
    share is ``LEAST_SHARE`` or more with ``LEAST_TOKENS`` agreeing (all of them in shorter items), or when ``STRETCH_AGREE``
    of ``STRETCH`` tokens in a row agree; every such alignment is found. Items of one or two tokens match
    nothing. Null texts have no tokens. Rows with a null doc_id are judged too, and a row is judged by its
    own text where others repeat its id; the result has one row per id and item, with the best of them. The same holds for
    items. Whole texts of any length are read; empty tables give an empty result, and other columns are not looked at.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).filter(F.size("item") >= LEAST_RUN)
    items = materialize(items.withColumn("item_no", F.monotonically_increasing_id()), "benchmark")
    size = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    few = size * (8 + 64 * len(masks)) <= BROADCAST_BYTES
    seeds = _seeds(items.withColumn("least", least_seeds(F.size("item"), masks)), "item", masks, "item_no", "least")
    seeds = seeds.select("item_no", "least", F.col("at").alias("item_at"), F.col("reach").alias("item_reach"), "hash")
    # a row is known by its id and two hashes of its text
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y")).alias("row"), "text")
    spots = _seeds(rows.select("row", tokens(F.col("text")).alias("words")), "words", masks, "row")
    if few:
        hits = spots.join(F.broadcast(seeds), "hash")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = spots.withColumn("salt", F.pmod(F.col("at"), F.lit(SALTS))).join(salted, ["hash", "salt"])
    # a seed with a reach stands for several
    number = F.when((F.col("reach") > 0) | (F.col("item_reach") > 0), MOST_SEEDS).otherwise(1)
    hits = hits.select("row", "item_no", "least", number.alias("number"), (F.col("at") - F.col("item_at") - F.col("item_reach")).alias("low"), (F.col("at") + F.col("reach") - F.col("item_at")).alias("high"))
    starts = hits.select("row", "item_no", "least", "number", F.explode(F.sequence("low", "high")).alias("start"))
    starts = starts.groupBy("row", "item_no", "least", "start").agg(F.sum("number").alias("number")).filter(F.col("number") >= F.col("least"))
    met = materialize(starts.groupBy("row", "item_no").agg(F.collect_list("start").alias("starts")), "alignments")
    keys = met.select(F.col("row").alias("met_row")).distinct()
    same_row = lambda a, b: F.col(a)["doc_id"].eqNullSafe(F.col(b)["doc_id"]) & (F.col(a)["x"] == F.col(b)["x"]) & (F.col(a)["y"] == F.col(b)["y"])
    texts = rows.join(F.broadcast(keys), same_row("row", "met_row"), "left_semi") if keys.count() <= BROADCAST_ROWS else rows
    texts = texts.select(F.col("row").alias("text_row"), tokens(F.col("text")).alias("words")).dropDuplicates(["text_row"])
    aligned = met.join(texts, same_row("row", "text_row")).join(F.broadcast(items) if few else items, "item_no")
    best = F.array_max(F.transform("starts", lambda start: _agreeing(F.col("words"), F.col("item"), start)))
    found = aligned.select(F.col("row.doc_id").alias("doc_id"), "item_id", F.size("item").alias("n"), best.alias("agreeing")).filter("agreeing IS NOT NULL")
    best = found.groupBy("doc_id", "item_id").agg(F.max("agreeing").cast("long").alias("agreeing"), F.max(F.col("agreeing") / F.col("n")).alias("share"))
    return best.select("doc_id", "item_id", "agreeing", "share")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_ids (sorted), share (largest): one row per contaminated document."""
    found = overlaps(docs, benchmark)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    gone = overlaps(docs, benchmark).select(F.col("doc_id").alias(name := fresh(docs, "leaked"))).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
