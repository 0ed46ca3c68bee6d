"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words. Whole passes over the source come first;
of the rest, the documents below a hash threshold are taken once more. The threshold
is found from sums: words are summed by source and hash bucket, a running sum over
the buckets finds the one in which the budget is reached, and only that bucket is
summed again by the next bits of the hash. No document is sorted or collected.
Everything is made of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

#: Bits of the hash, and bits that each histogram adds.
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources up to which the thresholds are sent to all tasks; above, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Weights repeat over the sources in code point order.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and most passes over a source.
SHARE, MOST_PASSES = 1.5, 2


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text (null: the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all words by weight, at most ``most`` times a source's size.

    What a capped source can't take is shared out again by weight until none is above.
    That ends where each target is ``min(most * size, level * weight)``: sources are
    capped in the order of ``most * size / weight``, and the level follows from the
    sums over those before and after.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(order) - 1) % len(weights)
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    out = out.withColumn("budget", F.sum("source_size").over(everything) * float(share))
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("level", (F.col("budget") - before) / rest)
    # the level holds from the first source that it doesn't fill
    out = out.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("a"), F.col("level").alias("b")))).over(everything)["b"])
    return out.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, target, passes and threshold: below it a document is taken once more.

    The threshold cuts where the running sum of words by hash comes nearest the rest of
    the target. ``plan`` has one row for each source.
    """
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    # low: start of the bucket still open; done: words of the source below it
    state = plan.withColumn("low", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("long"))
    state = materialize(state, "mix-state")
    few = state.count() <= BROADCAST_SOURCES
    shift, rows = HASH_BITS, sizes
    while shift > 0:
        width = shift
        shift = max(0, shift - LEVEL_BITS)
        open_at = state.select(F.col("source").alias("s"), "low")
        rows = rows.join(F.broadcast(open_at) if few else open_at, F.col("source").eqNullSafe(F.col("s")))
        rows = rows.filter(F.shiftrightunsigned("hash", width) == F.shiftrightunsigned("low", width)).drop("s", "low") if width < HASH_BITS else rows.drop("s", "low")
        buckets = rows.groupBy("source", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count_distinct("hash").alias("kinds") if shift else F.lit(1).cast("long").alias("kinds"))
        along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        buckets = buckets.withColumn("upto", F.sum("n").over(along)).withColumnRenamed("source", "s")
        known = state.select("source", "source_size", "target", "passes", "need", "low", "done")
        joined = known.join(buckets, F.col("source").eqNullSafe(F.col("s")), "left")
        # the bucket in which the need is reached, or the end
        reach = F.when(F.col("done") + F.col("upto") >= F.col("need"), F.struct("bucket", "n", "upto", "kinds"))
        found = joined.groupBy("source", "source_size", "target", "passes", "need", "low", "done").agg(F.min(reach).alias("at"), F.max(F.struct("bucket", "n", "upto", "kinds")).alias("end"))
        at = F.coalesce("at", "end")
        found = found.select(
            "source", "source_size", "target", "passes", "need",
            F.coalesce(F.shiftleft(at["bucket"], shift), F.col("low")).alias("low"),
            (F.col("done") + F.coalesce(at["upto"] - at["n"], F.lit(0))).alias("done"),
            F.coalesce(at["n"], F.lit(0)).alias("last"), F.coalesce(at["kinds"], F.lit(0)).alias("kinds"),
        )
        state = materialize(found, "mix-state")
        if state.filter("kinds > 1").isEmpty():
            break
    # the boundary bucket has one hash: with or without it, whichever is nearer
    over, under = F.col("done") + F.col("last") - F.col("need"), F.col("need") - F.col("done")
    top = F.col("low") + F.lit((1 << shift))
    return state.select(F.col("source").alias("s"), "source_size", "target", "passes", F.when(over < under, top).otherwise(F.col("low")).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``taken`` is the words the mix takes of the row, repeats counted: size times whole
    passes, once more below its source's threshold. The words taken of a source differ
    from its target by half its largest group of equal ids at most. Rows that share an
    id share its hash. Null sources form one source, null texts and texts without words
    have size 0. Depends only on ids, sources and texts, so reruns agree.
    """
    sizes = materialize(docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _thresholds(sizes, targets(sources, weights, share, most))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("s")))
    passes = F.col("passes") + (F.col("hash") < F.col("threshold")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * passes).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns of ``docs``."""
    sizes = docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash"))
    sizes = materialize(sizes, "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(_thresholds(sizes, targets(sources, weights, share, most)), "mix-plan")
    plan = plan.select(F.struct("s", "passes", "threshold").alias(name := fresh(docs, "plan")))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = docs.join(plan, docs["source"].eqNullSafe(plan[name]["s"]))
    passes = F.col(name)["passes"] + (hash_of(docs["doc_id"]) < F.col(name)["threshold"]).cast("long")
    # a row that is taken n times is repeated n times
    copy = fresh(docs, "copy")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), passes.cast("int")))).drop(name, copy)
