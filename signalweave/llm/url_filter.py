"""URL allow and block rules by a sort-merge range join with a stack of nested rules.

A rule is a host and a path prefix; it fits urls of the host and its subdomains. A
canonical key has the host's labels reversed, each followed by a dot, then the path:
``com.example./en/``. Keys are compared by their UTF-8 bytes, so a prefix is the interval from
itself up to itself followed by byte FF, which no UTF-8 text has. Intervals of prefixes nest or
are disjoint.

:func:`_sweep` sorts bounds and probes together and passes over them once. A running sum of
openings and closings is the height of the stack, and the interval opened last at a
height is the one on the stack there. The sorted rows are cut into ranges of equal size; a range starts with the
stack that the ranges before it leave. The first sweep finds the rule hosts that
enclose a url's host, the second the longest path rule under each of them. Everything is made
of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialize, partitions, release

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"
#: Kinds of rows of a sweep, in the order in which they stand at one key.
HEIGHT, CARRIED, OPEN, PROBE, CLOSE = range(5)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels from the last to the first, each followed by a dot, which no label has."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(rules: DataFrame, probes: DataFrame, ranges: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """``probe`` with the ``rule`` that is on top of the stack at its key, or, if ``every``, with each one on the stack.

    ``rules`` has distinct keys (binary) and a rule, ``probes`` key, probe and a tie that parts equal
    keys. A probe under no rule comes once, with a null rule. Also returns the table of sorted rows that this reads.
    """
    rule, probe = rules.schema["rule"].dataType, probes.schema["probe"].dataType
    no_rule, no_probe, tie = F.lit(None).cast(rule).alias("rule"), F.lit(None).cast(probe).alias("probe"), F.lit(0).cast("long").alias("tie")

    def row(kind: int, step: int) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.lit(step).cast("long").alias("step")]

    opened = rules.select("key", *row(OPEN, 1), "rule", no_probe, tie)
    closed = rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), *row(CLOSE, -1), no_rule, no_probe, tie)
    asked = probes.select("key", *row(PROBE, 0), no_rule, "probe", "tie")
    dealt = opened.union(closed).union(asked).repartitionByRange(ranges, "key", "kind", "tie")
    events = materialize(dealt.drop("tie").withColumn("range", F.spark_partition_id()), "sweep")
    # what each range begins with follows from the bounds alone
    bounds = events.filter(F.col("kind") != PROBE)
    sums = bounds.groupBy("range").agg(F.sum("step").alias("step"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each range
    after = sums.select("range", F.sum("step").over(before).alias("height"), F.lead("range", 1, ranges - 1).over(Window.orderBy("range")).alias("next"))
    heights = after.select(F.explode(F.when(F.col("range") < F.col("next"), F.sequence(F.col("range") + 1, "next"))).alias("range"), F.col("height").alias("step"))
    along = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = heights.withColumnRenamed("step", "base")
    levels = bounds.withColumn("level", F.sum("step").over(along)).filter(F.col("kind") == OPEN).join(base, "range", "left").withColumn("level", F.col("level") + F.coalesce("base", F.lit(0)))
    last = levels.groupBy("range", "level").agg(F.max_by("rule", "key").alias("rule"))
    onward = last.withColumn("next", F.lead("range", 1, ranges - 1).over(Window.partitionBy("level").orderBy("range")))
    carried = onward.select(F.explode(F.when(F.col("range") < F.col("next"), F.sequence(F.col("range") + 1, "next"))).alias("range"), "level", "rule")
    start, nothing = F.lit(b"").alias("key"), F.lit(None).cast("long").alias("level")
    rows = events.select("range", "key", "kind", "step", "rule", "probe", nothing)
    rows = rows.union(heights.select("range", start, F.lit(HEIGHT), "step", no_rule, no_probe, nothing))
    rows = rows.union(carried.select("range", start, F.lit(CARRIED), F.lit(0).cast("long"), "rule", no_probe, "level"))
    height = F.sum("step").over(along)
    rows = rows.withColumn("height", height).filter(F.col("kind").isin(CARRIED, OPEN, PROBE))
    lowest = F.lit(1).cast("long") if every else F.greatest(F.col("height"), F.lit(1))
    asked_of = F.when((F.col("kind") == PROBE) & (F.col("height") > 0), F.sequence(lowest, "height")).otherwise(F.array(F.coalesce("level", "height")))
    rows = rows.withColumn("level", F.explode(asked_of))
    at = Window.partitionBy("range", "level").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("rule", F.when(F.col("level") > 0, F.last("rule", ignorenulls=True).over(at))).filter(F.col("kind") == PROBE)
    return found.select("probe", "rule"), events


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict. The longest fitting rule wins (host and path
    together; at equal length the longer host, then block). rule is null and the verdict
    ``default`` where none fits. Null urls and urls without ``://`` have empty host and
    path. A null page_id is judged like any other. Repeated rows are repeated in the result; other columns are not looked at. Without
    rules every verdict is ``default``.
    """
    ranges = partitions(pages)
    told = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    # repeated rules: block wins
    told = materialize(told.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", host_key(F.col("host"))), "rules")
    hosts = told.select(F.col("host_key").cast("binary").alias("key"), F.struct("host_key").alias("rule")).distinct()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("tie", F.monotonically_increasing_id())
    asked = rows.select(host_key(F.col("host")).cast("binary").alias("key"), F.struct(F.col("tie").alias("id"), "page_id", "host", "path").alias("probe"), "tie")
    # the ids are fixed by the table that the sweep writes
    enclosed, events = _sweep(hosts, asked, ranges, True)
    under = materialize(enclosed.select("probe", F.col("rule.host_key").alias("host_key")), "under")
    release(events)
    full = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("host_n"), "verdict", F.concat("host", "path").alias("rule"))
    paths = told.select(F.concat("host_key", "path").cast("binary").alias("key"), full.alias("rule"))
    probes = under.filter(F.col("host_key").isNotNull()).select(F.concat("host_key", "probe.path").cast("binary").alias("key"), "probe", F.col("probe.id").alias("tie"))
    none = under.filter(F.col("host_key").isNull()).select("probe", F.lit(None).cast(paths.schema["rule"].dataType).alias("rule"))
    longest, _ = _sweep(paths, probes, ranges, False)
    release(told)
    best = longest.union(none).groupBy("probe.id").agg(F.first("probe").alias("probe"), F.max("rule").alias("best"))
    return best.select("probe.page_id", "probe.host", "probe.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The rows of ``pages`` with an allowed url, with all their columns.

    Rows that share a page_id, null included, share a verdict: one blocked url blocks them all.
    """
    gone = judge(pages, rules, default).filter("verdict = 'block'").select(F.col("page_id").alias(name := fresh(pages, "blocked"))).distinct()
    return pages.join(gone, pages["page_id"].eqNullSafe(F.col(name)), "left_anti")


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
