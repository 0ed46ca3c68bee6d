"""Deduplication of lines that repeat across documents.

Texts are exploded to lines, and the normalised lines that are long enough are hashed. Distinct documents are
counted per hash; the lines of a hash in too many documents go, except in the document of largest id that has
it. What a document loses is put together as the positions of its lines, and its text reassembled from the others.

Only hashes, ids and positions are shuffled with the lines. A hash of two independent 64-bit halves stands for a line.
Hashes are counted by partial sums. The repeating hashes that are in most documents are sent to all tasks, up to a fixed
number of them, so that the others, which are joined by a shuffle, have few lines each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, fresh, materialize

#: Shortest key that counts, in code points, and the distinct documents from which on a key repeats.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Most repeating keys that are sent to all tasks (about 40 bytes each).
BROADCAST_KEYS = 200_000


def lines_of(text: Column) -> Column:
    """The text cut at every line feed; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _row(doc_id: str, text: str) -> Column:
    """What a row is known by: rows that repeat both id and text lose the same lines."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _keyed(docs: DataFrame, least_chars: int) -> DataFrame:
    """row, position and key hash (a, b) of every line whose key is long enough."""
    lines = docs.select(_row("doc_id", "text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keys = lines.select("row", "at", key_of(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return keys.select("row", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def repeated_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """a, b, n_docs, keep: the hashes of keys found in ``least_docs`` documents or more, and the largest doc_id (as a struct) that has each.

    A document is what has one doc_id: rows that repeat an id are one document, and so are the rows without an id, the smallest.
    """
    doc = F.struct(F.col("row.doc_id").alias("doc_id"))
    found = _keyed(docs, least_chars).groupBy("a", "b").agg(F.count_distinct(doc).alias("n_docs"), F.max(doc).alias("keep"))
    return found.filter(F.col("n_docs") >= least_docs)


def dropped_positions(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """row (doc_id and two hashes of the text), gone: the sorted 0-based positions of the lines that each row loses; rows that lose none are left out."""
    keys = materialize(repeated_keys(docs, least_chars, least_docs), "lines")
    lines = _keyed(docs, least_chars)
    lost = F.struct(F.col("row.doc_id").alias("doc_id")) != F.col("keep")
    number, pairs = keys.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    if number <= BROADCAST_KEYS:
        found = lines.join(F.broadcast(keys), ["a", "b"]).filter(lost).select("row", "at")
    else:
        # fewer than BROADCAST_KEYS keys are in more than this part of all (document, key) pairs, and no other key has more
        hot = F.col("n_docs") > pairs / BROADCAST_KEYS
        seen = lines.join(F.broadcast(keys.filter(hot)), ["a", "b"], "left")
        rest = seen.filter("keep IS NULL").select("row", "at", "a", "b").join(keys.filter(~hot), ["a", "b"]).filter(lost)
        found = seen.filter("keep IS NOT NULL").filter(lost).select("row", "at").union(rest.select("row", "at"))
    return found.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def _others(lines: Column, gone: Column) -> Column:
    """The lines outside the sorted positions: the stretches between them, each cut out once."""
    stops = F.concat(gone, F.array(F.size(lines)))
    stretches = F.transform(stops, lambda stop, i: F.slice(lines, F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 2, stop - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1))
    return F.flatten(stretches)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of ``text``; all other columns stay.

    A line repeats if its key (white space stripped at both ends, A-Z lower-cased) has ``least_chars`` code points or more and
    is found in ``least_docs`` documents or more. It stays in the document of largest id that has it, there as often as it occurs, and goes
    from the others. Lines are cut at ``\\n`` and joined by it. A null text, like any text that loses nothing, stays as it is; a text that loses all
    its lines becomes empty. Rows that repeat an id are one document in the counts, and so are rows with a null id, whose id counts as the smallest; each row is reassembled
    by itself. Whole texts of any length are read, empty tables stay empty, and other columns may have any name. ``counts`` names
    two columns for the numbers of lines before dropping and of dropped lines.
    """
    row, gone = fresh(docs, "line_row"), fresh(docs, "lines_gone")
    found = dropped_positions(docs, least_chars, least_docs).select(F.col("row").alias(row), F.col("gone").alias(gone))
    mine = _row("doc_id", "text")
    same = mine["doc_id"].eqNullSafe(F.col(row)["doc_id"]) & (mine["x"] == F.col(row)["x"]) & (mine["y"] == F.col(row)["y"])
    rows = docs.join(found.hint("shuffle_hash"), same, "left")
    lines = lines_of(F.col("text"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_others(lines, F.col(gone)), "\n"))
    n_gone = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    extra = [F.size(lines).cast("long").alias(counts[0]), n_gone.cast("long").alias(counts[1])] if counts else []
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *extra)
