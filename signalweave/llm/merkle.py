"""Merkle manifest of a dataset: one tree over the rows of each source, one over the sources' roots.

The trees are built by supersteps over RDDs of blocks of nodes. Going up, children message their parents, and a parent that has
all its children hashes them and messages on. Going down, each parent hands its children the path of siblings that leads from
it to the root, and each child puts its own siblings before it. In the end every leaf has the path that proves it.

A block is all nodes below one node ``SPAN`` levels higher. Its messages are passed inside the task that holds it, so a superstep takes them
``SPAN`` levels and one shuffle of a ``FAN ** SPAN``-th of the nodes leads to the next. The tasks hold one block at a time, whatever the size of a
source. Leaves get their numbers from ranges of the order with the sums of the ranges before (:func:`placed`), not from a sort of a whole source.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import placed
from .common import materialize, partitions

#: Children of a node, and levels of a block.
FAN, SPAN = 3, 7
#: Columns that a leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "source string, doc_id {id}, leaf string, claimed string, path array<struct<place:int,siblings:array<string>>>, subroot string, root string"

#: A node: its digest and what rides on it. A path: steps from the bottom up, each the place among the siblings and their digests.
Step = tuple[int, tuple[str, ...]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values: dict[str, Column]) -> Column:
    """Hex sha256 of the covered values: each ``-`` if null, else its UTF-8 length, a colon and itself; whole numbers as decimals."""
    texts = [values[c].cast("string") for c in COVERED]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height_of(size: int) -> int:
    """Levels above ``size`` leaves until one node is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _deal(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The digests of a block on all its levels, from the bottom up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def _steps(block: list[list[str]], at: int) -> Iterator[Step]:
    """The steps from node ``at`` of the bottom of a block to its top."""
    for level in block[:-1]:
        first = at - at % FAN
        run = level[first : first + FAN]
        yield at - first, tuple(run[: at - first] + run[at - first + 1 :])
        at //= FAN


class Forest:
    """Trees over (tree, number, digest, size of the tree, rider) rows; ``rider`` is handed back with the path of its leaf.

    ``heights`` gives the height of the highest tree, and so the number of supersteps.
    """

    def __init__(self, leaves: RDD, height: int, parts: int, span: int):
        self.span, self.parts = span, parts
        wide = FAN**span
        #: blocks[k]: ((tree, block), [(number, digest, levels left, rider)]) of the nodes k * span levels above the leaves
        self.blocks: list[RDD] = []
        #: (tree, (superstep, digest)) of finished trees
        self.roots: RDD | None = None
        nodes = leaves.map(lambda r: ((r[0], r[1] // wide), (r[1], r[2], height_of(r[3]), r[4])))
        for k in range(max(1, -(-height // span))):
            here = nodes.groupByKey(parts, _deal)
            self.blocks.append(here)
            done = here.filter(self._is_last).map(lambda kv, k=k: (kv[0][0], (k, self._top(kv[1]))))
            self.roots = done if self.roots is None else self.roots.union(done)
            nodes = here.filter(lambda kv: not self._is_last(kv)).map(lambda kv: ((kv[0][0], kv[0][1] // wide), (kv[0][1], self._top(kv[1]), self._left(kv[1]) - span, None)))

    def __getstate__(self) -> dict:
        return {"span": self.span, "parts": self.parts}  # the tasks need no RDDs

    @staticmethod
    def _left(nodes) -> int:
        return next(iter(nodes))[2]

    def _is_last(self, block: tuple) -> bool:
        return self._left(block[1]) <= self.span

    def _levels(self, nodes) -> list[list[str]]:
        return _climb([n[1] for n in sorted(nodes, key=lambda n: n[0])], min(self.span, self._left(nodes)))

    def _top(self, nodes) -> str:
        return self._levels(nodes)[-1][0]

    def paths(self, above: RDD) -> RDD:
        """(rider, digest, path to the top, what came with the tree) of all leaves; ``above``: (tree, (superstep of its root, path above it, what comes with it))."""
        wide, span = FAN**self.span, self.span
        down = None
        for k in range(len(self.blocks) - 1, -1, -1):
            mine = above.filter(lambda kv, k=k: kv[1][0] == k).map(lambda kv: ((kv[0], 0), (kv[1][1], kv[1][2])))
            told = mine if down is None else down.union(mine)
            met = self.blocks[k].cogroup(told, numPartitions=self.parts)

            def below(kv: tuple, lowest: bool = k == 0) -> Iterator[tuple]:
                (tree, _), (groups, messages) = kv
                nodes = [n for g in groups for n in g]
                for path, extra in messages:
                    levels = self._levels(nodes)
                    for i, (number, name, _, rider) in enumerate(sorted(nodes, key=lambda n: n[0])):
                        steps = (*_steps(levels, i), *path)
                        yield (rider, name, steps, extra) if lowest else ((tree, number), (steps, extra))

            down = met.flatMap(below)
        return down


def _numbered(rows: DataFrame, tree: list[str], order: list[Column]) -> tuple[DataFrame, int]:
    """Rows with ``number`` and ``size``, and the height of the highest tree."""
    rows = placed(rows, order, tree, "number", "size", store=materialize)
    most = rows.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    return rows, height_of(most)


def _built(docs: DataFrame, claimed: Column | None, span: int) -> tuple[Forest, Forest, RDD, str]:
    spark, parts = docs.sparkSession, partitions(docs)
    leaf = leaf_of({c: F.col(c) for c in COVERED})
    kind = docs.schema["doc_id"].dataType.simpleString()
    claim = F.lit(None).cast("string") if claimed is None else claimed
    rows = materialize(docs.select(F.col("source").cast("string").alias("source"), "doc_id", leaf.alias("leaf"), claim.alias("claimed")), "leaves")
    rows, height = _numbered(rows, ["source"], [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc_nulls_first("claimed")])
    forest = Forest(rows.select("source", "number", "leaf", "size", "doc_id", "claimed").rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], r[5]))), height, parts, span)
    subroots = spark.createDataFrame(forest.roots.map(lambda kv: (kv[0], kv[1][0], kv[1][1])), "source string, step int, subroot string", verifySchema=False)
    subroots, high = _numbered(materialize(subroots, "subroots"), [], [F.asc_nulls_first("source")])
    crown = Forest(subroots.select("number", "subroot", "size", "source", "step").rdd.map(lambda r: (0, r[0], r[1], r[2], (r[3], r[4]))), high, parts, span)
    return forest, crown, crown.paths(crown.roots.map(lambda kv: (kv[0], (kv[1][0], (), kv[1][1])))), kind


def manifest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """source, subroot, root: one row per source with the root of its rows' tree, and the root over all sources."""
    _, _, sources, _ = _built(docs, None, span)
    return docs.sparkSession.createDataFrame(sources.map(lambda r: (r[0][0], r[1], r[3])), "source string, subroot string, root string", verifySchema=False)


def proofs(docs: DataFrame, claimed: Column | None = None, span: int = SPAN) -> DataFrame:
    """source, doc_id, leaf, claimed, path, subroot, root: one row per row of ``docs``.

    A leaf is the hash of its row's covered columns. In each source (null is one) leaves ascend by doc_id, a null id before all, rows that repeat an id
    by their leaves; every ``FAN`` neighbours, the last ones fewer, become their hash until one is left, the subroot, and the
    subroots in the order of their sources (null first) likewise the root. ``path`` has a step for each level from leaf to root: the place
    among the siblings and the others' digests. ``claimed`` is a column of ``docs``, or an expression over it, that comes back with the proof: a digest to be verified.
    Texts of any length and empty ones are hashed whole; an empty table has no rows, other columns are not covered, and equal rows each have a leaf.
    """
    forest, _, sources, kind = _built(docs, claimed, span)
    above = sources.map(lambda r: (r[0][0], (r[0][1], r[2], (r[0][0], r[1], r[3]))))
    rows = forest.paths(above).map(lambda r: (r[3][0], r[0][0], r[1], r[0][1], list(r[2]), r[3][1], r[3][2]))
    return docs.sparkSession.createDataFrame(rows, PROOF.format(id=kind), verifySchema=False)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    def up(name: Column, step: Column) -> Column:
        names = step["siblings"]
        run = F.concat(F.slice(names, F.lit(1), step["place"]), F.array(name), F.slice(names, step["place"] + 1, F.size(names)))
        return F.sha2(F.array_join(run, "").cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """Hex sha256 of all siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), "").cast("binary"), 256)


def verify(proved: DataFrame) -> DataFrame:
    """Add folded_root and verified to proofs: the root that the claimed leaf (the own one where none is claimed) leads to, and whether it is the root."""
    found = proved.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has lost its line feeds, where crc32 of the decimal doc_id is even; null elsewhere (and for null ids)."""
    values = {c: F.col(c) for c in COVERED} | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf_of(values))


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs of the untampered rows, and the tampered rows folded along them."""
    found = verify(proofs(docs, tampered(docs), span))
    return found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
