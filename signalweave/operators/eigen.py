"""Lowest Laplacian eigenvectors of large networks, and clusters of their rows, by joins over edges (rows G10, G11).

No matrix of nodes is made. The rows of a block of vectors lie in a table, and a product with the matrix is one join with
the entries and one sum. A round of the block method widens the span of the estimates, of the directions taken last and of the residuals by
further products; tasks sum the span's inner products, the driver solves the small eigenproblem, and tasks apply its coefficients to
their rows. What reaches the driver is as large as the number of vectors squared, whatever the number of nodes.
Blocks find repeated eigenvalues (a network of several parts has several zeros), which a single vector would not.

A network is (src, dst, weight) with columns ``by`` that tell networks apart (null is one). As with the matrix of a small one, strength
sums the absolute weights from a node and the entry of two nodes is that with the larger name as ``src``; repeated edges count once, with the
largest absolute weight. Rows without a weight or a node are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import stored
from .blocks import meet
from .paths import nodes_of

#: Networks worked on together; their small matrices are in the driver at the same time.
TOGETHER = 64
#: Vectors beside the wanted ones, which make the wanted ones settle sooner.
SPARE = 4
#: Products with the matrix in a round.
PRODUCTS = 3


def large_networks(network: DataFrame, by: list[str], nodes: int) -> DataFrame:
    """by: the networks with more than ``nodes`` nodes."""
    return nodes_of(network, by).groupBy(*by).count().filter(F.col("count") > nodes).drop("count")


def entries_of(network: DataFrame, normalized: bool) -> tuple[DataFrame, DataFrame]:
    """_net, src, dst, value of I - L / c, whose eigenvalues lie between -1 and 1; and _net, c (1 if normalised, else the largest strength)."""
    heaviest = F.max(F.struct(F.abs("weight").alias("size"), "weight"))["weight"].alias("weight")
    edges = stored(network.groupBy("_net", "src", "dst").agg(heaviest), "edges")
    strength = nodes_of(edges, ["_net"]).join(edges.groupBy("_net", F.col("src").alias("node")).agg(F.sum(F.abs("weight")).alias("strength")), ["_net", "node"], "left").select("_net", "node", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    strength = stored(strength, "strength")
    scale = strength.groupBy("_net").agg((F.lit(1.0) if normalized else F.greatest(F.max("strength"), F.lit(1e-300))).alias("c"))
    root = F.when(F.col("strength") > 0, 1 / F.sqrt("strength")).otherwise(1.0) if normalized else F.lit(1.0)
    # one row for each of at most TOGETHER networks
    root_of = strength.join(F.broadcast(scale), "_net").select("_net", "node", "strength", (root / F.sqrt("c")).alias("root"))
    below = edges.filter("src > dst OR src = dst")
    below = below.join(root_of.select("_net", F.col("node").alias("src"), F.col("root").alias("_rs")), ["_net", "src"])
    below = below.join(root_of.select("_net", F.col("node").alias("dst"), F.col("root").alias("_rd")), ["_net", "dst"])
    below = below.select("_net", "src", "dst", (F.col("weight") * F.col("_rs") * F.col("_rd")).alias("value"))
    above = below.filter("src <> dst").select("_net", F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
    # every node keeps a diagonal row, zero or not, so that no node is lost in a product
    diagonal = root_of.select("_net", F.col("node").alias("src"), F.col("node").alias("dst"), (1 - F.col("strength") * F.col("root") * F.col("root")).alias("value"))
    return stored(below.unionByName(above).unionByName(diagonal), "entries"), scale


def product(entries: DataFrame, rows: DataFrame, column: str, out: str, width: int) -> DataFrame:
    """_net, node, ``out``: the matrix times the block of vectors in the array ``column``."""
    met = entries.join(rows.select("_net", F.col("node").alias("dst"), column), ["_net", "dst"])
    return met.groupBy("_net", F.col("src").alias("node")).agg(F.array(*[F.sum(F.col("value") * F.col(column)[i]) for i in range(width)]).alias(out))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _of_net(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    nets = batch.column(batch.schema.get_field_index("_net")).to_numpy()
    for net in np.unique(nets):
        yield int(net), np.flatnonzero(nets == net)


def _arrays(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(rows).ravel()))


def summed(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    """The sums over all rows of ``partial(batch, places)``, a flat array for the rows of one network in a batch.

    Each task adds up its batches, and the tasks' sums meet entry by entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for net, places in _of_net(batch):
                found = partial(batch, net, places)
                total[net] = total[net] + found if net in total else found
        for net, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(values.size, net, np.int32)), pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values)], names=["_net", "at", "v"])

    found = rows.mapInArrow(run, "_net int, at int, v double").groupBy("_net", "at").agg(F.sum("v").alias("v"))
    out = {}
    for net, at in found.groupBy("_net").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"]).collect():
        out[net] = np.array(at)
    return out


def _ritz(gram: np.ndarray, image: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest Ritz values of a span and their coefficients; columns without a direction are zero with value -inf."""
    size = np.diag(gram)
    scale = np.where(size > 0, 1 / np.sqrt(np.where(size > 0, size, 1.0)), 0.0)
    values, vectors = np.linalg.eigh(gram * scale[:, None] * scale[None, :])
    keep = values > 1e-10 * max(values.max(), 1e-300)
    basis = scale[:, None] * vectors[:, keep] / np.sqrt(values[keep])
    small = basis.T @ image @ basis
    theta, y = np.linalg.eigh((small + small.T) / 2)
    order = theta.argsort()[::-1][:width]
    out, top = np.zeros((len(gram), width)), np.full(width, -np.inf)
    out[:, : order.size], top[: order.size] = basis @ y[:, order], theta[order]
    return top, out


def _advance(span: DataFrame, found: dict[int, tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """New estimates x, their images ax, the directions q and aq that led to them, and residuals r, from the rows of a span."""
    names = ["x", "ax", "q", "aq", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(names), batch.num_rows, width))
            basis, image = _matrix(batch, "basis"), _matrix(batch, "image")
            for net, at in _of_net(batch):
                theta, c = found[net]
                step = c.copy()
                step[:width] = 0
                x, ax = basis[at] @ c, image[at] @ c
                out[:, at] = x, ax, basis[at] @ step, image[at] @ step, ax - x * np.where(np.isfinite(theta), theta, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[_arrays(m) for m in out]], names=["_net", "node", *names])

    node = span.schema["node"].dataType.simpleString()
    return span.mapInArrow(run, f"_net int, node {node}, " + ", ".join(f"{n} array<double>" for n in names))


def _inner(batch: pa.RecordBatch, net: int, places: np.ndarray) -> np.ndarray:
    basis, image = _matrix(batch, "basis")[places], _matrix(batch, "image")[places]
    return np.concatenate([(basis.T @ basis).ravel(), (basis.T @ image).ravel()])


def lowest(network: DataFrame, k: int, normalized: bool, rounds: int, tolerance: float) -> tuple[dict[int, np.ndarray], DataFrame]:
    """The k lowest Laplacian eigenvalues of each network ``_net``, ascending, and (_net, node, x): a node's entries of their vectors.

    Ends when all residuals are below ``tolerance``, relative to the largest eigenvalue possible; an eigenvalue is off by no more than its
    residual. Warns after ``rounds`` rounds. The start is drawn from hashes of the nodes, so reruns and lost tasks agree.
    """
    entries, scale = entries_of(network, normalized)
    width = k + SPARE
    start = [(F.xxhash64(F.col("node").cast("string"), F.lit(i)) / F.lit(2.0**63)).alias(f"_{i}") for i in range(width)]
    none = F.array(*[F.lit(0.0)] * width)
    now = stored(nodes_of(entries, ["_net"]).select("_net", "node", *[none.alias(c) for c in ("x", "ax", "q", "aq")], F.array(*start).alias("r")), "vectors")
    for _ in range(rounds):
        span, last = now, now.select("_net", "node", "r")
        for j in range(PRODUCTS):
            last = product(entries, last, "r" if j == 0 else f"b{j}", f"b{j + 1}", width)
            span = span.join(last, ["_net", "node"])
        more = [f"b{j + 1}" for j in range(PRODUCTS)]
        span = stored(span.select("_net", "node", F.concat("x", "q", "r", *more[:-1]).alias("basis"), F.concat("ax", "aq", *more).alias("image")), "span")
        wide = (2 + PRODUCTS) * width
        found, worst = {}, 0.0
        for net, sums in summed(span, _inner).items():
            gram, image = sums.reshape(2, wide, wide)
            worst = max(worst, float(np.sqrt(np.diag(gram)[2 * width : 2 * width + k].max())))
            found[net] = _ritz(gram, image, width)
        now = stored(_advance(span, found, width), "vectors")
        if worst < tolerance:
            break
    else:
        warnings.warn(f"eigenvectors of a network moved by {worst:.1e} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    c = {r["_net"]: r["c"] for r in scale.collect()}
    values = {net: (c[net] * (1 - theta[:k]))[np.isfinite(theta[:k])] for net, (theta, _) in found.items()}
    return values, now.select("_net", "node", F.slice("x", 1, k).alias("x"))


def _groups(network: DataFrame, by: list[str], large: DataFrame | None) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Numbered keys (by, _net) of a group of networks, and its edges (_net, src, dst, weight)."""
    spark = network.sparkSession
    network = network.filter(F.col("weight").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    if not by:
        yield spark.createDataFrame([(0,)], "_net int"), network.select(F.lit(0).alias("_net"), "src", "dst", F.col("weight").cast("double").alias("weight"))
        return
    names = large.collect()  # networks of more than paths.NODES nodes each
    for at in range(0, len(names), TOGETHER):
        some = [(*row, i) for i, row in enumerate(names[at : at + TOGETHER])]
        keys = spark.createDataFrame(some, T.StructType([*large.schema.fields, T.StructField("_net", T.IntegerType())]))
        yield keys, meet(network, F.broadcast(keys), by).select("_net", "src", "dst", F.col("weight").cast("double").alias("weight"))


def eigenvalues(network: DataFrame, k: int, large: DataFrame | None, by: list[str], normalized: bool = True, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """by, place, eigenvalue: the k lowest of each network in ``large``, from place 1."""
    out = None
    for keys, edges in _groups(network, by, large):
        values, _ = lowest(edges, k, normalized, rounds, tolerance)
        rows = [(net, i + 1, float(v)) for net, found in values.items() for i, v in enumerate(found)]
        table = network.sparkSession.createDataFrame(rows, "_net int, place int, eigenvalue double").join(F.broadcast(keys), "_net").select(*by, "place", "eigenvalue")
        out = table if out is None else out.unionByName(table)
    return out


def clusters(network: DataFrame, k: int, large: DataFrame | None, by: list[str], seed: int = 123, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """by, node, cluster (from 1): k-means on the unit rows of the first k normalised vectors, for each network in ``large``.

    The first centre is the row of the smallest hash of its node, each next one the row farthest from the centres so far; then a round
    is one pass that sums the rows of each centre. Only centres reach the driver.
    """
    out = None
    for keys, edges in _groups(network, by, large):
        _, vectors = lowest(edges, k, True, 200, tolerance)
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
        rows = stored(vectors.select("_net", "node", F.transform("x", lambda v: v / F.greatest(size, F.lit(1e-12))).alias("x")), "rows")
        first = rows.groupBy("_net").agg(F.min_by("x", F.struct(F.xxhash64(F.col("node").cast("string"), F.lit(seed)), "node")).alias("x"))
        centres = {r["_net"]: np.array([r["x"]]) for r in first.collect()}
        for _ in range(k - 1):
            for net, x in _farthest(rows, centres).items():
                centres[net] = np.vstack([centres[net], x])
        for _ in range(rounds):
            sums = summed(rows, _sums_by_centre(centres))
            moved = {}
            for net, centre in centres.items():
                total = sums[net].reshape(k, -1)
                n = total[:, -1:]
                moved[net] = np.where(n > 0, total[:, :-1] / np.maximum(n, 1), centre)
            still = all(np.allclose(moved[net], centres[net]) for net in centres)
            centres = moved
            if still:
                break
        table = _labelled(rows, centres).join(F.broadcast(keys), "_net").select(*by, "node", "cluster")
        out = table if out is None else out.unionByName(table)
    return out


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((rows[:, None] - centres[None]) ** 2).sum(axis=2)


def _farthest(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, list[float]]:
    """The row of each network that is farthest from its nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x")
            best = [(net, at[gap.argmax()], gap.max()) for net, at in _of_net(batch) if (gap := _gaps(x[at], centres[net]).min(axis=1)).size]
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.int32()), pa.array([float(b[2]) for b in best]), _arrays(x[[b[1] for b in best]])], names=["_net", "gap", "x"])

    found = rows.mapInArrow(run, "_net int, gap double, x array<double>").groupBy("_net").agg(F.max(F.struct("gap", "x"))["x"].alias("x"))
    return {r["_net"]: r["x"] for r in found.collect()}


def _sums_by_centre(centres: dict[int, np.ndarray]):
    def partial(batch: pa.RecordBatch, net: int, places: np.ndarray) -> np.ndarray:
        x = _matrix(batch, "x")[places]
        chosen = np.eye(len(centres[net]))[_gaps(x, centres[net]).argmin(axis=1)]
        return (chosen.T @ np.column_stack([x, np.ones(len(x))])).ravel()

    return partial


def _labelled(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, label = _matrix(batch, "x"), np.zeros(batch.num_rows, np.int32)
            for net, at in _of_net(batch):
                label[at] = _gaps(x[at], centres[net]).argmin(axis=1) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label)], names=["_net", "node", "cluster"])

    return rows.mapInArrow(run, f"_net int, node {rows.schema['node'].dataType.simpleString()}, cluster int")
