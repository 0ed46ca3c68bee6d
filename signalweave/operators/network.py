"""Graph measures on connectivity networks (rows G1-G16, O3).

A network is a table of edges (src, dst, weight) with both directions and no loops. Degree,
clustering, density thresholds, Laplacian and modularity are native. Measures over
all paths and spectra run in numpy on the adjacency matrix of a network with few nodes (spread by ``per_network``), and as
joins over edges beyond (:mod:`.paths`, :mod:`.eigen`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import stored
from . import eigen, paths
from .blocks import meet


def adjacency(edges: DataFrame, threshold: float = 0.0, absolute: bool = True, undirected: bool = True) -> DataFrame:
    """G1: src, dst, weight from rows (a, b, value): both directions, no loops, weights below ``threshold`` and zeros dropped."""
    weight = F.abs("value") if absolute else F.col("value")
    one = edges.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("weight")).filter(F.col("weight").isNotNull() & (F.col("weight") != 0) & (F.abs("weight") >= threshold))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if undirected else one


def density_threshold(network: DataFrame, density: float) -> DataFrame:
    """The strongest share of the edges by absolute weight; edges tied with the last stay."""
    if not 0 < density <= 1:
        raise ValueError("density must be above 0 and at most 1")
    once = network.filter("src < dst").withColumn("place", F.rank().over(Window.orderBy(F.desc(F.abs("weight"))))).withColumn("n", F.count("*").over(Window.partitionBy()))
    kept = once.filter(F.col("place") <= F.ceil(F.col("n") * density)).select("src", "dst", "weight")
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def binarize(network: DataFrame, threshold: float = 0.0) -> DataFrame:
    """G3."""
    return network.filter(F.abs("weight") > threshold).withColumn("weight", F.lit(1.0))


def degree(network: DataFrame, weighted: bool = False) -> DataFrame:
    """Node, degree: number of edges, or sum of absolute weights."""
    return network.groupBy(F.col("src").alias("node")).agg((F.sum(F.abs("weight")) if weighted else F.count("*").cast("double")).alias("degree"))


def clustering(network: DataFrame, weighted: bool = False) -> DataFrame:
    """Node, clustering: share of a node's neighbour pairs that are linked; weighted by the cube root of the
    product of the three weights over the largest."""
    size = network.agg(F.max(F.abs("weight")).alias("largest"))
    w = F.abs("weight") / F.col("largest") if weighted else F.lit(1.0)
    scaled = network.join(F.broadcast(size)).select("src", "dst", w.alias("w"))
    ab = scaled.select(F.col("src").alias("node"), F.col("dst").alias("p"), F.col("w").alias("w1"))
    ac = scaled.select(F.col("src").alias("node"), F.col("dst").alias("q"), F.col("w").alias("w2"))
    bc = scaled.select(F.col("src").alias("p"), F.col("dst").alias("q"), F.col("w").alias("w3"))
    triangles = ab.join(ac, "node").filter("p < q").join(bc, ["p", "q"]).groupBy("node").agg(F.sum(F.cbrt(F.col("w1") * F.col("w2") * F.col("w3"))).alias("t"))
    k = F.col("degree")
    out = degree(network).join(triangles, "node", "left")
    return out.select("node", F.when(k >= 2, 2 * F.coalesce("t", F.lit(0.0)) / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def laplacian(network: DataFrame, normalized: bool = False) -> DataFrame:
    """Src, dst, value of D - A, or of its symmetric normalisation; D sums absolute weights."""
    strength = degree(network, True)
    if not normalized:
        off = network.select("src", "dst", (-F.col("weight")).alias("value"))
        return off.unionByName(strength.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("degree").alias("value")))
    left, right = strength.select(F.col("node").alias("src"), F.col("degree").alias("ds")), strength.select(F.col("node").alias("dst"), F.col("degree").alias("dd"))
    off = network.join(left, "src").join(right, "dst").select("src", "dst", (-F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("value"))
    return off.unionByName(strength.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("value")))


def modularity(network: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman's Q of a partition (node, community)."""
    strength = network.groupBy("src").agg(F.sum("weight").alias("k")).join(communities.select(F.col("node").alias("src"), "community"), "src")
    inside = network.join(communities.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(communities.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    within = inside.filter("cs = cd").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("within"))
    expected = strength.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return within.join(F.broadcast(expected)).select((F.col("within") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))).alias("modularity"))


def edge_density(network: DataFrame) -> DataFrame:
    """Share of possible edges that exist."""
    n = F.count_distinct("src")
    return network.agg((F.count("*") / (n * (n - 1))).alias("density"))


# ---------------------------------------------------------------- on matrices
def matrix_of(rows: pd.DataFrame) -> tuple[list, np.ndarray]:
    nodes = sorted(set(rows["src"]) | set(rows["dst"]))
    at = {n: i for i, n in enumerate(nodes)}
    out = np.zeros((len(nodes), len(nodes)))
    out[[at[s] for s in rows["src"]], [at[d] for d in rows["dst"]]] = rows["weight"]
    return nodes, out


def distances(matrix: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Shortest paths by relaxing over each node in turn; an edge is 1 long, or largest weight / weight."""
    size = np.abs(matrix)
    with np.errstate(divide="ignore"):
        length = np.where(size > 0, (size.max(initial=0.0) / size) if weighted else 1.0, np.inf)
    np.fill_diagonal(length, 0.0)
    for k in range(len(length)):
        length = np.minimum(length, length[:, k : k + 1] + length[k : k + 1, :])
    return length


def betweenness(matrix: np.ndarray, normalized: bool = True) -> np.ndarray:
    """Shortest paths through each node, by breadth-first searches that accumulate backwards.

    Each pair of ends counts in both directions; normalised to a share of the pairs of other nodes.
    """
    n = len(matrix)
    near = [np.flatnonzero(row).tolist() for row in matrix]
    total = np.zeros(n)
    for source in range(n):
        depth, ways, before, visited = {source: 0}, np.zeros(n), [[] for _ in range(n)], []
        ways[source] = 1
        queue = deque([source])
        while queue:
            v = queue.popleft()
            visited.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        flow = np.zeros(n)
        for w in reversed(visited):
            for v in before[w]:
                flow[v] += ways[v] / ways[w] * (1 + flow[w])
            if w != source:
                total[w] += flow[w]
    return total / ((n - 1) * (n - 2)) if normalized and n > 2 else total


def eigenvector(matrix: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """By power iteration."""
    x = np.ones(len(matrix)) / np.sqrt(max(1, len(matrix)))
    for _ in range(rounds):
        y = np.abs(matrix) @ x + 1e-3 * x  # the shift lets bipartite networks settle
        y /= np.linalg.norm(y) or 1.0
        if np.abs(y - x).max(initial=0.0) < tolerance:
            return y
        x = y
    return x


def global_efficiency(matrix: np.ndarray, weighted: bool = False) -> float:
    """Mean of 1 / distance over pairs."""
    d = distances(matrix, weighted)
    n = len(d)
    with np.errstate(divide="ignore"):
        inverse = np.where(np.eye(n, dtype=bool), 0.0, 1 / d)
    return float(inverse.sum() / (n * (n - 1))) if n > 1 else 0.0


def local_efficiency(matrix: np.ndarray) -> np.ndarray:
    """Efficiency among each node's neighbours; 0 below two."""
    out = np.zeros(len(matrix))
    for i, row in enumerate(matrix):
        near = np.flatnonzero(row)
        if near.size >= 2:
            out[i] = global_efficiency(matrix[np.ix_(near, near)])
    return out


def spectral_basis(matrix: np.ndarray, k: int | None = None, normalized: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of the Laplacian."""
    strength = np.abs(matrix).sum(axis=1)
    lap = np.diag(strength) - matrix
    if normalized:
        root = 1 / np.sqrt(np.where(strength > 0, strength, 1))
        lap = lap * root[:, None] * root[None, :]
    values, vectors = np.linalg.eigh(lap)
    return values[:k], vectors[:, :k]


def spectral_clusters(matrix: np.ndarray, k: int, seed: int = 123, rounds: int = 100) -> np.ndarray:
    """K-means on the rows of the first k Laplacian vectors; centres start far apart."""
    _, rows = spectral_basis(matrix, k)
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = [rows[rng.integers(len(rows))]]
    while len(centres) < k:
        gap = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(rows[int(gap.argmax())])
    centres = np.array(centres)
    for _ in range(rounds):
        label = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([rows[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return label + 1


def rewire(matrix: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Swap ends of edges, ten tries for each edge; degrees stay."""
    out = (matrix != 0).astype(float)
    edges = [tuple(e) for e in np.argwhere(np.triu(out)).tolist()]
    for _ in range(10 * len(edges)):
        i, j = rng.integers(len(edges), size=2)
        (a, b), (c, d) = edges[i], edges[j]
        if rng.random() < 0.5:
            c, d = d, c
        if len({a, b, c, d}) < 4 or out[a, d] or out[c, b]:
            continue
        for p, q, v in ((a, b, 0), (c, d, 0), (a, d, 1), (c, b, 1)):
            out[p, q] = out[q, p] = v
        edges[i], edges[j] = (a, d), (c, b)
    return out


def mean_clustering(matrix: np.ndarray) -> float:
    linked = (matrix != 0).astype(float)
    k = linked.sum(axis=1)
    closed = np.diag(linked @ linked @ linked)
    return float(np.mean(np.where(k >= 2, closed / np.maximum(k * (k - 1), 1), 0.0))) if len(linked) else 0.0


def mean_path(matrix: np.ndarray) -> float:
    d = distances(matrix)
    d = d[np.isfinite(d) & ~np.eye(len(d), dtype=bool)]
    return float(d.mean()) if d.size else float("nan")


def per_network(network: DataFrame, fn: Callable[[list, np.ndarray], dict], out: str, by: list[str] | None = None) -> DataFrame:
    """Apply a function of (nodes, matrix) to each network; ``by`` are the keys of networks."""
    by = by or []
    kinds = ", ".join(f"`{k}` {network.schema[k].dataType.simpleString()}" for k in by)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(fn(*matrix_of(frame)))
        for k in reversed(by):
            found.insert(0, k, frame[k].iloc[0])
        return found

    return network.groupBy(*by).applyInPandas(run, f"{kinds}{', ' if kinds else ''}{out}")


def node_kind(network: DataFrame) -> str:
    return network.schema["src"].dataType.simpleString()


def path_lengths(network: DataFrame, weighted: bool = False, by: list[str] | None = None) -> DataFrame:
    """Src, dst, distance of all pairs; infinity where there is no path."""
    if paths.is_large(network, by):
        return paths.path_lengths(network, weighted, by)
    kind = node_kind(network)

    def run(nodes: list, m: np.ndarray) -> dict:
        n = len(nodes)
        return {"src": np.repeat(np.array(nodes, object), n), "dst": np.tile(np.array(nodes, object), n), "distance": distances(m, weighted).ravel()}

    return per_network(network, run, f"src {kind}, dst {kind}, distance double", by).filter("src <> dst")


def node_metrics(network: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Node, betweenness, eigenvector, local_efficiency."""
    if paths.is_large(network, by):
        return paths.node_metrics(network, by)
    return per_network(network, lambda nodes, m: {"node": nodes, "betweenness": betweenness(m), "eigenvector": eigenvector(m), "local_efficiency": local_efficiency(m)}, f"node {node_kind(network)}, betweenness double, eigenvector double, local_efficiency double", by)


def efficiency(network: DataFrame, weighted: bool = False, by: list[str] | None = None) -> DataFrame:
    """G12."""
    if paths.is_large(network, by):
        return paths.efficiency(network, weighted, by)
    return per_network(network, lambda nodes, m: {"global_efficiency": [global_efficiency(m, weighted)]}, "global_efficiency double", by)


def _by_size(network: DataFrame, by: list[str] | None, in_matrix: Callable, in_edges: Callable) -> DataFrame:
    """Networks of up to ``paths.NODES`` nodes by their matrices, larger ones by joins over edges."""
    keys = by or []
    if not paths.is_large(network, keys):
        return in_matrix(network)
    if not keys:
        return in_edges(network, None)
    large = stored(eigen.large_networks(network, keys, paths.NODES), "large")
    return in_edges(network, large).unionByName(in_matrix(meet(network, large, keys, "left_anti")))


def clusters(network: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Node, cluster."""

    def in_matrix(small: DataFrame) -> DataFrame:
        return per_network(small, lambda nodes, m: {"node": nodes, "cluster": spectral_clusters(m, k)}, f"node {node_kind(network)}, cluster int", by)

    return _by_size(network, by, in_matrix, lambda net, large: eigen.clusters(net, k, large, by or []))


def eigenvalues(network: DataFrame, by: list[str] | None = None, k: int | None = None, normalized: bool = True) -> DataFrame:
    """Place, eigenvalue of the Laplacian: all, or the k lowest.

    All eigenvalues need the matrix of a network in one task; give ``k`` for large ones.
    """

    def in_matrix(small: DataFrame) -> DataFrame:
        def run(nodes: list, m: np.ndarray) -> dict:
            values, _ = spectral_basis(m, k, normalized)
            return {"place": np.arange(1, values.size + 1), "eigenvalue": values}

        return per_network(small, run, "place int, eigenvalue double", by)

    if k is None:
        return in_matrix(network)
    return _by_size(network, by, in_matrix, lambda net, large: eigen.eigenvalues(net, k, large, by or [], normalized))


def small_world(network: DataFrame, n_random: int = 100, seed: int = 1) -> DataFrame:
    """Sigma, with clustering and path length of the network and of ``n_random`` rewired ones.

    The random networks are spread over tasks, each seeded by its number; the network's matrix goes along.
    """
    spark = network.sparkSession
    _, matrix = matrix_of(network.select("src", "dst", "weight").toPandas())

    def run(batches):
        for batch in batches:
            rows = [rewire(matrix, np.random.default_rng([seed, int(i)])) for i in batch["id"]]
            yield pd.DataFrame({"c": [mean_clustering(m) for m in rows], "l": [mean_path(m) for m in rows]})

    random = spark.range(n_random).mapInPandas(run, "c double, l double").agg(F.avg("c").alias("c_random"), F.avg("l").alias("l_random"))
    c, length = mean_clustering(matrix), mean_path(matrix)
    sigma = F.try_divide(F.try_divide(F.lit(c), F.col("c_random")), F.try_divide(F.lit(length), F.col("l_random")))
    return random.select(sigma.alias("sigma"), F.lit(c).alias("clustering"), F.lit(length).alias("path_length"), "c_random", "l_random")


def inverse_weight_distance(weight: Column) -> Column:
    """The browser code's length of an edge; only positive weights count."""
    return F.when(weight > 0, 1 / weight)
