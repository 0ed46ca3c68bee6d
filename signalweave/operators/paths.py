"""Paths of large networks by joins over edges, level by level (rows G6-G8, G12, G13).

No matrix is made: searches from all nodes go on together, a level is one join of the frontier with the edges and one
aggregation, and its rows are written before the next. A weight of 0 is no edge, loops are left out, and repeated
edges count once, with the largest absolute weight. All functions take a network (src, dst, weight) and the columns ``by`` that tell networks apart (null is one).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import stored
from .blocks import meet

#: Nodes of a network up to which its matrix is worked on in one task.
NODES = 512


def nodes_of(network: DataFrame, by: list[str]) -> DataFrame:
    """by, node."""
    return network.select(*by, F.col("src").alias("node")).unionByName(network.select(*by, F.col("dst").alias("node"))).distinct()


def is_large(network: DataFrame, by: list[str] | None) -> bool:
    """Whether the largest network has more than ``NODES`` nodes."""
    return nodes_of(network, by or []).groupBy(*(by or [])).count().filter(F.col("count") > NODES).limit(1).count() > 0


def prepared(network: DataFrame, by: list[str] | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Edges (by, src, dst, weight), nodes (by, node), both stored, and the keys; a stand-in where there are none."""
    if not by:
        network, by = network.withColumn("_net", F.lit(0)), ["_net"]
    real = network.filter((F.col("weight") != 0) & (F.col("src") != F.col("dst")))
    edges = real.groupBy(*by, "src", "dst").agg(F.max(F.abs("weight")).alias("weight"))
    return stored(edges, "edges"), stored(nodes_of(network, by), "nodes"), by


def levels(edges: DataFrame, nodes: DataFrame, by: list[str]) -> list[DataFrame]:
    """Tables (by, source, node, ways) of the nodes at distance 0, 1, 2, ... of each source, and the number of shortest paths to them."""
    at = [*by, "source", "node"]
    hop = edges.select(*by, F.col("src").alias("node"), F.col("dst").alias("_to"))
    found = [stored(nodes.select(*by, F.col("node").alias("source"), "node", F.lit(1.0).alias("ways")), "level")]
    while True:
        ahead = meet(found[-1], hop, [*by, "node"]).groupBy(*by, "source", "_to").agg(F.sum("ways").alias("ways")).withColumnRenamed("_to", "node")
        seen = reduce(DataFrame.unionByName, found).select(*at)
        ahead = stored(meet(ahead, seen, at, "left_anti").select(*at, "ways"), "level")
        if ahead.isEmpty():
            return found
        found.append(ahead)


def lengths(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, source, node, distance of all reached pairs; an edge is largest weight / weight long. Only pairs that became shorter go on."""
    at = [*by, "source", "node"]
    largest = edges.groupBy(*by).agg(F.max("weight").alias("_largest"))
    hop = meet(edges, largest, by).select(*by, F.col("src").alias("node"), F.col("dst").alias("_to"), (F.col("_largest") / F.col("weight")).alias("_long"))
    hop = stored(hop, "lengths")
    known = frontier = stored(nodes.select(*by, F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")), "distances")
    while True:
        ahead = meet(frontier, hop, [*by, "node"]).groupBy(*by, "source", "_to").agg(F.min(F.col("distance") + F.col("_long")).alias("_new")).withColumnRenamed("_to", "node")
        better = meet(ahead, known, at, "left").filter(F.col("distance").isNull() | (F.col("_new") < F.col("distance")))
        frontier = stored(better.select(*at, F.col("_new").alias("distance")), "shorter")
        if frontier.isEmpty():
            return known
        known = stored(known.unionByName(frontier).groupBy(*at).agg(F.min("distance").alias("distance")), "distances")


def path_lengths(network: DataFrame, weighted: bool = False, by: list[str] | None = None) -> DataFrame:
    """By, src, dst, distance of all pairs; infinity where there is no path."""
    edges, nodes, keys = prepared(network, by)
    if weighted:
        found = lengths(edges, nodes, keys)
    else:
        found = reduce(DataFrame.unionByName, [t.select(*keys, "source", "node", F.lit(float(d)).alias("distance")) for d, t in enumerate(levels(edges, nodes, keys))])
    every = nodes.groupBy(*keys).agg(F.collect_list("node").alias("_all"))
    pairs = meet(nodes.withColumnRenamed("node", "source"), every, keys).select(*keys, "source", F.explode("_all").alias("node")).filter("source <> node")
    distance = F.coalesce("distance", F.lit(float("inf")))
    return meet(pairs, found, [*keys, "source", "node"], "left").select(*(by or []), F.col("source").alias("src"), F.col("node").alias("dst"), distance.alias("distance"))


def _closeness(reached: list[DataFrame], by: list[str], nodes: DataFrame) -> DataFrame:
    """by, value: mean of 1 / distance over all pairs of each network; 0 for fewer than two nodes."""
    near = reduce(DataFrame.unionByName, [t.groupBy(*by).agg((F.count("*") / F.lit(float(d))).alias("near")) for d, t in enumerate(reached) if d], nodes.select(*by, F.lit(0.0).alias("near")).distinct())
    size = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    value = F.coalesce(F.try_divide(F.col("near"), (F.col("n") * (F.col("n") - 1)).cast("double")), F.lit(0.0))
    return meet(near.groupBy(*by).agg(F.sum("near").alias("near")), size, by).select(*by, value.alias("value"))


def efficiency(network: DataFrame, weighted: bool = False, by: list[str] | None = None) -> DataFrame:
    """By, global_efficiency."""
    edges, nodes, keys = prepared(network, by)
    if not weighted:
        return _closeness(levels(edges, nodes, keys), keys, nodes).select(*(by or []), F.col("value").alias("global_efficiency"))
    near = lengths(edges, nodes, keys).filter("source <> node").groupBy(*keys).agg(F.sum(1 / F.col("distance")).alias("near"))
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    value = F.coalesce(F.try_divide(F.col("near"), (F.col("n") * (F.col("n") - 1)).cast("double")), F.lit(0.0))
    return meet(size, near, keys, "left").select(*(by or []), value.alias("global_efficiency"))


def betweenness(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """By, node, betweenness: the levels once more from behind, each giving its paths' shares to the one before."""
    at = [*by, "source", "node"]
    tables, totals, flow = levels(edges, nodes, by), [], None
    back = edges.select(*by, F.col("src").alias("_before"), F.col("dst").alias("node"))
    for depth in range(len(tables) - 1, 0, -1):
        now = tables[depth].withColumn("flow", F.lit(0.0)) if flow is None else meet(tables[depth], flow, at, "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
        now = stored(now, "flow")
        totals.append(now.groupBy(*by, "node").agg(F.sum("flow").alias("flow")))
        gives = meet(now, back, [*by, "node"]).select(*by, "source", F.col("_before").alias("node"), ((1 + F.col("flow")) / F.col("ways")).alias("part"))
        flow = meet(gives.groupBy(*at).agg(F.sum("part").alias("part")), tables[depth - 1], at).select(*at, (F.col("ways") * F.col("part")).alias("flow"))
    total = reduce(DataFrame.unionByName, totals, nodes.withColumn("flow", F.lit(0.0))).groupBy(*by, "node").agg(F.sum("flow").alias("flow"))
    size = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    share = F.when(F.col("n") > 2, F.col("flow") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(F.col("flow"))
    return meet(total, size, by).select(*by, "node", share.alias("betweenness"))


def eigenvector(edges: DataFrame, nodes: DataFrame, by: list[str], rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """By, node, eigenvector by power iteration; a round is a join of the edges with the vector. Ends when no entry of any network moves by ``tolerance``."""
    size = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    now = stored(meet(nodes, size, by).select(*by, "node", (1 / F.sqrt("n")).alias("x")), "vector")
    for _ in range(rounds):
        gives = meet(edges.withColumnRenamed("dst", "node"), now, [*by, "node"]).select(*by, F.col("src").alias("node"), (F.col("weight") * F.col("x")).alias("y"))
        shifted = now.select(*by, "node", (1e-3 * F.col("x")).alias("y"))  # the shift lets bipartite networks settle
        new = stored(gives.unionByName(shifted).groupBy(*by, "node").agg(F.sum("y").alias("y")), "product")
        norm = new.groupBy(*by).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        new = stored(meet(new, norm, by).select(*by, "node", F.coalesce(F.try_divide("y", "norm"), "y").alias("y")), "vector")
        moved = meet(now, new, [*by, "node"]).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
        now = new.withColumnRenamed("y", "x")
        if moved is None or moved < tolerance:
            break
    return now.select(*by, "node", F.col("x").alias("eigenvector"))


def local_efficiency(edges: DataFrame, by: list[str]) -> DataFrame:
    """By, node, local_efficiency: the efficiency of each node's neighbours among themselves; all these networks are searched together."""
    near = edges.select(*by, F.col("src").alias("_ego"), F.col("dst").alias("node"))
    keys = [*by, "_ego"]
    inside = meet(near.withColumnRenamed("node", "src"), edges.select(*by, "src", "dst"), [*by, "src"])
    inside = stored(meet(inside, near.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi").select(*keys, "src", "dst"), "neighbours")
    return _closeness(levels(inside, near, keys), keys, near).select(*by, F.col("_ego").alias("node"), F.col("value").alias("local_efficiency"))


def node_metrics(network: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, node, betweenness, eigenvector, local_efficiency."""
    edges, nodes, keys = prepared(network, by)
    at = [*keys, "node"]
    out = meet(betweenness(edges, nodes, keys), eigenvector(edges, nodes, keys), at)
    out = meet(out, local_efficiency(edges, keys), at, "left")
    return out.select(*(by or []), "node", "betweenness", "eigenvector", F.coalesce("local_efficiency", F.lit(0.0)).alias("local_efficiency"))
