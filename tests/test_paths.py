"""Paths by joins over edges equal those of the matrix."""

import numpy as np
import pandas as pd
import pytest

from signalweave.operators import network, paths


@pytest.fixture(scope="module")
def nets(spark):
    """A ring with chords of 300 nodes; a small one in two parts with a lone pair, without a name; a directed one with an edge of weight 0."""
    rng = np.random.default_rng(3)
    rows = [("ring", f"n{i:03}", f"n{(i + 1) % 300:03}", 1.0) for i in range(300)] + [("ring", f"n{a:03}", f"n{b:03}", float(w)) for a, b, w in zip(*rng.integers(0, 300, (2, 150)), rng.random(150) + 0.1, strict=True) if abs(a - b) not in (0, 1, 299)]
    rows = list({(n, min(a, b), max(a, b)): (n, a, b, w) for n, a, b, w in rows}.values())
    rows += [(None, "a", "b", 0.5), (None, "b", "c", 2.0), (None, "a", "d", 1.0), (None, "d", "c", 1.0), (None, "b", "d", 0.7), (None, "x", "y", -3.0)]
    both = rows + [(n, b, a, w) for n, a, b, w in rows]
    both += [("way", "p", "q", 1.0), ("way", "q", "r", 4.0), ("way", "r", "p", 1.0), ("way", "r", "s", 0.0)]
    return spark.createDataFrame(both, "net string, src string, dst string, weight double").cache()


def same(monkeypatch, make, on):
    whole = make().toPandas()
    monkeypatch.setattr(paths, "NODES", 2)
    got = make().toPandas()
    assert sorted(whole.columns) == sorted(got.columns)
    whole, got = (t.sort_values(on).reset_index(drop=True)[sorted(whole.columns)] for t in (whole, got))
    pd.testing.assert_frame_equal(whole, got, check_exact=False, atol=1e-4 if "eigenvector" in whole else 1e-9, rtol=0)
    return got


def test_hops_of_300_nodes(nets, monkeypatch):
    ring = nets.filter("net = 'ring'").drop("net")
    got = same(monkeypatch, lambda: network.path_lengths(ring), ["src", "dst"])
    assert len(got) == 300 * 299


def test_metrics_of_300_nodes(nets, monkeypatch):
    ring = nets.filter("net = 'ring'").drop("net")
    monkeypatch.setattr(network, "eigenvector", lambda m: network.np.zeros(len(m)))
    monkeypatch.setattr(paths, "eigenvector", lambda edges, nodes, by: nodes.withColumn("eigenvector", paths.F.lit(0.0)))
    same(monkeypatch, lambda: network.node_metrics(ring), ["node"])


@pytest.mark.parametrize("weighted", [False, True])
def test_networks_side_by_side(nets, monkeypatch, weighted):
    few = nets.filter("net IS NULL OR net = 'way'")
    got = same(monkeypatch, lambda: network.path_lengths(few, weighted, ["net"]), ["net", "src", "dst"])
    assert np.isinf(got["distance"]).any()


@pytest.mark.parametrize("weighted", [False, True])
def test_efficiency_side_by_side(nets, monkeypatch, weighted):
    same(monkeypatch, lambda: network.efficiency(nets.filter("net IS NULL OR net = 'way'"), weighted, ["net"]), ["net"])


def test_metrics_of_a_small_network(nets, monkeypatch):
    same(monkeypatch, lambda: network.node_metrics(nets.filter("net IS NULL AND src NOT IN ('x', 'y')").drop("net")), ["node"])
