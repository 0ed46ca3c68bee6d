"""Spectra by joins over edges equal those of the matrix."""

import numpy as np
import pandas as pd
import pytest

from signalweave.operators import eigen, network, paths


@pytest.fixture(scope="module")
def nets(spark):
    """Three groups of 100 nodes, dense inside and thin between; two parts and a node without an edge; a star with a third of its edges on a hub, signed."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        for j in range(i):
            if rng.random() < (0.12 if i // 100 == j // 100 else 0.002):
                rows.append(("groups", f"n{i:03}", f"n{j:03}", float(rng.random() + 0.2)))
    rows += [(None, f"{part}{i}", f"{part}{j}", 1.0 + i + j) for part in "ab" for i in range(6) for j in range(i)] + [(None, "lone", "a0", 0.0)]
    rows += [("star", "hub", f"s{i:02}", 1.0 if i % 4 else -0.5) for i in range(40)] + [("star", f"s{i:02}", f"s{(i + 1) % 40:02}", 0.3) for i in range(40)]
    both = rows + [(n, b, a, w) for n, a, b, w in rows]
    return spark.createDataFrame(both, "net string, src string, dst string, weight double").cache()


def rows_of(df, order):
    return df.toPandas().sort_values(order, na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("normalized", [True, False])
def test_lowest_eigenvalues_of_300_nodes(nets, monkeypatch, normalized):
    one = nets.filter("net = 'groups'").drop("net")
    want = rows_of(network.eigenvalues(one, k=5, normalized=normalized), ["place"])
    monkeypatch.setattr(paths, "NODES", 2)
    monkeypatch.setattr(network, "spectral_basis", None)  # no matrix on this way
    got = rows_of(network.eigenvalues(one, k=5, normalized=normalized), ["place"])
    pd.testing.assert_frame_equal(want, got, check_exact=False, atol=1e-6 * (1 if normalized else 50), rtol=0)


def test_networks_side_by_side_with_parts_and_hubs(nets, monkeypatch):
    """Two parts and a lone node have three zeros; repeated edges change nothing."""
    few = nets.filter("net IS NULL OR net = 'star'")
    want = rows_of(network.eigenvalues(few, ["net"], 4), ["net", "place"])
    assert np.allclose(want["eigenvalue"][:3], 0) and want["net"][:3].isna().all()
    monkeypatch.setattr(paths, "NODES", 2)
    got = rows_of(network.eigenvalues(few.unionByName(few), ["net"], 4), ["net", "place"])
    pd.testing.assert_frame_equal(want, got, check_exact=False, atol=1e-6, rtol=0)


def test_small_networks_beside_large_ones_keep_their_matrix(nets, monkeypatch):
    want = rows_of(network.eigenvalues(nets, ["net"], 3), ["net", "place"])
    monkeypatch.setattr(paths, "NODES", 100)  # the groups alone are large
    got = rows_of(network.eigenvalues(nets, ["net"], 3), ["net", "place"])
    pd.testing.assert_frame_equal(want, got, check_exact=False, atol=1e-6, rtol=0)


def test_more_vectors_than_nodes(spark):
    pair = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], "src string, dst string, weight double")
    got = eigen.eigenvalues(pair, 5, None, []).toPandas()
    assert np.allclose(got["eigenvalue"], [0, 2], atol=1e-9) and got["place"].tolist() == [1, 2]


def test_vectors_are_eigenvectors(nets):
    """L x = value x for every vector, with lengths of one."""
    rows = nets.filter("net = 'groups'").toPandas()
    nodes, m = network.matrix_of(rows)
    edges = nets.filter("net = 'groups'").selectExpr("0 AS _net", "src", "dst", "weight")
    values, table = eigen.lowest(edges, 4, True, 200, 1e-6)
    x = np.array(table.toPandas().set_index("node").loc[nodes, "x"].tolist())
    root = 1 / np.sqrt(m.sum(axis=1))
    lap = np.eye(len(m)) - m * root[:, None] * root[None, :]
    assert np.abs(lap @ x - x * values[0]).max() < 1e-6
    assert np.allclose(x.T @ x, np.eye(4), atol=1e-9)


def test_clusters_of_large_networks(nets, monkeypatch):
    """The three planted groups, alike with and without the matrix."""
    want = rows_of(network.clusters(nets.filter("net = 'groups'"), 3, ["net"]), ["node"])
    monkeypatch.setattr(paths, "NODES", 2)
    got = rows_of(network.clusters(nets.filter("net = 'groups'"), 3, ["net"]), ["node"])
    pairs = set(zip(want["cluster"], got["cluster"], strict=True))
    assert len(pairs) == 3
    assert got.groupby(got["node"].str[1])["cluster"].nunique().tolist() == [1, 1, 1] and got["cluster"].nunique() == 3
