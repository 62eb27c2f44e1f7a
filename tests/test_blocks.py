"""Block products, tree networks and lagged correlation at several block sizes."""

import numpy as np
import pytest

from edgemeter.functions import gram
from edgemeter.operators import association, networks, trees


def sparse(rng, genes, cells):
    return np.where(rng.random((genes, cells)) < 0.6, rng.normal(size=(genes, cells)).round(3), 0.0)


@pytest.mark.parametrize("items, features, lane", [(128, 4096, 64), (4, 7, 2), (3, 1, 1)])
def test_pair_products_over_blocks_chunks_and_lanes(spark, matrix, monkeypatch, items, features, lane):
    monkeypatch.setattr(gram, "ITEMS", items)
    monkeypatch.setattr(gram, "FEATURES", features)
    monkeypatch.setattr(gram, "LANE_CHUNKS", lane)
    x = sparse(np.random.default_rng(2), 11, 40)
    rows = matrix(x).unionByName(matrix(2 * x[:5], dataset="other"))
    got = gram.pair_products(rows, ["dataset_id", "run_id"], "gene", "cell", "value", True).collect()
    assert len(got) == 11 * 12 // 2 + 5 * 6 // 2
    for r in got:
        scale = 4 if r["dataset_id"] == "other" else 1
        i, j = int(r["item_a"][1:]), int(r["item_b"][1:])
        assert r["item_a"] <= r["item_b"] and r["dot"] == pytest.approx(scale * x[i] @ x[j], abs=1e-9)


def test_pair_products_of_an_empty_table(spark, matrix):
    empty = matrix(np.ones((2, 2))).limit(0)
    assert gram.pair_products(empty, ["dataset_id", "run_id"], "gene", "cell", "value").collect() == []


@pytest.mark.parametrize("method", ["rf", "gbt"])
def test_tree_network_finds_the_regulator_and_ignores_partitions(spark, matrix, monkeypatch, method):
    rng = np.random.default_rng(3)
    x = rng.random((6, 300)) + 0.1
    x[5] = (x[1] > 0.6) * 2.0 + 0.01 * rng.random(300)
    rows = matrix(x).unionByName(matrix(x[:, :200], dataset="other"))
    run = lambda df: {
        (r["dataset_id"], r["gene1"], r["gene2"]): r["weight"] for r in trees.tree_network(
            df, method, n_trees=4, depth=2, candidates=1.0).collect()}
    whole = run(rows)
    for dataset in ("d", "other"):
        into = {g1: w for (d, g1, g2), w in whole.items() if d == dataset and g2 == "g05"}
        assert max(into, key=into.get) == "g01" and into["g01"] > (0.9 if method == "rf" else 0.8)
    assert all(w > 0 and g1 != g2 for (_, g1, g2), w in whole.items())
    monkeypatch.setattr(trees, "CHUNK_VALUES", 200)
    monkeypatch.setattr(trees, "BLOCK_TARGETS", 2)
    split = run(rows.repartition(7))
    assert split.keys() == whole.keys() and all(split[k] == pytest.approx(whole[k]) for k in whole)
    only = trees.tree_network(rows, method, targets=["g05"], n_trees=4, depth=2, candidates=1.0).collect()
    assert {(r["dataset_id"], r["gene1"], r["gene2"]) for r in only} == {k for k in whole if k[2] == "g05"}


def test_tree_network_without_anything_to_explain(spark, matrix):
    flat = matrix(np.ones((3, 20)))
    assert trees.tree_network(flat, n_trees=2, depth=2).collect() == []
    assert trees.tree_network(flat.limit(0), n_trees=2, depth=2).collect() == []
    with pytest.raises(ValueError, match="unknown method"):
        trees.tree_network(flat, "svm")


def test_pearson_with_small_blocks_matches_numpy(spark, matrix, monkeypatch):
    monkeypatch.setattr(gram, "ITEMS", 2)
    monkeypatch.setattr(gram, "FEATURES", 5)
    x = np.abs(sparse(np.random.default_rng(6), 7, 30)) + 0.01
    got = {(r["gene1"], r["gene2"]): r["weight"] for r in association.pearson_network(matrix(x)).collect()}
    want = np.corrcoef(x)
    assert len(got) == 42
    for (a, b), w in got.items():
        assert w == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1e-9)


def brute_lagged(x, max_lag):
    """Largest correlation over lags by one np.corrcoef each."""
    window, out = x.shape[1] - max_lag, {}
    for i in range(len(x)):
        for j in range(len(x)):
            best = None
            for lag in range(max_lag + 1):
                a, b = x[i, :window], x[j, lag : lag + window]
                if i == j or (a == a[0]).all() or (b == b[0]).all():
                    continue
                r = np.corrcoef(a, b)[0, 1]
                if best is None or round(abs(r), 9) > round(abs(best[0]), 9):
                    best = (r, lag)
            if best:
                out[i, j] = best
    return out


@pytest.mark.parametrize("items, chunk", [(16, 4096), (2, 8), (3, 16)])
def test_lagged_network_over_chunks_and_segments(spark, matrix, monkeypatch, items, chunk):
    monkeypatch.setattr(networks, "LAG_ITEMS", items)
    monkeypatch.setattr(networks, "LAG_CHUNK", chunk)
    rng = np.random.default_rng(9)
    x = np.where(rng.random((7, 61)) < 0.5, rng.normal(size=(7, 61)) + 100, 0)
    x[1, 4:] = x[0, :-4]  # follows gene 0 by four cells
    x[3] = 5  # constant
    x[4] = np.arange(61) == 60  # constant in the leading window
    x[5, :30] = 0
    pt = spark.createDataFrame(
        [("d", "r1", f"c{i:03d}", 0, float(i)) for i in range(61)],
        "dataset_id string, run_id string, cell string, trajectory int, t double")
    got = {(int(r["gene1"][1:]), int(r["gene2"][1:])): r for r in networks.lagged_network(matrix(x), pt, 0.4).collect()}
    want = brute_lagged(x, 24)
    assert got.keys() == want.keys() and got[0, 1]["lag"] == 4
    for pair, (r, lag) in want.items():
        assert got[pair]["weight"] == pytest.approx(r, abs=1e-8) and got[pair]["lag"] == lag
    assert networks.lagged_network(matrix(x).limit(0), pt, 0.4).collect() == []
