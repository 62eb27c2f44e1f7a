import numpy as np
import pandas as pd
import pytest

from edgemeter.operators import association, matrix as m, networks, preprocess
from edgemeter.functions.blockinverse import block_inverse


def table(df, columns=("gene1", "gene2"), value="weight"):
    return {tuple(r[c] for c in columns): r[value] for r in df.collect()}


def sparse(seed, shape=(7, 40), zeros=0.5):
    rng = np.random.default_rng(seed)
    values = rng.gamma(2.0, 1.0, shape).round(2)
    return values * (rng.random(shape) > zeros)


@pytest.mark.parametrize("spread", [1.0, 1000.0, 0.01])
def test_quantile_bins_match_pandas(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    t = (rng.random(61) * spread).round(4)
    t[:9] = t[9]
    pt = spark.createDataFrame(
        [("d", "r1", f"c{i}", 0, float(v)) for i, v in enumerate(t)],
        "dataset_id string, run_id string, cell string, trajectory int, t double",
    )
    got = table(m.quantile_bins(pt, 8), ("cell",), "bin_time")
    cut = pd.qcut(pd.Series(t), q=8, duplicates="drop")
    for i, interval in enumerate(cut):
        assert got[(f"c{i}",)] == pytest.approx((interval.left + interval.right) / 2, abs=1e-9)


def test_correlation_with_absent_and_constant_genes(matrix):
    values = sparse(1)
    values[3] = 2.0
    values[4] = 0.0
    values[5, 0] = 1.0
    df = matrix(values, keep_zeros=True)
    got = table(association.assoc(df, "correlation"))
    with np.errstate(invalid="ignore"):
        expected = np.corrcoef(values)
    for i in range(7):
        for j in range(i + 1, 7):
            r = got[f"g{i:02d}", f"g{j:02d}"]
            if np.isnan(expected[i, j]):
                assert r is None
            else:
                assert r == pytest.approx(expected[i, j], abs=1e-10)
    network = association.pearson_network(df)
    assert network.count() == 5 * 4
    assert network.filter("gene1 = 'g03' or gene2 = 'g04'").isEmpty()


def test_blocks_and_chunks_do_not_change_products(matrix, monkeypatch):
    from edgemeter.functions import gram

    values = sparse(2, (11, 60), 0.9)
    monkeypatch.setattr(gram, "ITEMS", 3)
    monkeypatch.setattr(gram, "FEATURES", 7)
    got = table(association.assoc(matrix(values, keep_zeros=True), "dotprod", diagonal=True))
    expected = values @ values.T
    assert len(got) == 66
    for (a, b), w in got.items():
        assert w == pytest.approx(expected[int(a[1:]), int(b[1:])])


def test_proportionality_rejects_negative_numbers(matrix):
    values = sparse(3)
    values[0, 0] = -1
    with pytest.raises(Exception, match="non-negative"):
        association.assoc(matrix(values), "proprho").collect()


def test_zero_inflated_blocks_agree(matrix, monkeypatch):
    df = matrix(sparse(4))
    whole = table(association.assoc(df, "zikendall"))
    monkeypatch.setattr(association, "SERIES_ITEMS", 2)
    assert table(association.assoc(df, "zikendall")) == pytest.approx(whole)


def test_block_inverse(spark):
    rng = np.random.default_rng(5)
    rows, sizes, dense = [], [], {}
    for name, n in (("x", 23), ("y", 6)):
        a = rng.normal(size=(n, n))
        dense[name] = a @ a.T + np.eye(n)
        rows += [(name, i, j, float(dense[name][i, j])) for i in range(n) for j in range(n)]
        sizes.append((name, n))
    entries = spark.createDataFrame(rows, "k string, i long, j long, v double")
    out = block_inverse(entries, spark.createDataFrame(sizes, "k string, n long"), ["k"], 7)
    for r in out.collect():
        assert r.v == pytest.approx(np.linalg.inv(dense[r.k])[r.i, r.j], abs=1e-8)


def test_partial_spearman(matrix):
    import brute

    values = sparse(6, (6, 50), 0.3)
    rows = networks.partial_spearman(matrix(values), block=4).collect()
    ranks = np.array([brute.mid_ranks(v) for v in values])
    inverse = np.linalg.inv(np.corrcoef(ranks))
    expected = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    assert len(rows) == 36
    for r in rows:
        i, j = int(r.gene1[1:]), int(r.gene2[1:])
        assert r.weight == pytest.approx(1.0 if i == j else expected[i, j], abs=1e-9)
        assert (r.p_value == 0.0) if i == j else (0 <= r.p_value <= 1)
    with pytest.raises(ValueError, match="more cells than genes"):
        networks.partial_spearman(matrix(values[:, :5]))


def test_lagged_network_finds_the_delay(matrix, spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    values = np.vstack([x, np.concatenate([rng.normal(size=4), x[:-4]]), rng.normal(size=60)])
    pt = spark.createDataFrame(
        [("d", "r1", f"c{j:03d}", 0, float(j)) for j in range(60)],
        "dataset_id string, run_id string, cell string, trajectory int, t double",
    )
    rows = {(r.gene1, r.gene2): r for r in networks.lagged_network(matrix(values), pt, 0.3).collect()}
    assert rows["g00", "g01"].lag == 4
    assert rows["g00", "g01"].weight == pytest.approx(1.0)
    assert rows["g01", "g00"].weight < 0.9 and len(rows) == 6


def test_pca_matches_svd_in_every_matrix(matrix):
    far = np.random.default_rng(3).normal(100.0, 1.0, (6, 30))
    both = {"r1": sparse(8, (6, 30), 0.2), "r2": far}
    frame = matrix(both["r1"], run="r1").unionByName(matrix(far, run="r2"))
    rows = {(r.run_id, r.cell): (r.pc1, r.pc2, r.pc3) for r in preprocess.pca(frame, 3).collect()}
    for run, values in both.items():
        centred = (values - values.mean(axis=1, keepdims=True)).T
        u, s, vt = np.linalg.svd(centred, full_matrices=False)
        for k in range(3):
            sign = 1.0 if vt[k][np.abs(vt[k]).argmax()] > 0 else -1.0
            for j in range(30):
                assert rows[run, f"c{j:03d}"][k] == pytest.approx(sign * u[j, k] * s[k], abs=1e-6)


def test_pca_over_many_tiles_needs_no_gene_by_gene_table(matrix, monkeypatch):
    from edgemeter.functions import gram

    monkeypatch.setattr(gram, "ITEMS", 32)
    monkeypatch.setattr(gram, "FEATURES", 32)
    rng = np.random.default_rng(11)
    # Slowly falling spectrum, more genes than the basis may have columns.
    values = rng.normal(size=(150, 150)) @ np.diag(0.97 ** np.arange(150)) @ rng.normal(size=(150, 90))
    values[rng.random(values.shape) < 0.3] = 0
    got = {r.cell: (r.pc1, r.pc2) for r in preprocess.pca(
        matrix(values, genes=[f"g{i:03d}" for i in range(150)]), 2).collect()}
    centred = (values - values.mean(axis=1, keepdims=True)).T
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    for k in range(2):
        sign = np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert [got[f"c{j:03d}"][k] for j in range(90)] == pytest.approx(sign * u[:, k] * s[k], abs=1e-6)


def test_pca_of_constant_and_narrow_matrices(matrix):
    flat = matrix(np.full((4, 5), 2.0), run="r1")
    pair = matrix(np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]), run="r2")
    rows = {(r.run_id, r.cell): (r.pc1, r.pc2, r.pc3) for r in preprocess.pca(flat.unionByName(pair), 3).collect()}
    assert all(rows["r1", f"c{j:03d}"] == pytest.approx((0, 0, 0)) for j in range(5))
    for j, at in enumerate((-1, 0, 1)):
        assert rows["r2", f"c{j:03d}"] == pytest.approx((at * 5**0.5, 0, 0), abs=1e-9)
    assert preprocess.pca(flat.limit(0), 2).count() == 0


def test_correlation_with_large_means(matrix):
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    values = np.vstack([x, 0.8 * x + 0.5 * rng.normal(size=200), rng.normal(size=200)])
    expected = np.corrcoef(values)
    for shift in (1e7, 1e8):
        got = table(association.correlation(matrix(values + shift)))
        for (a, b), r in got.items():
            assert r == pytest.approx(expected[int(a[1:]), int(b[1:])], abs=1e-5)


@pytest.mark.parametrize("change", ["constant", "zero", "copy", "sum"])
def test_partial_spearman_refuses_degenerate_genes(matrix, change):
    values = np.random.default_rng(6).permuted(np.tile(np.arange(1.0, 51), (5, 1)), axis=1)
    values[4] = {"constant": np.full(50, 3.0), "zero": np.zeros(50), "copy": values[1],
                 "sum": np.exp(values[2] / 10)}[change]
    with pytest.raises(Exception, match="constant|singular"):
        networks.partial_spearman(matrix(values, keep_zeros=True), block=2).collect()


def test_dropout_quantile_counts_absent_cells(matrix):
    values = np.zeros((1, 20))
    values[0, :2] = [1.0, 2.0]
    cells = np.vstack([values, np.ones((1, 20))])
    out = {(r.gene, r.cell): r.value for r in preprocess.dropout(matrix(cells), 20, 0.5, 1.0).collect()}
    assert out["g00", "c000"] == 1.0 and out["g00", "c001"] == 2.0


def test_size_factors_skip_genes_with_zeros(matrix):
    values = np.array([[1.0, 2, 4], [10, 20, 40], [0, 5, 5]])
    got = table(preprocess.size_factors(matrix(values)), ("cell",), "size_factor")
    assert [got[(f"c{j:03d}",)] for j in range(3)] == pytest.approx([0.5, 1.0, 2.0])


def test_select_genes_limits(spark):
    ordering = spark.createDataFrame(
        [("d", f"g{i}", i / 100, float(i)) for i in range(6)],
        "dataset_id string, gene string, pvalue double, variance double",
    )
    tfs = spark.createDataFrame([("d", "g0"), ("d", "absent")], "dataset_id string, gene string")
    names = lambda df: {r.gene for r in df.collect()}
    assert names(m.select_genes(ordering, tfs, 2)) == {"g0", "g5", "g4"}
    assert names(m.select_genes(ordering, tfs, 0)) == {"g0"}
    assert names(m.select_genes(ordering, None, 99)) == {f"g{i}" for i in range(6)}
    assert names(m.select_genes(ordering, None, 2, "pvalue")) == {"g0", "g1"}
    assert m.filter_pvalue(ordering, 0).count() == 6
    assert names(m.filter_pvalue(ordering, 0.12)) == {"g0", "g1"}  # 0.12 / 6, strict


def test_sample_cells_fails_when_short(matrix):
    with pytest.raises(ValueError, match="fewer"):
        preprocess.sample_cells(matrix(sparse(9)), 1000)


def test_surrogates_keep_each_cells_values(matrix):
    values = sparse(10)
    rows = association.surrogates(matrix(values), 2, seed=1).collect()
    for rep in (0, 1):
        for j in range(40):
            got = sorted(r.value for r in rows if r.replicate == rep and r.cell == f"c{j:03d}")
            assert got == sorted(v for v in values[:, j] if v)
    again = association.surrogates(matrix(values).repartition(5), 2, seed=1).collect()
    assert set(map(tuple, rows)) == set(map(tuple, again))


def test_merge_keeps_equal_rows(spark):
    rows = [("d", "r", "a", "b", 0.5), ("d", "r", "a", "b", 0.5), ("d", "r", "a", "b", -0.9)]
    df = spark.createDataFrame(rows, "dataset_id string, run_id string, gene1 string, gene2 string, weight double")
    assert [r.weight for r in networks.merge_trajectories(df).collect()] == [0.5, 0.5]
    assert [r.weight for r in networks.merge_trajectories(df, absolute=True).collect()] == [0.9]
    assert networks.merge_trajectories(df, one_row=True).count() == 1
