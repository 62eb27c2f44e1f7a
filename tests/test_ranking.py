import numpy as np
import pytest
from pyspark.sql import functions as F

from edgemeter.functions import ranking
from edgemeter.functions.kernels import inversions, kendall, two_sided_t


@pytest.fixture
def small_ranges(monkeypatch):
    """Force the value ranges that large lists get."""
    monkeypatch.setattr(ranking, "RANGES", 64)
    monkeypatch.setattr(ranking, "STRIDE", 8)
    monkeypatch.setattr(ranking, "CHUNK_BITS", 4)


def test_cumulate_over_ranges(spark, small_ranges):
    rng = np.random.default_rng(1)
    rows = [("k", float(v)) for v in np.unique(rng.normal(size=3000).round(3))] + [("other", 1.0)]
    hist = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit(2).cast("long"))
    got = {(r.k, r.v): r.cum_n for r in ranking.cumulate(hist, ["k"], "v", ["n"]).collect()}
    for i, (k, v) in enumerate(sorted((r for r in rows if r[0] == "k"), key=lambda r: -r[1])):
        assert got[k, v] == 2 * (i + 1)
    assert got["other", 1.0] == 2
    assert len(got) == len(rows)


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank_with_heavy_ties(spark, small_ranges, descending):
    rng = np.random.default_rng(2)
    data = [("k", float(v), i) for i, v in enumerate(rng.integers(0, 5, 500))]
    df = spark.createDataFrame(data, "k string, v double, ord long")
    got = {r.ord: r["rank"] for r in ranking.global_rank(df, ["k"], "v", "ord", descending).collect()}
    sign = -1 if descending else 1
    expected = sorted(data, key=lambda r: (sign * r[1], r[2]))
    assert [got[r[2]] for r in expected] == list(range(1, 501))


def test_exact_percentiles(spark, small_ranges):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 40, 777).astype(float)
    df = spark.createDataFrame([("k", float(v)) for v in data], "k string, v double")
    probs = [0.0, 0.07, 0.5, 0.913, 1.0]
    got = {r.prob_ix: r.q for r in ranking.exact_percentiles(df, ["k"], "v", probs).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(list(np.percentile(data, [p * 100 for p in probs])))


def test_inversions_and_kendall():
    rng = np.random.default_rng(4)
    for n in (1, 2, 17, 60):
        x, y = rng.integers(0, 9, n), rng.integers(0, 9, n)
        assert inversions(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))
        s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
        dx = sum(x[i] != x[j] for i in range(n) for j in range(i))
        dy = sum(y[i] != y[j] for i in range(n) for j in range(i))
        assert kendall(x, y) == pytest.approx(s / np.sqrt(dx * dy) if dx * dy else 0.0)


def test_student_p_values():
    # Published two-sided critical points of Student's t.
    t = np.array([12.706, 2.228, 1.96, 0.0, 2.576])
    df = np.array([1.0, 10.0, 1e7, 5.0, 1e7])
    assert two_sided_t(t, df) == pytest.approx([0.05, 0.05, 0.05, 1.0, 0.01], abs=2e-4)
