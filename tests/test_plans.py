import pytest

from edgemeter.operators import curves, early, rollup, stability
from edgemeter.plans import benchmark
from edgemeter.plans.catalog import load


@pytest.fixture
def small(lists, truth):
    df = lists({("r1", "a"): [("a", "b", 1.0), ("b", "c", 0.5)], ("r2", "a"): [("c", "a", 1.0)]})
    return df, truth([("a", "b", "+"), ("b", "c", "-"), ("c", "a", "+")])


@pytest.mark.parametrize(
    "operator", [curves.auprc, curves.auroc, early.epr, early.signed_epr, stability.jaccard, stability.spearman]
)
def test_no_cartesian_products(small, operator):
    plan = operator(*small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small, tmp_path):
    from edgemeter.sources.edges import read_edge_table, write_ranked_edges

    write_ranked_edges(small[0], str(tmp_path / "t"))
    df = read_edge_table(spark, str(tmp_path / "t")).filter("dataset_id = 'd'")
    plan = curves.auprc(df, small[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan
    assert "ReadSchema: struct<gene1:string,gene2:string,weight:double>" in plan


def test_skewed_join_side_is_not_forced_to_broadcast(spark, small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = curves.auprc(*small)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_summary_orders_algorithms_and_fills_cells(spark):
    rows = [("d1", "x", "auprc_ratio", 1.0), ("d1", "y", "auprc_ratio", 3.0), ("d1", "z", "stability", 0.5)]
    df = spark.createDataFrame(rows, "dataset_id string, algorithm_id string, section string, value double")
    table = rollup.summary([df])
    order = {r.algorithm_id: r.place for r in table.collect()}
    assert order == {"y": 1, "x": 2, "z": 3}
    assert table.count() == 6
    cells = {(r.algorithm_id, r.section): r for r in rollup.heat_cells(table, 2.0).collect()}
    assert cells["y", "auprc_ratio"].label == "3.0" and cells["y", "auprc_ratio"].bucket == 10
    assert cells["x", "auprc_ratio"].below_cutoff and cells["x", "auprc_ratio"].bucket is None
    assert cells["z", "auprc_ratio"].missing


def test_median_ratio_skips_undefined_baselines(spark):
    values = spark.createDataFrame(
        [("d1", "r1", "a", 0.5), ("d1", "r2", "a", None), ("d2", "r1", "a", 0.5)],
        "dataset_id string, run_id string, algorithm_id string, value double",
    )
    base = spark.createDataFrame([("d1", 0.25), ("d2", None)], "dataset_id string, baseline double")
    assert [(r.dataset_id, r.value) for r in rollup.median_ratio(values, base).collect()] == [("d1", 2.0)]


def test_registered_extensions(small, matrix):
    import numpy as np

    got = benchmark.evaluate(*small, ["epr", "motif_ratios"])
    assert {r.metric for r in got.collect()} == {"epr", "fbl", "ffl", "mi"}
    ranked = benchmark.infer(matrix(np.arange(12.0).reshape(3, 4) ** 2), None, ["pearson"])
    assert sorted(r.ord for r in ranked.collect()) == list(range(6))


def test_catalog_is_complete():
    entries = load()
    assert len(entries) > 100
    without_sql = {name for name, e in entries.items() if e.sql is None}
    assert not without_sql


def test_no_copies_of_tables_as_large_as_their_partner(spark, small):
    """With many partitions and nothing broadcast, only few-row tables are repeated."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "240")
    try:
        plan = stability._rank_offsets(*small)[0]._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_new_run_shows_in_the_pivoted_table(spark):
    from edgemeter.functions.columns import longer
    from edgemeter.sources.metrics import pivot_metric

    rows = [("d", f"run_{c}", "a", "m", float(i)) for i, c in enumerate("ANRX")]
    df = spark.createDataFrame(rows, "dataset_id string, run_id string, algorithm_id string, metric string, value double")
    got = longer(pivot_metric(df), ["dataset_id", "Algorithm"], "run_id").collect()
    assert {(r.run_id, r.value) for r in got} == {(r[1], r[4]) for r in rows}
