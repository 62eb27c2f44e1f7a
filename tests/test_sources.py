import pytest

from edgemeter.sources import config, edges, expression, metrics, timing


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_ranked_edges_keep_file_order(spark, tmp_path):
    body = "Gene1\tGene2\tEdgeWeight\n" + "".join(f"a{i}\tb\t{(i * 7) % 5}\n" for i in range(50))
    write(tmp_path / "d 1+x" / "r1" / "alg" / "rankedEdges.csv", body + "z\tz\t\nq\tq\tNaN\n")
    df = edges.read_ranked_edges(spark, str(tmp_path))
    rows = df.orderBy("ord").collect()
    assert [r.gene1 for r in rows] == [f"a{i}" for i in range(50)]
    assert rows[0].dataset_id == "d 1+x" and rows[0].algorithm_id == "alg"
    raw = edges.read_ranked_edges(spark, str(tmp_path), keep_invalid=True)
    assert edges.invalid_weights(raw).collect()[0].n_invalid == 2


def test_ranked_edges_order_over_several_splits(spark, tmp_path):
    body = "Gene1\tGene2\tEdgeWeight\n" + "".join(f"a{i}\tb\t1.0\n" for i in range(4000))
    write(tmp_path / "d" / "r" / "alg" / "rankedEdges.csv", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = edges.read_ranked_edges(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.gene1 for r in rows] == [f"a{i}" for i in range(4000)]
    assert len({r.ord for r in rows}) == 4000


def test_ground_truth_with_and_without_type(spark, tmp_path):
    write(tmp_path / "signed" / "GroundTruthNetwork.csv", "Gene1,Gene2,Type\na,b,+\nb,a,?\n")
    write(tmp_path / "plain" / "GroundTruthNetwork.csv", "Gene1,Gene2\nx,y\n")
    assert edges.read_ground_truth(spark, str(tmp_path)).count() == 3
    signed = edges.read_ground_truth(spark, str(tmp_path), signed=True).collect()
    assert [(r.dataset_id, r.gene1) for r in signed] == [("signed", "a")]


@pytest.mark.parametrize("header", ["gene,c.1,c2", '"","c.1","c2"', "c.1,c2"])
def test_expression_headers(spark, tmp_path, header):
    write(tmp_path / "d" / "r" / "ExpressionData.csv", f"{header}\ng1,1.5,0\n\"g2\",NA,3\n")
    rows = {(r.gene, r.cell): r.value for r in expression.read_expression(spark, str(tmp_path)).collect()}
    assert rows == {("g1", "c.1"): 1.5, ("g1", "c2"): 0.0, ("g2", "c2"): 3.0}


def test_pseudotime_drops_cells_off_a_trajectory(spark, tmp_path):
    write(tmp_path / "d" / "r" / "PseudoTime.csv", ",P1,P2\n1,0.5,\n2,NA,0.25\n")
    rows = {(r.cell, r.trajectory, r.t) for r in expression.read_pseudotime(spark, str(tmp_path)).collect()}
    assert rows == {("1", 0, 0.5), ("2", 1, 0.25)}


def test_orderings_by_position(spark, tmp_path):
    write(tmp_path / "o.csv", ",VGAMpValue\ng1,0.5\n")
    assert expression.read_gene_ordering(spark, str(tmp_path / "o.csv"), "d").collect()[0].variance is None
    write(tmp_path / "tf.csv", "TF,other\ng1,x\n")
    assert expression.read_regulators(spark, str(tmp_path / "tf.csv"), "d").collect()[0].gene == "g1"


def test_metric_round_trip_drops_undefined(spark, tmp_path):
    rows = [("d", "r1", "a", "m", 0.5), ("d", "r2", "a", "m", None)]
    df = spark.createDataFrame(rows, "dataset_id string, run_id string, algorithm_id string, metric string, value double")
    metrics.write_metric(metrics.pivot_metric(df, "m"), str(tmp_path / "out"))
    back = metrics.load_metric(spark, str(tmp_path / "out" / "*" / "part-*")).collect()
    assert [(r.dataset_id, r.run_id, r.value) for r in back] == [("d", "r1", 0.5)]


def test_timing_logs(spark, tmp_path):
    write(tmp_path / "d" / "r" / "alg" / "working_dir" / "time0.txt", "\tUser time (seconds): 1\n")
    write(tmp_path / "d" / "r" / "alg" / "working_dir" / "other.txt", "no log")
    rows = timing.read_timings(spark, str(tmp_path)).collect()
    assert [(r.dataset_id, r.algorithm_id) for r in rows] == [("d", "alg")]


def test_config(spark, tmp_path):
    for run in ("b", "a"):
        (tmp_path / "inputs" / "scan" / run).mkdir(parents=True)
    (tmp_path / "inputs" / "empty").mkdir()
    settings = {
        "input_settings": {
            "input_dir": "inputs",
            "algorithms": [{"algorithm_id": "x", "should_run": [True]}, {"algorithm_id": "y"}],
            "datasets": [
                {"dataset_id": "scan", "scan_run_subdirectories": True, "nickname": "S"},
                {"dataset_id": "named", "runs": [{"run_id": "r1"}]},
                {"dataset_id": "off", "should_run": [False], "runs": []},
            ],
        },
        "output_settings": {"output_dir": "outputs", "experiment_id": "e1"},
    }
    bench = config.load_config(spark, settings, str(tmp_path))
    assert [tuple(r) for r in bench.runs.collect()] == [("scan", "a"), ("scan", "b"), ("named", "r1")]
    assert [r.algorithm_id for r in bench.algorithms.collect()] == ["x"]
    assert {r.dataset_id: r.nickname for r in bench.datasets.collect()} == {"scan": "S", "named": "named"}
    assert bench.output_root.endswith("outputs/e1")
    with pytest.raises(RuntimeError):
        config.discover_runs(spark, str(tmp_path / "inputs"), {"dataset_id": "empty", "scan_run_subdirectories": True})
    with pytest.raises(FileNotFoundError):
        config.discover_runs(spark, str(tmp_path / "inputs"), {"dataset_id": "none", "scan_run_subdirectories": True})


def test_columns_by_name(spark, tmp_path):
    write(tmp_path / "d" / "GroundTruthNetwork.csv", 'Type,Gene1,note,Gene2\n+,a,x,"b,1"\n-,b,y,c\n')
    write(tmp_path / "e" / "GroundTruthNetwork.csv", "Gene1,Gene2,Score\na,b,7\n")
    rows = edges.read_ground_truth(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {("d", "a", "b,1", "+"), ("d", "b", "c", "-"), ("e", "a", "b", None)}
    own = edges.read_ground_truth(spark, str(tmp_path), {"e": "GroundTruthNetwork.csv"})
    assert [tuple(r) for r in own.collect()] == [("e", "a", "b", None)]
    write(tmp_path / "d" / "r" / "x" / "rankedEdges.csv", "EdgeWeight\tGene2\tGene1\n0.5\tb\ta\n")
    write(tmp_path / "d" / "r" / "y" / "rankedEdges.csv", "u\tv\tw\na\tb\t0.25\n")
    rows = edges.read_ranked_edges(spark, str(tmp_path)).collect()
    assert {(r.algorithm_id, r.gene1, r.gene2, r.weight) for r in rows} == {("x", "a", "b", 0.5), ("y", "a", "b", 0.25)}


def test_no_file_gives_no_row(spark, tmp_path):
    assert edges.read_ranked_edges(spark, str(tmp_path)).count() == 0
    assert edges.read_ground_truth(spark, str(tmp_path)).count() == 0
    assert expression.read_expression(spark, str(tmp_path)).count() == 0


def test_quoted_fields_and_widths(spark, tmp_path):
    write(tmp_path / "d" / "r" / "ExpressionData.csv", 'g,"c,1",c2\n"g,1",1,2\n"g ""2""",,3\ng,"c,1",c2\n')
    rows = {(r.gene, r.cell): r.value for r in expression.read_expression(spark, str(tmp_path)).collect()}
    assert rows == {("g,1", "c,1"): 1.0, ("g,1", "c2"): 2.0, ('g "2"', "c2"): 3.0}
    write(tmp_path / "d" / "r" / "ExpressionData.csv", "g,c1,c2\na,1,2,3,4\n")
    with pytest.raises(Exception, match="does not fit the header"):
        expression.read_expression(spark, str(tmp_path)).collect()


def test_evaluate_from_a_configuration(spark, tmp_path):
    from edgemeter.plans import benchmark

    write(tmp_path / "in" / "d" / "own.csv", "Gene1,Gene2,Type\na,b,+\nb,c,-\n")
    write(tmp_path / "in" / "e" / "GroundTruthNetwork.csv", "Gene1,Gene2\nx,y\n")
    head = "Gene1\tGene2\tEdgeWeight\n"
    for run in ("r1", "r2"):
        write(tmp_path / "out" / "d" / run / "alg" / "rankedEdges.csv", head + "a\tb\t1.0\nb\tc\t0.5\n")
        write(tmp_path / "out" / "d" / run / "off" / "rankedEdges.csv", head + "a\tb\t1.0\n")
    write(tmp_path / "out" / "d" / "r3" / "alg" / "rankedEdges.csv", head)
    write(tmp_path / "out" / "e" / "r1" / "alg" / "rankedEdges.csv", head + "x\ty\t1.0\n")
    runs = [{"run_id": f"r{i}"} for i in (1, 2, 3)]
    settings = {
        "input_settings": {"input_dir": "in", "datasets": [
            {"dataset_id": "d", "runs": runs, "groundTruthNetwork": "own.csv"},
            {"dataset_id": "e", "runs": runs[:1], "should_run": [False]},
        ], "algorithms": [{"algorithm_id": "alg", "should_run": [True]}, {"algorithm_id": "off"}]},
        "output_settings": {"output_dir": "out"},
    }
    names = [n for n in benchmark.METRICS]
    rows = benchmark.evaluate_config(spark, settings, names, str(tmp_path)).collect()
    got = {(r.run_id, r.metric): r.value for r in rows}
    assert {r.dataset_id for r in rows} == {"d"} and {r.algorithm_id for r in rows} == {"alg"}
    assert got["r1", "auprc"] == 1.0 and got["r3", "auprc"] == pytest.approx((1 + 2 / 6) / 2)
    assert got["r1", "epr"] == 3.0 and got["r3", "epr"] == 0.0
    assert got[None, "median_jaccard"] == 0.0  # 1, 0 and 0 over the three pairs of runs
    assert got["r3", "auroc_ratio"] == 1.0 and got["r1", "num_tp"] == 2.0


def test_consensus_counts_lists_without_rows(spark, lists):
    from edgemeter.operators import consensus

    edges = lists({("r1", "a"): [("x", "y", 1.0), ("y", "z", 0.5)]})
    empty = spark.createDataFrame([("d", "r1", "b")], "dataset_id string, run_id string, algorithm_id string")
    got = {(r.gene1, r.gene2): r["mean"] for r in consensus.borda_scores(edges, empty).collect()}
    assert got == {("x", "y"): 2.0, ("y", "z"): 1.5}


def test_wide_matrices_round_trip(spark, tmp_path, monkeypatch):
    from edgemeter.sources import files

    monkeypatch.setattr(files, "ROWS_PER_FILE", 7)
    rows = [("d", f"r{i % 2}", f"g,{i % 23}", f"c{(i * 7) % 41}", i / 4) for i in range(0, 900, 3)]
    rows += [("d", "r0", "1", "only", 0.5), ("e", "x", 'q"t', "c", 2.0)]
    expr = spark.createDataFrame(
        list({r[:4]: r for r in rows}.values()), "dataset_id string, run_id string, gene string, cell string, value double")
    expression.write_expression(expr, str(tmp_path / "m"))
    back = expression.read_expression(spark, str(tmp_path / "m"), "part-*")
    assert sorted(back.collect()) == sorted(expr.collect())
    assert len(list((tmp_path / "m").glob("dataset_id=d/run_id=r0/part-*"))) >= 3
    expression.write_expression(expr.limit(0), str(tmp_path / "none"))
    assert expression.read_expression(spark, str(tmp_path / "none"), "part-*").count() == 0
