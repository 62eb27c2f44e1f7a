"""Work of one dataset or list spreads over tasks: lists numbered by ranges, universes by blocks."""

import pytest
from pyspark.sql import functions as F

from edgemeter import schema
from edgemeter.functions import ranking
from edgemeter.operators import curves, early, graph, primitives
from edgemeter.plans import fixtures

TRUTH = [("x", "y", "+"), ("y", "z", "-"), ("x", "x", "+"), (None, "w", "+"), ("w", None, "-"), ("v", "v", "+")]
UNIVERSE = {
    "directed": lambda genes, rows: {(a, b) for a in genes for b in genes if a and b and a != b},
    "undirected": lambda genes, rows: {(a, b) for a in genes for b in genes if a and b and a < b},
    "tf": lambda genes, rows: {(a, b) for a, t, _ in rows if a and t and a != t for b in genes if b and a != b},
    "tf_self": lambda genes, rows: {(a, b) for a, _, _ in rows for b in genes},
}


def test_places_equal_row_numbers_over_several_ranges(spark):
    rows = [("d", run, "a", f"g{i * 7 % 50:02d}", (i * 37 % 11 - 5) / 10) for run in ("r", "s", None) for i in range(50)]
    table = spark.createDataFrame(rows, "dataset_id string, run_id string, algorithm_id string, gene1 string, weight double")
    table.createOrReplaceTempView("to_place")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranking.placed(table.repartition(3), schema.KEYS, ["ABS(weight) DESC", "gene1"], "ord")
        assert found.schema["ord"].dataType.typeName() == "long"
        found = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = spark.sql("""SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id, run_id, algorithm_id
        ORDER BY ABS(weight) DESC, gene1) - 1 AS BIGINT) AS ord FROM to_place""")
    assert found == sorted(map(tuple, wanted.collect()), key=str)


@pytest.mark.parametrize("kind", primitives.UNIVERSES)
def test_universe_in_blocks_keeps_its_partitions(spark, truth, kind, monkeypatch):
    monkeypatch.setattr(primitives, "BLOCK", 2)
    gt = truth(TRUTH).unionByName(truth([("x", "y", "+")], dataset=None))
    pairs = primitives.universe(gt, kind)
    genes = {g for a, b, _ in TRUTH for g in (a, b)}
    wanted = {("d", *p) for p in UNIVERSE[kind](genes, TRUTH)}
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    # A few bytes of input, yet not one task: the output is quadratic.
    assert pairs.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("kind", primitives.UNIVERSES)
def test_align_in_blocks(spark, truth, lists, kind, monkeypatch):
    monkeypatch.setattr(primitives, "BLOCK", 2)
    rows = [("x", "y", 0.5), ("y", "x", -0.7), ("x", "y", -0.6), ("x", "x", 0.9), ("q", "x", 0.3), ("w", "v", 0.0)]
    edges = lists({"a": rows, "b": [("x", "x", 0.1)]}).unionByName(lists({(None, "a"): [("x", "y", 0.2)]}))
    genes = {g for a, b, _ in TRUTH for g in (a, b)}
    best = {("x", "y"): 0.6, ("y", "x"): 0.7}
    pairs = UNIVERSE[kind](genes, TRUTH)
    wanted = [("d", run, algo, *p, best.get(p, 0.0) if (run, algo) == ("r1", "a") else 0.0)
              for run, algo in (("r1", "a"), ("r1", "b"), (None, "a")) for p in pairs]
    out = primitives.align(edges, truth(TRUTH), kind)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(wanted, key=str)
    assert out.rdd.getNumPartitions() >= 4


def test_links_equal_the_joins_of_their_sql(spark):
    """Repeated and NULL keys multiply or lose rows as in the SQL, and the lines are shuffled once."""
    line = "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_quantity double"
    rows = {
        "lineitem": (line, [(1, 1, 1, "A", 3.0), (1, 2, 2, "A", 4.5), (1, 2, 2, "A", 4.5), (1, 3, None, "N", 5.0), (1, None, 1, None, 7.0),
                            (None, 1, 1, "A", 1.0), (None, 2, 2, "A", 1.0), (2, 1, 3, "R", None), (2, 2, 1, "R", 2.0), (3, 1, 1, "R", 2.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string", [(1, 1, "F"), (1, 2, "O"), (2, None, "P"), (2, 2, None), (None, 1, "F")]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 5), (2, 6), (2, 6), (2, None), (None, 7)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 8), (1, 9), (2, None), (None, 3)]),
    }
    for name, (schema_, data) in rows.items():
        spark.createDataFrame(data, schema_).createOrReplaceTempView(name)
    found = fixtures._links(spark)
    wanted = spark.sql(fixtures.BODIES["fx_links"])
    assert found.columns == wanted.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(l_orderkey" in x for x in plan.splitlines()) == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


@pytest.mark.parametrize("operator", [early.epr, curves.auprc])
def test_pairs_are_grouped_and_labelled_after_one_shuffle(spark, lists, truth, operator):
    """A shuffle by list and pair before the one by pair moved every row twice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = operator(lists({"a": [("a", "b", 1.0)]}), truth([("a", "b")]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_list = [x for x in plan.splitlines() if "Exchange hashpartitioning(dataset_id" in x and "run_id" in x and "gene1" in x]
    assert not by_list


def test_best_signed_breaks_ties_by_place(spark, lists):
    rows = [("a", "b", -0.5), ("a", "b", 0.5), ("c", "d", 0.2), ("c", "d", 0.7), ("c", "d", -0.7), ("e", "f", -0.9), ("e", "f", 0.3)]
    out = primitives.best_signed(lists({"x": rows}))
    assert {(r.gene1, r.weight) for r in out.collect()} == {("a", -0.5), ("c", 0.7), ("e", -0.9)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_count_each_time_on_a_curve(spark, lists, truth):
    rows = [("a", "b", 0.9), ("a", "b", 0.9), ("b", "c", 0.5), ("a", "a", 2.0), ("c", "a", -0.1)]
    out = curves.pr_curve(lists({"x": rows}), truth([("a", "b"), ("c", "a")]))
    points = sorted((r.threshold, round(r.recall, 6), round(r.precision, 6)) for r in out.collect() if r.threshold is not None)
    assert points == [(-0.1, 1.0, 0.75), (0.5, 0.666667, 0.666667), (0.9, 0.666667, 1.0)]


def test_wedges_travel_as_arrays(spark):
    """All kinds of triangles at hubs; a row per edge meets its neighbours, not a row per wedge."""
    import itertools
    import random

    draw = random.Random(5)
    nodes = [f"n{i}" for i in range(14)]
    edges = {(a, b) for a, b in itertools.permutations(nodes, 2) if draw.random() < (0.9 if "n0" in (a, b) else 0.35)}
    out = graph.motif_counts(spark.createDataFrame([("d", a, b) for a, b in edges], "dataset_id string, gene1 string, gene2 string"), ["dataset_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" in plan
    triples = [t for t in itertools.permutations(nodes, 3) if (t[0], t[1]) in edges and (t[1], t[2]) in edges]
    row = out.first()
    assert row.fbl == sum((c, a) in edges for a, _, c in triples) // 3
    assert row.ffl == sum((a, c) in edges for a, _, c in triples)
    assert row.mi == sum((b, a) in edges for a, b in edges) // 2


def test_path_search_leaves_no_row_per_node_and_word(spark, monkeypatch):
    """300 nodes in 60 rings of five and one ring of 12: each reaches only its ring."""
    kept = []

    def keeping(real):
        def keep(df, *label):
            out = real(df, *label)
            kept.append(out.count())
            return out

        return keep

    monkeypatch.setattr(graph, "checkpointed", keeping(graph.checkpointed))
    monkeypatch.setattr(graph, "stored", keeping(graph.stored))
    rings = [[f"r{i}_{j}" for j in range(5)] for i in range(60)] + [[f"long{j:02d}" for j in range(12)]]
    links = [("d", a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    # The distance is the difference of the places, up to 11 rounds; a word mixes many rings.
    pairs = [("d", ring[0], ring[-1], len(ring) - 1) for ring in rings] + [("d", "long09", "long08", 11)]
    pairs += [("d", "r0_0", f"r{i}_0", None) for i in range(1, 60)]
    pairs += [("d", f"r{i}_{j}", f"r{i}_{(j + 2) % 5}", 2) for i in range(60) for j in range(5)]
    schema_of = "dataset_id string, gene1 string, gene2 string"
    wanted = {p for p in pairs if p[3]}
    found = graph.shortest_lengths(
        spark.createDataFrame([p[:3] for p in pairs], schema_of), spark.createDataFrame(links, schema_of)
    )
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert max(kept) <= len(pairs)


@pytest.mark.parametrize("held, rounds", [(1, 1), (1 << 22, 3)])
def test_path_search_over_blocks_and_jobs(spark, monkeypatch, held, rounds):
    monkeypatch.setattr(graph, "HELD_WORDS", held)
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    monkeypatch.setattr(graph, "CHUNK_EDGES", 16)
    nodes = [f"n{i:03d}" for i in range(150)]
    # A chain with steps back by three, and a part that no step enters.
    links = list(zip(nodes[:8], nodes[1:9])) + [(nodes[i], nodes[i - 3]) for i in range(3, 9)]
    links += [(a, nodes[0]) for a in nodes[9:]]
    nexts = {}
    for a, b in links:
        nexts.setdefault(a, []).append(b)

    def lengths(start):
        out, edge = {start: 0}, [start]
        while edge:
            edge = list(dict.fromkeys(b for a in edge for b in nexts.get(a, []) if b not in out and not out.update({b: out[a] + 1})))
        return out

    pairs = [(a, b) for a in nodes for b in nodes[:12] if a != b]
    wanted = {("d", a, b, n) for a, b in pairs if (n := lengths(a).get(b))}
    schema_of = "dataset_id string, gene1 string, gene2 string"
    found = graph.shortest_lengths(
        spark.createDataFrame([("d", *p) for p in pairs], schema_of), spark.createDataFrame([("d", *p) for p in links], schema_of)
    ).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


@pytest.mark.parametrize("kind", primitives.UNIVERSES)
def test_universe_in_equal_parts_that_repeat_few_genes(spark, truth, kind, monkeypatch):
    """Tasks get as many rows as one another, and rows near each other hold the genes of a strip or two."""
    for name, size in (("CHUNK", 4), ("STRIP", 8), ("BLOCK", 40)):
        monkeypatch.setattr(primitives, name, size)
    genes = [f"g{i:03d}" for i in range(200)]
    rows = [(a, b) for a, b in zip(genes, genes[1:] + genes[:1])]
    pairs = primitives.universe(truth(rows), kind).withColumns(
        {"task": F.spark_partition_id(), "at": F.floor(F.monotonically_increasing_id() / 32)}
    ).localCheckpoint()
    wanted = {p for p in UNIVERSE[kind](genes, [(*r, None) for r in rows])}
    found = [(r.gene1, r.gene2) for r in pairs.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    sizes = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 1.1 * len(found) / 4
    near = pairs.groupBy("at").agg(F.count_distinct("gene2").alias("n")).agg(F.avg("n")).first()[0]
    assert near <= 16


@pytest.mark.parametrize("kind", ["directed", "undirected", "tf_self"])
def test_align_in_equal_parts_beside_a_full_list(spark, truth, lists, kind, monkeypatch):
    """A list that scores all pairs leaves nothing to unfold; the others' pairs are dealt evenly."""
    for name, size in (("CHUNK", 4), ("STRIP", 8), ("BLOCK", 32)):
        monkeypatch.setattr(primitives, name, size)
    genes = [f"g{i:02d}" for i in range(64)]
    rows = [(a, b, None) for a, b in zip(genes, genes[1:] + genes[:1])]
    full = [(a, b, 1.0 + (i + j) % 3) for i, a in enumerate(genes) for j, b in enumerate(genes)]
    few = [(a, genes[(7 * i) % 64], -0.25 * (1 + i % 4)) for i, a in enumerate(genes)] + [("g00", "no gene", 1.0)]
    tables = {"few": few, "full": full, "none": [("g01", "g01", 1.0)]}
    pairs = UNIVERSE[kind](genes, rows)
    best = {algo: {(a, b): abs(w) for a, b, w in edges if a != b} for algo, edges in tables.items()}
    wanted = [("d", "r1", algo, *p, best[algo].get(p, 0.0)) for algo in tables for p in pairs]
    out = primitives.align(lists(tables), truth(rows), kind).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:-1] for r in out) == sorted(wanted)
    sizes = {}
    for r in out:
        if r.score == 0 and r.algorithm_id != "full":
            sizes[r.task] = sizes.get(r.task, 0) + 1
    assert len(sizes) == 4 and max(sizes.values()) <= 1.25 * sum(sizes.values()) / 4
