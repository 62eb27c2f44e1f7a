import random

import numpy as np
import pytest

import brute
from edgemeter.operators import consensus, curves, early, graph, primitives, stability, timing

CYCLE = [("a", "b"), ("b", "c"), ("c", "a")]


def values(df, *columns):
    columns = columns or ("value",)
    return {
        (r.run_id, r.algorithm_id): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
        for r in df.collect()
    }


def one(df, column="value"):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def random_lists(seed, n_genes=9):
    rng = random.Random(seed)
    genes = [f"g{i}" for i in range(n_genes)]
    gt = [(rng.choice(genes), rng.choice(genes), rng.choice("+-")) for _ in range(20)]
    edges = [
        (rng.choice(genes + ["x"]), rng.choice(genes), rng.randint(-4, 4) / 4) for _ in range(60)
    ]
    return edges, gt


@pytest.mark.parametrize("seed", range(3))
def test_areas_match_full_universe(lists, truth, seed):
    edges, gt = random_lists(seed)
    area = curves.curve_areas(lists({"a": edges}), truth(gt)).collect()[0]
    assert area.auprc == pytest.approx(brute.auprc(edges, gt), abs=1e-12)
    assert area.auroc == pytest.approx(brute.auroc(edges, gt), abs=1e-12)


def test_areas_do_not_depend_on_partitioning(lists, truth):
    edges, gt = random_lists(7)
    df = lists({"a": edges})
    one_way = curves.curve_areas(df.repartition(1), truth(gt)).collect()
    other = curves.curve_areas(df.repartition(17), truth(gt)).collect()
    assert one_way[0].auprc == pytest.approx(other[0].auprc, abs=1e-12)


def test_auroc_ignores_monotone_maps_and_reverses(lists, truth):
    edges = [("a", "b", 6), ("b", "c", 5), ("a", "c", 4), ("b", "a", 3), ("c", "a", 2), ("c", "b", 1)]
    gt = [("a", "b"), ("c", "a")]
    df = lists({
        "plain": edges,
        "cubed": [(a, b, w**3) for a, b, w in edges],
        "reversed": [(a, b, 7 - w) for a, b, w in edges],
    })
    got = {k[1]: v for k, v in values(curves.auroc(df, truth(gt + [("b", "b")]))).items()}
    assert got["plain"] == pytest.approx(got["cubed"])
    assert got["plain"] + got["reversed"] == pytest.approx(1.0)


def test_no_usable_prediction_is_one_tied_block(lists, truth):
    gt = truth(CYCLE)
    loops = lists({"a": [("a", "a", 1.0)]})
    assert one(curves.auprc(loops, gt)) == pytest.approx((1 + 0.5) / 2)
    assert one(curves.auroc(loops, gt)) == pytest.approx(0.5)
    empty = loops.select("dataset_id", "run_id", "algorithm_id")
    assert one(curves.auprc(loops.limit(0), gt, lists=empty)) == pytest.approx(0.75)
    assert one(early.epr(loops, gt)) == 0.0
    assert {r.value for r in early.signed_epr(loops, truth([("a", "b", "+"), ("b", "a", "-")])).collect()} == {None}
    row = early.early_pr(loops, gt).collect()[0]
    assert (row.early_precision, row.early_recall, row.early_precision_ratio) == (1.0, 1.0, 1.0)


def test_area_undefined_without_true_edges(lists, truth):
    df = lists({"a": [("a", "b", 1.0)]})
    assert one(curves.auprc(df, truth([("a", "a"), ("b", "b")]))) is None
    assert one(curves.auroc(df, truth([("a", "b"), ("b", "a")]))) is None


def test_perfect_ranking_epr_is_inverse_prevalence(lists, truth):
    assert one(early.epr(lists({"a": [(*e, 1.0) for e in CYCLE]}), truth(CYCLE))) == pytest.approx(2.0)


def test_gene_on_self_loop_only_counts_in_universe_but_not_in_baseline(truth):
    from edgemeter.operators import rollup

    gt = truth([("a", "b"), ("c", "c")])
    assert primitives.universe_sizes(gt).collect()[0].n_pairs == 6
    assert rollup.random_baseline(gt).collect()[0].baseline == pytest.approx(0.5)


def test_tie_at_rank_k(lists, truth):
    df = lists({"a": [("a", "b", 0.9), ("a", "c", 0.5), ("b", "a", -0.5), ("c", "a", 0.1)]})
    k = primitives.k_true(truth([("a", "b"), ("a", "c")]))
    ties = {(r.gene1, r.gene2) for r in primitives.topk_ties(df, k).collect()}
    plain = {(r.gene1, r.gene2) for r in primitives.topk_plain(df, k).collect()}
    assert ties == {("a", "b"), ("a", "c"), ("b", "a")}
    assert plain == {("a", "b"), ("b", "a")}  # later rows first among equals


def test_zero_weights_never_enter_beside_positive_ones(lists, truth):
    k = primitives.k_true(truth(CYCLE))
    df = lists({"some": [("a", "b", 0.2), ("b", "c", 0.0)], "none": [("a", "b", 0.0), ("b", "c", 0.0)]})
    got = primitives.topk_ties(df, k).groupBy("algorithm_id").count().collect()
    assert {r.algorithm_id: r["count"] for r in got} == {"some": 1, "none": 2}


def test_early_pr_of_zero_list_is_null(lists, truth):
    row = early.early_pr(lists({"a": [("a", "b", 0.0)]}), truth(CYCLE)).collect()[0]
    assert row.early_precision is None and row.early_recall is None


def test_signed_epr_counts_repeats_and_drops_opposite(lists, truth):
    gt = truth([("a", "b", "+"), ("b", "c", "-"), ("c", "a", "+"), ("c", "a", "-")])
    df = lists({"a": [("a", "b", 0.9), ("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.9), ("c", "a", 1.0)]})
    got = {r.metric: r.value for r in early.signed_epr(df, gt).collect()}
    # Both-sign edge c->a leaves both pools; k = 2 of 6 pairs for each sign.
    assert got["epr_activation"] == pytest.approx((2 / 3) / (2 / 6))
    # Without a->b: a->c and b->c remain, one is right.
    assert got["epr_inhibitory"] == pytest.approx((1 / 2) / (2 / 6))


def test_signed_average_precision_last_row_wins(lists, truth):
    gt = truth([("a", "b", "+"), ("b", "a", "-")])
    df = lists({"a": [("a", "b", 0.9), ("a", "b", 0.1), ("b", "a", -0.5), ("a", "b", -0.7)]})
    got = {r.sign: r for r in curves.signed_pr_roc(df, gt).collect()}
    assert got["+"].average_precision == pytest.approx(1.0)
    assert got["-"].average_precision == pytest.approx(0.5)  # -0.7 on a->b ranks first


def test_undirected_counts_sorted_orientation_only(lists, truth):
    gt = truth([("b", "a"), ("b", "c")])
    df = lists({"sorted": [("a", "b", 1.0), ("b", "c", 0.9)], "turned": [("b", "a", 1.0), ("c", "b", 0.9)]})
    got = {r.algorithm_id: r for r in curves.pr_roc_ratio(df, gt, "undirected").collect()}
    assert got["sorted"].average_precision == pytest.approx(1.0)
    assert got["turned"].average_precision == pytest.approx(2 / 3)


def test_curves_use_signed_weights_and_place(lists, truth):
    df = lists({"good": [("a", "b", 0.9), ("a", "c", -0.9)], "bad": [("a", "c", 0.9), ("a", "b", -0.9)],
                "blank": [("a", "c", 1.0)]})
    rows = curves.pr_curve(df, truth([("a", "b")])).collect()
    assert {r.algorithm_id for r in rows} == {"good", "bad"}
    assert {r.algorithm_id: r.place for r in rows} == {"good": 1, "bad": 2}
    anchors = [r for r in rows if r.threshold is None]
    assert all((r.recall, r.precision) == (0.0, 1.0) for r in anchors)


def test_jaccard_pairs_and_single_run(lists, truth):
    gt = truth([("a", "b"), ("b", "c")])
    df = lists({
        ("r1", "m"): [("a", "b", 3), ("b", "c", 2)],
        ("r2", "m"): [("a", "b", 3), ("c", "a", 2)],
        ("r3", "m"): [("c", "b", 3), ("b", "a", 2)],
        ("r1", "solo"): [("a", "b", 1)],
    })
    got = {r.algorithm_id: r for r in stability.jaccard(df, gt).collect()}
    pairs = np.array([1 / 3, 0.0, 0.0])
    assert got["m"].median_jaccard == pytest.approx(np.median(pairs))
    assert got["m"].mad_jaccard == pytest.approx(np.abs(pairs - pairs.mean()).mean())
    assert got["solo"].median_jaccard is None


def test_spearman_matches_dense_ranks_and_drops_constant(lists, truth):
    edges1, gt = random_lists(3)
    edges2, _ = random_lists(4)
    df = lists({("r1", "m"): edges1, ("r2", "m"): edges2, ("r3", "m"): [("g0", "g1", 0.0)]})
    pairs = brute.universe(gt)

    def dense(edges):
        chosen = {}
        for a, b, w in edges:
            if a != b and ((a, b) not in chosen or abs(w) > abs(chosen[a, b])):
                chosen[a, b] = w
        return brute.mid_ranks([chosen.get(p, 0.0) for p in pairs])

    expected = np.corrcoef(dense(edges1), dense(edges2))[0, 1]
    row = stability.spearman(df, truth(gt)).collect()[0]
    assert row.median_spearman == pytest.approx(expected, abs=1e-10)
    assert row.mad_spearman == pytest.approx(0.0)


def test_borda_absent_edges_and_worst_rank(lists):
    df = lists({"x": [("a", "b", 0.9), ("b", "c", 0.5), ("a", "b", 0.1)], "y": [("b", "c", 1.0)]})
    got = {(r.gene1, r.gene2): r for r in consensus.borda_scores(df).collect()}
    # Two edges; x ranks a->b last (3), so its score is 0; y lacks it: 2 - 1 = 1.
    assert (got["a", "b"]["min"], got["a", "b"]["max"], got["a", "b"]["mean"]) == (0.0, 1.0, 0.5)
    assert (got["b", "c"]["min"], got["b", "c"]["max"]) == (1.0, 2.0)
    flat = consensus.borda(lists({"x": [("a", "b", 1.0)]})).collect()[0]
    assert flat.borda == 0.0


def test_motif_counts(lists, truth):
    def counts(edges):
        rows = truth(edges).select("dataset_id", "gene1", "gene2")
        r = graph.motif_counts(rows, ["dataset_id"]).collect()[0]
        return r.fbl, r.ffl, r.mi

    assert counts(CYCLE) == (1, 0, 0)
    assert counts([("a", "b"), ("a", "c"), ("b", "c")]) == (0, 1, 0)
    assert counts([("a", "b"), ("b", "a")]) == (0, 0, 1)
    rng = random.Random(5)
    edges = list({(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for _ in range(60)})
    edges = [e for e in edges if e[0] != e[1]]
    has, nodes = set(edges), sorted({n for e in edges for n in e})
    triples = [(a, b, c) for a in nodes for b in nodes for c in nodes if len({a, b, c}) == 3]
    fbl = sum((a, b) in has and (b, c) in has and (c, a) in has for a, b, c in triples) // 3
    ffl = sum((a, b) in has and (a, c) in has and (b, c) in has for a, b, c in triples)
    mi = sum((b, a) in has for a, b in edges) // 2
    assert counts(edges) == (fbl, ffl, mi)


def test_path_stats_bins(lists, truth):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(8)] + [("m0", "m1")]
    wrong = [("n0", "n2"), ("n0", "n5"), ("n0", "n6"), ("n3", "n0"), ("n0", "zz"), ("n0", "m1")]
    df = lists({"a": [(*e, 0.9) for e in [("n0", "n1"), *wrong]], "zero": [("n0", "n2", 0.0)]})
    rows = graph.path_stats(df, truth(chain)).collect()
    assert len(rows) == 1  # the all-zero list is left out
    r = rows[0]
    assert (r.len_0, r.len_2, r.len_3, r.len_4, r.len_5) == (0, 1, 0, 0, 1)
    assert (r.num_pred, r.num_tp, r.num_fp_with_path, r.num_fp_no_path) == (7, 1, 3, 3)


def test_shortest_lengths_over_several_words_of_sources(spark):
    rng = random.Random(7)
    schema = "dataset_id string, gene1 string, gene2 string"
    links = {(d, f"n{rng.randint(0, 99)}", f"n{rng.randint(0, 99)}") for d in "xy" for _ in range(260)}
    links |= {("long", f"c{i}", f"c{i + 1}") for i in range(6)}  # no cycle, no way back
    links = sorted(link for link in links if link[1] != link[2])
    nexts: dict[tuple[str, str], list[str]] = {}
    for d, a, b in links:
        nexts.setdefault((d, a), []).append(b)

    def lengths(d, start):
        out, edge, n = {}, [start], 0
        met = {start}
        while edge:
            n += 1
            edge = list(dict.fromkeys(b for a in edge for b in nexts.get((d, a), []) if b not in met))
            met.update(edge)
            out |= dict.fromkeys(edge, n)
        return out

    nodes = sorted({(d, g) for d, *pair in links for g in pair})
    pairs = [(d, a, b) for d, a in nodes for e, b in rng.sample(nodes, 12) if d == e and a != b]
    pairs += [("long", "c0", "c6"), ("long", "c6", "c0"), ("x", "n0", "absent"), ("none", "n0", "n1")]
    expected = {(d, a, b): n for d, a, b in pairs if (n := lengths(d, a).get(b))}
    got = graph.shortest_lengths(
        spark.createDataFrame(pairs + pairs[:5], schema), spark.createDataFrame(links, schema)
    ).collect()
    assert len(got) == len(expected)
    assert {(r.dataset_id, r.gene1, r.gene2): r.length for r in got} == expected
    empty = spark.createDataFrame([], schema)
    assert graph.shortest_lengths(empty, spark.createDataFrame(links, schema)).count() == 0


def test_path_threshold_follows_file_position(lists, truth):
    gt = truth([("a", "b"), ("b", "c")])
    df = lists({"a": [("a", "c", 0.9), ("b", "a", 0.2), ("c", "b", 0.5), ("c", "a", 0.1)]})
    got = primitives.topk_positional(df, primitives.k_true(gt)).collect()
    assert {(r.gene1, r.gene2) for r in got} == {("a", "c"), ("b", "a"), ("c", "b")}


def test_cpu_time(spark):
    good = "\tUser time (seconds): 1.50\n\tSystem time (seconds): 0.25\n"
    rows = [("d", "r1", "a", good), ("d", "r1", "a", good), ("d", "r1", "b", "\tUser time (seconds): 9\n")]
    logs = spark.createDataFrame(rows, "dataset_id string, run_id string, algorithm_id string, text string")
    named = spark.createDataFrame([("d", "r1", "c")], "dataset_id string, run_id string, algorithm_id string")
    got = {r.algorithm_id: r.value for r in timing.cpu_time(logs, named).collect()}
    assert got == {"a": 3.5, "b": 0.0, "c": None}
