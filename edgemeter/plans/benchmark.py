"""Extension points and whole-benchmark plans."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgemeter.functions.joins import salted_join
from edgemeter.operators import (
    association,
    consensus,
    curves,
    early,
    graph,
    matrix,
    networks,
    stability,
    timing,
    trees,
)
from edgemeter.schema import KEYS
from edgemeter.sources.config import Benchmark, load_config
from edgemeter.sources.edges import found_lists, read_ground_truth, read_ranked_edges
from edgemeter.sources.timing import read_timings

Metric = Callable[..., DataFrame]
Network = Callable[[DataFrame, DataFrame | None], DataFrame]

METRICS: dict[str, Metric] = {}
NETWORKS: dict[str, Network] = {}


def register_metric(name: str, fn: Metric) -> None:
    """`fn(edges, ground_truth)` gives (keys, metric, value); if it takes `lists`
    it is also told which lists exist without rows."""
    METRICS[name] = fn


def register_network(name: str, fn: Network) -> None:
    """`fn(expression, pseudotime)` gives (dataset_id, run_id, gene1, gene2, weight)."""
    NETWORKS[name] = fn


def evaluate(
    edges: DataFrame, gt: DataFrame, names: list[str], lists: DataFrame | None = None
) -> DataFrame:
    """(keys, metric, value) of all named metrics over all lists; metrics of an
    algorithm over its runs have a NULL run. `lists` names lists that exist
    without rows."""
    parts = []
    for name in names:
        fn = METRICS[name]
        takes = "lists" in inspect.signature(fn).parameters
        found = fn(edges, gt, lists=lists) if takes else fn(edges, gt)
        parts.append(found.select(*KEYS, "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def _configured(
    spark: SparkSession, settings: Mapping[str, Any], root: str, edge_file: str
) -> tuple[Benchmark, DataFrame, DataFrame, DataFrame]:
    """(configuration, wanted lists, found lists, their edges)."""
    bench = load_config(spark, settings, root)
    chosen = bench.runs.join(
        bench.algorithms.agg(F.collect_set("algorithm_id").alias("_a"))
    ).select("dataset_id", "run_id", F.explode("_a").alias("algorithm_id"))
    lists = found_lists(spark, bench.output_root, edge_file).join(chosen, KEYS, "left_semi")
    edges = read_ranked_edges(spark, bench.output_root, edge_file).join(chosen, KEYS, "left_semi")
    return bench, chosen, lists, edges


def evaluate_config(
    spark: SparkSession,
    settings: Mapping[str, Any],
    names: list[str],
    root: str = ".",
    edge_file: str = "rankedEdges.csv",
    timing_file: str = "time*.txt",
) -> DataFrame:
    """`evaluate` for a parsed configuration: the enabled datasets, runs and
    algorithms, each dataset with its own ground-truth file. `cpu_time` among the
    names sums the timing logs, NULL for a wanted list without any."""
    bench, chosen, lists, edges = _configured(spark, settings, root, edge_file)
    parts = []
    others = [n for n in names if n != "cpu_time"]
    if others:
        # One row per dataset of the configuration.
        files = {r.dataset_id: r.ground_truth for r in bench.datasets.collect()}
        parts.append(evaluate(edges, read_ground_truth(spark, bench.input_root, files), others, lists))
    if "cpu_time" in names:
        logs = read_timings(spark, bench.output_root, timing_file).join(chosen, KEYS, "left_semi")
        parts.append(timing.cpu_time(logs, chosen))
    return reduce(DataFrame.unionByName, parts)


def consensus_config(
    spark: SparkSession, settings: Mapping[str, Any], root: str = ".", edge_file: str = "rankedEdges.csv"
) -> DataFrame:
    """`consensus.borda` of the lists of a parsed configuration; lists without rows count."""
    _, _, lists, edges = _configured(spark, settings, root, edge_file)
    return consensus.borda(edges, lists)


def nicknamed(values: DataFrame, datasets: DataFrame) -> DataFrame:
    """Result rows with the `nickname` of their dataset, its id where it has none."""
    names = datasets.select("dataset_id", F.col("nickname").alias("_nick"))
    joined = salted_join(values, names, ["dataset_id"], values.columns, "left")
    return joined.withColumn("nickname", F.coalesce("_nick", "dataset_id")).drop("_nick")


def infer(expr: DataFrame, pt: DataFrame | None, names: list[str]) -> DataFrame:
    """Ranked edge lists (keys, ord, gene1, gene2, weight) of all named networks."""
    parts = [association.rank_edges(NETWORKS[n](expr, pt), n) for n in names]
    return reduce(DataFrame.unionByName, parts)


def select_inputs(
    expr: DataFrame,
    ordering: DataFrame,
    net: DataFrame,
    regulators: DataFrame | None = None,
    cutoff: float = 0.01,
    bonferroni: bool = True,
    n: int = 500,
    by: str = "variance",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen expression rows, network and its statistics of one selection."""
    genes = matrix.filter_pvalue(matrix.align_genes(ordering, expr), cutoff, bonferroni)
    chosen = matrix.select_genes(genes, regulators, n, by)
    slim, edges = matrix.filter_expression(expr, chosen), matrix.filter_network(net, chosen)
    return slim, edges, matrix.network_stats(edges, slim)


def _columns(fn, names: list[str], keys: list[str] = KEYS, **fixed) -> Metric:
    """Metric from an operator that gives one column per metric."""

    def run(edges, gt, lists=None):
        known = {"lists": lists} if "lists" in inspect.signature(fn).parameters else {}
        wide = fn(edges, gt, **fixed, **known)
        values = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                           for n in names])
        run_id = F.col("run_id") if "run_id" in keys else F.lit(None).cast("string")
        return wide.select("dataset_id", run_id.alias("run_id"), "algorithm_id", F.inline(values))

    return run


def _signed_ratios(edges, gt, lists=None):
    rows = curves.signed_pr_roc(edges, gt, lists=lists)
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in RATIOS])
    return rows.select(*KEYS, "sign", F.inline(values)).select(
        *KEYS, F.concat_ws(":", "name", "sign").alias("metric"), "value"
    )


RATIOS = ["average_precision", "auroc", "average_precision_ratio", "auroc_ratio"]
ALGORITHM = ["dataset_id", "algorithm_id"]

register_metric("auprc", curves.auprc)
register_metric("auroc", curves.auroc)
register_metric("areas", _columns(curves.curve_areas, ["auprc", "auroc"]))
register_metric("pr_roc_ratio", _columns(curves.pr_roc_ratio, RATIOS))
register_metric("signed_pr_roc", _signed_ratios)
register_metric("epr", early.epr)
register_metric("signed_epr", early.signed_epr)
register_metric("early_pr", _columns(
    early.early_pr, ["early_precision", "early_recall", "early_precision_ratio"], kind="directed"))
register_metric("jaccard", _columns(stability.jaccard, ["median_jaccard", "mad_jaccard"], ALGORITHM))
register_metric("spearman", _columns(stability.spearman, ["median_spearman", "mad_spearman"], ALGORITHM))
register_metric("motif_ratios", _columns(graph.motif_ratios, graph.MOTIFS))
register_metric("path_stats", _columns(graph.path_stats, [
    "len_0", "len_2", "len_3", "len_4", "len_5", "num_pred", "num_tp", "num_fp_with_path",
    "num_fp_no_path"]))

for _kernel in association.KERNELS:
    register_network(
        _kernel,
        lambda expr, pt, kernel=_kernel: association.symmetric_edges(
            association.assoc(association.drop_silent(expr), kernel)
        ),
    )
register_network("pearson", lambda expr, pt: association.pearson_network(expr))
register_network("tree_rf", lambda expr, pt: trees.tree_network(expr, "rf"))
register_network("tree_gbt", lambda expr, pt: trees.tree_network(expr, "gbt"))
register_network("information", lambda expr, pt: networks.information_edges(expr))
register_network(
    "partial_spearman",
    lambda expr, pt: networks.gate_pvalue(networks.partial_spearman(expr), 0.01),
)
register_network(
    "lagged",
    lambda expr, pt: networks.merge_trajectories(networks.lagged_network(expr, pt), absolute=True),
)
