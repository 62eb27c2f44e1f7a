"""Run-to-run stability of an algorithm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.columns import ratio
from edgemeter.functions.gram import pair_products
from edgemeter.functions.ranking import rank_offsets
from edgemeter.operators.primitives import (
    best_signed,
    k_rows,
    known_lists,
    mark_universe,
    topk_ties,
    universe_sizes,
)
from edgemeter.schema import KEYS, PAIR
from edgemeter.session import checkpointed

ALGO = ["dataset_id", "algorithm_id"]


def _run_pairs(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair of runs of an algorithm, with `columns` of both; the inputs
    have one row per list."""
    a = runs.select(*ALGO, F.col("run_id").alias("item_a"),
                    *[F.col(c).alias(f"{c}_a") for c in columns])
    b = runs.select(*ALGO, F.col("run_id").alias("item_b"),
                    *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, ALGO).filter(F.col("item_a") < F.col("item_b"))


def _spread(pairs: DataFrame, algorithms: DataFrame, median: str, mad: str) -> DataFrame:
    """Median and mean absolute deviation around the mean, NULLs skipped."""
    mean = F.avg("value").over(Window.partitionBy(*ALGO))
    deviations = pairs.withColumn("_dev", F.abs(F.col("value") - mean))
    stats = deviations.groupBy(*ALGO).agg(
        F.median("value").alias(median), F.avg("_dev").alias(mad)
    )
    return algorithms.join(stats, ALGO, "left")


def jaccard_pairs(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(dataset_id, algorithm_id, item_a, item_b, value): Jaccard index of the
    top-k pair sets of two runs."""
    k = k_rows(gt)
    chosen = checkpointed(topk_ties(edges, k))  # read by sizes and overlaps
    lists = known_lists(edges, lists).join(k.select("dataset_id"), "dataset_id", "left_semi")
    sizes = lists.join(
        chosen.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size")), KEYS, "left"
    ).fillna(0, ["size"])
    shared = pair_products(
        chosen.select(*ALGO, "run_id", F.concat_ws("\t", *PAIR).alias("edge"), F.lit(1.0).alias("one")),
        ALGO, "run_id", "edge", "one",
    )
    pairs = _run_pairs(sizes, ["size"]).join(shared, [*ALGO, "item_a", "item_b"], "left")
    both = F.coalesce("dot", F.lit(0.0))
    union = F.col("size_a") + F.col("size_b") - both
    return pairs.select(*ALGO, "item_a", "item_b", ratio(both, union).alias("value"))


def jaccard(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(dataset_id, algorithm_id, median_jaccard, mad_jaccard); NULL with
    fewer than two runs. k counts ground-truth rows, repeats included. `lists`
    may name lists without rows; their top is empty."""
    algorithms = (
        known_lists(edges, lists).select(*ALGO).distinct()
        .join(k_rows(gt).select("dataset_id"), "dataset_id", "left_semi")
    )
    return _spread(jaccard_pairs(edges, gt, lists), algorithms, "median_jaccard", "mad_jaccard")


def _rank_offsets(edges: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, edge, d) and per-list sums.

    d is the mid-rank of a weight minus the mid-rank of zero, over the whole
    universe; absent pairs have d = 0, so sums over present pairs are complete.
    """
    weights = mark_universe(best_signed(edges), gt).filter(
        F.col("inside") & (F.col("weight") != 0)
    ).select(*KEYS, *PAIR, "weight")
    # Both are read twice below: by the ranks and by the rows that take them.
    weights = checkpointed(weights)
    ranked = checkpointed(
        rank_offsets(weights, KEYS, "weight", universe_sizes(gt), ["dataset_id"], "n_pairs")
    )
    n, d = F.col("n").cast("double"), F.col("d")
    sums = ranked.groupBy(*KEYS, "n_pairs").agg(
        F.sum(n * d).alias("s"), F.sum(n * d * d).alias("ss"),
        F.count(F.lit(1)).alias("_values"), F.first("present").alias("_present"),
    )
    varied = (F.col("_values") > 1) | (F.col("_present") < F.col("n_pairs"))
    rows = weights.join(ranked.select(*KEYS, "weight", "d"), [*KEYS, "weight"])
    return rows.select(*KEYS, F.concat_ws("\t", *PAIR).alias("edge"), "d"), sums.filter(varied)


def spearman_pairs(edges: DataFrame, gt: DataFrame) -> DataFrame:
    """(dataset_id, algorithm_id, item_a, item_b, value): rank correlation of
    two runs over all directed candidate pairs; constant lists are left out."""
    rows, sums = _rank_offsets(edges, gt)
    dots = pair_products(rows.select(*ALGO, "run_id", "edge", "d"), ALGO, "run_id", "edge", "d")
    pairs = _run_pairs(sums, ["n_pairs", "s", "ss"]).join(
        dots, [*ALGO, "item_a", "item_b"], "left"
    )
    n = F.col("n_pairs_a").cast("double")
    cov = F.coalesce("dot", F.lit(0.0)) - F.col("s_a") * F.col("s_b") / n
    var_a = F.col("ss_a") - F.col("s_a") * F.col("s_a") / n
    var_b = F.col("ss_b") - F.col("s_b") * F.col("s_b") / n
    return pairs.select(
        *ALGO, "item_a", "item_b", ratio(cov, F.sqrt(var_a) * F.sqrt(var_b)).alias("value")
    )


def spearman(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(dataset_id, algorithm_id, median_spearman, mad_spearman); NULL with
    fewer than two usable runs. A list without rows is constant, so left out."""
    algorithms = (
        known_lists(edges, lists).select(*ALGO).distinct()
        .join(gt.select("dataset_id").distinct(), "dataset_id", "left_semi")
    )
    return _spread(spearman_pairs(edges, gt), algorithms, "median_spearman", "mad_spearman")
