"""Rank-aggregated consensus over algorithms and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgemeter.functions.columns import ratio, valid_number
from edgemeter.functions.joins import salted_join
from edgemeter.functions.ranking import global_rank
from edgemeter.operators.primitives import not_self
from edgemeter.schema import KEYS, PAIR

RUN = ["dataset_id", "run_id"]
METHODS = ["mean", "median", "min", "max"]
COLUMNS = {"mean": "borda", "median": "mborda", "min": "sborda", "max": "smborda"}


def _middle(column: str) -> Column:
    """Median of a sorted array."""
    size = F.size(column)
    lower = F.element_at(column, F.floor((size + 1) / 2).cast("int"))
    upper = F.element_at(column, F.floor(size / 2).cast("int") + 1)
    return (lower + upper) / 2


def borda_scores(edges: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(dataset_id, run_id, gene1, gene2, mean, median, min, max) of the Borda
    scores of an edge over the algorithms of one run.

    Rank 1 is the largest signed weight, earlier rows first among equals; a
    repeated edge keeps its worst rank; an absent edge ranks one past the end
    of the list. `lists` may name lists without rows: every edge is absent there.
    """
    rows = edges.filter(not_self() & valid_number("weight"))
    ranked = global_rank(rows, KEYS, "weight", "ord")
    worst = ranked.groupBy(*KEYS, *PAIR).agg(F.max("rank").alias("rank"))
    # An algorithm has few entries per edge and per run: one each.
    present = worst.groupBy(*RUN, *PAIR).agg(
        F.map_from_entries(F.collect_list(F.struct("algorithm_id", "rank"))).alias("_ranks")
    )
    # Counted from the rows, not from `present`, which would rank everything twice.
    n_edges = rows.select(*RUN, *PAIR).distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"))
    lengths = edges.groupBy(*KEYS).agg(
        F.count_if(not_self() & valid_number("weight")).alias("_len")
    )
    if lists is not None:
        none = lists.select(*KEYS, F.lit(0).cast("long").alias("_len"))
        lengths = lengths.unionByName(none).groupBy(*KEYS).agg(F.max("_len").alias("_len"))
    algorithms = lengths.groupBy(*RUN).agg(
        F.collect_list(F.struct("algorithm_id", "_len")).alias("_algos")
    )
    joined = salted_join(present, algorithms.join(n_edges, RUN), RUN, PAIR)
    scores = F.sort_array(
        F.transform(
            "_algos",
            lambda a: (
                F.col("_n")
                + 1
                - F.coalesce(F.col("_ranks")[a["algorithm_id"]], a["_len"] + 1)
            ).cast("double"),
        )
    )
    joined = joined.select(*RUN, *PAIR, scores.alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + x)
    return joined.select(
        *RUN,
        *PAIR,
        (total / F.size("_s")).alias("mean"),
        _middle("_s").alias("median"),
        F.element_at("_s", 1).alias("min"),
        F.element_at("_s", -1).alias("max"),
    )


def borda(edges: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(dataset_id, gene1, gene2, borda, mborda, sborda, smborda): median over
    runs, then min-max scaled to [0, 1] per dataset (0 when constant)."""
    # One entry per run; sorting the short arrays is cheaper than four medians.
    runs = borda_scores(edges, lists).groupBy("dataset_id", *PAIR).agg(
        F.collect_list(F.struct(*METHODS)).alias("_r")
    )
    sorted_runs = runs.select(
        "dataset_id", *PAIR, *[F.sort_array(F.col("_r")[m]).alias(m) for m in METHODS]
    )
    medians = sorted_runs.select("dataset_id", *PAIR, *[_middle(m).alias(m) for m in METHODS])
    bounds = medians.groupBy("dataset_id").agg(
        *[F.min(m).alias(f"_lo_{m}") for m in METHODS],
        *[F.max(m).alias(f"_hi_{m}") for m in METHODS],
    )
    joined = salted_join(medians, bounds, ["dataset_id"], PAIR)
    scaled = [
        F.coalesce(
            ratio(F.col(m) - F.col(f"_lo_{m}"), F.col(f"_hi_{m}") - F.col(f"_lo_{m}")), F.lit(0.0)
        ).alias(COLUMNS[m])
        for m in METHODS
    ]
    return joined.select("dataset_id", *PAIR, *scaled)
