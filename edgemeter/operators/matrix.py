"""Expression reshaping, gene selection, network selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.columns import ratio
from edgemeter.functions.joins import salted_join
from edgemeter.functions.ranking import (
    HASH_BITS,
    exact_percentiles,
    global_rank,
    pair_hash,
)
from edgemeter.operators.primitives import not_self
from edgemeter.schema import CELL_KEYS, PAIR

TRAJECTORY = [*CELL_KEYS, "trajectory"]


def transpose(expr: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """Cells by genes, wide; the long form itself has no orientation."""
    return expr.groupBy(*CELL_KEYS, "cell").pivot("gene", genes).agg(F.first("value"))


def by_trajectory(expr: DataFrame, pt: DataFrame) -> DataFrame:
    """(dataset_id, run_id, trajectory, gene, cell, value, t): expression of the
    cells on each trajectory, with their pseudotime."""
    return expr.join(pt, [*CELL_KEYS, "cell"]).select(
        *TRAJECTORY, "gene", "cell", "value", "t"
    )


def order_cells(pt: DataFrame) -> DataFrame:
    """Add `cell_index` (0-based) by pseudotime within each trajectory; ties by
    a hash of the cell name."""
    ranked = global_rank(
        pt.withColumn("_tie", pair_hash("cell")), TRAJECTORY, "t", "_tie",
        descending=False, bits=HASH_BITS,
    )
    return ranked.select(*pt.columns, (F.col("rank") - 1).alias("cell_index"))


def ordered_expression(expr: DataFrame, pt: DataFrame) -> DataFrame:
    """`by_trajectory` with the `cell_index` of every cell."""
    return expr.join(order_cells(pt), [*CELL_KEYS, "cell"]).select(
        *TRAJECTORY, "gene", "cell", "value", "t", "cell_index"
    )


def _rounded(edge: Column, digits: Column) -> Column:
    """Interval label: `digits` decimals, or significant decimals below 1."""
    small = (F.abs(edge) < 1) & (edge != 0)
    places = F.when(small, digits - F.floor(F.log10(F.abs(edge))) - 1).otherwise(digits)
    scale = F.pow(F.lit(10.0), places)
    return F.rint(edge * scale) / scale


def quantile_bins(pt: DataFrame, n_bins: int, precision: int = 3) -> DataFrame:
    """Add `bin` and `bin_time`, the midpoint of the cell's quantile interval.

    Intervals are closed on the right and hold the smallest value; repeated
    edges merge. Interval ends are rounded to `precision` places, more when
    needed to keep them apart, and the lowest end is moved down by one unit.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = (
        exact_percentiles(pt, TRAJECTORY, "t", probs)
        .groupBy(*TRAJECTORY)
        .agg(F.sort_array(F.collect_set("q")).alias("_edges"))  # n_bins + 1 values
    )
    label_sets = F.transform(
        F.sequence(F.lit(precision), F.lit(19)),
        lambda d: F.struct(
            d.alias("d"), F.transform("_edges", lambda e: _rounded(e, d)).alias("ends")
        ),
    )
    distinct_sets = F.filter(
        label_sets, lambda s: F.size(F.array_distinct(s["ends"])) == F.size("_edges")
    )
    edges = edges.withColumn("_pick", F.element_at(distinct_sets, 1)).select(
        *TRAJECTORY, "_edges", F.col("_pick.ends").alias("_ends"),
        F.pow(F.lit(10.0), -F.col("_pick.d")).alias("_unit"),
    )
    placed = salted_join(pt, edges, TRAJECTORY, ["cell"])
    index = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col("t"))), F.lit(1))
    low = F.col("_ends")[index - 1] - F.when(index == 1, F.col("_unit")).otherwise(0.0)
    high = F.col("_ends")[index]
    return placed.select(
        *pt.columns, (index - 1).alias("bin"), ((low + high) / 2).alias("bin_time")
    )


def shift_time(pt: DataFrame) -> DataFrame:
    """Add `time`, pseudotime from 0, and `experiment`, 1 when not given."""
    starts = pt.groupBy(*TRAJECTORY).agg(F.min("t").alias("_t0"))
    out = salted_join(pt, starts, TRAJECTORY, ["cell"]).withColumn("time", F.col("t") - F.col("_t0"))
    given = F.col("experiment") if "experiment" in pt.columns else F.lit(1)
    return out.withColumn("experiment", given).drop("_t0")


def clean_gene(column: str = "gene") -> Column:
    """Drop the `x_` some tools put into gene names."""
    return F.replace(F.col(column), F.lit("x_"), F.lit(""))


def clean_cell(column: str = "cell") -> Column:
    return F.replace(F.col(column), F.lit("."), F.lit("_"))


def align_genes(ordering: DataFrame, expr: DataFrame) -> DataFrame:
    """Ordering rows whose gene is in the matrix of the dataset."""
    return ordering.join(expr.select("dataset_id", "gene").distinct(), ["dataset_id", "gene"], "left_semi")


def unexpressed_genes(ordering: DataFrame, expr: DataFrame) -> DataFrame:
    """The rows `align_genes` drops, for a warning."""
    return ordering.join(expr.select("dataset_id", "gene").distinct(), ["dataset_id", "gene"], "left_anti")


def filter_pvalue(ordering: DataFrame, cutoff: float = 0.01, bonferroni: bool = True) -> DataFrame:
    """Genes strictly below the cutoff, divided by the number of genes of the
    dataset for Bonferroni; a cutoff of 0 keeps all."""
    if cutoff == 0:
        return ordering
    if not bonferroni:
        return ordering.filter(F.col("pvalue") < cutoff)
    sizes = ordering.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_genes"))
    return (
        ordering.join(sizes, "dataset_id")
        .filter(F.col("pvalue") < F.lit(float(cutoff)) / F.col("_genes"))
        .drop("_genes")
    )


def select_genes(
    ordering: DataFrame, regulators: DataFrame | None = None, n: int = 500, by: str = "variance"
) -> DataFrame:
    """(dataset_id, gene): all regulators in `ordering` plus the top `n` of the
    others, by variance descending or p-value ascending, ties by name.

    `ordering` should have passed `align_genes` and `filter_pvalue`.
    """
    if by not in ("variance", "pvalue"):
        raise ValueError("by must be 'variance' or 'pvalue'")
    genes = ordering
    chosen = None
    if regulators is not None:
        named = regulators.select("dataset_id", "gene").distinct()
        chosen = ordering.join(named, ["dataset_id", "gene"], "left_semi").select("dataset_id", "gene")
        genes = ordering.join(named, ["dataset_id", "gene"], "left_anti")
    first = F.desc("variance") if by == "variance" else F.asc("pvalue")
    order = Window.partitionBy("dataset_id").orderBy(first, "gene")
    # The limit is pushed below the exchange as a per-task group limit.
    top = genes.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    top = top.select("dataset_id", "gene")
    return (top if chosen is None else top.unionByName(chosen)).distinct()


def filter_expression(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """Matrix rows of the chosen genes."""
    return expr.join(genes.select("dataset_id", "gene").distinct(), ["dataset_id", "gene"], "left_semi")


def filter_network(net: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges between chosen genes, without self-loops and repeated rows."""
    chosen = genes.select("dataset_id", "gene").distinct()
    rows = net.filter(not_self())
    for end in PAIR:
        rows = rows.join(chosen.withColumnRenamed("gene", end), ["dataset_id", end], "left_semi")
    return rows.select(*net.columns).distinct()


def network_stats(net: DataFrame, expr: DataFrame) -> DataFrame:
    """(dataset_id, n_sources, n_genes, n_edges, density) of a filtered
    network, counting only genes of the matrix."""
    expressed = expr.select("dataset_id", "gene").distinct()
    roles = net.select(
        "dataset_id",
        F.explode(F.array(
            F.struct(F.col("gene1").alias("gene"), F.lit(1).alias("source")),
            F.struct(F.col("gene2").alias("gene"), F.lit(0).alias("source")),
        )).alias("_r"),
    ).groupBy("dataset_id", F.col("_r.gene").alias("gene")).agg(F.max("_r.source").alias("source"))
    counts = roles.join(expressed, ["dataset_id", "gene"], "left_semi").groupBy("dataset_id").agg(
        F.sum("source").alias("n_sources"), F.count(F.lit(1)).alias("n_genes")
    )
    edges = net.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_edges"))
    joined = edges.join(counts, "dataset_id", "left")
    n, s = F.col("n_genes"), F.col("n_sources")
    return joined.select(
        "dataset_id", "n_sources", "n_genes", "n_edges", ratio("n_edges", s * n - s).alias("density")
    )
