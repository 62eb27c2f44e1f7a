"""Cleaning and normalising of raw expression tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.columns import hash_unit
from edgemeter.functions.joins import salted_join
from edgemeter.functions.krylov import leading_vectors
from edgemeter.functions.ranking import HASH_BITS, exact_percentiles, global_rank, pair_hash
from edgemeter.operators.matrix import by_trajectory, clean_cell
from edgemeter.schema import CELL_KEYS
from edgemeter.session import checkpointed

GENE = [*CELL_KEYS, "gene"]


def cell_counts(expr: DataFrame) -> DataFrame:
    """(dataset_id, run_id, n_cells): distinct cells of each matrix."""
    return expr.select(*CELL_KEYS, "cell").distinct().groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n_cells")
    )


def collapse_transcripts(expr: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sum transcripts to genes. `symbols` is (transcript, symbol); the version
    after the first dot is ignored and unmapped transcripts are dropped."""
    named = expr.withColumn("transcript", F.split("gene", r"\.")[0])
    known = symbols.filter(F.col("symbol").isNotNull())
    mapped = named.join(known, "transcript")
    return mapped.groupBy(*CELL_KEYS, F.col("symbol").alias("gene"), "cell").agg(
        F.sum("value").alias("value")
    )


def filter_detected(
    expr: DataFrame,
    min_expr: float = 0.1,
    min_frac: float | None = 0.1,
    min_cells: int | None = None,
) -> DataFrame:
    """Genes seen in enough cells: above `min_expr` in a share of at least
    `min_frac`, or at least `min_expr` in at least `min_cells` cells."""
    if min_cells is not None:
        kept = expr.groupBy(*GENE).agg(F.count_if(F.col("value") >= min_expr).alias("_seen"))
        kept = kept.filter(F.col("_seen") >= min_cells)
    else:
        kept = expr.groupBy(*GENE).agg(F.count_if(F.col("value") > min_expr).alias("_seen"))
        kept = kept.join(cell_counts(expr), CELL_KEYS).filter(
            F.col("_seen") >= F.lit(float(min_frac)) * F.col("n_cells")
        )
    return expr.join(kept.select(*GENE), GENE, "left_semi")


def log2p1(expr: DataFrame, already_log: bool = False) -> DataFrame:
    return expr if already_log else expr.withColumn("value", F.log2(F.col("value") + 1))


def size_factors(expr: DataFrame) -> DataFrame:
    """(dataset_id, run_id, cell, size_factor): median over genes of value over
    the gene's geometric mean; genes with a zero in any cell do not count."""
    positive = expr.filter(F.col("value") > 0)
    means = (
        positive.groupBy(*GENE)
        .agg(F.avg(F.ln("value")).alias("_log"), F.count(F.lit(1)).alias("_n"))
        .join(cell_counts(expr), CELL_KEYS)
        .filter(F.col("_n") == F.col("n_cells"))
        .select(*GENE, "_log")
    )
    ratios = positive.join(means, GENE)
    # One value per gene, so a cell's group is bounded by the gene count.
    return ratios.groupBy(*CELL_KEYS, "cell").agg(
        F.median(F.col("value") / F.exp("_log")).alias("size_factor")
    )


def median_ratio_normalize(expr: DataFrame) -> DataFrame:
    """Divide every cell by its size factor."""
    joined = expr.join(size_factors(expr), [*CELL_KEYS, "cell"])
    return joined.withColumn("value", F.col("value") / F.col("size_factor")).drop("size_factor")


def gene_variance(expr: DataFrame) -> DataFrame:
    """(dataset_id, run_id, gene, variance): sample variance over all cells of
    the matrix; absent entries are zeros."""
    sums = expr.groupBy(*GENE).agg(
        F.count(F.lit(1)).cast("double").alias("_k"),
        F.avg("value").alias("_m"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("_v"),
    )
    n, k, m = F.col("n_cells").cast("double"), F.col("_k"), F.col("_m")
    # Squares around the mean of the present values, moved to the overall mean.
    squares = F.col("_v") * (k - 1) + m * m * k * (n - k) / n
    return sums.join(cell_counts(expr), CELL_KEYS).select(
        *GENE, F.try_divide(squares, n - 1).alias("variance")
    )


def rank_variance(expr: DataFrame) -> DataFrame:
    """`gene_variance` with `rank`, largest first, ties by a hash of the name."""
    rows = gene_variance(expr).withColumn("_tie", pair_hash("gene"))
    return global_rank(rows, CELL_KEYS, "variance", "_tie", bits=HASH_BITS).drop("_tie")


def shifted(expr: DataFrame) -> DataFrame:
    """Values less their gene's mean, for genes that are present in every cell.

    Products of such values do not cancel when means are large. Genes with
    absent cells (zeros) keep their values, so absent still means 0.
    """
    means = expr.groupBy(*GENE).agg(F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_k"))
    shift = F.when(F.col("_k") == F.col("n_cells"), F.col("_mean")).otherwise(0.0)
    means = means.join(cell_counts(expr), CELL_KEYS).select(*GENE, shift.alias("_shift"))
    return expr.join(means, GENE).withColumn("value", F.col("value") - F.col("_shift")).drop("_shift")


def pca(expr: DataFrame, k: int = 3) -> DataFrame:
    """(dataset_id, run_id, cell, pc1..pck) of centred, unscaled expression of
    every matrix; each component points to its largest loading.

    The loadings come from a block Krylov search over tiles of genes and cells;
    a task never holds more of a matrix than one tile. Where fewer than k
    components exist, the rest are 0.
    """
    values = shifted(expr).select(*GENE, "cell", "value")
    means = values.groupBy(*GENE).agg(F.sum("value").alias("_s")).join(cell_counts(expr), CELL_KEYS)
    # The row of means counts negative: X'X less this part is the centred product.
    mean_row = means.select(
        *GENE, F.lit("").alias("cell"), (F.col("_s") / F.sqrt("n_cells")).alias("value"),
        F.lit(True).alias("_minus"),
    )
    rows = values.withColumn("_minus", F.lit(False)).unionByName(mean_row)
    found = leading_vectors(rows, CELL_KEYS, "gene", "cell", "value", "_minus", k)
    loads = [f"l{i + 1}" for i in range(k)]
    signs = found.groupBy(*CELL_KEYS).agg(*[
        F.signum(F.max_by(F.get("vector", i), F.abs(F.get("vector", i)))).alias(f"_up{i}")
        for i in range(k)
    ])
    means = means.select(*GENE, (F.col("_s") / F.col("n_cells")).alias("mean"))
    loadings = salted_join(found.join(means, GENE), signs, CELL_KEYS, ["gene"]).select(
        *GENE, "mean", *[(F.get("vector", i) * F.col(f"_up{i}")).alias(c) for i, c in enumerate(loads)]
    )
    loadings = checkpointed(loadings)  # read for the scores and for their offsets
    offsets = loadings.groupBy(*CELL_KEYS).agg(
        *[F.sum(F.col("mean") * F.col(c)).alias(f"o{c}") for c in loads]
    )
    scores = values.join(loadings, GENE).groupBy(*CELL_KEYS, "cell").agg(
        *[F.sum(F.col("value") * F.col(c)).alias(c) for c in loads]
    )
    return salted_join(scores, offsets, CELL_KEYS, ["cell"]).select(
        *CELL_KEYS, "cell",
        *[(F.col(c) - F.col(f"o{c}")).alias(f"pc{i + 1}") for i, c in enumerate(loads)],
    )


def name_token(column: str, pattern: str, position: int) -> Column:
    """The `position`-th token (1-based) of a cell name split at `pattern`."""
    return F.try_element_at(F.split(column, pattern), F.lit(position))


def recode(column: Column, table: dict[str, str]) -> Column:
    """Replace known labels, keep the others."""
    if not table:
        return column
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), column)


def first_marker(markers: list[str]) -> Column:
    """Name of the first marker column equal to 1, else 'Unknown'."""
    hits = [F.when(F.col(m) == 1, F.lit(m)) for m in markers]
    return F.coalesce(*hits, F.lit("Unknown"))


def per_lineage(expr: DataFrame, pt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expression of each lineage's cells, with cleaned cell names, and the
    gene variances recomputed on them; the run id carries the lineage."""
    rows = by_trajectory(expr, pt)
    lineage = F.concat_ws("-", "run_id", F.col("trajectory").cast("string"))
    cells = rows.select(
        "dataset_id", lineage.alias("run_id"), "gene", clean_cell().alias("cell"), "value"
    )
    return cells, gene_variance(cells)


def heat_slice(expr: DataFrame, pt: DataFrame, ordering: DataFrame, top: int = 15) -> DataFrame:
    """(dataset_id, run_id, trajectory, gene, gene_place, cell, t, value): the
    `top` genes of lowest p-value over the cells that have a pseudotime."""
    order = Window.partitionBy("dataset_id").orderBy("pvalue", "gene")
    genes = (
        ordering.withColumn("gene_place", F.row_number().over(order))
        .filter(F.col("gene_place") <= top)
        .select("dataset_id", "gene", "gene_place")
    )
    slim = expr.join(genes, ["dataset_id", "gene"])
    return slim.join(pt, [*CELL_KEYS, "cell"]).select(
        *CELL_KEYS, "trajectory", "gene", "gene_place", "cell", "t", "value"
    )


def sample_cells(expr: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Expression of `n` cells per matrix, chosen by a seeded hash; fails when a
    matrix has fewer."""
    cells = expr.select(*CELL_KEYS, "cell").distinct()
    short = cell_counts(expr).filter(F.col("n_cells") < n)
    if not short.isEmpty():
        raise ValueError(f"a matrix has fewer than {n} cells")
    keyed = cells.withColumn("_u", hash_unit(F.lit(str(seed)), "cell")).withColumn(
        "_tie", pair_hash("cell")
    )
    ranked = global_rank(keyed, CELL_KEYS, "_u", "_tie", descending=False, bits=HASH_BITS)
    chosen = ranked.filter(F.col("rank") <= n).select(*CELL_KEYS, "cell")
    return expr.join(chosen, [*CELL_KEYS, "cell"], "left_semi")


def dropout(
    expr: DataFrame, n: int, quantile: float, probability: float, seed: int = 0
) -> DataFrame:
    """Sample `n` cells, then zero values below the gene's quantile with the
    given probability. Draws are seeded hashes, so reruns agree."""
    rows = sample_cells(expr, n, seed)
    # Absent cells are zeros of the gene; one row stands for all of them.
    zeros = rows.groupBy(*GENE).agg((F.lit(n) - F.count(F.lit(1))).alias("_w"))
    zeros = zeros.filter("_w > 0").select(*GENE, F.lit(0.0).alias("value"), "_w")
    weighted = rows.select(*GENE, "value", F.lit(1).cast("long").alias("_w")).unionByName(zeros)
    cuts = exact_percentiles(weighted, GENE, "value", [quantile], "_w").select(
        *GENE, F.col("q").alias("_cut")
    )
    joined = rows.join(cuts, GENE)
    draw = hash_unit(F.lit(str(seed)), "gene", "cell")
    lost = (F.col("value") < F.col("_cut")) & (draw < probability)
    return joined.withColumn("value", F.when(lost, 0.0).otherwise(F.col("value"))).drop("_cut")


