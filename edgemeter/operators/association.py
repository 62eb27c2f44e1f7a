"""Gene-gene association kernels, matrix to weighted pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.functions.columns import ratio, valid_number
from edgemeter.functions.gram import block_pairs, pair_products
from edgemeter.functions.joins import salted_join, spread_by
from edgemeter.functions.kernels import zero_inflated
from edgemeter.functions.ranking import HASH_BITS, exact_percentiles, global_rank, pair_hash
from edgemeter.operators.preprocess import GENE, cell_counts, shifted
from edgemeter.schema import CELL_KEYS, PAIR
from edgemeter.session import checkpointed

KERNELS = ("dotprod", "correlation", "proprho", "zikendall")
SERIES_ITEMS = 32
SERIES_VALUES = 2_000_000


def drop_silent(expr: DataFrame) -> DataFrame:
    """Rows of genes with any non-zero value."""
    loud = expr.groupBy(*GENE).agg(F.count_if(F.col("value") != 0).alias("_k"))
    return expr.join(loud.filter(F.col("_k") > 0).select(*GENE), GENE, "left_semi")


def _products(expr: DataFrame, value: str = "value") -> DataFrame:
    return pair_products(
        expr.select(*CELL_KEYS, "gene", "cell", value), CELL_KEYS, "gene", "cell", value, True
    )


def _with_both(pairs: DataFrame, per_gene: DataFrame, columns: list[str]) -> DataFrame:
    """Attach per-gene columns to item_a and item_b; a gene occurs once per
    other gene, so neither side is skewed."""
    for end in ("a", "b"):
        side = per_gene.select(
            *CELL_KEYS, F.col("gene").alias(f"item_{end}"),
            *[F.col(c).alias(f"{c}_{end}") for c in columns],
        )
        pairs = pairs.join(side, [*CELL_KEYS, f"item_{end}"])
    return pairs


def _named(pairs: DataFrame, weight, diagonal: bool) -> DataFrame:
    out = pairs if diagonal else pairs.filter(F.col("item_a") != F.col("item_b"))
    return out.select(
        *CELL_KEYS, F.col("item_a").alias("gene1"), F.col("item_b").alias("gene2"),
        weight.alias("weight"),
    )


def _centred_pairs(expr: DataFrame) -> DataFrame:
    """Pairs with n, the co-moment `cov` and moments `var_a`, `var_b` (all
    times n); absent entries count as zeros."""
    ends = expr.groupBy(*GENE).agg(
        F.max("value").alias("top"), F.min("value").alias("low"), F.count(F.lit(1)).alias("k")
    )
    values = shifted(expr)
    sums = values.groupBy(*GENE).agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    ).join(ends, GENE)
    pairs = _with_both(_products(values), sums, ["s", "ss", "top", "low", "k"])
    pairs = pairs.join(cell_counts(expr), CELL_KEYS)
    n = F.col("n_cells").cast("double")
    out = pairs.withColumn("cov", F.col("dot") - F.col("s_a") * F.col("s_b") / n)
    for end in ("a", "b"):
        # A constant gene has no spread; sums alone may leave a rounding error.
        full = F.col(f"k_{end}") == F.col("n_cells")
        top = F.when(full, F.col(f"top_{end}")).otherwise(F.greatest(f"top_{end}", F.lit(0.0)))
        low = F.when(full, F.col(f"low_{end}")).otherwise(F.least(f"low_{end}", F.lit(0.0)))
        spread = F.col(f"ss_{end}") - F.col(f"s_{end}") * F.col(f"s_{end}") / n
        out = out.withColumn(f"var_{end}", F.when(top > low, spread)).withColumn(
            f"top_{end}", top
        )
    return out


def dotprod(expr: DataFrame, diagonal: bool = False) -> DataFrame:
    return _named(_products(expr), F.col("dot"), diagonal)


def correlation(expr: DataFrame, diagonal: bool = False) -> DataFrame:
    """Pearson correlation over all cells; NULL for a constant gene."""
    pairs = _centred_pairs(expr)
    r = ratio("cov", F.sqrt("var_a") * F.sqrt("var_b"))
    return _named(pairs, r, diagonal)


def pearson_network(expr: DataFrame) -> DataFrame:
    """Both directions of every pair with a defined correlation, on genes
    divided by their maximum (a negative maximum turns the sign)."""
    pairs = _centred_pairs(expr)
    turn = F.when((F.col("top_a") < 0) != (F.col("top_b") < 0), -1.0).otherwise(1.0)
    r = turn * ratio("cov", F.sqrt("var_a") * F.sqrt("var_b"))
    return both_directions(_named(pairs, r, False).filter(F.col("weight").isNotNull()))


def proprho(expr: DataFrame, diagonal: bool = False) -> DataFrame:
    """Proportionality of log values centred per cell; zeros take the smallest
    non-zero value of the matrix.

    Logs are taken relative to that smallest value, which leaves zeros at 0 and
    drops out in the centring, so the sparse form stays exact.
    """
    bad = F.isnan("value") | F.col("value").isNull() | (F.col("value") < 0)
    checked = expr.withColumn(
        "value",
        F.when(bad, F.raise_error(F.lit("proportionality needs non-negative numbers"))).otherwise(
            F.col("value")
        ),
    )
    present = checked.filter(F.col("value") > 0)
    floors = present.groupBy(*CELL_KEYS).agg(F.min("value").alias("_min"))
    logs = salted_join(present, floors, CELL_KEYS, ["gene", "cell"]).withColumn(
        "y", F.ln("value") - F.ln("_min")
    )
    genes = expr.select(*GENE).distinct()
    n_genes = genes.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("n_genes"))
    means = (
        logs.groupBy(*CELL_KEYS, "cell").agg(F.sum("y").alias("_y"))
        .join(n_genes, CELL_KEYS)
        .select(*CELL_KEYS, "cell", (F.col("_y") / F.col("n_genes")).alias("m"))
    )
    cells = means.groupBy(*CELL_KEYS).agg(
        F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("smm")
    ).join(cell_counts(expr), CELL_KEYS)
    per_gene = logs.join(means, [*CELL_KEYS, "cell"]).groupBy(*GENE).agg(
        F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"),
        F.sum(F.col("y") * F.col("m")).alias("ym"),
    )
    # A silent gene has y = 0 everywhere but is still a row of the matrix.
    per_gene = genes.join(per_gene, GENE, "left").fillna(0.0, ["s", "ss", "ym"])
    silent = genes.select(*GENE, F.lit("\x00").alias("cell"), F.lit(0.0).alias("y"))
    dots = _products(logs.select(*GENE, "cell", "y").unionByName(silent), "y")
    pairs = _with_both(dots, per_gene, ["s", "ss", "ym"]).join(cells, CELL_KEYS)
    n, sm, smm = F.col("n_cells").cast("double"), F.col("sm"), F.col("smm")

    def moment(product, ym1, ym2, s1, s2):
        return product - ym1 - ym2 + smm - (s1 - sm) * (s2 - sm) / n

    c = F.col
    cov = moment(c("dot"), c("ym_a"), c("ym_b"), c("s_a"), c("s_b"))
    var_a = moment(c("ss_a"), c("ym_a"), c("ym_a"), c("s_a"), c("s_a"))
    var_b = moment(c("ss_b"), c("ym_b"), c("ym_b"), c("s_b"), c("s_b"))
    rho = F.when(c("item_a") == c("item_b"), 1.0).otherwise(ratio(2 * cov, var_a + var_b))
    return _named(pairs, rho, diagonal)


# ---- kernels over whole series of two genes ---------------------------------


def series_pairs(rows: DataFrame, group: list[str], feature: str) -> DataFrame:
    """Pack each gene's sparse series and send it to its block pairs.

    A block holds at most SERIES_ITEMS genes and, but for a single long series,
    SERIES_VALUES values.
    """
    sizes = rows.groupBy(*group).agg(
        F.approx_count_distinct("gene").alias("_g"),
        F.approx_count_distinct(feature).alias("_n"),
    )
    per_block = F.greatest(
        F.lit(1), F.least(F.lit(SERIES_ITEMS), F.floor(F.lit(SERIES_VALUES) / F.col("_n")))
    )
    sizes = sizes.select(*group, F.ceil(F.col("_g") / per_block).cast("int").alias("_blocks"))
    series = rows.groupBy(*group, "gene").agg(
        F.collect_list(F.struct(F.col(feature).alias("f"), F.col("value").alias("v"))).alias("_e")
    )
    placed = salted_join(series, sizes, group, ["gene"]).select(
        *group, "_blocks", "gene", F.pmod(F.xxhash64("gene"), F.col("_blocks")).cast("int").alias("_b"),
        F.col("_e.f").alias("_f"), F.col("_e.v").alias("_v"),
    )
    return block_pairs(placed)


def zikendall(expr: DataFrame, diagonal: bool = False) -> DataFrame:
    """Zero-inflated Kendall association."""
    present = expr.filter(F.col("value") != 0).select(*GENE, "cell", "value")
    counts = expr.groupBy(*GENE).agg(F.count_if(F.col("value") != 0).alias("k"))
    # A zero on one extra feature gives genes without any value a series too.
    anchors = counts.select(*GENE, F.lit("\x00").alias("cell"), F.lit(0.0).alias("value"))
    schema = ", ".join(f"{k} string" for k in CELL_KEYS) + (
        ", item_a string, item_b string, n11 long, tau double, p1_ab double, p1_ba double"
    )
    where = [*CELL_KEYS, "_lo", "_hi"]
    pairs = (
        spread_by(series_pairs(present.unionByName(anchors), CELL_KEYS, "cell"), *where)
        .groupBy(*where)
        .applyInPandas(lambda pdf: zero_inflated(pdf, CELL_KEYS), schema)
    )
    if diagonal:
        own = counts.select(
            *CELL_KEYS, F.col("gene").alias("item_a"), F.col("gene").alias("item_b"),
            F.col("k").alias("n11"), F.lit(1.0).alias("tau"), F.lit(0.0).alias("p1_ab"),
            F.lit(0.0).alias("p1_ba"),
        )
        pairs = pairs.unionByName(own)
    pairs = _with_both(pairs, counts, ["k"]).join(cell_counts(expr), CELL_KEYS)
    n = F.col("n_cells").cast("double")
    p11 = F.col("n11") / n
    p10, p01 = (F.col("k_a") - F.col("n11")) / n, (F.col("k_b") - F.col("n11")) / n
    p00 = F.lit(1.0) - p11 - p10 - p01
    weight = (
        p11 * p11 * F.col("tau")
        + 2 * (p00 * p11 - p01 * p10)
        + 2 * p11 * (p10 * (1 - 2 * F.col("p1_ab")) + p01 * (1 - 2 * F.col("p1_ba")))
    )
    return _named(pairs, weight, diagonal)


def assoc(expr: DataFrame, kernel: str, diagonal: bool = False) -> DataFrame:
    """(dataset_id, run_id, gene1, gene2, weight) for gene1 < gene2."""
    known = {"dotprod": dotprod, "correlation": correlation, "proprho": proprho,
             "zikendall": zikendall}
    if kernel not in known:
        raise ValueError(f"kernel must be one of {KERNELS}, got {kernel!r}")
    return known[kernel](expr, diagonal)


# ---- edge tables from kernels -----------------------------------------------


def both_directions(upper: DataFrame) -> DataFrame:
    """Every pair and its mirror image, in one pass."""
    ends = F.array(F.struct("gene1", "gene2"), F.struct(
        F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2")))
    rest = [c for c in upper.columns if c not in PAIR]
    return upper.select(*rest, F.inline(ends)).select(*upper.columns)


def symmetric_edges(upper: DataFrame) -> DataFrame:
    """Scale by the largest absolute weight of the matrix, write both
    directions, drop zeros."""
    tops = upper.groupBy(*CELL_KEYS).agg(F.max(F.abs("weight")).alias("_top"))
    scaled = salted_join(upper.filter(valid_number("weight") & (F.col("weight") != 0)), tops,
                         CELL_KEYS, PAIR)
    scaled = scaled.withColumn("weight", ratio("weight", "_top")).select(*CELL_KEYS, *PAIR, "weight")
    return both_directions(scaled)


def edge_density(upper: DataFrame, expr: DataFrame) -> DataFrame:
    """(dataset_id, run_id, density): non-zero pairs over all gene pairs."""
    n = expr.select(*GENE).distinct().groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("_g"))
    found = upper.groupBy(*CELL_KEYS).agg(F.count_if(F.col("weight") != 0).alias("_k"))
    pairs = F.col("_g") * (F.col("_g") - 1) / F.lit(2.0)
    return n.join(found, CELL_KEYS, "left").select(
        *CELL_KEYS, ratio(F.coalesce("_k", F.lit(0)), pairs).alias("density")
    )


def clr(edges: DataFrame) -> DataFrame:
    """Rescale each weight against its row and its column: z-scores with
    negatives set to 0, combined as a root of squares."""
    out = edges
    for end in PAIR:
        stats = edges.groupBy(*CELL_KEYS, end).agg(
            F.avg("weight").alias("_m"), F.stddev_samp("weight").alias("_sd")
        )
        z = F.greatest(F.lit(0.0), ratio(F.col("weight") - F.col("_m"), "_sd"))
        out = (
            out.join(stats, [*CELL_KEYS, end])
            .withColumn(f"_z_{end}", F.coalesce(z, F.lit(0.0)))
            .drop("_m", "_sd")
        )
    weight = F.sqrt(F.col("_z_gene1") ** 2 + F.col("_z_gene2") ** 2)
    return out.select(*CELL_KEYS, *PAIR, weight.alias("weight"))


def rank_edges(edges: DataFrame, algorithm_id: str, signed: bool = False) -> DataFrame:
    """Turn pairs into a ranked list (keys, ord, gene1, gene2, weight), by
    absolute weight unless `signed`; equal weights by a hash of the pair."""
    rows = edges.withColumn("algorithm_id", F.lit(algorithm_id)).withColumn(
        "_by", F.col("weight") if signed else F.abs("weight")
    ).withColumn("_tie", pair_hash(*PAIR))
    ranked = global_rank(rows, [*CELL_KEYS, "algorithm_id"], "_by", "_tie", bits=HASH_BITS)
    return ranked.select(
        *CELL_KEYS, "algorithm_id", (F.col("rank") - 1).alias("ord"), *PAIR, "weight"
    )


# ---- surrogates -------------------------------------------------------------


def surrogates(expr: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """`expr` k times with the values of each cell shuffled over the genes, and
    a column `replicate`.

    The order of the genes comes from a seeded hash, so lost tasks redo the
    same shuffle. A cell's arrays are bounded by the number of genes.
    """
    genes = expr.select(*GENE).distinct().groupBy(*CELL_KEYS).agg(
        F.sort_array(F.collect_list("gene")).alias("_genes")
    )
    cells = expr.filter(F.col("value") != 0).groupBy(*CELL_KEYS, "cell").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("gene", "value"))),
                    lambda x: x["value"]).alias("_values")
    )
    rows = salted_join(cells, genes, CELL_KEYS, ["cell"]).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    shuffled = F.sort_array(F.transform("_genes", lambda g: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), "cell", g)
              .cast("binary")).alias("h"), g.alias("gene"))))
    picked = F.slice(shuffled, 1, F.size("_values"))
    return rows.select(
        *CELL_KEYS, "replicate", "cell", F.inline(F.arrays_zip(
            F.transform(picked, lambda s: s["gene"]).alias("gene"), F.col("_values").alias("value")))
    )


def surrogate_associations(expr: DataFrame, kernel: str, k: int, seed: int = 0) -> DataFrame:
    """(dataset_id, run_id, replicate, gene1, gene2, weight): the kernel on
    every shuffled copy, all copies in one job."""
    shuffled = surrogates(expr, k, seed)
    # A zero per gene and copy, on a cell that exists, keeps silenced genes in.
    anchors = expr.groupBy(*GENE).agg(F.min("cell").alias("cell")).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    cells = expr.select(*CELL_KEYS, "cell").distinct().withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    some_gene = expr.groupBy(*CELL_KEYS).agg(F.min("gene").alias("gene"))
    anchors = anchors.unionByName(cells.join(some_gene, CELL_KEYS))
    full = (
        shuffled.unionByName(anchors.withColumn("value", F.lit(0.0)), allowMissingColumns=True)
        .groupBy(*GENE, "replicate", "cell")
        .agg(F.sum("value").alias("value"))
    )
    marked = full.withColumn(
        "run_id", F.concat_ws("\x01", "run_id", F.col("replicate").cast("string"))
    ).drop("replicate")
    # A kernel reads its input several times; shuffle the copies once.
    marked = checkpointed(marked)
    parts = F.split("run_id", "\x01")
    return assoc(marked, kernel).select(
        "dataset_id", parts[0].alias("run_id"), parts[1].cast("int").alias("replicate"),
        *PAIR, "weight",
    )


def surrogate_thresholds(
    expr: DataFrame, kernel: str, k: int, neg: list[float], pos: list[float], seed: int = 0
) -> DataFrame:
    """(dataset_id, run_id, place, neg_threshold, pos_threshold): median over
    the copies of the two percentiles (0-100) of the associations, for each
    (neg, pos) pair."""
    if len(neg) != len(pos):
        raise ValueError("neg and pos must have the same length")
    rows = surrogate_associations(expr, kernel, k, seed)
    probs = [p / 100 for p in [*neg, *pos]]
    cuts = exact_percentiles(
        rows.filter(valid_number("weight")), [*CELL_KEYS, "replicate"], "weight", probs
    )
    medians = cuts.groupBy(*CELL_KEYS, "prob_ix").agg(F.median("q").alias("q"))
    place = F.col("prob_ix") % len(neg)
    return medians.groupBy(*CELL_KEYS, place.cast("int").alias("place")).agg(
        F.max(F.when(F.col("prob_ix") < len(neg), F.col("q"))).alias("neg_threshold"),
        F.max(F.when(F.col("prob_ix") >= len(neg), F.col("q"))).alias("pos_threshold"),
    )
