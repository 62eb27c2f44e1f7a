"""Tree-importance networks: every gene regressed on all others, in one job per level.

The trees of all targets grow together, level by level. A task holds a chunk of
cells and a block of targets; it walks the cells down the trees found so far and
counts, for every node, candidate gene and bin, the cells and the sums of the
target. Spark adds these histograms over the chunks and picks each node's best
cut. The model so far travels to the tasks by block of targets; nothing is
fitted on the driver, which only starts the levels.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.joins import salted_join, spread_by
from edgemeter.functions.treekernels import histograms
from edgemeter.operators.networks import discretise
from edgemeter.operators.preprocess import GENE, cell_counts
from edgemeter.schema import CELL_KEYS, PAIR
from edgemeter.session import checkpointed

CHUNK_VALUES = 1 << 21
BLOCK_TARGETS = 32
SPLIT = "array<struct<target: int, tree: int, node: int, gene: int, bin: int, low: double, high: double>>"


def short_hash(column: str):
    """28 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 7), 16, 10).cast("long")


def _prepared(expr: DataFrame, bins: int, targets: list[str] | None, share: float | None):
    """(numbered genes, packed cells, blocks of targets), each written once."""
    number = F.row_number().over(Window.partitionBy(*CELL_KEYS).orderBy("gene")) - 1
    genes = checkpointed(
        expr.select(*GENE).distinct().select(
            *GENE, number.alias("place"), short_hash("gene").alias("hash"),
            (F.col("gene").isin(targets) if targets is not None else F.lit(True)).alias("wanted"))
    )
    sizes = genes.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("n_genes")).join(cell_counts(expr), CELL_KEYS)
    root = F.ceil(F.sqrt("n_genes")) if share is None else F.ceil(F.col("n_genes") * share)
    sizes = checkpointed(sizes.select(
        *CELL_KEYS, "n_cells",
        F.least(F.greatest(root, F.lit(1)), F.col("n_genes")).cast("int").alias("n_candidates"),
        F.ceil(F.col("n_cells") * F.col("n_genes") / CHUNK_VALUES).cast("int").alias("chunks"),
        F.ceil(F.col("n_genes") / BLOCK_TARGETS).cast("int").alias("blocks"),
    ))
    values = expr.filter(F.col("value") != 0).join(discretise(expr, bins), [*GENE, "cell"])
    values = values.join(genes.select(*GENE, "place"), GENE)
    # A cell without any value still counts in every tree.
    cells = expr.select(*CELL_KEYS, "cell").distinct().join(
        values.groupBy(*CELL_KEYS, "cell").agg(F.collect_list(
            F.struct("place", (F.col("bin") + 1).alias("bin"), "value")).alias("held")),
        [*CELL_KEYS, "cell"], "left")
    packed = salted_join(cells, sizes.select(*CELL_KEYS, "chunks"), CELL_KEYS, ["cell"]).select(
        *CELL_KEYS, short_hash("cell").alias("hash"),
        F.pmod(F.xxhash64("cell"), F.col("chunks")).cast("int").alias("chunk"),
        *[F.coalesce(F.col(f"held.{field}"), F.array().cast(kind)).alias(name) for field, name, kind in (
            ("place", "genes", "array<int>"), ("bin", "bins", "array<int>"), ("value", "values", "array<double>"))],
    )
    listed = genes.groupBy(*CELL_KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("listed"))
    blocks = genes.filter("wanted").groupBy(
        *CELL_KEYS, F.floor(F.col("place") / BLOCK_TARGETS).cast("int").alias("block")
    ).agg(F.collect_list("place").alias("targets"))
    blocks = salted_join(
        salted_join(blocks, sizes.select(*CELL_KEYS, "n_candidates", "chunks"), CELL_KEYS, ["block"]),
        listed.select(*CELL_KEYS, F.col("listed.hash").alias("hashes")), CELL_KEYS, ["block"])
    packed = salted_join(packed, sizes.select(*CELL_KEYS, "blocks"), CELL_KEYS, ["hash"])
    return genes, checkpointed(packed), checkpointed(blocks)


def _best_cuts(hist: DataFrame, min_leaf: int) -> DataFrame:
    """The cut of every node with the largest fall in the sum of squares."""
    node = [*CELL_KEYS, "target", "tree", "node"]
    summed = hist.groupBy(*node, "candidate", "bin").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "square")])
    whole = Window.partitionBy(*node, "candidate")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, s = F.sum("n").over(upto), F.sum("total").over(upto)
    cuts = summed.select(
        *node, "candidate", "bin", n.alias("n1"), s.alias("s1"),
        F.sum("n").over(whole).alias("n0"), F.sum("total").over(whole).alias("s0"),
        F.sum("square").over(whole).alias("q0"),
    ).filter((F.col("n1") >= min_leaf) & (F.col("n0") - F.col("n1") >= min_leaf))
    n1, n0, s1, s0 = (F.col(c) for c in ("n1", "n0", "s1", "s0"))
    gain = s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) - s0 * s0 / n0
    # Rounded relative to the node's sum of squares, so that equal cuts tie: then the first gene, the first bin.
    spread = F.col("q0") - s0 * s0 / n0
    cuts = cuts.withColumn("spread", spread).filter("spread > 1e-9").withColumn("gain", gain).withColumn(
        "rank", F.round(F.col("gain") / F.col("spread"), 9))
    best = cuts.filter("rank > 0").groupBy(*node).agg(F.max_by(
        F.struct("candidate", "bin", "gain", "spread", (s1 / n1).alias("low"), ((s0 - s1) / (n0 - n1)).alias("high")),
        F.struct("rank", -F.col("candidate"), -F.col("bin"))).alias("b"))
    return best.select(*node, F.col("b.candidate").alias("gene"), "b.bin", "b.gain", "b.spread", "b.low", "b.high")


def tree_network(
    expr: DataFrame,
    method: str = "rf",
    targets: list[str] | None = None,
    n_trees: int = 100,
    depth: int = 5,
    bins: int = 16,
    min_leaf: int = 5,
    sample: float | None = None,
    candidates: float | None = None,
    rate: float = 0.1,
    seed: int = 1,
) -> DataFrame:
    """(dataset_id, run_id, gene1, gene2, weight): how far gene1 explains gene2.

    `rf`: independent trees on 632 of 1000 cells, the square root of all genes as
    candidates of a node. `gbt`: trees one after the other on what the earlier
    ones leave, times `rate`, on 900 of 1000 cells and a tenth of the genes.
    `sample` and `candidates` override these shares. Genes are binned by rank,
    zeros in a bin of their own. The weight sums the falls in the sum of squares
    at the cuts on gene1, divided by the sums of squares at the roots (`gbt`: at
    the first root). Cells and candidates are drawn by hashes of names, seed,
    tree and node, so results do not depend on partitions. Pairs without a cut
    are absent, and so are constant targets.
    """
    if method not in ("rf", "gbt"):
        raise ValueError(f"unknown method {method!r}")
    boosted = method == "gbt"
    sample = (0.9 if boosted else 0.632) if sample is None else sample
    if candidates is None and boosted:
        candidates = 0.1
    genes, cells, blocks = _prepared(expr, bins, targets, candidates)
    types = dict(expr.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in CELL_KEYS] + [
        "target int, tree int, node int, candidate int, bin int, n long, total double, square double"])
    meet = [*CELL_KEYS, "chunk", "block"]
    spread_cells = cells.select(
        *CELL_KEYS, "chunk", "hash", "genes", "bins", "values",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    model: DataFrame | None = None
    # Trees of a forest share the jobs of their levels; boosting needs one round after the other.
    for trees in [[t] for t in range(n_trees)] if boosted else [list(range(n_trees))]:
        for level in range(depth):
            if model is None:
                known = blocks.withColumn("splits", F.array().cast(SPLIT))
            else:
                own = model.groupBy(
                    *CELL_KEYS, F.floor(F.col("target") / BLOCK_TARGETS).cast("int").alias("block")
                ).agg(F.collect_list(F.struct("target", "tree", "node", "gene", "bin", "low", "high")).alias("splits"))
                known = blocks.join(own, [*CELL_KEYS, "block"], "left").withColumn(
                    "splits", F.coalesce("splits", F.array().cast(SPLIT)))
            known = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            known = known.withColumnsRenamed({c: f"to_{c}" for c in meet})
            hist = (
                spread_by(spread_cells, *meet).groupBy(*meet)
                .cogroup(known.groupBy(*[f"to_{c}" for c in meet]))
                .applyInPandas(histograms(
                    CELL_KEYS, trees, level, bins + 1, round(sample * 1000), seed, rate if boosted else 0.0), schema)
            )
            found = checkpointed(_best_cuts(hist, min_leaf))
            model = found if model is None else model.unionByName(found)
    by_place = lambda end: genes.select(*CELL_KEYS, F.col("gene").alias(end), F.col("place").alias(f"at_{end}"))
    roots = model.filter("node = 1" + (" and tree = 0" if boosted else ""))
    roots = roots.groupBy(*CELL_KEYS, "target").agg(F.sum("spread").alias("spread"))
    sums = model.groupBy(*CELL_KEYS, "target", "gene").agg(F.sum("gain").alias("gain")).join(roots, [*CELL_KEYS, "target"])
    named = sums.withColumnsRenamed({"target": "at_gene2", "gene": "at_gene1"})
    for end in PAIR:
        named = named.join(by_place(end), [*CELL_KEYS, f"at_{end}"])
    return named.select(*CELL_KEYS, *PAIR, (F.col("gain") / F.col("spread")).alias("weight"))
