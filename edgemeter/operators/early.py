"""Early precision and its ratio to chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgemeter.functions.columns import half_even, ratio, valid_number
from edgemeter.functions.joins import mark_member, salted_join
from edgemeter.functions.ranking import cumulate
from edgemeter.operators.primitives import (
    known_lists,
    not_self,
    best_abs,
    by_pair,
    chosen,
    drop_self_loops,
    gt_genes,
    gt_sources,
    label_true,
    mark_universe,
    true_edges,
    universe_sizes,
)
from edgemeter.schema import KEYS, PAIR

SPREAD = ["run_id", "algorithm_id", "score"]


def _selected(column: str, counted: str) -> Column:
    """Sum over selected blocks: positive scores, or the zero block when the
    list has no positive score at all."""
    picked = F.sum(F.when((F.col("score") > 0) & F.col(counted), F.col(column)))
    zero = F.sum(F.when((F.col("score") == 0) & F.col(counted), F.col(column)))
    return F.coalesce(picked, zero)


def epr(
    edges: DataFrame, gt: DataFrame, tf_edges: bool = False, lists: DataFrame | None = None
) -> DataFrame:
    """Precision of the tie-aware top k over the share of true edges.

    Predictions outside the candidates compete unless `tf_edges` is set. A
    list without predictions gives 0, a dataset without true edges NULL.
    """
    kind = "tf" if tf_edges else "directed"
    scored = label_true(best_abs(drop_self_loops(edges)), true_edges(gt, kind))
    if tf_edges:
        scored = mark_universe(scored, gt, kind).filter("inside").drop("inside")
    hist = scored.groupBy(*KEYS, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")
    )
    sizes = universe_sizes(gt, kind)
    done = salted_join(
        cumulate(hist, KEYS, "score", ["n"]),
        sizes.select("dataset_id", F.col("n_true").alias("k")),
        ["dataset_id"],
        SPREAD,
    ).withColumn("_in", chosen("cum_n", "n", "k"))
    sums = done.groupBy(*KEYS).agg(
        _selected("n", "_in").alias("_n"), _selected("hits", "_in").alias("_h")
    )
    out = known_lists(edges, lists).join(sizes, "dataset_id").join(sums, KEYS, "left")
    precision = F.coalesce(ratio("_h", "_n"), F.lit(0.0))
    value = F.when(
        (F.col("n_true") > 0) & (F.col("n_pairs") > 0),
        ratio(precision, ratio("n_true", "n_pairs")),
    )
    return out.select(*KEYS, F.lit("epr").alias("metric"), value.alias("value"))


def signed_gt(gt: DataFrame) -> DataFrame:
    """Ground-truth rows that carry a sign."""
    return gt.filter(F.col("type").isin("+", "-"))


def signed_epr(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Early precision ratio per edge sign: metrics `epr_activation` and
    `epr_inhibitory`.

    Repeated rows count each time; predictions on edges of the opposite sign
    leave the pool; NULL when nothing remains.
    """
    signed = signed_gt(gt)
    flags = signed.groupBy("dataset_id", *PAIR).agg(
        F.max((F.col("type") == "+").cast("int")).alias("_plus"),
        F.max((F.col("type") == "-").cast("int")).alias("_minus"),
    )
    valid = drop_self_loops(edges).filter(valid_number("weight"))
    copies = (
        by_pair(valid.select(*KEYS, *PAIR, "weight"))
        .groupBy(*KEYS, *PAIR, F.abs("weight").alias("score"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(flags, ["dataset_id", *PAIR], "left")
    )
    plus = F.coalesce(F.col("_plus"), F.lit(0))
    minus = F.coalesce(F.col("_minus"), F.lit(0))
    c = F.col("copies")
    hist = copies.groupBy(*KEYS, "score").agg(
        F.sum(c * (1 - minus)).alias("n_plus"),
        F.sum(c * plus * (1 - minus)).alias("hits_plus"),
        F.sum(c * (1 - plus)).alias("n_minus"),
        F.sum(c * minus * (1 - plus)).alias("hits_minus"),
    )
    genes = gt_genes(signed).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_g"))
    per_sign = flags.filter(not_self()).groupBy("dataset_id").agg(
        F.sum("_plus").alias("k_plus"), F.sum("_minus").alias("k_minus")
    )
    sizes = genes.join(per_sign, "dataset_id", "left").select(
        "dataset_id",
        (F.col("_g") * (F.col("_g") - 1)).alias("n_pairs"),
        F.coalesce("k_plus", F.lit(0)).alias("k_plus"),
        F.coalesce("k_minus", F.lit(0)).alias("k_minus"),
    )
    done = salted_join(
        cumulate(hist, KEYS, "score", ["n_plus", "n_minus"]), sizes, ["dataset_id"], SPREAD
    )
    aggregates = []
    for s in ("plus", "minus"):
        done = done.withColumn(
            f"_in_{s}", chosen(f"cum_n_{s}", f"n_{s}", f"k_{s}") & (F.col(f"n_{s}") > 0)
        )
        aggregates += [
            _selected(f"n_{s}", f"_in_{s}").alias(f"_n_{s}"),
            _selected(f"hits_{s}", f"_in_{s}").alias(f"_h_{s}"),
        ]
    sums = done.groupBy(*KEYS).agg(*aggregates)
    out = known_lists(edges, lists).join(sizes, "dataset_id").join(sums, KEYS, "left")

    def value(s):
        chance = ratio(f"k_{s}", "n_pairs")
        return F.when(F.col(f"k_{s}") > 0, ratio(ratio(f"_h_{s}", f"_n_{s}"), chance))

    pairs = F.array(
        F.struct(F.lit("epr_activation").alias("metric"), value("plus").alias("value")),
        F.struct(F.lit("epr_inhibitory").alias("metric"), value("minus").alias("value")),
    )
    return out.select(*KEYS, F.explode(pairs).alias("_m")).select(*KEYS, "_m.metric", "_m.value")


def early_pr(
    edges: DataFrame, gt: DataFrame, kind: str = "tf", lists: DataFrame | None = None
) -> DataFrame:
    """(keys, early_precision, early_recall, early_precision_ratio).

    Scores are rounded to six places; exact repeated rows collapse first; k
    counts distinct ground-truth rows. Here genes that occur only on
    self-loops are not candidates. No prediction gives 1, 1, 1; a list of
    zeros gives NULL.
    """
    if kind not in ("tf", "directed"):
        raise ValueError("kind must be 'tf' or 'directed'")
    plain = drop_self_loops(gt)
    genes = gt_genes(plain)
    true = plain.select("dataset_id", *PAIR).distinct()
    distinct_rows = plain.select("dataset_id", *PAIR, "type").distinct()
    k = distinct_rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("k"))
    n = genes.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_g"))
    s = gt_sources(plain).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_s"))
    width = F.col("_s") if kind == "tf" else F.col("_g")
    sizes = k.join(n, "dataset_id").join(s, "dataset_id").select(
        "dataset_id", "k", (width * (F.col("_g") - 1)).alias("n_pairs")
    )
    rows = (
        drop_self_loops(edges)
        .filter(valid_number("weight"))
        .select(*KEYS, *PAIR, "weight")
        .distinct()
        .groupBy(*KEYS, *PAIR, half_even(F.abs("weight"), 6).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if kind == "tf":
        for gene, members, flag in (("gene1", gt_sources(plain), "_in1"), ("gene2", genes, "_in2")):
            rows = mark_member(
                rows, members.withColumnRenamed("gene", gene), ["dataset_id", gene], flag
            )
        rows = rows.filter(F.col("_in1") & F.col("_in2")).drop("_in1", "_in2")
    pairs = label_true(rows.groupBy(*KEYS, *PAIR).agg(F.max("score").alias("score")), true)
    zero = F.lit(0).cast("long")
    parts = rows.select(*KEYS, "score", "n", zero.alias("pairs"), zero.alias("hits")).unionByName(
        pairs.select(
            *KEYS, "score", zero.alias("n"), F.lit(1).cast("long").alias("pairs"),
            F.col("hit").cast("long").alias("hits"),
        )
    )
    hist = parts.groupBy(*KEYS, "score").agg(
        *[F.sum(c).alias(c) for c in ("n", "pairs", "hits")]
    )
    done = salted_join(
        cumulate(hist, KEYS, "score", ["n"]), sizes.select("dataset_id", "k"), ["dataset_id"],
        SPREAD,
    )
    take = chosen("cum_n", "n", "k") & (F.col("score") > 0)
    sums = done.groupBy(*KEYS).agg(
        F.sum(F.when(take, F.col("pairs"))).alias("_n"),
        F.sum(F.when(take, F.col("hits"))).alias("_h"),
        F.count(F.lit(1)).alias("_blocks"),
    )
    out = known_lists(edges, lists).join(sizes, "dataset_id").join(sums, KEYS, "left")
    none = F.col("_blocks").isNull()
    precision = ratio("_h", "_n")
    return out.select(
        *KEYS,
        F.when(none, 1.0).otherwise(precision).alias("early_precision"),
        F.when(none, 1.0).otherwise(ratio("_h", "k")).alias("early_recall"),
        F.when(none, 1.0)
        .otherwise(ratio(precision, ratio("k", "n_pairs")))
        .alias("early_precision_ratio"),
    )
