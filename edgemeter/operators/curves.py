"""Precision-recall and ROC areas and curve points.

Each list is reduced to a histogram of distinct scores with counts and hits.
Candidate pairs without a prediction form one block at score zero whose size
is known in closed form, so the quadratic universe is never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.functions.columns import ratio, valid_number
from edgemeter.functions.joins import salted_join
from edgemeter.functions.ranking import cumulate
from edgemeter.operators.primitives import (
    not_self,
    best_abs,
    by_pair,
    label_true,
    mark_universe,
    true_edges,
    universe_sizes,
)
from edgemeter.schema import KEYS, PAIR
from edgemeter.session import stored


def score_histogram(rows: DataFrame) -> DataFrame:
    """(keys, score, n, hits) of rows with keys, score, inside, hit.

    Rows outside the universe fall to score zero with count zero; they only
    keep a list alive that has no usable prediction.
    """
    inside = F.col("inside")
    return rows.groupBy(
        *KEYS, F.when(inside, F.col("score")).otherwise(F.lit(0.0)).alias("score")
    ).agg(
        F.sum(inside.cast("long")).alias("n"),
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("hits"),
    )


def _areas(hist: DataFrame, sizes: DataFrame) -> DataFrame:
    """Areas per list; `sizes` is per dataset (n_pairs, n_true)."""
    done = cumulate(hist, KEYS, "score", ["n", "hits"])
    tp, n = F.col("cum_hits"), F.col("cum_n")
    tp0, n0 = tp - F.col("hits"), n - F.col("n")
    fp, fp0 = n - tp, n0 - tp0
    precision = ratio(tp, n)
    before = F.coalesce(ratio(tp0, n0), F.lit(1.0))
    positive = F.col("score") > 0

    def total(value):
        return F.coalesce(F.sum(F.when(positive, value)), F.lit(0))

    sums = done.groupBy(*KEYS).agg(
        total(F.col("hits")).cast("double").alias("tp"),
        total(F.col("n")).cast("double").alias("np"),
        total(F.col("hits") * (precision + before) / 2).alias("pr"),
        total(F.col("hits") * precision).alias("step"),
        total((fp - fp0) * (tp + tp0).cast("double") / 2).alias("roc"),
    )
    joined = sums.join(sizes, "dataset_id")
    true, pairs = F.col("n_true").cast("double"), F.col("n_pairs").cast("double")
    prevalence = ratio(true, pairs)
    last = F.coalesce(ratio("tp", "np"), F.lit(1.0))
    rest = true - F.col("tp")
    false = pairs - true
    rest_false = false - (F.col("np") - F.col("tp"))
    return joined.select(
        *KEYS,
        ratio(F.col("pr") + rest * (last + prevalence) / 2, true).alias("auprc"),
        ratio(F.col("step") + rest * prevalence, true).alias("average_precision"),
        ratio(F.col("roc") + rest_false * (F.col("tp") + true) / 2, true * false).alias("auroc"),
        prevalence.alias("prevalence"),
    )


def _labelled(edges: DataFrame, gt: DataFrame, kind: str) -> DataFrame:
    scored = best_abs(edges)
    return mark_universe(label_true(scored, true_edges(gt, kind)), gt, kind)


def _with_empty(hist: DataFrame, lists: DataFrame | None) -> DataFrame:
    """Give every named list a block of score 0."""
    if lists is None:
        return hist
    nothing = F.lit(0).cast("long")
    empty = lists.select(*KEYS, F.lit(0.0).alias("score"), nothing.alias("n"), nothing.alias("hits"))
    return (
        hist.unionByName(empty)
        .groupBy(*KEYS, "score")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )


def curve_areas(
    edges: DataFrame, gt: DataFrame, kind: str = "directed", lists: DataFrame | None = None
) -> DataFrame:
    """(keys, auprc, average_precision, auroc, prevalence) for every list.

    `lists` may name lists (keys) that hold no row at all; they score as one
    tied block.
    """
    hist = _with_empty(score_histogram(_labelled(edges, gt, kind)), lists)
    return _areas(hist, universe_sizes(gt, kind))


def auprc(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Trapezoidal area under precision-recall with the anchor (0, 1)."""
    return _metric(curve_areas(edges, gt, lists=lists), "auprc")


def auroc(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Area under ROC; NULL when one class is empty."""
    return _metric(curve_areas(edges, gt, lists=lists), "auroc")


def pr_roc_ratio(
    edges: DataFrame, gt: DataFrame, kind: str = "directed", lists: DataFrame | None = None
) -> DataFrame:
    """Step-wise average precision and AUROC with their ratios to chance."""
    areas = curve_areas(edges, gt, kind, lists)
    return areas.select(
        *KEYS,
        "average_precision",
        "auroc",
        ratio("average_precision", "prevalence").alias("average_precision_ratio"),
        ratio("auroc", F.lit(0.5)).alias("auroc_ratio"),
    )


def signed_pr_roc(
    edges: DataFrame, gt: DataFrame, kind: str = "directed", lists: DataFrame | None = None
) -> DataFrame:
    """`pr_roc_ratio` per edge sign, in long form over `sign`.

    A list with a negative weight is matched by sign; otherwise predictions on
    edges of the opposite sign are ignored. The last row of a repeated pair
    counts.
    """
    rows = edges.filter(valid_number("weight"))
    # One row per pair and weight sign: its last weight and its list's signedness.
    last = by_pair(rows.select(*KEYS, *PAIR, "weight", "ord")).groupBy(*KEYS, *PAIR).agg(
        F.max_by(F.abs("weight"), F.col("ord")).alias("any_score"),
        F.max_by(F.when(F.col("weight") >= 0, F.abs("weight")),
                 F.when(F.col("weight") >= 0, F.col("ord"))).alias("plus_score"),
        F.max_by(F.when(F.col("weight") < 0, F.abs("weight")),
                 F.when(F.col("weight") < 0, F.col("ord"))).alias("minus_score"),
    )
    signedness = rows.groupBy(*KEYS).agg(F.max((F.col("weight") < 0).cast("int")).alias("_signed"))
    # The joins on pairs come first, while the rows of a pair are together.
    last = last.join(drop_self_loops_signs(gt), ["dataset_id", *PAIR], "left")
    for sign, flag in (("+", "_hit_plus"), ("-", "_hit_minus")):
        true = true_edges(gt.filter(F.col("type") == sign), kind)
        last = label_true(last, true).withColumnRenamed("hit", flag)
    last = mark_universe(salted_join(last, signedness, KEYS, PAIR), gt, kind)
    parts = []
    for sign, own in (("+", "plus_score"), ("-", "minus_score")):
        other = F.coalesce("_not_plus" if sign == "+" else "_not_minus", F.lit(0)) == 1
        score = F.when(F.col("_signed") == 1, F.col(own)).when(~other, F.col("any_score"))
        part = last.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn(
            "hit", F.col("_hit_plus" if sign == "+" else "_hit_minus")
        )
        sizes = _sign_sizes(gt, kind, sign)
        areas = _areas(_with_empty(score_histogram(part), lists), sizes)
        parts.append(
            areas.select(
                *KEYS,
                F.lit(sign).alias("sign"),
                "average_precision",
                "auroc",
                ratio("average_precision", "prevalence").alias("average_precision_ratio"),
                ratio("auroc", F.lit(0.5)).alias("auroc_ratio"),
            )
        )
    return parts[0].unionByName(parts[1])


def drop_self_loops_signs(gt: DataFrame) -> DataFrame:
    """(dataset_id, gene1, gene2, _not_plus, _not_minus) of non-self edges."""
    return (
        gt.filter(not_self())
        .groupBy("dataset_id", *PAIR)
        .agg(
            F.max((~F.col("type").eqNullSafe("+")).cast("int")).alias("_not_plus"),
            F.max((~F.col("type").eqNullSafe("-")).cast("int")).alias("_not_minus"),
        )
    )


def _sign_sizes(gt: DataFrame, kind: str, sign: str) -> DataFrame:
    """Universe of the whole ground truth, true edges of one sign."""
    pairs = universe_sizes(gt, kind).select("dataset_id", "n_pairs")
    true = (
        true_edges(gt.filter(F.col("type") == sign), kind)
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("n_true"))
    )
    return pairs.join(true, "dataset_id", "left").select(
        "dataset_id", "n_pairs", F.coalesce("n_true", F.lit(0)).alias("n_true")
    )


# ---- curve points ---------------------------------------------------------


def _prediction_curve(edges: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cumulative histogram over raw signed weights, and per-list totals."""
    valid = edges.filter(not_self() & valid_number("weight")).select(*KEYS, *PAIR, "weight")
    rows = label_true(by_pair(valid), true_edges(gt))
    # A row per distinct weight, read four times below: the lists are shuffled once.
    hist = stored(rows.groupBy(*KEYS, F.col("weight").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("hits")
    ), "histogram")
    totals = hist.groupBy(*KEYS).agg(F.sum("n").alias("_n"), F.sum("hits").alias("_k"))
    # A dataset without ground truth has no curve.
    totals = totals.join(gt.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return cumulate(hist, KEYS, "score", ["n", "hits"]), totals


def pr_curve(edges: DataFrame, gt: DataFrame) -> DataFrame:
    """(keys, threshold, recall, precision, area, place) over predicted edges
    only; `place` orders the curves of a run by area; the anchor (0, 1) has a
    NULL threshold. Lists without a positive are left out."""
    done, totals = _prediction_curve(edges, gt)
    done = salted_join(done, totals.filter(F.col("_k") > 0), KEYS, ["score"])
    tp0, n0 = F.col("cum_hits") - F.col("hits"), F.col("cum_n") - F.col("n")
    before = F.coalesce(ratio(tp0, n0), F.lit(1.0))
    points = done.select(
        *KEYS,
        F.col("score").alias("threshold"),
        ratio("cum_hits", "_k").alias("recall"),
        ratio("cum_hits", "cum_n").alias("precision"),
        (ratio("hits", "_k") * (ratio("cum_hits", "cum_n") + before) / 2).alias("_part"),
    )
    areas = _place(points.groupBy(*KEYS).agg(F.sum("_part").alias("area")))
    anchors = areas.select(
        *KEYS, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"), "area", "place",
    )
    return salted_join(points.drop("_part"), areas, KEYS, ["threshold"]).select(
        *anchors.columns
    ).unionByName(anchors)


def roc_curve(edges: DataFrame, gt: DataFrame) -> DataFrame:
    """(keys, threshold, fpr, tpr, area, place); the anchor (0, 0) has a NULL
    threshold. Lists with one class only are left out."""
    done, totals = _prediction_curve(edges, gt)
    both = totals.filter((F.col("_k") > 0) & (F.col("_k") < F.col("_n")))
    done = salted_join(done, both, KEYS, ["score"])
    false = F.col("_n") - F.col("_k")
    tp0 = F.col("cum_hits") - F.col("hits")
    points = done.select(
        *KEYS,
        F.col("score").alias("threshold"),
        ratio(F.col("cum_n") - F.col("cum_hits"), false).alias("fpr"),
        ratio("cum_hits", "_k").alias("tpr"),
        (
            ratio(F.col("n") - F.col("hits"), false)
            * ratio(F.col("cum_hits") + tp0, F.col("_k"))
            / 2
        ).alias("_part"),
    )
    areas = _place(points.groupBy(*KEYS).agg(F.sum("_part").alias("area")))
    anchors = areas.select(
        *KEYS, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"), "area", "place",
    )
    return salted_join(points.drop("_part"), areas, KEYS, ["threshold"]).select(
        *anchors.columns
    ).unionByName(anchors)


def _place(areas: DataFrame) -> DataFrame:
    """Rank the algorithms of a run; one row per list, so the window is small."""
    from pyspark.sql import Window

    order = Window.partitionBy("dataset_id", "run_id").orderBy(F.desc("area"), "algorithm_id")
    return areas.withColumn("place", F.row_number().over(order))


def _metric(areas: DataFrame, name: str) -> DataFrame:
    return areas.select(*KEYS, F.lit(name).alias("metric"), F.col(name).alias("value"))
