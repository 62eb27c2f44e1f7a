"""Benchmark summaries: baselines, ratios, orderings, heat cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.columns import ratio
from edgemeter.operators.primitives import drop_self_loops, gt_genes
from edgemeter.session import checkpointed


def signed_baselines(gt: DataFrame) -> DataFrame:
    """(dataset_id, total, activation, inhibition): expected precision of a
    random predictor. Self-loops are dropped first, repeated rows count, and
    all three share the same pair count; NULL for no edges."""
    rows = drop_self_loops(gt)
    n = gt_genes(rows).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    kind = F.col("type")
    counts = rows.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(kind == "+").alias("_plus"),
        F.count_if(kind == "-").alias("_minus"),
    )
    joined = gt.select("dataset_id").distinct().join(n, "dataset_id", "left").join(
        counts, "dataset_id", "left"
    )
    pairs = F.col("_n") * (F.col("_n") - 1)

    def share(column):
        return F.when(F.col(column) > 0, ratio(column, pairs))

    return joined.select(
        "dataset_id",
        share("_all").alias("total"),
        share("_plus").alias("activation"),
        share("_minus").alias("inhibition"),
    )


def random_baseline(gt: DataFrame) -> DataFrame:
    """(dataset_id, baseline)."""
    return signed_baselines(gt).select("dataset_id", F.col("total").alias("baseline"))


def median_ratio(metrics: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """(dataset_id, algorithm_id, value): median over runs of value over
    baseline; without baselines the values are ratios already. Datasets whose
    baseline is NULL or 0 are left out."""
    rows = metrics
    if baselines is None:
        rows = rows.withColumn("baseline", F.lit(1.0))
    else:
        rows = rows.join(baselines.filter(F.col("baseline") > 0), "dataset_id")
    return rows.groupBy("dataset_id", "algorithm_id").agg(
        F.median(F.col("value") / F.col("baseline")).alias("value")
    )


def order_algorithms(ratios: DataFrame, algorithms: DataFrame | None = None) -> DataFrame:
    """(algorithm_id, median, place): by median over datasets, largest first;
    no value counts as 0; ties by name. One row per algorithm."""
    named = (ratios if algorithms is None else algorithms).select("algorithm_id").distinct()
    medians = ratios.groupBy("algorithm_id").agg(F.median("value").alias("median"))
    full = named.join(medians, "algorithm_id", "left").withColumn(
        "median", F.coalesce("median", F.lit(0.0))
    )
    order = Window.orderBy(F.desc("median"), "algorithm_id")
    return full.withColumn("place", F.row_number().over(order))


def section(values: DataFrame, name: str, value: str = "value") -> DataFrame:
    return values.select(
        "dataset_id", "algorithm_id", F.lit(name).alias("section"), F.col(value).alias("value")
    )


def summary(sections: list[DataFrame], lead: str = "auprc_ratio") -> DataFrame:
    """(place, algorithm_id, section, dataset_id, value) over all algorithms of
    any section, ordered by the `lead` section; absent cells are NULL rows."""
    rows = sections[0]
    for part in sections[1:]:
        rows = rows.unionByName(part)
    # A few rows per list, read three times below: do not run the metrics thrice.
    rows = checkpointed(rows)
    order = order_algorithms(rows.filter(F.col("section") == lead), rows)
    # One array of the few table columns, so that every algorithm gets each.
    columns = rows.agg(F.collect_set(F.struct("section", "dataset_id")).alias("_c"))
    grid = order.join(columns).select("place", "algorithm_id", F.inline("_c"))
    return grid.join(rows, ["algorithm_id", "section", "dataset_id"], "left").select(
        "place", "algorithm_id", "section", "dataset_id", "value"
    )


def stability_summary(auprc: DataFrame, spearman: DataFrame, gt: DataFrame) -> DataFrame:
    """Sections `auprc_ratio` and `stability`."""
    return summary([
        section(median_ratio(auprc, random_baseline(gt)), "auprc_ratio"),
        section(spearman, "stability", "median_spearman"),
    ])


def epr_summary(auprc: DataFrame, epr: DataFrame, signed_epr: DataFrame, gt: DataFrame) -> DataFrame:
    """Sections `auprc_ratio`, `epr`, `epr_activation`, `epr_inhibitory`."""
    parts = [
        section(median_ratio(auprc, random_baseline(gt)), "auprc_ratio"),
        section(median_ratio(epr), "epr"),
    ]
    for name in ("epr_activation", "epr_inhibitory"):
        parts.append(section(median_ratio(signed_epr.filter(F.col("metric") == name)), name))
    return summary(parts)


def pivot_summary(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Algorithms by `section|dataset`; naming `columns` saves a job."""
    wide = table.withColumn("_column", F.concat_ws("|", "section", "dataset_id"))
    return wide.groupBy("place", "algorithm_id").pivot("_column", columns).agg(F.first("value"))


def heat_cells(table: DataFrame, cutoff: float) -> DataFrame:
    """Colour position and label of every cell of a summary.

    A column (section, dataset) runs from `cutoff`, or its minimum when the
    cutoff is 0, to its maximum. Cells below the cutoff and NULL cells have no
    colour.
    """
    column = Window.partitionBy("section", "dataset_id")  # one row per algorithm
    v = F.col("value")
    low = F.lit(float(cutoff)) if cutoff > 0 else F.min("value").over(column)
    shown = v.isNotNull() & (v >= cutoff)
    out = (
        table.withColumn("_floor", low)
        .withColumn("_max", F.max("value").over(column))
        .withColumn("_seen", F.min(F.when(v >= cutoff, v)).over(column))
        .withColumn(
            "scaled",
            F.when(
                shown,
                F.when(
                    F.col("_max") > F.col("_floor"),
                    ratio(v - F.col("_floor"), F.col("_max") - F.col("_floor")),
                ).otherwise(0.5),
            ),
        )
    )
    label = F.when(v >= 1, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return out.select(
        *table.columns,
        "scaled",
        F.when(  # `least` alone would skip a NULL
            F.col("scaled").isNotNull(), F.least(F.floor(F.col("scaled") * 10), F.lit(10))
        ).cast("int").alias("bucket"),
        F.coalesce(v < cutoff, F.lit(False)).alias("below_cutoff"),
        v.isNull().alias("missing"),
        F.coalesce(F.col("scaled") >= 1, F.lit(False)).alias("is_max"),
        F.coalesce(shown & (v <= F.col("_seen")), F.lit(False)).alias("is_visible_min"),
        F.when(shown, label).alias("label"),
    )


def box_stats(metrics: DataFrame, reference: float | None = None) -> DataFrame:
    """(dataset_id, algorithm_id, n, min, q1, median, q3, max, mean, reference)
    over the runs that have a value."""
    probs = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    rows = metrics.filter(F.col("value").isNotNull())
    stats = rows.groupBy("dataset_id", "algorithm_id").agg(
        F.count("value").alias("n"),
        F.percentile("value", probs).alias("_q"),
        F.avg("value").alias("mean"),
    )
    names = ["min", "q1", "median", "q3", "max"]
    return stats.select(
        "dataset_id", "algorithm_id", "n",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(names)],
        "mean", F.lit(reference).cast("double").alias("reference"),
    )
