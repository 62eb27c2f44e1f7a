"""Metric tables: pivot for the sink, unpivot on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgemeter.sources.files import melt_csv, number, path_parts


def pivot_metric(
    metrics: DataFrame, metric: str | None = None, runs: list[str] | None = None
) -> DataFrame:
    """Rows are algorithms of a dataset, columns are runs.

    Naming `runs` saves the job that finds the distinct run ids.
    """
    rows = metrics if metric is None else metrics.filter(F.col("metric") == metric)
    return (
        rows.groupBy("dataset_id", F.col("algorithm_id").alias("Algorithm"))
        .pivot("run_id", runs)
        .agg(F.first("value"))
    )


def write_metric(pivoted: DataFrame, root: str) -> None:
    """One comma-separated table per dataset below `root`/dataset_id=.../."""
    pivoted.write.partitionBy("dataset_id").option("header", True).csv(root)


def load_metric(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, run_id, algorithm_id, value) of metric tables below
    dataset directories; undefined values are left out."""
    cells = melt_csv(spark, path)
    dataset = path_parts(["dataset_id"], 1)["dataset_id"]
    return cells.select(
        dataset.alias("dataset_id"), F.col("column").alias("run_id"),
        F.col("row").alias("algorithm_id"), number("token").alias("value"),
    ).filter(F.col("value").isNotNull())
