"""Expression matrices, pseudotime, gene orderings and regulator lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgemeter.schema import CELL_KEYS
from edgemeter.sources.files import melt_csv, number, path_parts, write_wide


def read_expression(
    spark: SparkSession, root: str, filename: str = "ExpressionData.csv", sep: str = ","
) -> DataFrame:
    """(dataset_id, run_id, gene, cell, value) from `root`/dataset/run/`filename`."""
    cells = melt_csv(spark, f"{root}/*/*/{filename}", sep)
    keys = path_parts(CELL_KEYS, 1)
    return cells.select(
        *[c.alias(n) for n, c in keys.items()],
        F.col("row").alias("gene"), F.col("column").alias("cell"), number("token").alias("value"),
    ).filter(F.col("value").isNotNull())


def write_expression(expr: DataFrame, root: str) -> None:
    """Wide comma-separated matrices, genes by cells, one per dataset and run."""
    write_wide(expr, CELL_KEYS, "gene", "cell", "value", root)


def read_pseudotime(
    spark: SparkSession, root: str, filename: str = "PseudoTime.csv"
) -> DataFrame:
    """(dataset_id, run_id, cell, trajectory, t): trajectories are numbered by
    column; cells off a trajectory are left out."""
    cells = melt_csv(spark, f"{root}/*/*/{filename}")
    return cells.select(
        *[c.alias(n) for n, c in path_parts(CELL_KEYS, 1).items()],
        F.col("row").alias("cell"), F.col("position").alias("trajectory"),
        number("token").alias("t"),
    ).filter(F.col("t").isNotNull())


def write_pseudotime(pt: DataFrame, root: str) -> None:
    """Wide comma-separated pseudotime, one column per trajectory."""
    write_wide(pt, CELL_KEYS, "cell", "trajectory", "t", root)


def read_gene_ordering(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """(dataset_id, gene, pvalue, variance): columns by position, the third one
    optional."""
    rows = (
        spark.read.schema("gene string, pvalue double, variance double")
        .option("header", True)
        .csv(path)
    )
    return rows.select(F.lit(dataset_id).alias("dataset_id"), *rows.columns)


def read_regulators(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """(dataset_id, gene) from the first column."""
    rows = spark.read.schema("gene string").option("header", True).csv(path)
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "gene")
