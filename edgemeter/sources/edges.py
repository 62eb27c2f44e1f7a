"""Ranked edge lists and ground truths."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgemeter.functions.columns import valid_number
from edgemeter.schema import GROUND_TRUTH, KEYS, PAIR
from edgemeter.sources.files import named_fields, path_parts

FILE_BITS = 40


def read_ranked_edges(
    spark: SparkSession, root: str, filename: str = "rankedEdges.csv", keep_invalid: bool = False
) -> DataFrame:
    """Tab-separated lists below `root`/dataset/run/algorithm/`filename`.

    Columns are found by the names Gene1, Gene2 and EdgeWeight of each file's
    header, or by position where it has none of them.
    `ord` grows with the row position: part number of the file, then byte
    offset of the split plus the row's place in it. It is the plain row index
    for a file read as one split. Missing files are simply absent; see
    `missing_lists`. Rows without a usable weight are dropped unless
    `keep_invalid` is set; see `invalid_weights`.
    """
    wanted = {"gene1": ("Gene1", 0), "gene2": ("Gene2", 1), "weight": ("EdgeWeight", 2)}
    rows = named_fields(spark, f"{root}/*/*/*/{filename}", "\t", wanted)
    rows = rows.withColumn("weight", F.expr("try_cast(weight AS double)"))
    # A split is at most spark.sql.files.maxPartitionBytes, which bounds the window.
    place = F.row_number().over(Window.partitionBy("_path", "_start").orderBy("_seq")) - 1
    part = F.regexp_extract("_path", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    ord_ = F.shiftleft(F.coalesce(part, F.lit(0)), FILE_BITS) + F.col("_start") + place
    keyed = rows.withColumn("ord", ord_).select(
        *[c.alias(n) for n, c in path_parts(KEYS, 1).items()], "ord", *PAIR, "weight"
    )
    return keyed if keep_invalid else keyed.filter(valid_number("weight"))


def invalid_weights(edges: DataFrame) -> DataFrame:
    """(keys, n_invalid): rows whose weight is NULL or NaN, per list."""
    return edges.groupBy(*KEYS).agg(F.count_if(~valid_number("weight")).alias("n_invalid"))


def found_lists(spark: SparkSession, root: str, filename: str = "rankedEdges.csv") -> DataFrame:
    """(keys) of all list files, also those with a header only; no content is read."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/*/*/{filename}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in KEYS))
    paths = files.select(F.col("_metadata.file_path").alias("_path"))
    return paths.select(*[c.alias(n) for n, c in path_parts(KEYS, 1).items()]).distinct()


def missing_lists(
    edges: DataFrame, runs: DataFrame, algorithms: DataFrame
) -> DataFrame:
    """(keys) of configured lists that have no row.

    `runs` is (dataset_id, run_id), `algorithms` is (algorithm_id); both come
    from the configuration, so their product is one row per list.
    """
    names = algorithms.agg(F.collect_set("algorithm_id").alias("_a"))
    wanted = runs.join(names).select(*KEYS[:2], F.explode("_a").alias("algorithm_id"))
    return wanted.join(edges.select(*KEYS).distinct(), KEYS, "left_anti")


def read_ground_truth(
    spark: SparkSession,
    root: str,
    filename: str | Mapping[str, str] = "GroundTruthNetwork.csv",
    signed: bool = False,
    dataset: str = "*",
) -> DataFrame:
    """(dataset_id, gene1, gene2, type) from `root`/dataset/`filename`.

    Columns are found by the names Gene1, Gene2 and Type of each file's header;
    without the first two, genes are the first two columns. Files without a Type
    column give NULL types. `signed` keeps only `+` and `-`, so datasets without
    signs drop out. `filename` may be a mapping of dataset to file name; datasets
    it does not name are left out.
    """
    if isinstance(filename, Mapping):
        parts = [read_ground_truth(spark, root, f"{name}", signed, dataset)
                 for dataset, name in filename.items()]
        none = spark.createDataFrame([], GROUND_TRUTH)
        return reduce(DataFrame.unionByName, parts, none)
    wanted = {"gene1": ("Gene1", 0), "gene2": ("Gene2", 1), "type": ("Type", None)}
    rows = named_fields(spark, f"{root}/{dataset}/{filename}", ",", wanted)
    keyed = rows.select(path_parts(["dataset_id"], 1)["dataset_id"].alias("dataset_id"), *PAIR, "type")
    return keyed.filter(F.col("type").isin("+", "-")) if signed else keyed


def write_ground_truth(gt: DataFrame, root: str) -> None:
    """Comma-separated `Gene1, Gene2, Type` below `root`/dataset_id=.../."""
    gt.select(
        "dataset_id", F.col("gene1").alias("Gene1"), F.col("gene2").alias("Gene2"),
        F.col("type").alias("Type"),
    ).write.partitionBy("dataset_id").option("header", True).csv(root)


def write_ranked_edges(edges: DataFrame, root: str, fmt: str = "parquet") -> None:
    """Lists in rank order, one directory per dataset, run and algorithm.

    Range partitioning spreads one huge list over many ordered part files.
    Parquet keeps `ord`; `csv` writes `Gene1, Gene2, EdgeWeight` with tabs.
    """
    ordered = edges.repartitionByRange(*KEYS, "ord").sortWithinPartitions(*KEYS, "ord")
    if fmt == "parquet":
        ordered.write.partitionBy(*KEYS).parquet(root)
    elif fmt == "csv":
        ordered.select(
            *KEYS,
            F.col("gene1").alias("Gene1"),
            F.col("gene2").alias("Gene2"),
            F.col("weight").alias("EdgeWeight"),
        ).write.partitionBy(*KEYS).option("sep", "\t").option("header", True).csv(root)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_edge_table(spark: SparkSession, root: str) -> DataFrame:
    """Lists written by `write_ranked_edges` as Parquet; filters on the keys
    prune directories."""
    schema = "ord long, gene1 string, gene2 string, weight double, " + ", ".join(
        f"{k} string" for k in KEYS
    )
    return spark.read.schema(schema).parquet(root).select(*KEYS, "ord", *PAIR, "weight")
