"""Timing logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgemeter.schema import KEYS
from edgemeter.sources.files import path_parts


def read_timings(spark: SparkSession, root: str, filename: str = "time*.txt") -> DataFrame:
    """(keys, file, text): each log below
    `root`/dataset/run/algorithm/working_dir/`filename` as one row; a log is a
    few dozen lines. No log at all gives no row."""
    try:
        logs = spark.read.text(f"{root}/*/*/*/working_dir*/{filename}", wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in [*KEYS, "file", "text"]))
    rows = logs.select(
        "value", F.col("_metadata.file_path").alias("_path")
    )
    return rows.select(
        *[c.alias(n) for n, c in path_parts(KEYS, 2).items()],
        F.col("_path").alias("file"), F.col("value").alias("text"),
    )
