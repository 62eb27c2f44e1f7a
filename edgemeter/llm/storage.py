"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.session import scratch_path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet where every executor reaches it, and read it back.

    Cuts the lineage: what was computed once is not computed again after an
    executor is lost, and later scans read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other
    columns of the caller cannot clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
