"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def salt_count(df: DataFrame) -> int:
    """One salt per shuffle partition."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def spread_by(df: DataFrame, *columns: str) -> DataFrame:
    """Hash over all shuffle partitions before work that is heavy for its size.

    Adaptive execution merges partitions by bytes; small inputs of block
    products, wedge joins or searches would end up in very few tasks. An
    explicit number is kept.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(partitions, *columns)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join `big` to a table of few rows per group although `on` is coarse.

    For keys such as a list, a run or a dataset, each of which may hold a large
    share of `big` while `small` has a row or a few for it: rows of a group
    spread over all partitions by a hash of `spread`, and the few rows of
    `small` are repeated per partition. Where the key contains a gene, a cell, a
    value or a pair, `small` may be as large as `big`: use a plain join there,
    whose hot keys adaptive execution measures and splits at run time.
    No side is hinted: the planner broadcasts `small` when its size allows it.
    """
    salts = salt_count(big)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def mark_member(
    rows: DataFrame, members: DataFrame, on: list[str], flag: str
) -> DataFrame:
    """Add a boolean column telling whether the row's `on` occurs in `members`."""
    known = members.select(*on).distinct().withColumn(flag, F.lit(True))
    joined = rows.join(known, on, "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
