"""Places of rows within their groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm.storage import shuffle_partitions, staged


def positions(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """`rows` with `at` (unique, ascending by group and order), `pos` (place within
    the group, from 0, nulls first) and `n` (rows of the group).

    `group` must not be null. Rows are range-partitioned and sorted; a group that
    spans partitions gets the counts of its earlier partitions added, so a group
    of any size is spread. The sorted rows are written once: a lost executor
    cannot change the places.
    """
    n = shuffle_partitions(rows)
    listed = staged(
        rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
        .withColumn("at", F.monotonically_increasing_id()),
        label,
    ).withColumn("part", F.shiftright("at", 33))
    # One row for each partition that a group meets.
    runs = listed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(group)
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "part", (F.coalesce(F.sum("here").over(ahead), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(whole).alias("n"),
    )
    return listed.join(runs, [group, "part"]).withColumn(
        "pos", F.col("at") + F.col("shift")).drop("part", "shift")
