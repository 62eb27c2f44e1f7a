"""Inverse of one large symmetric positive definite matrix per group, by blocks.

Gauss-Jordan elimination over blocks: each round inverts one pivot block and
updates all other blocks in parallel, so no task holds more than four blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.functions.joins import salted_join
from edgemeter.functions.kernels import block_entries, eliminate_block, fill_block
from edgemeter.session import checkpointed

BLOCK = 128


def _round(group: list[str], k: int):
    return lambda pdf: eliminate_block(pdf, group, k)


def block_inverse(
    entries: DataFrame, sizes: DataFrame, group: list[str], block: int = BLOCK
) -> DataFrame:
    """(group, i, j, v) of the inverse. `entries` has the same columns with
    0-based positions, `sizes` is (group, n). Fails on a singular matrix."""
    keys = ", ".join(f"{c} {t}" for c, t in entries.dtypes if c in group)
    schema = f"{keys}, bi int, bj int, h int, w int, a array<double>"
    size = F.lit(block)
    extent = lambda b: F.least(size, F.col("n") - F.col(b) * size).cast("int")
    cells = entries.join(sizes, group).select(
        *group, "v",
        F.expr(f"cast(i div {block} as int)").alias("bi"), F.expr(f"cast(j div {block} as int)").alias("bj"),
        (F.col("i") % size).cast("int").alias("_r"), (F.col("j") % size).cast("int").alias("_c"), "n",
    ).withColumn("_h", extent("bi")).withColumn("_w", extent("bj"))
    blocks = checkpointed(cells.groupBy(*group, "bi", "bj").applyInPandas(
        lambda pdf: fill_block(pdf, group), schema
    ))
    rounds = (blocks.agg(F.max("bi")).first()[0] or 0) + 1
    for k in range(rounds):
        row = blocks.filter(F.col("bi") == k)
        pivot = row.filter(F.col("bj") == k).select(
            *group, F.col("a").alias("p"), F.col("h").alias("ph")
        )
        up = row.select(*group, "bj", F.col("a").alias("up"))
        left = blocks.filter(F.col("bj") == k).select(*group, "bi", F.col("a").alias("left"))
        joined = (
            salted_join(blocks, pivot, group, ["bi", "bj"], "left")
            .join(up, [*group, "bj"], "left")
            .join(left, [*group, "bi"], "left")
        )
        blocks = checkpointed(
            joined.groupBy(*group, "bi", "bj").applyInPandas(_round(group, k), schema)
        )
    out = f"{keys}, i long, j long, v double"
    return blocks.groupBy(*group, "bi", "bj").applyInPandas(
        lambda pdf: block_entries(pdf, group, block), out
    )
