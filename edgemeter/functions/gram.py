"""All-pairs inner products by blocks of items and chunks of features.

Items (genes or runs) are hashed into blocks and features (cells or edges)
into chunks, both sized from approximate counts. A block's values on one chunk
are packed into one row, which names each item and feature once, so copies of a
value carry no names. A task walks the sorted chunks of a pair of blocks and adds their NumPy products
up in place: its memory is two blocks on one chunk whatever the size of a group,
and the products leave it once for LANE_CHUNKS chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.functions.joins import salted_join, spread_by
from edgemeter.functions.kernels import block_sums, pack_blocks

ITEMS = 128
FEATURES = 4096
LANE_CHUNKS = 64


def block_pairs(rows: DataFrame) -> DataFrame:
    """Send every row of block `_b` to all pairs (_lo, _hi) its block is in."""
    return rows.withColumn(
        "_p", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    ).select(
        *[c for c in rows.columns if c != "_blocks"],
        F.least("_b", "_p").alias("_lo"),
        F.greatest("_b", "_p").alias("_hi"),
    )


def packed_blocks(rows: DataFrame, group: list[str], item: str, feature: str, value: str) -> DataFrame:
    """(group, _blocks, _b, _c, _items, _features, _i, _f, _v): a row per block of
    items and chunk of features; `_i` and `_f` are places in the two name lists."""
    sizes = rows.groupBy(*group).agg(
        F.ceil(F.approx_count_distinct(item) / ITEMS).cast("int").alias("_blocks"),
        F.ceil(F.approx_count_distinct(feature) / FEATURES).cast("int").alias("_chunks"),
    )
    types = dict(rows.dtypes)
    block = [*group, "_b", "_c"]
    placed = (
        salted_join(rows, sizes, group, [item, feature])
        .select(
            *group, "_blocks", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int").alias("_b"),
            F.pmod(F.xxhash64(feature), F.col("_chunks")).cast("int").alias("_c"),
            F.col(item).alias("_item"), F.col(feature).alias("_feature"), F.col(value).cast("double").alias("_v"))
    )
    return spread_by(placed, *block).sortWithinPartitions(*block).mapInArrow(
        pack_blocks(block), ", ".join([
            *[f"{c} {types[c]}" for c in group], "_blocks int, _b int, _c int", f"_items array<{types[item]}>",
            f"_features array<{types[feature]}>", "_i array<int>, _f array<int>, _v array<double>"]))


def pair_products(
    rows: DataFrame,
    group: list[str],
    item: str,
    feature: str,
    value: str,
    every_pair: bool = False,
) -> DataFrame:
    """(group, item_a, item_b, dot) for item_a <= item_b, the diagonal included.

    `rows` is sparse: one row per (group, item, feature), absent means 0. Pairs
    that share no chunk are absent and mean 0, unless `every_pair` makes all
    items meet on one extra feature of value 0; `feature` is a string then.
    """
    if every_pair:
        meeting = rows.select(*group, item).distinct().select(
            *group, item, F.lit("\x00").alias(feature), F.lit(0.0).alias(value)
        )
        rows = rows.select(*group, item, feature, value).unionByName(meeting)
    types = dict(rows.dtypes)
    packed = packed_blocks(rows, group, item, feature, value).withColumn(
        "_lane", F.expr(f"_c div {LANE_CHUNKS}")
    )
    schema = ", ".join(
        [f"{c} {types[c]}" for c in group]
        + [f"item_a {types[item]}", f"item_b {types[item]}", "dot double"]
    )
    where = [*group, "_lo", "_hi", "_lane"]
    partial = (
        spread_by(block_pairs(packed), *where)
        .sortWithinPartitions(*where, "_c")
        .mapInArrow(block_sums(group), schema)
    )
    return partial.groupBy(*group, "item_a", "item_b").agg(F.sum("dot").alias("dot"))
