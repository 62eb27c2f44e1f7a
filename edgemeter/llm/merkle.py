"""A Merkle manifest of a dataset by lag and lead windows.

Leaves stand in order within their trees, cut into aligned blocks of
fan_out ** HEIGHT leaves. Inside a block every level is one window: at a node's
first leaf, lag and lead columns at the fixed offsets of that level's width
supply the siblings, masked by the node's slot and the length of its run, and
the first child of a run hashes the parent. The blocks' nodes are the leaves of
the next pass, so a tree of any size needs one window of bounded size per block
and one pass per HEIGHT levels. Proofs travel down by one join per pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.joins import salted_join
from edgemeter.llm.ordering import positions
from edgemeter.llm.storage import staged

BLOCK_LEAVES = 256
STEP = "struct<left: string, right: string>"


def leaf_hash(values: list[Column]) -> Column:
    """Digest of a row: each value as `-` if null, else its UTF-8 byte count, `:` and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _height(fan_out: int) -> int:
    return max(1, int(math.log(BLOCK_LEAVES, fan_out) + 1e-9))


def _climb(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Nodes (tree, pos, n, node, ...) with `block`, the `steps` of their proofs inside
    their block, and in `node` the block's own node at the block's first row."""
    height = _height(fan_out)
    width = fan_out**height
    block = Window.partitionBy("tree", "block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumn("block", F.expr(f"pos div {width}"))
    steps = []
    for level in range(height):
        span = fan_out**level
        many = F.expr(f"(n + {span - 1}) div {span}")
        index = F.expr(f"pos div {span}")
        slot = index % fan_out
        run = F.least(F.lit(fan_out), many - (index - slot))
        heads = F.col("pos") % span == 0
        active = many > 1
        before = [
            F.when(slot >= j, F.lag("node", j * span).over(block)) for j in range(fan_out - 1, 0, -1)
        ]
        after = [
            F.when(slot + j < run, F.lead("node", j * span).over(block)) for j in range(1, fan_out)
        ]
        left, right = F.concat_ws("", *before), F.concat_ws("", *after)
        step = F.struct(left.alias("left"), right.alias("right"))
        out = out.withColumn(f"step_{level}", F.when(heads & active, step))
        parent = F.when(active, F.sha2(F.concat("node", F.col(f"step_{level}.right")), 256))
        out = out.withColumn("node", F.when(heads & (slot == 0), F.coalesce(parent, "node")))
        steps.append(F.when(active, F.last(f"step_{level}", ignorenulls=True).over(so_far)))
    # A node's first leaf knows the siblings: the leaves behind it take them over.
    out = out.withColumn("steps", F.filter(F.array(*steps), lambda step: step.isNotNull()))
    return out.drop(*[f"step_{level}" for level in range(height)])


def _blocks(climbed: DataFrame, fan_out: int) -> DataFrame:
    """One row a block, as the leaves of the next pass: written, as it is read twice."""
    width = fan_out ** _height(fan_out)
    return staged(
        climbed.filter(F.col("pos") % width == 0).select(
            "tree", F.col("block").alias("pos"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), "node"),
        "merkle-blocks",
    )


def _above(blocks: DataFrame, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """(blocks with the steps above them, tops of all trees)."""
    most = blocks.agg(F.max("n")).first()[0]
    if most is None or most <= 1:
        none = F.array().cast(f"array<{STEP}>")
        return blocks.select("tree", "pos", none.alias("steps")), blocks.select("tree", "node")
    climbed = _climb(blocks, fan_out)
    higher, tops = _above(_blocks(climbed, fan_out), fan_out)
    return _join_above(climbed, higher).select("tree", "pos", "steps"), tops


def _join_above(climbed: DataFrame, higher: DataFrame) -> DataFrame:
    more = higher.withColumnsRenamed({"pos": "block", "steps": "above"})
    return climbed.join(more, ["tree", "block"]).withColumn("steps", F.concat("steps", "above")).drop("above")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_text(steps: Column) -> Column:
    """All siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(
    docs: DataFrame,
    columns: list[str],
    group: str,
    order: str,
    fan_out: int = 2,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """(order, group, leaf, subroot, root, steps, also...) of every row.

    A row is a leaf, the `leaf_hash` of `columns`. Leaves of one `group` ascend
    by `order`; every `fan_out` consecutive nodes become one, a last run of fewer
    too, until one is left, the subroot. The groups' subroots, ordered by group
    (UTF-8 bytewise, null first), give the root likewise. `steps` are the
    siblings (left, right) from leaf to root. Null groups are a group; null
    orders come first; rows that agree in `order` stand by their digest, so rows
    repeated whole are leaves of their own with the same digest. No rows: none.
    """
    leaves = staged(
        docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("tree"),
            F.col(order).alias("order"), leaf_hash([F.col(c) for c in columns]).alias("leaf"),
            *[value.alias(f"also_{name}") for name, value in (also or {}).items()],
        ),
        "merkle-leaves",
    )
    placed = positions(leaves, "tree", ["order", "leaf"], "merkle-order").withColumn("node", F.col("leaf"))
    climbed = _climb(placed, fan_out)
    above, subroots = _above(_blocks(climbed, fan_out), fan_out)
    forest = positions(
        subroots.select(F.lit("root").alias("tree"), F.col("tree").alias("member"), F.col("node").alias("subroot")),
        "tree", ["member"], "merkle-forest",
    ).withColumn("node", F.col("subroot"))
    forest_climbed = _climb(forest, fan_out)
    higher, root = _above(_blocks(forest_climbed, fan_out), fan_out)
    trees = salted_join(_join_above(forest_climbed, higher), root.withColumnRenamed("node", "root"),
                        ["tree"], ["pos"])
    trees = trees.select(F.col("member").alias("tree"), "subroot", F.col("steps").alias("last"), "root")
    above = salted_join(above, trees, ["tree"], ["pos"])
    above = above.withColumn("steps", F.concat("steps", "last")).drop("last")
    return _join_above(climbed, above).select(
        F.col("order").alias(order),
        F.when(F.col("tree") != "0", F.expr("substring(tree, 2)")).alias(group),
        "leaf", "subroot", "root", "steps", *[F.col(f"also_{name}").alias(name) for name in also or {}],
    )
