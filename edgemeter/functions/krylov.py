"""Leading right singular vectors of large sparse matrices, one job a step.

The matrix stays cut into tiles of gene blocks and cell chunks. A step
multiplies a block of directions by all tiles and back, adds the result to a
basis that is spread over the gene blocks, and solves the small problem of the
basis' own products (columns x columns numbers, the only thing summed in one
task). The residuals of the best directions are the next block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.functions import krylovkernels as task
from edgemeter.functions.gram import packed_blocks
from edgemeter.functions.joins import salted_join, spread_by
from edgemeter.session import checkpointed

WIDTH = 16
COLUMNS = 96
TOLERANCE = 1e-11
STEPS = 200


def _sum(parts: DataFrame, keys: list[str], schema: str, within: list[str]) -> DataFrame:
    ordered = spread_by(parts, *keys).sortWithinPartitions(*keys, *within)
    return ordered.mapInArrow(task.sum_blocks(keys), schema)


def leading_vectors(
    rows: DataFrame, group: list[str], item: str, feature: str, value: str, minus: str, k: int,
    tolerance: float = TOLERANCE, steps: int = STEPS,
) -> DataFrame:
    """(group, item, vector): for each group the first `k` eigenvectors of X'JX,
    X being features x items and J the signs of the features (`minus` rows: -1).

    `rows` is sparse, one row per (group, item, feature); feature names of plus
    and minus rows need not differ. The search ends when the residuals of all k are at
    most `tolerance` of the largest value, and fails after `steps` steps. With
    fewer than k directions in a group, `vector` is padded with 0.
    """
    width = max(WIDTH, 2 * k)
    types = dict(rows.dtypes)
    named = ", ".join(f"{c} {types[c]}" for c in group)
    sided = rows.withColumn(
        "_side", F.concat(F.when(F.col(minus), "-").otherwise("+"), F.col(feature).cast("string"))
    )
    tiles = checkpointed(packed_blocks(sided, group, item, "_side", value))
    by_items = f"{named}, _b int, _names array<{types[item]}>"
    by_features = f"{named}, _c int, _names array<string>"
    block, chunk = [*group, "_b"], [*group, "_c"]
    # A name may be in several tiles of its block.
    names = tiles.select(*block, F.explode("_items").alias("_n")).distinct().groupBy(*block).agg(
        F.sort_array(F.collect_list("_n")).alias("_names")
    )
    state = checkpointed(
        names.mapInArrow(task.starting_block(width), f"{named}, _b int, _names array<{types[item]}>, _m array<double>")
        .withColumn("_q", F.lit(None).cast("array<double>")).withColumn("_aq", F.lit(None).cast("array<double>"))
    )
    for _ in range(steps):
        ahead = tiles.join(state.select(*block, "_names", "_m"), block).mapInArrow(
            task.tile_products([*chunk, "_b"], ("_items", "_i"), ("_features", "_f"), True),
            f"{named}, _c int, _b int, _names array<string>, _m array<double>")
        ahead = _sum(ahead, chunk, f"{by_features}, _m array<double>", ["_b"])
        back = tiles.join(ahead, chunk).mapInArrow(
            task.tile_products([*block, "_c"], ("_features", "_f"), ("_items", "_i"), False),
            f"{named}, _b int, _c int, _names array<{types[item]}>, _m array<double>")
        back = _sum(back, block, f"{by_items}, _m array<double>", ["_c"])
        grown = state.join(
            back.select(*block, F.col("_names").alias("_zn"), F.col("_m").alias("_z")), block
        ).mapInArrow(task.append_block(group), f"{by_items}, _q array<double>, _aq array<double>")
        grown = checkpointed(grown)
        small = grown.mapInArrow(
            task.small_products(block), f"{named}, _b int, _names array<string>, _m array<double>")
        small = _sum(small, group, f"{named}, _names array<string>, _m array<double>", ["_b"])
        best = checkpointed(small.mapInArrow(
            task.ritz(group, COLUMNS, 2 * width), f"{named}, _y array<double>, _theta array<double>"))
        # A row of at most COLUMNS + width squared numbers per group goes to each of its blocks.
        state = salted_join(grown, best, group, ["_b"]).mapInArrow(
            task.turn_basis(group, width),
            f"{by_items}, _q array<double>, _aq array<double>, _m array<double>, _r array<double>")
        rest = state.groupBy(*group).agg(*[
            F.sum(F.coalesce(F.get("_r", i), F.lit(0.0))).alias(f"_r{i}") for i in range(k)
        ]).agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"_r{i}") for i in range(k)]))).first()[0]
        if (rest or 0.0) <= tolerance**2:
            break
    else:
        raise RuntimeError(f"no {k} leading vectors within {steps} steps; residual {rest ** 0.5:.1e}")
    columns = F.expr("cast(size(_q) / size(_names) as int)")
    return state.select(
        *group, "_q", columns.alias("_w"), F.posexplode("_names").alias("_at", item)
    ).select(
        *group, item, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(
            i < F.col("_w"), F.get("_q", F.col("_at") * F.col("_w") + i)).otherwise(F.lit(0.0))).alias("vector"),
    )
