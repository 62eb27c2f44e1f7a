"""Networks inferred from expression, and imports of foreign results (A2-A8,
A20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.blockinverse import BLOCK, block_inverse
from edgemeter.functions.columns import ratio, valid_number
from edgemeter.functions.gram import pair_products
from edgemeter.functions.joins import salted_join, spread_by
from edgemeter.functions.kernels import t_pvalue
from edgemeter.functions.lagkernels import lagged_segments
from edgemeter.functions.ranking import mid_ranks, rank_offsets
from edgemeter.operators.association import (
    _products,
    _with_both,
    both_directions,
)
from edgemeter.operators.matrix import TRAJECTORY, ordered_expression
from edgemeter.operators.preprocess import GENE, cell_counts
from edgemeter.schema import CELL_KEYS, PAIR
from edgemeter.session import checkpointed

LAG_ITEMS = 16
LAG_CHUNK = 4096

# ---- partial rank correlation -----------------------------------------------


def partial_spearman(expr: DataFrame, block: int = BLOCK) -> DataFrame:
    """(dataset_id, run_id, gene1, gene2, weight, p_value): correlation of the
    gene ranks given all other genes, self pairs included.

    Needs more cells than genes; a constant gene or a singular matrix fails.
    """
    cells = cell_counts(expr)
    genes = expr.select(*GENE).distinct()
    # One row per gene, far below one task's memory.
    index = Window.partitionBy(*CELL_KEYS).orderBy("gene")
    genes = checkpointed(genes.withColumn("ix", F.row_number().over(index) - 1).join(cells, CELL_KEYS))
    sizes = genes.groupBy(*CELL_KEYS, "n_cells").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.filter(F.col("n_cells") <= F.col("n")).first()
    if few is not None:
        raise ValueError(f"{few.dataset_id}/{few.run_id}: needs more cells than genes")
    present = expr.filter(F.col("value") != 0)
    ranked = checkpointed(rank_offsets(present, GENE, "value", cells, CELL_KEYS, "n_cells"))
    rows = present.select(*GENE, "cell", "value").join(
        ranked.select(*GENE, "value", "d"), [*GENE, "value"]
    )
    n, d = F.col("n").cast("double"), F.col("d")
    moments = ranked.groupBy(*GENE, "n_cells").agg(
        F.sum(n * d).alias("s"), F.sum(n * d * d).alias("ss")
    )
    moments = moments.withColumn("v", F.col("ss") - F.col("s") * F.col("s") / F.col("n_cells"))
    flat = genes.join(moments, GENE, "left").filter(F.coalesce("v", F.lit(0.0)) <= 0).first()
    if flat is not None:
        raise ValueError(f"{flat.dataset_id}/{flat.run_id}: gene {flat.gene} is constant")
    pairs = _with_both(_products(rows, "d"), moments, ["s", "v"]).join(cells, CELL_KEYS)
    cov = F.col("dot") - F.col("s_a") * F.col("s_b") / F.col("n_cells")
    upper = pairs.select(
        *CELL_KEYS, F.col("item_a").alias("gene1"), F.col("item_b").alias("gene2"),
        F.when(F.col("item_a") == F.col("item_b"), 1.0)
        .otherwise(ratio(cov, F.sqrt("v_a") * F.sqrt("v_b"))).alias("v"),
    )
    full = both_directions(upper.filter(F.col("gene1") != F.col("gene2"))).unionByName(
        upper.filter(F.col("gene1") == F.col("gene2"))
    )

    def place(df, gene, ix):
        side = genes.select(*CELL_KEYS, F.col("gene").alias(gene), F.col("ix").alias(ix))
        return df.join(side, [*CELL_KEYS, gene])

    entries = place(place(full, "gene1", "i"), "gene2", "j").select(*CELL_KEYS, "i", "j", "v")
    inverse = checkpointed(
        block_inverse(entries, sizes.select(*CELL_KEYS, "n"), CELL_KEYS, block)
    )
    diagonal = inverse.filter(F.col("i") == F.col("j"))
    for end in ("i", "j"):
        side = diagonal.select(*CELL_KEYS, F.col("i").alias(end), F.col("v").alias(f"d{end}"))
        inverse = inverse.join(side, [*CELL_KEYS, end])
    for gene, end in (("gene1", "i"), ("gene2", "j")):
        side = genes.select(*CELL_KEYS, F.col("gene").alias(gene), F.col("ix").alias(end))
        inverse = inverse.join(side, [*CELL_KEYS, end])
    own = F.col("i") == F.col("j")
    scaled = -F.col("v") / F.sqrt(F.col("di") * F.col("dj"))
    weight = F.when(own, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled)))
    out = inverse.join(sizes, CELL_KEYS).withColumn("weight", weight)
    pvalue = F.pandas_udf(t_pvalue, "double")
    df = (F.col("n_cells") - F.col("n")).cast("double")  # n_cells - 2 - (genes - 2)
    t = F.col("weight") * F.sqrt(df / F.greatest(F.lit(1e-300), 1 - F.col("weight") ** 2))
    return out.select(
        *CELL_KEYS, *PAIR, "weight",
        F.when(own, 0.0).otherwise(pvalue(F.when(~own, t), df)).alias("p_value"),
    )


def gate_pvalue(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Keep significant weights, set the others to 0, drop undefined ones."""
    tested = pairs.filter(valid_number("p_value"))
    kept = F.when(F.col("p_value") <= cutoff, F.col("weight")).otherwise(F.lit(0.0))
    return tested.withColumn("weight", kept).drop("p_value")


# ---- lagged correlation -----------------------------------------------------


def lagged_network(expr: DataFrame, pt: DataFrame, max_lag: float = 0.33) -> DataFrame:
    """(dataset_id, run_id, trajectory, gene1, gene2, weight, lag): signed
    correlation of largest size over lags 0..floor(max_lag * cells), gene1
    leading, on a window of fixed length; the smallest lag wins a tie (to
    nine places).

    A task takes two blocks of genes and one segment of lags, and streams their
    series chunk by chunk, so it holds two chunks of each however long they are.
    """
    rows = ordered_expression(expr, pt).select(
        *TRAJECTORY, "gene", F.col("cell_index").cast("long").alias("at"), "value")
    cells = pt.groupBy(*TRAJECTORY).agg(F.count(F.lit(1)).cast("int").alias("n"))
    names = rows.groupBy(*TRAJECTORY, "gene").agg(F.sum("value").alias("sum"))
    blocks = names.groupBy(*TRAJECTORY).agg(F.ceil(F.count(F.lit(1)) / LAG_ITEMS).cast("int").alias("blocks"))
    shape = cells.join(blocks, TRAJECTORY).select(
        *TRAJECTORY, "n", "blocks", F.floor(F.col("n") * max_lag).cast("int").alias("max_lag"),
        F.least(F.lit(LAG_CHUNK), F.pow(2, F.ceil(F.log2("n")))).cast("int").alias("length"))
    none = F.array().cast("array<int>")
    headers = salted_join(names, shape, TRAJECTORY, ["gene"]).select(
        *TRAJECTORY, "gene", *shape.columns[len(TRAJECTORY):], F.lit(None).cast("int").alias("chunk"),
        none.alias("places"), F.array(F.col("sum") / F.col("n")).alias("values"))
    chunk = F.expr("at div length").cast("int")
    chunks = (
        salted_join(rows, shape, TRAJECTORY, ["gene", "at"])
        .groupBy(*TRAJECTORY, "gene", *shape.columns[len(TRAJECTORY):], chunk.alias("chunk"))
        .agg(F.collect_list(F.struct((F.col("at") % F.col("length")).cast("int").alias("p"), "value")).alias("held"))
        .select(*headers.columns[:-2], F.col("held.p").alias("places"), F.col("held.value").alias("values"))
    )
    packed = headers.unionByName(chunks).withColumn("own", F.pmod(F.xxhash64("gene"), F.col("blocks")).cast("int"))
    packed = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.expr("max_lag div length").cast("int"))))
    window = F.col("n") - F.col("max_lag")
    steps = F.ceil(window / F.col("length")).cast("int")
    common = [*TRAJECTORY, "n", "max_lag", "length", "segment", "gene", "places", "values"]
    # A leading chunk waits for the following chunk that is `segment` + 1 further on.
    leading = packed.filter(F.col("chunk").isNull() | (F.col("chunk") < steps)).select(
        *common, F.col("own").alias("lead"), F.col("other").alias("follow"), F.lit(1).alias("role"),
        F.coalesce(F.col("chunk") + 1, F.lit(-1)).alias("step"))
    moved = F.col("chunk") - F.col("segment")
    following = packed.filter(F.col("chunk").isNull() | ((moved >= 0) & (moved <= steps))).select(
        *common, F.col("other").alias("lead"), F.col("own").alias("follow"), F.lit(0).alias("role"),
        F.coalesce(moved, F.lit(-1)).alias("step"))
    where = [*TRAJECTORY, "lead", "follow", "segment"]
    types = dict(pt.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in TRAJECTORY)
    found = (
        spread_by(leading.unionByName(following), *where)
        .sortWithinPartitions(*where, "step", "role")
        .mapInArrow(lagged_segments(TRAJECTORY), schema + ", gene1 string, gene2 string, weight double, lag int")
    )
    best = F.max_by(F.struct("weight", "lag"), F.struct(F.round(F.abs("weight"), 9), -F.col("lag")))
    return found.groupBy(*TRAJECTORY, *PAIR).agg(best.alias("best")).select(
        *TRAJECTORY, *PAIR, "best.weight", "best.lag")


# ---- merging and importing --------------------------------------------------


def merge_trajectories(edges: DataFrame, absolute: bool = False, one_row: bool = False) -> DataFrame:
    """Merge the edges of all trajectories of a run: rows equal to the largest
    weight of their pair, all of them unless `one_row`. `absolute` takes
    absolute weights first."""
    rows = edges.filter(valid_number("weight"))
    if absolute:
        rows = rows.withColumn("weight", F.abs("weight"))
    copies = rows.groupBy(*CELL_KEYS, *PAIR, "weight").agg(F.count(F.lit(1)).alias("_k"))
    best = copies.groupBy(*CELL_KEYS, *PAIR).agg(
        F.max(F.struct("weight", "_k")).alias("_best")
    ).select(*CELL_KEYS, *PAIR, "_best.weight", "_best._k")
    if one_row:
        return best.drop("_k")
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))
    return best.withColumn("_i", repeated).drop("_i", "_k")


def _matrix_cells(matrix: DataFrame, genes: DataFrame) -> DataFrame:
    """(dataset_id, run_id, gene1, gene2, value) from rows (row_ix, values) and
    gene positions (gene_ix, gene)."""
    cells = matrix.select(*CELL_KEYS, "row_ix", F.posexplode("values").alias("col_ix", "value"))
    for gene, ix in (("gene1", "row_ix"), ("gene2", "col_ix")):
        side = genes.select(*CELL_KEYS, F.col("gene_ix").cast("int").alias(ix), F.col("gene").alias(gene))
        cells = cells.withColumn(ix, F.col(ix).cast("int")).join(side, [*CELL_KEYS, ix])
    return cells.select(*CELL_KEYS, *PAIR, "value")


def matrix_to_edges(matrix: DataFrame, genes: DataFrame, absolute: bool = True) -> DataFrame:
    """Square matrix to pairs, row gene first, self pairs kept."""
    value = F.abs("value") if absolute else F.col("value")
    return _matrix_cells(matrix, genes).select(*CELL_KEYS, *PAIR, value.cast("double").alias("weight"))


def rank_matrix_to_edges(matrix: DataFrame, genes: DataFrame) -> DataFrame:
    """Square matrix of ranks to weights: genes squared minus rank."""
    sizes = genes.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("_g"))
    cells = salted_join(_matrix_cells(matrix, genes), sizes, CELL_KEYS, PAIR)
    weight = (F.col("_g") * F.col("_g") - F.col("value")).cast("double")
    return cells.select(*CELL_KEYS, *PAIR, weight.alias("weight"))


# Columns of foreign result tables as gene1, gene2, weight.
LAYOUTS = {
    "regulator": ("TF", "target", "importance"),
    "parent": ("Parent", "Child", "Probability"),
    "plain": ("Gene1", "Gene2", "EdgeWeight"),
    "source_second": ("TargetGENES", "SourceGENES", "Interaction"),
}


def import_edges(table: DataFrame, layout: str) -> DataFrame:
    """Foreign result table to gene1, gene2, weight; other key columns stay.

    `headerless` takes the last three columns by position.
    """
    if layout == "headerless":
        names = tuple(table.columns[-3:])
    elif layout in LAYOUTS:
        names = LAYOUTS[layout]
    else:
        raise ValueError(f"layout must be 'headerless' or one of {sorted(LAYOUTS)}")
    keys = [c for c in table.columns if c in (*CELL_KEYS, "trajectory", "algorithm_id")]
    first, second, weight = names
    return table.select(
        *keys, F.col(first).alias("gene1"), F.col(second).alias("gene2"),
        F.col(weight).cast("double").alias("weight"),
    )


# ---- information network ----------------------------------------------------


def discretise(expr: DataFrame, bins: int) -> DataFrame:
    """(dataset_id, run_id, gene, cell, bin) of the non-zero values: `bins` bins
    of about equal count per gene, equal values together. Zeros are a bin of
    their own and stay implicit."""
    present = expr.filter(F.col("value") != 0).select(*GENE, "cell", "value")
    sizes = present.groupBy(*GENE).agg(F.count(F.lit(1)).alias("_k"))
    ranked = mid_ranks(present, GENE, "value").join(sizes, GENE)
    place = F.floor((F.col("mid") - 0.5) * bins / F.col("_k")).cast("int")
    ranked = ranked.select(*GENE, "value", place.alias("bin"))
    return present.join(ranked, [*GENE, "value"]).select(*GENE, "cell", "bin")


def joint_counts(expr: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """Joint bin counts of every ordered gene pair, and single counts.

    joint: (dataset_id, run_id, ga, ba, gb, bb, c); single: (.., g, b, c, n).
    The counts of the zero bin (-1) follow by subtraction from the counts of
    present values, so the matrix stays sparse.
    """
    rows = checkpointed(discretise(expr, bins))
    cells = cell_counts(expr)
    genes = expr.select(*GENE).distinct()
    item = F.concat_ws("\x01", "gene", F.col("bin").cast("string"))
    marked = rows.select(*CELL_KEYS, item.alias("item"), "cell", F.lit(1.0).alias("one"))
    shared = pair_products(marked, CELL_KEYS, "item", "cell", "one", True)
    split = lambda c, i: F.split(c, "\x01")[i]
    both = shared.select(
        *CELL_KEYS,
        split("item_a", 0).alias("ga"), split("item_a", 1).cast("int").alias("ba"),
        split("item_b", 0).alias("gb"), split("item_b", 1).cast("int").alias("bb"),
        F.round("dot").cast("long").alias("c"),
    )
    turned = F.array(
        F.struct("ga", "ba", "gb", "bb"),
        F.struct(F.col("gb").alias("ga"), F.col("bb").alias("ba"),
                 F.col("ga").alias("gb"), F.col("ba").alias("bb")),
    )
    different = (F.col("ga") != F.col("gb")) & (F.col("c") > 0)
    # Read by every branch below.
    pairs = checkpointed(both.filter(different).select(*CELL_KEYS, F.inline(turned), "c"))
    single = rows.groupBy(*GENE, "bin").agg(F.count(F.lit(1)).alias("c"))
    found = single.groupBy(*GENE).agg(F.sum("c").alias("_k"))
    zero = (
        genes.join(found, GENE, "left").join(cells, CELL_KEYS)
        .withColumn("c", F.col("n_cells") - F.coalesce("_k", F.lit(0)))
        .filter(F.col("c") > 0)
        .select(*GENE, F.lit(-1).alias("bin"), "c")
    )
    single = single.unionByName(zero).join(cells, CELL_KEYS).select(
        *CELL_KEYS, F.col("gene").alias("g"), F.col("bin").alias("b"), "c", F.col("n_cells").alias("n")
    )
    # Left value present, right value zero: single count minus what is shared.
    seen = pairs.groupBy(*CELL_KEYS, "ga", "ba", "gb").agg(F.sum("c").alias("_s"))
    plain = single.select(*CELL_KEYS, F.col("g").alias("ga"), F.col("b").alias("ba"), F.col("c").alias("_c"))
    partners = genes.select(*CELL_KEYS, F.col("gene").alias("gb"))
    grid = salted_join(plain.filter("ba >= 0"), partners, CELL_KEYS, ["ga", "ba"]).filter("ga <> gb")
    right_zero = (
        grid.join(seen, [*CELL_KEYS, "ga", "ba", "gb"], "left")
        .withColumn("c", F.col("_c") - F.coalesce("_s", F.lit(0)))
        .filter("c > 0")
        .select(*CELL_KEYS, "ga", "ba", "gb", F.lit(-1).alias("bb"), "c")
    )
    right_zero = checkpointed(right_zero)
    left_zero = right_zero.select(
        *CELL_KEYS, F.col("gb").alias("ga"), F.lit(-1).alias("ba"), F.col("ga").alias("gb"),
        F.col("ba").alias("bb"), "c",
    )
    some = left_zero.groupBy(*CELL_KEYS, "ga", "gb").agg(F.sum("c").alias("_s"))
    blank = salted_join(plain.filter("ba = -1"), partners, CELL_KEYS, ["ga"]).filter("ga <> gb")
    zero_zero = (
        blank.join(some, [*CELL_KEYS, "ga", "gb"], "left")
        .withColumn("c", F.col("_c") - F.coalesce("_s", F.lit(0)))
        .filter("c > 0")
        .select(*CELL_KEYS, "ga", F.lit(-1).alias("ba"), "gb", F.lit(-1).alias("bb"), "c")
    )
    joint = pairs.unionByName(right_zero).unionByName(left_zero).unionByName(zero_zero)
    return joint, single


def information_network(expr: DataFrame, bins: int = 5) -> DataFrame:
    """(dataset_id, run_id, gene1, gene2, mi, puc, weight) for gene1 < gene2.

    Mutual information of the binned genes; the share of it that no third gene
    explains, summed over third genes; and the sum of that share's rank among
    the pairs of either gene, scaled to [0, 1]. The sum over third genes comes
    from running sums of sorted specific informations, so no triple is built.
    """
    joint, single = joint_counts(expr, bins)
    joint, single = checkpointed(joint), checkpointed(single)
    a = single.select(*CELL_KEYS, F.col("g").alias("ga"), F.col("b").alias("ba"), F.col("c").alias("ca"), "n")
    b = single.select(*CELL_KEYS, F.col("g").alias("gb"), F.col("b").alias("bb"), F.col("c").alias("cb"))
    cells = joint.join(a, [*CELL_KEYS, "ga", "ba"]).join(b, [*CELL_KEYS, "gb", "bb"])
    c, ca, cb, n = (F.col(x).cast("double") for x in ("c", "ca", "cb", "n"))
    # Specific information of source gb about the target ga being in bin ba.
    specific = cells.groupBy(*CELL_KEYS, "ga", "ba", "gb").agg(
        F.sum(c / ca * F.ln(c * n / (ca * cb))).alias("s"), F.max(ca / n).alias("p")
    )
    specific = checkpointed(specific)
    per_bin = Window.partitionBy(*CELL_KEYS, "ga", "ba")  # one row per other gene
    upto = per_bin.orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    others = F.count(F.lit(1)).over(per_bin)
    below, at_most = F.sum("s").over(upto), F.count(F.lit(1)).over(upto)
    # Sum over third genes of the smaller specific information, itself left out.
    shared = below + F.col("s") * (others - at_most) - F.col("s")
    target = (
        specific.withColumn("_shared", shared)
        .withColumn("_others", others - 1)
        .groupBy(*CELL_KEYS, "ga", "gb")
        .agg(
            F.sum(F.col("p") * F.col("s")).alias("mi"),
            F.sum(F.col("p") * F.col("_shared")).alias("_red"),
            F.max("_others").alias("_z"),
        )
        .withColumn("unique", F.col("_z") * F.col("mi") - F.col("_red"))
    )
    left = target.filter("ga < gb").select(*CELL_KEYS, "ga", "gb", "mi", F.col("unique").alias("u1"))
    right = target.filter("ga > gb").select(
        *CELL_KEYS, F.col("gb").alias("ga"), F.col("ga").alias("gb"), F.col("unique").alias("u2")
    )
    puc = checkpointed(left.join(right, [*CELL_KEYS, "ga", "gb"]).select(
        *CELL_KEYS, F.col("ga").alias("gene1"), F.col("gb").alias("gene2"), "mi",
        F.round(F.coalesce(F.when(F.col("mi") > 1e-12, ratio(F.col("u1") + F.col("u2"), "mi")), F.lit(0.0)), 9).alias("puc"),
    ))
    sided = both_directions(puc.select(*CELL_KEYS, *PAIR, "puc"))
    own = Window.partitionBy(*CELL_KEYS, "gene1").orderBy("puc").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    share = F.count(F.lit(1)).over(own) / F.count(F.lit(1)).over(Window.partitionBy(*CELL_KEYS, "gene1"))
    shares = sided.withColumn("f", share)
    up = shares.filter("gene1 < gene2").select(*CELL_KEYS, *PAIR, F.col("f").alias("f1"))
    down = shares.filter("gene1 > gene2").select(
        *CELL_KEYS, F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), F.col("f").alias("f2")
    )
    return (
        puc.join(up, [*CELL_KEYS, *PAIR]).join(down, [*CELL_KEYS, *PAIR])
        .select(*CELL_KEYS, *PAIR, "mi", "puc", (F.col("f1") + F.col("f2")).alias("weight"))
    )


def information_edges(expr: DataFrame, bins: int = 5) -> DataFrame:
    """Both directions of `information_network` as weighted pairs."""
    return both_directions(information_network(expr, bins).select(*CELL_KEYS, *PAIR, "weight"))


__all__ = [
    "LAYOUTS", "gate_pvalue", "import_edges", "information_edges", "information_network",
    "lagged_network", "matrix_to_edges", "merge_trajectories", "partial_spearman",
    "rank_matrix_to_edges",
]
