"""Edge-list building blocks: dedup, candidate universe, thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.columns import half_even, valid_number
from edgemeter.functions.joins import mark_member, salt_count, salted_join, spread_by
from edgemeter.functions.ranking import chunk_of, cumulate, number_rows, placed, rank_blocks
from edgemeter.schema import KEYS, PAIR

UNIVERSES = ("directed", "tf", "tf_self", "undirected")


def not_self() -> Column:
    return F.col("gene1") != F.col("gene2")


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(not_self())


def by_pair(edges: DataFrame) -> DataFrame:
    """All rows of a pair of a dataset in one partition, so that its rows are
    grouped and met with the true edges after one shuffle of the lists.

    The number of partitions is explicit: lists compress well, and partitions
    merged by compressed bytes spill when they are grouped and sorted.
    """
    return spread_by(edges, "dataset_id", *PAIR)


def best_abs(edges: DataFrame) -> DataFrame:
    """(keys, gene1, gene2, score): largest absolute weight per pair."""
    return (
        by_pair(edges.filter(valid_number("weight")).select(*KEYS, *PAIR, "weight"))
        .groupBy(*KEYS, *PAIR)
        .agg(F.max(F.abs("weight")).alias("score"))
    )


def best_signed(edges: DataFrame) -> DataFrame:
    """(keys, gene1, gene2, weight): weight of the row with the largest
    absolute weight; the smallest `ord` wins a tie."""
    rows = drop_self_loops(edges).filter(valid_number("weight")).select(*KEYS, *PAIR, "weight", "ord")
    # Only the largest and the smallest weight can win; numbers in the buffers need no sort.
    ends = (
        by_pair(rows)
        .groupBy(*KEYS, *PAIR, "weight")
        .agg(F.min("ord").alias("ord"))
        .groupBy(*KEYS, *PAIR)
        .agg(
            F.max("weight").alias("_high"), F.max_by("ord", "weight").alias("_at_high"),
            F.min("weight").alias("_low"), F.min_by("ord", "weight").alias("_at_low"),
        )
    )
    high, low = F.col("_high"), F.col("_low")
    earlier = F.col("_at_high").isNull() | (F.col("_at_low") < F.col("_at_high"))
    best = F.when(high > -low, high).when((high < -low) | earlier, low).otherwise(high)
    return ends.select(*KEYS, *PAIR, best.alias("weight"))


# ---- ground truth ---------------------------------------------------------


def gt_genes(gt: DataFrame, with_self_loops: bool = True) -> DataFrame:
    """(dataset_id, gene): genes on any ground-truth row."""
    rows = gt if with_self_loops else drop_self_loops(gt)
    return rows.select("dataset_id", F.explode(F.array(*PAIR)).alias("gene")).distinct()


def gt_sources(gt: DataFrame, with_self_loops: bool = False) -> DataFrame:
    rows = gt if with_self_loops else drop_self_loops(gt)
    return rows.select("dataset_id", F.col("gene1").alias("gene")).distinct()


def true_edges(gt: DataFrame, kind: str = "directed") -> DataFrame:
    """(dataset_id, gene1, gene2): distinct non-self edges inside the universe.

    Sources and targets of every universe come from the ground truth, so all
    of its edges lie inside; the undirected one holds sorted pairs.
    """
    _check(kind)
    rows = drop_self_loops(gt)
    if kind == "undirected":
        rows = rows.select(
            "dataset_id",
            F.least(*PAIR).alias("gene1"),
            F.greatest(*PAIR).alias("gene2"),
        )
    return rows.select("dataset_id", *PAIR).distinct()


def universe_sizes(gt: DataFrame, kind: str = "directed") -> DataFrame:
    """(dataset_id, n_pairs, n_true) in closed form; no pair is built."""
    _check(kind)
    genes = gt_genes(gt).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    true = true_edges(gt, kind).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_true"))
    sizes = genes.join(true, "dataset_id", "left")
    n = F.col("_n")
    if kind == "directed":
        pairs = n * (n - 1)
    elif kind == "undirected":
        pairs = F.expr("_n * (_n - 1) div 2")
    else:
        sources = (
            gt_sources(gt, with_self_loops=kind == "tf_self")
            .groupBy("dataset_id")
            .agg(F.count(F.lit(1)).alias("_s"))
        )
        sizes = sizes.join(sources, "dataset_id", "left")
        s = F.coalesce(F.col("_s"), F.lit(0))
        pairs = s * n if kind == "tf_self" else s * (n - 1)
    return sizes.select(
        "dataset_id",
        pairs.alias("n_pairs"),
        F.coalesce("n_true", F.lit(0)).alias("n_true"),
    )


#: The universe exports are cut into tiles: a chunk of sources meets a block of
#: genes, whose strips its task unfolds.
CHUNK, STRIP, BLOCK = 64, 256, 16_384


def _sources(gt: DataFrame, kind: str) -> DataFrame:
    """(dataset_id, gene1): first genes of the pairs of a universe."""
    if kind in ("tf", "tf_self"):
        left = gt_sources(gt, with_self_loops=kind == "tf_self")
    else:
        left = gt_genes(gt)
    return left.withColumnRenamed("gene", "gene1")


def _cut(gt: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Sources and genes in order, cut into parts of almost equal size.

    (dataset_id, gene1, _chunk, _chunks, _blocks) and (dataset_id, gene, _strip,
    _block, _chunks, _blocks); parts count from 0.
    """
    sides = gt_genes(gt).withColumn("_leads", F.lit(False)).unionByName(
        _sources(gt, kind).select("dataset_id", F.col("gene1").alias("gene"), F.lit(True).alias("_leads"))
    )
    genes = placed(sides.dropna(subset=["dataset_id"]), ["dataset_id", "_leads"], ["gene"], "_place")
    strip = min(STRIP, BLOCK)
    counts = genes.groupBy("dataset_id").agg(
        F.count_if("_leads").alias("_s"), F.count_if(~F.col("_leads")).alias("_n")
    ).select(
        "*", F.ceil(F.col("_s") / CHUNK).alias("_chunks"),
        F.ceil(F.col("_n") / strip).alias("_strips"), F.ceil(F.col("_n") / BLOCK).alias("_blocks"),
    )
    at = salted_join(genes, counts, ["dataset_id"], ["gene"])
    sources = at.filter("_leads").select(
        "dataset_id", F.col("gene").alias("gene1"),
        F.expr("_place * _chunks div _s").alias("_chunk"), "_chunks", "_blocks",
    )
    targets = at.filter(~F.col("_leads")).withColumn("_strip", F.expr("_place * _strips div _n")).select(
        "dataset_id", "gene", "_strip", F.expr("_strip * _blocks div _strips").alias("_block"), "_chunks", "_blocks"
    )
    return sources, targets


def _packed(rows: DataFrame, keys: list[str], gene: str, name: str) -> DataFrame:
    # A struct, as a bare collect_list would leave out a NULL gene.
    ordered = F.sort_array(F.collect_list(F.struct(F.col(gene).alias("gene"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["gene"]).alias(name))


def _part(tile: Column, tiles: Column, parts: int) -> Column:
    """Part of a tile: tiles in order, the first with the last, the second with
    the last but one, so that parts of a triangle are as large as one another."""
    folded = F.least(tile, tiles - 1 - tile)
    return F.floor(folded * parts / F.ceil(tiles / 2))


def _tiles(
    sources: DataFrame, targets: DataFrame, lists: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tiles and the blocks of strips they meet, both with their `_part`.

    (dataset_id, _chunk, _block, _sources, _part), for each row of `lists` with
    its keys, and (dataset_id, _block, _strips, _part). Tiles of a block stand in
    a row, so a part sees few blocks and its output repeats few genes.
    """
    parts = salt_count(sources)
    tiles = _packed(sources, ["dataset_id", "_chunk", "_chunks", "_blocks"], "gene1", "_sources")
    if lists is None:
        tiles = tiles.withColumns({"_list": F.lit(0), "_lists": F.lit(1)})
    else:
        whole = Window.partitionBy("dataset_id")
        # A row per list, so these windows stay small.
        numbers = {"_list": F.row_number().over(whole.orderBy(*KEYS[1:])) - 1, "_lists": F.count(F.lit(1)).over(whole)}
        tiles = salted_join(tiles, lists.withColumns(numbers), ["dataset_id"], ["_chunk"])
    tiles = tiles.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({
        "_tile": F.expr("(_block * _chunks + _chunk) * _lists + _list"), "_tiles": F.expr("_blocks * _chunks * _lists"),
    })
    tile, last = F.col("_tile"), F.col("_tiles") - 1
    middle = F.floor(last / 2)
    ends = tiles.groupBy("dataset_id", "_block", "_tiles").agg(F.min(tile).alias("_from"), F.max(tile).alias("_to"))
    outer = [_part(F.col(c), F.col("_tiles"), parts) for c in ("_from", "_to")]
    inner = F.when(middle.between(F.col("_from"), F.col("_to")), _part(middle, F.col("_tiles"), parts))
    spans = ends.select(
        "dataset_id", "_block",
        F.explode(F.sequence(F.least(*outer), F.coalesce(inner, F.greatest(*outer)))).alias("_part"),
    )
    strips = _packed(targets, ["dataset_id", "_block", "_strip"], "gene", "_genes")
    blocks = strips.groupBy("dataset_id", "_block").agg(
        F.sort_array(F.collect_list(F.struct("_strip", "_genes"))).alias("_strips")
    ).join(spans, ["dataset_id", "_block"])
    tiles = tiles.withColumn("_part", _part(tile, F.col("_tiles"), parts)).drop(
        "_chunks", "_blocks", "_list", "_lists", "_tile", "_tiles"
    )
    # Datasets begin at different parts.
    turned = F.pmod(F.col("_part") + F.xxhash64("dataset_id") % parts, F.lit(parts)).cast("int")
    return tiles.withColumn("_part", turned), blocks.withColumn("_part", turned)


def _met(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join tiles to the strips of their block, for work quadratic in the genes.

    Both sides are small in bytes, so the number of partitions is explicit;
    adaptive execution would merge them into very few tasks, and a hash would
    deal several parts to one task and none to another.
    """
    parts = salt_count(tiles)
    tiles, blocks = (side.repartitionById(parts, F.col("_part")) for side in (tiles, blocks))
    return tiles.join(blocks, ["dataset_id", "_block", "_part"])


def _crossed(strips: str, sources: str, cell: Callable[[Column, Column], Column]) -> Column:
    """A row for each strip and source, as all rows that a row unfolds to are held together."""
    rows = F.transform(strips, lambda strip: F.transform(sources, lambda source: cell(strip, source)))
    return F.explode(F.flatten(rows)).alias("_cell")


def _wanted(pairs: DataFrame, kind: str) -> DataFrame:
    if kind == "undirected":
        return pairs.filter(F.col("gene1") < F.col("gene2"))
    return pairs if kind == "tf_self" else pairs.filter(not_self())


def _unfolded(strip: Column, kind: str, rest: Column | None = None) -> Column:
    """A row per gene of the strip, or of its `rest`; none where the last gene
    of the strip does not follow `gene1`."""
    rest = strip if rest is None else rest
    if kind == "undirected":
        rest = F.when(F.col("gene1") < F.element_at(strip, -1), rest)
    return F.explode(rest).alias("gene2")


def universe(gt: DataFrame, kind: str = "directed") -> DataFrame:
    """(dataset_id, gene1, gene2): the universe as rows.

    Only for exports of the candidate list; the metrics use `universe_sizes`.
    The output itself is quadratic in the genes of one dataset; chunks of
    sources meet blocks of genes, which their task unfolds, so no pair is
    shuffled. All sources of a chunk run through one strip of genes after the
    other: columnar files store such short repeats in a fraction of a byte.
    """
    _check(kind)
    cells = _met(*_tiles(*_cut(gt, kind))).select("dataset_id", _crossed(
        "_strips", "_sources", lambda strip, gene: F.struct(gene.alias("gene1"), strip["_genes"].alias("_genes"))
    )).select("dataset_id", "_cell.*")
    return _wanted(cells.select("dataset_id", "gene1", _unfolded(F.col("_genes"), kind)), kind)


def align(edges: DataFrame, gt: DataFrame, kind: str = "directed") -> DataFrame:
    """(keys, gene1, gene2, score): every universe pair, absent ones as 0.

    The dense export; metrics use the implicit zero block instead. Only the
    scores are shuffled: a tile of `universe` knows by source and strip the genes
    that have a score, and its task leaves them out as it unfolds the strip.
    """
    _check(kind)
    scores = best_abs(drop_self_loops(edges)).dropna(subset=KEYS)
    scores = mark_universe(scores, gt, kind).filter("inside").drop("inside")
    sources, targets = _cut(gt, kind)
    tile = [*KEYS, "_chunk", "_block"]
    scored = scores.join(
        targets.select("dataset_id", F.col("gene").alias("gene2"), "_strip", "_block"), ["dataset_id", "gene2"]
    ).join(sources.select("dataset_id", "gene1", "_chunk"), ["dataset_id", "gene1"])
    scored = spread_by(scored.select(*tile, "_strip", *PAIR), *tile)
    scored = scored.groupBy(*tile, "gene1", "_strip").agg(F.collect_list("gene2").alias("_scored"))
    for level in ("_strip", "gene1"):
        keys = [k for k in (*tile, "gene1") if k != level]
        scored = scored.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct(level, "_scored"))).alias("_scored")
        )
    tiles, blocks = _tiles(sources, targets, edges.select(*KEYS).distinct())
    tiles = tiles.join(scored, tile, "left").withColumn("_sources", F.transform("_sources", lambda gene: F.struct(
        gene.alias("gene1"), F.element_at("_scored", gene).alias("_scored")
    ))).drop("_scored")
    cells = _met(tiles, blocks).select(*KEYS, _crossed("_strips", "_sources", lambda strip, source: F.struct(
        source["gene1"].alias("gene1"), strip["_genes"].alias("_genes"),
        F.element_at(source["_scored"], strip["_strip"]).alias("_scored"),
    ))).select(*KEYS, "_cell.*")
    rest = F.when(F.col("_scored").isNull(), F.col("_genes")).otherwise(F.array_except("_genes", "_scored"))
    absent = _wanted(cells.select(*KEYS, "gene1", _unfolded(F.col("_genes"), kind, rest)), kind)
    return scores.select(*KEYS, *PAIR, "score").unionByName(
        absent.withColumn("score", F.lit(0.0))
    )


def known_lists(edges: DataFrame, lists: DataFrame | None) -> DataFrame:
    """(keys) of the lists that have rows and of those that `lists` names."""
    seen = edges.select(*KEYS)
    return (seen if lists is None else seen.unionByName(lists.select(*KEYS))).distinct()


def label_true(rows: DataFrame, true: DataFrame) -> DataFrame:
    """Add `hit` (0/1): the pair is a true edge of the row's dataset."""
    marked = true.select("dataset_id", *PAIR).withColumn("_hit", F.lit(1))
    return rows.join(marked, ["dataset_id", *PAIR], "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(0))
    ).drop("_hit")


def mark_universe(rows: DataFrame, gt: DataFrame, kind: str = "directed") -> DataFrame:
    """Add boolean `inside`: the pair is a scoreable member of the universe."""
    _check(kind)
    genes = gt_genes(gt)
    left = genes
    if kind in ("tf", "tf_self"):
        left = gt_sources(gt, with_self_loops=kind == "tf_self")
    rows = mark_member(
        rows, left.withColumnRenamed("gene", "gene1"), ["dataset_id", "gene1"], "_in1"
    )
    rows = mark_member(
        rows, genes.withColumnRenamed("gene", "gene2"), ["dataset_id", "gene2"], "_in2"
    )
    valid = F.col("gene1") < F.col("gene2") if kind == "undirected" else not_self()
    return rows.withColumn("inside", valid & F.col("_in1") & F.col("_in2")).drop("_in1", "_in2")


# ---- top-k ----------------------------------------------------------------


def chosen(cum: str, n: str, k: str) -> Column:
    """The block of equal scores starts before rank k, hence is selected."""
    return (F.col(cum) - F.col(n)) < F.col(k)


def tie_thresholds(rows: DataFrame, k_by_dataset: DataFrame) -> DataFrame:
    """(keys, threshold): tie-aware cutoff of rank k over `score`.

    `rows` has keys and score, `k_by_dataset` has (dataset_id, k). The cutoff
    is the k-th largest score, raised to the smallest positive score when it
    would be zero; lists without a positive score keep everything.
    """
    hist = rows.groupBy(*KEYS, "score").agg(F.count(F.lit(1)).alias("n"))
    done = cumulate(hist, KEYS, "score", ["n"])
    picked = salted_join(done, k_by_dataset, ["dataset_id"], ["run_id", "algorithm_id", "score"])
    positive = F.when(F.col("score") > 0, F.col("score"))
    return picked.filter(F.col("k") > 0).groupBy(*KEYS).agg(
        F.greatest(
            F.min(F.when(chosen("cum_n", "n", "k"), F.col("score"))),
            F.coalesce(F.min(positive), F.lit(0.0)),
        ).alias("threshold")
    )


def topk_ties(edges: DataFrame, k_by_dataset: DataFrame) -> DataFrame:
    """(keys, gene1, gene2, score): best k pairs, ties at the cut included."""
    best = best_abs(drop_self_loops(edges))
    cut = tie_thresholds(best, k_by_dataset)
    return (
        salted_join(best, cut, KEYS, PAIR)
        .filter(F.col("score") >= F.col("threshold"))
        .drop("threshold")
    )


def topk_plain(edges: DataFrame, k_by_dataset: DataFrame) -> DataFrame:
    """(keys, gene1, gene2): exactly the first k rows by absolute weight, later
    rows first among equals, then made distinct."""
    rows = (
        drop_self_loops(edges)
        .filter(valid_number("weight"))
        .select(*KEYS, *PAIR, "ord", F.abs("weight").alias("score"))
    )
    blocks = rank_blocks(rows, KEYS, "score", "ord", True, True)
    blocks = salted_join(blocks, k_by_dataset, ["dataset_id"], ["run_id", "algorithm_id", "score"])
    blocks = blocks.filter(F.col("before") < F.col("k"))
    ranked = number_rows(rows, blocks, KEYS, "score", "ord", True)
    return ranked.filter(F.col("rank") <= F.col("k")).select(*KEYS, *PAIR).distinct()


def topk_positional(edges: DataFrame, k_by_dataset: DataFrame) -> DataFrame:
    """(keys, gene1, gene2, score): rows at least as strong as the row at file
    position k, after rounding to six places and dropping zeros and repeats."""
    rows = (
        drop_self_loops(edges)
        .filter(valid_number("weight"))
        .select(*KEYS, *PAIR, "ord", half_even(F.abs("weight"), 6).alias("score"))
        .filter(F.col("score") > 0)
        .groupBy(*KEYS, *PAIR, "score")
        .agg(F.min("ord").alias("ord"))
    )
    counts = (
        rows.withColumn("_chunk", chunk_of("ord"))
        .groupBy(*KEYS, "_chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per 2^20 file positions, so this window stays small.
    ahead = Window.partitionBy(*KEYS).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEYS)
    blocks = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("_size", F.sum("n").over(whole))
        .join(k_by_dataset, "dataset_id")
        .withColumn("_pos", F.least("_size", "k"))
        .filter((F.col("before") < F.col("_pos")) & (F.col("_pos") <= F.col("before") + F.col("n")))
        .select(*KEYS, "_chunk", "before", "_pos")
    )
    inside = Window.partitionBy(*KEYS, "_chunk").orderBy("ord")
    cut = (
        rows.withColumn("_chunk", chunk_of("ord"))
        .join(blocks, [*KEYS, "_chunk"])
        .withColumn("_at", F.col("before") + F.row_number().over(inside))
        .filter(F.col("_at") == F.col("_pos"))
        .select(*KEYS, F.col("score").alias("threshold"))
    )
    return (
        salted_join(rows, cut, KEYS, PAIR)
        .filter(F.col("score") >= F.col("threshold"))
        .select(*KEYS, *PAIR, "score")
    )


def k_true(gt: DataFrame) -> DataFrame:
    """(dataset_id, k): distinct non-self ground-truth edges."""
    return true_edges(gt).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("k"))


def k_rows(gt: DataFrame) -> DataFrame:
    """(dataset_id, k): non-self ground-truth rows, repeats counted."""
    return drop_self_loops(gt).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("k"))


def _check(kind: str) -> None:
    if kind not in UNIVERSES:
        raise ValueError(f"universe kind must be one of {UNIVERSES}, got {kind!r}")
