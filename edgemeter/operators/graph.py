"""Motif counts and path statistics on directed graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.functions import pathkernels
from edgemeter.functions.columns import ratio
from edgemeter.functions.joins import spread_by
from edgemeter.functions.ranking import placed
from edgemeter.operators.primitives import (
    k_true,
    known_lists,
    label_true,
    topk_plain,
    topk_positional,
    true_edges,
)
from edgemeter.schema import KEYS, PAIR
from edgemeter.session import checkpointed, stored

MOTIFS = ["fbl", "ffl", "mi"]


def motif_counts(graph: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fbl, ffl, mi) of a distinct, self-loop-free directed graph.

    Each triangle is found once, from its node of least degree, so a hub does
    not pair up all of its neighbours; the directions decide the motif. The
    heavy joins run on numbers that stand for a node of one graph.
    """
    a, b = PAIR
    linked = graph.groupBy(
        *keys, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    ).agg(
        F.max((F.col(a) < F.col(b)).cast("int")).alias("uv"),
        F.max((F.col(a) > F.col(b)).cast("int")).alias("vu"),
    )
    # Read three times below; the graph may come from a long ranking plan.
    linked = checkpointed(linked)
    mutual = linked.groupBy(*keys).agg(F.sum(F.col("uv") * F.col("vu")).alias("mi"))
    nodes = (
        linked.select(*keys, F.explode(F.array("u", "v")).alias("node"))
        .groupBy(*keys, "node")
        .agg(F.count(F.lit(1)).alias("deg"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    nodes = checkpointed(nodes)  # also fixes the ids
    for end in ("u", "v"):
        side = nodes.select(
            *keys, F.col("node").alias(end), F.col("deg").alias(f"d{end}"), F.col("id").alias(f"i{end}")
        )
        linked = linked.join(side, [*keys, end])
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("iu") < F.col("iv")))

    def pick(x, y):
        return F.when(first, F.col(x)).otherwise(F.col(y))

    # p precedes q in (degree, id) order; `way` holds pq in bit 0, qp in bit 1.
    oriented = stored(linked.select(
        pick("iu", "iv").alias("p"), pick("iv", "iu").alias("q"), pick("dv", "du").alias("dq"),
        (pick("uv", "vu") + 2 * pick("vu", "uv")).alias("way"),
    ), "oriented")
    # In this order a node has at most sqrt(2 * edges) later neighbours, so they fit one row.
    later = F.sort_array(F.collect_list(F.struct(F.col("dq").alias("d"), F.col("q").alias("id"), "way")))
    near = spread_by(oriented, "p").groupBy("p").agg(later.alias("_later"))

    def of_way(nodes, way):
        return F.transform(F.filter(nodes, lambda x: x["way"] == way), lambda x: x["id"])

    def by_way(nodes, name):
        """Node ids of an array of neighbours, an array for each way."""
        return [of_way(nodes, way).alias(f"{name}{way}") for way in (1, 2, 3)]

    # A wedge is p, q and one of the ids after q; they travel as arrays to the neighbours of q.
    tails = near.select("p", "_later", F.posexplode("_later").alias("_at", "_to")).filter(
        F.col("_at") + 1 < F.size("_later")
    )
    rest = F.slice("_later", F.col("_at") + 2, F.size("_later"))
    wedges = tails.select("p", F.col("_to.id").alias("q"), F.col("_to.way").alias("way"), *by_way(rest, "_p"))
    closing = near.select(F.col("p").alias("q"), *by_way(F.col("_later"), "_q"))
    meeting = spread_by(wedges, "q").join(closing, "q")

    def motifs(w_pq, w_pr, w_qr):
        """(cycles, forward) of a triangle by the ways of its three sides."""
        (pq, qp), (pr, rp), (qr, rq) = ((w & 1, w >> 1) for w in (w_pq, w_pr, w_qr))
        # source, middle, target in each of the six orders
        forward = pq * pr * qr + pr * pq * rq + qp * qr * pr + qr * qp * rp + rp * rq * pq + rq * rp * qp
        return pq * qr * rp + pr * rq * qp, forward

    def total(which):
        value = F.lit(0).cast("long")
        for i in (1, 2, 3):
            for j in (1, 2, 3):
                each = F.array(*[F.lit(motifs(w, i, j)[which]) for w in (1, 2, 3)])
                shared = F.size(F.array_intersect(f"_p{i}", f"_q{j}"))
                value = value + shared * F.element_at(each, F.col("way").cast("int"))
        return F.sum(value)

    per_node = meeting.groupBy("p").agg(total(0).alias("fbl"), total(1).alias("ffl"))
    loops = (
        per_node.join(nodes.select(*keys, F.col("id").alias("p")), "p")
        .groupBy(*keys)
        .agg(F.sum("fbl").alias("fbl"), F.sum("ffl").alias("ffl"))
    )
    return mutual.join(loops, keys, "left").select(
        *keys, *[F.coalesce(m, F.lit(0)).alias(m) for m in MOTIFS]
    )


def motif_ratios(edges: DataFrame, gt: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(keys, fbl, ffl, mi): motif counts of the plain top-k graph over those
    of the ground truth; NULL where the ground truth has none. `lists` may name
    lists without rows; they have no motif."""
    k = k_true(gt)
    predicted = motif_counts(topk_plain(edges, k), KEYS)
    reference = motif_counts(true_edges(gt), ["dataset_id"]).select(
        "dataset_id", *[F.col(m).alias(f"_ref_{m}") for m in MOTIFS]
    )
    lists = known_lists(edges, lists).join(reference, "dataset_id")
    joined = lists.join(predicted, KEYS, "left")
    return joined.select(
        *KEYS, *[ratio(F.coalesce(m, F.lit(0)), f"_ref_{m}").alias(m) for m in MOTIFS]
    )


#: Sources that share a word of the path search.
WORD_BITS = 64
#: Words of 64 sources that a task of the path search holds, three times over; at least one per node.
HELD_WORDS = 1 << 22
#: Edges that a chunk has about, edges that a task sorts at most to read them once a round, rounds of a job.
CHUNK_EDGES, SORTED_EDGES, ROUNDS = 1 << 14, 1 << 26, 8


def shortest_lengths(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """(dataset_id, gene1, gene2, length) of the shortest directed path for
    each wanted pair that has one.

    A search from all wanted sources, cut into blocks; a task searches from one
    block at once, a bit for each source and node, while the edges pass by in
    chunks, once a round. So edges are shuffled once per block instead of bits
    once per edge, and a round leaves nothing on disk. A job has a bounded
    number of rounds; only of blocks that still miss a target and reach new
    nodes the bits go on to a further job.
    """
    spark = graph.sparkSession
    graph = graph.select("dataset_id", *PAIR).distinct()
    names = placed(
        graph.select("dataset_id", F.explode(F.array(*PAIR)).alias("gene")).distinct(), [], ["dataset_id", "gene"], "id"
    )
    nodes = names.count()

    def numbered(rows, columns):
        for gene, column in zip(PAIR, columns):
            side = names.select("dataset_id", F.col("gene").alias(gene), F.col("id").alias(column))
            rows = rows.join(side, ["dataset_id", gene])
        return rows

    step = stored(
        numbered(graph, ["node", "next"]).select(F.col("node").cast("int"), F.col("next").cast("int")), "steps"
    )
    edges = step.count()
    named = stored(numbered(pairs.select("dataset_id", *PAIR).distinct(), ["source", "target"]), "wanted")
    sources = placed(named.select("source").distinct(), [], ["source"], "place")
    # Small searches still fill the cores, large ones the memory of a task.
    words = -(-sources.count() // WORD_BITS)
    shared = -(-words // (2 * spark.sparkContext.defaultParallelism))
    width = max(1, min(HELD_WORDS // max(1, nodes), shared))
    size = width * WORD_BITS
    blocks = max(1, -(-words // width))
    rounds = max(1, min(ROUNDS, SORTED_EDGES // max(1, edges)))

    by_end = step.groupBy("next", F.shiftright("node", 20).alias("_part")).agg(F.collect_list("node").alias("_from"))
    chunk = F.pmod(F.xxhash64("next"), F.lit(max(1, edges // CHUNK_EDGES)))
    ends = by_end.groupBy(chunk.alias("_chunk"), "_part").agg(F.collect_list(F.struct("next", "_from")).alias("_ends"))
    chunks = stored(ends.select(
        F.flatten(F.transform("_ends", lambda e: e["_from"])).alias("a"),
        F.flatten(F.transform("_ends", lambda e: F.array(e["next"], F.size(e["_from"])))).alias("b"),
    ), "edges")

    def marked(rows, node, turn):
        """Pairs of slot and node, a row for each range of nodes and word of sources."""
        rows = rows.select(
            F.expr(f"CAST(place DIV {size} AS INT)").alias("block"),
            F.pmod("place", F.lit(size)).cast("int").alias("slot"), F.col(node).cast("int").alias("node"),
        )
        near = rows.groupBy("block", F.shiftright("node", 12).alias("_near"), F.shiftright("slot", 6).alias("_word"))
        return near.agg(F.collect_list(F.struct("slot", "node")).alias("_pairs")).select(
            "block", F.lit(turn).alias("turn"), F.col("_pairs.slot").alias("a"), F.col("_pairs.node").alias("b")
        )

    state = marked(sources, "source", pathkernels.START).unionByName(
        marked(named.join(sources, "source"), "target", pathkernels.WANTED)
    )
    found, done, still = [], 0, range(blocks)
    while still:
        passing = chunks.select(
            F.explode(F.array(*map(F.lit, still))).alias("block"), F.lit(pathkernels.EDGES).alias("turn"), "a", "b"
        )
        # The rounds of a chunk are told apart behind the shuffle.
        every = F.when(
            F.col("turn") == pathkernels.EDGES, F.sequence(F.col("turn"), F.col("turn") + (rounds - 1))
        ).otherwise(F.array("turn"))
        turns = state.unionByName(passing).repartitionById(blocks, "block").select(
            "block", F.explode(every).alias("turn"), "a", "b"
        )
        out = stored(turns.sortWithinPartitions("block", "turn").mapInArrow(
            pathkernels.search(nodes, width, done), pathkernels.FOUND
        ), "found")
        found.append(out.filter("length IS NOT NULL"))
        state = out.filter("turn IS NOT NULL").select("block", "turn", "a", "b")
        still = [r.block for r in state.select("block").distinct().collect()]
        done += rounds
    hits = reduce(DataFrame.unionByName, found).select(
        (F.col("block").cast("long") * size + F.col("slot")).alias("place"),
        F.col("node").cast("long").alias("target"), "length",
    )
    lengths = hits.join(sources, "place")
    return named.join(lengths, ["source", "target"]).select("dataset_id", *PAIR, "length")


def path_stats(edges: DataFrame, gt: DataFrame) -> DataFrame:
    """(keys, len_0, len_2..len_5, num_pred, num_tp, num_fp_with_path,
    num_fp_no_path) for the positional top k of every list that keeps a row."""
    graph = true_edges(gt)
    chosen = topk_positional(edges, k_true(gt)).select(*KEYS, *PAIR).distinct()
    labelled = stored(label_true(chosen, graph), "labelled")
    false = labelled.filter("hit = 0")
    lengths = shortest_lengths(false, graph)
    located = labelled.join(
        lengths.withColumn("hit", F.lit(0)), ["dataset_id", *PAIR, "hit"], "left"
    )
    length, miss = F.col("length"), F.col("hit") == 0
    return located.groupBy(*KEYS).agg(
        F.lit(0).cast("long").alias("len_0"),
        *[F.count_if(length == n).alias(f"len_{n}") for n in (2, 3, 4, 5)],
        F.count(F.lit(1)).alias("num_pred"),
        F.sum("hit").cast("long").alias("num_tp"),
        F.count_if(miss & length.isNotNull()).alias("num_fp_with_path"),
        F.count_if(miss & length.isNull()).alias("num_fp_no_path"),
    )
