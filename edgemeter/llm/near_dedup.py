"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

Two collections of `m` sub-keys (each `r` MinHash values) are drawn per
document; the m*m table keys combine one sub-key of each collection. So
2*m*r MinHash values serve m*m tables of 2*r values each, where plain banding
needs 2*r*m*m. A pair at the threshold t misses all tables with probability at
most 2*(1 - t^r)^m, kept at about 0.001 by `collection_size`.

Nothing lists the pairs of a bucket. A bucket links its members to its smallest
one, by way of the smallest of a batch; these links are confirmed on the whole
shingle sets. Where the confirmed links leave the members of such a star in
several components, the members are compared across components in bounded blocks: the triangle inequality of the
Jaccard distance and a long signature rule most pairs out, the rest are
confirmed on the whole sets as well.
"""

from __future__ import annotations

import math
import secrets
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm import arrays
from edgemeter.llm.components import components
from edgemeter.llm.storage import plain, shuffle_partitions, staged, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUB_KEY_VALUES = 3
MISS = 0.001
TABLES = b"tables"
LONG_SIGNATURE = 512
DEVIATIONS = 4.5
BATCH_DOCS = 8_192
SLOT_PAIRS = 256
BLOCK_DOCS = 512


def collection_size(threshold: float, r: int = SUB_KEY_VALUES) -> int:
    """Sub-keys per collection so that a pair at the threshold is rarely missed."""
    return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - threshold**r) - 0.5))


def _minima(sets: np.ndarray, bounds: np.ndarray, n: int, stream: int) -> np.ndarray:
    """(rows, n) smallest values of n hash functions; rows without a set give 0."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, n), np.uint32)
    if len(some):
        at = bounds[some]
        for i, (a, c) in enumerate(zip(arrays.seeds(n, stream) | np.uint64(1),
                                       arrays.seeds(n, stream + 1), strict=True)):
            out[some, i] = np.minimum.reduceat(sets * a + c, at) >> np.uint64(32)
    return out


def _signer(k: int, m: int, r: int, key: bytes):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()),
                        ("f2", pa.int64()), ("sub", pa.binary())])

    def sign(batches):
        for batch in batches:
            for first, buf, offsets in arrays.text_slices(batch.column("text")):
                rows = len(offsets) - 1
                # Which tables two documents share must not change from run to run.
                minima = _minima(*arrays.text_shingles(buf, offsets, k, TABLES), 2 * m * r, 7).astype(np.uint64)
                sets, bounds = arrays.text_shingles(buf, offsets, k, key)
                sizes = np.diff(bounds)
                sub = np.zeros((rows, 2 * m), np.uint64)
                for j in range(2 * m):
                    sub[:, j] = np.uint64(j)
                    for x in range(r):
                        sub[:, j] = arrays.mix(sub[:, j] * np.uint64(31) + minima[:, j * r + x])
                total = np.concatenate([[np.uint64(0)], np.cumsum(arrays.mix(sets))])
                again = np.concatenate(
                    [[np.uint64(0)], np.cumsum(arrays.mix(sets ^ np.uint64(0x5851F42D4C957F2D)))]
                )
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, rows),
                    pa.array(sizes.astype(np.int64)),
                    pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
                    pa.array((again[bounds[1:]] - again[bounds[:-1]]).view(np.int64)),
                    pa.array([row.tobytes() for row in sub], pa.binary()),
                ], schema=schema)

    return sign


def _table_rows(m: int):
    """Table keys of a partition's documents.

    Documents of one batch that share a key are linked at once; only their
    smallest goes on under the key, so a hot key has a row per batch at most.
    """

    def emit(key, doc, other):
        for at in range(0, len(key), 1 << 18):
            cut = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[cut].view(np.int64)), pa.array(doc[cut]),
                 pa.array(other[cut], mask=other[cut] == np.iinfo(np.int64).min)],
                names=["key", "doc", "other"])

    def tables(held):
        table = pa.Table.from_batches(held)
        docs = table.column("doc_id").to_numpy()
        sub = np.frombuffer(b"".join(table.column("sub").to_pylist()), np.uint64)
        sub = sub.reshape(len(docs), 2 * m)
        order = np.argsort(docs, kind="stable")
        docs, sub = docs[order], sub[order]
        linked = []
        for i in range(m):
            keys, rows = [], []
            for j in range(m):
                key = arrays.mix(sub[:, i] * np.uint64(3) + sub[:, m + j])
                by = np.argsort(key, kind="stable")
                new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
                lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                keys.append(key[by][new])
                rows.append(docs[by][new])
                linked.append(np.stack([docs[lead], docs[by]], 1)[~new])
            key, row = np.concatenate(keys), np.concatenate(rows)
            yield from emit(key, row, np.full(len(row), np.iinfo(np.int64).min))
        pairs = np.unique(np.concatenate(linked), axis=0)
        spread = arrays.mix(pairs[:, 0].view(np.uint64) * np.uint64(7)
                            + arrays.mix(pairs[:, 1].view(np.uint64)))
        yield from emit(spread, np.ascontiguousarray(pairs[:, 1]), np.ascontiguousarray(pairs[:, 0]))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                if n + part.num_rows > BATCH_DOCS and held:
                    yield from tables(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield from tables(held)

    return run


def _long_signer(k: int):
    def sign(batches):
        for batch in batches:
            for first, buf, offsets in arrays.text_slices(batch.column("text")):
                sets, bounds = arrays.text_shingles(buf, offsets, k, TABLES)
                rows = _minima(sets, bounds, LONG_SIGNATURE, 17).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(rows)),
                    batch.column("text").slice(first, len(rows)),
                    pa.array([row.tobytes() for row in rows], pa.binary()),
                ], names=["doc_id", "text", "sig"])

    return sign


def _measurer(k: int, key: bytes):
    """Sizes of intersection and union of the two texts' whole shingle sets."""

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sides = []
                for name in ("text_a", "text_b"):
                    own = []
                    texts = part.column(name).dictionary_encode()  # a star's centre comes with each of its members
                    for _, buf, offsets in arrays.text_slices(texts.dictionary):
                        sets, bounds = arrays.text_shingles(buf, offsets, k, key)
                        own += np.split(sets, bounds[1:-1])
                    sides.append([own[i] for i in texts.indices.to_numpy()])
                both = np.array([len(np.intersect1d(x, y, assume_unique=True))
                                 for x, y in zip(*sides, strict=True)], np.int64)
                size = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(both), pa.array(size - both)],
                    names=["a", "b", "both", "either"])

    return measure


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, key: bytes) -> DataFrame:
    """(a, b, both, either) of pairs, counted on the whole texts.

    The left document of many pairs is copied once per SLOT_PAIRS of them, so
    no task gets all pairs of a hot document.
    """
    texts = texts.select("doc_id", "text")
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLOT_PAIRS).cast("int").alias("slots"))
    left = (
        pairs.join(degree, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"))
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    )
    right = degree.join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
    ).select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return left.join(right, ["a", "slot"]).select("a", "b", "text_a", "text_b").mapInArrow(
        _measurer(k, key), "a long, b long, both long, either long"
    )


def _linker(k: int, percent: int, key: bytes):
    """Links between different components of one block, confirmed on the whole
    sets; rows come sorted by block. Components that a link has joined are not
    compared again, so a block gives fewer links than it has documents."""
    threshold = percent / 100
    floor = LONG_SIGNATURE * threshold - DEVIATIONS * math.sqrt(
        LONG_SIGNATURE * threshold * (1 - threshold)
    )

    def candidates(doc, comp, away, rest, sig):
        for i in np.flatnonzero(rest):
            near = (comp != comp[i]) & ~(np.abs(away - away[i]) > 1 - threshold + 1e-9)
            near = np.flatnonzero(near & (~rest | (doc > doc[i])))
            if len(near):
                same = (sig[near] == sig[i]).sum(1)
                yield from ((int(n), int(i), int(j)) for n, j in zip(same, near, strict=True) if n >= floor)

    def solve(block):
        comp = block.column("comp").to_numpy()
        rest = block.column("rest").to_numpy(zero_copy_only=False)
        if not rest.any() or (comp == comp[0]).all():
            return []
        doc = block.column("doc").to_numpy()
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8)
        pairs = list(candidates(doc, comp, block.column("away").to_numpy(), rest,
                                sig.reshape(len(doc), LONG_SIGNATURE)))
        if not pairs:
            return []
        used = sorted({i for _, *ends in pairs for i in ends})
        sets = {}
        texts = block.column("text").take(pa.array(used))
        for first, buf, offsets in arrays.text_slices(texts):
            found, bounds = arrays.text_shingles(buf, offsets, k, key)
            sets.update(zip(used[first:], np.split(found, bounds[1:-1]), strict=False))
        root: dict[int, int] = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        links = []
        for _, i, j in sorted(pairs, key=lambda x: (-x[0], *x[1:])):
            one, other = find(int(comp[i])), find(int(comp[j]))
            if one == other:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(one, other)] = min(one, other)
                links.append((int(doc[i]), int(doc[j])))
        return links

    def emit(links):
        a, b = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        tail = None
        for batch in batches:
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([batch.column(c).to_numpy() for c in ("a", "kind", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            edges = [0, *cuts.tolist()]
            links = [x for p, q in zip(edges[:-1], edges[1:], strict=True) for x in solve(batch.slice(p, q - p))]
            tail = batch.slice(edges[-1])
            if links:
                yield emit(links)
        if tail is not None and tail.num_rows:
            links = solve(tail)
            if links:
                yield emit(links)

    return run


def _across(
    stars: DataFrame, measured: DataFrame, comps: DataFrame, texts: DataFrame, k: int, percent: int,
    key: bytes,
) -> DataFrame:
    """Links between components among the members of each star.

    The members of a star's most frequent component need no comparison with
    each other; the others meet them, and one another, in blocks of at most
    2 * BLOCK_DOCS members.
    """
    comp_of = comps.select(F.col("node").alias("doc"), F.col("component"))
    direct = measured.select(
        "a", F.col("b").alias("doc"), (1 - F.col("both") / F.col("either")).alias("away"))
    # Members that a batch has linked to its own smallest one belong to the stars that one is in.
    unknown = F.lit(float("nan"))
    through = (
        stars.filter("not local").select("a", F.col("b").alias("lead"))
        .join(stars.filter("local").select(F.col("a").alias("lead"), F.col("b").alias("doc")), "lead")
        .select("a", "doc", unknown.alias("away"))
    )
    centres = stars.select("a", F.col("a").alias("doc"), F.lit(0.0).alias("away"))
    members = (
        direct.unionAll(through).unionAll(centres)
        .groupBy("a", "doc").agg(F.min("away").alias("away"))  # NaN is the largest value
        .join(comp_of, "doc", "left")
        .withColumn("comp", F.coalesce("component", "doc"))
        .select("a", "doc", "away", "comp")
    )
    per_comp = members.groupBy("a", "comp").agg(F.count(F.lit(1)).alias("n"))
    shape = (
        per_comp.groupBy("a")
        .agg(F.max(F.struct("n", F.col("comp").alias("bulk"))).alias("top"),
             F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"))
        .filter("comps > 1")
        .select("a", "top.bulk",
                F.ceil(F.col("top.n") / BLOCK_DOCS).cast("int").alias("n_bulk"),
                F.ceil((F.col("all") - F.col("top.n")) / BLOCK_DOCS).cast("int").alias("n_rest"))
    )
    placed = members.join(shape, "a").withColumn("rest", F.col("comp") != F.col("bulk"))
    mine = F.pmod(F.xxhash64("doc"), F.when(F.col("rest"), F.col("n_rest")).otherwise(F.col("n_bulk")))
    placed = placed.withColumn("own", mine.cast("int"))
    to_bulk = F.transform(
        F.sequence(F.lit(0), F.col("n_bulk") - 1),
        lambda j: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), j.alias("j")))
    to_rest = F.transform(
        F.sequence(F.lit(0), F.col("n_rest") - 1),
        lambda j: F.struct(F.lit(0).alias("kind"), F.least("own", j).alias("i"),
                           F.greatest("own", j).alias("j")))
    from_bulk = F.transform(
        F.sequence(F.lit(0), F.col("n_rest") - 1),
        lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("own").alias("j")))
    blocks = F.when(F.col("rest"), F.concat(to_rest, to_bulk)).otherwise(from_bulk)
    return (
        placed.join(texts.select(F.col("doc_id").alias("doc"), "text", "sig"), "doc")
        .select("a", "doc", "away", "comp", "rest", "text", "sig", F.explode(blocks).alias("block"))
        .select("a", "block.kind", "block.i", "block.j", "doc", "away", "comp", "rest", "text", "sig")
        .repartition(shuffle_partitions(stars), "a", "kind", "i", "j")
        .sortWithinPartitions("a", "kind", "i", "j")
        .mapInArrow(_linker(k, percent, key), "a long, b long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their
    sets of distinct k-word shingles (A-Z lowered, words split at ASCII white
    space). A text of fewer than k words has its whole word sequence as its
    only shingle; an empty or null text has an empty set and no link. The
    component is named by its smallest doc_id, the row that is kept. Rows
    repeated under one id appear as often as they are given; a row without id
    takes no part and is kept, with a null component.
    """
    # Sets are compared under a key drawn now, for which no text can be made to collide.
    key = secrets.token_bytes(16)
    r = SUB_KEY_VALUES
    m = collection_size(percent / 100, r)
    rows = plain(docs, id_col, text_col)
    signed = staged(
        rows.mapInArrow(
            _signer(k, m, r, key), "doc_id long, n_shingles long, f1 long, f2 long, sub binary"
        ),
        "signed",
    )
    same_set = ["f1", "f2", "n_shingles"]
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = staged(named.groupBy(*same_set).agg(F.min("doc_id").alias("class_id")), "classes")
    leads = named.join(
        classes.select(*same_set, F.col("class_id").alias("doc_id")), [*same_set, "doc_id"]
    ).select("doc_id", "sub")

    keyed = leads.mapInArrow(_table_rows(m), "key long, doc long, other long")
    first = F.min("doc").over(Window.partitionBy("key"))
    stars = staged(
        keyed.select(
            F.coalesce("other", first).alias("a"), F.col("doc").alias("b"),
            F.col("other").isNotNull().alias("local"),
        )
        .filter("a <> b")
        .distinct(),
        "stars",
    )
    met = stars.select(F.col("a").alias("doc_id")).unionAll(stars.select(F.col("b"))).distinct()
    texts = staged(
        # The same join at every size: how many documents meet others grows with the data.
        rows.join(met.hint("merge"), "doc_id", "left_semi").mapInArrow(
            _long_signer(k), "doc_id long, text string, sig binary"
        ),
        "texts",
    )
    passed = F.col("both") * 100 >= F.col("either") * percent
    measured = staged(_confirm(stars.select("a", "b").distinct(), texts, k, key), "measured")
    links = measured.filter(passed).select("a", "b")
    comps = components(links)
    more = staged(_across(stars, measured, comps, texts, k, percent, key), "more")
    if not more.isEmpty():
        comps = components(links.unionAll(more))

    classes = classes.join(
        comps.select(F.col("node").alias("class_id"), F.col("component")), "class_id", "left"
    ).select(*same_set, F.coalesce("component", "class_id").alias("component"))
    out = signed.drop("sub").join(classes, same_set, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all their columns."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    name = unused(docs, "_gone")
    gone = found.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
