"""Exact top-k by inner product: a Voronoi join.

Every vector, query or not, belongs to the nearest of a few pivots; the queries of
one cell form groups of bounded size. A cell is summarised by the
distances of its members from the pivot: the largest one and the k+1 smallest.
For a query q and a member x of the cell of p, the product is at least
q.p - |q| * |x-p| and at most q.p + |q| * |x-p|. The summaries' lower bounds
give each query a score that k vectors surely reach; only cells whose upper
bound comes up to it are searched. A block of data goes once to each query group
of which a member needs its cell, and is solved there with one matrix product.
"""

from __future__ import annotations

import math
import sys
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm.storage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 2048
MAX_PIVOTS = 512
LLOYD_ROUNDS = 4
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
SLACK = 1e-6
ROUNDING = 1e-15
HUGE = -1  # the cell of vectors with components beyond 64 bits: no bounds, always searched
HUGE_BYTES = 136  # holds every double times a scale of up to 2^60


def _quantise(scale: int):
    """Packed integer vectors; rows that take no part are left out."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            rows = []
            for vec_id, vector in zip(ids, batch.column("vector").to_pylist(), strict=True):
                if vec_id is None or vector is None or None in vector:
                    continue
                if not np.isfinite(np.asarray(vector, np.float64)).all():
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(np.asarray(vector, np.float64) * scale)
                if (np.abs(scaled) >= 2**63).any():
                    whole = [math.floor(Fraction(x) * scale) for x in vector]
                    cell = b"".join(x.to_bytes(HUGE_BYTES, "little", signed=True) for x in whole)
                else:
                    cell = scaled.astype(np.int64).tobytes()
                rows.append((vec_id, len(vector), cell))
            if rows:
                vec_id, dim, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vec_id, pa.int64()), pa.array(dim, pa.int32()), pa.array(packed, pa.binary())],
                    names=["vec_id", "dim", "packed"])

    return run


def _is_huge(cell: bytes, dim: int) -> bool:
    return len(cell) == HUGE_BYTES * dim and dim > 0


def _unpack(cells, dim: int | None = None) -> np.ndarray:
    cells = list(cells)
    if dim is not None and any(_is_huge(c, dim) for c in cells):
        out = np.empty((len(cells), dim), object)
        for row, cell in enumerate(cells):
            width = HUGE_BYTES if _is_huge(cell, dim) else 8
            out[row] = [int.from_bytes(cell[i : i + width], "little", signed=True)
                        for i in range(0, len(cell), width)]
        return out
    return np.frombuffer(b"".join(cells), np.int64).reshape(len(cells), -1)


def _centres(vectors: np.ndarray, n: int) -> np.ndarray:
    """n pivots: distant rows, then a few Lloyd rounds. Deterministic."""
    vectors = np.unique(vectors, axis=0).astype(np.float64)
    chosen = [0]
    away = np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        away = np.minimum(away, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(away.argmax()))
    pivots = vectors[chosen]
    for _ in range(LLOYD_ROUNDS):
        cell = _distances(vectors, pivots).argmin(1)
        for i in range(len(pivots)):
            if (cell == i).any():
                pivots[i] = vectors[cell == i].mean(0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(
        (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None, :], 0))


def _assign(pivots: dict[int, np.ndarray]):
    """Cell and distance of every vector."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            packed = batch.column("packed").to_pylist()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                who = np.flatnonzero(dims == dim)
                huge = np.array([_is_huge(packed[i], dim) for i in who])
                cell[who[huge]] = HUGE
                who = who[~huge]
                if not len(who):
                    continue
                x = _unpack(packed[i] for i in who).reshape(len(who), dim).astype(np.float64)
                p = pivots[int(dim)]
                cell[who] = _distances(x, p).argmin(1)
                away[who] = np.sqrt(((x - p[cell[who]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(away)],
                names=[*batch.schema.names, "cell", "away"])

    return run


def _needed(pivots: dict[int, np.ndarray], summary: dict[int, tuple], k: int):
    """Cells that each query has to search.

    `summary`: per dimension the cells, their radii and, per cell, the smallest
    distances. One more than k distances are kept, so that the query's own row
    may be among them.
    """

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            packed = batch.column("packed").to_pylist()
            lists: list = [None] * len(dims)
            for dim in np.unique(dims):
                who = np.flatnonzero(dims == dim)
                cells, radius, least, always = summary[int(dim)]
                huge = np.array([_is_huge(packed[i], dim) for i in who])
                for row in who[huge]:
                    lists[row] = cells.tolist() + always
                who = who[~huge]
                p = pivots[int(dim)][cells] if len(cells) else np.zeros((0, dim))
                for at in range(0, len(who), 1024):
                    part = who[at : at + 1024]
                    q = _unpack(packed[i] for i in part).reshape(len(part), dim).astype(np.float64)
                    norm = np.sqrt((q**2).sum(1))
                    at_pivot = q @ p.T
                    slack = SLACK * (1 + np.abs(at_pivot) + norm[:, None] * radius[None, :])
                    # Rounding of products that cancel, where components differ widely.
                    size = np.sqrt((p**2).sum(1)) + radius
                    slack += ROUNDING * (dim + 8) * norm[:, None] * size[None, :]
                    far = norm[:, None, None] * np.where(np.isinf(least), 0, least)[None, :, :]
                    sure = at_pivot[:, :, None] - far - slack[:, :, None]
                    sure[:, np.isinf(least)] = -np.inf  # the cell has fewer members
                    sure = np.sort(sure.reshape(len(part), -1), axis=1)[:, ::-1]
                    reach = sure[:, k] if sure.shape[1] > k else np.full(len(part), -np.inf)
                    best = at_pivot + norm[:, None] * radius[None, :] + slack
                    for row, keep in zip(part, best >= reach[:, None], strict=True):
                        lists[row] = cells[keep].tolist() + always
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "cells"])

    return run


def _solve(k: int):
    def run(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score", "copies"]
        if not len(queries) or not len(data):
            return pd.DataFrame(columns=columns).astype("int64")
        dim = int(queries["dim"].iloc[0])
        order = np.argsort(data["vec_id"].to_numpy(), kind="stable")
        ids, copies = data["vec_id"].to_numpy()[order], data["copies"].to_numpy()[order]
        x = _unpack(data["packed"].to_numpy()[order], dim)
        q = _unpack(queries["packed"], dim)
        own, times = queries["vec_id"].to_numpy(), queries["copies"].to_numpy()
        first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        most = lambda v: max((abs(int(y)) for y in (v.max(initial=0), v.min(initial=0))), default=0)
        bound = most(x) * most(q) * max(dim, 1)
        # Products below 2^53 are exact in doubles, and far faster there.
        kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
        x = x.astype(kind)
        out = []
        for at in range(0, len(q), 256):
            score = q[at : at + 256].astype(kind) @ x.T
            for i, row in enumerate(score, at):
                # Rows under the query's own id stand together.
                place = np.arange(len(row))
                if first[i] < last[i]:
                    place = np.delete(place, np.s_[first[i] : last[i]])
                    row = row[place]
                near = np.arange(len(row))
                if len(row) > k:
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                near = near[np.lexsort((ids[place[near]], -row[near]))][:k]
                out += [(own[i], ids[place[j]], int(row[j]), min(int(copies[place[j]]) * int(times[i]), k))
                        for j in near]
        return pd.DataFrame(out, columns=columns).astype("int64")

    return run


def top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Components become floor(scale * x). Queries are the rows whose id is
    divisible by `query_every`; the candidates are all other rows, the whole
    table. Ties go to the smaller id; with fewer candidates all are returned.
    Rows without an id, and vectors that are null or hold a null or a non-finite
    component, take no part. Rows repeated under one id are rows of their own:
    each is a candidate of the other ids, and a query asked by several rows gets
    the best of all their scores. Vectors of different lengths are not compared;
    only a score beyond 64 bits that would be returned raises. Pivots come from at most SAMPLE_ROWS rows;
    they decide the amount of work, not the result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    packed = staged(
        rows.mapInArrow(_quantise(scale), "vec_id long, dim int, packed binary")
        # Equal rows are solved once.
        .groupBy("vec_id", "dim", "packed").agg(F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    sizes = {r["dim"]: r["n"] for r in packed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        own = packed.filter((F.col("dim") == dim) & (F.length("packed") == 8 * F.col("dim")))
        sample = own.orderBy(F.xxhash64("vec_id", "packed"), "vec_id", "packed").limit(SAMPLE_ROWS).collect()
        wanted = min(MAX_PIVOTS, max(4, int(math.sqrt(n) / 16)))
        if sample:
            pivots[dim] = _centres(_unpack(r["packed"] for r in sample).reshape(len(sample), dim), wanted)
    data = staged(
        packed.mapInArrow(
            _assign(pivots), "vec_id long, dim int, packed binary, copies long, cell int, away double"),
        "cells",
    )
    nearest = F.row_number().over(Window.partitionBy("dim", "cell", "part").orderBy("away"))
    # Smallest distances first per part of a cell, then per cell: no cell is sorted in one task.
    # One row per id is enough for a bound, and the query's own id is then among them once.
    bounded = data.filter(F.col("cell") != HUGE)
    one = bounded.groupBy("vec_id", "dim").agg(F.min(F.struct("away", "cell")).alias("v"))
    least = one.select("dim", "v.cell", "v.away", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part"))
    least = least.withColumn("nth", nearest).filter(F.col("nth") <= k + 1)
    shape = data.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    # One row per cell, at most MAX_PIVOTS + 1 per dimension, each with k + 1 distances.
    cells = shape.join(
        least.groupBy("dim", "cell").agg(F.slice(F.array_sort(F.collect_list("away")), 1, k + 1).alias("least")),
        ["dim", "cell"], "left",
    ).collect()
    summary = {}
    for dim in sizes:
        own = sorted((r for r in cells if r["dim"] == dim and r["cell"] != HUGE), key=lambda r: r["cell"])
        table = np.full((len(own), k + 1), np.inf)
        for i, r in enumerate(own):
            table[i, : len(r["least"] or [])] = r["least"] or []
        summary[dim] = (
            np.array([r["cell"] for r in own], np.int64), np.array([r["radius"] for r in own], np.float64), table,
            [HUGE for r in cells if r["dim"] == dim and r["cell"] == HUGE])
    blocks = shape.select(
        "dim", "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = data.join(F.broadcast(blocks), ["dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "packed"), F.col("blocks")).cast("int"))

    queries = data.filter(F.col("vec_id") % query_every == 0)
    # Queries of one cell ask for much the same cells: a group never spans cells.
    groups = queries.groupBy("dim", "cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("long").alias("groups"))
    nth = F.pmod(F.xxhash64("vec_id", "packed"), F.col("groups"))
    queries = queries.join(F.broadcast(groups), ["dim", "cell"]).withColumn(
        "own", F.shiftleft(F.col("cell").cast("long"), 40) + nth)
    wanted = staged(
        queries.select("vec_id", "dim", "packed", "copies", "own").mapInArrow(
            _needed(pivots, summary, k),
            "vec_id long, dim int, packed binary, copies long, own long, cells array<int>"),
        "queries",
    )
    asked = wanted.select("vec_id", "dim", "packed", "copies", "own", F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(blocks), ["dim", "cell"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = ["dim", "cell", "block", "own"]
    # A data row goes to the query groups that need its cell, and to no other.
    needed = wanted.select("dim", "own", F.explode("cells").alias("cell")).distinct()
    there = [f"to_{name}" for name in meet]
    sent = placed.join(needed, ["dim", "cell"]).select(
        *[F.col(name).alias(to) for name, to in zip(meet, there, strict=True)], "vec_id", "packed", "copies")
    found = (
        asked.select(*meet, "vec_id", "packed", "copies").groupBy(*meet)
        .cogroup(sent.groupBy(*there))
        .applyInPandas(_solve(k), "query_id long, vec_id long, score long, copies long")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
