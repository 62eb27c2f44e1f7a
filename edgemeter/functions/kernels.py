"""NumPy helpers that run inside Spark tasks.

They travel to the executors by value, so the package need not be installed
there.
"""

from __future__ import annotations

import sys
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Least eigenvalue of a pivot block, relative to its largest, that still counts as regular.
DEPENDENT = 1e-10


def dense_rows(pdf: pd.DataFrame, width: int | None = None) -> np.ndarray:
    """Packed sparse rows `_f`, `_v` as a dense matrix; features are positions
    when `width` is given."""
    lengths = pdf["_f"].map(len).to_numpy()
    names = np.concatenate(pdf["_f"].to_numpy())
    if width is None:
        names, distinct = pd.factorize(names)
        width = len(distinct)
    out = np.zeros((len(pdf), width))
    out[np.repeat(np.arange(len(pdf)), lengths), names] = np.concatenate(pdf["_v"].to_numpy())
    return out


def with_keys(out: pd.DataFrame, pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Put the group's key values in front of its result."""
    for i, key in enumerate(keys):
        out.insert(i, key, pdf[key].iloc[0])
    return out


def pack_blocks(keys: list[str]):
    """One row for each run of equal `keys`, in which the rows come sorted: items
    and features once each, and the values with their numbers in these lists."""

    def pack(held):
        table = pa.Table.from_batches(held)
        out = {c: [table.column(c)[0].as_py()] for c in [*keys, "_blocks"]}
        for column, names, numbers in (("_item", "_items", "_i"), ("_feature", "_features", "_f")):
            coded = table.column(column).combine_chunks().dictionary_encode()
            out[names], out[numbers] = [coded.dictionary], [coded.indices]
        out["_v"] = [table.column("_v").combine_chunks()]
        lists = {
            c: pa.ListArray.from_arrays(pa.array([0, len(out[c][0])], pa.int32()), out[c][0])
            for c in ("_items", "_features", "_i", "_f", "_v")}
        order = [*keys[:-2], "_blocks", "_b", "_c"]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(out[c], table.schema.field(c).type) for c in order), *lists.values()],
            names=[*order, *lists])

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for key in keys:
                code = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= code[1:] != code[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                head = tuple(batch.column(key)[a].as_py() for key in keys)
                if held and head != last:
                    yield pack(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = head
        if held:
            yield pack(held)

    return run


class _BlockSum:
    """Inner products of two item blocks, summed chunk by chunk."""

    def __init__(self, same: bool):
        self.same = same
        self.places: tuple[dict, dict] = ({}, {})
        self.total = np.zeros((128, 128))
        self.open_chunk()

    def open_chunk(self) -> None:
        self.numbers: dict = {}
        self.rows: tuple[list, list] = ([], [])

    def add(self, side: int, items: list, features: list, i: np.ndarray, f: np.ndarray, v: np.ndarray) -> None:
        """A block's values on the open chunk."""
        places, numbers = self.places[side], self.numbers
        at = np.array([places.setdefault(x, len(places)) for x in items])
        to = np.array([numbers.setdefault(x, len(numbers)) for x in features])
        self.rows[side].append((at, i, to[f], v))

    def close_chunk(self) -> None:
        if self.rows[0] and (self.same or self.rows[1]):
            left, at = self._dense(self.rows[0])
            right, to = (left, at) if self.same else self._dense(self.rows[1])
            need = max(at.max(), to.max()) + 1
            if need > len(self.total):
                wider = np.zeros((2 * need, 2 * need))
                wider[: len(self.total), : len(self.total)] = self.total
                self.total = wider
            self.total[np.ix_(at, to)] += left @ right.T
        self.open_chunk()

    def _dense(self, rows):
        (at, i, f, v), = rows  # a block and chunk is one row
        out = np.zeros((len(at), len(self.numbers)))
        out[i, f] = v
        return out, at

    def pairs(self):
        """(item_a, item_b, dot) with item_a <= item_b."""
        left = np.array(list(self.places[0]), object)
        right = left if self.same else np.array(list(self.places[1]), object)
        rows, cols = np.triu_indices(len(left)) if self.same else np.indices((len(left), len(right))).reshape(2, -1)
        first, second = left[rows], right[cols]
        swap = first > second
        return np.where(swap, second, first), np.where(swap, first, second), self.total[rows, cols]


def block_sums(keys: list[str]):
    """Products of the block pairs of a partition, whose rows come sorted by
    `keys`, block pair, lane and chunk."""

    def run(batches):
        state, place, chunk = None, None, None

        def emit():
            state.close_chunk()
            a, b, dot = state.pairs()
            columns = [pa.array([k] * len(dot), kind) for k, kind in zip(place, kinds, strict=False)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(a, item_kind), pa.array(b, item_kind), pa.array(dot)],
                names=[*keys, "item_a", "item_b", "dot"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            item_kind = batch.schema.field("_items").type.value_type
            heads = list(zip(*(batch.column(k).to_pylist() for k in [*keys, "_lo", "_hi", "_lane"]), strict=True))
            for i, head in enumerate(heads):
                row = {c: batch.column(c)[i] for c in ("_b", "_c", "_items", "_features", "_i", "_f", "_v")}
                if head != place:
                    if state is not None:
                        yield emit()
                    state, place, chunk = _BlockSum(head[-3] == head[-2]), head, row["_c"]
                elif row["_c"] != chunk:
                    state.close_chunk()
                    chunk = row["_c"]
                # Copies: the batch goes away before its chunk is complete.
                numbers = [row[c].values.to_numpy().copy() for c in ("_i", "_f", "_v")]
                state.add(int(row["_b"].as_py() != head[-3]), row["_items"].as_py(), row["_features"].as_py(), *numbers)
        if state is not None:
            yield emit()

    return run


def inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], bit by bit from the top."""
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(max(int(ranks.max(initial=0)).bit_length(), 1) - 1, -1, -1):
        prefix = ranks >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        ones = (ranks[order] >> bit) & 1
        before = np.cumsum(ones) - ones
        starts = np.searchsorted(prefix[order], prefix[order], side="left")
        total += int(((before - before[starts]) * (1 - ones)).sum())
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b; 0 where undefined."""
    n = len(x)

    def tied(*columns):
        counts = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
        return int((counts * (counts - 1) // 2).sum())

    if n < 2:
        return 0.0
    pairs = n * (n - 1) // 2
    tx, ty, both = tied(x), tied(y), tied(x, y)
    root = np.sqrt(float(pairs - tx) * float(pairs - ty))
    if root == 0:
        return 0.0
    discordant = inversions(y[np.lexsort((y, x))])
    return (pairs - tx - ty + both - 2 * discordant) / root


def zero_inflated(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """tau11 and both exceedance shares of every gene pair of two blocks."""
    dense, genes, block = dense_rows(pdf), pdf["gene"].to_numpy(), pdf["_b"].to_numpy()
    low, high = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
    present = dense != 0

    def exceed(i, j):
        """Share of i's values where j is 0 above those where j is not."""
        with_j = np.sort(dense[i, present[i] & present[j]])
        alone = dense[i, present[i] & ~present[j]]
        if len(with_j) == 0:
            return 1.0
        if len(alone) == 0:
            return 0.0
        return np.searchsorted(with_j, alone, side="left").sum() / (len(with_j) * len(alone))

    rows = []
    for i in np.flatnonzero(block == low):
        for j in np.flatnonzero(block == high):
            if genes[i] == genes[j] or (low == high and genes[i] > genes[j]):
                continue
            a, b = (i, j) if genes[i] < genes[j] else (j, i)
            shared = present[a] & present[b]
            tau = kendall(dense[a, shared], dense[b, shared])
            rows.append((genes[a], genes[b], int(shared.sum()), tau, exceed(a, b), exceed(b, a)))
    columns = ["item_a", "item_b", "n11", "tau", "p1_ab", "p1_ba"]
    return with_keys(pd.DataFrame(rows, columns=columns), pdf, keys)


def two_sided_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided Student p-value: the regularised incomplete beta function
    I_x(df/2, 1/2) at x = df / (df + t^2), by its continued fraction."""
    tiny = 1e-300

    def fraction(a, b, x):
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 500):
            for top in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        return h

    a, b = df / 2, np.full_like(df, 0.5)
    x = df / (df + t * t)
    shapes, which = np.unique(a, return_inverse=True)
    log_beta = np.array([lgamma(v) + lgamma(0.5) - lgamma(v + 0.5) for v in shapes])[which]
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta)
    small = x < (a + 1) / (a + b + 2)
    direct = front * fraction(a, b, np.where(small, x, 0.0)) / a
    mirror = 1 - front * fraction(b, a, np.where(small, 0.0, 1 - x)) / b
    return np.where(x >= 1, 1.0, np.where(small, direct, mirror))


def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    known = (t.notna() & df.notna()).to_numpy()
    out = np.full(len(t), np.nan)
    out[known] = two_sided_t(t.to_numpy(float)[known], df.to_numpy(float)[known])
    return pd.Series(out)


# ---- blocks of one matrix ---------------------------------------------------


def fill_block(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    height, width = int(pdf["_h"].iloc[0]), int(pdf["_w"].iloc[0])
    dense = np.zeros((height, width))
    dense[pdf["_r"].to_numpy(), pdf["_c"].to_numpy()] = pdf["v"].to_numpy()
    out = pd.DataFrame({"h": [height], "w": [width], "a": [dense.ravel()]})
    return with_keys(out, pdf, [*keys, "bi", "bj"])


def eliminate_block(pdf: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    """One block after the elimination round of pivot block k."""
    r = pdf.iloc[0]
    a = r["a"]
    if r["p"] is not None:
        size = int(r["ph"])
        pivot = np.asarray(r["p"]).reshape(size, size)
        spectrum = np.linalg.eigvalsh((pivot + pivot.T) / 2)
        if spectrum[0] <= DEPENDENT * max(spectrum[-1], 1.0):
            where = "/".join(str(r[key]) for key in keys)
            raise ValueError(f"{where}: singular matrix, some genes follow from others")
        inverse = np.linalg.inv(pivot)
        block = np.asarray(a).reshape(int(r["h"]), int(r["w"]))
        if r["bi"] == k and r["bj"] == k:
            block = inverse
        elif r["bi"] == k:
            block = inverse @ block
        elif r["bj"] == k:
            block = -block @ inverse
        else:
            left = np.asarray(r["left"]).reshape(int(r["h"]), size)
            up = np.asarray(r["up"]).reshape(size, int(r["w"]))
            block = block - left @ inverse @ up
        a = block.ravel()
    out = pd.DataFrame({"a": [a]})
    return with_keys(out, pdf, [*keys, "bi", "bj", "h", "w"])


def block_entries(pdf: pd.DataFrame, keys: list[str], size: int) -> pd.DataFrame:
    r = pdf.iloc[0]
    i, j = np.indices((int(r["h"]), int(r["w"]))).reshape(2, -1)
    out = pd.DataFrame({
        "i": i + int(r["bi"]) * size, "j": j + int(r["bj"]) * size, "v": np.asarray(r["a"]),
    })
    return with_keys(out, pdf, keys)
