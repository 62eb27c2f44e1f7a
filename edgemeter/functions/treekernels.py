"""Histograms of regression-tree nodes on one block of cells; travels by value."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIME = 2147483647


def factor(seed: int, tree: int, node: int) -> int:
    """The multiplier that orders genes for a node, and cells (node 0) for a tree."""
    return 1 + (seed * 7919 + tree * 104729 + node * 1299709) % (PRIME - 1)


def drawn(hashes: np.ndarray, seed: int, tree: int, share: int) -> np.ndarray:
    """Which cells a tree sees: about `share` of a thousand."""
    return hashes * factor(seed, tree, 0) % PRIME % 1000 < share


def candidates(hashes: np.ndarray, seed: int, tree: int, node: int, n: int) -> np.ndarray:
    """The first n + 1 genes in the node's order; a target leaves itself out."""
    order = np.lexsort((np.arange(len(hashes)), hashes * factor(seed, tree, node) % PRIME))
    return order[: n + 1]


def grow(bins, values, targets, hashes, seen, splits, tree, depth, n_bins, n_candidates, seed, rate):
    """Rows (target, tree, node, candidate, bin, n, total, square) of the nodes at `depth` of `tree`.

    bins: cells x genes; splits: {(target, tree, node): (gene, bin, left, right)}.
    With a `rate` the trees before this one are subtracted from the target.
    """
    out = []
    for target in targets:
        y = values[:, target]
        if rate:
            for earlier in range(tree):
                y = y - rate * _predict(bins, splits, target, earlier)
        node = np.where(seen, 1, 0)
        for _ in range(depth):
            node = _down(bins, splits, target, tree, node)
        for here in np.unique(node[node >= 1 << depth]).tolist():
            rows = np.flatnonzero(node == here)
            own = candidates(hashes, seed, tree, here, n_candidates)
            own = own[own != target][:n_candidates]
            if not len(own):
                continue
            at = (bins[np.ix_(rows, own)] + np.arange(len(own)) * n_bins).ravel()
            each = np.repeat(y[rows], len(own))
            size = len(own) * n_bins
            n = np.bincount(at, minlength=size)
            total = np.bincount(at, each, minlength=size)
            square = np.bincount(at, each * each, minlength=size)
            used = np.flatnonzero(n)
            out.append(np.stack([
                np.full(len(used), target), np.full(len(used), tree), np.full(len(used), here),
                own[used // n_bins], used % n_bins, n[used], total[used], square[used]], 1))
    return out


def _down(bins, splits, target, tree, node):
    """Node of every cell one level further; 0 where a node has no split."""
    below = np.zeros_like(node)
    for here in np.unique(node[node > 0]).tolist():
        split = splits.get((target, tree, here))
        if split is not None:
            rows = node == here
            below[rows] = 2 * here + (bins[rows, split[0]] > split[1])
    return below


def _predict(bins, splits, target, tree):
    """The mean that the deepest split of a tree gives each cell; 0 without a split."""
    node, out = np.ones(len(bins), np.int64), np.zeros(len(bins))
    while node.any():
        below = _down(bins, splits, target, tree, node)
        for here in np.unique(node[below > 0]).tolist():
            _, _, left, right = splits[(target, tree, here)]
            rows = (node == here) & (below > 0)
            out[rows] = np.where(below[rows] == 2 * here, left, right)
        node = below
    return out


COLUMNS = ["target", "tree", "node", "candidate", "bin", "n", "total", "square"]


def histograms(keys, trees, depth, n_bins, share, seed, rate):
    """Function for a cogroup of (cells of a chunk, the model of a block of targets)."""

    def run(cells: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(cells) or not len(model):
            return pd.DataFrame(columns=[*keys, *COLUMNS])
        state = model.iloc[0]
        hashes = np.asarray(state["hashes"], np.int64)
        bins = np.zeros((len(cells), len(hashes)), np.int64)
        values = np.zeros((len(cells), len(hashes)))
        sizes = cells["genes"].map(len).to_numpy()
        row, at = np.repeat(np.arange(len(cells)), sizes), np.concatenate(cells["genes"].to_numpy()).astype(np.int64)
        bins[row, at] = np.concatenate(cells["bins"].to_numpy())
        values[row, at] = np.concatenate(cells["values"].to_numpy())
        splits = {
            (s["target"], s["tree"], s["node"]): (s["gene"], s["bin"], s["low"], s["high"])
            for s in state["splits"]}
        n_candidates = int(state["n_candidates"])
        cell_hash = cells["hash"].to_numpy(np.int64)
        parts = []
        for tree in trees:
            parts += grow(bins, values, np.asarray(state["targets"], np.int64).tolist(), hashes,
                          drawn(cell_hash, seed, tree, share), splits, tree, depth, n_bins, n_candidates, seed, rate)
        table = np.concatenate(parts) if parts else np.zeros((0, len(COLUMNS)))
        out = pd.DataFrame(table, columns=COLUMNS)
        out[COLUMNS[:6]] = out[COLUMNS[:6]].astype("int64")
        for i, key in enumerate(keys):
            out.insert(i, key, state[f"to_{key}"])
        return out

    return run
