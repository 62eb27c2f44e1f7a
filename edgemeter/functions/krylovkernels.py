"""Task code of the block Krylov search; travels by value.

A basis is spread over gene blocks: rows of (names, values), the values of a
block being names x columns numbers in one array.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A new direction shorter than this (in units of the largest value) is noise.
NOISE = 1e-13
# Directions that others explain up to this share are left out.
DEPENDENT = 1e-8


def _flat(values: np.ndarray) -> pa.Array:
    return pa.array([values.ravel()], pa.list_(pa.float64()))


def _matrix(batch: pa.RecordBatch, column: str, row: int, height: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy().reshape(height, -1)


def _names(batch: pa.RecordBatch, column: str, row: int) -> list:
    return batch.column(column)[row].as_py()


def _batch(batch: pa.RecordBatch, row: int, kept: list[str], **columns) -> pa.RecordBatch:
    """One row: `kept` as they are, and new columns."""
    old = {c: batch.column(c).slice(row, 1) for c in kept}
    return pa.RecordBatch.from_arrays([*old.values(), *columns.values()], names=[*old, *columns])


def starting_block(width: int):
    """Random normal numbers for every name, the same in every run."""

    def run(batches):
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "_names"]
            for row in range(batch.num_rows):
                names = _names(batch, "_names", row)
                start = np.array([
                    np.random.default_rng(crc32(str(name).encode())).normal(size=width) for name in names])
                yield _batch(batch, row, kept, _names=batch.column("_names").slice(row, 1), _m=_flat(start))

    return run


def tile_products(keys: list[str], have: tuple[str, str], want: tuple[str, str], minus: bool):
    """Each tile times the numbers of its names on the `have` side, per name of
    the `want` side; with `minus`, features that count negative change sign."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                place = {name: i for i, name in enumerate(_names(batch, "_names", row))}
                block = _matrix(batch, "_m", row, len(place))
                at = np.array([place[name] for name in _names(batch, have[0], row)])
                rows, cols, v = (batch.column(c)[row].values.to_numpy() for c in (have[1], want[1], "_v"))
                names = _names(batch, want[0], row)
                tile = np.zeros((len(names), len(at)))
                np.add.at(tile, (cols, rows), v)
                out = tile @ block[at]
                if minus:
                    out[[name.startswith("-") for name in names]] *= -1
                yield _batch(
                    batch, row, keys, _names=batch.column(want[0]).slice(row, 1), _m=_flat(out))

    return run


def sum_blocks(keys: list[str]):
    """Add the rows of equal `keys`, in which they come sorted, name by name."""

    def run(batches):
        head, schema = None, None
        places, total = {}, None

        def emit():
            columns = [pa.array([x], schema.field(c).type) for c, x in zip(keys, head, strict=True)]
            names = pa.array([list(places)], schema.field("_names").type)
            return pa.RecordBatch.from_arrays(
                [*columns, names, _flat(total[: len(places)])], names=[*keys, "_names", "_m"])

        for batch in batches:
            schema = batch.schema
            for row in range(batch.num_rows):
                new = tuple(batch.column(c)[row].as_py() for c in keys)
                if new != head:
                    if head is not None:
                        yield emit()
                    head, places, total = new, {}, None
                names = _names(batch, "_names", row)
                block = _matrix(batch, "_m", row, len(names))
                at = np.array([places.setdefault(name, len(places)) for name in names])
                if total is None or len(places) > len(total):
                    wider = np.zeros((2 * len(places), block.shape[1]))
                    if total is not None:
                        wider[: len(total)] = total
                    total = wider
                total[at] += block
        if head is not None:
            yield emit()

    return run


def append_block(keys: list[str]):
    """Join the direction `_m` and its product `_z` (names `_zn`) to the basis."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                names = _names(batch, "_names", row)
                place = {name: i for i, name in enumerate(_names(batch, "_zn", row))}
                product = _matrix(batch, "_z", row, len(names))[[place[name] for name in names]]
                parts = {"_q": _matrix(batch, "_m", row, len(names)), "_aq": product}
                for c in parts:
                    if batch.column(c)[row].is_valid:
                        parts[c] = np.hstack([_matrix(batch, c, row, len(names)), parts[c]])
                yield _batch(
                    batch, row, [*keys, "_b", "_names"], **{c: _flat(x) for c, x in parts.items()})

    return run


def small_products(keys: list[str]):
    """Q'Q and Q'AQ of each block, one after the other."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                height = len(_names(batch, "_names", row))
                q, aq = _matrix(batch, "_q", row, height), _matrix(batch, "_aq", row, height)
                yield _batch(batch, row, keys, _names=pa.array([["m", "t"]]),
                             _m=_flat(np.stack([q.T @ q, q.T @ aq])))

    return run


def ritz(keys: list[str], limit: int, keep: int):
    """Best approximations inside the basis: `_y` turns the basis, `_theta` are
    the values, largest first; beyond `limit` columns only `keep` stay."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                pair = _matrix(batch, "_m", row, 2)
                size = int(round(pair.shape[1] ** 0.5))
                # The names may have come in either order.
                order = _names(batch, "_names", row)
                mass, inner = (pair[order.index(c)].reshape(size, size) for c in ("m", "t"))
                length = np.sqrt(np.diag(mass))
                scale = np.where(length > NOISE * max(length.max(), 1e-300), 1 / np.maximum(length, 1e-300), 0.0)
                weights, turn = np.linalg.eigh(scale[:, None] * mass * scale)
                good = weights > DEPENDENT * max(weights[-1], 0.0)
                basis = scale[:, None] * turn[:, good] / np.sqrt(weights[good])
                values, vectors = np.linalg.eigh(basis.T @ ((inner + inner.T) / 2) @ basis)
                y = (basis @ vectors)[:, ::-1]
                count = keep if size > limit else y.shape[1]
                yield _batch(batch, row, keys, _y=_flat(y[:, :count]),
                             _theta=_flat(values[::-1][:count]))

    return run


def turn_basis(keys: list[str], width: int):
    """The basis in its best directions, and the residuals of the first `width`
    of them as the next directions; `_r` holds the squares of these."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                height = len(_names(batch, "_names", row))
                theta = batch.column("_theta")[row].values.to_numpy()
                old = _matrix(batch, "_q", row, height)
                y = _matrix(batch, "_y", row, old.shape[1])
                q, aq = old @ y, _matrix(batch, "_aq", row, height) @ y
                # In units of the largest value; a matrix of zeros has none.
                top = max(abs(theta[0]), 1e-300) if len(theta) else 1.0
                rest = (aq[:, :width] - q[:, :width] * theta[:width]) / top
                yield _batch(batch, row, [*keys, "_b", "_names"], _q=_flat(q), _aq=_flat(aq),
                             _m=_flat(rest), _r=_flat((rest * rest).sum(0)))

    return run
