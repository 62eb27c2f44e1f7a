"""Lagged correlations of two gene blocks for one segment of lags; travels by value.

Time is cut into chunks of `length` cells. The dot products of a leading chunk
with the two following chunks that its lags can reach are one product of their
spectra; summed over all chunks, one inverse transform gives the dot products of
a whole segment of lags. Sums, squares and changes of the moving window come the
same way, from a leading series of ones.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADER = -1
DIGITS = 9


class _Segment:
    """One (trajectory, leading block, following block, segment)."""

    def __init__(self, n: int, max_lag: int, length: int, segment: int):
        self.n, self.length, self.segment = n, length, segment
        self.window, self.lags = n - max_lag, min(length, max_lag + 1 - segment * length)
        self.means: tuple[dict, dict] = ({}, {})  # following, leading: gene -> mean
        self.rows: tuple[list, list] = ([], [])
        self.step = 0
        self.spectra = None

    def add(self, step: int, role: int, gene: str, places: np.ndarray, values: np.ndarray) -> None:
        """Rows come by step; a header names a gene and its mean."""
        if step == HEADER:
            self.means[role][gene] = float(values[0])
            return
        while self.step < step:
            self._advance()
        self.rows[role].append((gene, places, values))

    def _start(self):
        self.genes = tuple(list(m) for m in self.means)
        self.index = tuple({g: i for i, g in enumerate(names)} for names in self.genes)
        self.mean = tuple(np.array(list(m.values()))[:, None] for m in self.means)
        follow, lead = (len(names) for names in self.genes)
        shape = self.length + 1
        self.spectra = np.zeros((lead, follow, shape), complex)
        self.moving = np.zeros((3, follow, shape), complex)
        self.before = np.zeros((follow, self.length))
        self.total, self.square = np.zeros((2, lead))
        self.first, self.varies = np.full(lead, np.nan), np.zeros(lead, bool)

    def _dense(self, role: int, chunk: int, end: int) -> np.ndarray:
        """A chunk's values less their means, and zeros from `end` on."""
        out = np.repeat(-self.mean[role], self.length, axis=1)
        for gene, places, values in self.rows[role]:
            out[self.index[role][gene], places] += values
        out[:, max(0, end - chunk * self.length) :] = 0
        return out

    def _advance(self) -> None:
        """Finish a step: the chunk that came in is the far half of what the leading chunk meets."""
        if self.spectra is None:
            self._start()
        length, lead_chunk = self.length, self.step - 1
        after = self._dense(0, self.step + self.segment, self.n)
        if lead_chunk >= 0 and lead_chunk * length < self.window:
            lead = self._dense(1, lead_chunk, self.window)
            inside = min(length, self.window - lead_chunk * length)
            used = lead[:, :inside]
            self.total += used.sum(1)
            self.square += (used * used).sum(1)
            self.first = np.where(np.isnan(self.first), used[:, 0], self.first)
            self.varies |= (used != self.first[:, None]).any(1)
            ones = (np.arange(length) < np.array([[inside], [self.window - 1 - lead_chunk * length]])).astype(float)
            ahead = np.conj(np.fft.rfft(np.concatenate([lead, ones]), 2 * length))
            both = np.concatenate([self.before, after], axis=1)
            change = np.zeros_like(both)
            change[:, :-1] = both[:, 1:] != both[:, :-1]
            follow = np.fft.rfft(both)
            for i in range(len(lead)):
                self.spectra[i] += ahead[i] * follow
            self.moving[0] += ahead[-2] * follow
            self.moving[1] += ahead[-2] * np.fft.rfft(both * both)
            self.moving[2] += ahead[-1] * np.fft.rfft(change)
        self.before, self.rows, self.step = after, ([], []), self.step + 1

    def result(self):
        """(gene1, gene2, weight, lag): the largest absolute correlation of the segment."""
        while (self.step - 1) * self.length < self.window:
            self._advance()
        back = lambda x: np.fft.irfft(x, 2 * self.length)[..., : self.lags]
        w = float(self.window)
        total, square, changes = back(self.moving)
        spread = square - total * total / w
        spread = np.where((np.rint(changes) > 0) & (spread > 0), spread, np.nan)
        own = self.square - self.total * self.total / w
        own = np.where(self.varies & (own > 0), own, np.nan)
        for i, gene in enumerate(self.genes[1]):
            r = (back(self.spectra[i]) - self.total[i] * total / w) / np.sqrt(own[i] * spread)
            size = np.round(np.abs(np.nan_to_num(r, nan=-1.0)), DIGITS)
            size[np.isnan(r)] = -1
            lag = size.argmax(1)
            for j, other in enumerate(self.genes[0]):
                if other != gene and size[j, lag[j]] >= 0:
                    yield gene, other, float(r[j, lag[j]]), int(lag[j]) + self.segment * self.length


def lagged_segments(keys: list[str]):
    """Rows come sorted by `keys`, block pair, segment, step and role (following first)."""

    def run(batches):
        state, place, kinds = None, None, None

        def emit():
            rows = list(state.result())
            columns = [pa.array([k] * len(rows), kind) for k, kind in zip(place, kinds, strict=False)]
            names = [*keys, "gene1", "gene2", "weight", "lag"]
            ends = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = [pa.string(), pa.string(), pa.float64(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(x, t) for x, t in zip(ends, types, strict=True))], names=names)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            head = [*keys, "lead", "follow", "segment"]
            heads = list(zip(*(batch.column(k).to_pylist() for k in head), strict=True))
            facts = list(zip(*(batch.column(k).to_pylist() for k in (
                "n", "max_lag", "length", "segment", "step", "role", "gene")), strict=True))
            for i, (here, (*shape, step, role, gene)) in enumerate(zip(heads, facts, strict=True)):
                if here != place:
                    if state is not None:
                        yield emit()
                    state, place = _Segment(*shape), here
                places, values = (batch.column(c)[i].values.to_numpy().copy() for c in ("places", "values"))
                state.add(step, role, gene, places, values)
        if state is not None:
            yield emit()

    return run
