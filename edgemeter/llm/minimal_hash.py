"""A minimal perfect hash over distinct 128-bit keys, with its value arrays, as one byte string.

Level by level, every key that is not placed yet hashes to a slot of the level's
bitmap; slots hit by one key are kept, the others' keys go to the next level. A
key's number is the rank of its bit over all levels, so n keys have the numbers
0 to n - 1, and arrays of n entries hold their fingerprints and counts.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from edgemeter.llm import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS_PER_KEY = 2
WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _slot(h: np.ndarray, level: int, slots: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return arrays.mix(h + step) % np.uint64(slots)


def build(h: np.ndarray, fingerprint: np.ndarray, count: np.ndarray) -> bytes:
    """The index of distinct keys (h, fingerprint), both of 64 bits, with a count each.

    `h` alone places a key, so keys must differ in it; of keys that agree in `h`
    the first is kept and the rest follow in a list of their own.
    """
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    placed, extra = order[new], order[~new]
    bits, sizes, left, level = [], [], h[placed], 0
    while len(left):
        slots = -(-max(SLOTS_PER_KEY * len(left), 64) // 64) * 64
        at = _slot(left, level, slots).astype(np.int64)
        alone = np.bincount(at, minlength=slots) == 1
        bits.append(alone)
        sizes.append(slots)
        left = left[~alone[at]]
        level += 1
    bitmap = np.concatenate(bits) if bits else np.zeros(0, bool)
    wide = next(w for w in WIDTHS if int(count.max(initial=0)) < 1 << 8 * w)
    prints, counts = np.zeros(len(placed), np.uint64), np.zeros(len(placed), WIDTHS[wide])
    head = np.array([len(sizes), len(bitmap), len(placed), len(extra), wide, *sizes], np.int64)
    words = np.packbits(bitmap, bitorder="little")
    index = Index(b"".join(x.tobytes() for x in (head, words, prints, counts)), bare=True)
    number = index.number(h[placed])
    prints[number], counts[number] = fingerprint[placed], count[placed]
    return b"".join(x.tobytes() for x in (
        head, words, prints, counts, h[extra], fingerprint[extra], count[extra].astype(np.uint64)))


class Index:
    """What `build` has written, ready to be probed."""

    def __init__(self, blob: bytes, bare: bool = False):
        levels, n_bits, n, n_extra, wide = np.frombuffer(blob, np.int64, 5).tolist()
        at = 40
        self.sizes = np.frombuffer(blob, np.int64, levels, at)
        at += 8 * levels
        self.bits = np.frombuffer(blob, np.uint8, n_bits // 8, at)
        at += n_bits // 8
        #: Set bits before each byte.
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.uint32)])
        self.prints = np.frombuffer(blob, np.uint64, n, at)
        at += self.prints.nbytes
        self.counts = np.frombuffer(blob, WIDTHS[wide], n, at)
        at += self.counts.nbytes
        self.extra = {}
        if n_extra and not bare:
            h, f, c = np.frombuffer(blob, np.uint64, 3 * n_extra, at).reshape(3, n_extra).tolist()
            self.extra = dict(zip(zip(h, f, strict=True), c, strict=True))

    def number(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for those that no level places."""
        out = np.full(len(h), -1, np.int64)
        open_, base = np.arange(len(h)), 0
        for level, slots in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = base + _slot(h[open_], level, slots).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = self._rank(at[hit])
            open_ = open_[~hit]
            base += slots
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        low = self.bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return self.before[at >> 3].astype(np.int64) + np.bitwise_count(low)

    def count(self, h: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """Counts of the keys (h, fingerprint); 0 for keys that the index does not hold."""
        out = np.zeros(len(h), np.int64)
        number = self.number(h)
        known = number >= 0
        known[known] = self.prints[number[known]] == fingerprint[known]
        out[known] = self.counts[number[known]]
        if self.extra:
            for i in np.flatnonzero(~known).tolist():
                out[i] = self.extra.get((int(h[i]), int(fingerprint[i])), 0)
        return out
