"""Vectorised text helpers that run inside Spark tasks.

All of them see one slice of texts as one byte buffer with row offsets, so a
slice costs a few NumPy passes however many short texts it holds. Fingerprints
depend on the bytes (and a key) alone: every task on every machine names equal
words alike. `span_hash` and `word_hash` are quick and collide on texts made for
it, so they only select candidates; what removes or links text goes by digests.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20

SPACES = [0x20, *range(0x09, 0x0E)]
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[SPACES] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_slices(
    column: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `limit` bytes.

    Null counts as empty. A text above the limit is a slice of its own.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(raw[1], width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(
    buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): maximal runs of kept bytes, and for each row the
    index of its first word; a word never crosses rows."""
    inside = keep[buf]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(buf)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int) -> np.ndarray:
    """n reproducible 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               + np.uint64(stream * 0x632BE59BD9B4E019 % 2**64))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, base odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 2 * SLICE_BYTES:  # a giant text must not pin its tables
            _POWERS[base] = have
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit fingerprints of the value sequences [start, end)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


BYTE_BASE = 0xD6E8FEB86659FD93
WORD_BASE = 0xA0761D6478BD642F


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 1) -> np.ndarray:
    """Fingerprint of each word's bytes."""
    return span_hash(seeds(256, stream)[buf], starts, ends, BYTE_BASE + 2 * stream)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every word, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def digest(data: bytes, key: bytes = b"") -> bytes:
    """128-bit BLAKE2 digest."""
    return hashlib.blake2b(data, digest_size=16, key=key).digest()


def digests(data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) halves of the digests of data[begin:end]."""
    cells = [digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(cells), np.uint64).reshape(-1, 2)


def keyed_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """Fingerprint of each word under a secret key, from BLAKE2; once for each distinct word."""
    data, known = buf.tobytes(), {}
    at = np.fromiter(
        (known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)),
        np.int64, len(starts))
    named = b"".join(hashlib.blake2b(word, digest_size=8, key=key).digest() for word in known)
    return np.frombuffer(named, np.uint64)[at]


def shingles(
    words: np.ndarray, bounds: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted, with the rows' bounds.

    A row of fewer than k words has its whole sequence as its only shingle; a
    row without words has none.
    """
    counts = np.diff(bounds)
    some = np.flatnonzero(counts > 0)
    n = np.maximum(counts[some] - k + 1, 1)
    edge = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(bounds[some] - edge[:-1], n) + np.arange(edge[-1])
    width = np.repeat(np.minimum(counts[some], k), n)
    hashed = width.astype(np.uint64)
    for j in range(min(k, int(width.max(initial=0)))):
        inside = np.flatnonzero(width > j) if j else slice(None)
        # A step that no later word can undo.
        hashed[inside] = mix(hashed[inside] * np.uint64(0x9E3779B97F4A7C15) ^ words[begin[inside] + j])
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for row, a, b in zip(some.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = np.sort(hashed[a:b])
        if b - a > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes[row] = len(own)
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return out, np.concatenate([[0], np.cumsum(sizes)])


def text_shingles(
    buf: np.ndarray, offsets: np.ndarray, k: int, key: bytes
) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` of texts with A-Z lowered, named under a secret key."""
    low = LOWER[buf]
    starts, ends, bounds = word_spans(low, offsets, NON_SPACE)
    return shingles(keyed_words(low, starts, ends, key), bounds, k)
