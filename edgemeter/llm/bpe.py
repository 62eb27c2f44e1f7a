"""Byte-level BPE encoding and decoding by a rank queue.

A pre-token is a linked list of byte symbols. Every neighbouring pair that the
vocabulary can merge waits in the bucket of its rank; a bitmap of three levels
(64 bits a word) marks the buckets in use, so the next rank is found by three
find-first-set steps whatever the length of the pre-token. Entries whose pair
has changed since are skipped when they come up.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.llm import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KNOWN_BYTES = 32 << 20  # what is remembered of parts and tokens
ENTRY_BYTES = 160  # of a dictionary entry besides its text and ids
EMIT_ROWS = 512
BATCH_BYTES = 3 << 20
DECODE_BYTES = 1 << 18
LONG_PRETOKEN = 256
TOGETHER = 1 << 19  # bytes of pre-tokens that share one queue


def _kept() -> dict:
    """What a process keeps from task to task. This module travels by value, so
    its own variables begin anew in each task."""
    name = "_edgemeter_bpe_kept"
    return sys.modules.setdefault(name, ModuleType(name)).__dict__.setdefault("kept", {})


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank, from a file of `base64 rank` lines; read once per process."""
    kept = _kept()
    if ("ranks", path) not in kept:
        with open(path, "rb") as lines:
            kept["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return kept["ranks", path]


def load_merges(path: str) -> Merges:
    """The merges of that file; built once per process."""
    kept = _kept()
    if ("merges", path) not in kept:
        kept["merges", path] = Merges(load_ranks(path))
    return kept["merges", path]


class RankQueue:
    """Positions waiting under their merge rank; the smallest rank comes first
    and within it the leftmost position."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self._mark(rank)

    def _mark(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[group] |= 1 << (word & 63)
        self.top |= 1 << group

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put arrays of positions into their buckets, one array per bucket."""
        both = ranks.astype(np.int64) << 32 | positions
        both.sort()
        positions = both.astype(np.int32)  # the lower half
        both >>= 32
        edge = np.flatnonzero(both[1:] != both[:-1]) + 1
        cuts = [0, *edge.tolist(), len(both)]
        for rank, a, b in zip(both[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self._mark(rank)
                self.buckets[rank] = [positions[a:b]]
            else:
                bucket.append(positions[a:b])

    def pop_all(self) -> tuple[int, list[np.ndarray]]:
        """The whole bucket of the smallest rank, in no order."""
        rank = self._smallest()
        bucket = self.buckets[rank]
        self._empty(rank)
        return rank, bucket

    def _empty(self, rank: int) -> None:
        del self.buckets[rank]
        word, group = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[group] &= ~(1 << (word & 63))
            if not self.mid[group]:
                self.top &= ~(1 << group)

    def _smallest(self) -> int:
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def pop(self) -> tuple[int, int]:
        rank = self._smallest()
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self._empty(rank)
        return rank, position


def encode_pretoken(raw: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token; the queue is empty before and after."""
    whole = ranks.get(raw)
    if whole is not None:
        return [whole]
    n = len(raw)
    end = list(range(1, n + 1))  # a symbol is known by its first byte
    before = list(range(-1, n - 1))
    waiting = [-1] * n  # rank under which the pair beginning here waits
    for i in range(n - 1):
        rank = ranks.get(raw[i : i + 2])
        if rank is not None:
            waiting[i] = rank
            queue.push(rank, i)
    while queue.top:
        rank, i = queue.pop()
        if waiting[i] != rank:
            continue
        gone = end[i]
        stop = end[i] = end[gone]
        waiting[gone] = -1
        if stop < n:
            before[stop] = i
            longer = ranks.get(raw[i : end[stop]])
            waiting[i] = -1 if longer is None else longer
            if longer is not None:
                queue.push(longer, i)
        else:
            waiting[i] = -1
        left = before[i]
        if left >= 0:
            longer = ranks.get(raw[left:stop])
            if longer != waiting[left]:
                waiting[left] = -1 if longer is None else longer
                if longer is not None:
                    queue.push(longer, left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[raw[i : end[i]]])
        i = end[i]
    return ids


class Merges:
    """The vocabulary as merges of two ids, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, found = array("q"), array("q")
        for raw, rank in ranks.items():
            for at in range(1, len(raw)):
                left, right = ranks.get(raw[:at]), ranks.get(raw[at:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    found.append(rank)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.keys = np.frombuffer(keys, np.int64)[order]
        self.found = np.frombuffer(found, np.int64)[order].astype(np.int32)
        ids = np.repeat(self.bytes, 256), np.tile(self.bytes, 256)
        self.of_bytes = self.rank(*ids)  # ranks of all pairs of single bytes

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, -1 where the vocabulary has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], -1)


def encode_pretokens(raws: list[bytes], merges: Merges, queue: RankQueue) -> list[bytes]:
    """Packed ids of many short pre-tokens, all in one queue.

    The pre-tokens lie in one linked list with gaps. A bucket is taken whole;
    in each pre-token its leftmost live position is merged and further ones
    wait again, so each pre-token sees its merges in the same order as alone.
    """
    sizes = np.array([len(r) for r in raws], np.int64)
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
    data = np.frombuffer(b"".join(raws), np.uint8)
    # Position `total` stands for "none" on both sides.
    symbol = np.append(merges.bytes[data], np.int32(-1))
    after = np.append(np.arange(1, total + 1), total)
    before = np.append(np.arange(-1, total - 1), total)
    edge = np.cumsum(sizes)
    after[edge - 1] = total
    before[edge - sizes] = total
    alive = np.ones(total, bool)
    waiting = np.full(total + 1, -1, np.int32)
    waiting[: total - 1] = merges.of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]]
    waiting[edge - 1] = -1
    at = np.flatnonzero(waiting >= 0)
    if len(at):
        queue.push_all(waiting[at], at)
    while queue.top:
        rank, taken = queue.pop_all()
        at = (np.concatenate(taken) if len(taken) > 1 else taken[0]).astype(np.intp)
        at = at[waiting.take(at) == rank]
        if len(at) > 1:
            if len(taken) > 1:
                at.sort()
            own = owner.take(at)
            again = own[1:] == own[:-1]
            if again.any():
                # Of a position that came up twice, the copy is skipped when it comes up again.
                later = at[1:][again]
                queue.push_all(np.full(len(later), rank, np.int32), later)
                at = at[np.concatenate([[True], ~again])]
        if not len(at):
            continue
        gone = after.take(at)
        stop = after.take(gone)
        alive[gone] = False
        waiting[gone] = -1
        symbol[at] = rank
        after[at] = stop
        before[stop] = at
        left = before.take(at)
        right = symbol.take(stop)
        found = merges.rank(np.concatenate([np.full(len(at), rank, np.int32), symbol.take(left)]),
                            np.concatenate([right, np.full(len(at), rank, np.int32)]))
        waiting[at] = found[: len(at)]
        waiting[left] = found[len(at) :]
        waiting[total] = -1
        live = found >= 0
        if live.any():
            queue.push_all(found[live], np.concatenate([at, left])[live])
    ids = symbol[:-1][alive].tobytes()
    cuts = np.cumsum(np.bincount(owner[alive], minlength=len(raws))) * 4
    return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


class Encoder:
    """Encodes texts, remembering a bounded number of parts and tokens as packed ids.

    A part made of letters is one token, which is remembered as that part only.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks, self.merges = load_ranks(path), load_merges(path)
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.split = regex.compile(pattern).findall
        probe = " Aaß字aÀǅ"  # does the pattern leave a space and letters together?
        self.whole = self.split(probe) == [probe]
        self.known: dict[str, bytes] = {}  # parts after a space, which is left off
        self.tokens: dict[str, bytes] = {}  # other tokens
        self.held = 0  # bytes of both

    def _size(self, memory: dict[str, bytes]) -> int:
        return ENTRY_BYTES * len(memory) + sum(map(len, memory)) + sum(map(len, memory.values()))

    def _merged(self, tokens: list[str]) -> list[bytes]:
        """Packed ids of tokens."""
        raws = [token.encode() for token in tokens]
        out: list[bytes] = [b""] * len(raws)
        short: list[int] = []
        taken = 0
        for i, raw in enumerate(raws):
            if raw in self.ranks:
                out[i] = self.ranks[raw].to_bytes(4, sys.byteorder)
            elif len(raw) > LONG_PRETOKEN:
                ids = encode_pretoken(raw, self.ranks, self.queue)
                out[i] = np.array(ids, np.int32).tobytes()
            else:
                short.append(i)
                taken += len(raw)
                if taken > TOGETHER:
                    self._shared(raws, short, out)
                    short, taken = [], 0
        if short:
            self._shared(raws, short, out)
        return out

    def _shared(self, raws: list[bytes], which: list[int], out: list[bytes]) -> None:
        found = encode_pretokens([raws[i] for i in which], self.merges, self.queue)
        for i, ids in zip(which, found, strict=True):
            out[i] = ids

    def learn(self, heads: list[str], parts: set[str]) -> tuple[list[bytes], dict[str, bytes]]:
        """Packed ids of heads, and of parts and the words in them by part."""
        words = {part for part in parts if part.isalpha()} if self.whole else set()
        rest = [part for part in parts if part not in words]
        split = [self.split(head) for head in heads]
        split += [self.split(" " + part) for part in rest]
        ids = {}
        other = []
        for token in set(chain.from_iterable(split)):
            if self.whole and token[0] == " " and token[1:].isalpha():
                known = self.known.get(token[1:])
                if known is None:
                    words.add(token[1:])
                else:
                    ids[token] = known
            else:
                known = self.tokens.get(token)
                if known is None:
                    other.append(token)
                else:
                    ids[token] = known
        spaced = [" " + word for word in words]
        merged = self._merged(other + spaced)
        new = dict(zip(other, merged, strict=False))
        self.tokens |= new
        ids |= new
        own = dict(zip(words, merged[len(other) :], strict=True))
        ids.update(zip(spaced, own.values(), strict=True))
        self.held += self._size(new)
        found = [
            ids[tokens[0]] if len(tokens) == 1 else b"".join([ids[t] for t in tokens])
            for tokens in split
        ]
        own.update(zip(rest, found[len(heads) :], strict=True))
        return found[: len(heads)], own

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        # A head has no leading space and is seldom seen twice, so it is not remembered.
        # Texts are cut twice rather than held in parts: distinct parts are few.
        heads: set[str] = set()
        parts: set[str] = set()
        for text in texts:
            head, *rest = pieces.cut(text)
            heads.add(head)
            parts.update(rest)
        names = list(heads)
        found, new = self.learn(names, parts.difference(self.known))
        first = dict(zip(names, found, strict=True))
        self.known |= new
        self.held += self._size(new)
        known = self.known.__getitem__
        out = []
        for text in texts:
            head, *rest = pieces.cut(text)
            out.append(first[head] + b"".join(map(known, rest)))
        if self.held > KNOWN_BYTES:
            self._forget(parts.union(new))
        return out

    def _forget(self, used: set[str]) -> None:
        """Keep only the parts that the last texts used, or none if these are too many."""
        self.tokens = {}
        self.known = {part: self.known[part] for part in used}
        self.held = self._size(self.known)
        if self.held > KNOWN_BYTES:
            self.known, self.held = {}, 0


def _encoding(path: str, pattern: str):
    def run(batches):
        encoder = Encoder(path, pattern)  # what it remembers goes with the task
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for a, b in pieces.runs(sizes, BATCH_BYTES):
                packed = encoder.texts(pieces.texts_of(batch.column("text").slice(a, b - a)))
                for at in range(a, b, EMIT_ROWS):
                    part = packed[at - a : min(at + EMIT_ROWS, b) - a]
                    edge = np.cumsum([0, *(len(p) // 4 for p in part)])
                    ids = pa.ListArray.from_arrays(
                        pa.array(edge.astype(np.int32)),
                        pa.array(np.frombuffer(b"".join(part), np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, len(part)), ids], names=["doc_id", "ids"])

    return run


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>) of every row, without special tokens.

    Each match of `pattern` is encoded by itself. Null and empty texts give an
    empty array; a null id is returned as null, repeated rows as often as given.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoding(ranks_path, pattern), "doc_id long, ids array<int>")


def _decoding(path: str):
    def run(batches):
        ranks = load_ranks(path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, rank in ranks.items():
            size[rank] = len(raw)
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
            # Positions of all bytes of a run are held at once, so long texts go alone.
            for a, b in pieces.runs([4 * n for n in sizes], DECODE_BYTES):
                part = batch.slice(a, b - a)
                ids = part.column("ids")
                if ids.null_count:
                    ids = pa.array([i or [] for i in ids.to_pylist()], pa.list_(pa.int32()))
                edge = ids.offsets.to_numpy().astype(np.int64)
                values = ids.values.to_numpy()[edge[0] : edge[-1]]
                n = size[values]
                to = np.concatenate([[0], np.cumsum(n)])
                raw = flat[np.arange(to[-1]) + np.repeat(begin[values] - to[:-1], n)]
                cuts = to[edge - edge[0]].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(ids), [
                    None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), out],
                    names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes the ids stand for.

    Null ids give no bytes. An id outside the vocabulary raises.
    """
    return encoded.select("doc_id", "ids").mapInArrow(
        _decoding(ranks_path), "doc_id long, ids array<int>, decoded binary"
    )
