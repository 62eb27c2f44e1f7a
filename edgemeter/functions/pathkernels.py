"""Breadth-first search from a block of sources, a bit for each; travels by value.

A task holds a row of words for each node, 64 sources a word. The edges pass by
once a round and are not kept; the words of a node are united into its
successors, so a bit that is new after a round tells a distance.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Turns of rows (block, turn, a, b). Of pairs a has slots, b nodes; of words a has nodes, b their
# words; of edges a has the nodes before those of b, which come with their number of edges.
START, WANTED, SEEN, OPEN, EDGES = range(5)

STATE = "block int, turn int, a array<int>, b array<int>"
FOUND = f"{STATE}, slot int, node int, length int"

PIECE = 1 << 14  # words that are looked at together


def _bits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the bits that are set."""
    row, at = np.nonzero(words)
    which, bit = np.nonzero(np.unpackbits(
        words[row, at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    ))
    return row[which], at[which] * 64 + bit


class _Block:
    def __init__(self, block: int, nodes: int, width: int):
        self.block, self.width = block, width
        self.seen, self.reach, self.open = (np.zeros((nodes, width), np.uint64) for _ in range(3))
        self.step = max(1, PIECE // width)
        self.turn = EDGES - 1  # the round under way
        self.live = True

    def add(self, turn: int, a: np.ndarray, b: np.ndarray) -> None:
        if turn in (START, WANTED):
            bit = np.left_shift(np.uint64(1), (a & 63).astype(np.uint64))
            np.bitwise_or.at(self.seen if turn == START else self.open, (b, a >> 6), bit)
        elif turn in (SEEN, OPEN):
            words = np.ascontiguousarray(b).view("<u8").reshape(-1, self.width)
            (self.seen if turn == SEEN else self.open)[a] |= words
        else:
            to = np.repeat(b[0::2], b[1::2])
            for first in range(0, len(a), self.step):
                part = to[first : first + self.step]
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                words = self.seen[a[first : first + self.step]]
                self.reach[part[edge]] |= np.bitwise_or.reduceat(words, edge, axis=0)

    def begin(self, turn: int) -> None:
        self.turn = turn
        self.live = self.live and bool(self.open.any())
        if self.live:
            np.copyto(self.reach, self.seen)

    def end(self, done: int):
        """Pairs found in the round that ends."""
        if self.turn < EDGES or not self.live:
            return
        changed = False
        for first in range(0, len(self.seen), self.step):
            rows = slice(first, first + self.step)
            new = self.reach[rows] ^ self.seen[rows]
            changed = changed or bool(new.any())
            new &= self.open[rows]
            if new.any():
                self.open[rows] ^= new
                node, slot = _bits(new)
                length = np.full(len(node), done + self.turn - EDGES + 1, np.int32)
                yield self._batch(slot=slot.astype(np.int32), node=(first + node).astype(np.int32), length=length)
        self.seen, self.reach = self.reach, self.seen
        self.live = changed and bool(self.open.any())

    def close(self, done: int):
        """The last round; then the words of sources that miss a target, if it reached new nodes."""
        yield from self.end(done)
        if self.turn < EDGES or not self.live:
            return
        missing = np.bitwise_or.reduce(self.open, axis=0)
        for first in range(0, len(self.seen), self.step):
            for turn, words in ((SEEN, self.seen), (OPEN, self.open)):
                words = words[first : first + self.step] & missing
                at = np.flatnonzero(words.any(axis=1))
                if len(at):
                    yield self._batch(
                        turn=np.array([turn], np.int32), a=[(first + at).astype(np.int32)],
                        b=[words[at].astype("<u8").ravel().view(np.int32)],
                    )

    def _batch(self, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        schema = [(c, pa.list_(pa.int32()) if c in ("a", "b") else pa.int32())
                  for c in ("block", "turn", "a", "b", "slot", "node", "length")]
        columns["block"] = np.full(n, self.block, np.int32)
        arrays = [pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in schema]
        return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in schema])


def search(nodes: int, width: int, done: int):
    """Rounds of the blocks whose rows come ordered by block and turn; `done` rounds went before."""
    def run(batches):
        held = None
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            for i, (block, turn) in enumerate(zip(
                batch.column("block").to_pylist(), batch.column("turn").to_pylist(), strict=True
            )):
                if held is None or held.block != block:
                    if held is not None:
                        yield from held.close(done)
                    held = _Block(block, nodes, width)
                if turn > held.turn:
                    yield from held.end(done)
                    held.begin(turn)
                if held.live:
                    held.add(turn, *(c[i].values.to_numpy() for c in (a, b)))
        if held is not None:
            yield from held.close(done)

    return run
