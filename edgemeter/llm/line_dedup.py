"""Removal of lines that many documents share, by a sharded minimal perfect hash.

Documents are read in blocks. A block lists its distinct line keys once, as
128-bit BLAKE2 digests, with the number of its documents that hold each. Summed
over all blocks these give the documents of every key. The keys of enough
documents are dealt to shards by hash; a shard is one minimal perfect hash with
an array of fingerprints and one of counts. Each block then sends every shard
its keys of that shard, once however many of its lines have them, and gets the
places of those that the shard holds. So a line that stands everywhere has one
entry a block, in the counts and in the probes, and no line is joined to a line.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.llm import minimal_hash
from edgemeter.llm.storage import shuffle_partitions, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_LINES = 1 << 18
BLOCK_BYTES = 16 << 20
SHARD_KEYS = 1 << 15
SHARD_PROBES = 1 << 19
CUT_BYTES = 8 << 20


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where it has fewer code points than `min_chars`."""
    # Only A-Z change when bytes are lowered.
    keys = [line.strip(STRIP) for line in text.encode().lower().split(b"\n")]
    if min_chars <= 1:
        return [key if len(key) >= min_chars else None for key in keys]
    return [key if len(key.decode()) >= min_chars else None for key in keys]


def _blocks(min_chars: int):
    """One row a block: distinct keys, documents of each, rows, their line ends, the key of every line."""

    def emit(number, rows, ends, lines):
        lines = np.array(lines, np.int32)
        ends = np.array(ends, np.int64)
        keys = b"".join(hashlib.blake2b(key, digest_size=16).digest() for key in number)
        real = np.flatnonzero(lines >= 0)
        row = np.searchsorted(ends, real, "right")
        once = np.unique(row * max(len(number), 1) + lines[real])
        n = np.bincount(once % max(len(number), 1), minlength=len(number)).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in (keys, n.tobytes(), b"".join(rows), ends.tobytes(), lines.tobytes())],
            names=["keys", "n", "rows", "ends", "lines"])

    def run(batches):
        number, rows, ends, lines, size = {}, [], [], [], 0
        for batch in batches:
            for row, text in zip(batch.column("row"), batch.column("text"), strict=True):
                for key in line_keys(text.as_py() or "", min_chars):
                    if key is None:
                        lines.append(-1)
                        continue
                    at = number.setdefault(key, len(number))
                    if at == len(number) - 1:
                        size += len(key)
                    lines.append(at)
                rows.append(row.as_py())
                ends.append(len(lines))
                if len(lines) >= BLOCK_LINES or size >= BLOCK_BYTES:
                    yield emit(number, rows, ends, lines)
                    number, rows, ends, lines, size = {}, [], [], [], 0
        if rows:
            yield emit(number, rows, ends, lines)

    return run


def _halves(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(keys, np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])


def _counted():
    """(h, f, n): the keys of each block with their documents there."""

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("n"), strict=True):
                h, f = _halves(keys.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)),
                     pa.array(np.frombuffer(n.as_py(), np.uint32).astype(np.int64))], names=["h", "f", "n"])

    return run


def _indexed():
    """One index for each shard's list of (h, f, n)."""

    def run(batches):
        for batch in batches:
            blobs = []
            for cell in batch.column("held"):
                h, f, n = (cell.values.field(i).to_numpy() for i in range(3))
                blobs.append(minimal_hash.build(
                    np.ascontiguousarray(h).view(np.uint64), np.ascontiguousarray(f).view(np.uint64), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return run


def _probes(shards: int):
    """(shard, block, keys, places): a block's keys by shard, with their places in the block's list."""

    def run(batches):
        for batch in batches:
            for block, keys in zip(batch.column("block"), batch.column("keys"), strict=True):
                pair = np.frombuffer(keys.as_py(), np.uint64).reshape(-1, 2)
                if not len(pair):
                    continue
                shard = pair[:, 0].astype(np.int64) % shards  # as pmod
                order = np.argsort(shard, kind="stable").astype(np.uint32)
                shard = shard[order]
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                parts = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut]), pa.array([block.as_py()] * len(cut), pa.int64()),
                     pa.array([pair[p].tobytes() for p in parts], pa.binary()),
                     pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["shard", "block", "keys", "places"])

    return run


def _hits(min_docs: int):
    """(block, places): the places of the keys that the shard's index holds."""

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        blocks, found = [], []
        if index.num_rows:
            held = minimal_hash.Index(index.column("blob")[0].as_py())
            cells = probes.column("keys").to_pylist()
            n = np.array([len(c) // 16 for c in cells])
            hit = held.count(*_halves(b"".join(cells))) >= min_docs
            places = np.frombuffer(b"".join(probes.column("places").to_pylist()), np.uint32)
            at = 0
            for block, size in zip(probes.column("block").to_pylist(), n.tolist(), strict=True):
                own = places[at : at + size][hit[at : at + size]]
                at += size
                if len(own):
                    blocks.append(block)
                    found.append(own.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "places": pa.array(found, pa.binary())})

    return run


def _dropped():
    """(row, dropped): line numbers that go, of the rows that lose any."""

    def run(batches):
        for batch in batches:
            for rows, ends, lines, cells in zip(
                *(batch.column(c) for c in ("rows", "ends", "lines", "hits")), strict=True
            ):
                ends, lines = np.frombuffer(ends.as_py(), np.int64), np.frombuffer(lines.as_py(), np.int32)
                hit = np.zeros(int(lines.max(initial=-1)) + 2, bool)
                hit[np.frombuffer(b"".join(cells.as_py()), np.uint32)] = True
                gone = np.flatnonzero(hit[lines])  # -1 reads the last entry, which is never set
                row = np.searchsorted(ends, gone, "right")
                begin = np.concatenate([[0], ends[:-1]])
                number = (gone - begin[row]).astype(np.int32)
                cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
                ids = rows.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[16 * r : 16 * r + 16] for r in row[cut].tolist()], pa.binary()),
                     pa.array([number[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(row)], strict=True)],
                              pa.binary())], names=["row", "dropped"])

    return run


def _cut():
    """Lines that stay."""

    def emit(out):
        ids, n, gone, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for doc, text, dropped in zip(
                *(batch.column(c) for c in ("doc_id", "text", "dropped")), strict=True
            ):
                text = text.as_py() or ""
                numbers = np.frombuffer(dropped.as_py() or b"", np.int32)
                n = text.count("\n") + 1
                if len(numbers):
                    gone = set(numbers.tolist())
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])
                out.append((doc.as_py(), n, len(numbers), text))
                size += len(text)
                if size >= CUT_BYTES:
                    yield emit(out)
                    out, size = [], 0
        if out:
            yield emit(out)

    return run


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row.

    Texts split at line feeds; a null or empty text is one empty line. A line's
    key is the line without ASCII white space at its ends and with A-Z lowered.
    Lines whose key has at least `min_chars` code points and stands in at least
    `min_docs` rows go everywhere; the others stay as they are, joined by line
    feeds. Every row counts as a document of its own, also one without an id or
    repeated under one. A line that repeats within a row counts once.
    """
    n = shuffle_partitions(docs)
    # Equal digests mean the same id and text, hence the same lines.
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"),
                    F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.substring(F.unhex(F.sha2(name, 256)), 1, 16).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
    )
    blocks = staged(
        rows.select("row", "text")
        .mapInArrow(_blocks(min_chars), "keys binary, n binary, rows binary, ends binary, lines binary")
        .withColumn("block", F.monotonically_increasing_id()),
        "line-blocks",
    )
    common = staged(
        blocks.select("keys", "n").mapInArrow(_counted(), "h long, f long, n long")
        .groupBy("h", "f").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs),
        "common-lines",
    )
    n_probes = blocks.agg(F.sum(F.length("keys") / 16)).first()[0] or 0
    shards = max(n, math.ceil(common.count() / SHARD_KEYS), math.ceil(n_probes / SHARD_PROBES))
    index = staged(
        common.groupBy(F.pmod("h", F.lit(shards)).alias("shard"))
        .agg(F.collect_list(F.struct("h", "f", "n")).alias("held"))
        .mapInArrow(_indexed(), "shard long, blob binary"),
        "line-index",
    )
    hits = (
        blocks.select("block", "keys")
        .mapInArrow(_probes(shards), "shard long, block long, keys binary, places binary")
        .groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInArrow(_hits(min_docs), "block long, places binary")
        .groupBy("block").agg(F.collect_list("places").alias("hits"))
    )
    dropped = (
        blocks.select("block", "rows", "ends", "lines").join(hits, "block")
        .select("rows", "ends", "lines", "hits")
        .mapInArrow(_dropped(), "row binary, dropped binary")
        # A row given twice has lost the same lines twice.
        .groupBy("row").agg(F.first("dropped").alias("dropped"))
    )
    return rows.join(dropped, "row", "left").select("doc_id", "text", "dropped").mapInArrow(
        _cut(), "doc_id long, n_lines long, n_dropped long, kept_text string"
    )
