"""Removal of long word sequences that occur more than once, by recompression.

Every text is rewritten in rounds: runs of one word become one symbol, then
pairs (a, b) with `a` on the left and `b` on the right side of a pseudo-random
split of all symbols become one symbol, four times over. A symbol's name is a
fingerprint of the words it stands for, so all tasks name equal phrases alike.
Whether two symbols merge depends on these two alone, so equal word sequences
get equal symbols except near their ends, and how far the ends are uncertain
follows from the sequence itself.

A window of `size` words is represented by one anchor: the longest symbol (then
the smallest hash, then the leftmost) among those that no context can change, at
the highest round that leaves any. Equal windows have equal anchors at equal
offsets. One Spark round counts anchor names; windows whose anchor name occurs
once are unique. For the others a second round compares the windows under each
anchor name. A text as a whole is one more symbol: of texts that share it, only
the smallest takes part in the second round.

Windows and whole texts are compared by 128-bit BLAKE2 digests of their words, so
only names that merely select candidates rest on quick fingerprints. Names that
repeat within a batch are settled there, so a hot name has at most
one row per batch in a shuffle. Nothing is collected: the texts' shuffle by
document is written once and read by both rounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm import arrays
from edgemeter.llm.storage import shuffle_partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_ROUNDS = 4
COPY, LEAD = -1, -2
BATCH_ROWS = 1 << 20
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("at", "<i4"), ("w", "u1")])


def _regroup(names, starts, ends, head):
    """Merge symbols into those that begin at `head`; the rest join the symbol before."""
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(names)) - 1
    return at, last, starts[at], ends[last]


def _rounds(words: np.ndarray, bounds: np.ndarray, size: int):
    """Anchors of all windows: (window starts, their anchors, anchor names).

    Anchors are numbered 0.. in the order of (level, position); a name is given
    per anchor.
    """
    n = len(words)
    counts = np.diff(bounds)
    row_end = np.repeat(bounds[1:], counts)
    windows = np.flatnonzero(np.arange(n) + size <= row_end)
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    names, starts = words, np.arange(n)
    ends = starts + 1
    row = arrays.row_of(bounds)
    left, right = windows.copy(), windows + size
    live = np.ones(len(windows), bool)
    picked: list[tuple] = []
    begin_at, end_at = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    for step in range(PAIR_ROUNDS + 2):
        begin_at[starts] = np.arange(len(starts))
        end_at[ends] = np.arange(len(ends))
        here = (names, starts, ends, left.copy(), right.copy(), live.copy())
        if step == PAIR_ROUNDS + 1:
            picked.append((*here, live.copy()))
            break
        first, last = begin_at[left], end_at[right]
        if step == 0:
            head = np.ones(len(names), bool)
            head[1:] = (names[1:] != names[:-1]) | (row[starts[1:]] != row[starts[:-1]])
            at, to, new_starts, new_ends = _regroup(names, starts, ends, head)
            group = np.cumsum(head) - 1
            new_left, new_right = new_ends[group[first]], new_starts[group[last]]
            many = to > at
            named = names[at].copy()
            named[many] = arrays.mix(named[many] * np.uint64(5) + (to - at + 1)[many].astype(np.uint64))
        else:
            is_left = (arrays.mix(names + np.uint64(step)) >> np.uint64(17)) & np.uint64(1) == 1
            joins = np.zeros(len(names), bool)
            joins[1:] = is_left[:-1] & ~is_left[1:] & (row[starts[1:]] == row[starts[:-1]])
            at, to, new_starts, new_ends = _regroup(names, starts, ends, ~joins)
            new_left = np.where(is_left[first], left, ends[first])
            new_right = np.where(is_left[last], starts[last], right)
            named = names[at].copy()
            many = to > at
            named[many] = arrays.mix(named[many] * np.uint64(3) + arrays.mix(names[to[many]]))
        lives = live & (new_left < new_right)
        picked.append((*here, live & ~lives))
        left, right = np.where(lives, new_left, left), np.where(lives, new_right, right)
        # Windows that ended keep valid positions: those of their last level are not read again.
        left, right = np.where(lives, left, 0), np.where(lives, right, 0)
        if not lives.any():
            break
        names, starts, ends, live = named, new_starts, new_ends, lives
        left[~live], right[~live] = starts[0], ends[0]
    anchor = np.zeros(len(windows), np.int64)
    out_names: list[np.ndarray] = []
    total = 0
    for level, (names, starts, ends, left, right, _, done) in enumerate(picked):
        who = np.flatnonzero(done)
        if not len(who):
            continue
        begin_at[starts] = np.arange(len(starts))
        end_at[ends] = np.arange(len(ends))
        lo, hi = begin_at[left[who]], end_at[right[who]] + 1
        length = np.minimum(ends - starts, 255).astype(np.uint64)
        score = ((np.uint64(255) - length) << np.uint64(56)) | (arrays.mix(names) >> np.uint64(8))
        best = _range_argmin(score, lo, hi)
        used, index = np.unique(best, return_inverse=True)
        anchor[who] = total + index
        out_names.append(arrays.mix(names[used] + np.uint64(1000 + level)))
        total += len(used)
    return windows, anchor, np.concatenate(out_names)


def _range_argmin(score: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Leftmost position of the smallest score in each [lo, hi)."""
    width = hi - lo
    depth = np.frexp(width.astype(np.float64))[1] - 1
    best = np.arange(len(score))
    out = np.empty(len(lo), np.int64)
    for level in range(int(depth.max()) + 1):
        who = np.flatnonzero(depth == level)
        if len(who):
            a, b = best[lo[who]], best[hi[who] - (1 << level)]
            out[who] = np.where(score[b] < score[a], b, a)
        step = 1 << level
        if len(best) <= step:
            continue
        a, b = best[:-step], best[step:]
        best = np.where(score[b] < score[a], b, a)
    return out


def _parsed(batch, size):
    """Per slice: (row ids, bounds, word hashes, buffer, starts, ends, windows, anchors, names)."""
    for first, buf, offsets in arrays.text_slices(batch.column("text")):
        starts, ends, bounds = arrays.word_spans(buf, offsets, arrays.NON_SPACE)
        words = arrays.word_hash(buf, starts, ends)
        uid = batch.column("uid").slice(first, len(offsets) - 1).to_numpy()
        yield first, uid, bounds, words, buf, starts, ends, *_rounds(words, bounds, size)


def _joined(buf, starts, ends):
    """(words joined by one space, begin and end of each word there)."""
    width = ends - starts + 1
    begins = np.cumsum(width) - width
    out = np.full(int(width.sum()), 0x20, np.uint8)
    at = np.repeat(begins - starts, width - 1) + np.flatnonzero(_inside(len(buf), starts, ends))
    out[at] = buf[at - np.repeat(begins - starts, width - 1)]
    return out.tobytes(), begins, begins + width - 1


def _inside(n, starts, ends):
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _place_in_row(windows, anchor, n_anchors, bounds):
    """(row of each anchor, number of each anchor within its row)."""
    row = np.zeros(n_anchors, np.int64)
    row[anchor] = np.searchsorted(bounds, windows, "right") - 1
    order = np.argsort(row, kind="stable")
    sizes = np.bincount(row, minlength=len(bounds) - 1)
    number = np.empty(n_anchors, np.int64)
    number[order] = np.arange(n_anchors) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, number


def _spread(a: np.ndarray) -> np.ndarray:
    return arrays.mix(a.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))


def _anchor_rows(size: int):
    """(key, check, uid, numbers, weight): anchor names and whole-text names."""

    def emit(held):
        key, check, uid, number = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((number, uid, check, key))
        key, check, uid, number = key[order], check[order], uid[order], number[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(key)))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(number[at].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[at].view(np.int64)), pa.array(check[at].view(np.int64)), pa.array(uid[at]),
             lists, pa.array(np.minimum(n, 2).astype(np.int32))],
            names=["key", "check", "uid", "numbers", "weight"])
        uid, number = uid[~new], number[~new]  # settled here: one row per text
        if not len(uid):
            return
        order = np.argsort(uid, kind="stable")
        uid, number = uid[order], number[order]
        at = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(at, len(uid)).astype(np.int32)), pa.array(number.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_spread(uid[at]).view(np.int64)), pa.array(np.full(len(at), -1, np.int64)),
             pa.array(uid[at]), lists, pa.array(np.full(len(at), 2, np.int32))],
            names=["key", "check", "uid", "numbers", "weight"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, uid, bounds, words, buf, starts, ends, windows, anchor, names in _parsed(batch, size):
                row, number = _place_in_row(windows, anchor, len(names), bounds)
                held.append((names, np.zeros(len(names), np.uint64), uid[row], number))
                long = np.flatnonzero(np.diff(bounds) >= size)
                data, begins, ends_at = _joined(buf, starts, ends)
                half = arrays.digests(data, begins[bounds[long]], ends_at[bounds[long + 1] - 1])
                # Odd and positive: neither 0, an anchor's mark, nor -1, a settled row's.
                check = (half[:, 1] >> np.uint64(1)) | np.uint64(1)
                held.append((half[:, 0], check, uid[long], np.full(len(long), COPY)))
                n += len(names) + len(long)
                if n >= BATCH_ROWS:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _window_rows(size: int):
    """(key, uid, windows, ranges): windows to compare under their anchor name,
    and word ranges that this batch has settled."""

    def flags_of(numbers):
        return numbers.values.to_numpy(zero_copy_only=False)[
            numbers.offsets[0].as_py() : numbers.offsets[-1].as_py()]

    def emit(held):
        key, uid, h, g, at, w = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, uid, g, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        lead = order[new]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        weight = np.minimum(np.maximum(np.maximum.reduceat(w[order], np.flatnonzero(new)), n), 2)
        settled = order[np.repeat(weight == 2, n)]
        by = lead[np.lexsort((at[lead], uid[lead], key[lead]))]
        place = np.empty(len(order), np.int64)
        place[lead] = np.arange(len(lead))
        rows = np.empty(len(by), WINDOW)
        rows["h"], rows["g"], rows["at"], rows["w"] = h[by], g[by], at[by], weight[place[by]]
        cut = np.flatnonzero(np.concatenate(
            [[True], (key[by][1:] != key[by][:-1]) | (uid[by][1:] != uid[by][:-1])]))
        blob = _binary(rows, np.append(cut, len(by)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[by][cut].view(np.int64)), pa.array(uid[by][cut]), blob,
             pa.nulls(len(cut), pa.binary())], names=["key", "uid", "windows", "ranges"])
        if len(settled):
            owner, blob = _range_rows(uid[settled], at[settled], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(owner).view(np.int64)), pa.array(owner),
                 pa.nulls(len(owner), pa.binary()), blob], names=["key", "uid", "windows", "ranges"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            marked = batch.column("numbers")
            keep = np.flatnonzero(~np.asarray(marked.is_null()))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            marked = batch.column("numbers")
            for first, uid, bounds, words, buf, starts, ends, windows, anchor, names in _parsed(batch, size):
                rows = len(bounds) - 1
                own = marked.slice(first, rows)
                flat = flags_of(own)
                of = np.repeat(np.arange(rows), np.diff(own.offsets.to_numpy()))
                is_copy, is_lead = np.zeros(rows, bool), np.zeros(rows, bool)
                is_copy[of[flat == COPY]] = True
                is_lead[of[flat == LEAD]] = True
                row, number = _place_in_row(windows, anchor, len(names), bounds)
                sizes = np.bincount(row, minlength=rows)
                base = np.cumsum(sizes) - sizes
                hit = np.zeros(len(names), bool)
                order = np.empty(len(names), np.int64)
                order[base[row] + number] = np.arange(len(names))
                hit[order[base[of[flat >= 0]] + flat[flat >= 0]]] = True
                hit |= is_lead[row]
                hit &= ~(is_copy & ~is_lead)[row]
                take = hit[anchor]
                windows, anchor = windows[take], anchor[take]
                if not len(windows):
                    continue
                data, begins, ends_at = _joined(buf, starts, ends)
                half = arrays.digests(data, begins[windows], ends_at[windows + size - 1])
                wr = row[anchor]
                held.append((names[anchor], uid[wr], half[:, 0], half[:, 1],
                             (windows - bounds[wr]).astype(np.int32),
                             np.where(is_lead[wr], 2, 1).astype(np.int64)))
                n += len(windows)
                if n >= BATCH_ROWS:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Values between the cuts as one binary cell each."""
    raw = values.tobytes()
    offsets = (cuts * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _range_rows(uid: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array]:
    """Windows of each text merged into covered word ranges, packed per text."""
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order].astype(np.int64)
    new_text = np.concatenate([[True], uid[1:] != uid[:-1]])
    new = new_text.copy()
    new[1:] |= at[1:] > at[:-1] + size
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    ranges = np.stack([at[begin], at[end] + size], 1).astype(np.int32)
    cut = np.flatnonzero(new_text[begin])
    flat = ranges.reshape(-1)
    return uid[begin][cut], _binary(flat, np.append(cut, len(begin)) * 2)


def _compare(size: int):
    """Under each anchor name, the windows that occur twice; rows come sorted by key."""

    def settle(held):
        table = pa.Table.from_batches(held)
        uid = table.column("uid").to_numpy()
        cells = table.column("windows").to_pylist()
        n = np.array([len(c) // WINDOW.itemsize if c is not None else 0 for c in cells])
        rows = np.frombuffer(b"".join(c for c in cells if c is not None), WINDOW)
        owner = np.repeat(uid, n)
        if len(rows):
            order = np.lexsort((rows["g"], rows["h"]))
            h, g = rows["h"][order], rows["g"][order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            at = np.flatnonzero(new)
            total = np.add.reduceat(rows["w"][order].astype(np.int64), at)
            twice = order[np.repeat(total >= 2, np.diff(np.append(at, len(order))))]
            if len(twice):
                found, blob = _range_rows(owner[twice], rows["at"][twice], size)
                yield pa.RecordBatch.from_arrays([pa.array(found), blob], names=["uid", "ranges"])
        done = table.filter(table.column("ranges").is_valid()).select(["uid", "ranges"])
        yield from done.to_batches()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            held.append(batch)
            n += batch.num_rows
            if n < 50_000:
                continue
            # Everything before the last key is complete.
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from settle([*held[:-1], batch.slice(0, cut)])
                held, n = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from settle(held)

    return run


def _cut(size: int):
    """Remaining words of every text."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                out = []
                cells = batch.column("ranges").slice(at, 256).to_pylist()
                flags = batch.column("numbers").slice(at, 256).to_pylist()
                for text, ranges, marks in zip(texts[at : at + 256], cells, flags, strict=True):
                    words = (text or "").encode().split()
                    removed = 0
                    if marks and (COPY in marks or LEAD in marks):
                        removed, kept = len(words), []
                    elif ranges:
                        edge = np.zeros(len(words) + 1, np.int32)
                        spans = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2)
                        np.add.at(edge, spans[:, 0], 1)
                        np.add.at(edge, spans[:, 1], -1)
                        stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                        kept = [words[i] for i in stay.tolist()]
                        removed = len(words) - len(kept)
                    else:
                        kept = words
                    out.append((len(words), removed, b" ".join(kept).decode()))
                n, gone, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, 256), pa.array(n, pa.int64()),
                     pa.array(gone, pa.int64()), pa.array(text, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(
    docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row.

    A word (maximal run without ASCII white space) is removed when a window of
    `size` consecutive words that covers it also starts anywhere else, in this
    or another text; windows are judged on the input. Kept words are joined by
    one space. A null or empty text has no words; a text shorter than a window
    stays whole. Rows are told apart by id and text, so rows without an id are
    treated like others, and a row given twice is a repeat of itself.
    """
    n = shuffle_partitions(docs)
    texts = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"),
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
    )
    names = texts.select("uid", "text").mapInArrow(
        _anchor_rows(size), "key long, check long, uid long, numbers array<int>, weight int")
    same = Window.partitionBy("key", "check")
    counted = names.select(
        "uid", "numbers", "check", F.sum("weight").over(same).alias("n"),
        F.min("uid").over(same).alias("lead"),
    ).filter("n >= 2")
    is_whole = (F.col("check") != 0) & (F.col("check") != -1)
    marks = counted.select(
        "uid",
        F.when(is_whole & (F.col("uid") == F.col("lead")), F.array(F.lit(LEAD)))
        .otherwise(F.col("numbers")).alias("numbers"),
    ).groupBy("uid").agg(F.flatten(F.collect_list("numbers")).alias("numbers"))
    marked = texts.join(marks, "uid", "left")
    compared = (
        # The same columns as below: only then the shuffle of the texts is shared.
        marked.select("uid", "doc_id", "text", "numbers")
        .mapInArrow(_window_rows(size), "key long, uid long, windows binary, ranges binary")
        .repartition(n, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_compare(size), "uid long, ranges binary")
        .groupBy("uid")
        .agg(F.collect_list("ranges").alias("ranges"))
    )
    return marked.join(compared, "uid", "left").select(
        "doc_id", "text", "numbers", "ranges"
    ).mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_text string")
