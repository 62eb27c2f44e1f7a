"""Quality scores from compressed sizes under two dictionaries.

One zstandard dictionary is built from text labelled good, one from text
labelled bad. A text is compressed in chunks under both; the difference of the
sizes, normalised by the text's length, becomes a score through a logistic
calibration on labelled texts that built neither dictionary.
"""

import math
import random
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgemeter.llm.storage import staged, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 2048
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 2500  # per class, for the dictionaries and the calibration together
DICTIONARY_CHUNKS = 16_384  # per class, expected number; taken by hash where there are more
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def chunks(raw: bytes) -> list[bytes]:
    return [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]

    def compressors(self):
        return [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=_as_dictionary(raw), write_content_size=False,
                write_checksum=False, write_dict_id=False)
            for raw in (self.good, self.bad)
        ]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.mean)) / np.array(self.scale)
        z = x @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_AUTO if raw else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


def features(texts: list[str], compressors) -> np.ndarray:
    """Per text: size difference per byte, relative difference, mean size per
    byte and its square, and the weight of the frame headers in short texts."""
    out = np.zeros((len(texts), 5))
    good, bad = compressors
    for i, text in enumerate(texts):
        raw = text.encode()
        parts = chunks(raw)
        if not parts:
            continue
        g = sum(len(good.compress(c)) for c in parts)
        b = sum(len(bad.compress(c)) for c in parts)
        n = len(raw)
        ratio = (g + b) / (2 * n)
        out[i] = (b - g) / n, (b - g) / (b + g), ratio, ratio * ratio, 1 / math.sqrt(n)
    return out


def _dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary, or the text itself where there is too little to train on."""
    random.Random(0).shuffle(parts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), 1e-2)
        ridge[0] = 1e-6
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _chunk_picker(shares: dict[tuple[int, int], float]):
    """Chunks of the documents (y, doc_id) named in `shares`, of each about that share."""

    def run(batches):
        for batch in batches:
            for doc_id, y, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                least = shares.get((y, doc_id), 0) * 2**32
                parts = [(i, c) for i, c in enumerate(chunks(text.encode())) if zlib.crc32(b"%d %d" % (doc_id, i)) < least]
                if parts:
                    at, part = zip(*parts, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(at), pa.int64()), pa.array([y] * len(at), pa.int32()),
                         pa.array(at, pa.int64()), pa.array(part, pa.binary())],
                        names=["doc_id", "y", "at", "part"])

    return run


def _measurer(model: Model, wanted: set[tuple[int, int]]):
    """Features of the documents (y, doc_id) in `wanted`."""

    def run(batches):
        compressors = model.compressors()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)
                rows = [r for r in rows if (r[1], r[0]) in wanted]
                x = features([text for _, _, text in rows], compressors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array(x.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "y", "x"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Learn from labelled rows that are not `held_out`.

    At most `sample_docs` documents of each class, those with the smallest
    hashes of their ids, are read whole: one half builds the dictionaries, the
    other calibrates. Of rows repeated under one id the smallest text counts.
    Dictionaries are trained on the chunks of their half, on a part of them
    chosen by hash where they are more than DICTIONARY_CHUNKS. Class shares are
    those of all labelled rows, from a count. Rows without an id or a label of 0
    or 1 teach nothing; with fewer than four documents of a class the score is
    the share of label 1, or a half without any label.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .filter(~held_out(F.col("doc_id")))
    )
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    ids = [
        known.filter(F.col("y") == y).select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
        .distinct().orderBy("h", "doc_id").limit(sample_docs)
        for y in (0, 1)
    ]
    # At most 2 * sample_docs rows on the build side and in the sample.
    picked = F.broadcast(ids[0].unionAll(ids[1]))
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = staged(
        texts.join(picked, "doc_id").groupBy("doc_id", F.col("y").cast("int").alias("y"), "h")
        .agg(F.min("text").alias("text")),
        "quality-sample")
    rows = sample.select("doc_id", "y", "h", F.octet_length("text").alias("size")).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    by_class = [[r for r in rows if r["y"] == y] for y in (0, 1)]
    flat = [0.0] * 5, [0.0] * 5, [1.0] * 5
    if min(map(len, by_class)) < 4:
        share = shares.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", [math.log(share / (1 - share)), *flat[0]], flat[1], flat[2])
    place = {(r["y"], r["doc_id"]): i for i, r in enumerate(by_class[0] + by_class[1])}
    taken = {}
    for half in (c[::2] for c in by_class):
        n = sum(-(-r["size"] // CHUNK_BYTES) for r in half)
        taken |= {(r["y"], r["doc_id"]): DICTIONARY_CHUNKS / max(n, DICTIONARY_CHUNKS) for r in half}
    # Only chunks and features reach the driver, no whole text.
    read = sample.select("doc_id", "y", "text")
    parts = read.mapInArrow(_chunk_picker(taken), "doc_id long, y int, at long, part binary").collect()
    parts.sort(key=lambda r: (place[r["y"], r["doc_id"]], r["at"]))
    bad, good = (_dictionary([bytes(r["part"]) for r in parts if r["y"] == y]) for y in (0, 1))
    model = Model(good, bad, [0.0, *flat[0]], flat[1], flat[2])
    test = [c[1::2] for c in by_class]
    wanted = {(r["y"], r["doc_id"]) for r in test[0] + test[1]}
    measured = read.mapInArrow(_measurer(model, wanted), "doc_id long, y int, x array<double>").collect()
    measured.sort(key=lambda r: place[r["y"], r["doc_id"]])
    x = np.array([r["x"] for r in measured])
    y = np.array([0] * len(test[0]) + [1] * len(test[1]))
    weight = np.where(y == 1, shares[1] / len(test[1]), shares[0] / len(test[0]))
    weight *= len(y) / weight.sum()
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    weights = _calibrate((x - mean) / scale, y, weight)
    return Model(good, bad, weights, mean.tolist(), scale.tolist())


def _scorer(model: Model):
    def run(batches):
        compressors = model.compressors()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.score(features(texts, compressors)))],
                    names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only the text enters the score. Null and empty texts have the score of a
    text without features; a null id is returned with held_out false, repeated
    rows as often as given.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    judge = _judge(model)
    name = unused(docs, "_score")
    marked = docs.withColumn(name, judge(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.filter(F.col(name) >= 0.5).drop(name)


def _judge(model: Model):
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for texts in batches:
            yield pd.Series(model.score(features(texts.tolist(), compressors)))

    return F.pandas_udf(judge, "double")
