"""Exact top-k and mixing against brute force; the pipeline as a whole."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgemeter.llm import mixing, queries, topk


def brute_top(rows, k, every):
    use = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows
           if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, x in use:
        if q % every == 0:
            found = sorted((-int(x @ y), i) for i, y in use if i != q and len(y) == len(x))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def vectors(n=700, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(300)]  # one vector many times
    rows += [(2000, None), (2050, [None] * dim), (2100, [math.nan] * dim), (2101, [math.inf] * dim),
             (None, rows[0][1]), (2150, [0.0] * dim), (2200, [1.0, 2.0]), (2201, [1.0, -2.0])]
    return rows


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 8)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.top_k(frame.withColumn("cell", F.lit(1)), 5, 50)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 50)


def test_top_k_fewer_candidates_and_repeated_rows(spark):
    rows = [(0, [1.0]), (1, [0.5]), (1, [0.5]), (2, [0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(frame, 5, 50).collect()))
    assert got == [(0, 1, 1, 256 * 128), (0, 2, 1, 256 * 128), (0, 3, 2, 256 * 128)]
    # Different vectors under one id are candidates of their own.
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.1, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(frame, 5, 50).collect()))
    assert got == [(0, 1, 1, 230 * 256), (0, 2, 1, 128 * 256), (0, 3, 2, 25 * 256)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0


def test_top_k_repeated_ids_match_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=4).round(1).tolist()) for i in rng.integers(0, 120, 900)]
    rows += [(50, rows[0][1])] * 9 + [(7, rows[1][1])] * 9
    exact = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        scores = sorted(
            (-sum(a * b for a, b in zip(x, y, strict=True)), j)
            for i, x in exact if i == q for j, y in exact if j != q)[:5]
        want += [(q, n, j, -score) for n, (score, j) in enumerate(scores, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, topk.top_k(frame, 5, 50).collect())) == want


def test_top_k_components_beyond_64_bits(spark):
    rows = [(0, [2.0**-8, 0.0]), (1, [0.0, 1e300]), (2, [3.0, -1e300]), (3, [2.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, 2, 50).collect())) == [(0, 1, 2, 768), (0, 2, 3, 512)]
    frame = spark.createDataFrame([(50, [0.0, 1.0]), *rows], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|overflow|OverflowError"):
        topk.top_k(frame, 2, 50).collect()  # a score that no long holds


def test_top_k_sends_a_block_only_to_groups_that_need_it(spark):
    rng = np.random.default_rng(4)
    centre = 100 * np.eye(8)
    rows = [(i, (centre[i % 8] + rng.normal(size=8)).tolist()) for i in range(40_000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    sent = spark.sparkContext.accumulator(0)
    solve = topk._solve

    def counting(k):
        inner = solve(k)

        def run(key, queries, data):
            sent.add(len(data) if len(queries) else 0)
            return inner(key, queries, data)

        return run

    topk._solve = counting
    try:
        assert topk.top_k(frame, 5, 50).count() == 4000
    finally:
        topk._solve = solve
    # Eight clusters and no query that needs another cluster's cells: about one copy of the table.
    assert sent.value <= 2 * len(rows)


def test_top_k_large_components(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, 5, 50).collect())) == brute_top(rows, 5, 50)


def test_top_k_huge_components(spark):
    rows = [(0, [2.0**-8, 1.0])]
    rows += [(i, [2.0 ** (44 + i % 10) * (-1) ** i, float(i)]) for i in range(1, 20)]
    rows += [(100, [2.0**-8, 0.0]), (200, [2.0**-8, -(2.0**-8)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = [(i, [int(c * 256) for c in v]) for i, v in rows]
    want = []
    for q, x in exact:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in exact if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    assert any(s >= 2**53 for *_, s in want)
    assert sorted(map(tuple, topk.top_k(frame, 5, 50).collect())) == sorted(want)


def documents(seed=1):
    rng = random.Random(seed)
    sources = ["big"] * 300 + ["mid"] * 60 + ["low"] * 40 + [None] * 30 + ["empty"] * 3
    rows = []
    for i, source in enumerate(sources):
        n = 0 if source == "empty" else rng.randint(1, 40)
        rows.append((i, " ".join("w%d" % rng.randrange(50) for _ in range(n)), source))
    return [*rows, (9000, None, "big"), (9001, " \n", "low")]


def test_mix_reaches_its_target(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(frame, target_entropy=0.9, max_repeats=3.0).collect()
    assert len(got) == len(rows) and all(1 <= r["copies"] <= 3 for r in got)
    assert {r["doc_id"]: r["tokens"] for r in got} == {i: len((t or "").split()) for i, t, _ in rows}
    before, after = collections.Counter(), collections.Counter()
    for r in got:
        before[r["source"]] += r["tokens"]
        after[r["source"]] += r["tokens"] * r["copies"]
    shares = np.array([v for s, v in sorted(before.items(), key=str) if v], float)
    shares /= shares.sum()
    low, high = max(0.0, 1 - math.log(3) / math.log(shares.max() / shares.min())), 1.0
    entropy = lambda a: -sum(w * math.log(w) for w in shares**a / (shares**a).sum())
    goal = 0.9 * math.log(len(shares))
    if entropy(low) > goal:
        for _ in range(60):
            half = (low + high) / 2
            low, high = (half, high) if entropy(half) >= goal else (low, half)
    epochs = shares ** (low - 1)
    epochs /= epochs.min()
    names = [s for s, v in sorted(before.items(), key=str) if v]
    for name, wanted in zip(names, epochs, strict=True):
        assert after[name] <= wanted * before[name] + 1e-6 * before[name]
        assert after[name] > wanted * before[name] - 41  # the block is cut at a document
    assert after["empty"] == 0


def test_mix_is_the_same_for_any_partitioning(spark):
    frame = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    one = mixing.mix(frame.repartition(1)).select("doc_id", "copies").collect()
    two = mixing.mix(frame.repartition(9)).select("doc_id", "copies").collect()
    assert sorted(one) == sorted(two)


def test_repeat_rows_and_empty_table(spark):
    frame = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    frame = frame.withColumn("_copies", F.lit("c"))
    mixed = mixing.mix(frame)
    out = mixing.repeat_rows(frame, mixed)
    assert out.columns == frame.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(frame.limit(0)).count() == 0


@pytest.mark.parametrize("shares", [[1.0], [1, 1, 1], [1000, 10, 1]])
def test_find_mixture_bounds(spark, shares):
    totals = spark.createDataFrame([(str(i), int(s)) for i, s in enumerate(shares)], "name string, tokens long")
    found = mixing.find_mixture(totals, 1.0, 4.0)
    epochs = (np.array(shares) / sum(shares)) ** (found.exponent - 1) / found.norm / found.least
    assert epochs.max() <= 4 + 1e-9 and epochs.min() == pytest.approx(1)


def test_pipeline_against_its_parts(spark, tmp_path):
    """Each stage on small tables: nothing clean is lost, every decision shows in the result."""
    rng = random.Random(8)
    prose = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    good = [prose(rng.randint(20, 90)) for _ in range(160)]
    edited = [t + " and more" for t in good[:20]]
    bad = [" ".join(w.upper() + "!!" for w in prose(60).split()) for _ in range(60)]
    texts = [*good, *good[:30], *edited, *bad]
    rows = [(i, t, "en", "s%d" % (0 if i % 3 else i % 7), len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 210), 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(160))
    upper = collections.Counter(r["doc_id"] for r in out)
    assert 1 <= min(upper.values()) <= max(upper.values()) <= 2
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
               and r["n_tokens"] == len(r["ids"]) for r in out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_queries_are_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and callable(corpus_pipeline.run)
