"""Exact, near and substring deduplication against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from edgemeter.llm import components, exact_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(text):
    return (text or "").encode().split()


def corpus(seed=1):
    """Copies, edited copies, shared passages, runs, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "the", "of"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = prose(120), prose(50)
    texts = [" ".join(base)] * 9
    for _ in range(40):
        edited = list(base)
        for _ in range(rng.randint(0, 9)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    texts += [" ".join(prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60))) for _ in range(8)]
    texts += [" ".join(passage[:34]), " ".join(passage[:35]), "se " * 80, "se " * 36, "se " * 35, "a b " * 40]
    texts += [" ".join(prose(n)) for n in (1, 2, 3, 34, 35, 36, 9000)]
    texts += [None, "", " \t\n", "One  Two\tthree", "one two three", "One Two three", "x", "X"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, None, "s", None) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_exact_duplicates(docs, rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[SPACE.sub(" ", row[1] or "")].append(row[0])
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for body, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (
                min(ids), len(ids), i == min(ids), hashlib.sha256(body.encode()).hexdigest())


def test_exact_duplicates_hot_text(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = exact_dedup.exact_duplicates(frame)
    assert found.filter("group_size = 2000 and keep_id = 1").count() == 2000
    assert found.filter("kept").count() == 1001


def test_exact_duplicates_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b"), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_duplicates(frame)
    assert found.filter("kept").count() == 3
    kept = exact_dedup.drop_exact_duplicates(frame.withColumn("_row", F.lit(7)))
    assert kept.columns == ["doc_id", "text", "_row"]
    assert sorted(kept.collect(), key=str) == sorted([(5, "a", 7), (None, "b", 7), (1, None, 7)], key=str)


def shingle_sets(rows, k):
    sets = {}
    for row in rows:
        w = (row[1] or "").encode().translate(LOWER).split()
        sets[row[0]] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return sets


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    sets = shingle_sets(rows, k)
    wanted = brute_components(sets, percent)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, k, percent).collect()}
    assert {i: (len(sets[i]), wanted[i], wanted[i] == i) for i in sets} == {
        i: tuple(r)[1:] for i, r in got.items()}


def test_near_duplicates_compares_across_components(spark, monkeypatch):
    """Edits of growing weight: most members of a star are no copies of its centre."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(near_dedup, "SLOT_PAIRS", 4)
    rng = random.Random(5)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(150), rng.randint(0, 14)):
            text[at] = "x%d" % rng.randrange(40)
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = brute_components(shingle_sets(rows, 3), 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, 3, 85).collect()}
    assert got == wanted


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "A B c  d"), (5, None), (6, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(frame, 3, 85).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False),
                          (5, 0, 5, True), (6, 0, 6, True)], key=str)
    kept = near_dedup.drop_near_duplicates(frame.withColumn("_gone", F.lit("x")), 3, 85)
    assert kept.columns == ["doc_id", "text", "_gone"] and kept.count() == 5


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_repeats(rows, size):
    texts = [words(r[1]) for r in rows]
    seen = collections.Counter(
        tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = {}
    for row, w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out[row[0]] = (len(w), sum(gone), kept)
    return out


@pytest.mark.parametrize("size", [35, 7, 2])
def test_remove_repeats(docs, rows, size):
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, size).collect()}
    assert got == brute_repeats(rows, size)


@pytest.mark.parametrize("seed", range(3))
def test_remove_repeats_of_periodic_texts(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        text = unit * rng.randint(1, 20) + [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame, 12).collect()}
    assert got == brute_repeats(rows, 12)


def test_remove_repeats_settles_small_batches(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_ROWS", 50)
    rows = corpus(3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame, 35).collect()}
    assert got == brute_repeats(rows, 35)


def test_remove_repeats_odd_rows(spark):
    text = " ".join(map(str, range(40)))
    rows = [(None, text), (1, text[:100]), (2, "x " + text), (2, "x " + text), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1))
    got = sorted(tuple(r)[1:] for r in substring_dedup.remove_repeats(frame, 30).collect())
    assert [n for _, n, _ in got] == [0, 37, 40, 41, 41]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def thue_morse(n, zero, one):
    """Words whose polynomial fingerprints modulo 2^64 agree for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [zero if b else one for b in bits], [one if b else zero for b in bits]


def test_constructed_collisions_remove_and_link_nothing(spark):
    left, right = ("".join(x) for x in thue_morse(1024, "a", "b"))
    head = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{head} {left}", None, None, None), (2, f"{head} {right}", None, None, None)], SCHEMA)
    got = substring_dedup.remove_repeats(docs).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    texts = [f"{left} x y", f"{right} x y", *(" ".join(x) for x in thue_morse(2048, "no", "yes"))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs.filter("doc_id < 2"), 3, 85).collect()}
    assert all(r["kept"] and r["component_id"] == i for i, r in got.items())
    long = [" ".join(x) for x in thue_morse(2048, "no", "yes")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(long)], SCHEMA)
    got = substring_dedup.remove_repeats(docs, size=1500).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
