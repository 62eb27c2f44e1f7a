"""Merkle manifest, line deduplication and conversation repair against brute force."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgemeter.llm import conversations, line_dedup, merkle, minimal_hash, ordering

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def leaf_of(row):
    values = [row[0], row[3], row[2], row[4], row[1]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs(nodes, k):
    """(top, for each node its list of (left, right))."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            first = at - at % k
            run = nodes[first : first + k]
            paths[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            where[i] = at // k
        nodes = [sha("".join(nodes[i : i + k])) for i in range(0, len(nodes), k)]
    return nodes[0], paths


def merkle_rows(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"text É {i}" * rng.randint(0, 4), rng.choice(["de", "en", "en", "en", None, "é"]),
             rng.choice([None, "web"]), rng.choice([None, i])) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "x", "en", "s", 1), (5, "again", "en", "s", 2),
             (7, "", "zz", "", 0), (8, "same", "de", "s", 9), (8, "same", "de", "s", 9)]
    return rows


@pytest.mark.parametrize("fan_out, block", [(2, 256), (2, 4), (3, 9), (5, 5)])
def test_manifest_matches_brute_force(spark, monkeypatch, fan_out, block):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    rows = merkle_rows(70)
    # Extra columns with names that the operator uses itself.
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "pos", "n", "node", "at")})
    got = merkle.manifest(docs.repartition(3), COLUMNS, "lang", "doc_id", fan_out).collect()
    trees = collections.defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    expected, subroots = [], []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(trees[lang], key=lambda x: x[:3])
        top, paths = proofs([x[2] for x in own], fan_out)
        subroots.append(top)
        expected.append((lang, own, paths))
    root, last = proofs(subroots, fan_out)
    want = sorted(
        (str(x[3][0]), str(lang), x[2], top, root, path + end)
        for (lang, own, paths), top, end in zip(expected, subroots, last, strict=True)
        for x, path in zip(own, paths, strict=True))
    assert want == sorted(
        (str(r["doc_id"]), str(r["lang"]), r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]])
        for r in got)


def test_manifest_folds_to_the_root_and_shows_tampering(spark):
    docs = spark.createDataFrame(merkle_rows(40), DOCS)
    rows = merkle.manifest(docs, COLUMNS, "lang", "doc_id", also={"other": F.lit("0" * 64)}).select(
        "root", merkle.fold(F.col("leaf"), F.col("steps")).alias("good"),
        merkle.fold(F.col("other"), F.col("steps")).alias("bad")).collect()
    assert len(rows) == 46 and all(r["good"] == r["root"] != r["bad"] for r in rows)


def test_manifest_of_one_and_of_no_row(spark):
    one = spark.createDataFrame([(1, "a", "en", None, None)], DOCS)
    row = merkle.manifest(one, COLUMNS, "lang", "doc_id").collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == []
    assert merkle.manifest(one.limit(0), COLUMNS, "lang", "doc_id").collect() == []


def test_positions_in_one_group_and_many(spark):
    rows = [("a", i % 7, i) for i in range(500)] + [("b", None, 1), ("c", 3, 3), ("c", 3, 3)]
    got = ordering.positions(
        spark.createDataFrame(rows, "g string, x int, y int").repartition(4), "g", ["x", "y"], "places").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["g"]].append((r["pos"], r["x"], r["y"], r["n"], r["at"]))
    for g, own in by.items():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and {x[3] for x in own} == {len(own)}
        assert [x[1:3] for x in own] == sorted((x[1:3] for x in own), key=str) if g == "b" else sorted(
            x[1:3] for x in own)
        assert [x[4] for x in own] == sorted(x[4] for x in own)


# Line deduplication


def test_minimal_hash_numbers_every_key_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 40000):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        f, count = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 70000, n)
        index = minimal_hash.Index(minimal_hash.build(h, f, count))
        assert sorted(index.number(h).tolist()) == list(range(n))
        assert index.count(h, f).tolist() == count.tolist()
        other = rng.integers(0, 2**63, 5000).astype(np.uint64)
        assert not index.count(other, other).any()
        if n:
            assert not index.count(h, f + np.uint64(1)).any()


def test_minimal_hash_keeps_keys_that_agree_in_their_first_half():
    h = np.array([7, 7, 7, 9], np.uint64)
    f = np.array([1, 2, 3, 1], np.uint64)
    index = minimal_hash.Index(minimal_hash.build(h, f, np.array([5, 6, 700, 1 << 40])))
    assert index.count(h, f).tolist() == [5, 6, 700, 1 << 40]
    assert index.count(np.array([7, 9], np.uint64), np.array([4, 2], np.uint64)).tolist() == [0, 0]


def lines_corpus():
    rng = random.Random(5)
    pool = [f"Line {i} É" for i in range(60)] + ["", " ", "\t\x0b", "  header  ", "HEADER", "é", "É"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    texts += [None, "", "\n", "\n\n", "no line feed", "header\r\nx\r\n", "a \nheader ",
              "\n".join(f"unique {i}" for i in range(5000)), "twice in one\n" * 12]
    return [(i if i % 9 else None, t, None, None, None) for i, t in enumerate(texts)] + [(2, texts[2], None, None, None)] * 2


def drop_lines(rows, min_docs, min_chars):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [[(x, x.strip(strip).translate(lower)) for x in (r[1] or "").split("\n")] for r in rows]
    n = collections.Counter(k for own in keyed for k in {k for _, k in own if len(k) >= min_chars})
    out = []
    for r, own in zip(rows, keyed, strict=True):
        kept = [x for x, k in own if n[k] < min_docs]
        out.append((str(r[0]), len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 1), (12, 8), (1, 0)])
def test_common_lines_match_brute_force(spark, monkeypatch, min_docs, min_chars):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 300)
    rows = lines_corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("c") for c in ("row", "block", "dropped", "keys")})
    got = line_dedup.drop_common_lines(docs.repartition(5), min_docs, min_chars).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == drop_lines(
        rows, min_docs, min_chars)


def test_common_lines_of_an_empty_table_and_without_common_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb", None, None, None), (2, None, None, None, None)], DOCS)
    assert line_dedup.drop_common_lines(docs.limit(0)).collect() == []
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.drop_common_lines(docs).collect()}
    assert got == {1: (2, 0, "a\nb"), 2: (1, 0, "")}


# Conversation repair


def cheapest(rows):
    """(cost, audit, lines) by Dijkstra over (cost, audit) without any bound or segment."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        turn, full = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, turn, (*out, full + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        if role and state + role[0] in ("s", "u", "su", "au", "ua"):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, turn, (*out, f"{full}:{text}")))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected_repairs(rows):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        marked = faults([x[1:] for x in own])
        n = collections.Counter(x[2] for x in marked)
        initials = [x[1][:1] for x in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"],
                     n["truncated"], illegal, cost, audit, "\n".join(lines))
    return out


def talk(seed, n_conv, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] if turn % 2 else ["user", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "no", "Why? \n", " ", "", f"t {turn}!", f"t {turn}", None])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 1, None]), rng.choice([role, role, role, None]), text))
    return rows


@pytest.mark.parametrize("segment, longest", [(64, 9), (3, 14), (1, 8), (64, 150)])
def test_repairs_match_dijkstra(spark, monkeypatch, segment, longest):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = talk(segment, 40 if longest < 100 else 5, longest)
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("conv", "pos", "n", "seg", "at")})
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(table.repartition(3)).collect()}
    assert got == expected_repairs(rows)


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t}. Of {c}! Is it?") for c in range(150) for t in range(2)]
    rows += [(None, 3, "user", "Null id."), (900, None, "user", None), (901, 1, None, "x.")]
    hurt = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role,
               "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        hurt += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = conversations.damage(table)
    assert sorted(map(str, damaged.collect())) == sorted(
        map(str, spark.createDataFrame(hurt, table.schema).collect()))
    # Only a few conversations lose both rows: drop one whole on top.
    left = damaged.filter("conv_id is null or conv_id <> 7")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_all(table, left).collect()}
    want = expected_repairs([r for r in hurt if r[0] != 7])
    nothing = (0, 0, 0, 0, 0, 0, "", "")
    assert got == {r[0]: want.get(r[0], nothing) for r in rows} and got[7] == nothing
    assert conversations.repair_all(table.limit(0), damaged.limit(0)).collect() == []
