"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgemeter.llm import (
    bpe,
    conversations,
    exact_dedup,
    licenses,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    quality,
    secret_scan,
    substring_dedup,
    token_count,
    topk,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.count_tokens(_documents(spark, sf_dir), path, limit=1024)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, query_every=50)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), k=3, percent=85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proven = merkle.manifest(
        _documents(spark, sf_dir), columns, group="lang", order="doc_id",
        also={"tampered": F.when(chosen, merkle.leaf_hash(tampered))},
    ).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return proven.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.proof_text(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(_documents(spark, sf_dir), min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_all(rows, conversations.damage(rows)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2("repaired", 256).alias("repaired_sha256"),
    )


QUERIES = {
    name: run for name, run in list(globals().items()) if name.startswith("op") and callable(run)
}

SQL = {
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
                  FROM documents)),
        g AS (
            SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead AS n FROM w
            WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
        r AS (
            SELECT doc_id, i, 1 AS twice
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g WHERE n = 35) x WHERE c > 1),
        f AS (
            SELECT doc_id, i, word, coalesce(max(twice) OVER (
                PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
            FROM w LEFT JOIN r USING (doc_id, i))
        SELECT doc_id, count(i) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
        FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 1, 2)),
                   lambda i: array_to_string(words[i:i + 2], ' '))) AS shingle
            FROM w WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_in AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM both_in JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
            WHERE 100 * c >= 85 * (p.n + q.n - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, y FROM reach r JOIN ways ON x = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)""",
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 5""",
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])),
                    lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) % 7 = 0 AS chosen
            FROM documents),
        h AS (
            SELECT doc_id, lang, chosen,
                   coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                   || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
            FROM d),
        leaves AS (
            SELECT doc_id, lang,
                   sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN chosen THEN sha256(
                       head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail)
                   END AS changed
            FROM h),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
        trees AS (
            SELECT lang, 0 AS lev, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
            UNION ALL
            SELECT lang, lev + 1, list_transform(range(0, len(nodes), 2),
                   lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
            FROM trees WHERE len(nodes) > 1),
        subroots AS (
            SELECT lang, lev AS height, nodes[1] AS subroot,
                   row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1),
        tops AS (
            SELECT 0 AS lev, list(subroot ORDER BY place) AS nodes FROM subroots
            UNION ALL
            SELECT lev + 1, list_transform(range(0, len(nodes), 2),
                   lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
            FROM tops WHERE len(nodes) > 1),
        root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1),
        steps AS (
            SELECT p.lang, p.pos, t.lev, (p.pos >> t.lev) & 1 AS slot,
                   coalesce(t.nodes[xor(p.pos >> t.lev, 1) + 1], '') AS sibling
            FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang AND len(t.nodes) > 1
            UNION ALL
            SELECT p.lang, p.pos, s.height + t.lev, (s.place >> t.lev) & 1,
                   coalesce(t.nodes[xor(s.place >> t.lev, 1) + 1], '')
            FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON len(t.nodes) > 1),
        proofs AS (
            SELECT lang, pos, list({'slot': slot, 'sibling': sibling} ORDER BY lev) AS steps,
                   sha256(string_agg(sibling, '' ORDER BY lev)) AS proof_sha256
            FROM steps GROUP BY lang, pos),
        folded AS (
            SELECT lang, pos, 0 AS lev, coalesce(changed, leaf) AS node FROM placed
            UNION ALL
            SELECT f.lang, f.pos, lev + 1,
                   sha256(CASE WHEN steps[lev + 1].slot = 1 THEN steps[lev + 1].sibling || node
                               ELSE node || steps[lev + 1].sibling END)
            FROM folded f JOIN proofs p ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos AND lev < len(steps))
        SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
               f.node AS folded_root, f.node = root.root AS verified
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN root ON true
        LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
        JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.lev = coalesce(len(q.steps), 0)""",
    "op12_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])),
                    lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS fault
            FROM conversations),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                        ELSE text END AS text,
                   unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM src WHERE fault <> 0),
        r AS (
            SELECT *, row_number() OVER (
                       PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   left(role, 1) AS initial,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
        f AS (
            SELECT *, CASE WHEN body = '' THEN 'b'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                           WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS kind,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM r),
        puts(state, mark, price, after) AS (
            VALUES (0, '', 0, 0), (0, 'I', 3, 2), (0, 'II', 6, 3), (1, '', 0, 1), (1, 'I', 3, 2), (1, 'II', 6, 3),
                   (2, '', 0, 2), (2, 'I', 3, 3), (2, 'II', 6, 2), (3, '', 0, 3), (3, 'I', 3, 2), (3, 'II', 6, 3)),
        keeps(state, initial, after) AS (
            VALUES (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, 's', 1)),
        edits AS (
            SELECT p.state, f.conv_id, f.i, min({'cost': p.price + e.price, 'audit': p.mark || e.mark}) AS best, e.after
            FROM f, puts p, LATERAL (
                SELECT 'D' AS mark, 4 AS price, p.after AS after
                UNION ALL
                SELECT 'K', CASE WHEN f.kind = 't' THEN 3 ELSE 0 END, k.after FROM keeps k
                WHERE f.kind NOT IN ('b', 'd') AND k.state = p.after AND k.initial = f.initial
                UNION ALL
                SELECT 'R', CASE WHEN f.kind = 't' THEN 6 ELSE 3 END, CASE WHEN p.after = 2 THEN 3 ELSE 2 END
                WHERE f.kind NOT IN ('b', 'd')) e
            GROUP BY p.state, f.conv_id, f.i, e.after),
        ways AS (
            SELECT DISTINCT conv_id, 0 AS i, 0 AS state, 0 AS cost, '' AS audit FROM f
            UNION ALL
            SELECT conv_id, i, state, best.cost, best.audit
            FROM (SELECT w.conv_id, e.i, e.after AS state,
                         min({'cost': w.cost + e.best.cost, 'audit': w.audit || e.best.audit}) AS best
                  FROM ways w JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1
                       AND e.state = w.state
                  GROUP BY w.conv_id, e.i, e.after) x),
        sizes AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id),
        done AS (
            SELECT w.conv_id, min({'cost': w.cost + p.price, 'audit': w.audit || p.mark}) AS best
            FROM ways w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
            JOIN puts p ON p.state = w.state AND p.after IN (0, 3)
            GROUP BY w.conv_id),
        marks AS (
            SELECT conv_id, unnest(string_split(best.audit, '')) AS mark,
                   generate_subscripts(string_split(best.audit, ''), 1) AS spot FROM done),
        walk AS (
            SELECT *, count(*) FILTER (WHERE mark <> 'I') OVER w AS i, count(*) FILTER (WHERE mark <> 'D') OVER w AS nth
            FROM marks WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
        kept AS (
            SELECT w.conv_id, w.spot, w.mark, w.nth, CASE WHEN mark = 'I' THEN '' ELSE f.text END AS text, f.role,
                   coalesce(first(CASE WHEN mark = 'K' AND f.initial = 's' THEN 1 ELSE 0 END)
                       OVER (PARTITION BY w.conv_id ORDER BY w.spot), 0) AS system
            FROM walk w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
            WHERE mark <> 'D'),
        lines AS (
            SELECT conv_id, string_agg(CASE WHEN mark = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user'
                       ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot) AS repaired
            FROM kept GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'd') AS duplicate,
                   count(*) FILTER (WHERE kind = 't') AS truncated,
                   count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(done.best.cost, 0) AS BIGINT) AS cost,
               coalesce(done.best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
