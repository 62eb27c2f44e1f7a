"""Registered queries of association kernels and inferred networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgemeter.functions.columns import r6
from edgemeter.functions.treekernels import PRIME, factor
from edgemeter.operators import association, networks, trees
from edgemeter.plans import benchmark
from edgemeter.plans import evaluation_queries as ev
from edgemeter.plans.catalog import query
from edgemeter.plans.fixtures import (
    EMBEDDING_SQL,
    embedding_expression,
    fixture,
    with_fixtures,
)
from edgemeter.schema import CELL_KEYS, KEYS, PAIR

C = "dataset_id, run_id"
X, T, M = "fx_expression", "fx_pseudotime", "fx_matrix"


def dense_sql(source: str) -> dict[str, str]:
    """src: sparse rows; d: every gene in every cell; p: gene pairs by cell."""
    return {
        "src": source,
        "d": "SELECT g.dataset_id, g.run_id, g.gene, c.cell, COALESCE(x.value, 0) AS v FROM (SELECT DISTINCT dataset_id, run_id, gene FROM src) g JOIN (SELECT DISTINCT dataset_id, run_id, cell FROM src) c USING (dataset_id, run_id) LEFT JOIN src x ON x.dataset_id = g.dataset_id AND x.run_id = g.run_id AND x.gene = g.gene AND x.cell = c.cell",
        "p": "SELECT a.dataset_id, a.run_id, a.gene AS gene1, b.gene AS gene2, a.cell, a.v AS x, b.v AS y FROM d a JOIN d b ON a.dataset_id = b.dataset_id AND a.run_id = b.run_id AND a.cell = b.cell AND a.gene < b.gene",
    }


SPARSE = dense_sql(f"SELECT * FROM {X}")
EMB = dense_sql(EMBEDDING_SQL)
CORR = f"SELECT {C}, gene1, gene2, CASE WHEN STDDEV_POP(x) > 0 AND STDDEV_POP(y) > 0 THEN CORR(x, y) END AS weight FROM p GROUP BY {C}, gene1, gene2"
OUT = f"SELECT {C}, gene1, gene2, ROUND(weight, 6) + 0.0 AS weight FROM k"


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


def _expr(spark, sf):
    return fixture(spark, sf, X)


@query("pearson_network", with_fixtures([X], {**SPARSE, "k": CORR},
       f"{OUT} WHERE weight IS NOT NULL UNION ALL SELECT {C}, gene2, gene1, ROUND(weight, 6) + 0.0 FROM k WHERE weight IS NOT NULL"))
def pearson_network(spark, sf):
    return rounded(association.pearson_network(_expr(spark, sf)), "weight")


@query("pearson_network_negative_max", with_fixtures([], {
       **dense_sql(f"SELECT dataset_id, run_id, gene, cell, CASE WHEN gene LIKE '%3' THEN value - 10 ELSE value END AS value FROM ({EMBEDDING_SQL}) e"),
       "k0": f"SELECT {C}, gene1, gene2, CORR(x, y) * CASE WHEN MAX(x) < 0 THEN -1 ELSE 1 END * CASE WHEN MAX(y) < 0 THEN -1 ELSE 1 END AS weight FROM p GROUP BY {C}, gene1, gene2",
       "k": f"SELECT {C}, gene1, gene2, weight FROM k0 UNION ALL SELECT {C}, gene2, gene1, weight FROM k0"}, OUT))
def pearson_negative_max(spark, sf):
    shifted = embedding_expression(spark, sf).withColumn(
        "value", F.when(F.col("gene").endswith("3"), F.col("value") - 10).otherwise(F.col("value"))
    )
    return rounded(association.pearson_network(shifted), "weight")


@query("kernel_dotprod", with_fixtures([X], {**SPARSE, "k": f"SELECT {C}, gene1, gene2, SUM(x * y) AS weight FROM p GROUP BY {C}, gene1, gene2"}, OUT))
def kernel_dotprod(spark, sf):
    return rounded(association.assoc(_expr(spark, sf), "dotprod"), "weight")


@query("kernel_correlation", with_fixtures([], {**EMB, "k": CORR}, OUT))
def kernel_correlation(spark, sf):
    return rounded(association.assoc(embedding_expression(spark, sf), "correlation"), "weight")


PROP = {
    "l": "SELECT dataset_id, run_id, gene, cell, LN(CASE WHEN v = 0 THEN (SELECT MIN(value) FROM src WHERE value > 0) ELSE v END) AS y FROM d",
    "z": f"SELECT *, y - AVG(y) OVER (PARTITION BY {C}, cell) AS c FROM l",
    "pz": "SELECT a.dataset_id, a.run_id, a.gene AS gene1, b.gene AS gene2, a.c AS x, b.c AS y FROM z a JOIN z b ON a.dataset_id = b.dataset_id AND a.run_id = b.run_id AND a.cell = b.cell AND a.gene < b.gene",
    "k": f"SELECT {C}, gene1, gene2, 2 * COVAR_SAMP(x, y) / (VAR_SAMP(x) + VAR_SAMP(y)) AS weight FROM pz GROUP BY {C}, gene1, gene2",
}


@query("kernel_proprho", with_fixtures([X], {**SPARSE, **PROP}, OUT))
def kernel_proprho(spark, sf):
    return rounded(association.assoc(_expr(spark, sf), "proprho"), "weight")


ZIK = {
    "shape": f"""SELECT {C}, gene1, gene2, COUNT(*) AS n, CAST(SUM(CASE WHEN x<>0 AND y<>0 THEN 1 ELSE 0 END) AS DOUBLE) AS n11, CAST(SUM(CASE WHEN x<>0 AND y=0 THEN 1 ELSE 0 END) AS DOUBLE) AS n10,
      CAST(SUM(CASE WHEN x=0 AND y<>0 THEN 1 ELSE 0 END) AS DOUBLE) AS n01, CAST(SUM(CASE WHEN x=0 AND y=0 THEN 1 ELSE 0 END) AS DOUBLE) AS n00 FROM p GROUP BY {C}, gene1, gene2""",
    "both_on": "SELECT * FROM p WHERE x <> 0 AND y <> 0",
    "tau": f"""SELECT a.dataset_id, a.run_id, a.gene1, a.gene2, CAST(SUM(SIGN(a.x-b.x)*SIGN(a.y-b.y)) AS DOUBLE) AS s, CAST(SUM(CASE WHEN a.x<>b.x THEN 1 ELSE 0 END) AS DOUBLE) AS dx, CAST(SUM(CASE WHEN a.y<>b.y THEN 1 ELSE 0 END) AS DOUBLE) AS dy
      FROM both_on a JOIN both_on b ON a.dataset_id=b.dataset_id AND a.run_id=b.run_id AND a.gene1=b.gene1 AND a.gene2=b.gene2 AND a.cell<b.cell GROUP BY a.dataset_id, a.run_id, a.gene1, a.gene2""",
    "ex1": f"SELECT a.gene1, a.gene2, CAST(SUM(CASE WHEN a.x > b.x THEN 1 ELSE 0 END) AS DOUBLE) AS e FROM p a JOIN both_on b ON a.gene1=b.gene1 AND a.gene2=b.gene2 WHERE a.x<>0 AND a.y=0 GROUP BY a.gene1, a.gene2",
    "ex2": f"SELECT a.gene1, a.gene2, CAST(SUM(CASE WHEN a.y > b.y THEN 1 ELSE 0 END) AS DOUBLE) AS e FROM p a JOIN both_on b ON a.gene1=b.gene1 AND a.gene2=b.gene2 WHERE a.y<>0 AND a.x=0 GROUP BY a.gene1, a.gene2",
    "j": """SELECT s.*, COALESCE(t.s / NULLIF(SQRT(t.dx * t.dy), 0), 0) AS tau,
      CASE WHEN n11 = 0 THEN 1 WHEN n10 = 0 THEN 0 ELSE e1.e / (n11 * n10) END AS pa, CASE WHEN n11 = 0 THEN 1 WHEN n01 = 0 THEN 0 ELSE e2.e / (n11 * n01) END AS pb
      FROM shape s LEFT JOIN tau t ON t.gene1=s.gene1 AND t.gene2=s.gene2 LEFT JOIN ex1 e1 ON e1.gene1=s.gene1 AND e1.gene2=s.gene2 LEFT JOIN ex2 e2 ON e2.gene1=s.gene1 AND e2.gene2=s.gene2""",
    "k": f"SELECT {C}, gene1, gene2, n11*n11/n/n*tau + 2*(n00*n11 - n01*n10)/n/n + 2*n11/n*(n10/n*(1-2*pa) + n01/n*(1-2*pb)) AS weight FROM j",
}


@query("kernel_zikendall", with_fixtures([X], {**SPARSE, **ZIK}, OUT))
def kernel_zikendall(spark, sf):
    return rounded(association.assoc(_expr(spark, sf), "zikendall"), "weight")


@query("drop_silent", with_fixtures([X], body=f"SELECT {C}, gene, cell, ROUND(value, 6) + 0.0 AS value FROM {X}"))
def drop_silent(spark, sf):
    rows = _expr(spark, sf)
    silent = rows.withColumn("gene", F.concat(F.lit("off_"), "gene")).withColumn("value", F.lit(0.0))
    return rounded(association.drop_silent(rows.unionByName(silent)), "value").select(*CELL_KEYS, "gene", "cell", "value")


DOT = f"SELECT {C}, gene1, gene2, SUM(x * y) AS weight FROM p GROUP BY {C}, gene1, gene2"


@query("symmetric_edges", with_fixtures([], {**EMB, "k0": DOT,
       "k1": "SELECT dataset_id, run_id, gene1, gene2, weight / (SELECT MAX(ABS(weight)) FROM k0) AS weight FROM k0 WHERE weight <> 0",
       "k": f"SELECT {C}, gene1, gene2, weight FROM k1 UNION ALL SELECT {C}, gene2, gene1, weight FROM k1"}, OUT))
def symmetric_edges(spark, sf):
    upper = association.assoc(embedding_expression(spark, sf), "dotprod")
    return rounded(association.symmetric_edges(upper), "weight")


def _gated(spark, sf):
    upper = association.assoc(_expr(spark, sf), "correlation")
    return upper.withColumn("weight", F.when(F.abs("weight") > 0.1, F.col("weight")).otherwise(0.0))


@query("edge_density", with_fixtures([X], {**SPARSE, "k": CORR},
       f"SELECT {C}, ROUND(CAST(SUM(CASE WHEN ABS(weight) > 0.1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) + 0.0 AS density FROM k GROUP BY {C}"))
def edge_density(spark, sf):
    return rounded(association.edge_density(_gated(spark, sf), _expr(spark, sf)), "density")


CLR = {
    "k0": CORR, "k1": f"SELECT {C}, gene1, gene2, ABS(weight) AS w FROM k0 UNION ALL SELECT {C}, gene2, gene1, ABS(weight) FROM k0",
    "zz": f"SELECT *, GREATEST(0, (w - AVG(w) OVER a) / STDDEV_SAMP(w) OVER a) AS z1, GREATEST(0, (w - AVG(w) OVER b) / STDDEV_SAMP(w) OVER b) AS z2 FROM k1 WINDOW a AS (PARTITION BY {C}, gene1), b AS (PARTITION BY {C}, gene2)",
    "k": f"SELECT {C}, gene1, gene2, SQRT(z1 * z1 + z2 * z2) AS weight FROM zz",
}


@query("clr", with_fixtures([X], {**SPARSE, **CLR}, OUT))
def clr(spark, sf):
    edges = association.pearson_network(_expr(spark, sf)).withColumn("weight", F.abs("weight"))
    return rounded(association.clr(edges), "weight")


# Whole hundredths, so that products are exact and ties are real.
WHOLE = dense_sql(f"SELECT dataset_id, run_id, gene, cell, ROUND(value * 100) AS value FROM {X}")


@query("rank_edges", with_fixtures([X], {**WHOLE, "k0": DOT, "k": f"SELECT {C}, gene1, gene2, weight FROM k0 UNION ALL SELECT {C}, gene2, gene1, weight FROM k0"},
       f"""SELECT {C}, 'dotprod' AS algorithm_id, ROW_NUMBER() OVER (PARTITION BY {C} ORDER BY ABS(weight) DESC, ('0x'||substr(md5(gene1||'|'||gene2), 1, 15))::BIGINT) - 1 AS ord,
       gene1, gene2, weight FROM k"""))
def rank_edges(spark, sf):
    whole = _expr(spark, sf).withColumn("value", F.round(F.col("value") * 100))
    upper = association.assoc(whole, "dotprod")
    return association.rank_edges(association.both_directions(upper), "dotprod")


# ---- surrogates ---------------------------------------------------------------

SHUFFLED = {
    "reps": "SELECT 0 AS rep UNION ALL SELECT 1 UNION ALL SELECT 2",
    "slots": "SELECT r.rep, c.cell, g.gene, ROW_NUMBER() OVER (PARTITION BY r.rep, c.cell ORDER BY md5('5|'||CAST(r.rep AS VARCHAR)||'|'||c.cell||'|'||g.gene), g.gene) AS slot FROM reps r CROSS JOIN (SELECT DISTINCT cell FROM src) c CROSS JOIN (SELECT DISTINCT gene FROM src) g",
    "vals": "SELECT cell, value, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY gene) AS slot FROM src WHERE value <> 0",
    "sd": "SELECT rep, s.cell, gene, COALESCE(value, 0) AS v FROM slots s LEFT JOIN vals v ON v.cell = s.cell AND v.slot = s.slot",
    "sp": "SELECT a.rep, a.gene AS gene1, b.gene AS gene2, CASE WHEN STDDEV_POP(a.v) > 0 AND STDDEV_POP(b.v) > 0 THEN CORR(a.v, b.v) END AS w FROM sd a JOIN sd b ON a.rep = b.rep AND a.cell = b.cell AND a.gene < b.gene GROUP BY a.rep, a.gene, b.gene",
}


@query("surrogate_associations", with_fixtures([X], {"src": f"SELECT * FROM {X}", **SHUFFLED},
       "SELECT 'ev' AS dataset_id, 'r1' AS run_id, rep AS replicate, gene1, gene2, ROUND(w, 6) + 0.0 AS weight FROM sp"))
def surrogate_associations(spark, sf):
    return rounded(association.surrogate_associations(_expr(spark, sf), "correlation", 3, seed=5), "weight")


@query("surrogate_thresholds", with_fixtures([X], {"src": f"SELECT * FROM {X}", **SHUFFLED,
       "q": "SELECT rep, QUANTILE_CONT(w, 0.05) AS a0, QUANTILE_CONT(w, 0.1) AS a1, QUANTILE_CONT(w, 0.95) AS b0, QUANTILE_CONT(w, 0.9) AS b1 FROM sp GROUP BY rep"},
       """SELECT 'ev' AS dataset_id, 'r1' AS run_id, 0 AS place, ROUND(MEDIAN(a0), 6) + 0.0 AS neg_threshold, ROUND(MEDIAN(b0), 6) + 0.0 AS pos_threshold FROM q
       UNION ALL SELECT 'ev', 'r1', 1, ROUND(MEDIAN(a1), 6) + 0.0, ROUND(MEDIAN(b1), 6) + 0.0 FROM q"""))
def surrogate_thresholds(spark, sf):
    out = association.surrogate_thresholds(_expr(spark, sf), "correlation", 3, [5, 10], [95, 90], seed=5)
    return rounded(out, "neg_threshold", "pos_threshold")


# ---- networks -----------------------------------------------------------------


# One elimination step per level on the rank correlations with the identity beside
# them; p-values from the finite sums for whole degrees of freedom.
PARTIAL = f"""WITH RECURSIVE e AS ({EMBEDDING_SQL}),
r AS (SELECT gene, cell, RANK() OVER (PARTITION BY gene ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM e),
g AS (SELECT gene, ROW_NUMBER() OVER (ORDER BY gene) AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT gene FROM e) d),
c AS (SELECT a.gene AS g1, b.gene AS g2, CORR(a.r, b.r) AS v FROM r a JOIN r b ON a.cell = b.cell GROUP BY a.gene, b.gene),
one AS (SELECT x.i, list(c.v ORDER BY y.i) || list(CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END ORDER BY y.i) AS v
  FROM c JOIN g x ON x.gene = c.g1 JOIN g y ON y.gene = c.g2 GROUP BY x.i),
s(k, m) AS (SELECT CAST(0 AS BIGINT), list(v ORDER BY i) FROM one
  UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / row[k + 1])
    ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM s WHERE k < len(m)),
w AS (SELECT a.gene AS gene1, b.gene AS gene2, a.i = b.i AS own, (SELECT COUNT(DISTINCT cell) FROM e) - a.n AS df,
    CASE WHEN a.i = b.i THEN 1.0 ELSE -m[a.i][a.n + b.i] / SQRT(m[a.i][a.n + a.i] * m[b.i][a.n + b.i]) END AS weight
  FROM s JOIN g a ON s.k = a.n JOIN g b ON TRUE),
p AS (SELECT *, CASE WHEN own THEN 0.0 WHEN df % 2 = 0 THEN 1 - ABS(weight) * list_sum(list_transform(range(0, df // 2),
      lambda q: EXP(lgamma(2 * q + 1) - 2 * lgamma(q + 1) - 2 * q * LN(2)) * POW(1 - weight * weight, q)))
    ELSE 1 - 2 / PI() * (ASIN(ABS(weight)) + ABS(weight) * SQRT(1 - weight * weight) * COALESCE(list_sum(list_transform(range(0, (df - 1) // 2),
      lambda q: EXP(2 * q * LN(2) + 2 * lgamma(q + 1) - lgamma(2 * q + 2)) * POW(1 - weight * weight, q))), 0)) END AS p_value FROM w)
"""


@query("partial_spearman", PARTIAL + "SELECT 'emb' AS dataset_id, 'r1' AS run_id, gene1, gene2, ROUND(weight, 6) + 0.0 AS weight, ROUND(p_value, 6) + 0.0 AS p_value FROM p")
def partial_spearman(spark, sf):
    return rounded(networks.partial_spearman(embedding_expression(spark, sf)), "weight", "p_value")


@query("gate_pvalue", PARTIAL + "SELECT 'emb' AS dataset_id, 'r1' AS run_id, gene1, gene2, CASE WHEN p_value <= 0.1 THEN ROUND(weight, 6) + 0.0 ELSE 0.0 END AS weight FROM p")
def gate_pvalue(spark, sf):
    pairs = networks.partial_spearman(embedding_expression(spark, sf))
    return rounded(networks.gate_pvalue(pairs, 0.1), "weight")


# Means far above the spread: the products must not cancel.
FAR = EMBEDDING_SQL.replace("CAST(v AS DOUBLE) AS value", "CAST(v AS DOUBLE) + 1e7 AS value")


@query("correlation_large_means", with_fixtures([], {**dense_sql(FAR), "k": CORR}, OUT.replace("6", "4")))
def correlation_large_means(spark, sf):
    far = embedding_expression(spark, sf).withColumn("value", F.col("value") + 1e7)
    return association.assoc(far, "correlation").withColumn("weight", F.round("weight", 4) + F.lit(0.0))


LAG = {
    "o": f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {C}, trajectory ORDER BY t, cell) - 1 AS ix, COUNT(*) OVER (PARTITION BY {C}, trajectory) AS n FROM {T}",
    "g": f"SELECT DISTINCT e.dataset_id, e.run_id, p.trajectory, e.gene FROM {X} e JOIN {T} p ON p.dataset_id = e.dataset_id AND p.run_id = e.run_id AND p.cell = e.cell",
    "s": f"SELECT o.dataset_id, o.run_id, o.trajectory, g.gene, o.ix, CAST(FLOOR(o.n * 0.33) AS INT) AS ml, o.n, COALESCE(e.value, 0) AS v FROM o JOIN g ON g.trajectory = o.trajectory LEFT JOIN {X} e ON e.gene = g.gene AND e.cell = o.cell",
    "lags": "SELECT CAST(UNNEST(range(0, 1 + (SELECT MAX(ml) FROM s))) AS INT) AS lag",
    "b": "SELECT s.*, l.lag FROM s JOIN lags l ON l.lag <= s.ml AND s.ix >= l.lag AND s.ix < s.n - s.ml + l.lag",
    "r": """SELECT a.dataset_id, a.run_id, a.trajectory, a.gene AS gene1, b.gene AS gene2, b.lag, CASE WHEN STDDEV_POP(a.v) > 0 AND STDDEV_POP(b.v) > 0 THEN CORR(a.v, b.v) END AS r
      FROM s a JOIN b ON a.trajectory = b.trajectory AND b.ix = a.ix + b.lag AND a.ix < a.n - a.ml AND a.gene <> b.gene GROUP BY a.dataset_id, a.run_id, a.trajectory, a.gene, b.gene, b.lag""",
    "best": "SELECT *, ROW_NUMBER() OVER (PARTITION BY trajectory, gene1, gene2 ORDER BY ROUND(ABS(r), 10) DESC, lag) AS rn FROM r WHERE r IS NOT NULL",
}


@query("lagged_network", with_fixtures([X, T], LAG, f"SELECT {C}, trajectory, gene1, gene2, ROUND(r, 6) + 0.0 AS weight, lag FROM best WHERE rn = 1"))
def lagged_network(spark, sf):
    return rounded(networks.lagged_network(_expr(spark, sf), fixture(spark, sf, T), 0.33), "weight")


@query("lagged_network_merged", with_fixtures([X, T], {**LAG, "m": f"SELECT {C}, gene1, gene2, MAX(ABS(r)) AS weight FROM best WHERE rn = 1 GROUP BY {C}, gene1, gene2"},
       f"SELECT {C}, gene1, gene2, ROUND(weight, 6) + 0.0 AS weight FROM m"))
def lagged_network_merged(spark, sf):
    rows = networks.lagged_network(_expr(spark, sf), fixture(spark, sf, T), 0.33)
    return rounded(networks.merge_trajectories(rows, absolute=True), "weight")


MERGE = "SELECT dataset_id, run_id, gene1, gene2, {w} AS weight FROM fx_edges"


def _merge_query(name, w, sql, **options):
    @query(name, with_fixtures(["fx_edges"], {"e": MERGE.format(w=w)}, sql))
    def run(spark, sf):
        rows = fixture(spark, sf, "fx_edges").select(*CELL_KEYS, *PAIR, "weight")
        out = networks.merge_trajectories(rows, **options)
        return out.withColumn("weight", F.col("weight") + F.lit(0.0))


TOP = f"SELECT *, MAX(weight) OVER (PARTITION BY {C}, gene1, gene2) AS m FROM e"
_merge_query("merge_trajectories", "weight", f"SELECT {C}, gene1, gene2, weight + 0.0 AS weight FROM ({TOP}) q WHERE weight = m")
_merge_query("merge_trajectories_abs", "ABS(weight)", f"SELECT {C}, gene1, gene2, weight + 0.0 AS weight FROM ({TOP}) q WHERE weight = m", absolute=True)
_merge_query("merge_trajectories_one_row", "weight", f"SELECT DISTINCT {C}, gene1, gene2, weight + 0.0 AS weight FROM ({TOP}) q WHERE weight = m", one_row=True)


MATRIX = """SELECT 'm' AS dataset_id, 'r1' AS run_id, a.i AS row_ix, b.i AS col_ix, CAST(COALESCE(q.v, 0) AS DOUBLE) AS value
FROM (SELECT n_nationkey AS i FROM nation) a CROSS JOIN (SELECT n_nationkey AS i FROM nation) b
LEFT JOIN (SELECT s_nationkey AS i, c_nationkey AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) % 200 - 100 AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY s_nationkey, c_nationkey) q ON q.i = a.i AND q.j = b.i"""


def _matrix(spark, sf):
    for t in ("nation", "lineitem", "supplier", "orders", "customer"):
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    cells = spark.sql(MATRIX)
    rows = cells.groupBy(*CELL_KEYS, "row_ix").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "value"))), lambda x: x["value"]).alias("values")
    )
    genes = spark.table("nation").select(
        F.lit("m").alias("dataset_id"), F.lit("r1").alias("run_id"),
        F.col("n_nationkey").alias("gene_ix"), F.col("n_name").alias("gene"),
    )
    return rows, genes


NAMED = f"SELECT {C}, a.n_name AS gene1, b.n_name AS gene2, value FROM m JOIN nation a ON a.n_nationkey = row_ix JOIN nation b ON b.n_nationkey = col_ix"


@query("matrix_to_edges", with_fixtures([], {"m": MATRIX, "e": NAMED}, f"SELECT {C}, gene1, gene2, ABS(value) + 0.0 AS weight FROM e"))
def matrix_to_edges(spark, sf):
    return networks.matrix_to_edges(*_matrix(spark, sf)).withColumn("weight", F.col("weight") + F.lit(0.0))


@query("rank_matrix_to_edges", with_fixtures([], {"m": MATRIX, "e": NAMED}, f"SELECT {C}, gene1, gene2, CAST((SELECT COUNT(*) * COUNT(*) FROM nation) AS DOUBLE) - value AS weight FROM e"))
def rank_matrix_to_edges(spark, sf):
    return networks.rank_matrix_to_edges(*_matrix(spark, sf))


def _import_query(layout, names, swap=False):
    first, second = ("gene2", "gene1") if swap else ("gene1", "gene2")

    @query(f"import_edges_{layout}", with_fixtures(["fx_edges"], body=f"SELECT {ev.K}, {first} AS gene1, {second} AS gene2, weight + 0.0 AS weight FROM fx_edges"))
    def run(spark, sf):
        table = fixture(spark, sf, "fx_edges").select(
            *KEYS, *[F.col(c).alias(n) for c, n in zip(("gene1", "gene2", "weight"), names)]
        )
        out = networks.import_edges(table, layout)
        return out.withColumn("weight", F.col("weight") + F.lit(0.0))


_import_query("regulator", ("TF", "target", "importance"))
_import_query("parent", ("Parent", "Child", "Probability"))
_import_query("plain", ("Gene1", "Gene2", "EdgeWeight"))
_import_query("source_second", ("SourceGENES", "TargetGENES", "Interaction"), swap=True)
_import_query("headerless", ("_c0", "_c1", "_c2"))


INFO = {
    "bins": f"SELECT dataset_id, run_id, gene, cell, CASE WHEN v = 0 THEN -1 ELSE CAST(FLOOR((RANK() OVER w + (COUNT(*) OVER (PARTITION BY gene, v) - 1) / 2.0 - 0.5) * 5 / COUNT(*) OVER (PARTITION BY gene, v <> 0)) AS INT) END AS b FROM d WINDOW w AS (PARTITION BY gene, v <> 0 ORDER BY v)",
    "joint": "SELECT x.gene AS ga, x.b AS ba, y.gene AS gb, y.b AS bb, CAST(COUNT(*) AS DOUBLE) AS c FROM bins x JOIN bins y ON x.cell = y.cell AND x.gene <> y.gene GROUP BY x.gene, x.b, y.gene, y.b",
    "single": "SELECT gene AS g, b, CAST(COUNT(*) AS DOUBLE) AS c, CAST((SELECT COUNT(DISTINCT cell) FROM d) AS DOUBLE) AS n FROM bins GROUP BY gene, b",
    "spec": "SELECT ga, ba, gb, SUM(j.c / a.c * LN(j.c * a.n / (a.c * b.c))) AS s, MAX(a.c / a.n) AS p FROM joint j JOIN single a ON a.g = ga AND a.b = ba JOIN single b ON b.g = gb AND b.b = bb GROUP BY ga, ba, gb",
    "mi": "SELECT ga, gb, SUM(p * s) AS mi FROM spec GROUP BY ga, gb",
    "red": "SELECT x.ga, x.gb, SUM(x.p * LEAST(x.s, z.s)) AS red, COUNT(DISTINCT z.gb) AS z FROM spec x JOIN spec z ON x.ga = z.ga AND x.ba = z.ba AND x.gb <> z.gb GROUP BY x.ga, x.gb",
    "uni": "SELECT m.ga, m.gb, m.mi, z * m.mi - red AS u FROM mi m JOIN red r ON r.ga = m.ga AND r.gb = m.gb",
    "puc": "SELECT a.ga, a.gb, a.mi, ROUND(CASE WHEN a.mi > 1e-12 THEN (a.u + b.u) / a.mi ELSE 0 END, 9) AS puc FROM uni a JOIN uni b ON a.ga = b.gb AND a.gb = b.ga",
    "f": "SELECT *, CAST(COUNT(*) OVER (PARTITION BY ga ORDER BY puc) AS DOUBLE) / COUNT(*) OVER (PARTITION BY ga) AS f FROM puc",
}


@query("information_network", with_fixtures([X], {k: v for k, v in {**SPARSE, **INFO}.items() if k != "p"},
       "SELECT 'ev' AS dataset_id, 'r1' AS run_id, x.ga AS gene1, x.gb AS gene2, ROUND(x.mi, 6) + 0.0 AS mi, ROUND(x.puc, 5) + 0.0 AS puc, ROUND(x.f + y.f, 6) + 0.0 AS weight FROM f x JOIN f y ON x.ga = y.gb AND x.gb = y.ga WHERE x.ga < x.gb"))
def information_network(spark, sf):
    out = networks.information_network(_expr(spark, sf), 5)
    return rounded(out, "mi", "weight").withColumn("puc", F.round("puc", 5) + F.lit(0.0))


# ---- tree importance ----------------------------------------------------------


def tree_ctes(n_trees: int, depth: int, bins: int, min_leaf: int, sample: float, share: float | None,
              rate: float, seed: int = 1) -> dict[str, str]:
    """The same trees, one after the other, as joins of all cells with all candidates."""
    md5 = "('0x'||substr(md5({0}), 1, 7))::BIGINT"
    m = "CEIL(SQRT(COUNT(*)))" if share is None else f"CEIL(COUNT(*) * CAST({share} AS DOUBLE))"
    out = {
        "b": f"SELECT gene, cell, v, CASE WHEN v = 0 THEN 0 ELSE 1 + CAST(FLOOR((RANK() OVER w + (COUNT(*) OVER (PARTITION BY gene, v) - 1) / 2.0 - 0.5) * {bins} / COUNT(*) OVER (PARTITION BY gene, v <> 0)) AS INT) END AS bin FROM d WINDOW w AS (PARTITION BY gene, v <> 0 ORDER BY v)",
        "g": f"SELECT gene, ROW_NUMBER() OVER (ORDER BY gene) - 1 AS place, {md5.format('gene')} AS h FROM (SELECT DISTINCT gene FROM d) x",
        "m": f"SELECT {m} AS m FROM g",
        "u": f"SELECT cell, {md5.format('cell')} AS h FROM (SELECT DISTINCT cell FROM d) x",
        "y0": "SELECT gene AS target, cell, v FROM b",
    }
    for t in range(n_trees):
        out[f"w{t}_0"] = f"SELECT target, cell, 1 AS node, CAST(0 AS DOUBLE) AS pred FROM y{t}"
        for level in range(depth):
            here, node = f"{t}_{level}", "target, node"
            factors = ", ".join(f"({n}, {factor(seed, t, n)})" for n in range(1 << level, 2 << level))
            out[f"c{here}"] = f"SELECT * FROM (SELECT t.gene AS target, f.node, g.gene, g.place, ROW_NUMBER() OVER (PARTITION BY t.gene, f.node ORDER BY g.h * f.f % {PRIME}, g.place) AS nth FROM g t, g, (VALUES {factors}) f(node, f) WHERE g.gene <> t.gene) x, m WHERE nth <= m"
            out[f"h{here}"] = f"SELECT w.target, w.node, c.gene, c.place, b.bin, COUNT(*) AS n, SUM(y.v) AS s, SUM(y.v * y.v) AS q FROM w{here} w JOIN u ON u.cell = w.cell AND u.h * {factor(seed, t, 0)} % {PRIME} % 1000 < {round(sample * 1000)} JOIN y{t} y ON y.target = w.target AND y.cell = w.cell JOIN c{here} c ON c.target = w.target AND c.node = w.node JOIN b ON b.gene = c.gene AND b.cell = w.cell GROUP BY ALL"
            out[f"r{here}"] = f"SELECT {node}, gene, place, bin, SUM(n) OVER k AS n1, SUM(s) OVER k AS s1, SUM(n) OVER a AS n0, SUM(s) OVER a AS s0, SUM(q) OVER a AS q0 FROM h{here} WINDOW a AS (PARTITION BY {node}, gene), k AS (PARTITION BY {node}, gene ORDER BY bin)"
            out[f"e{here}"] = f"SELECT *, s1*s1/n1 + (s0-s1)*(s0-s1)/(n0-n1) - s0*s0/n0 AS gain, q0 - s0*s0/n0 AS spread FROM r{here} WHERE n1 >= {min_leaf} AND n0 - n1 >= {min_leaf}"
            out[f"s{here}"] = f"SELECT {node}, gene, bin, gain, spread, s1/n1 AS low, (s0-s1)/(n0-n1) AS high FROM e{here} WHERE spread > 1e-9 AND ROUND(gain / spread, 9) > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY {node} ORDER BY ROUND(gain / spread, 9) DESC, place, bin) = 1"
            out[f"w{t}_{level + 1}"] = f"SELECT w.target, w.cell, CASE WHEN s.gene IS NULL THEN 0 WHEN b.bin > s.bin THEN 2 * w.node + 1 ELSE 2 * w.node END AS node, CASE WHEN s.gene IS NULL THEN w.pred WHEN b.bin > s.bin THEN s.high ELSE s.low END AS pred FROM w{here} w LEFT JOIN s{here} s ON s.target = w.target AND s.node = w.node LEFT JOIN b ON b.gene = s.gene AND b.cell = w.cell"
        out[f"y{t + 1}"] = f"SELECT y.target, y.cell, y.v - {rate} * w.pred AS v FROM y{t} y JOIN w{t}_{depth} w ON w.target = y.target AND w.cell = y.cell"
    every = " UNION ALL ".join(f"SELECT {t} AS tree, * FROM s{t}_{level}" for t in range(n_trees) for level in range(depth))
    return {**out, "s": every}


def tree_sql(ctes: dict[str, str], first: str) -> str:
    """Importances; `first` tells the roots whose sums of squares divide them."""
    return with_fixtures([X], {
        **{k: v for k, v in SPARSE.items() if k != "p"}, **ctes,
        "z": f"SELECT target, SUM(spread) AS spread FROM s WHERE node = 1{first} GROUP BY target",
    }, "SELECT 'ev' AS dataset_id, 'r1' AS run_id, s.gene AS gene1, s.target AS gene2, ROUND(SUM(s.gain) / MAX(z.spread), 6) + 0.0 AS weight FROM s JOIN z ON z.target = s.target GROUP BY s.gene, s.target")


@query("tree_network_rf", tree_sql(tree_ctes(4, 3, 8, 5, 0.632, None, 0.0), ""))
def tree_network_rf(spark, sf):
    """A random forest for every gene."""
    return rounded(trees.tree_network(_expr(spark, sf), "rf", n_trees=4, depth=3, bins=8), "weight")


@query("tree_network_gbt", tree_sql(tree_ctes(3, 2, 8, 5, 0.9, 0.1, 0.5), " AND tree = 0"))
def tree_network_gbt(spark, sf):
    """Boosted trees for every gene."""
    return rounded(trees.tree_network(_expr(spark, sf), "gbt", n_trees=3, depth=2, bins=8, rate=0.5), "weight")


# ---- extension points ---------------------------------------------------------


@query("evaluate_registered", with_fixtures(ev.ALL, ev.area_ctes(),
       f"SELECT {ev.K}, 'auprc' AS metric, ROUND(auprc, 6) + 0.0 AS value FROM areas UNION ALL SELECT {ev.K}, 'auroc', ROUND(auroc, 6) + 0.0 FROM areas "
       f"UNION ALL SELECT {ev.K}, 'n_edges', CAST(COUNT(*) AS DOUBLE) FROM fx_edges GROUP BY {ev.K}"))
def evaluate_registered(spark, sf):
    """The built-in areas and a metric of the user's own."""
    benchmark.register_metric("n_edges", lambda edges, gt: edges.groupBy(*KEYS).agg(
        F.lit("n_edges").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")))
    return rounded(benchmark.evaluate(*ev.fixture_pair(spark, sf), ["areas", "n_edges"]), "value")


@query("infer_registered", with_fixtures([X], {**SPARSE, "k": f"SELECT {C}, gene1, gene2, SUM(CASE WHEN x <> 0 AND y <> 0 THEN 1 ELSE 0 END) AS weight FROM p GROUP BY {C}, gene1, gene2"},
       f"""SELECT {C}, 'together' AS algorithm_id, ROW_NUMBER() OVER (PARTITION BY {C} ORDER BY weight DESC, ('0x'||substr(md5(gene1||'|'||gene2), 1, 15))::BIGINT) - 1 AS ord,
       gene1, gene2, CAST(weight AS DOUBLE) AS weight FROM k"""))
def infer_registered(spark, sf):
    """A network of the user's own: cells in which both genes are seen."""
    benchmark.register_network("together", lambda expr, pt: association.assoc(
        expr.withColumn("value", (F.col("value") != 0).cast("double")), "dotprod"))
    out = benchmark.infer(_expr(spark, sf), None, ["together"])
    return out.withColumn("weight", F.round("weight", 6))
