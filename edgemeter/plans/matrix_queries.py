"""Registered queries of expression reshaping, selection and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgemeter.functions.columns import longer, r6
from edgemeter.operators import matrix, preprocess
from edgemeter.plans import benchmark
from edgemeter.plans.catalog import query
from edgemeter.plans.fixtures import (
    EMBEDDING_SQL,
    embedding_expression,
    fixture,
    with_fixtures,
)
from edgemeter.schema import CELL_KEYS

C = "dataset_id, run_id"
X, T, M, O = "fx_expression", "fx_pseudotime", "fx_matrix", "fx_gene_ordering"
JOINED = f"SELECT e.dataset_id, e.run_id, p.trajectory, e.gene, e.cell, e.value, p.t FROM {X} e JOIN {T} p ON p.dataset_id = e.dataset_id AND p.run_id = e.run_id AND p.cell = e.cell"
REGS = "SELECT DISTINCT 'parts' AS dataset_id, p_brand||'/'||p_type AS gene FROM part WHERE p_size > 48 UNION ALL SELECT 'parts', 'not/expressed'"


def _both(spark, sf):
    return fixture(spark, sf, X), fixture(spark, sf, T)


def _regulators(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(REGS)


def _round(df, *columns):
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


@query("transpose", with_fixtures([X], body=f"SELECT {C}, cell, gene, ROUND(value, 6) + 0.0 AS value FROM {X} WHERE value IS NOT NULL"))
def transpose(spark, sf):
    """The table with a column per gene, read off again in long form."""
    return _round(longer(matrix.transpose(fixture(spark, sf, X)), [*CELL_KEYS, "cell"], "gene"), "value")


@query("by_trajectory", with_fixtures([X, T], {"j": JOINED}, f"SELECT {C}, trajectory, gene, cell, ROUND(value, 6) + 0.0 AS value, t FROM j"))
def by_trajectory(spark, sf):
    return _round(matrix.by_trajectory(*_both(spark, sf)), "value")


@query("order_cells", with_fixtures([T], body=f"SELECT {C}, cell, trajectory, t, ROW_NUMBER() OVER (PARTITION BY {C}, trajectory ORDER BY t, cell) - 1 AS cell_index FROM {T}"))
def order_cells(spark, sf):
    return matrix.order_cells(fixture(spark, sf, T))


@query("ordered_expression", with_fixtures([X, T], {"j": JOINED, "o": f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {C}, trajectory ORDER BY t, cell) - 1 AS cell_index FROM {T}"},
       f"SELECT {C}, trajectory, gene, cell, ROUND(value, 6) + 0.0 AS value, t, cell_index FROM j JOIN o USING ({C}, trajectory, cell, t)"))
def ordered_expression(spark, sf):
    return _round(matrix.ordered_expression(*_both(spark, sf)), "value")


# All times of this input exceed 1, so interval ends round to three decimals.
@query("quantile_bins", with_fixtures([T], {
    "q": f"SELECT {C}, trajectory, QUANTILE_CONT(t, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qs FROM {T} GROUP BY {C}, trajectory",
    "e": f"SELECT {C}, trajectory, list_sort(list_distinct(qs)) AS edges FROM q",
    "p": f"SELECT p.*, edges, GREATEST(len(list_filter(edges, lambda x: x < p.t)), 1) AS i FROM {T} p JOIN e USING ({C}, trajectory)"},
    f"""SELECT {C}, cell, trajectory, t, CAST(i - 1 AS INT) AS bin,
      ROUND((ROUND_EVEN(edges[i], 3) - CASE WHEN i = 1 THEN 0.001 ELSE 0 END + ROUND_EVEN(edges[i + 1], 3)) / 2, 6) + 0.0 AS bin_time FROM p"""))
def quantile_bins(spark, sf):
    return _round(matrix.quantile_bins(fixture(spark, sf, T), 10), "bin_time")


@query("shift_time", with_fixtures([T], body=f"SELECT *, t - MIN(t) OVER (PARTITION BY {C}, trajectory) AS time, 1 AS experiment FROM {T}"))
def shift_time(spark, sf):
    return matrix.shift_time(fixture(spark, sf, T))


@query("clean_names", "SELECT event_id, REPLACE('x_'||event_type, 'x_', '') AS gene, REPLACE(CAST(value AS VARCHAR), '.', '_') AS cell FROM events")
def clean_names(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.concat(F.lit("x_"), "event_type").alias("gene"), F.col("value").cast("string").alias("cell")
    )
    return rows.select("event_id", matrix.clean_gene().alias("gene"), matrix.clean_cell().alias("cell"))


SEEN = f"SELECT DISTINCT dataset_id, gene FROM {M}"
ALIGNED = f"SELECT * FROM {O} o WHERE EXISTS (SELECT 1 FROM {M} m WHERE m.dataset_id = o.dataset_id AND m.gene = o.gene)"


def _ordering(spark, sf):
    """The gene ordering with a few genes the matrix lacks."""
    rows = fixture(spark, sf, O)
    extra = rows.select("dataset_id", F.concat("gene", F.lit("*")).alias("gene"), "pvalue", "variance")
    return rows.unionByName(extra)


ORDERING = f"SELECT * FROM {O} UNION ALL SELECT dataset_id, gene||'*', pvalue, variance FROM {O}"


@query("align_genes", with_fixtures([O, M], {"a": ALIGNED}, "SELECT dataset_id, gene, ROUND(pvalue, 6) + 0.0 AS pvalue, variance FROM a"))
def align_genes(spark, sf):
    return _round(matrix.align_genes(_ordering(spark, sf), fixture(spark, sf, M)), "pvalue")


@query("unexpressed_genes", with_fixtures([O, M], {"all_rows": ORDERING},
       f"SELECT dataset_id, gene, ROUND(pvalue, 6) + 0.0 AS pvalue, variance FROM all_rows o WHERE NOT EXISTS (SELECT 1 FROM {M} m WHERE m.gene = o.gene)"))
def unexpressed_genes(spark, sf):
    return _round(matrix.unexpressed_genes(_ordering(spark, sf), fixture(spark, sf, M)), "pvalue")


PASSED = f"SELECT * FROM a WHERE pvalue < CAST(0.05 AS DOUBLE) / (SELECT COUNT(*) FROM a)"


@query("filter_pvalue", with_fixtures([O, M], {"a": ALIGNED, "passed": PASSED}, "SELECT dataset_id, gene, ROUND(pvalue, 6) + 0.0 AS pvalue, variance FROM passed"))
def filter_pvalue(spark, sf):
    genes = matrix.align_genes(_ordering(spark, sf), fixture(spark, sf, M))
    return _round(matrix.filter_pvalue(genes, 0.05), "pvalue")


@query("filter_pvalue_plain", with_fixtures([O], body=f"SELECT dataset_id, gene, ROUND(pvalue, 6) + 0.0 AS pvalue, variance FROM {O} WHERE pvalue < 0.0002"))
def filter_pvalue_plain(spark, sf):
    return _round(matrix.filter_pvalue(fixture(spark, sf, O), 0.0002, bonferroni=False), "pvalue")


SELECTION = {
    "regs": REGS, "a": ALIGNED, "passed": PASSED,
    "kept": "SELECT dataset_id, gene FROM passed WHERE gene IN (SELECT gene FROM regs)",
    "ranked": "SELECT *, ROW_NUMBER() OVER (ORDER BY variance DESC, gene) AS rn FROM passed WHERE gene NOT IN (SELECT gene FROM regs)",
    "chosen": "SELECT dataset_id, gene FROM ranked WHERE rn <= 40 UNION SELECT * FROM kept",
}


def _chosen(spark, sf, by="variance"):
    genes = matrix.filter_pvalue(matrix.align_genes(_ordering(spark, sf), fixture(spark, sf, M)), 0.05)
    return matrix.select_genes(genes, _regulators(spark, sf), 40, by)


@query("select_genes", with_fixtures([O, M], SELECTION, "SELECT dataset_id, gene FROM chosen"))
def select_genes(spark, sf):
    return _chosen(spark, sf)


@query("select_genes_by_pvalue", with_fixtures([O, M], {**SELECTION, "ranked": SELECTION["ranked"].replace("variance DESC", "pvalue")}, "SELECT dataset_id, gene FROM chosen"))
def select_genes_by_pvalue(spark, sf):
    return _chosen(spark, sf, "pvalue")


@query("filter_expression", with_fixtures([O, M], SELECTION, f"SELECT * FROM {M} WHERE gene IN (SELECT gene FROM chosen)"))
def filter_expression(spark, sf):
    return matrix.filter_expression(fixture(spark, sf, M), _chosen(spark, sf)).select(
        *CELL_KEYS, "gene", "cell", "value"
    )


# A network over part kinds: kinds on consecutive lines of an order.
NET = """SELECT 'parts' AS dataset_id, x.p_brand||'/'||x.p_type AS gene1, y.p_brand||'/'||y.p_type AS gene2
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
JOIN part x ON x.p_partkey = a.l_partkey JOIN part y ON y.p_partkey = b.l_partkey"""
NET_CTES = {**SELECTION, "net": NET,
            "slim": "SELECT DISTINCT * FROM net WHERE gene1 <> gene2 AND gene1 IN (SELECT gene FROM chosen) AND gene2 IN (SELECT gene FROM chosen)"}


def _network(spark, sf):
    for table in ("lineitem", "part"):
        spark.read.parquet(f"{sf}/{table}.parquet").createOrReplaceTempView(table)
    return matrix.filter_network(spark.sql(NET), _chosen(spark, sf))


@query("filter_network", with_fixtures([O, M], NET_CTES, "SELECT dataset_id, gene1, gene2 FROM slim"))
def filter_network(spark, sf):
    return _network(spark, sf)


@query("select_inputs", with_fixtures([O, M], {**NET_CTES,
       "m": f"SELECT dataset_id, COUNT(*) AS n_values, COUNT(DISTINCT gene) AS n_rows, SUM(value) AS total FROM {M} WHERE gene IN (SELECT gene FROM chosen) GROUP BY dataset_id",
       "c": "SELECT (SELECT COUNT(DISTINCT gene1) FROM slim) AS s, (SELECT COUNT(*) FROM (SELECT gene1 FROM slim UNION SELECT gene2 FROM slim) q) AS n, (SELECT COUNT(*) FROM slim) AS e"},
       "SELECT 'parts' AS dataset_id, s AS n_sources, n AS n_genes, e AS n_edges, ROUND(CAST(e AS DOUBLE) / NULLIF(s * n - s, 0), 6) + 0.0 AS density, n_values, n_rows, ROUND(total, 6) + 0.0 AS total FROM c, m"))
def select_inputs(spark, sf):
    """The whole selection at once: chosen values, network and its statistics."""
    _network(spark, sf)  # registers the tables of the network
    slim, edges, stats = benchmark.select_inputs(
        fixture(spark, sf, M), _ordering(spark, sf), spark.sql(NET), _regulators(spark, sf), cutoff=0.05, n=40)
    values = slim.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_distinct("gene").alias("n_rows"), F.sum("value").alias("total"))
    return _round(_round(stats.join(values, "dataset_id"), "density"), "total")


@query("network_stats", with_fixtures([O, M], {**NET_CTES,
       "c": f"SELECT (SELECT COUNT(DISTINCT gene1) FROM slim) AS s, (SELECT COUNT(*) FROM (SELECT gene1 FROM slim UNION SELECT gene2 FROM slim) q) AS n, (SELECT COUNT(*) FROM slim) AS e"},
       "SELECT 'parts' AS dataset_id, s AS n_sources, n AS n_genes, e AS n_edges, ROUND(CAST(e AS DOUBLE) / NULLIF(s * n - s, 0), 6) + 0.0 AS density FROM c"))
def network_stats(spark, sf):
    return _round(matrix.network_stats(_network(spark, sf), fixture(spark, sf, M)), "density")


# ---- preprocessing ----------------------------------------------------------

SYMBOLS = "SELECT DISTINCT p_brand||'/'||p_type AS transcript, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS symbol FROM part"


@query("collapse_transcripts", with_fixtures([M], {"s": SYMBOLS},
       f"SELECT {C}, symbol AS gene, cell, ROUND(SUM(value), 6) + 0.0 AS value FROM {M} m JOIN s ON s.transcript = m.gene WHERE symbol IS NOT NULL GROUP BY {C}, symbol, cell"))
def collapse_transcripts(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part")
    versioned = fixture(spark, sf, M).withColumn("gene", F.concat("gene", F.lit(".2")))
    return _round(preprocess.collapse_transcripts(versioned, spark.sql(SYMBOLS)), "value").select(
        *CELL_KEYS, "gene", "cell", "value"
    )


def _detected_sql(condition, having):
    return with_fixtures([X], {"k": f"SELECT gene FROM {X} GROUP BY gene HAVING COUNT(*) FILTER (WHERE {condition}) >= {having}"},
                         f"SELECT {C}, gene, cell, ROUND(value, 6) + 0.0 AS value FROM {X} WHERE gene IN (SELECT gene FROM k)")


@query("filter_detected", _detected_sql("value > 60", f"0.47 * (SELECT COUNT(DISTINCT cell) FROM {X})"))
def filter_detected(spark, sf):
    out = preprocess.filter_detected(fixture(spark, sf, X), min_expr=60.0, min_frac=0.47)
    return _round(out.select(*CELL_KEYS, "gene", "cell", "value"), "value")


@query("filter_detected_cells", _detected_sql("value >= 450", "1"))
def filter_detected_cells(spark, sf):
    out = preprocess.filter_detected(fixture(spark, sf, X), min_expr=450.0, min_cells=1)
    return _round(out.select(*CELL_KEYS, "gene", "cell", "value"), "value")


@query("log2p1", with_fixtures([X], body=f"SELECT {C}, gene, cell, ROUND(LOG2(value + 1), 6) + 0.0 AS value FROM {X}"))
def log2p1(spark, sf):
    return _round(preprocess.log2p1(fixture(spark, sf, X)), "value")


COUNTS = f"SELECT dataset_id, run_id, gene, cell, ROUND(ABS(value) * 1000) + 1 AS value FROM ({EMBEDDING_SQL}) e"


def _counts(spark, sf):
    rows = embedding_expression(spark, sf)
    return rows.select(*CELL_KEYS, "gene", "cell", (F.round(F.abs("value") * 1000) + 1).alias("value"))


MEANS = "SELECT gene, AVG(LN(value)) AS g FROM x GROUP BY gene HAVING COUNT(*) = (SELECT COUNT(DISTINCT cell) FROM x)"
FACTORS = "SELECT x.cell, MEDIAN(value / EXP(g)) AS f FROM x JOIN m ON m.gene = x.gene GROUP BY x.cell"


@query("size_factors", with_fixtures([], {"x": COUNTS, "m": MEANS, "f": FACTORS},
       "SELECT 'emb' AS dataset_id, 'r1' AS run_id, cell, ROUND(f, 6) + 0.0 AS size_factor FROM f"))
def size_factors(spark, sf):
    return _round(preprocess.size_factors(_counts(spark, sf)), "size_factor")


@query("median_ratio_normalize", with_fixtures([], {"x": COUNTS, "m": MEANS, "f": FACTORS},
       f"SELECT {C}, gene, x.cell, ROUND(value / f, 6) + 0.0 AS value FROM x JOIN f ON f.cell = x.cell"))
def median_ratio_normalize(spark, sf):
    out = preprocess.median_ratio_normalize(_counts(spark, sf))
    return _round(out.select(*CELL_KEYS, "gene", "cell", "value"), "value")


DENSE = f"SELECT g.{C.replace(', ', ', g.')}, g.gene, c.cell, COALESCE(x.value, 0) AS value FROM (SELECT DISTINCT {C}, gene FROM src) g JOIN (SELECT DISTINCT {C}, cell FROM src) c USING ({C}) LEFT JOIN src x ON x.dataset_id = g.dataset_id AND x.run_id = g.run_id AND x.gene = g.gene AND x.cell = c.cell"


@query("gene_variance", with_fixtures([X], {"src": f"SELECT * FROM {X}", "d": DENSE},
       f"SELECT {C}, gene, ROUND(VAR_SAMP(value), 6) + 0.0 AS variance, RANK() OVER (PARTITION BY {C} ORDER BY VAR_SAMP(value) DESC) AS rank FROM d GROUP BY {C}, gene"))
def gene_variance(spark, sf):
    out = preprocess.rank_variance(fixture(spark, sf, X))
    return _round(out.select(*CELL_KEYS, "gene", "variance", "rank"), "variance")


def _pca_sql(parts: int = 3, squarings: int = 18) -> str:
    """Components by squaring the covariance until one direction is left, then taking it out."""
    steps = {
        "x": f"SELECT dataset_id, run_id, gene, cell, value - AVG(value) OVER (PARTITION BY dataset_id, run_id, gene) AS v FROM ({EMBEDDING_SQL}) e",
        "c1": f"SELECT {C}, a.gene AS i, b.gene AS j, SUM(a.v * b.v) AS v FROM x a JOIN x b USING ({C}, cell) GROUP BY ALL",
    }
    for k in range(1, parts + 1):
        steps[f"p{k}"] = f"""SELECT 0 AS step, {C}, i, j, v / SUM(CASE WHEN i = j THEN v END) OVER (PARTITION BY {C}) AS v FROM c{k}
  UNION ALL SELECT step + 1, {C}, i, j, v / SUM(CASE WHEN i = j THEN v END) OVER (PARTITION BY {C}) FROM (
    SELECT a.step, {C}, a.i, b.j, SUM(a.v * b.v) AS v FROM p{k} a JOIN p{k} b USING ({C}) WHERE a.j = b.i AND a.step < {squarings} GROUP BY ALL) q"""
        steps[f"o{k}"] = f"SELECT {C}, ARG_MAX(j, v) AS j FROM p{k} WHERE step = {squarings} AND i = j GROUP BY {C}"
        # The longest column, of length 1 and with its largest entry positive.
        steps[f"l{k}"] = f"""SELECT {C}, i AS gene, v / SQRT(SUM(v * v) OVER w) * SIGN(ARG_MAX(v, ABS(v)) OVER w) AS v
  FROM p{k} JOIN o{k} USING ({C}, j) WHERE step = {squarings} WINDOW w AS (PARTITION BY {C})"""
        steps[f"e{k}"] = f"SELECT {C}, SUM(a.v * c.v * b.v) AS e FROM c{k} c JOIN l{k} a USING ({C}) JOIN l{k} b USING ({C}) WHERE a.gene = c.i AND b.gene = c.j GROUP BY {C}"
        steps[f"c{k + 1}"] = f"SELECT {C}, i, j, c.v - e * a.v * b.v AS v FROM c{k} c JOIN l{k} a USING ({C}) JOIN l{k} b USING ({C}) JOIN e{k} USING ({C}) WHERE a.gene = c.i AND b.gene = c.j"
        steps[f"s{k}"] = f"SELECT {C}, cell, ROUND(SUM(x.v * l{k}.v), 5) + 0.0 AS pc{k} FROM x JOIN l{k} USING ({C}, gene) GROUP BY {C}, cell"
    joined = " ".join(f"JOIN s{k} USING ({C}, cell)" for k in range(2, parts + 1))
    columns = ", ".join(f"pc{k}" for k in range(1, parts + 1))
    return with_fixtures([], steps, f"SELECT {C}, cell, {columns} FROM s1 {joined}").replace("WITH ", "WITH RECURSIVE ", 1)


@query("pca", _pca_sql())
def pca(spark, sf):
    out = preprocess.pca(embedding_expression(spark, sf), 3)
    return out.select(*CELL_KEYS, "cell", *[(F.round(c, 5) + 0.0).alias(c) for c in ("pc1", "pc2", "pc3")])


@query("label_cells", """SELECT event_id, CASE str_split(event_type||'_'||CAST(user_id AS VARCHAR)||'_'||CAST(event_id AS VARCHAR), '_')[1]
  WHEN 'click' THEN 'engaged' WHEN 'view' THEN 'idle' ELSE event_type END AS label,
  CASE WHEN value > 50 THEN 'high' WHEN user_id % 2 = 1 THEN 'odd' ELSE 'Unknown' END AS marker FROM events""")
def label_cells(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id",
        F.concat_ws("_", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("cell"),
        (F.col("value") > 50).cast("int").alias("high"),
        (F.col("user_id") % 2).cast("int").alias("odd"),
    )
    label = preprocess.recode(preprocess.name_token("cell", "_", 1), {"click": "engaged", "view": "idle"})
    return rows.select("event_id", label.alias("label"), preprocess.first_marker(["high", "odd"]).alias("marker"))


LINEAGE = {"src": f"SELECT dataset_id, run_id||'-'||CAST(trajectory AS VARCHAR) AS run_id, gene, REPLACE(cell, '.', '_') AS cell, value FROM ({JOINED}) j", "d": DENSE}


@query("per_lineage", with_fixtures([X, T], LINEAGE, f"SELECT {C}, gene, ROUND(VAR_SAMP(value), 6) + 0.0 AS variance FROM d GROUP BY {C}, gene"))
def per_lineage(spark, sf):
    return _round(preprocess.per_lineage(*_both(spark, sf))[1], "variance")


@query("per_lineage_matrix", with_fixtures([X, T], LINEAGE, f"SELECT {C}, gene, cell, ROUND(value, 6) + 0.0 AS value FROM src"))
def per_lineage_matrix(spark, sf):
    return _round(preprocess.per_lineage(*_both(spark, sf))[0], "value")


@query("heat_slice", with_fixtures([X, T], {"j": JOINED,
       "o": f"SELECT dataset_id, gene, CAST(1 AS DOUBLE) / SUM(value) AS pvalue FROM {X} GROUP BY dataset_id, gene",
       "top": "SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY pvalue, gene) AS INT) AS gene_place FROM o"},
       f"SELECT {C}, trajectory, j.gene, gene_place, cell, t, ROUND(value, 6) + 0.0 AS value FROM j JOIN top ON top.gene = j.gene WHERE gene_place <= 15"
       .replace("SELECT dataset_id, run_id", "SELECT j.dataset_id, j.run_id")))
def heat_slice(spark, sf):
    expr, pt = _both(spark, sf)
    ordering = expr.groupBy("dataset_id", "gene").agg((F.lit(1.0) / F.sum("value")).alias("pvalue"))
    return _round(preprocess.heat_slice(expr, pt, ordering, 15), "value")


UNIT = "CAST(('0x'||substr(md5({x}), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"
PICK = {
    "cells": f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {C} ORDER BY {UNIT.format(x=chr(39) + '7|' + chr(39) + '||cell')}) AS rn FROM (SELECT DISTINCT {C}, cell FROM {X}) q",
    "s": f"SELECT * FROM {X} WHERE cell IN (SELECT cell FROM cells WHERE rn <= 10)",
}


@query("sample_cells", with_fixtures([X], PICK, f"SELECT {C}, gene, cell, ROUND(value, 6) + 0.0 AS value FROM s"))
def sample_cells(spark, sf):
    out = preprocess.sample_cells(fixture(spark, sf, X), 10, seed=7)
    return _round(out.select(*CELL_KEYS, "gene", "cell", "value"), "value")


@query("dropout", with_fixtures([X], {**PICK, "c": """SELECT g.gene, QUANTILE_CONT(COALESCE(s.value, 0), 0.7) AS cut
  FROM (SELECT DISTINCT gene FROM s) g CROSS JOIN (SELECT DISTINCT cell FROM s) k LEFT JOIN s ON s.gene = g.gene AND s.cell = k.cell GROUP BY g.gene"""},
       f"SELECT {C}, s.gene, cell, CASE WHEN value < cut AND {UNIT.format(x=chr(39) + '7|' + chr(39) + '||s.gene||' + chr(39) + '|' + chr(39) + '||cell')} < 0.5 THEN 0.0 ELSE ROUND(value, 6) + 0.0 END AS value FROM s JOIN c ON c.gene = s.gene"))
def dropout(spark, sf):
    out = preprocess.dropout(fixture(spark, sf, X), 10, 0.7, 0.5, seed=7)
    return _round(out.select(*CELL_KEYS, "gene", "cell", "value"), "value")
