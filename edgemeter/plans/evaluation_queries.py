"""Registered queries of the edge-list evaluators.

The SQL twins take the naive road: they build every candidate pair and sort
whole lists, so they also prove the closed forms used by the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edgemeter.functions.columns import longer, r6
from edgemeter.operators import consensus, curves, early, graph, primitives, stability
from edgemeter.plans.catalog import query
from edgemeter.plans.fixtures import fixture, with_fixtures
from edgemeter.schema import KEYS, PAIR
from edgemeter.sources.metrics import pivot_metric

ALL = ["fx_ground_truth", "fx_edges"]
K = "dataset_id, run_id, algorithm_id"
E = "dataset_id, gene1, gene2"

# ---- shared CTEs for the SQL twins ----------------------------------------

GENES = """SELECT dataset_id, gene1 AS g FROM fx_ground_truth UNION SELECT dataset_id, gene2 FROM fx_ground_truth"""
TRUE = f"SELECT DISTINCT {E} FROM fx_ground_truth WHERE gene1 <> gene2"
UNIVERSE = {
    "directed": "SELECT a.dataset_id, a.g AS gene1, b.g AS gene2 FROM genes a JOIN genes b ON a.dataset_id = b.dataset_id AND a.g <> b.g",
    "undirected": "SELECT a.dataset_id, a.g AS gene1, b.g AS gene2 FROM genes a JOIN genes b ON a.dataset_id = b.dataset_id AND a.g < b.g",
    "tf": "SELECT a.dataset_id, a.g AS gene1, b.g AS gene2 FROM (SELECT DISTINCT dataset_id, gene1 AS g FROM fx_ground_truth WHERE gene1 <> gene2) a JOIN genes b ON a.dataset_id = b.dataset_id AND a.g <> b.g",
    "tf_self": "SELECT a.dataset_id, a.g AS gene1, b.g AS gene2 FROM (SELECT DISTINCT dataset_id, gene1 AS g FROM fx_ground_truth) a JOIN genes b ON a.dataset_id = b.dataset_id",
}
TRUE_UNDIRECTED = "SELECT DISTINCT dataset_id, LEAST(gene1, gene2) AS gene1, GREATEST(gene1, gene2) AS gene2 FROM fx_ground_truth WHERE gene1 <> gene2"
BEST = f"SELECT {K}, gene1, gene2, MAX(ABS(weight)) AS score FROM fx_edges WHERE gene1 <> gene2 GROUP BY {K}, gene1, gene2"
LISTS = f"SELECT DISTINCT {K} FROM fx_edges"
GRID = """SELECT l.dataset_id, l.run_id, l.algorithm_id, u.gene1, u.gene2, COALESCE(b.score, 0) AS score,
       CASE WHEN t.gene1 IS NULL THEN 0 ELSE 1 END AS hit
FROM lists l JOIN uni u ON l.dataset_id = u.dataset_id
LEFT JOIN best b ON b.dataset_id = l.dataset_id AND b.run_id = l.run_id AND b.algorithm_id = l.algorithm_id AND b.gene1 = u.gene1 AND b.gene2 = u.gene2
LEFT JOIN truth t ON t.dataset_id = u.dataset_id AND t.gene1 = u.gene1 AND t.gene2 = u.gene2"""
BLOCKS = f"SELECT {K}, score, COUNT(*) AS n, SUM(hit) AS h FROM grid GROUP BY {K}, score"
CURVE = f"""SELECT *, SUM(n) OVER w AS cn, SUM(h) OVER w AS ch, SUM(n) OVER a AS tn, SUM(h) OVER a AS th
FROM blocks WINDOW w AS (PARTITION BY {K} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {K})"""
AREAS = f"""SELECT {K}, MAX(th) AS k, MAX(tn) AS pairs,
  SUM(CAST(h AS DOUBLE) / NULLIF(th, 0) * (CAST(ch AS DOUBLE) / cn + CASE WHEN cn = n THEN 1.0 ELSE CAST(ch - h AS DOUBLE) / (cn - n) END) / 2) AS auprc,
  SUM(CAST(h AS DOUBLE) / NULLIF(th, 0) * CAST(ch AS DOUBLE) / cn) AS ap,
  SUM(CAST(n - h AS DOUBLE) / NULLIF(tn - th, 0) * (CAST(ch AS DOUBLE) + ch - h) / NULLIF(th, 0) / 2) AS auroc
FROM curve GROUP BY {K}"""


def area_ctes(kind: str = "directed") -> dict[str, str]:
    return {
        "genes": GENES,
        "truth": TRUE_UNDIRECTED if kind == "undirected" else TRUE,
        "uni": UNIVERSE[kind],
        "best": BEST,
        "lists": LISTS,
        "grid": GRID,
        "blocks": BLOCKS,
        "curve": CURVE,
        "areas": AREAS,
    }


def fixture_pair(spark, sf, edges="fx_edges"):
    return fixture(spark, sf, edges), fixture(spark, sf, "fx_ground_truth")


# ---- E1, E2, E11, E12, E14 -------------------------------------------------

PIVOT = """SELECT dataset_id, algorithm_id AS "Algorithm", run_id, {v} AS value FROM areas WHERE {v} IS NOT NULL"""


@query("auprc", with_fixtures(ALL, area_ctes(),
       f"SELECT {K}, 'auprc' AS metric, ROUND(auprc, 6) + 0.0 AS value FROM areas"))
def auprc(spark, sf):
    return curves.auprc(*fixture_pair(spark, sf)).withColumn("value", r6("value"))


@query("auprc_by_run", with_fixtures(ALL, area_ctes(), PIVOT.format(v="ROUND(auprc, 6) + 0.0")))
def auprc_by_run(spark, sf):
    """The table with a column per run, read off again in long form: a run that
    the table loses is missing here."""
    values = curves.auprc(*fixture_pair(spark, sf)).withColumn("value", r6("value"))
    return longer(pivot_metric(values), ["dataset_id", "Algorithm"], "run_id")


@query("auroc", with_fixtures(ALL, area_ctes(),
       f"SELECT {K}, 'auroc' AS metric, ROUND(auroc, 6) + 0.0 AS value FROM areas"))
def auroc(spark, sf):
    return curves.auroc(*fixture_pair(spark, sf)).withColumn("value", r6("value"))


RATIOS = """SELECT {keys}, ROUND(ap, 6) + 0.0 AS average_precision, ROUND(auroc, 6) + 0.0 AS auroc,
  ROUND(ap / (CAST(k AS DOUBLE) / pairs), 6) + 0.0 AS average_precision_ratio, ROUND(auroc / 0.5, 6) + 0.0 AS auroc_ratio FROM areas"""
RATIO_COLUMNS = ["average_precision", "auroc", "average_precision_ratio", "auroc_ratio"]


def _ratio_query(kind):
    @query(f"pr_roc_ratio_{kind}", with_fixtures(ALL, area_ctes(kind), RATIOS.format(keys=K)))
    def run(spark, sf):
        out = curves.pr_roc_ratio(*fixture_pair(spark, sf), kind)
        return out.select(*KEYS, *[r6(c).alias(c) for c in RATIO_COLUMNS])


for _kind in ("directed", "undirected", "tf_self"):
    _ratio_query(_kind)


def _signed_ctes(kind: str) -> dict[str, str]:
    sorted_pair = kind == "undirected"
    g1, g2 = ("LEAST(gene1, gene2)", "GREATEST(gene1, gene2)") if sorted_pair else ("gene1", "gene2")
    score = """SELECT {k}, gene1, gene2, sign, ARG_MAX(ABS(weight), ord) AS score FROM (
      SELECT e.*, s.sign, l.neg FROM fx_edges e JOIN neg l USING ({k}) CROSS JOIN (SELECT '+' AS sign UNION ALL SELECT '-') s
      WHERE (l.neg = 1 AND ((s.sign = '+') = (e.weight >= 0)))
         OR (l.neg = 0 AND NOT EXISTS (SELECT 1 FROM fx_ground_truth t WHERE t.dataset_id = e.dataset_id AND t.gene1 = e.gene1
              AND t.gene2 = e.gene2 AND t.gene1 <> t.gene2 AND t.type IS DISTINCT FROM s.sign))) q
      WHERE gene1 <> gene2 GROUP BY {k}, gene1, gene2, sign""".format(k=K)
    ks = K + ", sign"
    return {
        "genes": GENES,
        "truth": f"SELECT DISTINCT dataset_id, type AS sign, {g1} AS gene1, {g2} AS gene2 FROM fx_ground_truth WHERE gene1 <> gene2",
        "uni": UNIVERSE[kind],
        "lists": LISTS,
        "neg": f"SELECT {K}, MAX(CASE WHEN weight < 0 THEN 1 ELSE 0 END) AS neg FROM fx_edges GROUP BY {K}",
        "best": score,
        "grid": """SELECT l.dataset_id, l.run_id, l.algorithm_id, s.sign, COALESCE(b.score, 0) AS score, CASE WHEN t.gene1 IS NULL THEN 0 ELSE 1 END AS hit
          FROM lists l CROSS JOIN (SELECT '+' AS sign UNION ALL SELECT '-') s JOIN uni u ON l.dataset_id = u.dataset_id
          LEFT JOIN best b ON b.dataset_id = l.dataset_id AND b.run_id = l.run_id AND b.algorithm_id = l.algorithm_id AND b.sign = s.sign AND b.gene1 = u.gene1 AND b.gene2 = u.gene2
          LEFT JOIN truth t ON t.dataset_id = u.dataset_id AND t.sign = s.sign AND t.gene1 = u.gene1 AND t.gene2 = u.gene2""",
        "blocks": BLOCKS.replace(K, ks),
        "curve": CURVE.replace(K, ks),
        "areas": AREAS.replace(K, ks),
    }


def _signed_query(kind):
    @query(f"signed_pr_roc_{kind}",
           with_fixtures(ALL, _signed_ctes(kind), RATIOS.format(keys=K + ", sign")))
    def run(spark, sf):
        out = curves.signed_pr_roc(*fixture_pair(spark, sf), kind)
        return out.select(*KEYS, "sign", *[r6(c).alias(c) for c in RATIO_COLUMNS])


for _kind in ("directed", "undirected", "tf_self"):
    _signed_query(_kind)

POINTS = {
    "truth": TRUE,
    "rows": f"""SELECT e.{K.replace(', ', ', e.')}, e.weight AS score, CASE WHEN t.gene1 IS NULL THEN 0 ELSE 1 END AS hit
      FROM fx_edges e LEFT JOIN truth t ON t.dataset_id = e.dataset_id AND t.gene1 = e.gene1 AND t.gene2 = e.gene2 WHERE e.gene1 <> e.gene2""",
    "grid": "SELECT * FROM rows",
    "blocks": BLOCKS,
    "curve": CURVE,
}


@query("pr_curve", with_fixtures(ALL, {**POINTS, "areas": AREAS,
       "placed": f"SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id, run_id ORDER BY auprc DESC, algorithm_id) AS INT) AS place FROM areas WHERE k > 0"},
       f"""SELECT c.{K.replace(', ', ', c.')}, ROUND(c.score, 6) + 0.0 AS threshold, ROUND(CAST(ch AS DOUBLE) / th, 6) + 0.0 AS recall,
       ROUND(CAST(ch AS DOUBLE) / cn, 6) + 0.0 AS precision, ROUND(p.auprc, 6) + 0.0 AS area, p.place FROM curve c JOIN placed p USING ({K})
       UNION ALL SELECT {K}, NULL, 0.0, 1.0, ROUND(auprc, 6) + 0.0, place FROM placed"""))
def pr_curve(spark, sf):
    out = curves.pr_curve(*fixture_pair(spark, sf))
    return out.select(*KEYS, *[r6(c).alias(c) for c in ("threshold", "recall", "precision", "area")], "place")


@query("roc_curve", with_fixtures(ALL, {**POINTS, "areas": AREAS,
       "placed": f"SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id, run_id ORDER BY auroc DESC, algorithm_id) AS INT) AS place FROM areas WHERE k > 0 AND k < pairs"},
       f"""SELECT c.{K.replace(', ', ', c.')}, ROUND(c.score, 6) + 0.0 AS threshold, ROUND(CAST(cn - ch AS DOUBLE) / (tn - th), 6) + 0.0 AS fpr,
       ROUND(CAST(ch AS DOUBLE) / th, 6) + 0.0 AS tpr, ROUND(p.auroc, 6) + 0.0 AS area, p.place FROM curve c JOIN placed p USING ({K})
       UNION ALL SELECT {K}, NULL, 0.0, 0.0, ROUND(auroc, 6) + 0.0, place FROM placed"""))
def roc_curve(spark, sf):
    out = curves.roc_curve(*fixture_pair(spark, sf))
    return out.select(*KEYS, *[r6(c).alias(c) for c in ("threshold", "fpr", "tpr", "area")], "place")


# ---- E3, E4, E13 ------------------------------------------------------------

CUT = f"""SELECT r.*, MAX(CASE WHEN r.rn = r.m THEN r.score END) OVER (PARTITION BY {K}) AS kth,
  COALESCE(MIN(CASE WHEN r.score > 0 THEN r.score END) OVER (PARTITION BY {K}), 0) AS minpos FROM (
  SELECT c.*, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY score DESC) AS rn,
    LEAST(COUNT(*) OVER (PARTITION BY {K}), k) AS m FROM cand c) r"""
SELECTED = "SELECT * FROM cut WHERE score >= GREATEST(kth, minpos)"


def _epr_ctes(kind: str) -> dict[str, str]:
    inside = "" if kind == "directed" else "JOIN uni u ON u.dataset_id = b.dataset_id AND u.gene1 = b.gene1 AND u.gene2 = b.gene2"
    return {
        "genes": GENES, "truth": TRUE, "uni": UNIVERSE[kind], "best": BEST, "lists": LISTS,
        "sizes": "SELECT d.dataset_id, (SELECT COUNT(*) FROM truth t WHERE t.dataset_id = d.dataset_id) AS k, (SELECT COUNT(*) FROM uni u WHERE u.dataset_id = d.dataset_id) AS pairs FROM (SELECT DISTINCT dataset_id FROM genes) d",
        "cand": f"""SELECT b.*, s.k, CASE WHEN t.gene1 IS NULL THEN 0 ELSE 1 END AS hit FROM best b JOIN sizes s ON s.dataset_id = b.dataset_id {inside}
          LEFT JOIN truth t ON t.dataset_id = b.dataset_id AND t.gene1 = b.gene1 AND t.gene2 = b.gene2""",
        "cut": CUT, "selected": SELECTED,
        "prec": f"SELECT {K}, CAST(SUM(hit) AS DOUBLE) / COUNT(*) AS p FROM selected GROUP BY {K}",
    }


EPR_OUT = f"""SELECT {K}, 'epr' AS metric, ROUND(CASE WHEN k > 0 AND pairs > 0 THEN COALESCE(p, 0) / (CAST(k AS DOUBLE) / pairs) END, 6) + 0.0 AS value
FROM lists JOIN sizes USING (dataset_id) LEFT JOIN prec USING ({K})"""


@query("epr", with_fixtures(ALL, _epr_ctes("directed"), EPR_OUT))
def epr(spark, sf):
    return early.epr(*fixture_pair(spark, sf)).withColumn("value", r6("value"))


@query("epr_tf", with_fixtures(ALL, _epr_ctes("tf"), EPR_OUT))
def epr_tf(spark, sf):
    return early.epr(*fixture_pair(spark, sf), tf_edges=True).withColumn("value", r6("value"))


KS = K + ", metric"


@query("signed_epr", with_fixtures(["fx_ground_truth", "fx_edges_dup"], {
    "signs": "SELECT '+' AS s, 'epr_activation' AS metric UNION ALL SELECT '-', 'epr_inhibitory'",
    "genes": GENES,
    "sizes": "SELECT dataset_id, COUNT(*) * (COUNT(*) - 1) AS pairs FROM genes GROUP BY dataset_id",
    "ks": f"SELECT dataset_id, type AS s, COUNT(*) AS k FROM (SELECT DISTINCT {E}, type FROM fx_ground_truth WHERE gene1 <> gene2) q GROUP BY dataset_id, type",
    "cand": f"""SELECT e.dataset_id, e.run_id, e.algorithm_id, g.metric, ABS(e.weight) AS score, k.k,
      CASE WHEN EXISTS (SELECT 1 FROM fx_ground_truth t WHERE t.dataset_id = e.dataset_id AND t.gene1 = e.gene1 AND t.gene2 = e.gene2 AND t.type = g.s) THEN 1 ELSE 0 END AS hit
      FROM fx_edges_dup e CROSS JOIN signs g JOIN ks k ON k.dataset_id = e.dataset_id AND k.s = g.s
      WHERE e.gene1 <> e.gene2 AND NOT EXISTS (SELECT 1 FROM fx_ground_truth t WHERE t.dataset_id = e.dataset_id AND t.gene1 = e.gene1 AND t.gene2 = e.gene2 AND t.type <> g.s)""",
    "cut": CUT.replace(K, KS), "selected": SELECTED,
    "prec": f"SELECT {KS}, CAST(SUM(hit) AS DOUBLE) / COUNT(*) / MAX(k) AS p FROM selected GROUP BY {KS}"},
    f"""SELECT l.dataset_id, l.run_id, l.algorithm_id, g.metric, ROUND(p.p * z.pairs, 6) + 0.0 AS value
    FROM (SELECT DISTINCT {K} FROM fx_edges_dup) l CROSS JOIN signs g JOIN sizes z ON z.dataset_id = l.dataset_id
    LEFT JOIN prec p ON p.dataset_id = l.dataset_id AND p.run_id = l.run_id AND p.algorithm_id = l.algorithm_id AND p.metric = g.metric"""))
def signed_epr(spark, sf):
    return early.signed_epr(*fixture_pair(spark, sf, "fx_edges_dup")).withColumn("value", r6("value"))


def _early_ctes(kind: str) -> dict[str, str]:
    src = "SELECT DISTINCT dataset_id, gene1 AS g FROM plain" if kind == "tf" else "SELECT * FROM genes"
    inside = "" if kind == "directed" else "JOIN uni u ON u.dataset_id = e.dataset_id AND u.gene1 = e.gene1 AND u.gene2 = e.gene2"
    return {
        "plain": "SELECT DISTINCT dataset_id, gene1, gene2, type FROM fx_ground_truth WHERE gene1 <> gene2",
        "genes": "SELECT dataset_id, gene1 AS g FROM plain UNION SELECT dataset_id, gene2 FROM plain",
        "src": src,
        "uni": "SELECT a.dataset_id, a.g AS gene1, b.g AS gene2 FROM src a JOIN genes b ON a.dataset_id = b.dataset_id AND a.g <> b.g",
        "sizes": "SELECT d.dataset_id, (SELECT COUNT(*) FROM plain t WHERE t.dataset_id = d.dataset_id) AS k, (SELECT COUNT(*) FROM uni u WHERE u.dataset_id = d.dataset_id) AS pairs FROM (SELECT DISTINCT dataset_id FROM genes) d",
        "cand": f"""SELECT e.dataset_id, e.run_id, e.algorithm_id, e.gene1, e.gene2, ROUND(ABS(e.weight), 6) AS score, s.k,
          CASE WHEN EXISTS (SELECT 1 FROM plain t WHERE t.dataset_id = e.dataset_id AND t.gene1 = e.gene1 AND t.gene2 = e.gene2) THEN 1 ELSE 0 END AS hit
          FROM (SELECT DISTINCT {K}, gene1, gene2, weight FROM fx_edges_dup WHERE gene1 <> gene2) e JOIN sizes s ON s.dataset_id = e.dataset_id {inside}""",
        "cut": CUT, "selected": SELECTED,
        "uniq": f"SELECT {K}, COUNT(*) AS n, SUM(hit) AS h FROM (SELECT DISTINCT {K}, gene1, gene2, hit FROM selected WHERE score > 0) q GROUP BY {K}",
    }


EARLY_OUT = f"""SELECT {K}, ROUND(CASE WHEN c.present IS NULL THEN 1.0 ELSE CAST(h AS DOUBLE) / n END, 6) + 0.0 AS early_precision,
  ROUND(CASE WHEN c.present IS NULL THEN 1.0 ELSE CAST(h AS DOUBLE) / k END, 6) + 0.0 AS early_recall,
  ROUND(CASE WHEN c.present IS NULL THEN 1.0 ELSE CAST(h AS DOUBLE) / n / (CAST(k AS DOUBLE) / pairs) END, 6) + 0.0 AS early_precision_ratio
FROM (SELECT DISTINCT {K} FROM fx_edges_dup) l JOIN sizes USING (dataset_id) LEFT JOIN uniq USING ({K})
LEFT JOIN (SELECT DISTINCT {K}, 1 AS present FROM cand) c USING ({K})"""


def _early_query(kind):
    @query(f"early_pr_{kind}",
           with_fixtures(["fx_ground_truth", "fx_edges_dup"], _early_ctes(kind), EARLY_OUT))
    def run(spark, sf):
        out = early.early_pr(*fixture_pair(spark, sf, "fx_edges_dup"), kind)
        return out.select(*KEYS, *[r6(c).alias(c) for c in out.columns if c not in KEYS])


for _kind in ("tf", "directed"):
    _early_query(_kind)

# ---- E5, E6, E7 -------------------------------------------------------------

SPREAD = """SELECT a.dataset_id, a.algorithm_id, ROUND(MEDIAN(p.value), 6) + 0.0 AS median_{m},
  ROUND(AVG(ABS(p.value - p.mean)), 6) + 0.0 AS mad_{m}
FROM (SELECT DISTINCT dataset_id, algorithm_id FROM fx_edges) a
LEFT JOIN (SELECT *, AVG(value) OVER (PARTITION BY dataset_id, algorithm_id) AS mean FROM pairs) p
  ON p.dataset_id = a.dataset_id AND p.algorithm_id = a.algorithm_id GROUP BY a.dataset_id, a.algorithm_id"""
JACCARD = {
    "ks": "SELECT dataset_id, COUNT(*) AS k FROM fx_ground_truth WHERE gene1 <> gene2 GROUP BY dataset_id",
    "best": BEST, "lists": LISTS,
    "cand": "SELECT b.*, k FROM best b JOIN ks USING (dataset_id)",
    "cut": CUT, "selected": SELECTED,
    "pairs": """SELECT a.dataset_id, a.algorithm_id, CAST(i AS DOUBLE) / NULLIF(na + nb - i, 0) AS value FROM (
      SELECT a.dataset_id, a.algorithm_id,
        (SELECT COUNT(*) FROM selected x WHERE x.dataset_id = a.dataset_id AND x.algorithm_id = a.algorithm_id AND x.run_id = a.run_id) AS na,
        (SELECT COUNT(*) FROM selected x WHERE x.dataset_id = a.dataset_id AND x.algorithm_id = a.algorithm_id AND x.run_id = b.run_id) AS nb,
        (SELECT COUNT(*) FROM selected x JOIN selected y ON x.dataset_id = y.dataset_id AND x.algorithm_id = y.algorithm_id AND x.gene1 = y.gene1 AND x.gene2 = y.gene2
          WHERE x.dataset_id = a.dataset_id AND x.algorithm_id = a.algorithm_id AND x.run_id = a.run_id AND y.run_id = b.run_id) AS i
      FROM lists a JOIN lists b ON a.dataset_id = b.dataset_id AND a.algorithm_id = b.algorithm_id AND a.run_id < b.run_id) a""",
}


@query("jaccard", with_fixtures(ALL, JACCARD, SPREAD.format(m="jaccard")))
def jaccard(spark, sf):
    out = stability.jaccard(*fixture_pair(spark, sf))
    return out.select("dataset_id", "algorithm_id", r6("median_jaccard").alias("median_jaccard"),
                      r6("mad_jaccard").alias("mad_jaccard"))


SPEARMAN = {
    "genes": GENES, "uni": UNIVERSE["directed"], "lists": LISTS,
    "signedbest": f"SELECT {K}, gene1, gene2, ARG_MAX(weight, ABS(weight) * 1000000000 - ord) AS weight FROM fx_edges WHERE gene1 <> gene2 GROUP BY {K}, gene1, gene2",
    "dense": f"""SELECT l.dataset_id, l.run_id, l.algorithm_id, u.gene1, u.gene2, COALESCE(b.weight, 0) AS w FROM lists l JOIN uni u ON u.dataset_id = l.dataset_id
      LEFT JOIN signedbest b ON b.dataset_id = l.dataset_id AND b.run_id = l.run_id AND b.algorithm_id = l.algorithm_id AND b.gene1 = u.gene1 AND b.gene2 = u.gene2""",
    "usable": f"SELECT {K} FROM dense GROUP BY {K} HAVING MIN(w) <> MAX(w)",
    "mids": f"SELECT *, RANK() OVER (PARTITION BY {K} ORDER BY w) + (COUNT(*) OVER (PARTITION BY {K}, w) - 1) / 2.0 AS r FROM dense JOIN usable USING ({K})",
    "pairs": """SELECT x.dataset_id, x.algorithm_id, CORR(CAST(x.r AS DOUBLE), CAST(y.r AS DOUBLE)) AS value FROM mids x JOIN mids y
      ON x.dataset_id = y.dataset_id AND x.algorithm_id = y.algorithm_id AND x.gene1 = y.gene1 AND x.gene2 = y.gene2 AND x.run_id < y.run_id
      GROUP BY x.dataset_id, x.algorithm_id, x.run_id, y.run_id""",
}


@query("spearman", with_fixtures(ALL, SPEARMAN, SPREAD.format(m="spearman")))
def spearman(spark, sf):
    out = stability.spearman(*fixture_pair(spark, sf))
    return out.select("dataset_id", "algorithm_id", r6("median_spearman").alias("median_spearman"),
                      r6("mad_spearman").alias("mad_spearman"))


BORDA = {
    "plain": "SELECT * FROM fx_edges_dup WHERE gene1 <> gene2",
    "ranked": f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY weight DESC, ord) AS rk FROM plain",
    "worst": f"SELECT {K}, gene1, gene2, MAX(rk) AS rk FROM ranked GROUP BY {K}, gene1, gene2",
    "lens": f"SELECT {K}, SUM(CASE WHEN gene1 <> gene2 THEN 1 ELSE 0 END) AS len FROM fx_edges_dup GROUP BY {K}",
    "pool": "SELECT DISTINCT dataset_id, run_id, gene1, gene2 FROM plain",
    "sizes": "SELECT dataset_id, run_id, COUNT(*) AS n FROM pool GROUP BY dataset_id, run_id",
    "scores": """SELECT p.dataset_id, p.run_id, p.gene1, p.gene2, CAST(s.n + 1 - COALESCE(w.rk, l.len + 1) AS DOUBLE) AS score
      FROM pool p JOIN sizes s USING (dataset_id, run_id) JOIN lens l USING (dataset_id, run_id)
      LEFT JOIN worst w ON w.dataset_id = p.dataset_id AND w.run_id = p.run_id AND w.algorithm_id = l.algorithm_id AND w.gene1 = p.gene1 AND w.gene2 = p.gene2""",
    "runs": "SELECT dataset_id, run_id, gene1, gene2, AVG(score) AS a, MEDIAN(score) AS b, MIN(score) AS c, MAX(score) AS d FROM scores GROUP BY dataset_id, run_id, gene1, gene2",
    "med": "SELECT dataset_id, gene1, gene2, MEDIAN(a) AS a, MEDIAN(b) AS b, MEDIAN(c) AS c, MEDIAN(d) AS d FROM runs GROUP BY dataset_id, gene1, gene2",
}
SCALED = ", ".join(
    f"ROUND(COALESCE(({x} - MIN({x}) OVER w) / NULLIF(MAX({x}) OVER w - MIN({x}) OVER w, 0), 0), 6) + 0.0 AS {name}"
    for x, name in zip("abcd", ["borda", "mborda", "sborda", "smborda"])
)


@query("borda", with_fixtures(["fx_edges_dup"], BORDA,
       f"SELECT dataset_id, gene1, gene2, {SCALED} FROM med WINDOW w AS (PARTITION BY dataset_id)"))
def borda(spark, sf):
    out = consensus.borda(fixture(spark, sf, "fx_edges_dup"))
    return out.select("dataset_id", *PAIR, *[r6(c).alias(c) for c in consensus.COLUMNS.values()])


# ---- E8, E9 -----------------------------------------------------------------

MOTIF_CTES = {
    "truth": TRUE,
    "ks": "SELECT dataset_id, COUNT(*) AS k FROM truth GROUP BY dataset_id",
    "lists": LISTS,
    "top": f"""SELECT DISTINCT {K}, gene1, gene2 FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY ABS(weight) DESC, ord DESC) AS rn
      FROM fx_edges e WHERE gene1 <> gene2) q JOIN ks USING (dataset_id) WHERE rn <= k""",
    "net": f"SELECT {K}, gene1 AS a, gene2 AS b FROM top UNION ALL SELECT dataset_id, 'ref', 'ref', gene1, gene2 FROM truth",
    "mi": f"SELECT x.{K.replace(', ', ', x.')}, COUNT(*) AS c FROM net x JOIN net y ON x.dataset_id=y.dataset_id AND x.run_id=y.run_id AND x.algorithm_id=y.algorithm_id AND x.a=y.b AND x.b=y.a WHERE x.a < x.b GROUP BY ALL",
    "fbl": f"""SELECT x.{K.replace(', ', ', x.')}, COUNT(*) AS c FROM net x JOIN net y ON x.dataset_id=y.dataset_id AND x.run_id=y.run_id AND x.algorithm_id=y.algorithm_id AND x.b=y.a
      JOIN net z ON x.dataset_id=z.dataset_id AND x.run_id=z.run_id AND x.algorithm_id=z.algorithm_id AND y.b=z.a AND z.b=x.a WHERE x.a < y.a AND x.a < z.a GROUP BY ALL""",
    "ffl": f"""SELECT x.{K.replace(', ', ', x.')}, COUNT(*) AS c FROM net x JOIN net y ON x.dataset_id=y.dataset_id AND x.run_id=y.run_id AND x.algorithm_id=y.algorithm_id AND x.b=y.a
      JOIN net z ON x.dataset_id=z.dataset_id AND x.run_id=z.run_id AND x.algorithm_id=z.algorithm_id AND z.a=x.a AND z.b=y.b WHERE y.b <> x.a GROUP BY ALL""",
}


def _motif_value(m: str) -> str:
    return (
        f"ROUND(CAST(COALESCE((SELECT c FROM {m} q WHERE q.dataset_id=l.dataset_id AND q.run_id=l.run_id AND q.algorithm_id=l.algorithm_id), 0) AS DOUBLE)"
        f" / (SELECT c FROM {m} q WHERE q.dataset_id=l.dataset_id AND q.run_id='ref'), 6) + 0.0 AS {m}"
    )


@query("motif_ratios", with_fixtures(ALL, MOTIF_CTES,
       f"SELECT {K}, {', '.join(_motif_value(m) for m in ('fbl', 'ffl', 'mi'))} FROM lists l"))
def motif_ratios(spark, sf):
    out = graph.motif_ratios(*fixture_pair(spark, sf))
    return out.select(*KEYS, *[r6(m).alias(m) for m in graph.MOTIFS])


PATHS = """WITH RECURSIVE {ctes},
reach AS (
  SELECT DISTINCT dataset_id, gene1 AS src, gene2 AS node, 1 AS d FROM truth
  UNION
  SELECT r.dataset_id, r.src, t.gene2, r.d + 1 FROM reach r JOIN truth t ON t.dataset_id = r.dataset_id AND t.gene1 = r.node
  WHERE r.d < {depth}),
dist AS (SELECT dataset_id, src AS gene1, node AS gene2, MIN(d) AS len FROM reach GROUP BY dataset_id, src, node)
SELECT {K}, CAST(0 AS BIGINT) AS len_0,
  COUNT(*) FILTER (WHERE hit = 0 AND len = 2) AS len_2, COUNT(*) FILTER (WHERE hit = 0 AND len = 3) AS len_3,
  COUNT(*) FILTER (WHERE hit = 0 AND len = 4) AS len_4, COUNT(*) FILTER (WHERE hit = 0 AND len = 5) AS len_5,
  COUNT(*) AS num_pred, CAST(SUM(hit) AS BIGINT) AS num_tp,
  COUNT(*) FILTER (WHERE hit = 0 AND len IS NOT NULL) AS num_fp_with_path, COUNT(*) FILTER (WHERE hit = 0 AND len IS NULL) AS num_fp_no_path
FROM (SELECT p.*, CASE WHEN t.gene1 IS NULL THEN 0 ELSE 1 END AS hit, d.len FROM pred p
  LEFT JOIN truth t ON t.dataset_id = p.dataset_id AND t.gene1 = p.gene1 AND t.gene2 = p.gene2
  LEFT JOIN dist d ON d.dataset_id = p.dataset_id AND d.gene1 = p.gene1 AND d.gene2 = p.gene2) q GROUP BY {K}"""
PATH_CTES = {
    "truth": TRUE,
    "ks": "SELECT dataset_id, COUNT(*) AS k FROM truth GROUP BY dataset_id",
    "slim": f"SELECT {K}, gene1, gene2, ROUND(ABS(weight), 6) AS w, MIN(ord) AS ord FROM fx_edges_unsorted WHERE gene1 <> gene2 AND ROUND(ABS(weight), 6) > 0 GROUP BY {K}, gene1, gene2, ROUND(ABS(weight), 6)",
    "numbered": f"SELECT s.*, k, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY ord) AS rn, COUNT(*) OVER (PARTITION BY {K}) AS size FROM slim s JOIN ks USING (dataset_id)",
    "cutw": f"SELECT {K}, w AS cutoff FROM numbered WHERE rn = LEAST(size, k)",
    "pred": f"SELECT DISTINCT {K}, gene1, gene2 FROM numbered JOIN cutw USING ({K}) WHERE w >= cutoff",
}


@query("path_stats", PATHS.replace("{ctes}", with_fixtures(
    ["fx_ground_truth", "fx_edges_unsorted"], PATH_CTES).removeprefix("WITH ").rstrip()
).replace("{K}", K).replace("{depth}", "(SELECT COUNT(DISTINCT gene1) FROM truth)"))
def path_stats(spark, sf):
    return graph.path_stats(*fixture_pair(spark, sf, "fx_edges_unsorted"))


# ---- primitives -------------------------------------------------------------


@query("drop_self_loops", with_fixtures(["fx_edges"], body="SELECT * FROM fx_edges WHERE gene1 <> gene2"))
def p_drop_self_loops(spark, sf):
    return primitives.drop_self_loops(fixture(spark, sf, "fx_edges"))


@query("best_abs", with_fixtures(["fx_edges_dup"], body=f"SELECT {K}, gene1, gene2, MAX(ABS(weight)) AS score FROM fx_edges_dup GROUP BY {K}, gene1, gene2"))
def p_best_abs(spark, sf):
    return primitives.best_abs(fixture(spark, sf, "fx_edges_dup"))


@query("best_signed", with_fixtures(["fx_edges_dup"], body=f"""SELECT {K}, gene1, gene2, weight + 0.0 AS weight FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, gene1, gene2 ORDER BY ABS(weight) DESC, ord) AS rn FROM fx_edges_dup WHERE gene1 <> gene2) q WHERE rn = 1"""))
def p_best_signed(spark, sf):
    out = primitives.best_signed(fixture(spark, sf, "fx_edges_dup"))
    return out.withColumn("weight", F.col("weight") + F.lit(0.0))


def _universe_query(kind):
    sql = with_fixtures(["fx_ground_truth"], {"genes": GENES, "uni": UNIVERSE[kind]}, f"SELECT {E} FROM uni")

    @query(f"universe_{kind}", sql)
    def run(spark, sf):
        return primitives.universe(fixture(spark, sf, "fx_ground_truth"), kind)

    truth = TRUE_UNDIRECTED if kind == "undirected" else TRUE

    @query(f"universe_sizes_{kind}", with_fixtures(["fx_ground_truth"], {"genes": GENES, "uni": UNIVERSE[kind], "truth": truth},
           "SELECT dataset_id, COUNT(*) AS n_pairs, COUNT(t.gene1) AS n_true FROM uni LEFT JOIN truth t USING (dataset_id, gene1, gene2) GROUP BY dataset_id"
           .replace("COUNT(t.gene1)", "COUNT(t.mark)").replace("LEFT JOIN truth t", "LEFT JOIN (SELECT *, 1 AS mark FROM truth) t")))
    def sizes(spark, sf):
        return primitives.universe_sizes(fixture(spark, sf, "fx_ground_truth"), kind)

    @query(f"true_edges_{kind}", with_fixtures(["fx_ground_truth"], {"truth": truth}, f"SELECT {E} FROM truth"))
    def true(spark, sf):
        return primitives.true_edges(fixture(spark, sf, "fx_ground_truth"), kind)


for _kind in primitives.UNIVERSES:
    _universe_query(_kind)


@query("align", with_fixtures(ALL, {k: v for k, v in area_ctes().items() if k in ("genes", "truth", "uni", "best", "lists", "grid")},
       f"SELECT {K}, gene1, gene2, score FROM grid"))
def p_align(spark, sf):
    return primitives.align(*fixture_pair(spark, sf))


@query("topk_ties", with_fixtures(ALL, {k: v for k, v in JACCARD.items() if k in ("ks", "best", "cand", "cut", "selected")},
       f"SELECT {K}, gene1, gene2, score FROM selected"))
def p_topk_ties(spark, sf):
    edges, gt = fixture_pair(spark, sf)
    return primitives.topk_ties(edges, primitives.k_rows(gt))


@query("topk_plain", with_fixtures(ALL, {k: MOTIF_CTES[k] for k in ("truth", "ks", "top")}, f"SELECT {K}, gene1, gene2 FROM top"))
def p_topk_plain(spark, sf):
    edges, gt = fixture_pair(spark, sf)
    return primitives.topk_plain(edges, primitives.k_true(gt))


@query("topk_positional", with_fixtures(["fx_ground_truth", "fx_edges_unsorted"], PATH_CTES,
       f"SELECT {K}, gene1, gene2, w AS score FROM numbered JOIN cutw USING ({K}) WHERE w >= cutoff"))
def p_topk_positional(spark, sf):
    edges, gt = fixture_pair(spark, sf, "fx_edges_unsorted")
    return primitives.topk_positional(edges, primitives.k_true(gt))
