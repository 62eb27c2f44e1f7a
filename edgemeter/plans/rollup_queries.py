"""Registered queries of the benchmark roll-ups, timing, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgemeter.functions.columns import longer, r6
from edgemeter.functions.ranking import global_rank
from edgemeter.operators import curves, early, rollup, stability, timing
from edgemeter.plans import benchmark
from edgemeter.plans import evaluation_queries as ev
from edgemeter.plans.catalog import query
from edgemeter.plans.fixtures import fixture, with_fixtures
from edgemeter.schema import CELL_KEYS, KEYS, PAIR
from edgemeter.session import scratch_path
from edgemeter.sources import config, edges as edge_io, expression, metrics
from edgemeter.sources.timing import read_timings

K = ev.K
BASE = """SELECT d.dataset_id, CAST(NULLIF(COUNT(t.gene1), 0) AS DOUBLE) / NULLIF(MAX(n) * (MAX(n) - 1), 0) AS total,
  CAST(NULLIF(SUM(CASE WHEN t.type = '+' THEN 1 ELSE 0 END), 0) AS DOUBLE) / NULLIF(MAX(n) * (MAX(n) - 1), 0) AS activation,
  CAST(NULLIF(SUM(CASE WHEN t.type = '-' THEN 1 ELSE 0 END), 0) AS DOUBLE) / NULLIF(MAX(n) * (MAX(n) - 1), 0) AS inhibition
FROM (SELECT DISTINCT dataset_id FROM fx_ground_truth) d LEFT JOIN fx_ground_truth t ON t.dataset_id = d.dataset_id AND t.gene1 <> t.gene2
LEFT JOIN (SELECT dataset_id, COUNT(*) AS n FROM (SELECT dataset_id, gene1 FROM fx_ground_truth WHERE gene1 <> gene2
  UNION SELECT dataset_id, gene2 FROM fx_ground_truth WHERE gene1 <> gene2) g GROUP BY dataset_id) z ON z.dataset_id = d.dataset_id
GROUP BY d.dataset_id"""


@query("random_baseline", with_fixtures(["fx_ground_truth"], {"base": BASE}, "SELECT dataset_id, ROUND(total, 6) + 0.0 AS baseline FROM base"))
def random_baseline(spark, sf):
    out = rollup.random_baseline(fixture(spark, sf, "fx_ground_truth"))
    return out.withColumn("baseline", r6("baseline"))


@query("signed_baselines", with_fixtures(["fx_ground_truth"], {"base": BASE},
       "SELECT dataset_id, ROUND(total, 6) + 0.0 AS total, ROUND(activation, 6) + 0.0 AS activation, ROUND(inhibition, 6) + 0.0 AS inhibition FROM base"))
def signed_baselines(spark, sf):
    out = rollup.signed_baselines(fixture(spark, sf, "fx_ground_truth"))
    return out.select("dataset_id", *[r6(c).alias(c) for c in ("total", "activation", "inhibition")])


RATIO_CTES = {
    **ev.area_ctes(), "base": BASE,
    "ratios": "SELECT a.dataset_id, a.algorithm_id, MEDIAN(auprc / total) AS value FROM areas a JOIN base b USING (dataset_id) WHERE total > 0 GROUP BY a.dataset_id, a.algorithm_id",
    "ordered": "SELECT algorithm_id, m, CAST(ROW_NUMBER() OVER (ORDER BY m DESC, algorithm_id) AS INT) AS place FROM (SELECT algorithm_id, MEDIAN(value) AS m FROM ratios GROUP BY algorithm_id) q",
}


def _ratios(spark, sf):
    edges, gt = ev.fixture_pair(spark, sf)
    return rollup.median_ratio(curves.auprc(edges, gt), rollup.random_baseline(gt))


@query("median_ratio", with_fixtures(ev.ALL, RATIO_CTES, "SELECT dataset_id, algorithm_id, ROUND(value, 6) + 0.0 AS value FROM ratios"))
def median_ratio(spark, sf):
    return _ratios(spark, sf).withColumn("value", r6("value"))


@query("order_algorithms", with_fixtures(ev.ALL, RATIO_CTES, "SELECT algorithm_id, ROUND(m, 6) + 0.0 AS median, place FROM ordered"))
def order_algorithms(spark, sf):
    return rollup.order_algorithms(_ratios(spark, sf)).withColumn("median", r6("median"))


STABILITY = {
    "stable": """SELECT a.dataset_id, a.algorithm_id, MEDIAN(p.value) AS value FROM (SELECT DISTINCT dataset_id, algorithm_id FROM fx_edges) a
      LEFT JOIN pairs p ON p.dataset_id = a.dataset_id AND p.algorithm_id = a.algorithm_id GROUP BY a.dataset_id, a.algorithm_id""",
    "sections": "SELECT 'auprc_ratio' AS section, * FROM ratios UNION ALL SELECT 'stability', * FROM stable",
}
_SPEAR = {k: v for k, v in ev.SPEARMAN.items() if k not in RATIO_CTES}


def _stability(spark, sf):
    edges, gt = ev.fixture_pair(spark, sf)
    return rollup.stability_summary(curves.auprc(edges, gt), stability.spearman(edges, gt), gt)


@query("stability_summary", with_fixtures(ev.ALL, {**RATIO_CTES, **_SPEAR, **STABILITY},
       "SELECT place, s.algorithm_id, section, dataset_id, ROUND(value, 6) + 0.0 AS value FROM sections s JOIN ordered o ON o.algorithm_id = s.algorithm_id"))
def stability_summary(spark, sf):
    return _stability(spark, sf).withColumn("value", r6("value"))


SUMMARY_CELLS = """SELECT place, s.algorithm_id, section || '|' || dataset_id AS cell, ROUND(value, 6) + 0.0 AS value
FROM sections s JOIN ordered o ON o.algorithm_id = s.algorithm_id WHERE value IS NOT NULL"""


def _metric_sections() -> dict[str, str]:
    """Median EPR per algorithm and dataset, unsigned and per sign."""
    epr = ev._epr_ctes("directed")
    out = {k: epr[k] for k in ("sizes", "cand", "cut", "selected", "prec")}
    out["e_epr"] = f"SELECT dataset_id, algorithm_id, 'epr' AS section, COALESCE(p, 0) / (CAST(k AS DOUBLE) / pairs) AS value FROM lists JOIN sizes USING (dataset_id) LEFT JOIN prec USING ({K})"
    out["ks"] = f"SELECT dataset_id, type AS s, COUNT(*) AS k FROM (SELECT DISTINCT {ev.E}, type FROM fx_ground_truth WHERE gene1 <> gene2) q GROUP BY dataset_id, type"
    out["scand"] = """SELECT e.dataset_id, e.run_id, e.algorithm_id, g.metric, ABS(e.weight) AS score, k.k,
      CASE WHEN EXISTS (SELECT 1 FROM fx_ground_truth t WHERE t.dataset_id = e.dataset_id AND t.gene1 = e.gene1 AND t.gene2 = e.gene2 AND t.type = g.s) THEN 1 ELSE 0 END AS hit
      FROM fx_edges e CROSS JOIN (SELECT '+' AS s, 'epr_activation' AS metric UNION ALL SELECT '-', 'epr_inhibitory') g JOIN ks k ON k.dataset_id = e.dataset_id AND k.s = g.s
      WHERE e.gene1 <> e.gene2 AND NOT EXISTS (SELECT 1 FROM fx_ground_truth t WHERE t.dataset_id = e.dataset_id AND t.gene1 = e.gene1 AND t.gene2 = e.gene2 AND t.type <> g.s)"""
    out["scut"] = ev.CUT.replace(K, ev.KS).replace("FROM cand", "FROM scand")
    out["e_signed"] = f"""SELECT c.dataset_id, algorithm_id, metric AS section, CAST(SUM(hit) AS DOUBLE) / COUNT(*) / MAX(c.k) * MAX(z.pairs) AS value
      FROM scut c JOIN sizes z ON z.dataset_id = c.dataset_id WHERE score >= GREATEST(kth, minpos) GROUP BY c.dataset_id, run_id, algorithm_id, metric"""
    out["sections"] = """SELECT 'auprc_ratio' AS section, dataset_id, algorithm_id, value FROM ratios
      UNION ALL SELECT section, dataset_id, algorithm_id, MEDIAN(value) FROM e_epr GROUP BY ALL
      UNION ALL SELECT section, dataset_id, algorithm_id, MEDIAN(value) FROM e_signed GROUP BY ALL"""
    return out


@query("epr_summary", with_fixtures(ev.ALL, {**RATIO_CTES, **_metric_sections()}, SUMMARY_CELLS))
def epr_summary(spark, sf):
    edges, gt = ev.fixture_pair(spark, sf)
    table = rollup.epr_summary(
        curves.auprc(edges, gt), early.epr(edges, gt), early.signed_epr(edges, gt), gt
    ).withColumn("value", r6("value"))
    return longer(rollup.pivot_summary(table), ["place", "algorithm_id"], "cell")


def _heat_sql(cutoff: float) -> str:
    low = str(cutoff) if cutoff > 0 else "MIN(value) OVER w"
    return f"""SELECT place, algorithm_id, section, dataset_id, ROUND(value, 6) + 0.0 AS value, ROUND(scaled, 6) + 0.0 AS scaled,
  CASE WHEN scaled IS NOT NULL THEN CAST(LEAST(FLOOR(scaled * 10), 10) AS INT) END AS bucket, COALESCE(value < {cutoff}, FALSE) AS below_cutoff, value IS NULL AS missing,
  COALESCE(scaled >= 1, FALSE) AS is_max, COALESCE(value >= {cutoff} AND value <= seen, FALSE) AS is_visible_min,
  CASE WHEN value >= {cutoff} THEN CASE WHEN value >= 1 THEN printf('%.1f', value) ELSE printf('%.2f', value) END END AS label
FROM (SELECT *, CASE WHEN value >= {cutoff} THEN CASE WHEN mx > low THEN (value - low) / (mx - low) ELSE 0.5 END END AS scaled FROM (
  SELECT place, s.algorithm_id, section, dataset_id, value, MAX(value) OVER w AS mx, {low} AS low,
    MIN(CASE WHEN value >= {cutoff} THEN value END) OVER w AS seen
  FROM sections s JOIN ordered o ON o.algorithm_id = s.algorithm_id WINDOW w AS (PARTITION BY section, dataset_id)) q) r"""


_RATIO_SECTION = {**RATIO_CTES, "sections": "SELECT 'auprc_ratio' AS section, dataset_id, algorithm_id, value FROM ratios"}


def _heat_query(name, cutoff):
    @query(name, with_fixtures(ev.ALL, _RATIO_SECTION, _heat_sql(cutoff)))
    def run(spark, sf):
        table = rollup.summary([rollup.section(_ratios(spark, sf), "auprc_ratio")])
        cells = rollup.heat_cells(table, cutoff)
        return cells.withColumn("value", r6("value")).withColumn("scaled", r6("scaled"))


_heat_query("heat_cells_baseline", 1.0)
_heat_query("heat_cells_full_range", 0.0)


@query("box_stats", with_fixtures(ev.ALL, ev._epr_ctes("directed") | {
    "vals": f"SELECT dataset_id, algorithm_id, COALESCE(p, 0) / (CAST(k AS DOUBLE) / pairs) AS v FROM lists JOIN sizes USING (dataset_id) LEFT JOIN prec USING ({K})"},
    """SELECT dataset_id, algorithm_id, COUNT(v) AS n, ROUND(MIN(v), 6) + 0.0 AS min, ROUND(QUANTILE_CONT(v, 0.25), 6) + 0.0 AS q1,
    ROUND(MEDIAN(v), 6) + 0.0 AS median, ROUND(QUANTILE_CONT(v, 0.75), 6) + 0.0 AS q3, ROUND(MAX(v), 6) + 0.0 AS max,
    ROUND(AVG(v), 6) + 0.0 AS mean, 1.0::DOUBLE AS reference FROM vals GROUP BY dataset_id, algorithm_id"""))
def box_stats(spark, sf):
    out = rollup.box_stats(early.epr(*ev.fixture_pair(spark, sf)), reference=1.0)
    numbers = ["min", "q1", "median", "q3", "max", "mean", "reference"]
    return out.select("dataset_id", "algorithm_id", "n", *[r6(c).alias(c) for c in numbers])


# ---- timing ---------------------------------------------------------------

# Per list and gene a log whose seconds come from its edges; some logs of run N
# lack the system line, and one algorithm has no logs.
LOG_SOURCE = f"""SELECT {K}, gene1, SUM(ord) AS u, COUNT(*) AS s FROM fx_edges GROUP BY {K}, gene1"""


@query("cpu_time", with_fixtures(["fx_edges"], {"logs": LOG_SOURCE},
       f"""SELECT l.dataset_id, l.run_id, l.algorithm_id, 'cpu_time' AS metric, ROUND(v, 6) + 0.0 AS value FROM (SELECT DISTINCT {K} FROM fx_edges UNION SELECT DISTINCT dataset_id, run_id, 'alg_X' FROM fx_edges) l LEFT JOIN
       (SELECT {K}, SUM(CASE WHEN run_id = 'run_N' AND u % 2 = 0 THEN 0 ELSE CAST(u AS DOUBLE) + CAST(s AS DOUBLE) END) AS v FROM logs GROUP BY {K}) t
       ON t.dataset_id = l.dataset_id AND t.run_id = l.run_id AND t.algorithm_id = l.algorithm_id"""))
def cpu_time(spark, sf):
    edges = fixture(spark, sf, "fx_edges")
    logs = (
        edges.groupBy(*KEYS, "gene1")
        .agg(F.sum("ord").alias("u"), F.count(F.lit(1)).alias("s"))
    )
    broken = (F.col("run_id") == "run_N") & (F.col("u") % 2 == 0)
    user = F.concat(F.lit("\tUser time (seconds): "), F.col("u").cast("string"), F.lit(".00\n"))
    system = F.concat(F.lit("\tSystem time (seconds): "), F.col("s").cast("string"), F.lit(".00\n"))
    text = F.concat(F.lit("\tCommand being timed: \"x\"\n"), user,
                    F.when(broken, F.lit("")).otherwise(system))
    without_logs = edges.select(*CELL_KEYS, F.lit("alg_X").alias("algorithm_id"))
    named = edges.select(*KEYS).unionByName(without_logs)
    out = timing.cpu_time(logs.select(*KEYS, text.alias("text")), named)
    return out.withColumn("value", r6("value"))


@query("read_timings", with_fixtures(["fx_edges"], body=f"SELECT {K}, CAST(COUNT(*) AS DOUBLE) + 0.5 AS seconds FROM fx_edges GROUP BY {K}"))
def timings_round_trip(spark, sf):
    root = scratch_path(spark, "timings")
    counts = fixture(spark, sf, "fx_edges").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    lines = F.concat(
        F.lit("\tUser time (seconds): "), F.col("n").cast("string"),
        F.lit(".25\n\tSystem time (seconds): 0.25"),
    )
    counts.select(*KEYS, F.lit("x").alias("working_dir"), lines.alias("value")).write.partitionBy(
        *KEYS, "working_dir"
    ).text(root)
    return read_timings(spark, root, "part-*").select(*KEYS, timing.cpu_seconds().alias("seconds"))


# ---- sources and sinks ----------------------------------------------------


@query("ranked_edges_csv", with_fixtures(["fx_edges"], body=f"SELECT {K}, ord, gene1, gene2, weight + 0.0 AS weight FROM fx_edges"))
def ranked_edges_csv(spark, sf):
    """Write tab-separated lists, read them back, recover the positions."""
    root = scratch_path(spark, "ranked")
    edge_io.write_ranked_edges(fixture(spark, sf, "fx_edges"), root, "csv")
    back = edge_io.read_ranked_edges(spark, root, "part-*")
    placed = global_rank(back.withColumn("_tie", F.col("ord")), KEYS, "ord", "_tie", descending=False)
    return placed.select(*KEYS, (F.col("rank") - 1).alias("ord"), *PAIR,
                         (F.col("weight") + F.lit(0.0)).alias("weight"))


@query("ranked_edges_table", with_fixtures(["fx_edges"], body=f"SELECT {K}, ord, gene1, gene2, weight + 0.0 AS weight FROM fx_edges"))
def ranked_edges_table(spark, sf):
    root = scratch_path(spark, "ranked")
    edge_io.write_ranked_edges(fixture(spark, sf, "fx_edges"), root)
    back = edge_io.read_edge_table(spark, root)
    return back.withColumn("weight", F.col("weight") + F.lit(0.0))


def _gt_round_trip(spark, sf, signed):
    root = scratch_path(spark, "truth")
    edge_io.write_ground_truth(fixture(spark, sf, "fx_ground_truth"), root)
    return edge_io.read_ground_truth(spark, root, "part-*", signed)


@query("ground_truth_csv", with_fixtures(["fx_ground_truth"], body="SELECT * FROM fx_ground_truth"))
def ground_truth_csv(spark, sf):
    return _gt_round_trip(spark, sf, False)


@query("ground_truth_signed_csv", with_fixtures(["fx_ground_truth"], body="SELECT * FROM fx_ground_truth WHERE type IN ('+', '-')"))
def ground_truth_signed_csv(spark, sf):
    return _gt_round_trip(spark, sf, True)


@query("expression_csv", with_fixtures(["fx_expression"], body="SELECT dataset_id, run_id, gene, cell, ROUND(value, 6) + 0.0 AS value FROM fx_expression"))
def expression_csv(spark, sf):
    root = scratch_path(spark, "expression")
    expression.write_expression(fixture(spark, sf, "fx_expression"), root)
    back = expression.read_expression(spark, root, "part-*")
    return back.withColumn("value", r6("value"))


@query("pseudotime_csv", with_fixtures(["fx_pseudotime"], body="SELECT * FROM fx_pseudotime"))
def pseudotime_csv(spark, sf):
    root = scratch_path(spark, "pseudotime")
    expression.write_pseudotime(fixture(spark, sf, "fx_pseudotime"), root)
    return expression.read_pseudotime(spark, root, "part-*").select(
        *CELL_KEYS, "cell", "trajectory", "t"
    )


@query("gene_ordering_csv", with_fixtures(["fx_gene_ordering"], body="SELECT dataset_id, gene, ROUND(pvalue, 6) + 0.0 AS pvalue, ROUND(variance, 6) + 0.0 AS variance FROM fx_gene_ordering"))
def gene_ordering_csv(spark, sf):
    root = scratch_path(spark, "ordering")
    fixture(spark, sf, "fx_gene_ordering").select(
        F.col("gene").alias("name"), F.col("pvalue").alias("VGAMpValue"), F.col("variance").alias("Var")
    ).write.option("header", True).csv(root)
    out = expression.read_gene_ordering(spark, root, "parts")
    return out.select("dataset_id", "gene", r6("pvalue").alias("pvalue"), r6("variance").alias("variance"))


@query("regulators_csv", with_fixtures(["fx_ground_truth"], body="SELECT DISTINCT 'all' AS dataset_id, gene1 AS gene FROM fx_ground_truth"))
def regulators_csv(spark, sf):
    root = scratch_path(spark, "regulators")
    fixture(spark, sf, "fx_ground_truth").select(F.col("gene1").alias("TF")).distinct().write.option(
        "header", True
    ).csv(root)
    return expression.read_regulators(spark, root, "all")


@query("load_metric", with_fixtures(ev.ALL, ev._epr_ctes("directed"), ev.EPR_OUT.replace("'epr' AS metric, ", "")))
def load_metric(spark, sf):
    root = scratch_path(spark, "metric")
    values = early.epr(*ev.fixture_pair(spark, sf)).withColumn("value", r6("value"))
    metrics.write_metric(metrics.pivot_metric(values), root)
    return metrics.load_metric(spark, f"{root}/*/part-*").select(*KEYS, "value")


@query("discover_runs", with_fixtures(["fx_edges"], body="SELECT DISTINCT dataset_id, run_id FROM fx_edges"))
def discover_runs(spark, sf):
    """List the run directories of a written benchmark through a configuration."""
    root = scratch_path(spark, "inputs")
    names = fixture(spark, sf, "fx_edges").select(*CELL_KEYS).distinct()
    names.select(*CELL_KEYS, F.concat("dataset_id", F.lit("/"), "run_id").alias("value")).write.partitionBy(
        *CELL_KEYS
    ).text(root)
    settings = {
        "input_settings": {
            "input_dir": root.rsplit("/", 1)[1],
            "datasets": [
                {"dataset_id": name, "scan_run_subdirectories": True, "should_run": [True]}
                for name in config.list_directories(spark, root)
            ],
            "algorithms": [],
        },
        "output_settings": {"output_dir": "outputs"},
    }
    found = config.load_config(spark, settings, root.rsplit("/", 1)[0]).runs
    strip = [F.regexp_replace(c, f"^{c}=", "").alias(c) for c in CELL_KEYS]
    return found.select(*strip)


@query("missing_lists", with_fixtures(["fx_edges"], body="""SELECT r.dataset_id, r.run_id, a.algorithm_id
  FROM (SELECT DISTINCT dataset_id, run_id FROM fx_edges) r CROSS JOIN (SELECT DISTINCT algorithm_id FROM fx_edges UNION ALL SELECT 'alg_X') a
  WHERE NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.dataset_id = r.dataset_id AND e.run_id = r.run_id AND e.algorithm_id = a.algorithm_id)"""))
def missing_lists(spark, sf):
    edges = fixture(spark, sf, "fx_edges")
    extra = edges.sparkSession.createDataFrame([("alg_X",)], "algorithm_id string")
    algorithms = edges.select("algorithm_id").distinct().union(extra)
    return edge_io.missing_lists(edges, edges.select(*CELL_KEYS).distinct(), algorithms)


def _written_benchmark(spark, sf):
    """Lists, ground truths and logs as files, and a configuration that switches alg_P off."""
    root = scratch_path(spark, "benchmark")
    edges, gt = ev.fixture_pair(spark, sf)
    edge_io.write_ranked_edges(edges, f"{root}/out", "csv")
    shapes = edges.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("\tUser time (seconds): "), F.col("n").cast("string"),
                    F.lit(".25\n\tSystem time (seconds): 0.25"))
    shapes.select(*KEYS, F.lit("x").alias("working_dir"), line.alias("value")).write.mode("append").partitionBy(
        *KEYS, "working_dir").text(f"{root}/out")
    datasets = []
    for row in shapes.groupBy("dataset_id").agg(F.collect_set("run_id").alias("runs")).collect():
        own = gt.filter(F.col("dataset_id") == row.dataset_id)
        own.select(F.col("gene1").alias("Gene1"), F.col("gene2").alias("Gene2"), F.col("type").alias("Type")).write.option(
            "header", True).csv(f"{root}/in/{row.dataset_id}")
        datasets.append({"dataset_id": row.dataset_id, "nickname": f"the {row.dataset_id}", "groundTruthNetwork": "part-*",
                         "runs": [{"run_id": run} for run in row.runs]})
    algorithms = [{"algorithm_id": f"alg_{x}", "should_run": [x != "P"]} for x in "FOP"]
    settings = {"input_settings": {"input_dir": "in", "datasets": datasets, "algorithms": algorithms},
                "output_settings": {"output_dir": "out"}}
    return settings, root


@query("evaluate_config", with_fixtures(ev.ALL, ev.area_ctes(), f"""SELECT {K}, metric, value, 'the ' || dataset_id AS nickname FROM (
       SELECT {K}, 'auprc' AS metric, ROUND(auprc, 6) + 0.0 AS value FROM areas UNION ALL SELECT {K}, 'auroc', ROUND(auroc, 6) + 0.0 FROM areas
       UNION ALL SELECT {K}, 'cpu_time', CAST(COUNT(*) AS DOUBLE) + 0.5 FROM fx_edges GROUP BY {K}) q WHERE algorithm_id <> 'alg_P'"""))
def evaluate_config(spark, sf):
    """Areas and CPU time of a benchmark of files, as its configuration selects them."""
    settings, root = _written_benchmark(spark, sf)
    values = benchmark.evaluate_config(spark, settings, ["areas", "cpu_time"], root, "part-*", "part-*")
    named = benchmark.nicknamed(values, config.load_config(spark, settings, root).datasets)
    return named.withColumn("value", r6("value"))
