"""Benchmark-shaped inputs derived from the driver's tables.

Each body is SQL that Spark and DuckDB read alike, so a query and its check
start from the same rows. `trade` links nations over order lines; `supply`
links the suppliers of consecutive lines of an order and grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgemeter.functions.joins import spread_by
from edgemeter.functions.ranking import place_ranges, read_places
from edgemeter.schema import KEYS, PAIR
from edgemeter.session import scratch_path

BASE_TABLES = ["lineitem", "orders", "customer", "supplier", "part", "events", "embeddings"]

BODIES = {
    "fx_links": """
SELECT 'trade' AS dataset_id, l.l_returnflag AS run, o.o_orderstatus AS algo,
       'G'||CAST(s.s_nationkey AS VARCHAR(10)) AS gene1, 'G'||CAST(c.c_nationkey AS VARCHAR(10)) AS gene2,
       SUM(CAST(l.l_quantity AS BIGINT)) AS qty
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey
     JOIN supplier s ON l.l_suppkey=s.s_suppkey
GROUP BY l.l_returnflag, o.o_orderstatus, s.s_nationkey, c.c_nationkey
UNION ALL
SELECT 'supply' AS dataset_id, a.l_returnflag AS run, o.o_orderstatus AS algo,
       'S'||CAST(a.l_suppkey AS VARCHAR(10)) AS gene1, 'S'||CAST(b.l_suppkey AS VARCHAR(10)) AS gene2,
       SUM(CAST(a.l_quantity AS BIGINT)) AS qty
FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1
     JOIN orders o ON a.l_orderkey=o.o_orderkey
GROUP BY a.l_returnflag, o.o_orderstatus, a.l_suppkey, b.l_suppkey""",
    "fx_ground_truth": """
SELECT dataset_id, gene1, gene2, CASE WHEN SUM(qty) % 2 = 0 THEN '+' ELSE '-' END AS type
FROM fx_links GROUP BY dataset_id, gene1, gene2 HAVING SUM(qty) % 7 = 0""",
    "fx_edges_raw": """
SELECT dataset_id, 'run_'||run AS run_id, 'alg_'||algo AS algorithm_id, gene1, gene2,
       CASE WHEN dataset_id = 'trade' THEN CAST(qty % 21 - 10 AS DOUBLE) / 10
            ELSE CAST((qty * 37) % 401 - 200 AS DOUBLE) / 100 END AS weight
FROM fx_links""",
    "fx_edges": """
SELECT dataset_id, run_id, algorithm_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id, run_id, algorithm_id ORDER BY ABS(weight) DESC, gene1, gene2) - 1 AS BIGINT) AS ord,
       gene1, gene2, weight
FROM fx_edges_raw""",
    "fx_edges_unsorted": """
SELECT dataset_id, run_id, algorithm_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id, run_id, algorithm_id ORDER BY gene1, gene2) - 1 AS BIGINT) AS ord,
       gene1, gene2, weight
FROM fx_edges_raw""",
    "fx_edges_dup": """
SELECT dataset_id, run_id, algorithm_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id, run_id, algorithm_id ORDER BY ABS(weight) DESC, weight, gene1, gene2, copy) - 1 AS BIGINT) AS ord,
       gene1, gene2, weight
FROM (SELECT dataset_id, run_id, algorithm_id, gene1, gene2, weight, 0 AS copy FROM fx_edges_raw
      UNION ALL
      SELECT dataset_id, run_id, algorithm_id, gene1, gene2, -weight / 2 AS weight, 1 AS copy FROM fx_edges_raw WHERE algorithm_id = 'alg_F') u""",
    "fx_expression": """
SELECT 'ev' AS dataset_id, 'r1' AS run_id, event_type||'_'||CAST(event_id % 8 AS VARCHAR(10)) AS gene,
       CAST(user_id AS VARCHAR(20)) AS cell, CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) AS DOUBLE)/100 AS value
FROM events GROUP BY event_type, event_id % 8, user_id""",
    "fx_pseudotime": """
SELECT 'ev' AS dataset_id, 'r1' AS run_id, CAST(user_id AS VARCHAR(20)) AS cell,
       CAST(user_id % 2 AS INT) AS trajectory, CAST(MIN(event_id) AS DOUBLE) AS t
FROM events GROUP BY user_id""",
    "fx_gene_ordering": """
SELECT 'parts' AS dataset_id, p_brand||'/'||p_type AS gene, CAST(1 AS DOUBLE) / COUNT(*) / SUM(p_size) AS pvalue,
       CAST(SUM(p_size * p_size) AS DOUBLE) AS variance
FROM part GROUP BY p_brand, p_type""",
    "fx_matrix": """
SELECT 'parts' AS dataset_id, 'r1' AS run_id, p.p_brand||'/'||p.p_type AS gene, CAST(l.l_suppkey AS VARCHAR(20)) AS cell,
       CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS DOUBLE) AS value
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_brand, p.p_type, l.l_suppkey""",
}

NEEDS = {
    "fx_ground_truth": ["fx_links"],
    "fx_edges_raw": ["fx_links"],
    "fx_edges": ["fx_edges_raw"],
    "fx_edges_unsorted": ["fx_edges_raw"],
    "fx_edges_dup": ["fx_edges_raw"],
}

# The lists whose `ord` is a row number over a whole list: their rows and the
# order. Spark numbers them without a window, which would sort a list in one task.
_COPIES = BODIES["fx_edges_dup"].partition("FROM (")[2].removesuffix(") u")
PLACED = {
    "fx_edges": ("SELECT * FROM fx_edges_raw", ["ABS(weight) DESC", *PAIR]),
    "fx_edges_unsorted": ("SELECT * FROM fx_edges_raw", PAIR),
    "fx_edges_dup": (_COPIES, ["ABS(weight) DESC", "weight", *PAIR, "copy"]),
}


def _links(spark: SparkSession) -> DataFrame:
    """The rows of `fx_links` from one shuffle of the order lines.

    The SQL joins the lines three times. Here a frame over the lines of an order
    finds the suppliers of the next line, nations come as arrays with the orders
    and suppliers, and a line unfolds into its `trade` and `supply` links, which
    are grouped by their numbers. Repeated keys multiply rows as joins do.
    """
    def nations(table, key, nation, name):
        rows = spark.table(table).filter(F.col(key).isNotNull())
        return rows.groupBy(key).agg(F.collect_list(F.struct(F.col(nation).cast("long").alias("k"))).alias(name))

    # RANGE takes every line with the next number; a struct keeps a NULL supplier.
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    lines = spark.table("lineitem").filter(F.col("l_orderkey").isNotNull()).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("qty")
    )
    following = F.collect_list(F.struct(F.col("l_suppkey").cast("long").alias("k"))).over(after)
    lines = spread_by(lines, "l_orderkey").withColumn("_next", F.when(F.col("l_linenumber").isNotNull(), following)).drop("l_linenumber")
    orders = spark.table("orders").filter(F.col("o_orderkey").isNotNull()).select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )
    bought = orders.join(
        nations("customer", "c_custkey", "c_nationkey", "_to"), F.col("o_custkey") == F.col("c_custkey"), "left"
    ).select("o_orderkey", "o_orderstatus", "_to")
    rows = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(
        nations("supplier", "s_suppkey", "s_nationkey", "_from"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
    )

    def link(kind, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    trade = F.flatten(F.transform("_from", lambda s: F.transform("_to", lambda c: link("trade", s["k"], c["k"]))))
    supply = F.transform("_next", lambda n: link("supply", F.col("l_suppkey").cast("long"), n["k"]))
    none = F.array().cast("array<struct<kind:string,a:bigint,b:bigint>>")
    links = F.concat(F.coalesce(trade, none), F.coalesce(supply, none))
    summed = rows.select("l_returnflag", "o_orderstatus", "qty", F.inline(links)).groupBy(
        "kind", "l_returnflag", "o_orderstatus", "a", "b"
    ).agg(F.sum("qty").alias("qty"))
    letter = F.when(F.col("kind") == "trade", "G").otherwise("S")
    return summed.select(
        F.col("kind").alias("dataset_id"), F.col("l_returnflag").alias("run"), F.col("o_orderstatus").alias("algo"),
        *[F.concat(letter, F.col(c).cast("string")).alias(g) for c, g in zip("ab", PAIR)], "qty",
    )


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def with_fixtures(names: list[str], ctes: dict[str, str] | None = None, body: str = "") -> str:
    """A WITH query over the named fixtures, further CTEs and a final select."""
    parts = [f"{n} AS ({BODIES[n]})" for n in _closure(names)]
    parts += [f"{n} AS ({sql})" for n, sql in (ctes or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


_STAGED: dict[tuple[str, str, str], str] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input as a Parquet table in the shared folder, written once
    per application; edge lists usually arrive as tables, not as joins."""
    if name == "fx_edges_raw":  # only renames and divides, so it is not stored again
        fixture(spark, sf_dir, "fx_links").createOrReplaceTempView("fx_links")
        return spark.sql(BODIES[name])
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        for table in BASE_TABLES:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        for need in NEEDS.get(name, []):
            fixture(spark, sf_dir, need).createOrReplaceTempView(need)
        if name in PLACED:
            rows, order = PLACED[name]
            _STAGED[key] = place_ranges(spark.sql(rows), KEYS, order)
        else:
            table = _links(spark) if name == "fx_links" else spark.sql(BODIES[name])
            path = scratch_path(spark, name)
            table.write.parquet(path)
            _STAGED[key] = path
    if name in PLACED:
        return read_places(spark, _STAGED[key], KEYS, "ord").select(*KEYS, "ord", *PAIR, "weight")
    return spark.read.parquet(_STAGED[key])


def embedding_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense expression: gene = position in the vector, cell = vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(
        F.lit("emb").alias("dataset_id"),
        F.lit("r1").alias("run_id"),
        F.col("vec_id").cast("string").alias("cell"),
        F.posexplode("embedding").alias("_i", "_v"),
    ).select(
        "dataset_id", "run_id",
        F.concat(F.lit("d"), F.col("_i").cast("string")).alias("gene"), "cell",
        F.col("_v").cast("double").alias("value"),
    )


# The same rows for DuckDB.
EMBEDDING_SQL = """
SELECT 'emb' AS dataset_id, 'r1' AS run_id, 'd'||CAST(i - 1 AS VARCHAR) AS gene, CAST(vec_id AS VARCHAR) AS cell,
       CAST(v AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) t"""

__all__ = ["BODIES", "EMBEDDING_SQL", "embedding_expression", "fixture", "with_fixtures"]
