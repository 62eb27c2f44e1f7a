"""Column names and schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["dataset_id", "run_id", "algorithm_id"]
PAIR = ["gene1", "gene2"]
CELL_KEYS = ["dataset_id", "run_id"]

EDGES = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [T.StructField("ord", T.LongType())]
    + [T.StructField(g, T.StringType()) for g in PAIR]
    + [T.StructField("weight", T.DoubleType())]
)
GROUND_TRUTH = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["dataset_id", *PAIR, "type"]]
)
EXPRESSION = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*CELL_KEYS, "gene", "cell"]]
    + [T.StructField("value", T.DoubleType())]
)
PSEUDOTIME = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*CELL_KEYS, "cell"]]
    + [T.StructField("trajectory", T.IntegerType()), T.StructField("t", T.DoubleType())]
)
METRIC = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*KEYS, "metric"]]
    + [T.StructField("value", T.DoubleType())]
)
