import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edgemeter import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lists(spark):
    """lists({"alg": [(g1, g2, w), ...]}) or {("run", "alg"): [...]} as edge rows."""

    def build(tables, dataset="d"):
        rows = []
        for key, edges in tables.items():
            run, algo = key if isinstance(key, tuple) else ("r1", key)
            rows += [(dataset, run, algo, i, a, b, float(w)) for i, (a, b, w) in enumerate(edges)]
        return spark.createDataFrame(rows, schema.EDGES)

    return build


@pytest.fixture
def truth(spark):
    """truth([(g1, g2), ...] or [(g1, g2, sign), ...]) as ground-truth rows."""

    def build(edges, dataset="d"):
        rows = [(dataset, e[0], e[1], e[2] if len(e) > 2 else None) for e in edges]
        return spark.createDataFrame(rows, schema.GROUND_TRUTH)

    return build


@pytest.fixture
def matrix(spark):
    """matrix(array, genes, cells): sparse expression rows of a dense array."""

    def build(values, genes=None, cells=None, dataset="d", run="r1", keep_zeros=False):
        genes = genes or [f"g{i:02d}" for i in range(values.shape[0])]
        cells = cells or [f"c{j:03d}" for j in range(values.shape[1])]
        rows = [
            (dataset, run, g, c, float(values[i, j]))
            for i, g in enumerate(genes)
            for j, c in enumerate(cells)
            if keep_zeros or values[i, j] != 0
        ]
        return spark.createDataFrame(rows, schema.EXPRESSION)

    return build
