"""Benchmark configuration as dimension tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

GROUND_TRUTH_FILE = "GroundTruthNetwork.csv"


@dataclass(frozen=True)
class Benchmark:
    """`datasets` (dataset_id, nickname, ground_truth), `runs` (dataset_id,
    run_id), `algorithms` (algorithm_id) and the two root folders."""

    datasets: DataFrame
    runs: DataFrame
    algorithms: DataFrame
    input_root: str
    output_root: str


def enabled(entry: Mapping[str, Any], default: bool) -> bool:
    """`should_run` may be a plain value or a one-element list."""
    flag = entry.get("should_run", default)
    return bool(flag[0]) if isinstance(flag, (list, tuple)) else bool(flag)


def list_directories(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the directories in `path`, on any Hadoop file system."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        raise FileNotFoundError(f"{path} is not a directory")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())


def discover_runs(spark: SparkSession, input_root: str, dataset: Mapping[str, Any]) -> list[str]:
    """Run ids of one dataset: its sub-directories when asked, else its list."""
    if not dataset.get("scan_run_subdirectories"):
        return [run["run_id"] for run in dataset.get("runs", [])]
    path = f"{input_root}/{dataset['dataset_id']}"
    found = list_directories(spark, path)
    if not found:
        raise RuntimeError(f"no run directories in {path}")
    return found


def load_config(spark: SparkSession, config: Mapping[str, Any], root: str = ".") -> Benchmark:
    """Enabled datasets, runs and algorithms of a parsed configuration.

    Datasets run unless switched off, algorithms only when switched on.
    """
    inputs, outputs = config["input_settings"], config["output_settings"]
    input_root = f"{root}/{inputs['input_dir']}"
    output_root = f"{root}/{outputs['output_dir']}"
    if outputs.get("experiment_id"):
        output_root = f"{output_root}/{outputs['experiment_id']}"
    chosen = [d for d in inputs.get("datasets", []) if enabled(d, True)]
    datasets = [
        (d["dataset_id"], d.get("nickname", d["dataset_id"]),
         d.get("groundTruthNetwork", GROUND_TRUTH_FILE))
        for d in chosen
    ]
    runs = [(d["dataset_id"], r) for d in chosen for r in discover_runs(spark, input_root, d)]
    algorithms = [
        (a["algorithm_id"],) for a in inputs.get("algorithms", []) if enabled(a, False)
    ]
    return Benchmark(
        spark.createDataFrame(datasets, "dataset_id string, nickname string, ground_truth string"),
        spark.createDataFrame(runs, "dataset_id string, run_id string"),
        spark.createDataFrame(algorithms, "algorithm_id string"),
        input_root,
        output_root,
    )
