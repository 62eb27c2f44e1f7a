"""CPU time of algorithms from timing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.schema import KEYS

# The two log fields.
USER = r"User time \(seconds\):\s+([\d.]+)"
SYSTEM = r"System time \(seconds\):\s+([\d.]+)"


def cpu_seconds(text: str = "text"):
    """User plus system seconds of one log; 0 when either field is missing.
    The last mention of a field counts."""

    def last(pattern):
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        return F.when(F.size(found) > 0, F.element_at(found, -1)).try_cast("double")

    return F.coalesce(last(USER) + last(SYSTEM), F.lit(0.0))


def cpu_time(timings: DataFrame, lists: DataFrame) -> DataFrame:
    """Metric `cpu_time`: seconds summed over the logs of a list, NULL without
    logs. `lists` (keys) names the algorithms of every run, with or without
    logs."""
    totals = timings.groupBy(*KEYS).agg(F.sum(cpu_seconds()).alias("value"))
    named = lists.select(*KEYS).union(totals.select(*KEYS)).distinct()
    return named.join(totals, KEYS, "left").select(
        *KEYS, F.lit("cpu_time").alias("metric"), "value"
    )
