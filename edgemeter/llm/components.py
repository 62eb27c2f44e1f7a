"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.llm.storage import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each linked node.

    `links` holds pairs (a, b) of longs. Every round takes the smallest label
    of a node's neighbours and then follows labels once more, so distances
    halve; both joins read at most two rows per link and the minima are
    combined before the shuffle. Ends when nothing changes.
    """
    both = staged(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .filter("node <> other")
        .distinct(),
        "links",
    )
    labels = staged(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels"
    )
    while True:
        seen = both.join(
            labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other"
        )
        best = seen.groupBy("node").agg(F.min("near").alias("near"))
        moved = labels.join(best, "node").select(
            "node", F.least("label", "near").alias("next"), F.col("label").alias("was")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("over"))
        done = staged(
            moved.join(jump, "next", "left").select(
                "node", "was", F.least("next", F.coalesce("over", "next")).alias("label")
            ),
            "labels",
        )
        labels = done.select("node", "label")
        if done.filter("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
