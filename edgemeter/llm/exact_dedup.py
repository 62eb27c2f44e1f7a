"""Exact duplicates by a content sort, in DataFrame operations only.

Normalised texts are dealt to sampled ranges of their content and sorted there
(spilling to disk where needed), so equal texts stand next to each other; each
row is compared in full with its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm.storage import shuffle_partitions, staged, unused

HEAD_CHARS = 64


def normalized(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when they agree after `normalized`. Of equal texts the row
    with the smallest id stays; a null id counts as the largest, and of rows
    repeated under one id the first stays.

    The range key is the head of the text with a hash behind it, which keeps
    the sample that sets the ranges small whatever the texts' lengths. A text
    that fills more than a quarter of a mean partition is hot: its rows get a
    third key part, so its copies spread over several ranges. Their first rows
    are compared once more, one row per range.
    """
    n = shuffle_partitions(docs)
    text = normalized(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("body")).withColumn(
        "hash", F.xxhash64("body")
    )
    total = docs.count()
    hot_rows = max(2, total // (4 * n))
    # At most 4 * n texts can be hot: the broadcast is bounded by the partition count.
    hot = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter(
        F.col("copies") > hot_rows
    )
    hot = hot.select("hash", F.ceil(F.col("copies") / hot_rows).cast("int").alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).cast("int")
    spread = rows.join(F.broadcast(hot), "hash", "left").select(
        "doc_id", "body", "hash", F.substring("body", 1, HEAD_CHARS).alias("head"),
        salt.alias("salt"), F.col("salts").isNotNull().alias("is_hot"),
    )
    ranged = spread.repartitionByRange(n, "head", "hash", "salt")
    same = Window.partitionBy("head", "hash", "salt", "body")
    ordered = same.orderBy(F.col("doc_id").asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(ordered)
    found = staged(
        ranged.select(
            "doc_id", "hash", "salt", "is_hot", place.alias("place"),
            F.first("doc_id").over(whole).alias("first_id"),
            F.count(F.lit(1)).over(whole).alias("n"),
            F.sha2("body", 256).alias("text_sha256"),
            F.when(F.col("is_hot") & (place == 1), F.col("body")).alias("lead_body"),
        ),
        "ranged",
    )
    leads = found.filter(F.col("is_hot") & (F.col("place") == 1))
    merged = leads.groupBy("lead_body").agg(
        F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size")
    ).select(F.sha2("lead_body", 256).alias("text_sha256"), "keep_id", "group_size")
    # One row per hot text, so bounded like `hot`.
    out = found.join(F.broadcast(merged), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("is_hot"), F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
        "place", "first_id", "text_sha256",
    )
    kept = (F.col("place") == 1) & F.col("first_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of equal texts: the first by id, all columns."""
    row, nth = unused(docs, "_row"), unused(docs, "_nth")
    found = exact_duplicates(docs, id_col, text_col).filter("kept")
    key = lambda i, sha: F.concat_ws("|", i.cast("string"), sha).alias(row)
    stay = found.select(key(F.col("doc_id"), F.col("text_sha256")))
    own = F.sha2(normalized(F.col(text_col)), 256)
    named = docs.withColumn(row, key(docs[id_col], own)).join(stay, row, "left_semi")
    # Rows repeated under one id and text: the join has brought them together.
    first = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))
    return named.withColumn(nth, first).filter(F.col(nth) == 1).drop(row, nth)
