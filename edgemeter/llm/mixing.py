"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0
(uniform) and 1 (as found). The exponent is searched so that the entropy of the
weights reaches a target, but is never so low that a source would be repeated
more often than allowed. The budget is set so that the least sampled source is
read once: no document is lost, smaller sources are repeated.

A source's epochs are realised as whole copies plus a fraction. For the fraction
the source's documents are dealt to blocks, the blocks are permuted, and blocks
are taken until their tokens fill the fraction; the block that crosses it is cut
by a permutation of its documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.functions.ranking import cumulate
from edgemeter.llm.storage import staged, unused

BLOCK_DOCS = 64
SECTIONS = 16
PASSES = 7


@dataclass(frozen=True)
class Mixture:
    exponent: float
    norm: float  # sum of share ** exponent
    tokens: float  # all tokens
    least: float  # smallest weight / share


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))
    return F.when(body == "", 0).otherwise(spaces + 1).cast("long")


def find_mixture(totals: DataFrame, target_entropy: float, max_repeats: float) -> Mixture:
    """Exponent for (source, tokens > 0); only sums over sources reach the driver.

    `target_entropy` is a share of the largest possible entropy. Each pass cuts
    the interval that holds the exponent into SECTIONS parts, in one job.
    """
    facts = totals.agg(
        F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n"),
        F.min("tokens").alias("low"), F.max("tokens").alias("high"),
    ).first()
    if not facts["n"]:
        return Mixture(1.0, 1.0, 0.0, 1.0)
    everything = float(facts["all"])
    share = F.col("tokens") / F.lit(everything)
    spread = math.log(facts["high"] / facts["low"])
    floor = max(0.0, 1 - math.log(max_repeats) / spread) if spread > 0 else 0.0

    def entropies(exponents: list[float]) -> list[float]:
        sums = []
        for i, a in enumerate(exponents):
            power = F.pow(share, F.lit(a))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"l{i}")]
        row = totals.agg(*sums).first()
        return [math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"]
                for i, a in enumerate(exponents)]

    goal = target_entropy * math.log(facts["n"])
    low, high = floor, 1.0
    at_low, at_high = entropies([low, high])
    if at_high >= goal:
        low = high  # as found, the sources are even enough
    elif at_low > goal:
        for _ in range(PASSES):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            found = entropies(grid)
            last = max(i for i, h in enumerate(found[:-1]) if i == 0 or h >= goal)
            low, high = grid[last], grid[last + 1]
    row = totals.agg(F.sum(F.pow(share, F.lit(low))).alias("z")).first()
    least = (facts["high"] / everything) ** (low - 1) / row["z"]
    return Mixture(low, float(row["z"]), everything, least)


def mix(
    docs: DataFrame,
    target_entropy: float = 0.9,
    max_repeats: float = 2.0,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, tokens, copies, block) of every row: how often to read it.

    Every row is read at least once. A null source is a source of its own; a
    source without tokens, and null or empty texts, are read as they are found.
    Rows repeated under one id share their place in the permutations.
    """
    rows = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_tokens(F.col(text_col)).alias("tokens"),
        ),
        "tokens",
    )
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("name")
    rows = rows.withColumn("name", name)
    totals = staged(
        rows.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")),
        "sources",
    )
    found = find_mixture(totals.filter("tokens > 0"), target_entropy, max_repeats)
    share = F.col("tokens") / F.lit(max(found.tokens, 1.0))
    epochs = F.when(
        F.col("tokens") > 0,
        F.pow(share, F.lit(found.exponent - 1)) / F.lit(found.norm * found.least),
    ).otherwise(F.lit(1.0))
    epochs = F.greatest(F.lit(1.0), F.round(epochs, 9))
    plan = totals.select(
        "name",
        F.floor(epochs).cast("int").alias("whole"),
        F.floor((epochs - F.floor(epochs)) * F.col("tokens")).cast("long").alias("extra"),
        F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"),
    )
    dealt = rows.join(plan, "name").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks"))
    )
    sums = dealt.groupBy("name", "block").agg(
        F.sum("tokens").alias("size"), F.first("extra").alias("extra")
    )
    # The permutation of the blocks: totals of their order, by ranges, as a source may have many.
    sums = cumulate(
        staged(sums.withColumn("turn", F.xxhash64(F.lit(seed + 1), "name", "block")), "blocks"),
        ["name"], "turn", ["size"], descending=False,
    ).select("name", "block", "size", (F.col("extra") - F.col("cum_size") + F.col("size")).alias("left"))
    placed = dealt.drop("extra").join(sums, ["name", "block"])
    inside = Window.partitionBy("name", "block").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id")
    filled = F.sum("tokens").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    more = (
        F.when(F.col("left") <= 0, 0)
        .when(F.col("left") >= F.col("size"), 1)
        .otherwise((filled <= F.col("left")).cast("int"))
    )
    return placed.select(
        "doc_id", "source", "tokens", (F.col("whole") + more).alias("copies"), "block"
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns, as often as `mix` says."""
    key, n, nth = (unused(docs, c) for c in ("_id", "_copies", "_nth"))
    copies = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n))
    copies = copies.filter(F.col(key).isNotNull() & (F.col(n) > 1))
    joined = docs.join(copies, docs[id_col].cast("long") == F.col(key), "left")
    each = F.explode(F.sequence(F.lit(1), F.coalesce(n, F.lit(1))))
    return joined.withColumn(nth, each).drop(key, n, nth)
