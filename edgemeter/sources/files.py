"""Helpers for files whose path carries the keys."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgemeter.functions.joins import salted_join

MISSING = ["", "NA", "NaN", "nan", "null", "None"]


def path_parts(names: list[str], levels_above: int) -> dict[str, Column]:
    """Columns from the directories of the file: `names` are consecutive
    directories, the last one `levels_above` levels over the file. Plain and
    `key=value` directory names both work."""
    path = F.try_url_decode(F.replace(F.col("_path"), F.lit("+"), F.lit("%2B")))
    steps = F.split(path, "/")
    out = {}
    for i, name in enumerate(reversed(names)):
        step = F.element_at(steps, -(levels_above + 1 + i))
        out[name] = F.regexp_replace(step, f"^{name}=", "")
    return {n: out[n] for n in names}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_path, _start, _seq, value): lines with their place in the file. No
    matching file gives no line."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "_path string, _start long, _seq long, value string")
    return lines.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )


def fields(line: str, sep: str) -> Column:
    """Fields of a delimited line; quoted ones may hold the separator and
    doubled quotes."""
    mark = re.escape(sep)
    quoted = F.regexp_extract_all(
        F.col(line), F.lit(f'(?:^|{mark})("(?:[^"]|"")*"|[^{mark}]*)'), F.lit(1)
    )
    bare = lambda x: F.when(
        x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
    ).otherwise(F.trim(x))
    plain = F.transform(F.split(F.col(line), mark), lambda x: F.trim(x))
    return F.when(F.col(line).contains('"'), F.transform(quoted, bare)).otherwise(plain)


def body_lines(spark: SparkSession, path: str, heading: dict[str, Column]) -> DataFrame:
    """(_path, _start, _seq, value, heading): the lines after the first of each
    file, with the columns that `heading` takes from that first line, `_header`.
    Empty lines are left out.

    A header is parsed once per file, from the split at byte 0, where every first
    line begins. The table of headings has a row per file; the lines of a large
    file spread over all partitions unless it is small enough to broadcast.
    """
    lines = text_lines(spark, path)
    place = F.struct("_start", "_seq")
    headers = lines.filter(F.col("_start") == 0).groupBy("_path").agg(
        F.min_by("value", place).alias("_header"), F.min(place).alias("_first")
    ).select("_path", "_first", *[column.alias(name) for name, column in heading.items()])
    joined = salted_join(lines.filter(F.length("value") > 0), headers, ["_path"], ["_start", "_seq"])
    return joined.filter(place != F.col("_first")).drop("_first")


def melt_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(_path, row, position, column, token) of wide delimited files.

    Column 0 names the row. Lines stay arrays until the explode, so a file of
    a million columns never becomes a million-column plan. A line whose width
    does not fit the header fails.
    """
    cells = body_lines(spark, path, {"_h": fields("_header", sep)}).select(
        "_path", fields("value", sep).alias("_v"), "_h"
    )
    width = F.size("_v") - 1
    # A header may or may not name the row column.
    extra = F.size("_h") - width
    unfit = F.raise_error(F.concat(F.col("_path"), F.lit(": a line does not fit the header")))
    names = F.when(extra.isin(0, 1), F.slice("_h", extra + 1, width)).otherwise(unfit)
    return cells.select(
        "_path",
        F.col("_v")[0].alias("row"),
        F.posexplode(F.arrays_zip(names.alias("c"), F.slice("_v", 2, width).alias("t"))),
    ).select(
        "_path", "row", F.col("pos").alias("position"),
        F.col("col.c").alias("column"), F.col("col.t").alias("token"),
    )


def named_fields(
    spark: SparkSession, path: str, sep: str, wanted: dict[str, tuple[str, int | None]]
) -> DataFrame:
    """`body_lines` with columns from the fields of `value` by their header names;
    only the places of the names go with the lines.

    `wanted`: column -> (header name, its position in a header without any of
    the names; None if it is then absent). A name that is missing next to others gives NULL.
    """
    header = fields("_header", sep)
    known = F.arrays_overlap(header, F.array(*[F.lit(name) for name, _ in wanted.values()]))
    heading = {}
    for column, (name, fallback) in wanted.items():
        at = F.array_position(header, name)
        if fallback is not None:
            at = F.when(known, at).otherwise(F.lit(fallback + 1))
        heading[f"_at_{column}"] = at.cast("int")
    lines = body_lines(spark, path, heading).withColumn("_fields", fields("value", sep))
    found = {
        column: F.when(F.col(at) > 0, F.try_element_at("_fields", F.col(at)))
        for column, at in zip(wanted, heading, strict=True)
    }
    return lines.withColumns(found).drop("_fields", "value", *heading)


def number(token: str) -> Column:
    """Token as double; the usual missing-value marks become NULL."""
    return F.when(~F.col(token).isin(MISSING), F.expr(f"try_cast({token} AS double)"))


ROWS_PER_FILE = 65_536


def _quoted(column: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(
        text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(text)


def write_wide(
    rows: DataFrame, keys: list[str], row: str, column: str, value: str, root: str
) -> None:
    """One comma-separated matrix per `keys` below `root`/key=value/..., in
    part files of about ROWS_PER_FILE lines that each begin with the header.

    The mirror of `melt_csv`: lines are put together from arrays, so the number
    of columns is not limited by a plan; a line holds them all anyway.
    """
    order = Window.partitionBy(*keys).orderBy(column)
    columns = rows.select(*keys, column).distinct().withColumn("_at", F.row_number().over(order))
    headers = columns.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_at", _quoted(column).alias("_t")))).alias("_h")
    )
    headers = headers.select(
        *keys, F.size("_h").alias("_n"),
        F.concat_ws(",", F.lit(row), F.col("_h._t")).alias("_header"),
    )
    cells = rows.join(columns, [*keys, column]).groupBy(*keys, row).agg(
        F.array_sort(
            F.collect_list(F.struct("_at", F.col(value).cast("string").alias("_t")))
        ).alias("_c")
    )
    counts = cells.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).cast("int").alias("_parts"))
    # A row per matrix; the running total numbers the files of all of them.
    total = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = counts.join(headers, keys).withColumn("_first", F.sum("_parts").over(total) - F.col("_parts"))
    files = files.select(*keys, "_parts", "_header", "_n", F.col("_first").cast("int").alias("_first"))
    n_files = files.agg(F.sum("_parts")).first()[0] or 0
    if not n_files:
        return
    gaps = F.transform("_c", lambda x, i: F.concat(
        F.repeat(F.lit(","), x["_at"] - F.when(i > 0, F.get("_c", i - 1)["_at"]).otherwise(0)),
        F.coalesce(x["_t"], F.lit(""))))
    line = F.concat(
        _quoted(row), F.array_join(gaps, ""),
        F.repeat(F.lit(","), F.col("_n") - F.element_at("_c", -1)["_at"]),
    )
    body = salted_join(cells, files.drop("_header"), keys, [row]).select(
        *keys, line.alias("value"), F.lit(1).alias("_line"),
        (F.col("_first") + F.pmod(F.xxhash64(row), F.col("_parts"))).cast("int").alias("_file"),
    )
    heads = files.select(
        *keys, F.col("_header").alias("value"), F.lit(0).alias("_line"),
        F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)).alias("_file"),
    )
    placed = body.unionByName(heads).repartitionById(int(n_files), F.col("_file"))
    placed.sortWithinPartitions(*keys, "_line", "value").drop("_line", "_file").write.partitionBy(
        *keys
    ).text(root)
