"""Lines and CSV records of files with their exact numbers, over file splits.

A file is read in splits by many tasks. A line's number is its place in its split plus the lines of the splits before, which
is a running sum over one row for each split. Whether a line begins a CSV record depends on the quotes before it,
in the same way: each split counts the lines that would begin one if it began outside quotes, and if inside; a running
parity over the splits tells which it was.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import settled

PLACE = ("file", "row", "payload")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value, quotes): written once, so that the splits stay as they are."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    return settled(read.withColumn("quotes", odd), "lines")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, payload): every line of the files and its number, from 1."""
    lines = _lines(spark, path)
    sizes = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file", "split", before.alias("before"))  # a row for each split
    inside = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    return lines.withColumn("inside", inside).join(sizes, ["file", "split"]).select("file", (F.col("before") + F.col("inside")).alias("row"), F.col("value").alias("payload"))


def _records(lines: DataFrame) -> DataFrame:
    """(file, record, text): CSV records, numbered from 0 in each file; blank lines between records are none."""
    inside = Window.partitionBy("file", "split").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    marked = lines.withColumns({"odd": before, "blank": F.trim("value") == ""})
    begins = lambda entered: ((F.col("odd") + entered) % 2 == 0) & ~F.col("blank")
    splits = marked.groupBy("file", "split").agg((F.sum("quotes") % 2).alias("parity"), F.count_if(begins(F.lit(0))).alias("outside"), F.count_if(begins(F.lit(1))).alias("within"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("entered", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("starts", F.when(F.col("entered") == 0, F.col("outside")).otherwise(F.col("within")))
    splits = splits.select("file", "split", "entered", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("records"))
    rows = marked.join(splits, ["file", "split"]).withColumn("begins", begins(F.col("entered")))
    rows = rows.filter(~F.col("blank") | ((F.col("odd") + F.col("entered")) % 2 == 1))
    number = F.col("records") + F.sum(F.col("begins").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumn("record", number)
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "value")))  # the lines of one record
    return rows.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text"))


def numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files with one header, all as text, with (file, row, payload) of each.

    ``row`` counts records as a spreadsheet would, the header being 1, whatever line breaks stand in quoted cells; blank
    lines between records do not count. A quote is doubled to stand in a quoted cell. Cells beyond the header are left out,
    missing ones are null. A column that is named again gets a number. Files of different headers, and a quote that is
    never closed, are errors. No file or no record: no rows, and no columns but the place.
    """
    lines = _lines(spark, path)
    if not lines.groupBy("file").agg((F.sum("quotes") % 2).alias("open")).filter("open = 1").isEmpty():
        raise ValueError("a quoted cell has no end")
    records = settled(_records(lines), "records")
    heads = [r.text for r in records.filter("record = 0").select("text").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("the files have different headers")
    names: list[str] = []
    for name in next(csv.reader([heads[0].removeprefix("﻿")]), []) if heads else []:
        n = sum(x == name or x.startswith(f"{name}.") for x in names)
        names.append(f"{name}.{n}" if name in names else name or f"column {len(names)}")
    rows = records.filter("record > 0").select("file", (F.col("record") + 1).alias("row"), F.col("text").alias("payload"))
    if not names:
        return rows.withColumnsRenamed({c: f"_{c}" for c in PLACE})
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("payload", F.lit(schema), {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\u0000"})
    parsed = rows.withColumn("cells", cells)
    return parsed.select(*(F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)), *(F.col(c).alias(f"_{c}") for c in PLACE))
