"""Counts and audits of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n, pct) by descending count; ``top`` makes it a report of the most frequent values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("pct"))  # one row
    ordered = shares.orderBy(F.desc("n"), "value")
    return ordered.limit(top) if top else shares


def partition_offsets(bronze: DataFrame) -> DataFrame:
    """Smallest and largest offset and rows of each partition of the stream."""
    return bronze.groupBy("kafka_partition").agg(F.min("kafka_offset").alias("min_offset"), F.max("kafka_offset").alias("max_offset"), F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), a row for each column, from one aggregation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]))
    return counts.select(pairs.alias("p")).select("p.column", "p.nulls")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of their key."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def capped_histogram(df: DataFrame, column: str, quantile: float = 0.99, bins: int = 40) -> DataFrame:
    """(bin, lo, n) of the values up to the quantile, in equal bins; the last bin is closed."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    cap = exact_quantiles(values, "v", [], (quantile,)).withColumnRenamed("q0", "cap")
    kept = values.crossJoin(F.broadcast(cap)).filter("v <= cap").drop("cap")  # one row
    bounds = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = kept.crossJoin(F.broadcast(bounds))  # one row
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(bins - 1)))
    return rows.groupBy(at.alias("bin")).agg(F.min("v").alias("lo"), F.count("*").alias("n"))


def feature_summary(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, null_rate, mean, max), a row for each feature, from one aggregation."""
    measures = [m for f in names for m in (F.avg(F.col(f).isNull().cast("int")).alias(f"{f}__0"), F.avg(f).alias(f"{f}__1"), F.max(F.col(f).cast("double")).alias(f"{f}__2"))]
    wide = features.agg(*measures)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__0").alias("null_rate"), F.round(f"{f}__1", 6).alias("mean"), F.col(f"{f}__2").alias("max")) for f in names]))
    return wide.select(pairs.alias("p")).select("p.feature", "p.null_rate", "p.mean", "p.max")
