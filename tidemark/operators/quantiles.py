"""Exact quantiles of few, large groups, without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
SMALL = 10 * ACCURACY  # beyond, a bracket is wider than the sketch's error by several ranks


def exact_quantiles(rows: DataFrame, value: str, by: list[str], points: tuple[float, ...]) -> DataFrame:
    """(by..., q0, q1, ...): for each point the quantile with linear interpolation between the two nearest ranks.

    A sketch of bounded size, whose rank is off by at most 1 / ``ACCURACY`` of the rows, brackets each
    quantile; the rows below the bracket are counted, and only the distinct values inside, about
    four in ``ACCURACY`` of the rows, are ordered. Up to ``SMALL`` rows all of a group's values are inside. ``by`` has few groups, or is empty; they are broadcast,
    a row for each. Null values and NaN are left out; a group without values has nulls.
    """
    by_name = by or ["_all"]
    data = rows.select(*by, F.col(value).cast("double").alias("_v")) if by else rows.select(F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v"))
    data = data.filter("_v IS NOT NULL AND NOT isnan(_v)")
    slack = 2 / ACCURACY
    cuts = [0.0, 1.0, *(c for p in points for c in (max(0.0, p - slack), min(1.0, p + slack)))]
    sketch = data.groupBy(*by_name).agg(F.percentile_approx("_v", F.array(*map(F.lit, cuts)), ACCURACY).alias("_cuts"), F.count("*").alias("_n"))
    names = [f"_key{i}" for i in range(len(by_name))]
    bounds = F.broadcast(sketch.select(*(F.col(k).alias(n) for k, n in zip(by_name, names, strict=True)), "_cuts", "_n"))  # a row for each group
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by_name, names, strict=True)]
    placed = data.join(bounds, same)
    few = F.col("_n") <= SMALL
    low = lambda i: F.when(few, F.col("_cuts")[0]).otherwise(F.col("_cuts")[2 * i + 2])
    high = lambda i: F.when(few, F.col("_cuts")[1]).otherwise(F.col("_cuts")[2 * i + 3])
    below = placed.groupBy(*by_name).agg(F.first("_n").alias("_n"), *(F.count_if(F.col("_v") < low(i)).alias(f"_below{i}") for i in range(len(points))))
    which = F.array_compact(F.array(*[F.when((F.col("_v") >= low(i)) & (F.col("_v") <= high(i)), F.lit(i)) for i in range(len(points))]))
    inside = placed.select(*by_name, "_v", F.explode(which).alias("_i")).groupBy(*by_name, "_i", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by_name, "_i").orderBy("_v"))
    ranked = inside.withColumn("_upto", upto).join(F.broadcast(below.withColumnsRenamed(dict(zip(by_name, names, strict=True)))), same)
    measures = []
    for i, p in enumerate(points):
        rank = F.lit(p) * (F.col("_n") - 1)
        # The value of rank r (from 0) is the least one with more than r rows up to it.
        at = lambda r, i=i: F.min(F.when((F.col("_i") == i) & (F.col(f"_below{i}") + F.col("_upto") > r), F.col("_v")))
        a, b, part = at(F.floor(rank)), at(F.ceil(rank)), F.first(rank - F.floor(rank))
        measures.append((a + (b - a) * part).alias(f"q{i}"))
    found = ranked.groupBy(*by_name).agg(*measures)
    return found if by else found.drop("_all")
