"""Running aggregates over a total order, without a window over the whole table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 2048
_WHOLE = {"max": F.max, "sum": F.sum}


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of the range, from 0, that a value of ``column`` lies in: ranges of about as many rows each, however the values lie.

    The cuts are quantiles from a sketch of one pass over the column, ``ranges`` numbers at most, and are kept in
    the expression, which searches them by halving. Equal values are in one range; null is before all others (-1).
    """
    kind = df.schema[column].dataType.simpleString()
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    found = df.agg(F.expr(f"percentile_approx(`{column}`, array({shares}), {max(10_000, 10 * ranges)})").alias("cuts")).first().cuts if shares else None
    cuts = sorted({c for c in found or [] if c == c})
    if not cuts:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    bounds = F.from_json(F.lit(json.dumps(cuts)), f"array<{kind}>")  # one constant
    at = F.aggregate(
        F.array(*[F.lit(1 << j) for j in reversed(range(len(cuts).bit_length()))]),
        F.lit(0),
        lambda n, step: F.when((n + step <= len(cuts)) & (F.element_at(bounds, F.least(n + step, F.lit(len(cuts)))) <= F.col(column)), n + step).otherwise(n),
    )
    return F.when(F.col(column).isNull(), -1).otherwise(at)


def running(df: DataFrame, measures: dict[str, tuple[str, Column]], order: str, tie: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """``df`` with running aggregates up to and with each row, in the order of ``order`` and ``tie``: name -> ("max" or "sum", expression).

    The order is cut into ranges of about as many rows each; what the ranges come to (``ranges`` rows) is accumulated and
    broadcast, the rest is a window within each range. A sum is 0, a maximum null before the first value that is there.
    """
    return running_in(df.withColumn("_range", range_of(df, order, ranges)), measures, "_range", (order, *tie)).drop("_range")


def running_in(df: DataFrame, measures: dict[str, tuple[str, Column]], ranges: str, order: tuple[str, ...]) -> DataFrame:
    """The same for rows that have the number of their range."""
    placed = df.withColumns({f"_of_{name}": value for name, (_, value) in measures.items()})
    tops = placed.groupBy(F.col(ranges).alias("_r")).agg(*[_WHOLE[how](f"_of_{name}").alias(f"_top_{name}") for name, (how, _) in measures.items()])
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_r", *[_WHOLE[how](f"_top_{name}").over(earlier).alias(f"_before_{name}") for name, (how, _) in measures.items()])
    inside = Window.partitionBy(ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(tops), placed[ranges] == tops["_r"], "left")  # a row for each range
    zero = F.lit(0).cast("long")
    both = {
        "max": lambda name: F.greatest(F.max(f"_of_{name}").over(inside), F.col(f"_before_{name}")),
        "sum": lambda name: F.coalesce(F.sum(f"_of_{name}").over(inside), zero) + F.coalesce(F.col(f"_before_{name}"), zero),
    }
    found = joined.withColumns({name: both[how](name) for name, (how, _) in measures.items()})
    return found.drop("_r", *(f"{p}_{name}" for name in measures for p in ("_of", "_before")))
