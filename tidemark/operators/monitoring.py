"""Counters and histograms as dashboards read them: rates over sliding ranges, quantiles from cumulative buckets.

A counter is a table of samples (series, time, value) whose value grows until its process restarts. A cumulative
histogram is a counter for each upper bound ``le``, the last of them infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples further from an end of the range than so many mean distances do not reach it.
REACH = 1.1


def increase(value: Column, before: Column) -> Column:
    """What a counter has grown by between two samples; after a restart it has grown from 0."""
    return F.when(value < before, value).otherwise(value - before)


def counter_rate(samples: DataFrame, by: list[str], range_ms: int, step_ms: int, ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """(by..., at_ms, samples, increase, per_second) of each series at each multiple of ``step_ms`` with samples in the range before it.

    The range ends at ``at_ms``, included, and is open at its other end. The increase is what the samples in it show, restarts
    taken into account. The rate carries it on to the range's ends, but not further than half the mean distance of the
    samples where an end lies beyond ``REACH`` of it, nor to before the counter would have been 0. One sample has no rate: null.
    Of samples of one time the largest counts; null and NaN values and null times are left out.

    Samples are first brought together in cells of one step, of which a range has ``range_ms / step_ms``; only these rows,
    not samples, are repeated for the ranges that they are in. A cell's samples are sorted, never collected.
    """
    if range_ms % step_ms:
        raise ValueError("the range must be a multiple of the step")
    kept = samples.filter(F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = _cells(kept, by, step_ms, ts, {"v": value})
    long = cells.select(*by, "_cell", "_n", *(F.struct(f"{end}._t", F.col(f"{end}.v").alias("_v")).alias(end) for end in ("_first", "_last")), F.col("_grown_v").alias("_grown"))
    return _rates(long, by, range_ms, step_ms)


def _cells(samples: DataFrame, by: list[str], step_ms: int, ts: str, values: dict[str, str]) -> DataFrame:
    """(by..., _cell, _first, _last, _n, _grown_<name>...) of counters (name -> column) that are sampled together.

    Of the samples of a cell its first and last (_t and the counters by name), their number, and what each counter grew by between them.
    Samples of one time are brought together in the order of the cell, as a table of nearly all samples by time would fill a task's memory.
    """
    rows = samples.select(*by, F.col(ts).cast("long").alias("_t"), *(F.col(c).cast("double").alias(name) for name, c in values.items()))
    rows = rows.withColumn("_cell", F.ceil(F.col("_t") / F.lit(step_ms)))  # ends at _cell * step, included
    inside = Window.partitionBy(*by, "_cell").orderBy("_t")
    together = inside.rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.select(*by, "_cell", "_t", F.lag("_t").over(inside).alias("_before"), *(F.max(name).over(together).alias(name) for name in values))
    rows = rows.filter(F.col("_before").isNull() | (F.col("_before") < F.col("_t")))
    rows = rows.withColumns({f"_grown_{name}": F.coalesce(increase(F.col(name), F.lag(name).over(inside)), F.lit(0.0)) for name in values})
    at = lambda f, name: f(F.struct("_t", *values)).alias(name)
    return rows.groupBy(*by, "_cell").agg(at(F.min, "_first"), at(F.max, "_last"), F.count("*").alias("_n"), *(F.sum(f"_grown_{name}").alias(f"_grown_{name}") for name in values))


def _rates(by_cell: DataFrame, by: list[str], range_ms: int, step_ms: int) -> DataFrame:
    """``counter_rate`` from the cells of each series, which have at most one row each."""
    cells, seconds = range_ms // step_ms, 1000.0
    spread = by_cell.withColumn("_at", F.explode(F.sequence(F.col("_cell"), F.col("_cell") + (cells - 1))))
    ranges = spread.groupBy(*by, "_at").agg(F.array_sort(F.collect_list(F.struct("_cell", "_first", "_last", "_grown", "_n"))).alias("_cells"))  # at most ``cells``
    between = F.aggregate(
        F.sequence(F.lit(2), F.size("_cells")),
        F.lit(0.0),
        lambda s, i: s + F.when(i <= F.size("_cells"), increase(F.element_at("_cells", i)["_first"]["_v"], F.element_at("_cells", F.greatest(i - 1, F.lit(1)))["_last"]["_v"])).otherwise(0.0),
    )
    between = F.when(F.size("_cells") > 1, between).otherwise(F.lit(0.0))
    total = F.aggregate("_cells", F.lit(0.0), lambda s, c: s + c["_grown"]) + between
    n = F.aggregate("_cells", F.lit(0).cast("long"), lambda s, c: s + c["_n"])
    found = ranges.select(
        *by,
        (F.col("_at") * step_ms).alias("at_ms"),
        n.alias("samples"),
        total.alias("increase"),
        F.element_at("_cells", 1)["_first"].alias("_first"),
        F.element_at("_cells", -1)["_last"].alias("_last"),
    )
    first, last = F.col("_first._t") / seconds, F.col("_last._t") / seconds
    covered = last - first
    mean = covered / (F.col("samples") - 1)
    to_start = first - (F.col("at_ms") - range_ms) / seconds
    to_start = F.when(to_start >= REACH * mean, mean / 2).otherwise(to_start)
    to_zero = F.when((F.col("increase") > 0) & (F.col("_first._v") >= 0), covered * (F.col("_first._v") / F.when(F.col("increase") > 0, F.col("increase"))))
    to_start = F.least(to_start, to_zero)
    to_end = F.col("at_ms") / seconds - last
    to_end = F.when(to_end >= REACH * mean, mean / 2).otherwise(to_end)
    rate = F.col("increase") * ((covered + to_start + to_end) / covered) / (range_ms / seconds)
    return found.select(*by, "at_ms", "samples", "increase", F.when(F.col("samples") > 1, rate).alias("per_second"))


def bucket_quantile(q: float, buckets: Column, total: Column) -> Column:
    """The ``q`` quantile of a sorted array of (le, n), n at or below each bound and ``total`` the largest n, interpolated within its bucket.

    The lowest bucket begins at 0, or is its own bound where that is not positive. In the infinite bucket the quantile is the
    highest finite bound. Counts that fall, as rates may by rounding, count as the largest before them. Null without an infinite bucket, without
    a finite one, or if nothing was counted; minus infinity for q below 0, infinity above 1. One fold over the buckets.
    """
    if q < 0 or q > 1:
        return F.lit(float("-inf") if q < 0 else float("inf"))
    rank = F.lit(q) * total

    def step(acc: Column, b: Column) -> Column:
        n = F.greatest(acc["n"], b["n"])
        low = F.when(acc["i"] == 0, F.lit(0.0)).otherwise(acc["le"])
        inside = low + (b["le"] - low) * ((rank - acc["n"]) / F.nullif(n - acc["n"], F.lit(0.0)))
        here = F.when(b["le"] == float("inf"), acc["le"]).when((acc["i"] == 0) & (b["le"] <= 0), b["le"]).otherwise(F.coalesce(inside, low))
        value = F.when(acc["value"].isNotNull(), acc["value"]).when(n >= rank, here)
        return F.struct(b["le"].alias("le"), n.alias("n"), value.alias("value"), (acc["i"] + 1).alias("i"))

    start = F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("i"))
    found = F.aggregate(buckets, start, step, lambda acc: F.when((acc["i"] > 1) & (acc["le"] == float("inf")), acc["value"]))
    return F.when(total > 0, found)


def quantiles_over_ranges(samples: DataFrame, by: list[str], range_ms: int, step_ms: int, points: tuple[float, ...] = (0.5, 0.95, 0.99), le: str = "le", **columns: str) -> DataFrame:
    """(by..., at_ms, p50, ...): quantiles of what a cumulative histogram's counters gained in each range.

    A null ``le`` is infinite. ``by`` names what tells histograms apart, without ``le``.
    """
    bounded = samples.withColumn("_le", F.coalesce(F.col(le).cast("double"), F.lit(float("inf"))))
    return _quantiles(counter_rate(bounded, [*by, "_le"], range_ms, step_ms, **columns), by, points)


def quantiles_of_histograms(samples: DataFrame, by: list[str], bounds: dict[str, float], range_ms: int, step_ms: int, points: tuple[float, ...] = (0.5, 0.95, 0.99), ts: str = "ts_ms") -> DataFrame:
    """The same where a sample has all of its histogram's counters as columns (name -> upper bound), none of them null.

    Samples stay one row each until they are brought together in cells; only cells become a row for each bound.
    """
    if range_ms % step_ms:
        raise ValueError("the range must be a multiple of the step")
    cells = _cells(samples.filter(F.col(ts).isNotNull()), by, step_ms, ts, {name: name for name in bounds})
    of = lambda end, name: F.struct(f"{end}._t", F.col(f"{end}.{name}").alias("_v")).alias(end)
    each = F.array(*(F.struct(F.lit(float(le)).alias("_le"), of("_first", name), of("_last", name), F.col(f"_grown_{name}").alias("_grown")) for name, le in bounds.items()))
    long = cells.select(*by, "_cell", "_n", F.inline(each))
    return _quantiles(_rates(long, [*by, "_le"], range_ms, step_ms), by, points)


def _quantiles(rates: DataFrame, by: list[str], points: tuple[float, ...]) -> DataFrame:
    rates = rates.filter("per_second IS NOT NULL")
    buckets = F.array_sort(F.collect_list(F.struct(F.col("_le").alias("le"), F.col("per_second").alias("n"))))  # a row for each bound
    grouped = rates.groupBy(*by, "at_ms").agg(buckets.alias("_buckets"), F.max("per_second").alias("_total"))
    return grouped.select(*by, "at_ms", *(bucket_quantile(p, F.col("_buckets"), F.col("_total")).alias(f"p{100 * p:g}".replace(".", "_")) for p in points))
