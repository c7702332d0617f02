"""Histograms of features, and the population-stability index against a baseline."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FEATURES
from ..sources.tables import settled
from .quantiles import ACCURACY, SMALL

BINS = 10
FLOOR = 1e-6
STABLE, RETRAIN = 0.10, 0.25


def psi_status(psi: Column) -> Column:
    return F.when(psi < STABLE, "stable").when(psi < RETRAIN, "moderate").otherwise("retrain")


@dataclass(frozen=True)
class _Summary:
    """What one side knows of a feature: a few numbers, whatever the number of rows."""

    n: int
    low: float
    high: float
    mean: float
    std: float
    cuts: tuple[float, float]
    bins: tuple[int, ...] = ()
    median: float | None = None


def _edges(low: float, high: float) -> list[float]:
    """Eleven edges of equal bins; a constant column is widened by a half on both sides."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / BINS
    return [*(low + i * step for i in range(BINS)), high]


def _bin(value: Column, edges: Column) -> Column:
    """Bins are half open, the last is closed; null outside the edges."""
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.least(F.size(F.filter(edges, lambda e: e <= value)) - 1, F.lit(BINS - 1)))


def _value(name: str) -> Column:
    """A feature's value; null for NaN."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _summaries(rows: DataFrame, names: list[str], edges: dict[str, list[float]] | None = None) -> dict[str, _Summary]:
    """A summary of each feature that has values, from three passes, whatever the number of features.

    The first takes bounds, moments and a sketch's bracket of the median; the second counts the bins, by the given edges or else the
    own ones, and what lies below the bracket; the third orders only the distinct values inside the bracket (all, of up to ``SMALL``).
    """
    slack = 2 / ACCURACY
    points = [0.0, 0.5 - slack, 0.5 + slack, 1.0]
    first = rows.agg(*[
        F.struct(F.count(v := _value(f)), F.min(v), F.max(v), F.avg(v), F.stddev_pop(v), F.percentile_approx(v, points, ACCURACY)).alias(f) for f in names
    ]).first()
    found = {}
    for f in names:
        n, low, high, mean, std, cuts = first[f]
        if n:
            found[f] = _Summary(n, low, high, mean, std, (cuts[0], cuts[3]) if n <= SMALL else (cuts[1], cuts[2]))
    if not found:
        return {}
    edges = edges or {f: _edges(s.low, s.high) for f, s in found.items()}
    own = {f: s for f, s in found.items() if f in edges}
    if not own:
        return {}
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), _value(f).alias("v")) for i, f in enumerate(own)]))).filter("v IS NOT NULL")
    of = lambda items: F.element_at(F.array(*items), F.col("i") + 1)
    low, high = (of([F.lit(s.cuts[k]) for s in own.values()]) for k in (0, 1))
    binned = each.groupBy("i", _bin(F.col("v"), of([F.array(*map(F.lit, edges[f])) for f in own])).alias("bin"))
    bins, below = [[0] * BINS for _ in own], [0] * len(own)
    for r in binned.agg(F.count("*").alias("n"), F.count_if(F.col("v") < low).alias("below")).collect():  # a row for each bin
        below[r.i] += r.below
        if r.bin is not None:
            bins[r.i][r.bin] = r.n
    values = each.filter(F.col("v").between(low, high)).groupBy("i", "v").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy("i").orderBy("v")))
    rank = of([F.lit(0.5 * (s.n - 1) - b) for s, b in zip(own.values(), below, strict=True)])
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    medians = {r.i: r.a + (r.b - r.a) * (r.r - math.floor(r.r)) for r in values.groupBy("i").agg(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"), F.first(rank).alias("r")).collect()}
    return {f: replace(s, bins=tuple(bins[i]), median=medians[i]) for i, (f, s) in enumerate(own.items())}


def baseline_histograms(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """A row for each feature that has values: bin_edges, bin_counts, n, mean, std (of the population), p50."""
    present = [n for n in names if n in features.columns]
    found = _summaries(settled(features.select(*present), "baseline-rows"), present)
    rows = [(f, _edges(s.low, s.high), list(s.bins), s.n, s.mean, s.std, s.median) for f, s in found.items()]
    return features.sparkSession.createDataFrame(rows, "feature string, bin_edges array<double>, bin_counts array<long>, n long, mean double, std double, p50 double")


def psi_by_feature(baseline: DataFrame, current: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """A row for each feature that both sides have: psi, status, means and medians of both.

    Values outside the baseline's edges count for the number of values only; empty bins count as
    a share of one millionth.
    """
    before = {r.feature: r for r in baseline.collect()}  # a row for each feature
    present = [n for n in names if n in current.columns and n in before]
    now = _summaries(settled(current.select(*present), "current-rows"), present, {f: list(before[f].bin_edges) for f in present}) if present else {}
    rows = [(f, list(b.bin_counts), list(now[f].bins), b.mean, now[f].mean, b.p50, now[f].median, b.n, now[f].n) for f, b in before.items() if f in now]
    joined = current.sparkSession.createDataFrame(rows, "feature string, bin_counts array<long>, now_counts array<long>, mean double, current_mean double, p50 double, current_p50 double, n long, now_n long")
    total = F.aggregate("bin_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda counts, n: F.transform(counts, lambda x: F.greatest(x / n, F.lit(FLOOR)))
    parts = F.zip_with(share("now_counts", F.col("now_n")), share("bin_counts", total), lambda a, e: (a - e) * F.log(a / e))
    psi = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return joined.select(
        "feature",
        F.round(psi, 6).alias("psi"),
        psi_status(psi).alias("status"),
        F.col("mean").alias("baseline_mean"),
        F.round("current_mean", 4).alias("current_mean"),
        F.col("p50").alias("baseline_p50"),
        F.round("current_p50", 4).alias("current_p50"),
        F.col("n").alias("baseline_n"),
        F.col("now_n").alias("current_n"),
    )


def drift_alert(report: DataFrame) -> DataFrame:
    """One row: whether any feature calls for retraining, and how many features have each status."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return report.agg(
        F.coalesce(F.bool_or(F.col("status") == "retrain"), F.lit(False)).alias("drift_alert"),
        is_("stable").alias("stable"),
        is_("moderate").alias("moderate"),
        is_("retrain").alias("retrain"),
    )
