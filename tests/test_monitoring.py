"""Rates and bucket quantiles on samples small enough to reckon by hand."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitoring
from tidemark.plans import operations

MINUTE = 60_000


def rates(spark, rows, minutes=1, step=MINUTE):
    df = spark.createDataFrame(rows, "s string, ts_ms long, value double")
    return {(r.s, r.at_ms): r for r in monitoring.counter_rate(df, ["s"], minutes * MINUTE, step).collect()}


def test_rate_of_a_steady_counter_is_its_slope(spark):
    found = rates(spark, [("a", t * 1000, float(t)) for t in range(0, 600, 15)], 5)
    assert found["a", 5 * MINUTE].per_second == pytest.approx(1.0)
    assert found["a", 10 * MINUTE].samples == 19 and found["a", 10 * MINUTE].per_second == pytest.approx(1.0)
    # The last sample is long before the end: the rate is not carried on beyond half a distance.
    assert found["a", 14 * MINUTE].per_second == pytest.approx((45 + 15 - 15 + 7.5) / 300, rel=0.2)
    assert ("a", 15 * MINUTE) not in found  # an empty range has no row


def test_restarts_ties_and_single_samples(spark):
    rows = [("a", 61_000, 5.0), ("a", 80_000, 9.0), ("a", 100_000, 2.0), ("a", 100_000, 1.0), ("a", 119_000, 4.0), ("b", 61_000, 5.0), ("b", None, 1.0), ("b", 62_000, None), ("b", 63_000, math.nan)]
    found = rates(spark, rows)
    a = found["a", 2 * MINUTE]
    assert (a.samples, a.increase) == (4, 4.0 + 2.0 + 2.0)
    b = found["b", 2 * MINUTE]
    assert (b.samples, b.increase, b.per_second) == (1, 0.0, None)
    # Bounds: a sample at the end counts, one at the beginning does not.
    edge = rates(spark, [("a", 60_000, 1.0), ("a", 120_000, 3.0)], 2)
    assert edge["a", 120_000].samples == 2 and edge["a", 180_000].samples == 1
    assert rates(spark, [("a", 60_000, 1.0), ("a", 120_000, 3.0)])["a", 120_000].samples == 1
    with pytest.raises(ValueError, match="multiple"):
        rates(spark, [], 1, 45_000)


def test_increase_over_cells_equals_the_plain_sum(spark):
    values = [(i * 7919) % 23 for i in range(200)]
    rows = [("a", i * 9_000 + 500, float(v)) for i, v in enumerate(values)]
    for (_, at), r in rates(spark, rows, 5).items():
        own = [v for _, t, v in rows if at - 5 * MINUTE < t <= at]
        assert r.samples == len(own) and r.increase == sum(b if b < a else b - a for a, b in zip(own, own[1:], strict=False))


def test_histograms_by_column_equal_those_by_row(spark):
    bounds = {"a": 0.1, "b": 0.5, "c": math.inf}
    wide = spark.range(400).selectExpr("CAST(id % 2 AS int) AS s", "(id * 7919) % 600000 AS ts_ms", "id % 150 AS a", "id % 150 * 2 AS b", "id % 150 * 3 AS c")
    rows = wide.select("s", "ts_ms", F.inline(F.array(*(F.struct(F.lit(le).alias("le"), F.col(c).alias("value")) for c, le in bounds.items()))))
    for minutes in (1, 5):
        plain = monitoring.quantiles_over_ranges(rows, ["s"], minutes * MINUTE, MINUTE)
        found = monitoring.quantiles_of_histograms(wide, ["s"], bounds, minutes * MINUTE, MINUTE)
        assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    # A sample is one row until there are cells: no row for each bound is sorted or shuffled before.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1 and plan.index("Generate inline") < plan.rindex("Window [lag(")


@pytest.mark.parametrize("name", ["latency_quantiles_1m", "prediction_rate_1m"])
def test_no_task_holds_a_table_of_samples_by_time_or_sorts_a_day(spark, name):
    plan = getattr(operations, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert keys and not [k for k in keys if re.search(r"\b(ts_ms|_t)#", k)]
    # Windows over samples, which are ordered by time, are within minutes or cells.
    sorts = re.findall(r", \[([^\]]*)\], \[((?:ts_ms|_t)#[^\]]*)\]", plan)
    assert sorts and all(re.search(r"\b(minute|_cell)#", by) for by, _ in sorts)


def test_bucket_quantiles(spark):
    inf = math.inf

    def value(q, *b):
        df = spark.createDataFrame([(sorted(b), max((n for _, n in b), default=None))], "b array<struct<le: double, n: double>>, total double")
        return df.select(monitoring.bucket_quantile(q, F.col("b"), F.col("total")).alias("v")).first().v

    buckets = ((0.1, 10.0), (0.5, 30.0), (1.0, 30.0), (inf, 40.0))
    assert value(0.25, *buckets) == pytest.approx(0.1)
    assert value(0.125, *buckets) == pytest.approx(0.05)
    assert value(0.5, *buckets) == pytest.approx(0.1 + 0.4 * 0.5)
    assert value(0.99, *buckets) == 1.0  # in the infinite bucket: the highest bound
    assert value(0.5, *reversed(buckets)) == pytest.approx(0.3)
    assert value(0.0, *buckets) == 0.0 and value(1.5, *buckets) == inf and value(-1.0, *buckets) == -inf
    assert value(0.5, (0.1, 0.0), (inf, 0.0)) is None  # nothing counted
    assert value(0.5, (inf, 4.0)) is None and value(0.5, (0.1, 1.0), (0.5, 2.0)) is None and value(0.5) is None
    assert value(0.5, (-1.0, 3.0), (inf, 4.0)) == -1.0
    assert value(0.9, (0.1, 10.0), (0.5, 9.0), (1.0, 20.0), (inf, 20.0)) == pytest.approx(0.5 + 0.5 * 0.8)  # a count that falls
