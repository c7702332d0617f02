"""Lateness against a running maximum of event time, and removal of repeated events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .ranges import RANGES, range_of, running, running_in

MINUTE_MS = 60_000
#: Rows of a key that are looked at together; keys of more are followed row by row over all tasks.
FEW = 1000
#: Partitions of a source at most, of which each is two columns.
PARTITIONS = 1024


@dataclass(frozen=True)
class WatermarkConfig:
    allowed_ms: int = 5 * MINUTE_MS
    max_late_ms: int = 35 * 24 * 60 * MINUTE_MS
    idle_ms: int = 30_000  # of a source's partition, for ``partition_watermark``
    buckets: int = RANGES  # into which the arrival order is cut


def running_max(events: DataFrame, value: str = "timestamp_ms", arrival: str = "arrival_seq", tie: tuple[str, ...] = ("event_id",), buckets: int = RANGES, start: int | None = None) -> DataFrame:
    """``events`` with ``running_max``: the largest value among the rows up to this one, in order of arrival.

    A window over the whole table would be one task: see ``ranges.running``. Where the value is itself the order, the
    running maximum is the value. ``start`` is a maximum from before.
    """
    before = F.lit(start).cast("long")
    if value == arrival:
        return events.withColumn("running_max", F.greatest(F.col(value), before))
    found = running(events, {"running_max": ("max", F.col(value))}, arrival, tie, buckets)
    return found.withColumn("running_max", F.greatest("running_max", before))


def partition_watermark(
    events: DataFrame, partition: str = "kafka_partition", arrival: str = "arrival_seq", arrived_ms: str = "ingestion_timestamp_ms",
    config: WatermarkConfig = WatermarkConfig(), tie: tuple[str, ...] = ("event_id",), partitions: list | None = None, value: str = "timestamp_ms",
) -> DataFrame:  # fmt: skip  # noqa: B008
    """``events`` with ``watermark_ms``: the least, over the partitions that are not idle, of their running maxima, less ``allowed_ms``.

    The maximum of a partition is over its rows up to this one, which counts. A partition is idle at a row if its last row came
    ``idle_ms`` or more before; it then holds nothing back until it sends again. One that has sent nothing yet counts from the
    first arrival of all, and until it is idle there is no watermark (null). A watermark never falls. Rows of a null
    partition are one partition; rows without an arrival time hold back and release nothing.

    ``partitions`` are found in ``events`` where not given, at most ``PARTITIONS``: each is two columns of one running
    aggregation. The watermark itself is a second one.
    """
    if partitions is None:
        found = events.select(partition).distinct().limit(PARTITIONS + 1).collect()
        partitions = sorted((r[0] for r in found), key=lambda p: (p is not None, p))
    if len(partitions) > PARTITIONS:
        raise ValueError(f"more than {PARTITIONS} partitions")
    first = events.agg(F.min(arrived_ms)).first()[0]
    own = lambda p, x: F.when(F.col(partition).eqNullSafe(F.lit(p)), F.col(x))
    measures = {}
    for i, p in enumerate(partitions):
        measures |= {f"_top{i}": ("max", own(p, value)), f"_came{i}": ("max", own(p, arrived_ms))}
    marked = running(events, measures, arrival, tie, config.buckets) if measures else events
    active = [F.col(arrived_ms) - F.coalesce(F.col(f"_came{i}"), F.lit(first)) < config.idle_ms for i in range(len(partitions))]
    waits = reduce(Column.__or__, [a & F.col(f"_top{i}").isNull() for i, a in enumerate(active)], F.lit(False))
    tops = [F.when(a, F.col(f"_top{i}")) for i, a in enumerate(active)]
    least = F.array_min(F.array(*tops)) if tops else F.lit(None).cast("long")
    marked = marked.withColumn("_least", F.when(~F.coalesce(waits, F.lit(True)), least)).drop(*measures)
    found = running(marked, {"watermark_ms": ("max", F.col("_least"))}, arrival, tie, config.buckets)
    return found.withColumn("watermark_ms", F.col("watermark_ms") - config.allowed_ms).drop("_least")


def classification(ts: Column, running: Column, config: WatermarkConfig) -> Column:
    """on_time, late or discard; both bounds are inclusive, and the first is never below 0."""
    return (
        F.when(ts >= F.greatest(F.lit(0).cast("long"), running - config.allowed_ms), "on_time")
        .when(ts >= running - config.max_late_ms, "late")
        .otherwise("discard")
    )


def classify(events: DataFrame, config: WatermarkConfig = WatermarkConfig(), arrival: str = "arrival_seq", start: int | None = None) -> DataFrame:  # noqa: B008
    """``events`` with ``watermark_classification``. The row itself counts for the maximum.

    ``arrival`` may be the event time itself, as in a batch sorted by it; then nothing is late.
    """
    marked = running_max(events, arrival=arrival, buckets=config.buckets, start=start)
    return marked.withColumn("watermark_classification", classification(F.col("timestamp_ms"), F.col("running_max"), config)).drop("running_max")


def first_per_key(events: DataFrame, key: str = "event_id", arrival: str = "arrival_seq", tie: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key in order of arrival: a partial minimum, so a frequent key is never gathered.

    Further ties are broken by the remaining columns. Rows of a null key are one key.
    """
    first = [arrival, *(t for t in tie if t != arrival)]
    rest = [c for c in events.columns if c not in (key, *first)]
    best = events.groupBy(key).agg(F.min(F.struct(*first, *rest)).alias("row"))
    return best.select(*(F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in events.columns))


def accepted_within_ttl(events: DataFrame, key: str = "event_id", ts: str = "timestamp_ms", seq: str = "arrival_seq", ttl_ms: int = 3_600_000) -> DataFrame:
    """Rows that are at least ``ttl_ms`` after the last accepted row of their key, in order of event time; ties: the first to arrive.

    A row that is the TTL or more after its predecessor is accepted whatever came before; it starts a
    run. The row accepted after another is the first one that is the TTL later, so the accepted rows of
    a run are a chain, which is followed by pointer doubling: as many rounds as the logarithm of the
    longest run, counted in TTLs. Predecessors and successors are found within (key, time bucket), and
    across buckets on one row for each, so a key that fires steadily is spread over its buckets. Rows
    without a time are left out; a null key is a key.
    """
    key_ = F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))
    rows = events.filter(F.col(ts).isNotNull()).groupBy(key_.alias("_k"), F.col(ts).alias("_t")).agg(F.min(F.struct(F.col(seq), F.col(key))).alias("_row"))
    rows = settled(rows.withColumn("_b", F.floor(F.col("_t") / F.lit(ttl_ms))), "ttl-rows")
    times = rows.select("_k", "_b", "_t", F.col("_t").alias("_real"), F.lit(None).cast("long").alias("_from"))
    asked = rows.select("_k", (F.col("_b") + 1).alias("_b"), (F.col("_t") + ttl_ms).alias("_t"), F.lit(None).cast("long").alias("_real"), F.col("_t").alias("_from"))
    both = times.unionByName(asked)
    # The least time at or after each asked one, and the time before each real one, in the bucket or else beyond it.
    down = Window.partitionBy("_k", "_b").orderBy(F.desc("_t"), F.col("_from").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("_k", "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_next", F.last("_real", ignorenulls=True).over(down)).withColumn("_prev", F.when(F.col("_real").isNotNull(), F.last("_real", ignorenulls=True).over(up)))
    ends = both.groupBy("_k", "_b").agg(F.min("_real").alias("_lo"), F.max("_real").alias("_hi"))
    by_bucket = Window.partitionBy("_k").orderBy("_b")
    ends = ends.select(
        "_k", "_b",
        F.first("_lo", ignorenulls=True).over(by_bucket.rowsBetween(1, Window.unboundedFollowing)).alias("_beyond"),
        F.last("_hi", ignorenulls=True).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
    )
    found = settled(near.join(ends, ["_k", "_b"]).select("_k", "_real", "_from", F.coalesce("_next", "_beyond").alias("_next"), F.coalesce("_prev", "_earlier").alias("_prev")), "ttl-found")
    starts = found.filter("_real IS NOT NULL").filter(F.col("_prev").isNull() | (F.col("_real") - F.col("_prev") >= ttl_ms)).select("_k", F.col("_real").alias("_t"))
    starts = settled(starts, "ttl-starts")
    # A chain ends where the next run starts.
    jumps = found.filter("_from IS NOT NULL AND _next IS NOT NULL").select("_k", F.col("_from").alias("_t"), "_next")
    jumps = settled(jumps.join(starts.withColumnRenamed("_t", "_next"), ["_k", "_next"], "left_anti").select("_k", "_t", "_next"), "ttl-jumps")
    marked = starts
    while True:
        reached = settled(marked.join(jumps, ["_k", "_t"]).select("_k", F.col("_next").alias("_t")), "ttl-reached")
        if reached.isEmpty():
            break
        marked = settled(marked.unionByName(reached), "ttl-marked")
        further = jumps.select("_k", F.col("_t").alias("_next"), F.col("_next").alias("_after"))
        jumps = settled(jumps.join(further, ["_k", "_next"]).select("_k", "_t", F.col("_after").alias("_next")), "ttl-jumps")
    return rows.join(marked, ["_k", "_t"]).select(F.col(f"_row.{key}").alias(key), F.col("_t").alias(ts), F.col(f"_row.{seq}").alias(seq))


def _chains(clocked: DataFrame, least: int) -> DataFrame:
    """(_key, _place) of the rows that are ``least`` after the last one taken of their key; keys of at most ``FEW`` rows."""
    own = clocked.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_clock", "_place"))).alias("_rows"))
    take = lambda taken, x: F.when(x["_clock"] - F.element_at(taken, -1)["_clock"] >= least, F.concat(taken, F.array(x))).otherwise(taken)
    kept = F.aggregate(F.slice("_rows", 2, FEW), F.slice("_rows", 1, 1), take)
    return own.select("_key", F.explode(kept).alias("_row")).select("_key", "_row._place")


def accepted_within_cap(events: DataFrame, key: str = "event_id", arrival: str = "arrival_seq", cap: int = 200_000, tie: tuple[str, ...] = ()) -> DataFrame:
    """(key, arrival) of the rows that a memory of the ``cap`` last accepted keys lets through, in order of arrival.

    A row is accepted if its key is not in the memory; the key then enters it, and beyond ``cap`` the one that entered first leaves.
    A repeated row does not move its key up. So a key's next accepted row is its first that comes after ``cap`` further
    acceptances: deduplication with a time limit, whose clock is the number of rows accepted so far. The clock is found by
    rounds: each takes the last round's acceptances as the clock, beginning with the keys' first rows. A round is right up
    to the first row where the last one was wrong and beyond it, so the rounds end, at the one answer; where copies follow
    their originals within the cap or far beyond it, after two or three. ``arrival`` and ``tie`` must tell a key's rows apart.
    Rows without an arrival are left out; a null key is a key.
    """
    if cap < 1:
        raise ValueError("cap must be positive")
    key_ = F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0")).alias("_key")
    rows = events.filter(F.col(arrival).isNotNull()).select(key_, F.col(key).alias("_id"), F.struct(arrival, *(t for t in tie if t != arrival)).alias("_place"), F.col(arrival).alias("_at"))
    firsts = settled(rows.groupBy("_key").agg(F.min("_place").alias("_place"), F.count("*").alias("_n")), "cap-firsts")
    often = firsts.filter(F.col("_n") > FEW).count() > 0
    ordered = settled(rows.withColumn("_range", range_of(rows, "_at")).join(firsts.select("_key", "_n"), "_key"), "cap-rows")
    accepted = firsts.select("_key", "_place")
    while True:
        flagged = ordered.join(accepted.withColumn("_in", F.lit(1).cast("long")), ["_key", "_place"], "left")
        clocked = running_in(flagged, {"_upto": ("sum", F.col("_in"))}, "_range", ("_place", "_key"))
        # The rows accepted before this one.
        clocked = clocked.select("_key", "_n", "_place", (F.col("_upto") - F.coalesce("_in", F.lit(0))).alias("_clock"))
        clocked = settled(clocked, "cap-clock") if often else clocked
        found = _chains(clocked.filter(F.col("_n") <= FEW), cap + 1)
        if often:
            found = found.unionByName(accepted_within_ttl(clocked.filter(F.col("_n") > FEW), "_key", "_clock", "_place", cap + 1).select("_key", "_place"))
        found = settled(found, "cap-accepted")
        if found.count() == accepted.count() and found.join(accepted, ["_key", "_place"], "left_anti").isEmpty():
            break
        accepted = found
    return ordered.join(found, ["_key", "_place"], "left_semi").select(F.col("_id").alias(key), F.col("_at").alias(arrival))
