"""Rolling-window features of users, point-in-time joins and the online view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from ..schemas import DAY_MS, FEATURES, HOUR_MS


@dataclass(frozen=True)
class FeatureView:
    """What a set of features is joined by, and for how long a row of it is valid."""

    entity: str = "user_id"
    features: tuple[str, ...] = FEATURES
    ttl_ms: int = 7 * DAY_MS


def _window_measures(ref: Column, rounding: str) -> list[Column]:
    ts, bought = F.col("timestamp_ms"), F.col("event_type") == "PURCHASE"
    since = lambda ms: ts >= ref - F.lit(ms)
    windows = {"1h": HOUR_MS, "24h": DAY_MS, "7d": 7 * DAY_MS}
    counts = [F.count_if(bought & since(ms)).alias(f"purchase_count_{w}") for w, ms in windows.items()]
    sums = [F.coalesce(F.sum(F.when(bought & since(ms), F.col("amount_cents"))), F.lit(0)).cast("long").alias(f"revenue_sum_{w}") for w, ms in windows.items()]
    days = (F.max(ref) - F.max(F.when(bought, ts))) / F.lit(float(DAY_MS))
    days = half_even(days) if rounding == "half_even" else F.floor(days)
    return [
        *counts,
        *sums,
        F.countDistinct(F.when(since(DAY_MS), F.col("session_id"))).alias("session_count_24h"),
        F.count_if(since(DAY_MS)).alias("event_count_24h"),
        F.coalesce(days.cast("long"), F.lit(999).cast("long")).alias("days_since_last_purchase"),
    ]


def compute_features(silver: DataFrame, as_of_ms: int | None = None, rounding: str = "half_even") -> DataFrame:
    """Nine features of each user over windows that end at the reference time, in one aggregation.

    The reference is the latest event, or ``as_of_ms``, which also leaves out all later events.
    ``rounding`` of the days since the last purchase: ``half_even`` (training) or ``floor`` (drift
    reports); users without a purchase have 999.
    """
    rows = silver.select("user_id", "session_id", "event_type", "amount_cents", "timestamp_ms")
    if as_of_ms is None:
        rows = rows.crossJoin(F.broadcast(silver.agg(F.max("timestamp_ms").alias("ref_ms"))))  # one row
    else:
        rows = rows.filter(F.col("timestamp_ms") <= as_of_ms).withColumn("ref_ms", F.lit(as_of_ms).cast("long"))
    grouped = rows.groupBy("user_id").agg(F.max("ref_ms").alias("ref_ms"), *_window_measures(F.col("ref_ms"), rounding))
    return grouped.select("user_id", F.timestamp_millis("ref_ms").alias("event_timestamp"), *FEATURES)


def feature_history(silver: DataFrame, as_of_ms: list[int]) -> DataFrame:
    """Snapshots at several times, so that training rows find features that were known then.

    An event goes only to the snapshots whose longest window it is in. The last purchase before
    each snapshot comes from one row for each user and gap between snapshots.
    """
    refs = sorted(set(as_of_ms))
    times = F.array(*[F.lit(r).cast("long") for r in refs])
    rows = silver.select("user_id", "session_id", "event_type", "amount_cents", "timestamp_ms")
    # Snapshots are in order, so the number of those not before an event tells which they are.
    rows = rows.withColumn("left", F.size(F.filter(times, lambda r: r >= F.col("timestamp_ms")))).filter("left > 0")
    later = F.slice(times, F.lit(len(refs) + 1) - F.col("left"), F.col("left"))
    in_window = F.filter(later, lambda r: r - F.col("timestamp_ms") <= 7 * DAY_MS)
    windows = rows.select("user_id", "session_id", "event_type", "amount_cents", "timestamp_ms", F.explode(in_window).alias("ref_ms"))
    measures = windows.groupBy("user_id", "ref_ms").agg(*_window_measures(F.col("ref_ms"), "half_even")[:-1])
    gaps = rows.groupBy("user_id", "left").agg(F.max(F.when(F.col("event_type") == "PURCHASE", F.col("timestamp_ms"))).alias("bought_ms"))
    last = gaps.select("user_id", F.explode(later).alias("ref_ms"), "bought_ms").groupBy("user_id", "ref_ms").agg(F.max("bought_ms").alias("bought_ms"))
    days = half_even((F.col("ref_ms") - F.col("bought_ms")) / F.lit(float(DAY_MS))).cast("long")
    joined = last.join(measures, ["user_id", "ref_ms"], "left")
    return joined.select(
        "user_id",
        F.timestamp_millis("ref_ms").alias("event_timestamp"),
        *(F.coalesce(f, F.lit(0).cast("long")).alias(f) for f in FEATURES[:-1]),
        F.coalesce(days, F.lit(999).cast("long")).alias(FEATURES[-1]),
    )


def point_in_time_join(entities: DataFrame, features: DataFrame, view: FeatureView = FeatureView(), bucket_ms: int = DAY_MS) -> DataFrame:  # noqa: B008
    """For each entity row the latest feature row not after it and within the view's TTL; else nulls.

    Both sides are stacked and the last feature row is carried forward within (entity, time
    bucket); what a bucket inherits is the last feature row of earlier buckets, found on one row
    for each bucket. An entity with very many rows is so spread over its buckets. At equal times
    the feature row comes first. The entity columns come through unchanged, repeated rows too.
    """
    key, ts = view.entity, "event_timestamp"
    ms = lambda c: F.unix_millis(F.col(c))
    payload = F.struct(ms(ts).alias("feature_ms"), *view.features)
    left = entities.select(key, ms(ts).alias("ms"), F.struct(*entities.columns).alias("entity"), F.lit(None).cast(features.select(payload.alias("p")).schema["p"].dataType).alias("payload"))
    right = features.select(key, ms(ts).alias("ms"), F.lit(None).cast(left.schema["entity"].dataType).alias("entity"), payload.alias("payload"))
    both = left.unionByName(right).withColumn("bucket", F.floor(F.col("ms") / F.lit(bucket_ms)))
    within = Window.partitionBy(key, "bucket").orderBy(F.col("ms"), F.col("payload").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("seen", F.last("payload", ignorenulls=True).over(within))
    ends = both.groupBy(key, "bucket").agg(F.max("payload").alias("end"))  # feature_ms is the payload's first field
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select(F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), F.last("end", ignorenulls=True).over(before).alias("inherited"))
    rows = carried.filter("entity IS NOT NULL").join(inherited, F.col(key).eqNullSafe(F.col("_key")) & F.col("bucket").eqNullSafe(F.col("_bucket")), "left")
    found = F.coalesce("seen", "inherited")
    valid = F.when(F.col("ms") - found["feature_ms"] <= view.ttl_ms, found)
    return rows.select(*(F.col(f"entity.{c}").alias(c) for c in entities.columns), *(valid[f].alias(f) for f in view.features))


def latest_per_entity(features: DataFrame, key: str = "user_id", ts: str = "event_timestamp") -> DataFrame:
    """The latest row of each entity, for a key-value store; a partial maximum, so no entity is gathered."""
    row = F.struct(F.col(ts), *(F.col(c) for c in features.columns if c not in (key, ts)))
    latest = features.groupBy(key).agg(F.max(row).alias("row"))
    return latest.select(*(F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in features.columns))


def lookup(features: DataFrame, user_ids: DataFrame) -> DataFrame:
    """The rows of the given users; ``user_ids`` may repeat."""
    return features.join(user_ids.select("user_id"), "user_id", "left_semi")


def lookup_counts(features: DataFrame, user_ids: DataFrame) -> DataFrame:
    """One row: how many of the asked, distinct users were found and how many were not."""
    asked = user_ids.select("user_id").distinct()
    known = features.select("user_id", F.lit(1).alias("known")).distinct()
    joined = asked.join(known, "user_id", "left")
    return joined.agg(F.count("*").alias("requested"), F.count("known").alias("found"), F.count_if(F.col("known").isNull()).alias("failed"))
