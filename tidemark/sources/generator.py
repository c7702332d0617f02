"""Synthetic events: a deterministic function of a row number, so any task can make any part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the synthetic mix: event types and their weights.
MIX = (("CLICK", 45), ("PURCHASE", 10), ("ADD_TO_CART", 20), ("SESSION_START", 24), ("SESSION_END", 1))
LATE_SHARE = 0.02
LATE_SECONDS = (60, 600)


def _uniform(seed: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def synthetic_events(spark: SparkSession, n: int | DataFrame, start_ms: int, per_second: int = 1400, users: int = 10_000, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """``n`` events, or one for each ``id`` of a table, at an even rate; two in a hundred are 60 to 600 seconds late; a purchase has an amount."""
    ids = n.select(F.col("id").cast("long").alias("id")) if isinstance(n, DataFrame) else spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    total, kind, at = sum(w for _, w in MIX), F.lit(MIX[-1][0]), 0
    steps = []
    for name, weight in MIX[:-1]:
        at += weight
        steps.append((name, at / total))
    for name, upto in reversed(steps):
        kind = F.when(_uniform(seed, 1) < upto, name).otherwise(kind)
    late = F.when(_uniform(seed, 2) < LATE_SHARE, ((LATE_SECONDS[0] + _uniform(seed, 3) * (LATE_SECONDS[1] - LATE_SECONDS[0])) * 1000).cast("long")).otherwise(F.lit(0).cast("long"))
    user = F.floor(_uniform(seed, 4) * users).cast("long")
    device = F.element_at(F.array(*map(F.lit, ("DESKTOP", "MOBILE", "TABLET", "UNKNOWN"))), F.floor(_uniform(seed, 5) * 4).cast("int") + 1)
    country = F.element_at(F.array(*map(F.lit, ("US", "GB", "IN", "DE", "BR"))), F.floor(_uniform(seed, 6) * 5).cast("int") + 1)
    product = F.concat(F.lit("PROD-"), F.lpad(F.floor(_uniform(seed, 7) * 500).cast("string"), 4, "0"))
    base = ids.withColumn("event_type", kind).withColumn("user", user)
    shop = F.col("event_type").isin("PURCHASE", "ADD_TO_CART", "CLICK")
    return base.select(
        F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("id").cast("string"))).alias("event_id"),
        "event_type",
        F.concat(F.lit("USER-"), F.lpad(F.col("user").cast("string"), 6, "0")).alias("user_id"),
        F.concat(F.lit("S-"), F.col("user").cast("string"), F.lit("-"), F.floor(F.col("id") / (per_second * 1800)).cast("string")).alias("session_id"),
        (F.lit(start_ms) + F.floor(F.col("id") * 1000 / per_second).cast("long") - late).alias("timestamp_ms"),
        F.when(F.col("event_type") == "CLICK", F.concat(F.lit("/p/"), F.floor(_uniform(seed, 8) * 9).cast("string"))).alias("page_url"),
        F.when(shop, product).alias("product_id"),
        F.when(F.col("event_type") == "PURCHASE", (F.lit(100) + F.floor(_uniform(seed, 9) * 50_000)).cast("long")).alias("amount_cents"),
        device.alias("device_type"),
        country.alias("country_code"),
        F.lit("1.0.0").alias("app_version"),
    )
