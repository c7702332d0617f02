"""Order exports: roll-up to purchase events, time compression, customer enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import days_between_floor, half_even
from ..schemas import DAY_MS

# Fixed values of replayed events.
REPLAY_VERSION = "olist-1.0"
REPLAY_COUNTRY = "BR"


def sum_in_order(value: str, order: str) -> Column:
    """The sum of a group's numbers, added one after the other by ``order``: the same to the last bit however the rows are dealt out.

    A plain sum of doubles adds in the order in which partial sums arrive, and where half a cent decides, so does the
    rounded amount. For groups of few rows, as an order's payments are.
    """
    there = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("value")))))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x["value"]))


def order_rollup(orders: DataFrame, customers: DataFrame, payments: DataFrame, items: DataFrame, payment_order: str | None = None) -> DataFrame:
    """Delivered, paid orders with their customer, total payment and first product that is not null.

    With ``payment_order``, a column of ``payments``, an order's payments are added in that order.
    """
    delivered = orders.filter("order_status = 'delivered'").select("order_id", "customer_id", "order_purchase_timestamp")
    total = sum_in_order("payment_value", payment_order) if payment_order else F.sum("payment_value")
    paid = payments.filter("order_id IS NOT NULL").groupBy("order_id").agg(total.alias("total_payment"))
    tie = [c for c in ("order_item_id", "product_id", "seller_id") if c in items.columns]
    first = items.filter("product_id IS NOT NULL").groupBy("order_id").agg(F.min_by("product_id", F.struct(*tie)).alias("first_product_id"))
    joined = (
        delivered.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
        .join(paid, "order_id", "left")
        .join(first, "order_id", "left")
    )
    kept = joined.filter("order_purchase_timestamp IS NOT NULL AND total_payment > 0")
    return kept.select("order_id", "customer_unique_id", "order_purchase_timestamp", "total_payment", "first_product_id")


def compress_timestamps(orders: DataFrame, now_ms: int, days: int) -> DataFrame:
    """``orders`` with ``timestamp_ms``: the whole time range mapped linearly onto the ``days`` before now.

    If all times are equal, all become now. The sum is truncated to a whole number.
    """
    ms = F.unix_millis(F.col("order_purchase_timestamp").cast("timestamp"))
    bounds = orders.agg(F.min(ms).alias("lo"), F.max(ms).alias("hi"))
    rows = orders.crossJoin(F.broadcast(bounds))  # one row
    start, span = now_ms - days * DAY_MS, days * DAY_MS
    share = (ms - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0).cast("long"))
    mapped = (F.lit(float(start)) + share * F.lit(float(span))).cast("long")
    return rows.withColumn("timestamp_ms", F.coalesce(mapped, F.lit(now_ms).cast("long"))).drop("lo", "hi")


def build_events(orders: DataFrame) -> DataFrame:
    """A purchase event for each order: at least one cent, event id from the order."""
    return orders.select(
        F.md5(F.concat_ws("|", F.lit("order"), F.col("order_id").cast("string"))).alias("event_id"),
        F.lit("PURCHASE").alias("event_type"),
        F.col("customer_unique_id").cast("string").alias("user_id"),
        F.col("order_id").cast("string").alias("session_id"),
        "timestamp_ms",
        F.lit(None).cast("string").alias("page_url"),
        F.col("first_product_id").cast("string").alias("product_id"),
        F.greatest(F.lit(1).cast("long"), half_even(F.col("total_payment") * 100).cast("long")).alias("amount_cents"),
        F.lit("UNKNOWN").alias("device_type"),
        F.lit(REPLAY_COUNTRY).alias("country_code"),
        F.lit(REPLAY_VERSION).alias("app_version"),
    )


def customer_enrichment(orders: DataFrame, customers: DataFrame, reviews: DataFrame, payments: DataFrame) -> DataFrame:
    """Mean delivery delay, review score and installments of each customer who has any of them.

    The three means are measures of one union, grouped once, in place of full outer joins.
    """
    owner = orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
    late = days_between_floor(F.col("order_delivered_customer_date").cast("timestamp"), F.col("order_estimated_delivery_date").cast("timestamp"))
    key = F.col("customer_unique_id").cast("string").alias("user_id")
    none = F.lit(None).cast("double")
    by_order = owner.select("order_id", "customer_unique_id")
    measures = (
        owner.select(key, late.cast("double").alias("delay"), none.alias("score"), none.alias("installments"))
        .unionByName(reviews.join(by_order, "order_id", "left").select(key, none.alias("delay"), F.col("review_score").cast("double").alias("score"), none.alias("installments")))
        .unionByName(payments.join(by_order, "order_id", "left").select(key, none.alias("delay"), none.alias("score"), F.col("payment_installments").cast("double").alias("installments")))
    )
    return measures.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        half_even(F.avg("delay"), 2).alias("avg_delivery_delay_days"),
        half_even(F.avg("score"), 4).alias("avg_review_score"),
        half_even(F.avg("installments"), 2).alias("avg_payment_installments"),
    )
