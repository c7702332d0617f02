"""Daily aggregates and user signals over cleaned events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_minus_days, safe_pct


def stamped(df: DataFrame, computed_ms: int | None) -> DataFrame:
    return df if computed_ms is None else df.withColumn("gold_computed_ms", F.lit(computed_ms).cast("long"))


def compute_dau(silver: DataFrame, computed_ms: int | None = None) -> DataFrame:
    """Users, sessions and events by date, country and device.

    Rows are first reduced to one for each user and session, so the two distinct counts expand
    the reduced rows and not the events.
    """
    keys = ["event_date", "country_code", "device_type"]
    reduced = silver.groupBy(*keys, "user_id", "session_id").agg(F.count("*").alias("n"))
    dau = reduced.groupBy(*keys).agg(F.countDistinct("user_id").alias("unique_users"), F.countDistinct("session_id").alias("total_sessions"), F.sum("n").alias("total_events"))
    return stamped(dau, computed_ms)


def compute_revenue(silver: DataFrame, computed_ms: int | None = None) -> DataFrame:
    """Purchases and revenue by date, country and raw product: a null product and one named N/A stay two rows."""
    paid = silver.filter((F.col("event_type") == "PURCHASE") & (F.col("amount_cents") > 0))
    grouped = paid.groupBy("event_date", "country_code", "product_id").agg(
        F.count("*").alias("total_purchases"),
        F.sum("amount_cents").alias("total_revenue_cents"),
        F.avg("amount_cents").alias("avg_order_value_cents"),
    )
    return stamped(grouped.withColumn("product_id", F.coalesce("product_id", F.lit("N/A"))), computed_ms)


def compute_funnel(silver: DataFrame, computed_ms: int | None = None) -> DataFrame:
    """Views, carts and purchases by date and country, and the two conversion rates in percent."""
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = silver.groupBy("event_date", "country_code").agg(
        count("PAGE_VIEW").alias("total_page_views"),
        count("ADD_TO_CART").alias("total_add_to_carts"),
        count("PURCHASE").alias("total_purchases"),
    )
    rates = counts.withColumns(
        {
            "view_to_cart_pct": safe_pct(F.col("total_add_to_carts"), F.col("total_page_views")),
            "cart_to_purchase_pct": safe_pct(F.col("total_purchases"), F.col("total_add_to_carts")),
        }
    )
    return stamped(rates, computed_ms)


def compute_user_signals(silver: DataFrame, signal_date: str | None = None, computed_ms: int | None = None) -> DataFrame:
    """Activity of the trailing seven days and churn risk, a row for each user.

    The window starts seven dates before ``signal_date`` (the latest date, if not given) and so
    has eight dates. One aggregation gives both the last date and the window.
    """
    rows = silver.select("user_id", "session_id", "event_type", "amount_cents", "event_date")
    if signal_date is None:
        rows = rows.crossJoin(F.broadcast(silver.agg(F.max("event_date").alias("signal_date"))))  # one row
    else:
        rows = rows.withColumn("signal_date", F.lit(signal_date))
    recent = F.col("event_date") >= iso_minus_days(F.col("signal_date"), 7)
    bought = recent & (F.col("event_type") == "PURCHASE")
    signals = rows.groupBy("user_id", "signal_date").agg(
        F.max("event_date").alias("last_seen_date"),
        F.countDistinct(F.when(recent, F.col("session_id"))).alias("total_sessions_7d"),
        F.count_if(recent).alias("total_events_7d"),
        F.count_if(bought).alias("total_purchases_7d"),
        F.coalesce(F.sum(F.when(bought, F.col("amount_cents"))), F.lit(0)).alias("total_revenue_7d_cents"),
    )
    days = F.datediff(F.to_date("signal_date"), F.to_date("last_seen_date")).cast("long")
    signals = signals.select(
        "user_id", "last_seen_date", days.alias("days_since_last_session"),
        "total_sessions_7d", "total_events_7d", "total_purchases_7d", "total_revenue_7d_cents",
        (days >= 7).alias("is_churned"), F.least(days / F.lit(7.0), F.lit(1.0)).alias("churn_risk_score"), "signal_date",
    )
    return stamped(signals, computed_ms)


def run_all(silver: DataFrame, computed_ms: int | None = None) -> dict[str, DataFrame]:
    """All four tables. Cache ``silver`` first if it is costly to make."""
    return {
        "dau": compute_dau(silver, computed_ms),
        "revenue": compute_revenue(silver, computed_ms),
        "funnel": compute_funnel(silver, computed_ms),
        "user_signals": compute_user_signals(silver, computed_ms=computed_ms),
    }
