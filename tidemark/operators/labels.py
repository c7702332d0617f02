"""Training labels, samples and splits, all deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DAY_MS


def _last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("timestamp_ms").alias("last_seen_ms"))


def _judged(events: DataFrame, horizon_ms: int) -> DataFrame:
    """(event_id, user_id, timestamp_ms) of the events that are at least the horizon old; of all events if none is."""
    bounds = events.agg(F.max("timestamp_ms").alias("hi"), F.min("timestamp_ms").alias("lo"))
    rows = events.select("event_id", "user_id", "timestamp_ms").crossJoin(F.broadcast(bounds))  # one row
    return rows.filter((F.col("timestamp_ms") <= F.col("hi") - horizon_ms) | (F.col("lo") > F.col("hi") - horizon_ms)).drop("hi", "lo")


def churn_labels(events: DataFrame, horizon_ms: int = 7 * DAY_MS) -> DataFrame:
    """Events old enough to be judged, with ``churned_7d``: the user's last event is less than the horizon later.

    If no event is that old, all events are used. A row for each event, repeated or not; without a user no label.
    """
    joined = _judged(events, horizon_ms).join(_last_seen(events), "user_id", "left")
    label = (F.col("last_seen_ms") - F.col("timestamp_ms") < horizon_ms).cast("int")
    return joined.select("event_id", "user_id", F.timestamp_millis("timestamp_ms").alias("event_timestamp"), label.alias("churned_7d"))


def churn_labels_strict(events: DataFrame, horizon_ms: int = 7 * DAY_MS) -> DataFrame:
    """The same events, labelled by whether the user has no event within the horizon after the event."""
    # One row for each time at which a user was active, with the next such time.
    times = events.filter("user_id IS NOT NULL").select("user_id", "timestamp_ms").distinct()
    following = times.withColumn("next_ms", F.lead("timestamp_ms").over(Window.partitionBy("user_id").orderBy("timestamp_ms")))
    rows = _judged(events, horizon_ms).join(following, ["user_id", "timestamp_ms"], "left")
    label = F.when(F.col("user_id").isNotNull(), F.coalesce((F.col("next_ms") - F.col("timestamp_ms") > horizon_ms).cast("int"), F.lit(1)))
    return rows.select("event_id", "user_id", F.timestamp_millis("timestamp_ms").alias("event_timestamp"), label.alias("churned_7d_strict"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer), the first in the order of a seeded hash of ``key``."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def repeat_buyer_labels(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """1 for customers with exactly one delivered order."""
    delivered = orders.filter("order_status = 'delivered'").join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
    counts = delivered.filter("customer_unique_id IS NOT NULL").groupBy(F.col("customer_unique_id").cast("string").alias("user_id")).agg(F.count("order_id").alias("n_orders"))
    return counts.withColumn("label", (F.col("n_orders") == 1).cast("int"))


def stratified_split(df: DataFrame, label: str, key: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``is_train``: within each label the first ``train_share`` of rows in the order of a seeded hash.

    A label may hold most rows, so rows are counted by (label, first byte of the hash); only the
    byte in which a label's cut falls is ranked row by row.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    sizes = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(label).orderBy("_b")
    sizes = sizes.select(
        F.col(label).alias("_label"), F.col("_b").alias("_byte"),
        (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"),
        F.ceil(F.sum("_n").over(Window.partitionBy(label)) * F.lit(train_share)).alias("_cut"),
    )
    joined = hashed.join(sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_byte")))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    return joined.withColumn("is_train", rank <= F.col("_cut")).drop("_h", "_b", "_label", "_byte", "_before", "_cut")


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: rows of each class and the weight of the positive class, n_neg / n_pos (1 without positives)."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return counts.withColumn("scale_pos_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0)))
