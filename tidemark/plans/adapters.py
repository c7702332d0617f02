"""The star-schema test tables in the shapes of the operators' inputs, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bronze(spark: SparkSession, sf_dir: str, duplicates: bool = False) -> DataFrame:
    """``events`` as raw events, with planted faults, out-of-order arrival and, if asked, repeated ids."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id", "event_type AS kind", "value",
        "unix_millis(CAST(ts AS timestamp)) AS timestamp_ms",
        "date_format(ts, 'yyyy-MM-dd') AS event_date",
        "CAST(get_json_object(props, '$.k') AS int) AS k",
    )
    rows = rows.selectExpr(
        "concat('E-', lpad(CAST(id AS string), 9, '0')) AS event_id",
        "CASE kind WHEN 'view' THEN 'PAGE_VIEW' WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'PURCHASE' ELSE upper(kind) END AS event_type",
        "concat('USER-', lpad(CAST(user_id AS string), 6, '0')) AS user_id",
        "concat('S-', CAST(user_id AS string), '-', event_date) AS session_id",
        "timestamp_ms",
        "CASE WHEN kind = 'view' THEN concat('/p/', CAST(k % 9 AS string)) END AS page_url",
        "CASE WHEN kind IN ('purchase', 'signup', 'click') AND k % 10 <> 0 THEN concat('PROD-', lpad(CAST(k AS string), 4, '0')) END AS product_id",
        "CASE WHEN kind = 'purchase' THEN CASE WHEN id % 79 = 0 THEN 0L ELSE CAST(rint(value * 100) AS bigint) END END AS amount_cents",
        "CASE WHEN id % 83 = 0 THEN 'SMARTWATCH' ELSE element_at(array('DESKTOP', 'MOBILE', 'TABLET', 'UNKNOWN'), k % 4 + 1) END AS device_type",
        "CASE WHEN id % 89 = 0 THEN 'usa' ELSE element_at(array('US', 'GB', 'IN', 'DE', 'BR'), k % 5 + 1) END AS country_code",
        "CASE WHEN id % 97 = 0 THEN '' ELSE '1.0.0' END AS app_version",
        "'events' AS kafka_topic",
        "CAST(id % 4 AS int) AS kafka_partition",
        "id AS kafka_offset",
        "timestamp_ms AS ingestion_timestamp_ms",
        "event_date AS ingestion_date",
        "event_date",
        "id + (id % 7) * (id % 13) AS arrival_seq",
        "id",
    )
    if duplicates:
        copies = rows.filter("id % 11 = 0").withColumn("arrival_seq", F.col("arrival_seq") + 50)
        rows = rows.unionByName(copies)
    return rows.drop("id")


BRONZE_SQL = """bronze AS (
  SELECT 'E-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id,
         CASE event_type WHEN 'view' THEN 'PAGE_VIEW' WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'PURCHASE' ELSE upper(event_type) END AS event_type,
         'USER-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_id,
         'S-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
         epoch_us(ts) // 1000 AS timestamp_ms,
         CASE WHEN event_type = 'view' THEN '/p/' || CAST(k % 9 AS VARCHAR) END AS page_url,
         CASE WHEN event_type IN ('purchase', 'signup', 'click') AND k % 10 <> 0 THEN 'PROD-' || lpad(CAST(k AS VARCHAR), 4, '0') END AS product_id,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 79 = 0 THEN 0 ELSE CAST(value * 100 AS BIGINT) END END AS amount_cents,
         CASE WHEN event_id % 83 = 0 THEN 'SMARTWATCH' ELSE ['DESKTOP', 'MOBILE', 'TABLET', 'UNKNOWN'][k % 4 + 1] END AS device_type,
         CASE WHEN event_id % 89 = 0 THEN 'usa' ELSE ['US', 'GB', 'IN', 'DE', 'BR'][k % 5 + 1] END AS country_code,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE '1.0.0' END AS app_version,
         CAST(event_id % 4 AS INTEGER) AS kafka_partition, event_id AS kafka_offset,
         strftime(ts, '%Y-%m-%d') AS event_date,
         event_id + (event_id % 7) * (event_id % 13) AS arrival_seq, event_id AS id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
DUPLICATED_SQL = BRONZE_SQL + """, arrived AS (
  SELECT * FROM bronze UNION ALL SELECT * REPLACE (arrival_seq + 50 AS arrival_seq) FROM bronze WHERE id % 11 = 0)"""


def order_tables(spark: SparkSession, sf_dir: str, placed: bool = False) -> dict[str, DataFrame]:
    """Orders, customers, payments, items and reviews of an order export. If ``placed``, payments have their ``line``."""
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    delivered = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("delivered"))
    return {
        "orders": orders.join(delivered, orders["o_orderkey"] == delivered["l_orderkey"], "left").selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer_id", "IF(o_orderstatus = 'F', 'delivered', 'other') AS order_status",
            "CAST(o_orderdate AS timestamp) AS order_purchase_timestamp", "CAST(delivered AS timestamp) AS order_delivered_customer_date",
            "CAST(o_orderdate AS timestamp) + INTERVAL 30 DAYS AS order_estimated_delivery_date",
        ),
        "customers": customer.selectExpr("c_custkey AS customer_id", "c_custkey % 1000 AS customer_unique_id"),
        "payments": lines.selectExpr("l_orderkey AS order_id", "l_extendedprice * (1 - l_discount) AS payment_value", "l_linenumber AS payment_installments", *(["struct(_metadata.file_name, _metadata.row_index) AS line"] if placed else [])),
        "items": lines.selectExpr("l_orderkey AS order_id", "l_linenumber AS order_item_id", "l_partkey AS product_id", "l_suppkey AS seller_id"),
        "reviews": orders.selectExpr("o_orderkey AS order_id", "1 + o_orderkey % 5 AS review_score"),
    }


ORDERS_SQL = """xorders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'other' END AS order_status,
         o_orderdate AS order_purchase_timestamp, delivered, o_orderdate + INTERVAL 30 DAY AS estimated
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS delivered FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
xcustomers AS (SELECT c_custkey AS customer_id, c_custkey % 1000 AS customer_unique_id FROM customer),
xpayments AS (SELECT l_orderkey AS order_id, l_extendedprice * (1 - l_discount) AS payment_value, l_linenumber AS payment_installments FROM lineitem),
rollup_ AS (
  SELECT o.order_id, c.customer_unique_id, o.order_purchase_timestamp, p.total_payment, i.first_product_id
  FROM xorders o LEFT JOIN xcustomers c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT order_id, sum(payment_value) AS total_payment FROM xpayments GROUP BY 1) p ON o.order_id = p.order_id
  LEFT JOIN (SELECT l_orderkey AS order_id, l_partkey AS first_product_id FROM lineitem
             QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) i ON o.order_id = i.order_id
  WHERE o.order_status = 'delivered' AND o.order_purchase_timestamp IS NOT NULL AND p.total_payment > 0)"""
