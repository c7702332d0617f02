"""Registered queries, (spark, folder of tables) -> DataFrame, each beside its DuckDB SQL.

Nothing here depends on the clock or on random numbers: times are literals, ids come from hashes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, drift, features, gold, labels, ml, normalize, orders, quality, serving, silver, watermark
from ..schemas import DAY_MS, DEVICE_TYPES, EVENT, EVENT_TYPES, FEATURES, REQUIRED, TS_MAX_MS, TS_MIN_MS, from_avro_json, to_avro_json
from ..sources import feeds
from ..sources.tables import TableIO, scratch
from .adapters import BRONZE_SQL, DUPLICATED_SQL, ORDERS_SQL, bronze, order_tables, table
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

PROCESSED_MS = 1_706_745_600_000  # 2024-02-01
MID_MS = 1_705_363_200_000  # 2024-01-16
SNAPSHOTS = [1_704_499_200_000 + i * 2 * DAY_MS for i in range(12)]  # 2024-01-06 and every second day
LATENESS = watermark.WatermarkConfig(allowed_ms=300_000, max_late_ms=3_000_000)
OPTIONS = silver.SilverOptions(watermark=LATENESS)


# Daily aggregates


@query(f"""WITH {BRONZE_SQL} SELECT event_date, country_code, device_type, count(DISTINCT user_id) AS unique_users,
count(DISTINCT session_id) AS total_sessions, count(*) AS total_events FROM bronze GROUP BY 1, 2, 3""")
def gold_dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.compute_dau(bronze(spark, sf_dir))


@query(f"""WITH {BRONZE_SQL} SELECT event_date, country_code, coalesce(product_id, 'N/A') AS product_id, count(*) AS total_purchases,
CAST(sum(amount_cents) AS BIGINT) AS total_revenue_cents, avg(amount_cents) AS avg_order_value_cents
FROM bronze WHERE event_type = 'PURCHASE' AND amount_cents > 0 GROUP BY event_date, country_code, bronze.product_id""")
def gold_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.compute_revenue(bronze(spark, sf_dir))


@query(f"""WITH {BRONZE_SQL}, c AS (SELECT event_date, country_code, count(*) FILTER (event_type = 'PAGE_VIEW') AS total_page_views,
count(*) FILTER (event_type = 'ADD_TO_CART') AS total_add_to_carts, count(*) FILTER (event_type = 'PURCHASE') AS total_purchases FROM bronze GROUP BY 1, 2)
SELECT *, CASE WHEN total_page_views = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * total_add_to_carts / total_page_views, 2) END AS view_to_cart_pct,
CASE WHEN total_add_to_carts = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * total_purchases / total_add_to_carts, 2) END AS cart_to_purchase_pct FROM c""")
def gold_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.compute_funnel(bronze(spark, sf_dir))


@query(f"""WITH {BRONZE_SQL}, d AS (SELECT max(event_date) AS signal_date, strftime(CAST(max(event_date) AS DATE) - 7, '%Y-%m-%d') AS cutoff FROM bronze),
s AS (SELECT user_id, max(event_date) AS last_seen_date, count(DISTINCT session_id) FILTER (event_date >= cutoff) AS total_sessions_7d,
count(*) FILTER (event_date >= cutoff) AS total_events_7d, count(*) FILTER (event_date >= cutoff AND event_type = 'PURCHASE') AS total_purchases_7d,
CAST(coalesce(sum(amount_cents) FILTER (event_date >= cutoff AND event_type = 'PURCHASE'), 0) AS BIGINT) AS total_revenue_7d_cents, any_value(signal_date) AS signal_date
FROM bronze, d GROUP BY user_id)
SELECT *, datediff('day', CAST(last_seen_date AS DATE), CAST(signal_date AS DATE)) AS days_since_last_session,
datediff('day', CAST(last_seen_date AS DATE), CAST(signal_date AS DATE)) >= 7 AS is_churned,
least(CAST(datediff('day', CAST(last_seen_date AS DATE), CAST(signal_date AS DATE)) AS DOUBLE) / 7.0, 1.0::DOUBLE) AS churn_risk_score FROM s""")
def gold_user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.compute_user_signals(bronze(spark, sf_dir))


# Features


def _features_sql(source: str, ref: str, days: str, group: str = "user_id") -> str:
    since = lambda ms: f"timestamp_ms >= {ref} - {ms}"
    windows = (("1h", 3_600_000), ("24h", DAY_MS), ("7d", 7 * DAY_MS))
    counts = ", ".join(f"count(*) FILTER (event_type = 'PURCHASE' AND {since(ms)}) AS purchase_count_{w}" for w, ms in windows)
    sums = ", ".join(f"CAST(coalesce(sum(amount_cents) FILTER (event_type = 'PURCHASE' AND {since(ms)}), 0) AS BIGINT) AS revenue_sum_{w}" for w, ms in windows)
    gap = f"(max({ref}) - max(timestamp_ms) FILTER (event_type = 'PURCHASE'))"
    return f"""SELECT {group}, make_timestamp(max({ref}) * 1000)::TIMESTAMPTZ AS event_timestamp, {counts}, {sums},
    count(DISTINCT session_id) FILTER ({since(DAY_MS)}) AS session_count_24h, count(*) FILTER ({since(DAY_MS)}) AS event_count_24h,
    CASE WHEN max(timestamp_ms) FILTER (event_type = 'PURCHASE') IS NULL THEN 999 ELSE {days.format(gap=gap)} END AS days_since_last_purchase
    FROM {source} GROUP BY {group}"""


_HALF_EVEN = "CAST(round_even({gap} / 86400000.0::DOUBLE, 0) AS BIGINT)"
_FLOOR = "CAST(floor({gap} / 86400000.0::DOUBLE) AS BIGINT)"
_REFS = "(SELECT *, (SELECT max(timestamp_ms) FROM bronze) AS ref_ms FROM bronze)"
_USER_FEATURES_SQL = f"WITH {BRONZE_SQL}, f AS ({_features_sql(_REFS, 'ref_ms', _HALF_EVEN)}) SELECT * EXCLUDE (event_timestamp) FROM f"


@query(_USER_FEATURES_SQL)
def user_features_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.compute_features(bronze(spark, sf_dir)).drop("event_timestamp")


@query(f"WITH {BRONZE_SQL}, f AS ({_features_sql(_REFS, 'ref_ms', _FLOOR)}) SELECT * EXCLUDE (event_timestamp) FROM f")
def user_features_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.compute_features(bronze(spark, sf_dir), rounding="floor").drop("event_timestamp")


_HISTORY_ROWS = f"(SELECT b.*, s.ref_ms FROM bronze b JOIN (SELECT unnest({SNAPSHOTS}) AS ref_ms) s ON b.timestamp_ms <= s.ref_ms)"
_HISTORY_SQL = _features_sql(_HISTORY_ROWS, "ref_ms", _HALF_EVEN, "user_id, ref_ms")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_history(bronze(spark, sf_dir), SNAPSHOTS)


@query(f"WITH {BRONZE_SQL}, h AS ({_HISTORY_SQL}) SELECT * EXCLUDE (event_timestamp) FROM h")
def features_as_of_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).withColumn("ref_ms", F.unix_millis("event_timestamp")).drop("event_timestamp")


_LATEST = ", ".join(FEATURES)


@query(f"""WITH {BRONZE_SQL}, h AS ({_HISTORY_SQL}) SELECT user_id, ref_ms, {_LATEST} FROM h
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ref_ms DESC) = 1""")
def online_latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_per_entity(_history(spark, sf_dir)).withColumn("ref_ms", F.unix_millis("event_timestamp")).drop("event_timestamp")


@query(f"""WITH {BRONZE_SQL}, h AS ({_HISTORY_SQL}), e AS (SELECT id, user_id, timestamp_ms FROM bronze)
SELECT e.id, e.user_id, e.timestamp_ms, {", ".join(f"CASE WHEN e.timestamp_ms - h.ref_ms <= {7 * DAY_MS} THEN h.{f} END AS {f}" for f in FEATURES)}
FROM e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.timestamp_ms >= h.ref_ms""")
def pit_training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = bronze(spark, sf_dir).select(F.col("kafka_offset").alias("id"), "user_id", "timestamp_ms", F.timestamp_millis("timestamp_ms").alias("event_timestamp"))
    return features.point_in_time_join(entities, _history(spark, sf_dir)).drop("event_timestamp")


@query(f"""WITH {BRONZE_SQL}, f AS (SELECT DISTINCT user_id FROM bronze WHERE event_type = 'PURCHASE' AND event_date >= '2024-01-20'),
a AS (SELECT DISTINCT user_id FROM bronze WHERE device_type = 'MOBILE' UNION SELECT 'USER-none')
SELECT count(*) AS requested, count(f.user_id) AS found, count(*) - count(f.user_id) AS failed FROM a LEFT JOIN f ON a.user_id = f.user_id""")
def feature_lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bronze(spark, sf_dir)
    known = events.filter("event_type = 'PURCHASE' AND event_date >= '2024-01-20'").select("user_id")
    asked = events.filter("device_type = 'MOBILE'").select("user_id").unionByName(spark.createDataFrame([("USER-none",)], "user_id string"))
    return features.lookup_counts(known, asked)


@query(_USER_FEATURES_SQL + " WHERE user_id IN (SELECT user_id FROM bronze WHERE device_type = 'SMARTWATCH')")
def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bronze(spark, sf_dir)
    return features.lookup(features.compute_features(events).drop("event_timestamp"), events.filter("device_type = 'SMARTWATCH'"))


# Data contract


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ERRORS_SQL = "[x FOR x IN [" + ", ".join(
    [f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' THEN 'expect_column_values_to_not_be_null: ''{c}''' END" for c in REQUIRED]
    + [f"CASE WHEN NOT coalesce({c} IN ({_list(v)}), false) THEN 'expect_column_values_to_be_in_set: {c}=''' || coalesce({c}, 'None') || '''' END" for c, v in (("event_type", EVENT_TYPES), ("device_type", DEVICE_TYPES))]
    + [f"CASE WHEN NOT timestamp_ms BETWEEN {TS_MIN_MS} AND {TS_MAX_MS} THEN 'expect_column_values_to_be_between: timestamp_ms=' || timestamp_ms END"]
    + ["CASE WHEN NOT coalesce(regexp_matches(country_code, '^[A-Z]{2}$'), false) THEN 'expect_column_values_to_match_regex: country_code=''' || coalesce(country_code, 'None') || '''' END"]
    + ["CASE WHEN event_type = 'PURCHASE' AND (amount_cents IS NULL OR amount_cents <= 0) THEN 'conditional_expectation: PURCHASE requires amount_cents > 0, got ' || coalesce(CAST(amount_cents AS VARCHAR), 'None') END"]
) + "] IF x IS NOT NULL]"


@query(f"WITH {BRONZE_SQL} SELECT event_id, array_to_string({_ERRORS_SQL}, ' | ') AS errors FROM bronze WHERE len({_ERRORS_SQL}) > 0")
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = quality.split(bronze(spark, sf_dir))
    return invalid.select("event_id", F.array_join("errors", " | ").alias("errors"))


@query(f"""WITH {BRONZE_SQL} SELECT count(*) AS total, count(*) FILTER (len({_ERRORS_SQL}) = 0) AS valid, count(*) FILTER (len({_ERRORS_SQL}) > 0) AS invalid,
count(*) FILTER (len({_ERRORS_SQL}) = 0) / count(*) AS pass_rate FROM bronze""")
def validate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(bronze(spark, sf_dir))


@query(f"""WITH {BRONZE_SQL} SELECT event_id, event_type, user_id, session_id, timestamp_ms, page_url, product_id, amount_cents, device_type, country_code, app_version,
'validation_failure' AS quarantine_reason, array_to_string({_ERRORS_SQL}, ' | ') AS validation_errors, CAST({PROCESSED_MS} AS BIGINT) AS silver_processed_ms, CAST(NULL AS VARCHAR) AS ingestion_date
FROM bronze WHERE len({_ERRORS_SQL}) > 0""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = quality.split(bronze(spark, sf_dir).drop("ingestion_date"))
    rows = quality.quarantine(invalid, PROCESSED_MS)
    return rows.withColumn("validation_errors", F.array_join(F.from_json("validation_errors", "array<string>"), " | "))


# Lateness, deduplication, cleaning

_MARKED_SQL = f"""{DUPLICATED_SQL}, m AS (SELECT *, max(timestamp_ms) OVER (ORDER BY arrival_seq, event_id ROWS UNBOUNDED PRECEDING) AS top FROM arrived),
marked AS (SELECT *, CASE WHEN timestamp_ms >= greatest(0, top - {LATENESS.allowed_ms}) THEN 'on_time' WHEN timestamp_ms >= top - {LATENESS.max_late_ms} THEN 'late' ELSE 'discard' END AS watermark_classification FROM m)"""
_OUTCOME_SQL = f"""{_MARKED_SQL}, live AS (SELECT *, row_number() OVER (PARTITION BY event_id, watermark_classification <> 'discard' ORDER BY arrival_seq) AS nth FROM marked),
outcomes AS (SELECT *, CASE WHEN watermark_classification = 'discard' THEN 'discarded' WHEN nth > 1 THEN 'duplicate'
  WHEN watermark_classification = 'on_time' AND len({_ERRORS_SQL}) > 0 THEN 'quarantined' WHEN watermark_classification = 'late' THEN 'late' ELSE 'silver' END AS outcome FROM live)"""


@query(f"WITH {_MARKED_SQL} SELECT event_id, arrival_seq, watermark_classification FROM marked")
def watermark_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.classify(bronze(spark, sf_dir, duplicates=True), LATENESS).select("event_id", "arrival_seq", "watermark_classification")


@query(f"WITH {BRONZE_SQL} SELECT 'on_time' AS watermark_classification, count(*) AS n FROM bronze")
def watermark_batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = watermark.classify(bronze(spark, sf_dir), LATENESS, arrival="timestamp_ms")
    return marked.groupBy("watermark_classification").agg(F.count("*").alias("n"))


@query(f"""WITH {_OUTCOME_SQL} SELECT count(*) AS total, count(*) FILTER (watermark_classification = 'on_time') AS on_time, count(*) FILTER (watermark_classification = 'late') AS late,
count(*) FILTER (outcome = 'discarded') AS discarded, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'quarantined') AS quarantined,
count(*) FILTER (outcome IN ('silver', 'late')) AS silver FROM outcomes""")
def silver_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.outcome_counts(bronze(spark, sf_dir, duplicates=True), OPTIONS)


@query(f"WITH {DUPLICATED_SQL} SELECT event_id, arrival_seq, timestamp_ms, user_id FROM arrived QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.first_per_key(bronze(spark, sf_dir, duplicates=True)).select("event_id", "arrival_seq", "timestamp_ms", "user_id")


@query(f"""WITH RECURSIVE {BRONZE_SQL}, t AS (SELECT user_id, timestamp_ms, arrival_seq, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms, arrival_seq) AS n FROM bronze),
r AS (SELECT user_id, timestamp_ms, arrival_seq, n, timestamp_ms AS last, true AS ok FROM t WHERE n = 1
UNION ALL SELECT t.user_id, t.timestamp_ms, t.arrival_seq, t.n, CASE WHEN t.timestamp_ms - r.last >= 3600000 THEN t.timestamp_ms ELSE r.last END, t.timestamp_ms - r.last >= 3600000
FROM t JOIN r ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, timestamp_ms, arrival_seq FROM r WHERE ok""")
def dedup_ttl_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.accepted_within_ttl(bronze(spark, sf_dir), key="user_id")


@query(f"""WITH {_OUTCOME_SQL} SELECT event_id, event_type, user_id, session_id, timestamp_ms, page_url, product_id, amount_cents, device_type, country_code, app_version,
CAST({PROCESSED_MS} AS BIGINT) AS silver_processed_ms, watermark_classification, event_date FROM outcomes WHERE outcome IN ('silver', 'late')""")
def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = silver.bronze_to_silver(bronze(spark, sf_dir, duplicates=True), PROCESSED_MS, OPTIONS)
    return good


@query(f"""WITH {_OUTCOME_SQL} SELECT event_id, amount_cents, watermark_classification FROM outcomes WHERE outcome IN ('silver', 'late')""")
def silver_from_array_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning path on amounts as array libraries write them: fractional, and NaN where there is none."""
    events = bronze(spark, sf_dir, duplicates=True)
    amount = F.when(F.col("amount_cents").isNull(), F.lit(float("nan"))).otherwise(F.col("amount_cents") + F.lit(0.25))
    good, _ = silver.bronze_to_silver(events.withColumn("amount_cents", amount), PROCESSED_MS, OPTIONS)
    return good.select("event_id", "amount_cents", "watermark_classification")


# Labels and splits

_LABELS_SQL = f"""{BRONZE_SQL}, e AS (SELECT * FROM bronze WHERE timestamp_ms <= (SELECT max(timestamp_ms) FROM bronze) - {7 * DAY_MS})"""


@query(f"""WITH {_LABELS_SQL}, l AS (SELECT user_id, max(timestamp_ms) AS last_seen FROM bronze GROUP BY 1)
SELECT event_id, e.user_id, CAST(last_seen - timestamp_ms < {7 * DAY_MS} AS INTEGER) AS churned_7d FROM e JOIN l ON e.user_id = l.user_id""")
def churn_labels_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.churn_labels(bronze(spark, sf_dir)).drop("event_timestamp")


@query(f"""WITH {_LABELS_SQL} SELECT event_id, user_id, CAST(NOT EXISTS (SELECT 1 FROM bronze b WHERE b.user_id = e.user_id AND b.timestamp_ms > e.timestamp_ms
AND b.timestamp_ms <= e.timestamp_ms + {7 * DAY_MS}) AS INTEGER) AS churned_7d_strict FROM e""")
def churn_labels_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.churn_labels_strict(bronze(spark, sf_dir)).drop("event_timestamp")


@query(f"""WITH {_LABELS_SQL} SELECT event_id, user_id FROM e ORDER BY md5('42|' || event_id), event_id LIMIT 500""")
def sampled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.sample_rows(labels.churn_labels(bronze(spark, sf_dir)), 500, "event_id").select("event_id", "user_id")


@query(f"""WITH {ORDERS_SQL} SELECT CAST(customer_unique_id AS VARCHAR) AS user_id, count(order_id) AS n_orders, CAST(count(order_id) = 1 AS INTEGER) AS label
FROM xorders o JOIN xcustomers c ON o.customer_id = c.customer_id WHERE order_status = 'delivered' GROUP BY 1""")
def repeat_buyer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_tables(spark, sf_dir)
    return labels.repeat_buyer_labels(t["orders"], t["customers"])


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS n,
count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer) SELECT c_custkey, c_mktsegment, n <= ceil(total * 0.8::DOUBLE) AS is_train FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query(f"""WITH {ORDERS_SQL}, l AS (SELECT customer_unique_id, CAST(count(order_id) = 1 AS INTEGER) AS label FROM xorders o JOIN xcustomers c ON o.customer_id = c.customer_id
WHERE order_status = 'delivered' GROUP BY 1) SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
CASE WHEN count(*) FILTER (label = 1) > 0 THEN count(*) FILTER (label = 0) / count(*) FILTER (label = 1) ELSE 1.0::DOUBLE END AS scale_pos_weight FROM l""")
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_weight(repeat_buyer_labels(spark, sf_dir), "label")


# A/B, scores, alerts, monitoring

_BUCKET_SQL = "CAST(('0x' || substr(md5({c}), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE"
_USERS_SQL = "u AS (SELECT DISTINCT user_id FROM bronze)"
# A score from the hash of user and day; each event is a scoring.
_SCORES_SQL = f"""{BRONZE_SQL}, scored AS (SELECT CASE WHEN kafka_partition = 0 THEN 'acme' ELSE 'default' END AS tenant, user_id, timestamp_ms AS scored_ms,
round({_BUCKET_SQL.format(c="user_id || event_date")}, 6) AS score FROM bronze),
latest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY tenant, user_id ORDER BY scored_ms DESC, score DESC) = 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.conv(F.substring(F.md5(F.concat("user_id", "event_date")), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)
    return bronze(spark, sf_dir).select(
        F.when(F.col("kafka_partition") == 0, "acme").otherwise("default").alias("tenant"),
        "user_id",
        F.col("timestamp_ms").alias("scored_ms"),
        F.round(bucket, 6).alias("score"),
    )


@query(f"""WITH {BRONZE_SQL}, {_USERS_SQL} SELECT user_id, CASE WHEN {_BUCKET_SQL.format(c="user_id")} < 0.9::DOUBLE THEN 'champion' ELSE 'challenger' END AS ab_group FROM u""")
def ab_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.assign(bronze(spark, sf_dir).select("user_id").distinct())


@query(f"""WITH {BRONZE_SQL}, {_USERS_SQL}, a AS (SELECT {_BUCKET_SQL.format(c="user_id")} < 0.9::DOUBLE AS c FROM u)
SELECT count(*) AS total, count(*) FILTER (c) AS champion, count(*) FILTER (NOT c) AS challenger, count(*) FILTER (c) / count(*) AS champion_pct FROM a""")
def ab_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.split_stats(bronze(spark, sf_dir).select("user_id").distinct())


@query(f"WITH {_SCORES_SQL} SELECT * FROM latest")
def score_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.upsert_scores(_scored(spark, sf_dir))


@query(f"WITH {_SCORES_SQL} SELECT user_id, round(score, 4) AS churn_probability FROM latest WHERE tenant = 'default' AND score >= 0.7 ORDER BY score DESC, user_id LIMIT 100")
def alerts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.alerts(serving.upsert_scores(_scored(spark, sf_dir)), "default")


@query(f"""WITH {_SCORES_SQL}, f AS (SELECT DISTINCT user_id FROM bronze WHERE event_type = 'PURCHASE' AND event_date >= '2024-01-25'), {_USERS_SQL},
hi AS (SELECT DISTINCT user_id FROM latest WHERE tenant = 'default' AND score >= 0.7)
SELECT count(f.user_id) AS scored, count(*) - count(f.user_id) AS failed, count(*) FILTER (f.user_id IS NOT NULL AND hi.user_id IS NOT NULL) AS alerts
FROM u LEFT JOIN f ON u.user_id = f.user_id LEFT JOIN hi ON u.user_id = hi.user_id""")
def alerts_refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bronze(spark, sf_dir)
    known = events.filter("event_type = 'PURCHASE' AND event_date >= '2024-01-25'").select("user_id")
    latest = serving.upsert_scores(_scored(spark, sf_dir)).filter("tenant = 'default'")
    return serving.refresh_counts(known, events.select("user_id"), latest)


@query(f"WITH {_SCORES_SQL} SELECT tenant, count(DISTINCT user_id) AS total_scored FROM latest GROUP BY 1")
def total_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.total_scored(serving.upsert_scores(_scored(spark, sf_dir)))


@query(f"""WITH {_SCORES_SQL} SELECT count(*) FILTER (score >= 0.70) AS high, count(*) FILTER (score >= 0.30 AND score < 0.70) AS medium, count(*) FILTER (score < 0.30) AS low,
round(avg(score), 6) AS mean_score, max(score) AS max_score FROM latest""")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.risk_bands(serving.upsert_scores(_scored(spark, sf_dir)))


@query(f"""WITH {_USER_FEATURES_SQL[5:].replace("SELECT * EXCLUDE (event_timestamp) FROM f", "")}, l AS (SELECT user_id, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature,
unnest([{", ".join(f"({f} - 5) / 7.0::DOUBLE" for f in FEATURES)}]) AS v, unnest(range({len(FEATURES)})) AS i FROM f)
SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS place, feature, round(v, 4) AS shap_value, CASE WHEN v > 0 THEN 'increases_churn' ELSE 'decreases_churn' END AS direction
FROM l WINDOW w AS (PARTITION BY user_id ORDER BY abs(v) DESC, i) QUALIFY row_number() OVER w <= 3""")
def top_feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.compute_features(bronze(spark, sf_dir))
    values = F.array(*[(F.col(f) - 5) / F.lit(7.0) for f in FEATURES])
    best = rows.select("user_id", F.posexplode(serving.top_contributions(F.array(*map(F.lit, FEATURES)), values)).alias("at", "e"))
    return best.select("user_id", (F.col("at") + 1).alias("place"), "e.feature", "e.shap_value", "e.direction")


@query(f"""WITH {_SCORES_SQL} SELECT user_id, json_extract_string(p, '$.event') AS event, CAST(json_extract_string(p, '$.churn_probability') AS DOUBLE) AS churn_probability,
json_extract_string(p, '$.ab_group') AS ab_group FROM (SELECT user_id, json_object('event', 'churn_alert', 'churn_probability', score,
'ab_group', CASE WHEN {_BUCKET_SQL.format(c="user_id")} < 0.9::DOUBLE THEN 'champion' ELSE 'challenger' END) AS p FROM latest WHERE tenant = 'default' AND score >= 0.7)""")
def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = serving.assign(serving.upsert_scores(_scored(spark, sf_dir)).filter("tenant = 'default'"))
    rows = latest.withColumns({"model_version": F.lit("1"), "top_features": F.array().cast("array<string>"), "alerted_at": F.lit("2024-02-01T00:00:00+00:00")})
    payloads = serving.alert_payloads(rows)
    get = lambda key: F.get_json_object("payload", f"$.{key}")
    return payloads.select("user_id", get("event").alias("event"), get("churn_probability").cast("double").alias("churn_probability"), get("ab_group").alias("ab_group"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS model, max(c_custkey) AS champion, min(c_custkey) AS challenger
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS n FROM customer) WHERE n <= 2 GROUP BY 1""")
def registry_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("model"), F.col("c_custkey").alias("version"))
    return serving.registry_roles(versions)


@query(f"""WITH {_SCORES_SQL} SELECT '1' AS model_version, CASE WHEN {_BUCKET_SQL.format(c="user_id")} < 0.9::DOUBLE THEN 'champion' ELSE 'challenger' END AS ab_group,
score >= 0.5 AS churn_prediction, count(*) AS predictions FROM scored GROUP BY ALL""")
def prediction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.prediction_counters(serving.assign(_scored(spark, sf_dir)).withColumn("model_version", F.lit("1")))


@query("""SELECT event_type, le, count(*) FILTER (value / 500.0::DOUBLE <= coalesce(le, 'inf'::DOUBLE)) AS n
FROM events, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, NULL]::DOUBLE[]) AS le) GROUP BY 1, 2""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / F.lit(500.0)).alias("seconds"))
    return serving.cumulative_histogram(rows, "seconds", ["event_type"])


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.quantiles(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(*) * 1000000.0::DOUBLE / 86400000000 AS per_second FROM events GROUP BY 1")
def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return serving.rate_per_window(rows, "ts").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "per_second")


# Drift

_LONG = lambda source: f"(SELECT unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, unnest([{', '.join(f + '::DOUBLE' for f in FEATURES)}]) AS value FROM {source})"
_EDGES_SQL = """edges AS (SELECT feature, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM (SELECT feature, min(value) AS lo, max(value) AS hi FROM base GROUP BY 1)),
bins AS (SELECT feature, [CASE WHEN i = 10 THEN hi ELSE lo + i::DOUBLE * ((hi - lo) / 10.0::DOUBLE) END FOR i IN range(11)] AS e FROM edges)"""
_BIN = "CASE WHEN value >= e[1] AND value <= e[11] THEN least(len([x FOR x IN e IF x <= value]) - 1, 9) END"
_OLD_FEATURES = _features_sql(f"(SELECT *, {MID_MS} AS ref_ms FROM bronze WHERE timestamp_ms <= {MID_MS})", "ref_ms", _HALF_EVEN)
_DRIFT_SQL = f"""{BRONZE_SQL}, old AS ({_OLD_FEATURES}), new AS ({_features_sql(_REFS, "ref_ms", _FLOOR)}),
base AS (SELECT * FROM {_LONG("old")}), cur AS (SELECT * FROM {_LONG("new")}), {_EDGES_SQL},
b AS (SELECT feature, {_BIN} AS bin, count(*) AS c FROM base JOIN bins USING (feature) GROUP BY 1, 2), c AS (SELECT feature, {_BIN} AS bin, count(*) AS c FROM cur JOIN bins USING (feature) GROUP BY 1, 2),
bs AS (SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS p50 FROM base GROUP BY 1),
cs AS (SELECT feature, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50 FROM cur GROUP BY 1),
grid AS (SELECT feature, i AS bin FROM bins, (SELECT unnest(range(10)) AS i)),
psi AS (SELECT g.feature, sum((a - x) * ln(a / x)) AS psi FROM (SELECT g.feature, g.bin, greatest(coalesce(c.c, 0) / cs.n, 1e-6::DOUBLE) AS a, greatest(coalesce(b.c, 0) / bs.n, 1e-6::DOUBLE) AS x
  FROM grid g JOIN bs ON g.feature = bs.feature JOIN cs ON g.feature = cs.feature LEFT JOIN b ON g.feature = b.feature AND g.bin = b.bin LEFT JOIN c ON g.feature = c.feature AND g.bin = c.bin) g GROUP BY 1),
report AS (SELECT p.feature, round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'retrain' END AS status,
  bs.mean AS baseline_mean, round(cs.mean, 4) AS current_mean, bs.p50 AS baseline_p50, round(cs.p50, 4) AS current_p50, bs.n AS baseline_n, cs.n AS current_n
  FROM psi p JOIN bs ON p.feature = bs.feature JOIN cs ON p.feature = cs.feature)"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.baseline_histograms(features.compute_features(bronze(spark, sf_dir), as_of_ms=MID_MS))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi_by_feature(_baseline(spark, sf_dir), features.compute_features(bronze(spark, sf_dir), rounding="floor"))


@query(f"""WITH {_DRIFT_SQL} SELECT g.feature, g.bin, round(e[g.bin + 1], 6) AS lo, coalesce(b.c, 0) AS n, round(bs.mean, 6) AS mean, round(bs.std, 6) AS std, bs.p50 FROM grid g JOIN bins ON g.feature = bins.feature
JOIN bs ON g.feature = bs.feature LEFT JOIN b ON g.feature = b.feature AND g.bin = b.bin""")
def baseline_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baseline(spark, sf_dir).select("feature", "bin_edges", F.posexplode("bin_counts").alias("bin", "n"), "mean", "std", "p50")
    return rows.select("feature", F.col("bin").cast("long").alias("bin"), F.round(F.element_at("bin_edges", F.col("bin") + 1), 6).alias("lo"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "p50")


@query(f"WITH {_DRIFT_SQL} SELECT feature, psi, status FROM report")
def psi_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("feature", "psi", "status")


@query(f"WITH {_DRIFT_SQL} SELECT * REPLACE (round(baseline_mean, 6) AS baseline_mean) FROM report")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).withColumn("baseline_mean", F.round("baseline_mean", 6))


@query(f"""WITH {_DRIFT_SQL} SELECT bool_or(status = 'retrain') AS drift_alert, count(*) FILTER (status = 'stable') AS stable,
count(*) FILTER (status = 'moderate') AS moderate, count(*) FILTER (status = 'retrain') AS retrain FROM report""")
def drift_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_alert(_report(spark, sf_dir))


# Order exports


def _rollup(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    t = order_tables(spark, sf_dir, placed)
    return orders.order_rollup(t["orders"], t["customers"], t["payments"], t["items"], "line" if placed else None)


@query(f"WITH {ORDERS_SQL} SELECT order_id, customer_unique_id, epoch_us(order_purchase_timestamp) AS purchase_us, round(total_payment, 4) AS total_payment, first_product_id FROM rollup_")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rollup(spark, sf_dir)
    return rows.select("order_id", "customer_unique_id", F.unix_micros("order_purchase_timestamp").alias("purchase_us"), F.round("total_payment", 4).alias("total_payment"), "first_product_id")


_COMPRESS_SQL = f"""{ORDERS_SQL}, k AS (SELECT *, epoch_us(order_purchase_timestamp) // 1000 AS ms FROM rollup_), b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM k),
compressed AS (SELECT k.*, CASE WHEN lo = hi THEN {PROCESSED_MS} ELSE CAST(trunc({PROCESSED_MS - 30 * DAY_MS}::DOUBLE + (ms - lo) / (hi - lo) * {30 * DAY_MS}::DOUBLE) AS BIGINT) END AS timestamp_ms FROM k, b)"""


@query(f"WITH {_COMPRESS_SQL} SELECT order_id, timestamp_ms FROM compressed")
def time_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.compress_timestamps(_rollup(spark, sf_dir), PROCESSED_MS, 30).select("order_id", "timestamp_ms")


@query(f"""WITH {_COMPRESS_SQL} SELECT md5('order|' || order_id) AS event_id, 'PURCHASE' AS event_type, CAST(customer_unique_id AS VARCHAR) AS user_id, CAST(order_id AS VARCHAR) AS session_id, timestamp_ms,
CAST(NULL AS VARCHAR) AS page_url, CAST(first_product_id AS VARCHAR) AS product_id, greatest(1, CAST(round_even(total_payment * 100, 0) AS BIGINT)) AS amount_cents, 'UNKNOWN' AS device_type, 'BR' AS country_code, 'olist-1.0' AS app_version FROM compressed""")
def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Amounts are rounded to cents: payments are added in the order of their lines.
    return orders.build_events(orders.compress_timestamps(_rollup(spark, sf_dir, placed=True), PROCESSED_MS, 30))


@query(f"""WITH {ORDERS_SQL}, o AS (SELECT o.*, customer_unique_id FROM xorders o LEFT JOIN xcustomers c ON o.customer_id = c.customer_id),
d AS (SELECT customer_unique_id, round_even(avg(floor((epoch_us(delivered) - epoch_us(estimated)) / 86400000000.0::DOUBLE)), 2) AS v FROM o GROUP BY 1),
r AS (SELECT customer_unique_id, round_even(avg(1 + order_id % 5), 4) AS v FROM o GROUP BY 1),
p AS (SELECT customer_unique_id, round_even(avg(payment_installments), 2) AS v FROM xpayments JOIN o ON xpayments.order_id = o.order_id GROUP BY 1)
SELECT CAST(coalesce(d.customer_unique_id, r.customer_unique_id, p.customer_unique_id) AS VARCHAR) AS user_id, d.v AS avg_delivery_delay_days, r.v AS avg_review_score, p.v AS avg_payment_installments
FROM d FULL JOIN r ON d.customer_unique_id = r.customer_unique_id FULL JOIN p ON coalesce(d.customer_unique_id, r.customer_unique_id) = p.customer_unique_id
WHERE coalesce(d.customer_unique_id, r.customer_unique_id, p.customer_unique_id) IS NOT NULL""")
def customer_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_tables(spark, sf_dir)
    return orders.customer_enrichment(t["orders"], t["customers"], t["reviews"], t["payments"])


# Normalisers, on payloads made from orders

_NORMAL_COLUMNS = ["event_id", "event_type", "user_id", "timestamp_ms", "page_url", "product_id", "amount_cents", "device_type", "country_code", "app_version", "kafka_topic"]
_NORMAL_SQL = """WITH o AS (SELECT *, CAST(o_totalprice AS VARCHAR) AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 977 AS VARCHAR) END AS product, ['US', 'de', 'Brazil', ''][o_orderkey % 4 + 1] AS place FROM orders)
SELECT '{prefix}' || o_orderkey AS event_id, 'purchase' AS event_type, '{user}' || o_custkey AS user_id, epoch_us(o_orderdate) // 1000 AS timestamp_ms,
{page} AS page_url, product AS product_id, CASE WHEN o_orderkey % 31 = 3 THEN 0 ELSE CAST(trunc(o_totalprice * 100) AS BIGINT) END AS amount_cents, 'web' AS device_type,
CASE o_orderkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'BR' ELSE 'US' END AS country_code, '{version}' AS app_version, '{topic}' AS kafka_topic FROM o WHERE o_orderkey % 13 <> 0 AND o_orderkey % 29 NOT IN (1, 2, 3) AND o_orderkey % 37 NOT IN (1, 2) AND {real}"""


def _order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "IF(o_orderkey % 13 = 0, NULL, CAST(o_orderkey AS string)) AS id", "CAST(o_custkey AS string) AS customer",
        # Texts that are no amounts or times, or none that fit, and the text "0", which is an amount.
        "CASE o_orderkey % 29 WHEN 1 THEN 'NaN' WHEN 2 THEN '1e30' WHEN 3 THEN '-Infinity' ELSE IF(o_orderkey % 31 = 3, '0', CAST(o_totalprice AS string)) END AS price",
        "CASE o_orderkey % 37 WHEN 1 THEN '-1e30' WHEN 2 THEN 'NaN' ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") END AS at", "IF(o_orderkey % 10 = 0, NULL, CAST(o_orderkey % 977 AS string)) AS product",
        "element_at(array('US', 'de', 'Brazil', ''), CAST(o_orderkey % 4 AS int) + 1) AS place",
    )


def _normal_sql(feed: str, page: str = "CAST(NULL AS VARCHAR)") -> str:
    # A webhook's customer number 0 counts as missing; in a CSV it is a text like any other.
    return _NORMAL_SQL.format(**normalize.FEEDS[feed], page=page, real="true" if feed == "csv" else "o_custkey <> 0")


@query(_normal_sql("shopify", "'/l/' || o_orderkey"))
def normalize_shopify(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.expr("IF(product IS NULL, CAST(array() AS array<struct<product_id:string>>), array(struct(product AS product_id)))")
    body = F.struct("id", F.struct(F.col("customer").cast("long").alias("id")).alias("customer"), F.col("at").alias("created_at"), F.col("price").alias("total_price"), F.lit("50.00").alias("subtotal_price"), F.concat(F.lit("/l/"), "id").alias("landing_site"), F.struct(F.col("place").alias("country_code")).alias("billing_address"), items.alias("line_items"))
    good, _ = normalize.split_errors(normalize.shopify(_order_fields(spark, sf_dir).select(F.to_json(body).alias("value")), PROCESSED_MS))
    return good.select(*_NORMAL_COLUMNS)


@query(_normal_sql("woocommerce"))
def normalize_woo(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.expr("IF(product IS NULL, CAST(array() AS array<struct<product_id:string>>), array(struct(product AS product_id)))")
    body = F.struct("id", F.col("customer").cast("long").alias("customer_id"), F.lit("").alias("date_created"), F.col("at").alias("date_created_gmt"), F.col("price").alias("total"), F.struct(F.col("place").alias("country")).alias("billing"), items.alias("line_items"))
    good, _ = normalize.split_errors(normalize.woocommerce(_order_fields(spark, sf_dir).select(F.to_json(body).alias("value")), PROCESSED_MS))
    return good.select(*_NORMAL_COLUMNS)


@query(_normal_sql("csv"))
def normalize_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_fields(spark, sf_dir).select(F.col("id").alias("Order_Number"), F.col("customer").alias("client_id"), F.col("at").alias("Date"), F.concat(F.lit("$"), "price").alias("TOTAL"), F.col("product").alias("sku"), F.col("place").alias("ship_country"))
    good, _ = normalize.split_errors(normalize.csv_rows(rows, PROCESSED_MS))
    return good.select(*_NORMAL_COLUMNS)


@query("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'No order_id' WHEN o_orderkey % 29 IN (1, 2, 3) THEN 'Bad amount' END AS error FROM orders) WHERE error IS NOT NULL GROUP BY 1""")
def normalize_csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_fields(spark, sf_dir).select(F.col("id").alias("order_id"), F.col("customer").alias("email"), "price")
    _, bad = normalize.split_errors(normalize.csv_rows(rows, PROCESSED_MS))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'Missing ' || chr(39) || 'id' || chr(39) WHEN o_custkey = 0 THEN 'Missing ' || chr(39) || 'customer_id' || chr(39) WHEN o_orderkey % 37 IN (1, 2) THEN 'Bad time'
WHEN o_orderkey % 29 IN (1, 2, 3) THEN 'Bad amount' END AS error FROM orders) WHERE error IS NOT NULL GROUP BY 1""")
def normalize_woo_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct("id", F.col("customer").cast("long").alias("customer_id"), F.col("at").alias("date_created"), F.col("price").alias("total"))
    _, bad = normalize.split_errors(normalize.woocommerce(_order_fields(spark, sf_dir).select(F.to_json(body).alias("value")), PROCESSED_MS))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


# Tables and feeds


@query(f"WITH {BRONZE_SQL} SELECT event_date AS ingestion_date, 'files' AS kafka_topic, count(*) AS n, CAST((SELECT count(*) FROM bronze) AS BIGINT) AS appended, 0 AS appended_empty FROM bronze GROUP BY 1")
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ingest metadata, appended to a table by date, and nothing for an empty append."""
    sink = TableIO(scratch(spark, "append"), partition_by=("ingestion_date",))
    raw = bronze(spark, sf_dir).drop("kafka_topic", "kafka_partition", "kafka_offset", "ingestion_timestamp_ms")
    rows = feeds.with_ingest_metadata(raw, PROCESSED_MS)
    n, none = sink.append(rows), sink.append(rows.limit(0))
    found = sink.read(spark).groupBy(F.col("ingestion_date").cast("string").alias("ingestion_date"), "kafka_topic").agg(F.count("*").alias("n"))
    return found.withColumns({"appended": F.lit(n).cast("long"), "appended_empty": F.lit(none)})


# In a CSV ids are texts, and are compared as such where an item number repeats.
_TEXT_ORDERS_SQL = ORDERS_SQL.replace("ORDER BY l_linenumber, l_partkey, l_suppkey", "ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)")


@query(f"""WITH {_TEXT_ORDERS_SQL} SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_unique_id AS VARCHAR) AS customer_unique_id, epoch_us(order_purchase_timestamp) AS purchase_us,
round(total_payment, 4) AS total_payment, CAST(first_product_id AS VARCHAR) AS first_product_id FROM rollup_""")
def order_export_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order export written as CSV files, read back by role, and rolled up."""
    root, t = scratch(spark, "export"), order_tables(spark, sf_dir)
    paths = {role: f"{root}/{role}" for role in feeds.ORDER_FILES}
    for role, path in paths.items():
        t[role].write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    found = feeds.order_export(spark, paths)
    rows = orders.order_rollup(found["orders"], found["customers"], found["payments"], found["items"])
    return rows.select("order_id", "customer_unique_id", F.unix_micros("order_purchase_timestamp").alias("purchase_us"), F.round("total_payment", 4).alias("total_payment"), "first_product_id")


@query(f"""WITH {BRONZE_SQL}, c AS (SELECT {", ".join(f"count({f.name}) AS {f.name}" for f in EVENT)} FROM bronze)
SELECT unnest({[f.name for f in EVENT]}) AS field, unnest({["BIGINT" if f.dataType.simpleString() == "bigint" else "VARCHAR" for f in EVENT]}) AS type, unnest({str([f.nullable for f in EVENT]).lower()}) AS nullable, unnest([{", ".join(f.name for f in EVENT)}]) AS present FROM c""")
def avro_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event schema through its registered Avro form and back, and how many events have each of its fields, in its type."""
    found = from_avro_json(to_avro_json(EVENT, "UserEvent"))
    names = {"bigint": "BIGINT", "string": "VARCHAR"}
    counts = bronze(spark, sf_dir).agg(*[F.count(F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in found])
    rows = [F.struct(F.lit(f.name).alias("field"), F.lit(names[f.dataType.simpleString()]).alias("type"), F.lit(f.nullable).alias("nullable"), F.col(f.name).alias("present")) for f in found]
    return counts.select(F.inline(F.array(*rows)))


# Of each table its rows, and a measure that all of its rows add to.
_RUN_ALL = {"dau": "total_events", "revenue": "total_revenue_cents", "funnel": "total_purchases", "user_signals": "total_events_7d"}


@query(f"""WITH {BRONZE_SQL}, paid AS (SELECT * FROM bronze WHERE event_type = 'PURCHASE' AND amount_cents > 0)
SELECT 'dau' AS name, count(*) AS n, (SELECT count(*) FROM bronze) AS measure FROM (SELECT DISTINCT event_date, country_code, device_type FROM bronze)
UNION ALL SELECT 'revenue', count(*), (SELECT CAST(sum(amount_cents) AS BIGINT) FROM paid) FROM (SELECT DISTINCT event_date, country_code, product_id FROM paid)
UNION ALL SELECT 'funnel', count(*), (SELECT count(*) FROM bronze WHERE event_type = 'PURCHASE') FROM (SELECT DISTINCT event_date, country_code FROM bronze)
UNION ALL SELECT 'user_signals', count(DISTINCT user_id), count(*) FILTER (event_date >= (SELECT strftime(CAST(max(event_date) AS DATE) - 7, '%Y-%m-%d') FROM bronze)) FROM bronze""")
def gold_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = gold.run_all(bronze(spark, sf_dir))
    sums = [tables[name].agg(F.count("*").alias("n"), F.sum(measure).alias("measure")).select(F.lit(name).alias("name"), "n", "measure") for name, measure in _RUN_ALL.items()]
    return reduce(DataFrame.unionByName, sums)


@query(f"WITH {DUPLICATED_SQL} SELECT DISTINCT event_id, timestamp_ms, user_id, event_type, amount_cents FROM arrived")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed-state deduplication by event time, whose state outlives every copy here."""
    from ..streaming.silver_stream import dedup_stream

    root, source = scratch(spark, "dedup"), bronze(spark, sf_dir, duplicates=True)
    source.write.parquet(f"{root}/in")
    kept = dedup_stream(spark.readStream.schema(source.schema).parquet(f"{root}/in"), "60 days").select("event_id", "timestamp_ms", "user_id", "event_type", "amount_cents")
    kept.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{root}/out")


# Training frames and metrics

_ENRICHED_SQL = f"""{_USER_FEATURES_SQL[5:].replace("SELECT * EXCLUDE (event_timestamp) FROM f", "")},
x AS (SELECT 'USER-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS user_id, round(c_acctbal, 2) AS avg_delivery_delay_days, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 5 + 0.5 END::DOUBLE AS avg_review_score, CAST(1 + c_custkey % 3 AS DOUBLE) AS avg_payment_installments FROM customer WHERE c_custkey % 4 <> 0),
y AS (SELECT user_id, CAST(min(timestamp_ms) % 2 AS INTEGER) AS label FROM bronze GROUP BY 1 HAVING min(timestamp_ms) % 7 <> 0)"""


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").selectExpr(
        "concat('USER-', lpad(CAST(c_custkey AS string), 6, '0')) AS user_id", "round(c_acctbal, 2) AS avg_delivery_delay_days",
        "CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 5 + 0.5 AS double) END AS avg_review_score", "CAST(1 + c_custkey % 3 AS double) AS avg_payment_installments",
    )
    events = bronze(spark, sf_dir)
    labelled = events.groupBy("user_id").agg(F.min("timestamp_ms").alias("t")).filter("t % 7 <> 0").select("user_id", (F.col("t") % 2).cast("int").alias("label"))
    return ml.training_frame(features.compute_features(events).drop("event_timestamp"), labelled, customers)


@query(f"""WITH {_ENRICHED_SQL} SELECT f.* EXCLUDE (event_timestamp), label, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ml.ENRICHMENT)}
FROM f JOIN y ON f.user_id = y.user_id LEFT JOIN x ON f.user_id = x.user_id""")
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir)


_METRICS_SQL = f"""{_SCORES_SQL}, s AS (SELECT user_id, round(score, 3) AS score, CAST(substr(md5(user_id || tenant), 1, 1) < '6' OR score > 0.9 AS INTEGER) AS label FROM latest)"""


def _labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (F.substring(F.md5(F.concat("user_id", "tenant")), 1, 1) < "6") | (F.col("score") > 0.9)
    return serving.upsert_scores(_scored(spark, sf_dir)).select("user_id", F.round("score", 3).alias("score"), label.cast("int").alias("label"))


@query(f"""WITH {_METRICS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM s)
SELECT n, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, (tp + fn) / n AS base_rate FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.binary_metrics(_labelled_scores(spark, sf_dir))


@query(f"""WITH {_METRICS_SQL} SELECT round(avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END::DOUBLE), 9) AS auc
FROM s p, s q WHERE p.label = 1 AND q.label = 0""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.auc(_labelled_scores(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


# Two fixed ensembles: what a registry would hold, small enough to be written out in SQL.
_F = {f: i for i, f in enumerate(FEATURES)}
_TREES = {
    "champion": [
        (_F["days_since_last_purchase"], 6.5, (_F["purchase_count_7d"], 2.5, (_F["revenue_sum_7d"], 40_000.0, (-0.05, 120), (-0.2, 60)), (-0.45, 90)), (_F["session_count_24h"], 0.5, (0.6, 210), (_F["days_since_last_purchase"], 13.5, (0.1, 30), (0.35, 20)))),
        (_F["event_count_24h"], 1.5, (_F["purchase_count_7d"], 0.5, (0.25, 180), (0.05, 140)), (_F["purchase_count_7d"], 3.5, (-0.1, 130), (-0.3, 80))),
    ],
    "challenger": [(_F["days_since_last_purchase"], 4.5, (-0.3, 200), (_F["revenue_sum_7d"], 10_000.0, (0.5, 150), (0.2, 50)))],
}
_ENSEMBLES = {name: ml.Ensemble.of_trees(FEATURES, trees) for name, trees in _TREES.items()}


def _condition(feature: int, low: float, high: float) -> str:
    bounds = [f"{FEATURES[feature]} {sign} {x}" for sign, x in ((">", low), ("<=", high)) if abs(x) != float("inf")]
    return f"CASE WHEN {' AND '.join(bounds)} THEN 1.0 ELSE 0.0 END::DOUBLE"


def _expected_sql(leaves: list[ml.Leaf], known: frozenset[int]) -> str:
    """What a tree is expected to say if only the features ``known`` are."""
    return "(" + " + ".join(f"{leaf.value}::DOUBLE * " + " * ".join(_condition(f, low, high) if f in known else f"{share}::DOUBLE" for f, (low, high, share) in leaf.ranges.items()) for leaf in leaves) + ")"


def _margin_sql(name: str) -> str:
    return " + ".join(_expected_sql(leaves, frozenset(range(len(FEATURES)))) for leaves in map(ml.leaves_of, _TREES[name]))


def _shapley_sql(name: str, feature: int) -> str:
    """The definition: the mean gain of knowing the feature over all orders in which a tree's features become known."""
    terms = ["0.0::DOUBLE"]
    for leaves in map(ml.leaves_of, _TREES[name]):
        own = sorted({f for leaf in leaves for f in leaf.ranges})
        others = [f for f in own if f != feature]
        for size in range(len(own)) if feature in own else ():
            weight = factorial(size) * factorial(len(own) - size - 1) / factorial(len(own))
            terms += [f"{weight}::DOUBLE * ({_expected_sql(leaves, frozenset((*s, feature)))} - {_expected_sql(leaves, frozenset(s))})" for s in combinations(others, size)]
    return " + ".join(terms)


_GROUP_SQL = f"""CASE WHEN {_BUCKET_SQL.format(c="f.user_id")} < 0.9::DOUBLE THEN 'champion' ELSE 'challenger' END"""


@query(f"""WITH {_ENRICHED_SQL}, g AS (SELECT f.*, {_GROUP_SQL} AS ab_group FROM f JOIN y ON f.user_id = y.user_id),
s AS (SELECT user_id, ab_group, 1 / (1 + exp(-2 * CASE ab_group WHEN 'champion' THEN {_margin_sql("champion")} ELSE {_margin_sql("challenger")} END)) AS score FROM g)
SELECT user_id, ab_group, round(score, 9) AS score, score >= 0.5 AS churn_prediction FROM s""")
def routed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's group, and the probability that its model gives."""
    found = ml.predict(_ENSEMBLES["champion"], _ENSEMBLES["challenger"], _frame(spark, sf_dir))
    return found.select("user_id", "ab_group", F.round("score", 9).alias("score"), "churn_prediction")


_EXPLAINED_SQL = f"""{_ENRICHED_SQL}, shap AS (SELECT f.user_id, {_margin_sql("champion")} AS margin, {", ".join(f"{_shapley_sql('champion', i)} AS s{i}" for i in range(len(FEATURES)))} FROM f JOIN y ON f.user_id = y.user_id)"""


@query(f"""WITH {_EXPLAINED_SQL} SELECT user_id, round({_ENSEMBLES["champion"].base}::DOUBLE, 9) AS base, round(margin, 9) AS margin, {", ".join(f"round(s{i}, 9) + 0.0 AS {f}" for i, f in enumerate(FEATURES))} FROM shap""")
def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's margin and the Shapley value of each feature."""
    found = ml.contributions(_ENSEMBLES["champion"], _frame(spark, sf_dir))
    return found.select("user_id", F.round("base", 9).alias("base"), F.round("margin", 9).alias("margin"), *((F.round(F.col("contributions")[i], 9) + 0.0).alias(f) for i, f in enumerate(FEATURES)))


@query(f"""WITH {_EXPLAINED_SQL} SELECT unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([{", ".join(f"round(avg(abs(s{i})), 9)" for i in range(len(FEATURES)))}]) AS mean_abs_shap FROM shap""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean size of each feature's Shapley value over all users."""
    found = ml.global_importance(ml.contributions(_ENSEMBLES["champion"], _frame(spark, sf_dir)))
    return found.select("feature", F.round("mean_abs_shap", 9).alias("mean_abs_shap"))


# Audits


@query(f"WITH {BRONZE_SQL} SELECT event_type AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM bronze), 2) AS pct FROM bronze GROUP BY 1")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_counts(bronze(spark, sf_dir), "event_type")


@query(f"WITH {BRONZE_SQL} SELECT product_id AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM bronze), 2) AS pct FROM bronze GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 5")
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_counts(bronze(spark, sf_dir), "product_id", top=5)


@query(f"WITH {BRONZE_SQL} SELECT kafka_partition, min(kafka_offset) AS min_offset, max(kafka_offset) AS max_offset, count(*) AS n FROM bronze GROUP BY 1")
def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.partition_offsets(bronze(spark, sf_dir))


@query(f"""WITH {BRONZE_SQL} SELECT unnest(['event_id', 'page_url', 'product_id', 'amount_cents']) AS "column",
unnest([count(*) FILTER (event_id IS NULL), count(*) FILTER (page_url IS NULL), count(*) FILTER (product_id IS NULL), count(*) FILTER (amount_cents IS NULL)]) AS nulls FROM bronze""")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.null_counts(bronze(spark, sf_dir).select("event_id", "page_url", "product_id", "amount_cents"))


@query(f"WITH {DUPLICATED_SQL} SELECT count(*) AS rows, count(DISTINCT event_id) AS keys, count(*) - count(DISTINCT event_id) AS duplicates FROM arrived")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_count(bronze(spark, sf_dir, duplicates=True), "event_id")


@query(f"""WITH {BRONZE_SQL}, v AS (SELECT amount_cents::DOUBLE AS v FROM bronze WHERE amount_cents IS NOT NULL), k AS (SELECT v FROM v WHERE v <= (SELECT quantile_cont(v, 0.99) FROM v)),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM k) SELECT least(CAST(floor((v - lo) / ((hi - lo) / 40.0::DOUBLE)) AS INTEGER), 39) AS bin, min(v) AS lo, count(*) AS n FROM k, b GROUP BY 1""")
def amount_histogram_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.capped_histogram(bronze(spark, sf_dir), "amount_cents")


@query(f"""WITH {_USER_FEATURES_SQL[5:].replace("SELECT * EXCLUDE (event_timestamp) FROM f", "")} SELECT feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS null_rate, round(avg(value), 6) AS mean, max(value) AS max
FROM {_LONG("f")} GROUP BY 1""")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.feature_summary(features.compute_features(bronze(spark, sf_dir)), FEATURES)


# Models


@query()
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ml.training_frame(features.compute_features(bronze(spark, sf_dir), as_of_ms=MID_MS))
    model = ml.train(frame, trees=300, depth=4, rate=0.05)
    return ml.score(model, frame)


@query()
def synthetic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.generator import synthetic_events as generate

    return generate(spark, table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), PROCESSED_MS)


from . import operations  # noqa: E402,F401  registers its own
