"""Hand fixtures and plain replays of the operators' rules."""

import json
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar
from tidemark.operators import audit, drift, features, gold, labels, ml, normalize, orders, quality, ranges, serving, silver, watermark

MS = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)
HOUR, DAY = schemas.HOUR_MS, schemas.DAY_MS


def event(i, user="u1", session="s1", kind="CLICK", ts=1_700_000_000_000, amount=None, product=None, device="MOBILE", country="US", version="1"):
    return (i, kind, user, session, ts, None, product, amount, device, country, version)


def events(spark, rows):
    df = spark.createDataFrame(rows, schemas.EVENT)
    return df.withColumn("event_date", scalar.event_date(F.col("timestamp_ms")))


NOON = MS(2026, 6, 20, 12)
GOLD = [
    event("e1", "u1", "s1", "PAGE_VIEW", NOON, device="DESKTOP"),
    event("e2", "u1", "s1", "ADD_TO_CART", NOON, product="P1", device="DESKTOP"),
    event("e3", "u1", "s1", "PURCHASE", NOON, 5000, "P1", "DESKTOP"),
    event("e4", "u2", "s2", "PAGE_VIEW", NOON, country="GB"),
    event("e5", "u3", "s3", "SESSION_START", NOON),
    event("e6", "u3", "s3", "PURCHASE", NOON, 2500, "P2"),
]


def test_gold_fixture(spark):
    s = events(spark, GOLD)
    dau = {(r.country_code, r.device_type): r for r in gold.compute_dau(s).collect()}
    assert dau["US", "DESKTOP"].unique_users == dau["US", "MOBILE"].unique_users == 1 and dau["US", "DESKTOP"].total_events == 3
    revenue = gold.compute_revenue(s).collect()
    assert sum(r.total_revenue_cents for r in revenue) == 7500 and {r.country_code for r in revenue} == {"US"}
    funnel = {r.country_code: r for r in gold.compute_funnel(s, 5).collect()}
    us, gb = funnel["US"], funnel["GB"]
    assert (us.total_page_views, us.total_add_to_carts, us.total_purchases, us.view_to_cart_pct) == (1, 1, 2, 100.0)
    assert (gb.view_to_cart_pct, gb.cart_to_purchase_pct, gb.gold_computed_ms) == (0.0, 0.0, 5)
    signals = {r.user_id: r for r in gold.compute_user_signals(s).collect()}
    assert (signals["u1"].total_purchases_7d, signals["u1"].total_revenue_7d_cents, signals["u2"].total_revenue_7d_cents) == (1, 5000, 0)
    assert not any(r.is_churned for r in signals.values())
    assert set(gold.run_all(s)) == {"dau", "revenue", "funnel", "user_signals"}


def test_null_product_and_named_na_stay_apart(spark):
    rows = [event("a", kind="PURCHASE", amount=1), event("b", kind="PURCHASE", amount=2, product="N/A")]
    got = gold.compute_revenue(events(spark, rows)).collect()
    assert sorted((r.product_id, r.total_revenue_cents) for r in got) == [("N/A", 1), ("N/A", 2)]


def test_user_idle_for_exactly_seven_days_is_churned_but_active(spark):
    rows = [event("a", "old", ts=MS(2026, 6, 13, 9)), event("b", "older", ts=MS(2026, 6, 11)), event("c", "new", ts=MS(2026, 6, 20))]
    got = {r.user_id: r for r in gold.compute_user_signals(events(spark, rows)).collect()}
    assert (got["old"].is_churned, got["old"].total_events_7d, got["old"].churn_risk_score) == (True, 1, 1.0)
    assert (got["older"].total_events_7d, got["older"].days_since_last_session) == (0, 9) and not got["new"].is_churned


MINUTE = 60_000
FEATURE_ROWS = [
    event("1", "u1", "s1", "SESSION_START", NOON - 30 * MINUTE), event("2", "u1", "s1", "PURCHASE", NOON - 20 * MINUTE, 5000),
    event("3", "u1", "s2", "PURCHASE", NOON - 2 * HOUR, 3000), event("4", "u1", "s2", "CLICK", NOON - HOUR),
    event("5", "u2", "s3", "SESSION_START", NOON - 10 * MINUTE), event("6", "u2", "s3", "CLICK", NOON - 5 * MINUTE),
    event("7", "u3", "s4", "PURCHASE", NOON - 2 * DAY, 1500), event("8", "u3", "s4", "CLICK", NOON - HOUR),
]


def test_features_fixture(spark):
    got = {r.user_id: r for r in features.compute_features(events(spark, FEATURE_ROWS)).collect()}
    u1, u2, u3 = got["u1"], got["u2"], got["u3"]
    assert (u1.purchase_count_1h, u1.purchase_count_24h, u1.purchase_count_7d) == (1, 2, 2)
    assert (u1.revenue_sum_1h, u1.revenue_sum_24h, u1.session_count_24h) == (5000, 8000, 2)
    assert (u2.purchase_count_7d, u2.days_since_last_purchase, u2.event_count_24h) == (0, 999, 2)
    assert (u3.purchase_count_24h, u3.purchase_count_7d, u3.days_since_last_purchase) == (0, 1, 2)


@pytest.mark.parametrize(("days", "half_even", "floor"), [(1.5, 2, 1), (2.5, 2, 2), (0.4, 0, 0)])
def test_recency_rounding(spark, days, half_even, floor):
    s = events(spark, [event("1", "u", kind="PURCHASE", ts=NOON - int(days * DAY), amount=1), event("2", "v", ts=NOON)])
    of = lambda **k: features.compute_features(s, **k).filter("user_id = 'u'").first().days_since_last_purchase
    assert (of(), of(rounding="floor")) == (half_even, floor)


def test_history_equals_one_snapshot_at_a_time(spark):
    rng = random.Random(1)
    rows = [event(str(i), f"u{rng.randint(0, 9)}", f"s{rng.randint(0, 20)}", rng.choice(["CLICK", "PURCHASE"]), NOON + rng.randint(0, 20 * DAY), rng.randint(1, 99)) for i in range(400)]
    s, refs = events(spark, rows), [NOON + d * DAY for d in (1, 3, 8, 19)]
    want = sorted(map(str, [r for ref in refs for r in features.compute_features(s, as_of_ms=ref).collect()]))
    assert sorted(map(str, features.feature_history(s, refs).collect())) == want


def test_point_in_time_join_at_its_bounds(spark):
    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    names = schemas.FEATURES
    feats = spark.createDataFrame([("u", at(NOON), *[1] * 9), ("u", at(NOON + DAY), *[2] * 9), ("v", at(NOON), *[7] * 9)], f"user_id string, event_timestamp timestamp, {', '.join(f'{n} long' for n in names)}")
    asked = [("u", NOON, 1), ("u", NOON - 1, None), ("u", NOON + DAY - 1, 1), ("u", NOON + DAY, 2), ("u", NOON + 8 * DAY, 2), ("u", NOON + 8 * DAY + 1, None), ("w", NOON, None), ("v", NOON + 3 * DAY, 7), ("v", NOON + 3 * DAY, 7)]
    entities = spark.createDataFrame([(u, at(t), want) for u, t, want in asked], "user_id string, event_timestamp timestamp, want int")
    got = features.point_in_time_join(entities, feats)
    assert got.columns == ["user_id", "event_timestamp", "want", *names]
    rows = got.collect()
    assert len(rows) == len(asked) and all(r.purchase_count_1h == r.want for r in rows)


BASE = event("e", ts=1_700_000_000_000)


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({}, 0), ({"event_id": None}, 1), ({"user_id": ""}, 1), ({"event_type": "UNKNOWN_TYPE"}, 1), ({"event_type": None}, 2), ({"device_type": "SMARTWATCH"}, 1),
        ({"timestamp_ms": 1_000_000_000}, 1), ({"timestamp_ms": 9_999_999_999_999}, 1), ({"timestamp_ms": schemas.TS_MAX_MS}, 0), ({"timestamp_ms": None}, 1),
        ({"country_code": "usa"}, 1), ({"country_code": "U"}, 1), ({"country_code": None}, 2), ({"event_type": "PURCHASE"}, 1), ({"event_type": "PURCHASE", "amount_cents": 0}, 1), ({"event_type": "PURCHASE", "amount_cents": 1}, 0),
    ],
)
def test_contract(spark, change, errors):
    row = dict(zip(schemas.EVENT_COLUMNS, BASE)) | change
    found = quality.with_errors(spark.createDataFrame([tuple(row.values())], schemas.EVENT)).first().errors
    assert len(found) == errors, found


def test_statistics_and_quarantine(spark):
    s = events(spark, [BASE, BASE, event("x", country="é")])
    stats = quality.statistics(s).first()
    assert (stats.total, stats.valid, stats.invalid) == (3, 2, 1) and abs(stats.pass_rate - 2 / 3) < 1e-12
    assert quality.statistics(s.limit(0)).first().pass_rate == 1.0
    row = quality.quarantine(quality.split(s)[1], 9).first()
    assert json.loads(row.validation_errors) == ["expect_column_values_to_match_regex: country_code='é'"]
    assert (row.quarantine_reason, row.ingestion_date, row.silver_processed_ms) == ("validation_failure", None, 9)


def arrivals(n=500, seed=3):
    rng = random.Random(seed)
    return [(f"e{rng.randint(0, n)}", rng.randint(0, 40) * 100_000 + i * 1000, i) for i in range(n)]


def replay(rows, config):
    top, out = 0, []
    for event_id, ts, seq in rows:
        top = max(top, ts)
        kind = "on_time" if ts >= max(0, top - config.allowed_ms) else "late" if ts >= top - config.max_late_ms else "discard"
        out.append((event_id, ts, seq, kind))
    return out


@pytest.mark.parametrize("buckets", [1, 7, 2048])
def test_classification_equals_replay(spark, buckets):
    rows = arrivals()
    config = watermark.WatermarkConfig(300_000, 2_000_000, buckets=buckets)
    frame = spark.createDataFrame(rows[::-1], "event_id string, timestamp_ms long, arrival_seq long")
    got = watermark.classify(frame, config).select("event_id", "timestamp_ms", "arrival_seq", "watermark_classification")
    assert sorted(map(tuple, got.collect())) == sorted(replay(rows, config))


def test_classification_bounds(spark):
    config = watermark.WatermarkConfig(300_000, 3_600_000)
    rows = [("a", 1_000_000, 0), ("b", 800_000, 1), ("c", 700_000, 2), ("d", 600_000, 3), ("e", 5_000_000, 4), ("f", 0, 5), ("g", 1_400_000, 6)]
    got = watermark.classify(spark.createDataFrame(rows, "event_id string, timestamp_ms long, arrival_seq long"), config)
    assert {r.event_id: r.watermark_classification for r in got.collect()} == {"a": "on_time", "b": "on_time", "c": "on_time", "d": "late", "e": "on_time", "f": "discard", "g": "late"}


def test_first_and_ttl_equal_replay(spark):
    rows = arrivals()
    frame = spark.createDataFrame(rows, "event_id string, timestamp_ms long, arrival_seq long")
    first = {}
    for r in rows:
        first.setdefault(r[0], r)
    assert sorted(map(tuple, watermark.first_per_key(frame).collect())) == sorted(first.values())
    last, kept = {}, []
    for event_id, ts, seq in sorted(((r[0][:2], *r[1:]) for r in rows), key=lambda r: (r[1], r[2])):
        if event_id not in last or ts - last[event_id] >= 50_000:
            last[event_id] = ts
            kept.append((event_id, ts, seq))
    short = frame.withColumn("event_id", F.substring("event_id", 1, 2))
    assert sorted(map(tuple, watermark.accepted_within_ttl(short, ttl_ms=50_000).collect())) == sorted(kept)


def test_silver_order_of_steps(spark):
    t = 1_700_000_000_000
    rows = [
        event("a", ts=t), event("a", ts=t),  # repeated
        event("bad", ts=t, country="x"), event("bad", ts=t),  # an invalid first copy hides a valid second
        event("late", ts=t - 400_000, country="x"),  # late and invalid: kept
        event("gone", ts=t - 10_000_000), event("gone", ts=t),  # a discard leaves no trace
    ]
    schema = "event_id string, event_type string, user_id string, session_id string, timestamp_ms long, page_url string, product_id string, amount_cents long, device_type string, country_code string, app_version string, arrival_seq long"
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    options = silver.SilverOptions(watermark.WatermarkConfig(300_000, 3_600_000))
    good, bad = silver.bronze_to_silver(frame, 1, options)
    assert sorted((r.event_id, r.watermark_classification) for r in good.collect()) == [("a", "on_time"), ("gone", "on_time"), ("late", "late")]
    assert [r.event_id for r in bad.collect()] == ["bad"] and good.columns == schemas.SILVER.fieldNames() and bad.columns == schemas.QUARANTINE.fieldNames()
    counts = silver.outcome_counts(frame, options).first().asDict()
    assert counts == {"total": 7, "on_time": 5, "late": 1, "discarded": 1, "duplicate": 2, "quarantined": 1, "silver": 3}
    strict = silver.SilverOptions(options.watermark, validate_late=True)
    assert {r.event_id for r in silver.bronze_to_silver(frame, 1, strict)[1].collect()} == {"bad", "late"}


def test_psi_and_histograms_equal_numpy(spark):
    rng = np.random.default_rng(0)
    base, now = rng.normal(5, 2, 400), np.append(rng.normal(6, 2, 300), [99.0, -99.0])
    frame = lambda v: spark.createDataFrame([(float(x), 3) for x in v] + [(None, 3)], "a double, b int")
    hist = drift.baseline_histograms(frame(base), ("a", "b"))
    rows = {r.feature: r for r in hist.collect()}
    counts, edges = np.histogram(base, bins=10)
    assert rows["a"].bin_counts == counts.tolist() and np.allclose(rows["a"].bin_edges, edges)
    assert rows["b"].bin_counts == np.histogram([3.0] * 401, bins=10)[0].tolist()
    assert np.allclose([rows["a"].mean, rows["a"].std, rows["a"].p50], [base.mean(), base.std(), np.median(base)])
    share = np.maximum(np.histogram(now, bins=edges)[0] / len(now), 1e-6)
    want = np.maximum(counts / counts.sum(), 1e-6)
    report = {r.feature: r for r in drift.psi_by_feature(hist, frame(now), ("a", "b")).collect()}
    assert abs(report["a"].psi - ((share - want) * np.log(share / want)).sum()) < 1e-6 and report["b"].status == "stable"
    same = drift.psi_by_feature(hist, frame(base), ("a",)).first()
    assert same.psi < 0.01 and same.status == "stable"
    far = drift.psi_by_feature(hist, frame([999.0] * 50), ("a",))
    assert far.first().status == "retrain" and drift.drift_alert(far).first().drift_alert


def test_psi_status_bounds(spark):
    got = spark.createDataFrame([(0.0999,), (0.10,), (0.2499,), (0.25,)], "p double").select(drift.psi_status(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == ["stable", "moderate", "moderate", "retrain"]


def test_assignment_is_stable_and_near_its_share(spark):
    users = spark.range(5000).select(F.concat(F.lit("user-"), "id").alias("user_id"))
    stats = serving.split_stats(users).first()
    assert 0.85 <= stats.champion_pct <= 0.95 and stats.total == 5000
    assert serving.split_stats(users, 0.0).first().champion == 0 and serving.split_stats(users, 1.0).first().challenger == 0
    assert serving.split_stats(users.limit(0)).first().champion_pct == 0.0


def test_alerts_order_and_scores(spark):
    rows = [("t", "b", 0.9, 1), ("t", "a", 0.9, 1), ("t", "c", 0.7, 1), ("t", "d", 0.95, 1), ("t", "d", 0.1, 2), ("o", "z", 1.0, 1)]
    latest = serving.upsert_scores(spark.createDataFrame(rows, "tenant string, user_id string, score double, scored_ms long"))
    assert [r.user_id for r in serving.alerts(latest, "t").collect()] == ["a", "b", "c"]
    assert [r.user_id for r in serving.alerts(latest, "t", limit=1).collect()] == ["a"]
    assert {r.tenant: r.total_scored for r in serving.total_scored(latest).collect()} == {"t": 4, "o": 1}


def test_top_contributions(spark):
    frame = spark.createDataFrame([(["a", "b", "c", "d"], [0.5, -2.0, 0.5, 0.0])], "n array<string>, v array<double>")
    got = frame.select(serving.top_contributions(F.col("n"), F.col("v")).alias("x")).first().x
    assert [(g.feature, g.direction) for g in got] == [("b", "decreases_churn"), ("a", "increases_churn"), ("c", "increases_churn")]


def test_normalisers(spark):
    texts = lambda *p: spark.createDataFrame([(json.dumps(x) if not isinstance(x, str) else x,) for x in p], "value string")
    order = {"id": 5, "customer": {"id": 7}, "created_at": "2024-01-01T00:00:00+02:00", "total_price": "19.99", "line_items": [{"product_id": 3}], "shipping_address": {"country": "France"}}
    rows = normalize.shopify(texts(order, {**order, "total_price": None, "subtotal_price": "1.5", "line_items": []}, {**order, "customer": None}, {**order, "id": None}, "not json"), 10).collect()
    assert (rows[0].event_id, rows[0].user_id, rows[0].amount_cents, rows[0].country_code, rows[0].product_id) == ("shopify-5", "USER-SHOPIFY-7", 1998, "FR", "3")
    assert rows[0].timestamp_ms == MS(2023, 12, 31, 22) and (rows[1].amount_cents, rows[1].product_id) == (150, None)
    assert [r.error for r in rows] == [None, None, "Missing customer id", "Missing 'id'", "Missing 'id'"]
    woo = normalize.woocommerce(texts({"id": 1, "customer_id": 2, "date_created": "2024-01-01T00:00:00"}), 10).first()
    assert (woo.event_id, woo.amount_cents, woo.country_code, woo.error) == ("woo-1", 0, "US", None)
    cells = spark.createDataFrame([("1", "x@y", "$1,234.50", "1700000000", "", "gbr"), ("2", "", "5", None, "p", None), ("3", "c", "abc", "1700000000000", "p", "de")], "ID string, EMAIL string, Revenue string, `date` string, SKU string, country string")
    good, bad = normalize.split_errors(normalize.csv_rows(cells, 10))
    row = good.first()
    assert (row.event_id, row.user_id, row.amount_cents, row.timestamp_ms, row.product_id, row.country_code) == ("csv-1", "USER-x@y", 123450, 1_700_000_000_000, None, "GB")
    assert sorted(r.error for r in bad.collect()) == ["Bad amount", "No customer_id"]
    assert good.columns == schemas.BRONZE.fieldNames()
    fixed = silver.canonicalize_enums(good).first()
    assert (fixed.event_type, fixed.device_type) == ("PURCHASE", "UNKNOWN")


def test_orders_edges(spark):
    at = datetime(2024, 1, 5, tzinfo=timezone.utc)
    frame = spark.createDataFrame([(1, 9, at, 0.001, None), (2, 9, at, 2.005, 4)], "order_id long, customer_unique_id long, order_purchase_timestamp timestamp, total_payment double, first_product_id long")
    same = orders.compress_timestamps(frame, 1000, 1)
    assert {r.timestamp_ms for r in same.collect()} == {1000}
    rows = {r.session_id: r for r in orders.build_events(same).collect()}
    assert rows["1"].amount_cents == 1 and rows["1"].product_id is None and rows["2"].product_id == "4"


def test_payments_are_added_in_the_order_of_their_lines(spark):
    at = datetime(2024, 1, 5, tzinfo=timezone.utc)
    values, n = [0.1, 0.2, 0.3, None], 50
    made = spark.createDataFrame([(i, 7, at, "delivered") for i in range(n)], "order_id long, customer_id long, order_purchase_timestamp timestamp, order_status string")
    customers = spark.createDataFrame([(7, 9)], "customer_id long, customer_unique_id long")
    items = spark.createDataFrame([(1, 1, 3)], "order_id long, order_item_id long, product_id long")
    rows = [(i, v, line) for i in range(n) for line, v in enumerate(values)]
    for dealt in (rows, rows[::-1], random.Random(5).sample(rows, len(rows))):
        payments = spark.createDataFrame(dealt, "order_id long, payment_value double, line int").repartition(7)
        got = orders.order_rollup(made, customers, payments, items, "line").collect()
        assert len(got) == n and {r.total_payment for r in got} == {0.1 + 0.2 + 0.3}  # 0.3 + 0.2 + 0.1 is another number


def test_split_and_labels(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = labels.stratified_split(frame, "label", "id")
    counts = {(r.label, r.is_train): r["count"] for r in got.groupBy("label", "is_train").count().collect()}
    assert counts == {(0, True): 720, (0, False): 180, (1, True): 80, (1, False): 20} and got.columns == ["id", "label", "is_train"]
    assert labels.class_weight(frame, "label").first().scale_pos_weight == 9.0 and labels.class_weight(frame.filter("label = 0"), "label").first().scale_pos_weight == 1.0
    short = events(spark, [event("a", ts=NOON), event("b", ts=NOON + DAY)])
    assert labels.churn_labels(short).count() == 2


def test_audits(spark):
    frame = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, v int")
    assert {r["column"]: r.nulls for r in audit.null_counts(frame).collect()} == {"k": 1, "v": 1}
    assert tuple(audit.duplicate_count(frame, "k").first()) == (3, 2, 1)
    assert sum(r.n for r in audit.capped_histogram(spark.range(1000).toDF("v"), "v").collect()) == 990


def test_models(spark):
    rng = random.Random(2)
    rows = [event(str(i), f"u{rng.randint(0, 199)}", "s", rng.choice(["CLICK", "PURCHASE"]), NOON + rng.randint(0, 30 * DAY), 5) for i in range(700)]
    frame = ml.training_frame(features.compute_features(events(spark, rows)))
    model = ml.train(frame, trees=4, depth=2)
    scored = ml.score(model, frame).join(frame.select("user_id", "label"), "user_id")
    assert ml.auc(scored).first().auc > 0.9 and all(0 <= r.score <= 1 for r in scored.collect())
    metrics = ml.binary_metrics(scored).first()
    assert metrics.f1 > 0.8 and ml.binary_metrics(scored.limit(0)).first().precision == 0.0
    assert ml.feature_importance(model)[0][0] == "days_since_last_purchase"
    assert ml.predict(model, model, frame).count() == frame.count()


def test_avro_schema_maps_to_the_event_schema():
    fields = [{"name": f.name, "type": ["null", "long" if f.dataType.simpleString() == "bigint" else "string"] if f.name in ("page_url", "product_id", "amount_cents") else "long" if f.name == "timestamp_ms" else "string"} for f in schemas.EVENT]
    fields[1]["type"] = {"type": "enum", "name": "EventType", "symbols": list(schemas.EVENT_TYPES)}
    got = schemas.from_avro_json(json.dumps({"type": "record", "name": "UserEvent", "fields": fields}))
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schemas.EVENT]
    assert [f.name for f in got if f.nullable] == ["page_url", "product_id", "amount_cents"]


def test_gbt_scores_are_of_the_whole_model(spark, monkeypatch):
    from tidemark.operators import ml
    from tidemark.plans import queries

    asked, train = [], ml.train
    monkeypatch.setattr(ml, "train", lambda frame, **sizes: asked.append(sizes) or train(frame, trees=1, depth=1))
    assert queries.gbt_scores(spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [{"trees": 300, "depth": 4, "rate": 0.05}]


def test_dirty_numbers_make_error_rows(spark):
    rows = [("1", "a", "NaN", "2024-01-01"), ("2", "a", "Infinity", "2024-01-01"), ("3", "a", "1e30", "2024-01-01"), ("4", "a", "$1,234.50", "2024-01-01"), ("5", "a", "x", "2024-01-01"), ("6", "a", "1", "NaN"), ("7", "a", "1", "1e30"), ("8", "a", "1", "no date"), ("9", "a", "1", "1700000000"), ("10", "a", "0", None)]
    good, bad = normalize.split_errors(normalize.csv_rows(spark.createDataFrame(rows, "order_id string, customer_id string, total string, date string"), 5))
    assert {r.event_id: (r.amount_cents, r.timestamp_ms) for r in good.collect()} == {"csv-4": (123450, MS(2024, 1, 1)), "csv-9": (100, 1_700_000_000_000), "csv-10": (0, 5)}
    assert {r.event_id[4:]: r.error for r in bad.collect()} == {**dict.fromkeys("1235", "Bad amount"), **dict.fromkeys("678", "Bad time")}


def test_the_text_zero_counts_and_the_number_zero_does_not(spark):
    base = '"created_at": "2024-01-01T00:00:00Z", "subtotal_price": "50.00"'
    payloads = [
        f'{{"id": 1, "customer_id": 2, "total_price": "0", {base}}}', f'{{"id": 2, "customer_id": 2, "total_price": 0, {base}}}', f'{{"id": 3, "customer_id": 2, "total_price": 0.0, {base}}}',
        f'{{"id": 4, "customer_id": 2, "total_price": false, {base}}}', f'{{"id": 5, "customer_id": 2, "total_price": null, {base}}}', f'{{"id": 6, "customer_id": 2, "total_price": "", {base}}}',
        f'{{"id": "0", "customer": {{"id": "0"}}, "total_price": 1.5, {base}}}', f'{{"id": 0, "customer_id": 2, {base}}}', f'{{"id": "false", "customer_id": 0, {base}}}', f'{{"id": 7, "customer_id": 2, "total_price": 1e30, {base}}}', "no json",
    ]
    good, bad = normalize.split_errors(normalize.shopify(spark.createDataFrame([(p,) for p in payloads], "value string"), 5))
    assert {r.event_id[8:]: (r.user_id[13:], r.amount_cents) for r in good.collect()} == {"1": ("2", 0), **{k: ("2", 5000) for k in "23456"}, "0": ("0", 150)}
    assert sorted((r.event_id or "", r.error) for r in bad.collect()) == [("", "Missing 'id'"), ("", "Missing 'id'"), ("shopify-7", "Bad amount"), ("shopify-false", "Missing customer id")] or sorted(r.error for r in bad.collect()) == ["Bad amount", "Missing 'id'", "Missing 'id'", "Missing customer id"]


def test_strict_labels_keep_every_row_once(spark):
    now = NOON + 20 * DAY
    rows = [event("e", "u", ts=NOON)] * 3 + [event("n", None, ts=NOON), event("k", "v", ts=NOON), event("l", "v", ts=NOON + 3 * DAY), event("z", "w", ts=now)]
    got = sorted(((r.event_id, r.user_id, r.churned_7d_strict) for r in labels.churn_labels_strict(events(spark, rows)).collect()), key=str)
    assert got == [("e", "u", 1)] * 3 + [("k", "v", 0), ("l", "v", 1), ("n", None, None)]


@pytest.mark.parametrize("small", [0, 10**6])
def test_quantiles_equal_numpy(spark, monkeypatch, small):
    from tidemark.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = random.Random(1)
    data = {"a": [rng.gauss(0, 1) for _ in range(200_000)], "b": [float(rng.randint(0, 3)) for _ in range(200_000)], None: [1.0] * 100_000} if not small else {"a": [rng.random() for _ in range(1001)], "b": [5.0, 7.0], "c": [3.0], None: [1.0, 2.0, 2.0]}
    frame = spark.createDataFrame([(k, v) for k, vs in data.items() for v in [*vs, None, float("nan")]], "k string, v double")
    points = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in quantiles.exact_quantiles(frame, "v", ["k"], points).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert np.allclose(got[k], np.quantile(values, points), rtol=1e-12, atol=1e-12)
    assert quantiles.exact_quantiles(frame.limit(0), "v", ["k"], points).count() == 0


def test_contributions_equal_all_orders_of_features(spark):
    from itertools import permutations

    rng = random.Random(4)
    names = ("a", "b", "c")
    frame = spark.createDataFrame([(str(i), rng.random(), rng.random(), rng.random(), 0) for i in range(300)], "user_id string, a double, b double, c double, label int")
    frame = frame.withColumn("label", ((F.col("a") > 0.5) != (F.col("b") * F.col("c") > 0.3)).cast("int"))
    model = ml.train(frame, names, trees=3, depth=3)
    leaves = ml.Ensemble.of_model(model, names).leaves

    def value(x, known):
        total = 0.0
        for leaf in leaves:
            total += leaf.value * np.prod([(low < x[f] <= high) if f in known else share for f, (low, high, share) in leaf.ranges.items()])
        return total

    for r in ml.contributions(model, frame, names).limit(12).collect():
        x = frame.filter(F.col("user_id") == r.user_id).select(*names).first()
        want = [np.mean([value(x, {*order[: order.index(f) + 1]}) - value(x, set(order[: order.index(f)])) for order in permutations(range(3))]) for f in range(3)]
        assert np.allclose(r.contributions, want) and abs(r.base + sum(r.contributions) - r.margin) < 1e-9
    both = ml.score(model, frame).join(ml.score(ml.Ensemble.of_model(model, names), frame).withColumnRenamed("score", "own"), "user_id")
    assert both.filter(F.abs(F.col("score") - F.col("own")) > 1e-9).count() == 0
    plan = ml.contributions(model, frame, names)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_outcomes_and_tables_agree_on_ties(spark):
    rows = [event("t", "u2", kind="CLICK", ts=NOON), event("t", "u1", kind="CLICK", ts=NOON, version=""), event("t", "u1", kind="CLICK", ts=NOON, version="")]
    frame = events(spark, rows).withColumn("arrival_seq", F.lit(1).cast("long"))
    good, bad = silver.bronze_to_silver(frame, 1)
    counts = silver.outcome_counts(frame).first()
    assert (good.count(), bad.count()) == (counts.silver, counts.quarantined) and counts.duplicate == 2


def test_write_silver_equals_both_plans(spark, tmp_path):
    rows = [event(str(i), f"u{i % 3}", kind="PURCHASE" if i % 2 else "CLICK", ts=NOON + i, amount=None if i % 5 == 0 else i) for i in range(40)]
    frame = events(spark, rows).withColumns({"arrival_seq": F.col("timestamp_ms"), "amount_cents": F.coalesce(F.col("amount_cents").cast("double"), F.lit(float("nan")))})
    plans, tables = silver.bronze_to_silver(frame, 1), silver.write_silver(frame, str(tmp_path), 1)
    for a, b in zip(plans, tables):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() > 0


def capped_replay(rows, cap):
    """The memory as a queue, row by row."""
    memory, kept = [], []
    for key, at in rows:
        if key not in memory:
            kept.append((key, at))
            memory = [*memory, key][-cap:]
    return kept


@pytest.mark.parametrize("cap,few", [(5, 1000), (3, 4), (200_000, 1000)])
def test_capped_memory_equals_replay(spark, monkeypatch, cap, few):
    monkeypatch.setattr(watermark, "FEW", few)
    rng = random.Random(cap)
    rows = [(rng.choice([None, *"abcdefghijklmnop"][: rng.choice((3, 9, 17))]), i * 3) for i in range(200 if few > 10 else 40)]
    frame = spark.createDataFrame(rows[::-1], "event_id string, arrival_seq long")
    got = watermark.accepted_within_cap(frame, cap=cap).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, capped_replay(rows, cap)))
    assert watermark.accepted_within_cap(frame.limit(0), cap=cap).count() == 0


def watermark_replay(rows, config, partitions):
    """rows: (partition, event time, arrival time) in order."""
    top, came, best, out = {}, dict.fromkeys(partitions, rows[0][2]), None, []
    for p, ts, now in rows:
        top[p], came[p] = max(top.get(p, ts), ts), now
        active = [q for q in partitions if now - came[q] < config.idle_ms]
        if all(q in top for q in active):
            low = min(top[q] for q in active)
            best = low if best is None else max(best, low)
        out.append(None if best is None else best - config.allowed_ms)
    return out


@pytest.mark.parametrize("buckets", [1, 5, 2048])
def test_partition_watermark_equals_replay(spark, buckets):
    rng = random.Random(buckets)
    config = watermark.WatermarkConfig(allowed_ms=700, idle_ms=40, buckets=buckets)
    rows, now = [], 1000
    for i in range(400):
        now += rng.choice((0, 1, 3, 9))
        p = rng.choice([0, 1, None] if 120 < i < 200 or i < 30 else [0, 1, 2, None])
        rows.append((p, rng.randrange(10_000) + 20 * i, now))
    frame = spark.createDataFrame([(f"e{i:04}", p, ts, now, i) for i, (p, ts, now) in enumerate(rows)][::-1], "event_id string, kafka_partition int, timestamp_ms long, ingestion_timestamp_ms long, arrival_seq long")
    got = watermark.partition_watermark(frame, config=config).orderBy("arrival_seq").collect()
    want = watermark_replay(rows, config, [None, 0, 1, 2])
    assert [r.watermark_ms for r in got] == want and want[0] is None and want[-1] is not None
    assert watermark.partition_watermark(frame.limit(0), config=config).count() == 0


def test_ranges_stay_even_whatever_the_values(spark):
    """Outliers at 0 and at 9,999,999,999,999 leave the rest in ranges of under 1 % of the rows."""
    rows = spark.range(100_000).select((F.lit(1_700_000_000_000) + F.col("id")).alias("at")).unionByName(spark.createDataFrame([(0,), (9_999_999_999_999,), (None,)], "at long"))
    sizes = [r["count"] for r in rows.withColumn("r", ranges.range_of(rows, "at")).groupBy("r").count().collect()]
    assert max(sizes) < 1_000 and len(sizes) > 1_000
    total = ranges.running(rows.filter("at IS NOT NULL"), {"n": ("sum", F.lit(1)), "top": ("max", F.col("at"))}, "at")
    worst = total.agg(F.max("n").alias("n"), F.count_if(F.col("top") != F.col("at")).alias("wrong"), F.countDistinct("n").alias("distinct")).first()
    assert (worst.n, worst.wrong, worst.distinct) == (100_002, 0, 100_002)
