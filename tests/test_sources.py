"""Tables, feeds, the generator and the streaming path."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import quality, silver, watermark
from tidemark.plans.adapters import bronze
from tidemark.sources import feeds, generator, tables
from tidemark.streaming import online_store, silver_stream

SF = "/root/testdata/sf0.001"


def test_tables(spark, tmp_path):
    t = tables.TableIO(str(tmp_path / "t"), partition_by=("d",))
    rows = lambda *r: spark.createDataFrame(r, "k int, v int, d string")
    assert t.append(rows((1, 1, "a"), (2, 2, "b"))) == 2 and t.append(rows((9, 9, "a")).limit(0)) == 0
    t.overwrite_partitions(rows((3, 3, "b")))
    t.overwrite_partitions(rows((3, 3, "b")))
    assert sorted(map(tuple, t.read(spark).collect())) == [(1, 1, "a"), (3, 3, "b")]
    assert "PartitionFilters: [isnotnull(d" in t.read(spark).filter("d = 'a'")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="tenant"):
        tables.tenant_table("x", "a/b")
    latest = tables.upsert_latest(rows((1, 5, "a"), (2, 5, "a")), rows((1, 7, "b"), (1, 6, "c")), ("k",), "v")
    assert sorted(map(tuple, latest.collect())) == [(1, 7, "b"), (2, 5, "a")]


def test_feeds(spark, tmp_path):
    csv = tmp_path / "orders.csv"
    csv.write_text("Order_ID,customer,total,country\n1,c,3.5,us\n2,,3,us\n")
    good, bad = feeds.csv_upload(spark, str(csv), 1_700_000_000_000)
    assert [r.amount_cents for r in good.collect()] == [350] and bad.count() == 1
    hooks = tmp_path / "hooks.jsonl"
    hooks.write_text('{"id": 1, "customer_id": 2, "created_at": 1700000000, "total_price": 2}\n{"id": 3}\n')
    good, bad = feeds.webhook_files(spark, str(hooks), "shopify", 5)
    assert [(r.timestamp_ms, r.amount_cents) for r in good.collect()] == [(1_700_000_000_000, 200)] and bad.count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        feeds.webhook_files(spark, str(hooks), "other", 5)
    with pytest.raises(FileNotFoundError, match="items, orders, payments"):
        feeds.order_export(spark, {"customers": "x"})
    for role, body in {"orders": "order_id,customer_id,order_status,order_purchase_timestamp\no,c,delivered,2024-01-01 00:00:00\no2,c,delivered,bad\n", "customers": "customer_id,customer_unique_id\nc,u\n", "payments": "order_id,payment_value\no,3\n", "items": "order_id,order_item_id,product_id\no,1,p\n"}.items():
        (tmp_path / f"{role}.csv").write_text(body)
    export = feeds.order_export(spark, {r: str(tmp_path / f"{r}.csv") for r in feeds.ORDER_FILES})
    assert [r.order_purchase_timestamp is None for r in export["orders"].collect()] == [False, True]
    added = feeds.with_ingest_metadata(spark.range(1), 1_700_000_000_000).first()
    assert (added.kafka_partition, added.ingestion_date) == (0, "2023-11-14")


def test_generator_is_valid_and_repeatable(spark):
    made = generator.synthetic_events(spark, 20_000, 1_700_000_000_000)
    again = generator.synthetic_events(spark, 20_000, 1_700_000_000_000, partitions=3)
    assert made.exceptAll(again).count() == 0 and quality.statistics(made).first().invalid == 0
    late = made.filter("timestamp_ms < 1700000000000 + floor(0)").count()
    kinds = {r.event_type: r["count"] / 20_000 for r in made.groupBy("event_type").count().collect()}
    assert "PAGE_VIEW" not in kinds and 0.08 < kinds["PURCHASE"] < 0.12 and late > 0
    assert made.select("event_id").distinct().count() == 20_000


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    source = bronze(spark, SF, duplicates=True)
    # One file for each range of arrival, read in that order.
    bounds = [r.arrival_seq for r in source.select("arrival_seq").orderBy("arrival_seq").collect()]
    cuts = [bounds[len(bounds) * i // files] for i in range(files)] + [bounds[-1] + 1]
    options = silver.SilverOptions(watermark.WatermarkConfig(300_000, 3_000_000))
    stream = silver_stream.SilverStream(str(tmp_path / "out"), 7, options)
    for i in range(files):
        part = source.filter((F.col("arrival_seq") >= cuts[i]) & (F.col("arrival_seq") < cuts[i + 1]))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.run(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    good, bad = silver.bronze_to_silver(source, 7, options)
    got = spark.read.parquet(str(tmp_path / "out/silver")).drop("batch_id")
    assert sorted(map(str, got.select(good.columns).collect())) == sorted(map(str, good.collect()))
    lost = spark.read.parquet(str(tmp_path / "out/quarantine"))
    assert sorted(r.event_id for r in lost.collect()) == sorted(r.event_id for r in bad.collect())
    # A run that died between its last write and its commit does the same again.
    before = sorted(map(str, got.collect()))
    for query in ("mark", "settle"):
        done = sorted((tmp_path / f"out/checkpoint-{query}/commits").glob("[0-9]*"), key=lambda p: int(p.name))
        done[-1].unlink()
        (done[-1].parent / f".{done[-1].name}.crc").unlink(missing_ok=True)
    stream.run(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out/silver")).drop("batch_id").collect())) == before


def _events_in(spark, path, rows):
    spark.createDataFrame(rows, "event_id string, arrival_seq long, timestamp_ms long").join(bronze(spark, SF).limit(1).drop("event_id", "arrival_seq", "timestamp_ms")).coalesce(1).write.mode("append").parquet(path)


def test_a_late_copy_with_another_time_is_found(spark, tmp_path):
    path, minute = str(tmp_path / "in"), 60_000
    options = silver.SilverOptions(watermark.WatermarkConfig(5 * minute, 50 * minute))
    stream = silver_stream.SilverStream(str(tmp_path / "out"), 7, options)
    day = 86_400_000
    for rows in ([("dup", 1, 10 * day), ("a", 2, 10 * day + minute)], [("b", 3, 12 * day)], [("dup", 4, 12 * day)]):
        _events_in(spark, path, rows)
        stream.run(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    got = sorted(r.event_id for name in ("silver", "quarantine") for r in spark.read.schema("event_id string").parquet(str(tmp_path / "out" / name)).collect())
    assert got == ["a", "b", "dup"]


def test_ids_without_a_time_limit_are_kept_by_a_built_in_aggregate(spark, tmp_path):
    path, day = str(tmp_path / "in"), 86_400_000
    stream = silver_stream.SilverStream(str(tmp_path / "out"), 7, silver.SilverOptions(watermark.WatermarkConfig(day, 9 * day)))

    def run():
        stream.run(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path))
        found = [spark.read.schema("event_id string, timestamp_ms long").parquet(str(tmp_path / "out" / name)) for name in ("silver", "quarantine")]
        return sorted(((r.event_id or "", r.timestamp_ms) for t in found for r in t.collect()))

    # Three batches of ``mark`` in one trigger of ``settle``: the least arrival of all of them is the first.
    for rows in ([("a", 5, 10 * day), ("b", 1, 10 * day), (None, 6, 10 * day)], [("a", 3, 10 * day + 1), ("b", 4, 10 * day + 1)], [(None, 2, 10 * day + 2), ("c", 7, 10 * day + 2)]):
        _events_in(spark, path, rows)
    first = [("", 10 * day + 2), ("a", 10 * day + 1), ("b", 10 * day), ("c", 10 * day + 2)]
    assert run() == first
    # What was let through stays, also for copies that arrived before it.
    _events_in(spark, path, [("a", 0, 10 * day + 3), (None, 0, 10 * day + 3), ("d", 8, 10 * day + 3), ("d", 9, 10 * day)])
    assert run() == [*first, ("d", 10 * day + 3)]
    assert [r.operatorName for r in spark.read.format("state-metadata").load(str(tmp_path / "out/checkpoint-settle")).select("operatorName").distinct().collect()] == ["stateStoreSave"]
    # A row that cannot be found is an error, never left out.
    schema = spark.read.parquet(str(tmp_path / "out/marked/batch_id=0")).schema
    with pytest.raises(Exception, match="marked row is missing"):
        stream._marked_rows(spark.createDataFrame([("a", 0, 0), ("lost", 0, 0)], "event_id string, first_in long, last_in long"), schema).collect()


def test_keys_are_let_through_again_after_their_time(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "event_id string, arrival_seq long, timestamp_ms long")
    for name, ttl, want in (("short", 1500, 3), ("long", 3_600_000, 2), ("never", None, 2)):
        for part in (rows(("a", 2, 0), ("a", 1, 0), ("b", 3, 0)), rows(("a", 4, 0))):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            kept = silver_stream.dedup_ttl_stream(spark.readStream.schema(part.schema).parquet(str(tmp_path / name / "in")), ttl)
            with silver_stream.keyed_state(spark):
                out = kept.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "c")).trigger(availableNow=True).start()
            out.awaitTermination()
            time.sleep(2 if ttl == 1500 else 0)
        got = sorted((r.event_id, r.arrival_seq) for r in spark.read.parquet(str(tmp_path / name / "out")).collect())
        assert got == ([("a", 1), ("a", 4), ("b", 3)] if want == 3 else [("a", 1), ("b", 3)]), name
        assert {r.event_id for r in silver_stream.seen_keys(spark, str(tmp_path / name / "c")).collect()} >= {"a"}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true") == "true"


def test_keys_of_a_bucket_share_one_list_of_state(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "event_id string, arrival_seq long, timestamp_ms long")
    for part in (rows(*((f"k{i % 40}", i, 0) for i in range(80)), (None, 99, 0)), rows(("k3", 1, 0), ("new", 7, 0), ("new", 6, 0), (None, 1, 0))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept = silver_stream.dedup_ttl_stream(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), 3_600_000, buckets=3)
        with silver_stream.keyed_state(spark):
            out = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        out.awaitTermination()
    want = {(f"k{i}", i) for i in range(40)} | {(None, 99), ("new", 6)}
    got = [(r.event_id, r.arrival_seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(want) and set(got) == want
    seen = [(r.event_id, int(r.place)) for r in silver_stream.seen_keys(spark, str(tmp_path / "c")).collect()]
    assert len(seen) == len(want) and set(seen) == want
    assert spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "c")).select("key").distinct().count() <= 3


def test_online_store_merges_each_batch_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k string, ts long, v int")
    store = online_store.OnlineStore(str(tmp_path), ("k",), "ts", buckets=3)
    batches = [rows(("a", 1, 1), ("b", 1, 2), ("a", 3, 3)), rows(("a", 2, 4), ("c", 1, 5)), rows(), rows(("b", 9, 6), ("b", 9, 7))]
    for i, b in enumerate(batches):
        store.merge(b, i)
        store.merge(b, i)  # run again
    found = lambda i: sorted(map(tuple, store.read(spark, batches[0].schema, i).collect()))
    assert found(0) == [("a", 3, 3), ("b", 1, 2)] and found(1) == found(2) == [("a", 3, 3), ("b", 1, 2), ("c", 1, 5)]
    assert found(3) == [("a", 3, 3), ("b", 9, 7), ("c", 1, 5)]
    assert found(-1) == []


def test_messages_round_trip_without_a_queue(spark):
    rows = bronze(spark, SF).select(*[f.name for f in schemas.EVENT]).limit(20)
    sent = feeds.messages_of(rows).selectExpr("value", "'t' AS topic", "1 AS partition", "5L AS offset")
    got = feeds.parsed_messages(sent)
    assert got.columns[-4:] == ["kafka_topic", "kafka_partition", "kafka_offset", "error"]
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    broken = spark.createDataFrame([(b"{", "t", 0, 1)], "value binary, topic string, partition int, offset long")
    assert (feeds.parsed_messages(broken).first().event_id, feeds.parsed_messages(broken).first().error) == (None, "Bad message")
    schema = schemas.to_avro_json(schemas.EVENT, "UserEvent")
    framed = feeds.messages_of(rows, (7, schema)).selectExpr("value", "'t' AS topic", "1 AS partition", "5L AS offset")
    back = feeds.parsed_messages(framed, {7: schema})
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect())) and back.filter("error IS NULL").count() == 20
    assert feeds.parsed_messages(framed, {8: schema}).first().error == "Unknown schema 7"


def test_stateful_streams(spark, tmp_path):
    source = bronze(spark, SF, duplicates=True).orderBy("timestamp_ms").coalesce(1)
    source.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    out = silver_stream.dedup_stream(read()).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    out.awaitTermination()
    assert spark.table("deduped").count() == source.select("event_id").distinct().count()
    counts = silver_stream.funnel_stream(read()).writeStream.format("memory").queryName("funnel").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.awaitTermination()
    assert spark.table("funnel").agg(F.sum("purchases")).first()[0] == source.filter("event_type = 'PURCHASE'").count()
    assert silver_stream.validated_stream(source).filter("size(errors) > 0").count() > 0
