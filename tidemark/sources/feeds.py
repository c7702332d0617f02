"""Feeds of raw events: message queues, CSV uploads, webhooks, order exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import event_date
from ..operators import normalize
from ..schemas import EVENT, to_avro_json
from . import lines, registry

ORDER_FILES = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, order_approved_at timestamp, order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp",
    "customers": "customer_id string, customer_unique_id string",
    "payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double",
    "items": "order_id string, order_item_id int, product_id string, seller_id string",
}


def kafka_events(spark: SparkSession, servers: str, topic: str, max_offsets: int = 500, schemas: dict[int, str] | None = None) -> DataFrame:
    """A stream of events from a topic, as JSON or as framed Avro of the given registered schemas, with ingest metadata.

    Needs the queue connector on the class path. The checkpoint of the query that reads it takes the place of committed
    offsets.
    """
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    return parsed_messages(raw, schemas)


def parsed_messages(raw: DataFrame, schemas: dict[int, str] | None = None) -> DataFrame:
    """Events, their place and ``error`` from queue messages (value, topic, partition, offset).

    Framed Avro by the schema that each message names, if there are ``schemas``, else JSON. A message that is no event has an
    error and nulls.
    """
    place = [F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset")]
    if schemas is not None:
        found = registry.unframed(raw.select(*place, "value"), schemas, to_avro_json(EVENT, "UserEvent"))
        return found.select(*EVENT.fieldNames(), "kafka_topic", "kafka_partition", "kafka_offset", "error")
    text = F.col("value").cast("string")
    # What is no JSON object gives no value for a key.
    body = F.from_json(text, EVENT)
    read = raw.select(body.alias("e"), *place, F.when(F.from_json(text, "map<string,string>").isNull(), "Bad message").alias("error"))
    return read.select("e.*", "kafka_topic", "kafka_partition", "kafka_offset", "error")


def messages_of(events: DataFrame, schema: tuple[int, str] | None = None) -> DataFrame:
    """(key, value) messages of events, keyed by user: JSON, or framed Avro of the registered (id, schema)."""
    if schema:
        return registry.framed(events, *schema)
    return events.select(F.col("user_id").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def to_kafka(events: DataFrame, servers: str, topic: str, schema: tuple[int, str] | None = None) -> None:
    """Write events to a topic, acknowledged by all replicas. Needs the queue connector on the class path."""
    messages_of(events, schema).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("topic", topic).save()


def with_ingest_metadata(events: DataFrame, now_ms: int, topic: str = "files") -> DataFrame:
    """Metadata of ingestion for events that no queue has given any."""
    present = events.columns
    added = {
        "kafka_topic": F.lit(topic),
        "kafka_partition": F.lit(0),
        "kafka_offset": F.lit(0).cast("long"),
        "ingestion_timestamp_ms": F.lit(now_ms).cast("long"),
        "ingestion_date": event_date(F.lit(now_ms).cast("long")),
    }
    return events.withColumns({c: v for c, v in added.items() if c not in present})


def csv_upload(spark: SparkSession, path: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Bronze rows of CSV files with a header, and the rejected rows: (event_id, error, file, row, payload).

    ``row`` is the row's number in its file, the header being 1. All columns are read as text.
    """
    rows = lines.numbered_csv(spark, path)
    good, bad = normalize.split_errors(normalize.csv_rows(rows, now_ms, tuple(f"_{c}" for c in lines.PLACE)))
    return good, bad.withColumnsRenamed({f"_{c}": c for c in lines.PLACE})


def webhook_files(spark: SparkSession, path: str, source: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Bronze rows of text files with one webhook payload on each line, and the rejected ones: (event_id, error, file, row, payload)."""
    by = {"shopify": normalize.shopify, "woocommerce": normalize.woocommerce}
    if source not in by:
        raise ValueError(f"unknown source {source!r}; expected one of {sorted(by)}")
    return normalize.split_errors(by[source](lines.numbered_lines(spark, path), now_ms, "payload", lines.PLACE))


def order_export(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The files of an order export by role; all four roles are required."""
    missing = sorted(set(ORDER_FILES) - set(paths))
    if missing:
        raise FileNotFoundError(f"no file for {', '.join(missing)}")
    read = {}
    for role, wanted in ORDER_FILES.items():
        rows = spark.read.option("header", True).csv(paths[role])
        fields = [f.strip().rsplit(" ", 1) for f in wanted.split(",")]
        cast = {"timestamp": lambda c: F.try_to_timestamp(c), "string": lambda c: c}
        read[role] = rows.select(*(cast.get(t, lambda c, t=t: c.try_cast(t))(F.col(n)).alias(n) for n, t in fields if n in rows.columns))
    return read
