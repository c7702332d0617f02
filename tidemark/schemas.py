"""Schemas of events and derived tables, and the values of the data contract."""

from __future__ import annotations

import json

from pyspark.sql import types as T

# Fixed values of the data contract.
EVENT_TYPES = ("CLICK", "PAGE_VIEW", "PURCHASE", "SESSION_START", "SESSION_END", "ADD_TO_CART")
DEVICE_TYPES = ("DESKTOP", "MOBILE", "TABLET", "UNKNOWN")
REQUIRED = ("event_id", "event_type", "user_id", "session_id", "timestamp_ms", "device_type", "country_code", "app_version")
TS_MIN_MS = 1577836800000
TS_MAX_MS = 2051222400000
COUNTRY_PATTERN = "^[A-Z]{2}$"

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

FEATURES = (
    "purchase_count_1h",
    "purchase_count_24h",
    "purchase_count_7d",
    "revenue_sum_1h",
    "revenue_sum_24h",
    "revenue_sum_7d",
    "session_count_24h",
    "event_count_24h",
    "days_since_last_purchase",
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("amount_cents", T.LongType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("app_version", T.StringType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT.fieldNames())
BRONZE = T.StructType(
    [
        *EVENT.fields,
        T.StructField("kafka_topic", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("ingestion_timestamp_ms", T.LongType()),
        T.StructField("ingestion_date", T.StringType()),
    ]
)
SILVER = T.StructType(
    [
        *EVENT.fields,
        T.StructField("silver_processed_ms", T.LongType()),
        T.StructField("watermark_classification", T.StringType()),
        T.StructField("event_date", T.StringType()),
    ]
)
QUARANTINE = T.StructType(
    [
        *EVENT.fields,
        T.StructField("quarantine_reason", T.StringType()),
        T.StructField("validation_errors", T.StringType()),
        T.StructField("silver_processed_ms", T.LongType()),
        T.StructField("ingestion_date", T.StringType()),
    ]
)


def from_avro_json(schema: str) -> T.StructType:
    """The StructType of an Avro record schema given as JSON: primitives, enums and unions with null."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}

    def field(spec: dict) -> T.StructField:
        kind, null = spec["type"], False
        if isinstance(kind, list):
            null = "null" in kind
            kind = next(k for k in kind if k != "null")
        if isinstance(kind, dict):
            kind = "string" if kind["type"] == "enum" else kind["type"]
        return T.StructField(spec["name"], kinds[kind], null)

    return T.StructType([field(f) for f in json.loads(schema)["fields"]])


def to_avro_json(schema: T.StructType, name: str) -> str:
    """The Avro record schema of a StructType of plain types, as JSON; the inverse of ``from_avro_json``."""
    kinds = {"string": "string", "bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean", "binary": "bytes"}
    kind = lambda f: ["null", kinds[f.dataType.simpleString()]] if f.nullable else kinds[f.dataType.simpleString()]
    return json.dumps({"type": "record", "name": name, "fields": [{"name": f.name, "type": kind(f)} for f in schema]})
