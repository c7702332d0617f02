"""Order webhooks and CSV rows to bronze events.

Each function returns all input rows with ``error``: null, or why the row is rejected. The event
type and device of the results are those that the feeds give, outside the data contract;
``silver.canonicalize_enums`` maps them if asked. A number that is none, is not finite or does not fit
makes a "Bad amount" or "Bad time" row, never a failure of the job. Cells of a CSV that are empty are rejected where a
value is required. ``now_ms`` stands for the time of ingestion; columns in ``keep`` go along, such as a row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_amount, event_date, first_alias, json_text, money_to_cents, parse_ts_ms, seems_absent
from ..schemas import BRONZE

# Fixed values of normalised events.
EVENT_TYPE = "purchase"
DEVICE_TYPE = "web"
DEFAULT_COUNTRY = "US"
FEEDS = {
    "shopify": {"prefix": "shopify-", "user": "USER-SHOPIFY-", "version": "shopify-webhook-v1", "topic": "webhook.shopify"},
    "woocommerce": {"prefix": "woo-", "user": "USER-WOO-", "version": "woocommerce-webhook-v1", "topic": "webhook.woocommerce"},
    "csv": {"prefix": "csv-", "user": "USER-", "version": "csv-upload-v1", "topic": "csv_upload"},
}
ORDER_ID_KEYS = ("order_id", "id", "order_number", "order")
CUSTOMER_ID_KEYS = ("customer_id", "user_id", "customer", "client_id", "email")
DATE_KEYS = ("order_date", "created_at", "date", "timestamp", "purchase_date")
AMOUNT_KEYS = ("total_amount", "total", "amount", "revenue", "price", "order_total")
PRODUCT_KEYS = ("product_id", "item_id", "sku")
COUNTRY_KEYS = ("country", "country_code", "billing_country", "ship_country")

_ITEMS = "line_items array<struct<product_id: string>>"
SHOPIFY = f"id string, customer_id string, customer struct<id: string>, created_at string, total_price string, subtotal_price string, landing_site string, billing_address struct<country_code: string, country: string>, shipping_address struct<country_code: string, country: string>, {_ITEMS}"
WOOCOMMERCE = f"id string, customer_id string, date_created string, date_created_gmt string, total string, billing struct<country: string>, {_ITEMS}"
#: The same values with their types, read only for a payload where one may count as absent.
TYPED = {
    SHOPIFY: "id variant, customer_id variant, customer struct<id: variant>, created_at variant, total_price variant",
    WOOCOMMERCE: "id variant, customer_id variant, date_created variant, date_created_gmt variant",
}


def _full(x: Column) -> Column:
    """Null in place of an empty text."""
    return F.when(x != "", x)


def _event(feed: str, order: Column, customer: Column, ts: Column, page: Column, product: Column, cents: Column, country: Column, now_ms: int) -> list[Column]:
    spec = FEEDS[feed]
    return [
        F.concat(F.lit(spec["prefix"]), order).alias("event_id"),
        F.lit(EVENT_TYPE).alias("event_type"),
        F.concat(F.lit(spec["user"]), customer).alias("user_id"),
        F.md5(F.concat_ws("|", F.lit(feed), order, customer)).alias("session_id"),
        ts.alias("timestamp_ms"),
        page.alias("page_url"),
        product.alias("product_id"),
        cents.alias("amount_cents"),
        F.lit(DEVICE_TYPE).alias("device_type"),
        F.upper(F.substring(country, 1, 2)).alias("country_code"),
        F.lit(spec["version"]).alias("app_version"),
        F.lit(spec["topic"]).alias("kafka_topic"),
        F.lit(0).alias("kafka_partition"),
        F.lit(0).cast("long").alias("kafka_offset"),
        F.lit(now_ms).cast("long").alias("ingestion_timestamp_ms"),
        event_date(F.lit(now_ms).cast("long")).alias("ingestion_date"),
    ]


def _first_error(*tests: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in tests], F.lit(None).cast("string")).alias("error")


def _parsed(payloads: DataFrame, column: str, schema: str, keep: tuple[str, ...], *texts: str) -> DataFrame:
    """(p, t, keep...): each payload parsed once, and the text or null of the JSON values ``texts`` of it, their dots as two underscores.

    A plain projection would be merged into its many uses and evaluated in each.
    """
    p = payloads.select(F.explode(F.array(F.struct(F.from_json(column, schema).alias("p"), F.col(column).alias("raw")))).alias("x"), *keep)
    typed = F.from_json(F.col("x.raw"), TYPED[schema])
    found = F.struct(*[F.when(seems_absent(F.col(f"x.p.{name}")), json_text(typed.getField(name) if "." not in name else typed[name.split(".")[0]][name.split(".")[1]])).otherwise(F.col(f"x.p.{name}")).alias(name.replace(".", "__")) for name in texts])
    return p.select(F.col("x.p").alias("p"), F.explode(F.array(found)).alias("t"), *keep)


def shopify(payloads: DataFrame, now_ms: int, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    p = _parsed(payloads, column, SHOPIFY, keep, "id", "customer.id", "customer_id", "created_at", "total_price")
    order, customer = F.col("t.id"), F.coalesce(F.col("t.customer__id"), F.col("t.customer_id"))
    created = F.col("t.created_at")
    total = F.coalesce(F.col("t.total_price"), F.col("p.subtotal_price"), F.lit("0"))
    place = F.coalesce(F.col("p.billing_address"), F.col("p.shipping_address"))
    country = F.coalesce(_full(place["country_code"]), _full(place["country"]), F.lit(DEFAULT_COUNTRY))
    product = F.try_element_at("p.line_items", F.lit(1))["product_id"]
    ts, cents = parse_ts_ms(created, now_ms), money_to_cents(total)
    error = _first_error((order.isNull(), "Missing 'id'"), (customer.isNull(), "Missing customer id"), (created.isNull(), "Missing 'created_at'"), (ts.isNull(), "Bad time"), (cents.isNull(), "Bad amount"))
    return p.select(*_event("shopify", order, customer, ts, F.col("p.landing_site"), product, cents, country, now_ms), error, *keep)


def woocommerce(payloads: DataFrame, now_ms: int, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    p = _parsed(payloads, column, WOOCOMMERCE, keep, "id", "customer_id", "date_created", "date_created_gmt")
    order, customer = F.col("t.id"), F.col("t.customer_id")
    created = F.coalesce(F.col("t.date_created"), F.col("t.date_created_gmt"))
    country = F.coalesce(_full(F.col("p.billing.country")), F.lit(DEFAULT_COUNTRY))
    product = F.try_element_at("p.line_items", F.lit(1))["product_id"]
    ts, cents = parse_ts_ms(created, now_ms), money_to_cents(F.coalesce("p.total", F.lit("0")))
    error = _first_error((order.isNull(), "Missing 'id'"), (customer.isNull(), "Missing 'customer_id'"), (created.isNull(), "Missing 'date_created'"), (ts.isNull(), "Bad time"), (cents.isNull(), "Bad amount"))
    return p.select(*_event("woocommerce", order, customer, ts, F.lit(None).cast("string"), product, cents, country, now_ms), error, *keep)


def csv_rows(rows: DataFrame, now_ms: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a CSV whose columns go by any of their aliases, which are resolved on the header."""
    column = lambda keys: F.col(f"`{found}`").cast("string") if (found := first_alias(rows.columns, keys)) else F.lit(None).cast("string")
    full = lambda c: F.when(F.trim(c) != "", c)
    order, customer, total = full(column(ORDER_ID_KEYS)), full(column(CUSTOMER_ID_KEYS)), full(column(AMOUNT_KEYS))
    ts, cents = parse_ts_ms(full(column(DATE_KEYS)), now_ms), money_to_cents(clean_amount(total))
    country = F.coalesce(full(column(COUNTRY_KEYS)), F.lit(DEFAULT_COUNTRY))
    error = _first_error((order.isNull(), "No order_id"), (customer.isNull(), "No customer_id"), (total.isNull(), "No amount"), (ts.isNull(), "Bad time"), (cents.isNull(), "Bad amount"))
    return rows.select(*_event("csv", order, customer, ts, F.lit(None).cast("string"), full(column(PRODUCT_KEYS)), cents, country, now_ms), error, *keep)


def split_errors(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bronze rows, and of the rejected rows the error and whatever columns were kept with them, such as where they stood."""
    good = normalised.filter("error IS NULL").select(*BRONZE.fieldNames())
    kept = [c for c in normalised.columns if c not in (*BRONZE.fieldNames(), "error")]
    return good, normalised.filter("error IS NOT NULL").select("event_id", "error", *kept)
