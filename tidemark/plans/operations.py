"""Registered queries of feeds, monitoring and state: what keeps the event path running."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import monitoring, watermark
from ..schemas import EVENT, to_avro_json
from ..sources import feeds, registry
from ..sources.tables import TableIO, scratch
from ..streaming import online_store, silver_stream
from .adapters import BRONZE_SQL, DUPLICATED_SQL, bronze, table
from .queries import _OUTCOME_SQL, OPTIONS, PROCESSED_MS
from .registry import query

MINUTE = 60_000

# Counters and histograms over sliding ranges

#: Four instances, which restart with each day of the events, count what they serve and how long it takes. Each event is a
#: sample; a day is compressed to 24 minutes.
_SAMPLES_SQL = """served AS (SELECT CAST(event_id % 4 AS INTEGER) AS instance, epoch_us(ts) // 60000 AS t, event_id, CAST(ts AS DATE) AS day, value / 500.0::DOUBLE AS seconds FROM events)"""
_LATENCY_LE = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def _rates_sql(samples: str, by: str, minutes: int) -> str:
    """per_second by the rules of sliding rates, from samples (by..., t, v)."""
    return f"""g AS (SELECT *, unnest(range(CAST(ceil(t / {MINUTE}.0::DOUBLE) AS BIGINT), CAST(ceil(t / {MINUTE}.0::DOUBLE) AS BIGINT) + {minutes})) * {MINUTE} AS at_ms FROM (SELECT {by}, t, CAST(max(v) AS DOUBLE) AS v FROM {samples} GROUP BY {by}, t)),
l AS (SELECT *, lag(v) OVER (PARTITION BY {by}, at_ms ORDER BY t) AS p FROM g),
a AS (SELECT {by}, at_ms, count(*) AS samples, sum(CASE WHEN p IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END)::DOUBLE AS increase, min(t) / 1000.0::DOUBLE AS t0, max(t) / 1000.0::DOUBLE AS t1, arg_min(v, t) AS v0 FROM l GROUP BY {by}, at_ms),
b AS (SELECT *, (t1 - t0) / (samples - 1) AS mean, t0 - (at_ms - {minutes * MINUTE}) / 1000.0::DOUBLE AS s, at_ms / 1000.0::DOUBLE - t1 AS e FROM a WHERE samples > 1),
c AS (SELECT *, CASE WHEN s >= 1.1::DOUBLE * mean THEN mean / 2 ELSE s END AS s1, CASE WHEN e >= 1.1::DOUBLE * mean THEN mean / 2 ELSE e END AS e1 FROM b),
rates AS (SELECT {by}, at_ms, samples, increase, increase * ((t1 - t0) + least(s1, CASE WHEN increase > 0 THEN (t1 - t0) * (v0 / increase) END) + e1) / (t1 - t0) / {minutes * 60}.0::DOUBLE AS per_second FROM c)"""


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("CAST(event_id % 4 AS int) AS instance", "event_id", "CAST(ts AS timestamp) AS ts", "value / 500.0D AS seconds")
    return rows.withColumns({"ts_ms": F.floor(F.unix_micros("ts") / F.lit(60_000)), "day": F.to_date("ts")})


def _counters(spark: SparkSession, sf_dir: str, counts: dict[str, Column]) -> DataFrame:
    """(instance, ts_ms, counters...): what was counted up to each time of an instance's day.

    Added up within minutes, which are many where days are few, and over what the minutes of a day come to.
    """
    served = _served(spark, sf_dir).withColumn("minute", F.floor(F.col("ts_ms") / F.lit(MINUTE)))  # within a day
    earlier = Window.partitionBy("instance", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    sums = served.groupBy("instance", "day", "minute").agg(*(c.alias(name) for name, c in counts.items()))
    sums = sums.select(F.col("instance").alias("_instance"), F.col("minute").alias("_minute"), *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in counts))
    inside = Window.partitionBy("instance", "minute").orderBy("ts_ms")  # rows of one time count together
    rows = served.select("instance", "minute", "ts_ms", F.lag("ts_ms").over(inside).alias("_before"), *(c.over(inside).alias(name) for name, c in counts.items()))
    rows = rows.filter(F.col("_before").isNull() | (F.col("_before") < F.col("ts_ms")))
    # A row for each instance and minute is broadcast.
    rows = rows.join(F.broadcast(sums), F.col("instance").eqNullSafe(F.col("_instance")) & (F.col("minute") == F.col("_minute")))
    return rows.select("instance", "ts_ms", *((F.col(name) + F.col(f"_{name}")).alias(name) for name in counts))


def _rate(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    samples = _counters(spark, sf_dir, {"value": F.count("*")})
    rates = monitoring.counter_rate(samples, ["instance"], minutes * MINUTE, MINUTE).filter("per_second IS NOT NULL")
    return rates.withColumns({"increase": F.round("increase", 6), "per_second": F.round("per_second", 9)})


def _rate_sql(minutes: int) -> str:
    samples = "(SELECT instance, t, row_number() OVER (PARTITION BY instance, day ORDER BY t, event_id) AS v FROM served)"
    return f"WITH {_SAMPLES_SQL}, {_rates_sql(samples, 'instance', minutes)} SELECT instance, at_ms, samples, round(increase, 6) AS increase, round(per_second, 9) AS per_second FROM rates"


@query(_rate_sql(1))
def prediction_rate_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions a second of each instance over one minute."""
    return _rate(spark, sf_dir, 1)


@query(_rate_sql(5))
def prediction_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over five minutes, each minute."""
    return _rate(spark, sf_dir, 5)


_LE_SQL = f"[{', '.join(map(str, _LATENCY_LE))}, 'inf'::DOUBLE]::DOUBLE[]"
_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _quantile_sql(q: float, at: str) -> str:
    low, below = f"CASE WHEN {at} > 1 THEN le[{at} - 1] ELSE 0.0 END", f"CASE WHEN {at} > 1 THEN n[{at} - 1] ELSE 0.0 END"
    return f"round(CASE WHEN n[-1] <= 0 THEN NULL WHEN {at} = len(n) THEN le[len(n) - 1] ELSE {low} + (le[{at}] - {low}) * (({q}::DOUBLE * n[-1] - {below}) / (n[{at}] - {below})) END, 8)"


def _latency_sql(minutes: int) -> str:
    samples = f"""(SELECT instance, le, t, count(*) FILTER (seconds <= le) OVER (PARTITION BY instance, le, day ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS v
    FROM served, (SELECT unnest({_LE_SQL}) AS le))"""
    return f"""WITH {_SAMPLES_SQL}, {_rates_sql(samples, 'instance, le', minutes)}, h AS (SELECT instance, at_ms, list(le ORDER BY le) AS le, list(m ORDER BY le) AS n
    FROM (SELECT *, max(per_second) OVER (PARTITION BY instance, at_ms ORDER BY le) AS m FROM rates) GROUP BY 1, 2),
    k AS MATERIALIZED (SELECT *, {', '.join(f'least(len(list_filter(n, lambda x: x < {q}::DOUBLE * n[-1])) + 1, len(n)) AS at_{name}' for name, q in _POINTS.items())} FROM h)
    SELECT instance, at_ms, {', '.join(f'{_quantile_sql(q, "at_" + name)} AS {name}' for name, q in _POINTS.items())} FROM k"""


def _latency(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    bounds = {f"le{i}": le for i, le in enumerate((*_LATENCY_LE, float("inf")))}
    samples = _counters(spark, sf_dir, {name: F.count_if(F.col("seconds") <= le) if le < float("inf") else F.count("*") for name, le in bounds.items()})
    found = monitoring.quantiles_of_histograms(samples, ["instance"], bounds, minutes * MINUTE, MINUTE)
    return found.select("instance", "at_ms", *(F.round(p, 8).alias(p) for p in _POINTS))


@query(_latency_sql(1))
def latency_quantiles_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50, p95 and p99 of latency from cumulative buckets over one minute."""
    return _latency(spark, sf_dir, 1)


@query(_latency_sql(5))
def latency_quantiles_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latency(spark, sf_dir, 5)


# Framed messages of two schema versions in one feed

_FIELDS = [f.name for f in EVENT]
_OLD_SCHEMA = T.StructType([f for f in EVENT if f.name not in ("app_version", "page_url")] + [T.StructField("region", T.StringType())])


@query(f"""WITH {BRONZE_SQL}, m AS (SELECT *, kafka_offset % 2 = 0 AS old, CASE WHEN kafka_offset % 97 = 5 THEN 'Short message' WHEN kafka_offset % 89 = 5 THEN 'Bad magic byte'
WHEN kafka_offset % 83 = 5 THEN 'Unknown schema 9' WHEN kafka_offset % 79 = 5 THEN 'Bad record' END AS error FROM bronze)
SELECT kafka_offset, CASE WHEN error IN ('Short message', 'Bad magic byte') THEN NULL WHEN error = 'Unknown schema 9' THEN 9 WHEN old THEN 1 ELSE 2 END AS schema_id, error, error IS NOT NULL AS kept,
{", ".join(f"CASE WHEN error IS NULL {'AND NOT old ' if c in ('app_version', 'page_url') else ''}THEN {c} END AS {c}" for c in _FIELDS)} FROM m""")
def framed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as framed Avro, half of them by an older schema, some damaged, read by one schema."""
    schemas = registry.SchemaRegistry(TableIO(scratch(spark, "schemas")))
    old, new = to_avro_json(_OLD_SCHEMA, "UserEvent"), to_avro_json(EVENT, "UserEvent")
    ids = [schemas.register(spark, "events-value", s) for s in (old, new)]
    events = bronze(spark, sf_dir).select(*_FIELDS, F.lit("r").alias("region"), "kafka_offset")
    # The key carries the offset here, as a queue would give it.
    sent = [registry.framed(events.filter(F.col("kafka_offset") % 2 == i), ids[i], s, key="kafka_offset") for i, s in enumerate((old, new))]
    offset, value = F.col("key").cast("long"), F.col("value")
    after = lambda n: F.expr(f"substring(value, {n + 1})")
    damaged = (
        F.when(offset % 97 == 5, F.substring(value, 1, 4))
        .when(offset % 89 == 5, F.concat(F.unhex(F.lit("01")), after(1)))
        .when(offset % 83 == 5, F.concat(F.unhex(F.lit("0000000009")), after(5)))
        .when(offset % 79 == 5, F.expr("substring(value, 1, length(value) - 1)"))
        .otherwise(value)
    )
    messages = sent[0].unionByName(sent[1]).select(offset.alias("kafka_offset"), damaged.alias("value"))
    found = registry.unframed(messages, schemas.schemas(spark), new)
    return found.select("kafka_offset", F.col("schema_id").cast("int").alias("schema_id"), F.split("error", ":")[0].alias("error"), F.col("value").isNotNull().alias("kept"), *_FIELDS)


# Watermarks of partitioned sources, and a memory of bounded size

_IDLE = watermark.WatermarkConfig(allowed_ms=300_000, idle_ms=30_000)
#: A row arrives each second; partition 3 sends nothing for 500 of every 2,000.
_ACTIVE = [f"(arrived - coalesce(a{p}, (SELECT min(arrived) FROM stalled)) < {_IDLE.idle_ms})" for p in range(4)]


@query(f"""WITH {BRONZE_SQL}, stalled AS (SELECT *, arrival_seq * 1000 AS arrived FROM bronze WHERE NOT (kafka_partition = 3 AND arrival_seq // 500 % 4 = 1)),
m AS (SELECT *, {", ".join(f"max(CASE WHEN kafka_partition = {p} THEN timestamp_ms END) OVER w AS t{p}, max(CASE WHEN kafka_partition = {p} THEN arrived END) OVER w AS a{p}" for p in range(4))} FROM stalled WINDOW w AS (ORDER BY arrival_seq, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CASE WHEN NOT ({" OR ".join(f"{a} AND t{p} IS NULL" for p, a in enumerate(_ACTIVE))}) THEN least({", ".join(f"CASE WHEN {a} THEN t{p} END" for p, a in enumerate(_ACTIVE))}) END AS low FROM m)
SELECT event_id, kafka_partition, max(low) OVER (ORDER BY arrival_seq, event_id ROWS UNBOUNDED PRECEDING) - {_IDLE.allowed_ms} AS watermark_ms FROM l""")
def watermark_idle_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark of a source of four partitions, one of which stalls: it holds the others back for 30 seconds only."""
    events = bronze(spark, sf_dir).withColumn("ingestion_timestamp_ms", F.col("arrival_seq") * 1000)
    stalled = events.filter(~((F.col("kafka_partition") == 3) & (F.floor(F.col("arrival_seq") / 500) % 4 == 1)))
    return watermark.partition_watermark(stalled, config=_IDLE).select("event_id", "kafka_partition", "watermark_ms")


_CAP = 53


@query(f"""WITH RECURSIVE {DUPLICATED_SQL}, t AS MATERIALIZED (SELECT event_id, arrival_seq, row_number() OVER (ORDER BY arrival_seq, event_id) AS n FROM arrived),
r AS (SELECT n, event_id, arrival_seq, true AS ok, [event_id] AS seen FROM t WHERE n = 1
UNION ALL SELECT t.n, t.event_id, t.arrival_seq, NOT list_contains(seen, t.event_id), CASE WHEN list_contains(seen, t.event_id) THEN seen ELSE list_append(seen, t.event_id)[-{_CAP}:] END
FROM r JOIN t ON t.n = r.n + 1)
SELECT event_id, arrival_seq FROM r WHERE ok""")
def dedup_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events let through by a memory of the 53 ids accepted last: some copies come back after their id has left it."""
    return watermark.accepted_within_cap(bronze(spark, sf_dir, duplicates=True), cap=_CAP, tie=("event_id",))


# Uploads whose rejected rows can be found


@query("""WITH o AS (SELECT o_orderkey AS key, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) + 1 AS row FROM orders)
SELECT key, row, CASE WHEN key % 13 = 0 THEN 'No order_id' WHEN key % 29 IN (1, 2) THEN 'Bad amount' ELSE 'No customer_id' END AS error FROM o WHERE key % 13 = 0 OR key % 29 IN (1, 2) OR key % 31 = 4""")
def csv_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as three CSV files with line breaks in quoted cells: the rejected rows and their numbers."""
    root = scratch(spark, "upload")
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS key", "IF(o_orderkey % 13 = 0, NULL, CAST(o_orderkey AS string)) AS order_id", "IF(o_orderkey % 13 <> 0 AND o_orderkey % 29 NOT IN (1, 2) AND o_orderkey % 31 = 4, NULL, CAST(o_custkey AS string)) AS customer_id",
        "CASE o_orderkey % 29 WHEN 1 THEN 'NaN' WHEN 2 THEN '1e30' ELSE CAST(o_totalprice AS string) END AS total", "concat('say \"hi\",\\n\\nkey=', CAST(o_orderkey AS string), IF(o_orderkey % 5 = 0, '\\n', '')) AS note",
    )
    for i in range(3):
        rows.filter(F.col("key") % 3 == i).repartition(1).sortWithinPartitions("key").drop("key").write.option("header", True).option("escape", '"').csv(f"{root}/part{i}")
    _, bad = feeds.csv_upload(spark, f"{root}/part*", MINUTE)
    return bad.select(F.regexp_extract("payload", "key=([0-9]+)", 1).cast("long").alias("key"), "row", "error")


# State that outlives a run


def _in_parts(spark: SparkSession, rows: DataFrame, path: str, order: str, parts: int, run) -> None:
    """Append the rows to ``path`` in ``parts`` parts by ``order``, calling ``run(i)`` after each: a start, and restarts."""
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0]
    which = sum((F.when(F.col(order) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(parts):
        rows.filter(which == i).write.mode("append").parquet(path)
        run(i)


@query(f"WITH {DUPLICATED_SQL} SELECT event_id, min(arrival_seq) AS arrival_seq, true AS remembered FROM arrived GROUP BY 1")
def stream_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state with a time to live that outlasts the run, in three runs; what got through, and whether the state has it."""
    root, source = scratch(spark, "ttl"), bronze(spark, sf_dir, duplicates=True).select("event_id", "arrival_seq", "timestamp_ms")

    def run(_: int) -> None:
        kept = silver_stream.dedup_ttl_stream(spark.readStream.schema(source.schema).parquet(f"{root}/in"), 30 * 24 * 60 * MINUTE)
        with silver_stream.keyed_state(spark):
            out = kept.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        out.awaitTermination()

    _in_parts(spark, source, f"{root}/in", "arrival_seq", 3, run)
    state = silver_stream.seen_keys(spark, f"{root}/checkpoint").select("event_id", F.col("place").cast("long").alias("place"))
    kept = spark.read.schema(source.schema).parquet(f"{root}/out").join(state, "event_id", "left")
    return kept.select("event_id", "arrival_seq", F.coalesce(F.col("place") == F.col("arrival_seq"), F.lit(False)).alias("remembered"))


@query(f"""WITH {BRONZE_SQL} SELECT user_id, timestamp_ms, event_id, event_type FROM bronze QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, event_id DESC) = 1""")
def stream_online_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, merged from a stream in three runs, the last batch twice."""
    root, changes = scratch(spark, "online"), bronze(spark, sf_dir).select("user_id", "timestamp_ms", "event_id", "event_type", "arrival_seq")
    store = online_store.OnlineStore(root, ("user_id",), "timestamp_ms", buckets=8)
    schema = changes.drop("arrival_seq").schema

    def run(i: int) -> None:
        store.start(spark.readStream.schema(changes.schema).parquet(f"{root}/in").drop("arrival_seq")).awaitTermination()

    _in_parts(spark, changes, f"{root}/in", "arrival_seq", 3, run)
    last = spark.read.schema("batch long").parquet(f"{root}/parts").agg(F.max("batch")).first()[0]
    cut = changes.agg(F.percentile_approx("arrival_seq", [1 / 3, 2 / 3])).first()[0][1]
    store.merge(changes.filter(F.col("arrival_seq") >= cut).drop("arrival_seq"), last)  # the same batch again
    return store.read(spark, schema, last)


@query(f"""WITH {_OUTCOME_SQL} SELECT CASE WHEN outcome = 'quarantined' THEN 'quarantine' ELSE 'silver' END AS target, event_id, event_type, user_id, session_id, timestamp_ms, page_url, product_id, amount_cents, device_type, country_code, app_version,
CASE WHEN outcome <> 'quarantined' THEN watermark_classification END AS watermark_classification FROM outcomes WHERE outcome IN ('silver', 'late', 'quarantined')""")
def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning path as a stream, restarted after each third of the arrivals: both tables, equal to one run over all."""
    root, source = scratch(spark, "stream"), bronze(spark, sf_dir, duplicates=True)
    stream = silver_stream.SilverStream(root, PROCESSED_MS, OPTIONS)
    _in_parts(spark, source, f"{root}/in", "arrival_seq", 3, lambda _: stream.run(spark.readStream.schema(source.schema).parquet(f"{root}/in")))
    good = spark.read.parquet(f"{root}/silver").select(F.lit("silver").alias("target"), *_FIELDS, "watermark_classification")
    bad = spark.read.parquet(f"{root}/quarantine").select(F.lit("quarantine").alias("target"), *_FIELDS, F.lit(None).cast("string").alias("watermark_classification"))
    return good.unionByName(bad)
