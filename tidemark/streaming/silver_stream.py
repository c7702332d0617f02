"""Raw to cleaned events as a stream, in two queries that follow one another.

``mark`` classifies each micro-batch against the running maximum that the batches before it left, a one-row table for each
batch id, and writes the rows that are no discards, the first of each id in the batch. ``settle`` reads these, lets the first of each id
through by keyed state, validates, and writes the silver and quarantine tables. Discards so never enter the state.
The state is a built-in aggregate, four numbers for each id; only ids with a time to live need state of their own (``dedup_ttl_stream``).

A micro-batch costs what is in it: its maximum is one row of state, its ids are looked up in the state store, and no
table of what was seen is read. Both queries go on from their checkpoints. A batch that is run again, after a crash between
its write and its commit, starts from the same state and overwrites its own output; what ``settle`` then reads a second time,
its state knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import quality
from ..operators.silver import SilverOptions, canonicalize_enums, to_silver
from ..operators.watermark import classify, first_per_key

#: The column of the marked table that tells the batch of ``mark`` a row came in.
MARKED_IN = "marked_in"


@dataclass
class SilverStream:
    """Reads raw events and writes the marked, state, silver and quarantine tables below ``root``.

    ``ttl_ms``: forget an id so long (of processing time) after its first copy; by default ids are kept, as in the batch path.
    """

    root: str
    processed_ms: int
    options: SilverOptions = field(default_factory=SilverOptions)
    ttl_ms: int | None = None

    def _table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _top_before(self, spark: SparkSession, batch_id: int) -> int | None:
        """The maximum that the batch before left. Batch ids follow one another, and every batch leaves its state."""
        if batch_id == 0:
            return None
        return spark.read.schema("max_ms long").parquet(f"{self._table('state')}/batch_id={batch_id - 1}").agg(F.max("max_ms")).first()[0]

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._table(name)}/batch_id={batch_id}")

    def mark(self, batch: DataFrame, batch_id: int) -> None:
        """Classify a batch, drop discards and the batch's own copies."""
        o = self.options
        batch = (canonicalize_enums(batch) if o.canonicalize else batch).persist()
        try:
            start = self._top_before(batch.sparkSession, batch_id)
            marked = classify(batch, o.watermark, o.arrival, start)
            live = first_per_key(marked.filter("watermark_classification <> 'discard'"), "event_id", o.arrival, ("timestamp_ms",))
            self._write(live.withColumn(MARKED_IN, F.lit(batch_id).cast("long")), "marked", batch_id)
            top = batch.agg(F.max("timestamp_ms").alias("max_ms")).select(F.greatest("max_ms", F.lit(start).cast("long")).alias("max_ms"))
            self._write(top.coalesce(1), "state", batch_id)
        finally:
            batch.unpersist()

    def settle(self, fresh: DataFrame, batch_id: int) -> None:
        """Validate first copies and write them; ``fresh`` is read once."""
        checked = quality.with_errors(fresh).persist()
        try:
            bad = F.size("errors") > 0
            if not self.options.validate_late:
                bad = bad & (F.col("watermark_classification") == "on_time")
            self._write(to_silver(checked.filter(~bad).drop("errors"), self.processed_ms), "silver", batch_id)
            # The silver candidate has no ingestion date.
            self._write(quality.quarantine(checked.filter(bad).drop("ingestion_date"), self.processed_ms), "quarantine", batch_id)
        finally:
            checked.unpersist()

    def _marked_rows(self, ids: DataFrame, schema: T.StructType) -> DataFrame:
        """The first row of each id in the marked batches that its trigger had of it; only these batches are read."""
        spark, o = ids.sparkSession, self.options
        low, high = ids.agg(F.min("first_in"), F.max("last_in")).first()
        batches = range(low, high + 1) if low is not None else ()
        rows = spark.read.schema(schema).parquet(*(f"{self._table('marked')}/batch_id={b}" for b in batches)) if batches else spark.createDataFrame([], schema)
        own = ids.select(F.col("event_id").alias("_id"), "first_in", "last_in")
        found = own.join(rows, F.col("_id").eqNullSafe(F.col("event_id")) & F.col(MARKED_IN).between(F.col("first_in"), F.col("last_in")), "left")
        # A row that is not there, such as of a batch that is just being written again, fails the trigger, which then runs again.
        there = F.coalesce("watermark_classification", F.raise_error(F.lit("A marked row is missing")).cast("string"))
        found = found.withColumn("watermark_classification", there).select([f.name for f in schema if f.name != MARKED_IN])
        return first_per_key(found, "event_id", o.arrival, ("timestamp_ms",)) if len(batches) > 1 else found  # a batch has an id once

    def _settling(self, spark: SparkSession, schema: T.StructType, trigger: dict) -> StreamingQuery:
        marked = spark.readStream.schema(schema).parquet(f"{self._table('marked')}/batch_id=*")
        if self.ttl_ms is None:
            fresh, mode = first_marked_stream(marked), "update"

            def settle(ids: DataFrame, batch_id: int) -> None:
                ids.persist()
                try:
                    self.settle(self._marked_rows(ids, schema), batch_id)
                finally:
                    ids.unpersist()
        else:
            fresh, mode = dedup_ttl_stream(marked.drop(MARKED_IN), self.ttl_ms, order=(self.options.arrival, "timestamp_ms")), "append"
            settle = self.settle
        with keyed_state(spark):
            return fresh.writeStream.outputMode(mode).foreachBatch(settle).option("checkpointLocation", self._table("checkpoint-settle")).trigger(**trigger).start()

    def start(self, events: DataFrame, trigger: dict | None = None) -> list[StreamingQuery]:
        """Run until all present input is done, or go on by the given trigger, such as {"processingTime": "15 seconds"}.

        The queries that are running; the first is done already where the input present is all.
        """
        spark, now = events.sparkSession, trigger or {"availableNow": True}
        schema = T.StructType([*events.schema.fields, T.StructField("watermark_classification", T.StringType()), T.StructField(MARKED_IN, T.LongType())])
        marking = events.writeStream.foreachBatch(self.mark).option("checkpointLocation", self._table("checkpoint-mark")).trigger(**now).start()
        if "processingTime" not in now:
            marking.awaitTermination()
        return [marking, self._settling(spark, schema, now)]

    def run(self, events: DataFrame) -> None:
        """All input that is there and not yet done."""
        for query in self.start(events):
            query.awaitTermination()


def dedup_stream(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """First event of each id, with state dropped once the watermark is ``ttl`` past it."""
    timed = events.withColumn("event_ts", F.timestamp_millis("timestamp_ms")).withWatermark("event_ts", ttl)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("event_ts")


def first_marked_stream(marked: DataFrame, key: str = "event_id", batch: str = MARKED_IN) -> DataFrame:
    """(key, first_in, last_in) of the keys that come for the first time: the least and greatest batch that their trigger has of them. For update mode.

    State is an aggregate of the key: these two, and the least and greatest time of a trigger that it came in. All rows of
    a trigger have the trigger's time, which a trigger that runs again keeps, so both are the same in a key's first trigger only,
    whichever way the clock is set. Null is a key. Start it within ``keyed_state``.
    """
    came = marked.select(key, batch, F.current_timestamp().alias("_came"))
    seen = came.groupBy(key).agg(F.min(batch).alias("first_in"), F.max(batch).alias("last_in"), F.min("_came").alias("_first"), F.max("_came").alias("_last"))
    return seen.filter("_first = _last").select(key, "first_in", "last_in")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that keys are dealt to, each with one list in the state store. Fixed for the life of a checkpoint.
BUCKETS = 1 << 16


class _FirstSeen(StatefulProcessor):
    """Lets the first row of each key of a bucket through and remembers its place; the memory goes ``ttl_ms`` after it was made."""

    def __init__(self, key: str, kind: str, order: tuple[str, ...], ttl_ms: int | None):
        self.key, self.kind, self.order, self.ttl_ms = key, kind, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", f"id {self.kind}, place string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = {}
        for row in rows:
            place, id_ = [(row[c] is not None, row[c]) for c in self.order], row[self.key]
            if id_ not in first or place < first[id_][0]:
                first[id_] = place, row
        for id_, _ in self.seen.get():
            first.pop(id_, None)
        if first:
            self.seen.appendList([(id_, str(row[self.order[0]])) for id_, (_, row) in first.items()])
        for _, row in first.values():
            yield row

    def close(self) -> None:
        pass


def dedup_ttl_stream(events: DataFrame, ttl_ms: int | None = 3_600_000, key: str = "event_id", order: tuple[str, ...] = ("arrival_seq", "timestamp_ms"), buckets: int = BUCKETS) -> DataFrame:
    """First event of each key since the key was last forgotten, which is ``ttl_ms`` of processing time after it came (None: never).

    The first is that of the least ``order`` in its trigger. A later copy, in the same or a following trigger, is
    dropped and does not extend the time. Keys are dealt to ``buckets`` by hash, and a bucket's keys are a list in the state store, which drops
    each of them itself when its time is over: calls to the store are for each bucket, not for each key. A trigger reads the lists of its own
    keys' buckets only and appends the new keys. Start it within ``keyed_state``. ``seen_keys`` reads the state.
    """
    kind = events.schema[key].dataType.simpleString()
    dealt = events.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").transformWithState(_FirstSeen(key, kind, order, ttl_ms), dealt.schema, "append", "ProcessingTime").drop("_bucket")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it keep their state in RocksDB, beside executors' heaps and checkpointed by changes.

    Such a query also asks for another trigger after each, to let timers run, and so would never be done with the input present.
    State with a time to live needs none, as what is over is never returned, so triggers without input are off.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # would look each key up again
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def seen_keys(spark: SparkSession, checkpoint: str, key: str = "event_id") -> DataFrame:
    """(key, place) of the keys that a deduplication with this checkpoint remembers, from the state data source."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    element = "list_element.value" if "ttlExpirationMs" in state.schema["list_element"].dataType.fieldNames() else "list_element"
    return state.select(F.col(f"{element}.id").alias(key), F.col(f"{element}.place").alias("place"))


def funnel_stream(events: DataFrame, lateness: str = "5 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of event types by window and country, with bounded lateness."""
    timed = events.withColumn("event_ts", F.timestamp_millis("timestamp_ms")).withWatermark("event_ts", lateness)
    return timed.groupBy(F.window("event_ts", window), "country_code").agg(
        F.count_if(F.col("event_type") == "PAGE_VIEW").alias("page_views"),
        F.count_if(F.col("event_type") == "ADD_TO_CART").alias("add_to_carts"),
        F.count_if(F.col("event_type") == "PURCHASE").alias("purchases"),
    )


def validated_stream(events: DataFrame) -> DataFrame:
    """Every event with its errors; the two outputs are filters of it in one foreachBatch."""
    return quality.with_errors(events)
