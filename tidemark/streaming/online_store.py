"""The latest row of each entity, kept up to date by a stream of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import upsert_latest


@dataclass(frozen=True)
class OnlineStore:
    """A table of one row for each key, in ``buckets`` by the key's hash below ``root``.

    A batch of changes rewrites only the buckets that it has keys of: it reads their rows as the batch before left them, merges,
    and writes them below its own id, with a list of which batch has each bucket's rows. Nothing is changed in place, so a batch
    that is run again, after a crash at any point or a lost checkpoint, starts from the same rows and leaves the same ones.
    """

    root: str
    key: tuple[str, ...]
    ts: str
    buckets: int = 64

    def _parts(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """Which batch has the rows of each bucket, as the batches up to ``batch_id`` left it; a number for each bucket."""
        if batch_id < 0:
            return {}
        try:
            return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{self.root}/parts/batch={batch_id}").collect()}
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self._parts(spark, batch_id - 1)
            raise

    def _rows(self, spark: SparkSession, parts: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.root}/rows/batch={batch}/bucket={bucket}" for bucket, batch in sorted(parts.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, batch_id: int) -> None:
        """Merge a batch; a row is kept if it is the latest of its key by time, then by its other columns."""
        spark = changes.sparkSession
        parts = self._parts(spark, batch_id - 1)
        touched = [r[0] for r in changes.select(self._bucket()).distinct().collect()]  # at most one for each bucket
        if touched:
            before = self._rows(spark, {b: parts[b] for b in touched if b in parts}, changes.schema)
            latest = upsert_latest(before, changes, self.key, self.ts).withColumn("bucket", self._bucket())
            latest.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/batch={batch_id}")
        parts |= dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(parts.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/parts/batch={batch_id}")

    def read(self, spark: SparkSession, schema, batch_id: int) -> DataFrame:
        """The rows as the batch left them."""
        return self._rows(spark, self._parts(spark, batch_id), schema)

    def start(self, changes: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """Merge a stream of changes until all present input is done, or by the given trigger."""
        writer = changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
