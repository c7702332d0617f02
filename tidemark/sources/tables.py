"""Tables on files: append, idempotent overwrite of partitions, upsert, incremental reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader


@dataclass(frozen=True)
class TableIO:
    """A table of one format. ``parquet`` is built in; ``delta`` or others work where installed."""

    path: str
    format: str = "parquet"
    partition_by: tuple[str, ...] = ()

    def append(self, df: DataFrame) -> int:
        """Add rows and return their number; an empty input writes nothing. Failed tasks are retried by Spark."""
        if df.isEmpty():
            return 0
        rows = Observation()
        self._writer(df.observe(rows, F.count(F.lit(1)).alias("n")), "append").save(self.path)
        return int(rows.get["n"])

    def overwrite_partitions(self, df: DataFrame) -> None:
        """Replace exactly the partitions that ``df`` has rows of, so that a rerun does not repeat them."""
        self._writer(df, "overwrite").option("partitionOverwriteMode", "dynamic").save(self.path)

    def _writer(self, df: DataFrame, mode: str):
        writer = df.write.format(self.format).mode(mode)
        return writer.partitionBy(*self.partition_by) if self.partition_by else writer

    def read(self, spark: SparkSession, schema=None) -> DataFrame:
        """The table, lazily: filters and columns are pushed down, partitions are pruned."""
        reader = spark.read.format(self.format)
        return (reader.schema(schema) if schema else reader).load(self.path)

    def stream(self, spark: SparkSession, schema, max_files: int | None = None) -> DataFrame:
        """New files since the checkpoint of the query that reads it."""
        reader: DataStreamReader = spark.readStream.format(self.format).schema(schema)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(self.path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one of a local session where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a scratch folder: cuts the lineage and outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tenant_table(root: str, tenant: str) -> TableIO:
    """The raw table of a tenant: one table, partitioned by tenant and date."""
    if not tenant or "/" in tenant:
        raise ValueError(f"not a tenant: {tenant!r}")
    return TableIO(root, partition_by=("tenant", "ingestion_date"))


def upsert_latest(current: DataFrame, changes: DataFrame, key: tuple[str, ...], ts: str) -> DataFrame:
    """``current`` with the latest row of each key from both sides, by time, then by the other columns."""
    both = current.unionByName(changes.select(current.columns))
    rest = [c for c in current.columns if c not in key]
    row = F.struct(ts, *(c for c in rest if c != ts))
    latest = both.groupBy(*key).agg(F.max(row).alias("row"))
    return latest.select(*(F.col(c) if c in key else F.col(f"row.{c}").alias(c) for c in current.columns))
