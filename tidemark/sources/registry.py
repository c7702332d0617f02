"""Schemas of messages by id, and framed messages: a zero byte, the schema's id in four bytes, the Avro record."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import from_avro_json
from . import avro
from .tables import TableIO

MAGIC = 0
HEADER = 5


@dataclass(frozen=True)
class SchemaRegistry:
    """A table of (schema_id, subject, version, schema): a few rows, read by the driver."""

    table: TableIO

    def _rows(self, spark: SparkSession) -> list:
        try:
            return self.table.read(spark, "schema_id int, subject string, version int, schema string").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def register(self, spark: SparkSession, subject: str, schema: str) -> int:
        """The schema's id. One that any subject has keeps its id; a new version must be readable by the one before, and it by the new one."""
        schema = json.dumps(json.loads(schema), sort_keys=True)
        rows = self._rows(spark)
        known = next((r.schema_id for r in rows if r.schema == schema), None)
        own = sorted((r for r in rows if r.subject == subject), key=lambda r: r.version)
        if any(r.schema == schema for r in own):
            return known
        if own:
            avro.reader(own[-1].schema, schema)
            avro.reader(schema, own[-1].schema)
        found = known or max((r.schema_id for r in rows), default=0) + 1
        self.table.append(spark.createDataFrame([(found, subject, len(own) + 1, schema)], "schema_id int, subject string, version int, schema string"))
        return found

    def schemas(self, spark: SparkSession) -> dict[int, str]:
        return {r.schema_id: r.schema for r in self._rows(spark)}

    def latest(self, spark: SparkSession, subject: str) -> tuple[int, str]:
        rows = [r for r in self._rows(spark) if r.subject == subject]
        if not rows:
            raise KeyError(f"no schema of {subject!r}")
        last = max(rows, key=lambda r: r.version)
        return last.schema_id, last.schema


def framed(events: DataFrame, schema_id: int, schema: str, key: str = "user_id") -> DataFrame:
    """(key, value) messages of the events' columns that the schema has. A value that does not fit the schema fails the job."""
    names = [f["name"] for f in json.loads(schema)["fields"]]
    header = bytes([MAGIC]) + schema_id.to_bytes(4, "big")
    present = [n for n in names if n in events.columns]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = avro.writer(schema)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True) if present else ([()] * batch.num_rows)
            values = [header + encode(dict(zip(present, row, strict=True))) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["key", "value"])

    return events.select(F.col(key).cast("string").alias("key"), *present).mapInArrow(write, "key string, value binary")


def _header(value: Column) -> tuple[Column, Column]:
    """The schema id of a message, and what is wrong with its frame."""
    number = lambda at, size: F.conv(F.hex(F.substring(value, at, size)), 16, 10).cast("int")
    short = value.isNull() | (F.octet_length(value) < HEADER)
    bad = F.when(short, "Short message").when(number(1, 1) != MAGIC, "Bad magic byte")
    return F.when(bad.isNull(), F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")), bad


def unframed(messages: DataFrame, schemas: dict[int, str], wanted: str, value: str = "value") -> DataFrame:
    """The records of framed messages by the schema ``wanted``, with the other columns of ``messages``, ``schema_id`` and ``error``.

    Each message is read by the schema that its id names, whichever version that is. A message that is short, has another
    first byte, names no known schema or is no record of it, has an error and no record; its ``value`` is kept there, so
    that it can be sent again. Frames are checked by column expressions; one narrow pass reads the records.
    """
    fields = from_avro_json(wanted)
    others = [c for c in messages.columns if c != value]
    if clash := sorted({*others, "schema_id", "error"} & set(fields.fieldNames())):
        raise ValueError(f"columns of both the messages and the records: {', '.join(clash)}")
    schema_id, wrong = _header(F.col(value))
    marked = messages.select(*others, schema_id.alias("schema_id"), wrong.alias("error"), F.col(value).alias("value"))
    n = len(others)
    nullable = fields.simpleString()[len("struct<") : -1].replace(":", " ")
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in marked.select(*others, "schema_id").schema) + f"error string, value binary, {nullable}"
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {i: avro.reader(s, wanted) for i, s in schemas.items()}
        nothing = [None] * len(fields)
        for batch in batches:
            ids, errors, values = (batch.column(n + i).to_pylist() for i in range(3))
            rows = []
            for i, (schema, error, data) in enumerate(zip(ids, errors, values, strict=True)):
                row = nothing
                if error is None:
                    try:
                        if schema not in readers:
                            raise avro.BadRecord(f"Unknown schema {schema}")
                        row, values[i] = readers[schema](data[HEADER:]), None
                    except avro.BadRecord as e:
                        errors[i] = str(e) if schema not in readers else f"Bad record: {e}"
                rows.append(row)
            columns = [pa.array([r[j] for r in rows], kinds[f.dataType.simpleString()]) for j, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(errors, pa.string()), pa.array(values, pa.binary()), *columns], names=[*others, "schema_id", "error", "value", *fields.fieldNames()])

    return marked.mapInArrow(read, out)
