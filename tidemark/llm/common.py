"""What the corpus operators share: reading, tables in the shared folder, Arrow batches.

Conventions that hold for every operator here:

* a null text counts as the empty text; whole texts are processed, however long;
* only the named columns are read, so extra columns (also with clashing names) do no harm;
* repeated rows and equal ids are kept as separate rows;
* an empty table gives an empty result of the declared schema.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step takes at most, unless a single document is longer.
STEP_CHARS = 4 << 20

#: A key of a join's left side is frequent if it has at least one in so many of its rows; so there are no more such keys.
FREQUENT = 1000

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of a local session (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(_own_dirs[app])
            atexit.register(shutil.rmtree, _own_dirs[app].removeprefix("file://"), ignore_errors=True)
        place = _own_dirs[app]
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives any executor. ``options``: of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for found in tables:
        spark, jvm = found.sparkSession, found.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(found._written_to)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder below the shared one, and the folder's path in it, for files that executors write."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has at most one row for each ``key``; null keys match nothing.

    A key may hold any share of ``left``'s rows. Keys with at least 1 / ``FREQUENT`` of them, of which there are
    at most ``FREQUENT``, are broadcast; the rest is shuffled. ``left`` is read twice: give a written table.
    ``counts``: (key, _n), the rows of ``left`` for each key, or for each that may be frequent, if they are known.
    """
    if counts is None:
        counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    least = max(FREQUENT, -(-left.count() // FREQUENT))
    frequent = written(counts.filter(F.col("_n") >= least).select(key, F.lit(True).alias("_frequent")), "frequent")
    if not frequent.count():
        forget(frequent)
        return left.join(right, key, how)
    marked = left.join(F.broadcast(frequent), key, "left")  # at most FREQUENT rows
    theirs = right.join(F.broadcast(frequent), key, "left")
    some = marked.filter("_frequent").drop("_frequent").join(F.broadcast(theirs.filter("_frequent").drop("_frequent")), key, how)
    rest = marked.filter("_frequent IS NULL").drop("_frequent").join(theirs.filter("_frequent IS NULL").drop("_frequent"), key, how)
    return some.unionByName(rest)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each piece (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 1
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers stay, for other stages


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
