"""Token ids as flat binary shards that can be memory-mapped.

A shard is one file, little-endian throughout::

    ids            t unsigned integers, padded to a multiple of 8 bytes
    int64[d + 1]   where each document's ids start; the last is t
    int64[d]       document ids (the smallest int64 for null)
    int64[3]       d, t, and the width of an id in bytes (2 or 4)
    8 bytes        TOKSHRD1

Shards are ranges of document ids in ascending order; a manifest row holds each shard's
counts, and the place of a shard in the whole is the prefix sum of the counts before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, opened, shared_path, shuffle_partitions, steps

MAGIC = b"TOKSHRD1"
FOOT = 32
#: Ids that are read from a file at once, but for a longer document.
READ_IDS = 1 << 21
NULL_ID = np.iinfo(np.int64).min
MANIFEST = "shard int, path string, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str, cut: str, end_id: int, width: int = 2) -> DataFrame:
    """Encode ``docs`` into shards below ``folder``, ascending by doc_id; the manifest, a row for each shard.

    Rows are dealt by ranges of (doc_id, hash of text, place in the input), so equal ids or rows,
    however many, are still spread. Each attempt of a task writes a file of its own name, and the manifest names those of the attempts that
    were done; so a task can run again after any loss, on stores that replace no file, too.
    """
    spark = docs.sparkSession
    kind = {2: "<u2", 4: "<u4"}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), tokens.encoder(vocabulary, cut)
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        lengths, doc_ids, total = [], [], 0
        with store.open_output_stream(path) as out:
            for batch in steps(batches):
                ids, places = encoder.encode(batch.column(1))
                n = np.diff(places) + 1
                ends = np.cumsum(n)
                full = np.empty(len(ids) + len(n), dtype=kind)
                last = np.zeros(len(full), dtype=bool)
                last[ends - 1] = True
                full[last], full[~last] = end_id, ids
                out.write(full.tobytes())
                total += len(full)
                lengths.append(n)
                doc_ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            out.write(bytes(-total * width % 8))
            n = np.concatenate([[0], *lengths]).astype("<i8")
            out.write(np.cumsum(n).astype("<i8").tobytes())
            for part in doc_ids:
                out.write(part.tobytes())
            n_docs = len(n) - 1
            out.write(np.array([n_docs, total, width], dtype="<i8").tobytes() + MAGIC)
        if not n_docs:
            store.delete_file(path)
            return
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": pa.array([total], pa.int64())})

    dealt = id_and_text(docs).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    n = shuffle_partitions(spark)
    return dealt.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(write, MANIFEST)


class Shard:
    """A shard: ``offsets`` and ``doc_ids`` of any range of documents, and the ids of any document.

    A local file is mapped into memory. Of a store without mapping only the ranges that are asked for are read.
    """

    def __init__(self, path: str, folder: str):
        store, _ = opened(folder)
        if isinstance(store, fs.LocalFileSystem):
            self._data = np.memmap(path, dtype=np.uint8, mode="r")
            size, self._at = len(self._data), lambda start, n: self._data[start : start + n]
        else:
            self._file = store.open_input_file(path)
            size, self._at = self._file.size(), lambda start, n: np.frombuffer(self._file.read_at(n, start), np.uint8)
        foot = self._at(size - FOOT, FOOT)
        if bytes(foot[-8:]) != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.n_docs, self.n_ids, self.width = foot[:-8].view("<i8").tolist()
        self._offsets = self.n_ids * self.width + -self.n_ids * self.width % 8

    def offsets(self, a: int, b: int) -> np.ndarray:
        return self._at(self._offsets + 8 * a, 8 * (b - a)).view("<i8")

    def doc_ids(self, a: int, b: int) -> np.ndarray:
        return self._at(self._offsets + 8 * (self.n_docs + 1 + a), 8 * (b - a)).view("<i8")

    def ids(self, start: int, end: int) -> np.ndarray:
        return self._at(start * self.width, (end - start) * self.width).view(f"<u{self.width}")

    def documents(self, ends: np.ndarray) -> Iterator[np.ndarray]:
        """The ids between each two of ``ends``, read about ``READ_IDS`` at a time."""
        a = 0
        while a < len(ends) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + READ_IDS, side="right")) - 1)
            ids = self.ids(int(ends[a]), int(ends[b]))
            yield from np.split(ids, ends[a + 1 : b] - ends[a])
            a = b

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.offsets(i, i + 2).tolist())


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document, from the files: place in the whole, number of ids, CRC-32 of the ids.

    The manifest has a row for each shard, so its prefix sums are made on the driver.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.path, base))
        base += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], folder)
                for at in range(0, shard.n_docs, 4096):
                    upto = min(at + 4096, shard.n_docs)
                    ends = shard.offsets(at, upto + 1)
                    sums = [zlib.crc32(ids.astype("<u4")) for ids in shard.documents(ends)]
                    doc_ids = np.array(shard.doc_ids(at, upto))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = spark.createDataFrame(rows, "shard int, path string, base long")
    return shards.repartitionByRange(max(1, min(len(rows), shuffle_partitions(spark))), "shard").mapInArrow(read, RESULT)


def keep_named(manifest: DataFrame, folder: str) -> None:
    """Delete what attempts that were not the last left in ``folder``: files that the manifest does not name."""
    store, root = opened(folder)
    named = {r.path.rsplit("/", 1)[1] for r in manifest.collect()}  # a row for each shard
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name not in named:
            store.delete_file(info.path)


def tokenize_to_files(docs: DataFrame, vocabulary: str, cut: str = "white", end_id: int = 1, width: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return what they hold.

    A null or empty text has the end id alone. Rows of a null doc_id come first. Equal ids
    keep separate rows, ordered by a hash of their text. An empty table makes no shard.
    """
    folder = shared_path(docs.sparkSession, "token-files")
    manifest = docs.sparkSession.createDataFrame(write_shards(docs, folder, vocabulary, cut, end_id, width).collect(), MANIFEST)
    keep_named(manifest, folder)
    return read_shards(manifest, folder)
