"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for test phrases.

Words of the benchmark get numbers; any other word of the corpus is one symbol that no phrase
has. Runs of benchmark words too short for the shortest phrase cannot hold one, so a shard's
index covers the longer runs only, with a separator between them: it finds exactly what an
index of the whole shard finds, at a fraction of its size. All phrases are searched backwards
at once, occurrences are located by sampled suffixes, and overlapping ones are merged.

Executors turn the benchmark into blocks of phrases, of about ``BLOCK_CHARS`` characters of text
each, and write them to the shared folder. Every shard of the corpus, a step of a few megabytes of
text, is searched for one block after the other; a worker holds at most ``HELD_BYTES`` of blocks.
So a benchmark of any size is searched whole in one pass over the corpus, and neither the driver
nor a broadcast holds phrases.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, opened, shared_path, steps
from .fmindex import FMIndex

WINDOW = 10
BLOCK_CHARS = 4 << 20
HELD_BYTES = 256 << 20

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of words to themselves in lower case, all others to a blank.
_FOLD = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def words_of(text: str | None) -> list[str]:
    folded = _FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    return [w.decode() for w in _WORD.findall(folded)]


@dataclass
class Phrases:
    """The distinct windows of some benchmark items, by length, and which items have them."""

    vocabulary: pa.Array
    windows: list[np.ndarray]  # a matrix for each length, the shortest first; symbols from 2
    bounds: np.ndarray  # of each window, counted over all lengths, in ``owners``
    owners: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        words, places = corpus_words(pa.array([t or "" for _, t in items], pa.string()))
        coded = words.dictionary_encode()
        symbols = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 2
        names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: i for i, name in enumerate(names)}
        owner = np.array([-1 if i is None else number[str(i)] for i, _ in items], np.int64)
        count = np.diff(places)
        windows, pairs, before = [], [np.empty((0, 2), np.int64)], 0
        for size in sorted(set(np.minimum(count, window).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(count, window) == size)
            n = count[own] - size + 1
            starts = np.repeat(places[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found, at = np.unique(symbols[starts[:, None] + np.arange(size)], axis=0, return_inverse=True)
            windows.append(found)
            pairs.append(np.unique(np.stack([at.ravel() + before, np.repeat(owner[own], n)], axis=1), axis=0))
            before += len(found)
        pairs = np.concatenate(pairs)
        pairs = pairs[pairs[:, 1] >= 0]
        return cls(coded.dictionary, windows, np.searchsorted(pairs[:, 0], np.arange(before + 1)), pairs[:, 1].astype(np.int32), names)

    @property
    def shortest(self) -> int:
        return self.windows[0].shape[1] if self.windows else 0

    @property
    def size(self) -> int:
        return self.vocabulary.nbytes + sum(w.nbytes for w in self.windows) + self.bounds.nbytes + self.owners.nbytes


def write_blocks(benchmark: DataFrame, window: int, block_chars: int) -> tuple[str, list[str]]:
    """The phrases of the distinct rows of ``benchmark`` as files below the shared folder: the folder, and a path for each block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n_blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    folder = shared_path(benchmark.sparkSession, "phrases")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block").sortWithinPartitions("block")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[int, list[tuple]]]:
            now, rows = None, []
            for batch in batches:
                for item_id, text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block != now and rows:
                        yield now, rows
                        rows = []
                    now = block
                    rows.append((item_id, text))
            if rows:
                yield now, rows

        store, root = opened(folder)
        for block, rows in blocks():
            store.create_dir(root, recursive=True)
            temporary, path = f"{root}/.{block:06d}-{uuid.uuid4().hex}", f"{root}/{block:06d}.phrases"
            with store.open_output_stream(temporary) as out:
                out.write(pickle.dumps(Phrases.of(rows, window), protocol=5))
            store.move(temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return folder, sorted(r.path for r in dealt.mapInArrow(write, "path string").collect())


_held: dict[str, Phrases] = {}


def read_blocks(folder: str, paths: list[str]) -> Iterator[Phrases]:
    """The blocks one after the other; this worker keeps those read last, within ``HELD_BYTES``."""
    for path in paths:
        if path not in _held:
            store, _ = opened(folder)
            with store.open_input_stream(path) as source:
                block = pickle.loads(source.read())
            while _held and sum(b.size for b in _held.values()) + block.size > HELD_BYTES:
                _held.pop(next(iter(_held)))
            _held[path] = block
        yield _held[path]


def corpus_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column without nulls, and the n + 1 places between texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(_FOLD[data])])
    lists = pc.ascii_split_whitespace(folded)
    parts = lists.flatten()
    real = pc.not_equal(pc.binary_length(parts), 0)
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    bounds = lists.offsets.to_numpy()
    return parts.filter(real), ends[bounds - bounds[0]]


def occurrences(words: pa.Array, places: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each phrase occurs: first word, word after the last, and which window it is."""
    nothing = (np.empty(0, np.int64),) * 3
    if not phrases.shortest or not len(words):
        return nothing
    symbols = pc.fill_null(pc.index_in(words, phrases.vocabulary), -1).to_numpy().astype(np.int64) + 2  # 1: no word of the benchmark
    # Runs end at other words and where a text ends.
    known = symbols > 1
    breaks = np.zeros(len(symbols) + 1, bool)
    breaks[places] = True
    starts = np.flatnonzero(known & (breaks[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = ends - starts >= phrases.shortest
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return nothing
    # The kept runs one after the other, each followed by a separator, which stands for the word after the run.
    sizes = sizes + 1
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[np.cumsum(sizes) - 1] = 1
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    first, after, which, before = [], [], [], 0
    for windows in phrases.windows:
        low, high = index.search(windows.astype(np.int64))
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = place[index.locate(rows)]
        first.append(at)
        after.append(at + windows.shape[1])
        which.append(np.repeat(np.arange(before, before + len(n)), n))
        before += len(n)
    return np.concatenate(first), np.concatenate(after), np.concatenate(which)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of the ranges, as ascending ranges that do not overlap."""
    out: list[list[int]] = []
    for start, end in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _find(texts: pa.Array, blocks: Iterator[Phrases]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, set[str]]]]:
    """Number of words of each text; its occurrences in words of the text, and their items."""
    words, places = corpus_words(texts)
    first, after, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)], {}
    for phrases in blocks:
        start, end, which = occurrences(words, places, phrases)
        first.append(start)
        after.append(end)
        n = phrases.bounds[which + 1] - phrases.bounds[which]
        owner = phrases.owners[np.repeat(phrases.bounds[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        doc = np.repeat(np.searchsorted(places, start, side="right") - 1, n)
        for d, i in np.unique(np.stack([doc, owner], axis=1), axis=0).tolist():
            items.setdefault(d, set()).add(phrases.items[i])
    first, after = np.concatenate(first), np.concatenate(after)
    doc = np.searchsorted(places, first, side="right") - 1
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    found = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own = order[a:b]
        found.append((first[own] - places[i], after[own] - places[i], items.get(i, set())))
    return np.diff(places), found


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: words, words hit, items with occurring windows, and the hit spans in words.

    A null or empty text has no words; an item without words has no window. Repeated items count
    once, by item_id; an item without item_id hits words but is not counted. An empty benchmark
    contaminates nothing. One stage over the documents, without a shuffle.
    """
    folder, paths = write_blocks(benchmark, window, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            n_words, found = _find(batch.column(1), read_blocks(folder, paths))
            ranges = [merged(s, e) for s, e, _ in found]
            n_hit = [sum(b - a for a, b in own) for own in ranges]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words.astype(np.int64)),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(i) for *_, i in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for *_, i in found], pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                    pa.array([",".join(f"{a}:{b}" for a, b in own) for own in ranges], pa.string()),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return id_and_text(docs).mapInArrow(run, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; rows of a null text stay."""
    schema, at = docs.schema, docs.columns.index("text")
    folder, paths = write_blocks(benchmark, window, block_chars)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words, places = corpus_words(pc.fill_null(batch.column(at), ""))
            hit = np.zeros(batch.num_rows, bool)
            for phrases in read_blocks(folder, paths):
                first, _, _ = occurrences(words, places, phrases)
                hit[np.searchsorted(places, first, side="right") - 1] = True
            yield batch.filter(pa.array(~hit))

    return docs.mapInArrow(keep, schema)
