"""SimHash near-duplicates: fingerprints, their exact neighbours, and components.

``simhash_classes`` links fingerprints that differ in at most three bits (vantage.py).

``near_duplicate_classes`` is for a similarity of texts: two texts belong together if the
Jaccard similarity of their sets of five-word shingles is 0.8 or more. At that similarity
64-bit SimHashes differ in 3 to 14 bits, a radius at which the triangle bound prunes nothing,
so SimHash neighbours alone would miss most pairs. Its candidates are therefore the SimHash
neighbours and, beside them, texts that share a band of MinHash values if the MinHash estimate
of the similarity, with slack, allows it. Within each component of the candidates all pairs
that the estimate allows are then decided by the exact similarity of their shingle sets.

Crowds, of a band or of a component of the candidates, are cut into parts of about ``CELL_MOST``
texts. Each part is first compared within itself and with the crowd's smallest text, which joins
most of a group of near copies at a cost in proportion to its size; only texts that this leaves
apart from the smallest are then compared with all parts, in cells of two parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shuffle_partitions, spread_join, steps, written
from .components import components
from .fingerprints import bin_minima, low_bits
from .shingles import hash_words, simhash, words_of
from .vantage import links_within

FINGERPRINT_WORDS = 3
RADIUS = 3

WORDS = 5
SIMILARITY = 0.8
SKETCH_BINS = 256
SKETCH_BITS = 16
BANDS, ROWS = 20, 5
#: Four standard errors of the estimate at SIMILARITY: (0.8 * 0.2 / 256) ** 0.5 * 4.
SLACK = 0.1
CELL_MOST = 512
#: Shingles of a part whose sets are compared, which bounds a cell's memory for long texts.
CELL_SHINGLES = 1 << 20


def fingerprints(docs: DataFrame, words: int = FINGERPRINT_WORDS) -> DataFrame:
    """(doc_id, word): the SimHash of every whole text, as a signed 64-bit word; a row for each row, repeated or not.

    A bit of which exactly half of the hashes are set is 0.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = np.array([simhash(hash_words(words_of(t), words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "word"])

    return id_and_text(docs).mapInArrow(compute, "doc_id long, word long")


def simhash_classes(docs: DataFrame, words: int = FINGERPRINT_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents reachable over fingerprints within ``radius`` share a component.

    Texts without words have fingerprint zero and are linked like any other. Rows of a null
    doc_id have a fingerprint, but link nobody: their component_id is that of their
    fingerprint's other documents, or null. Repeated rows repeat in the result. Equal
    fingerprints are one node, so copies, however many, make no pairs.
    """
    own = written(fingerprints(docs, words), "simhash")  # a word, such as the empty text's, may be most rows'
    nodes = written(own.filter("doc_id IS NOT NULL").groupBy("word").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = components(links_within(nodes, radius)).withColumnRenamed("a", "id").withColumnRenamed("b", "root")
    classes = nodes.join(roots, "id", "left").select("word", F.coalesce("root", "id").alias("component_id"))
    return spread_join(own, written(classes, "simhash-classes"), "word", "left").select("doc_id", F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the words, simhash, sketch, shingles): of equal digests the words are equal."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            digests, simhashes, sketches, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hashes = hash_words(words, WORDS)
                digests.append(_digest(words))
                counts.append(len(hashes))
                simhashes.append(simhash(hashes))
                sketches.append(low_bits(bin_minima(hashes, SKETCH_BINS), SKETCH_BITS).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(np.array(simhashes, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(counts, pa.int64())],
                names=["doc_id", "digest", "word", "sketch", "shingles"],
            )

    return id_and_text(docs).filter("doc_id IS NOT NULL").mapInArrow(compute, "doc_id long, digest binary, word long, sketch binary, shingles long")


def _estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    chance = 2.0**-SKETCH_BITS
    return ((many == one).mean(axis=1) - chance) / (1 - chance)


def _others(first: np.ndarray, i: int, second: np.ndarray) -> np.ndarray:
    """The rows that row ``i`` of the ``first`` part is compared with: the other part, or later ones if there is none."""
    return second if len(second) else np.arange(i + 1, len(first))


def _labels(classes: np.ndarray) -> np.ndarray:
    """For each row the first row of its class."""
    _, at, back = np.unique(classes, return_index=True, return_inverse=True)
    return at[back]


def similar_links(ids: np.ndarray, sketches: np.ndarray, first: np.ndarray, classes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what the pairs of an estimate of ``least`` or more connect.

    Rows of the ``first`` part are compared with those of the other part, or with each other if there is no other.
    A pair is compared only while its rows are in different classes, of which ``classes`` are known from
    before: comparing it later cannot change the classes. So a crowd of copies costs about its size, not its square.
    """
    label, second = _labels(classes), np.flatnonzero(~first)
    for i in np.flatnonzero(first).tolist():
        rest = _others(first, i, second)
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            near = part[_estimate(sketches[i], sketches[part]) >= least]
            if len(near):
                joined = np.unique(np.append(label[near], label[i]))
                label[np.isin(label, joined)] = joined[0]
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _linked(members: DataFrame, crowd: Column, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links of the members of each group that ``compare`` finds in cells of (group, x, y), in two passes.

    ``members``: a written table of (group, root, id, part, parts, ...), where ``root`` is the group's smallest id. ``compare`` sees
    them with x, y, ``first`` (of which part a row is) and ``class`` (rows of one class need no comparison).
    """
    everywhere = F.when(F.col("id") == F.col("root"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    cells = members.withColumn("x", F.explode(everywhere)).withColumns({"y": F.col("x"), "first": F.lit(True), "class": F.col("id")})
    near = written(compare(cells), "near-links")
    if not members.filter("parts > 1").limit(1).count():
        return near
    classes = components(near).withColumnRenamed("a", "id").withColumnRenamed("b", "class")
    crowded = written(members.filter("parts > 1").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")), "crowded")
    roots = crowded.filter("id = root").select("group", F.col("class").alias("root_class")).distinct()
    crowded = written(spread_join(crowded, written(roots, "roots"), "group"), "crowded-roots")
    open_parts = crowded.filter("class <> root_class").groupBy("group").agg(F.ceil(crowd).cast("int").alias("open_parts"))
    crowded = spread_join(crowded, written(open_parts, "open"), "group")
    open_part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("open_parts")).cast("int")
    first = crowded.filter("class <> root_class").withColumns({"x": open_part, "first": F.lit(True)}).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    second = crowded.withColumns({"y": F.col("part"), "first": F.lit(False)}).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("open_parts") - 1)))
    return near.unionByName(compare(first.unionByName(second)))


def _bands(sketches: DataFrame) -> DataFrame:
    """(group, root, id, part, parts): the texts of each band that several share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, SKETCH_BINS)
            for band in range(BANDS):
                key = np.full(len(rows), band + 1, np.uint64)
                with np.errstate(over="ignore"):
                    for value in rows[:, band * ROWS : (band + 1) * ROWS].T:
                        key = (key ^ value) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64))], names=["id", "group"])

    bands = written(sketches.select("id", "sketch").mapInArrow(cut, "id long, group long"), "bands")
    sizes = bands.groupBy("group").agg(F.count("*").alias("n"), F.min("id").alias("root")).filter("n > 1")
    shared = written(sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(0.75 * CELL_MOST)).cast("int")), "shared-bands")
    members = spread_join(bands, shared.drop("n"), "group", counts=shared.select("group", F.col("n").alias("_n")))
    return members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def _band_links(sketches: DataFrame, least: float) -> DataFrame:
    """Links of texts that share a band and whose estimate is ``least`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            if len(rows) > 1:
                ids, first, known, data = zip(*rows, strict=True)
                sketch = np.frombuffer(b"".join(data), np.uint16).reshape(len(rows), SKETCH_BINS)
                a, b = similar_links(np.array(ids), sketch, np.array(first), np.array(known), least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def compared(cells: DataFrame) -> DataFrame:
        with_sketch = cells.select("group", "x", "y", "id", "first", "class").join(sketches.select("id", "sketch"), "id")
        return _dealt(with_sketch, "id", "first", "class", "sketch").mapInArrow(compare, "a long, b long").filter("a <> b").distinct()

    return _linked(written(_bands(sketches), "band-members"), F.count("*") / F.lit(0.75 * CELL_MOST), compared)


def _dealt(cells: DataFrame, *columns: str) -> DataFrame:
    key = ["group", "x", "y"]
    return cells.select(*key, *columns).repartition(shuffle_partitions(cells.sparkSession), *key).sortWithinPartitions(*key)


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows, without their first ``n_keys`` columns, of each stretch of equal keys."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != row[:n_keys]:
                yield rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    yield rows


def _simhash_links(sketches: DataFrame) -> DataFrame:
    """Links that connect the neighbours by SimHash; texts of an equal SimHash hang on their first.

    They are bent to stars, so nothing may be decided by the two ends of such a link.
    """
    nodes = written(sketches.groupBy("word").agg(F.min("id").alias("id")), "words")
    same = spread_join(sketches.select("id", "word"), nodes.withColumnRenamed("id", "b"), "word").filter("id <> b").select(F.col("id").alias("a"), "b")
    return links_within(nodes, RADIUS).distinct().unionByName(same)


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, digest, found): the distinct shingle hashes of each row's text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            found = pa.array([np.unique(hash_words(w, WORDS)).tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, words), pa.binary()), found], names=["id", "digest", "found"])

    return docs.mapInArrow(compute, "id long, digest binary, found binary")


def exact_links(ids: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], first: np.ndarray, classes: np.ndarray, least: float, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what the pairs of an exact Jaccard ``similarity`` or more connect.

    As ``similar_links``, but pairs whose estimate reaches ``least`` are decided by their ``sets``.
    """
    size, label = np.array([len(s) for s in sets]), _labels(classes)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, ends = flat.astype(np.int32), np.cumsum(size)
    own = [flat[end - n : end] for n, end in zip(size.tolist(), ends.tolist(), strict=True)]
    marked, second = np.zeros(len(values), bool), np.flatnonzero(~first)
    for i in np.flatnonzero(first & (size > 0)).tolist():
        rest = _others(first, i, second)
        marked[own[i]] = True
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            part = part[(label[part] != label[i]) & (np.minimum(size[part], size[i]) / np.maximum(size[part], size[i]) >= similarity)]
            if len(part):
                part = part[_estimate(sketches[i], sketches[part]) >= least]
            if not len(part):
                continue
            starts = np.cumsum(size[part]) - size[part]
            both = np.add.reduceat(marked[np.concatenate([own[j] for j in part])], starts, dtype=np.int64)
            near = part[both / (size[part] + size[i] - both) >= similarity]
            if len(near):
                joined = np.unique(np.append(label[near], label[i]))
                label[np.isin(label, joined)] = joined[0]
        marked[own[i]] = False
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _exact_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, least: float, similarity: float) -> DataFrame:
    """Links of the pairs at ``similarity`` or more within each component of the ``candidates``."""
    found = components(candidates)
    members = found.unionByName(found.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("id"), F.col("b").alias("group"))
    placed = written(members.join(nodes.select("id", "digest", "sketch", "shingles"), "id"), "candidates")
    crowd = F.greatest(F.count("*") / F.lit(0.75 * CELL_MOST), F.sum("shingles") / CELL_SHINGLES)
    parts = written(placed.groupBy("group").agg(F.ceil(crowd).cast("int").alias("parts"), F.count("*").alias("n")), "crowds")
    placed = spread_join(placed, parts.drop("n"), "group", counts=parts.select("group", F.col("n").alias("_n")))
    placed = placed.withColumns({"root": F.col("group"), "part": F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")})
    texts = id_and_text(docs).withColumnRenamed("doc_id", "id").join(members.select("id"), "id", "left_semi")
    placed = written(placed.join(_shingle_sets(texts).dropDuplicates(["id", "digest"]), ["id", "digest"]), "candidate-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            if len(rows) > 1:
                ids, first, known, data, sets = zip(*rows, strict=True)
                sketch = np.frombuffer(b"".join(data), np.uint16).reshape(len(rows), SKETCH_BINS)
                a, b = exact_links(np.array(ids), sketch, [np.frombuffer(x, np.uint64) for x in sets], np.array(first), np.array(known), least, similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def compared(cells: DataFrame) -> DataFrame:
        return _dealt(cells, "id", "first", "class", "sketch", "found").mapInArrow(compare, "a long, b long").filter("a <> b").distinct()

    return _linked(placed, crowd, compared)


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of each row with a doc_id: near copies share the smallest doc_id among them."""
    own = written(_sketches(docs), "sketches")
    nodes = own.groupBy("digest").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("word", "sketch", "shingles")))
    nodes = written(nodes, "sketch-nodes")
    least = similarity - SLACK
    candidates = _band_links(nodes, least).unionByName(_simhash_links(nodes))
    roots = components(_exact_links(docs, nodes, candidates, least, similarity)).withColumnRenamed("a", "id").withColumnRenamed("b", "root")
    classes = nodes.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    return spread_join(own.select("doc_id", "digest"), written(classes, "near-classes"), "digest").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that are not the smallest doc_id of their class of near copies; rows of a null doc_id stay.

    A null or empty text is like any other empty text. Of equal texts, and of classes, the smallest doc_id stays. Of rows that repeat a doc_id all stay if that id does.
    """
    gone = near_duplicate_classes(docs, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
