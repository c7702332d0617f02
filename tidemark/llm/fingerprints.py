"""Document fingerprints: one-permutation MinHash, optimal densification, packed low bits.

Each shingle is hashed once. The upper bits of the hash choose one of ``BINS`` bins, the rest
competes for the bin's minimum. An empty bin borrows the value of a bin drawn for it by a
hash of (bin, attempt) until that bin is not empty, which makes each empty bin's loan
independent of its neighbours (optimal densification). Of each bin the ``LOW_BITS`` lowest bits
of a mixed minimum are kept. Two unrelated bins agree by chance in 1 of 2**LOW_BITS cases, so
the share m of agreeing bins gives the likeness (m - c) / (1 - c) with c = 2**-LOW_BITS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shuffle_partitions, steps
from .shingles import hash_words, words_of

WORDS = 5
BINS = 512
LOW_BITS = 4
ATTEMPTS = 32  # of an empty bin that are looked up at once

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that lets every bit depend on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _draws(bins: int, at: int) -> np.ndarray:
    """From which bins each bin borrows, in its attempts ``ATTEMPTS * at`` and following; a row for each attempt."""
    attempts = np.arange(ATTEMPTS * at + 1, ATTEMPTS * (at + 1) + 1, dtype=np.uint64)
    keys = np.arange(bins, dtype=np.uint64)[None, :] * np.uint64(1 << 20) + attempts[:, None]
    return (_mix(keys) % np.uint64(bins)).astype(np.int64)


def bin_minima(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The minimum of each bin, after densification. No shingles: all bins zero."""
    if not len(hashes):
        return np.zeros(bins, np.uint64)
    ordered = np.sort(hashes)  # the bin is in the upper bits, so each bin's first value is its minimum
    bin_of = (ordered >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[bin_of[first]], full[bin_of[first]] = ordered[first], True
    empty, at = np.flatnonzero(~full), 0
    while len(empty):
        draws = _draws(bins, at)[:, empty]
        lends = full[draws]
        found = lends.argmax(axis=0)
        lent = lends[found, np.arange(len(empty))]
        values[empty[lent]] = values[draws[found[lent], np.flatnonzero(lent)]]
        empty, at = empty[~lent], at + 1
    return values


def low_bits(minima: np.ndarray, bits: int = LOW_BITS) -> np.ndarray:
    return (_mix(minima) & np.uint64((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16)


def packed(low: np.ndarray) -> str:
    """Four-bit values as hexadecimal digits, the first bin first."""
    return (low[0::2] << 4 | low[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, bits: int = LOW_BITS) -> float:
    chance = 2.0**-bits
    return float(max(0.0, (np.mean(a == b) - chance) / (1 - chance)))


def fingerprint(text: str) -> np.ndarray:
    return low_bits(bin_minima(hash_words(words_of(text), WORDS)))


def _hashed(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    hashes = hash_words(words_of(text), WORDS)
    return text, hashes, low_bits(bin_minima(hashes))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the text that follows."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _edited_hashes(text: str, edited: str, hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes of ``edited``; those of whole words that it shares at the start are taken from ``hashes``."""
    kept = len(text) - len(text) // 3
    shared = len(words_of(text[:kept])) - 1 - (WORDS - 1)  # shingles before the word that the cut may touch
    if shared < 1 or shared > len(hashes):
        return hash_words(words_of(edited), WORDS)
    words = words_of(edited)
    if len(words) < WORDS + shared:
        return hash_words(words, WORDS)
    return np.concatenate([hashes[:shared], hash_words(words[shared:], WORDS)])


def _compare(rows: Iterator[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
    """Results for (doc_id, text, text that follows), which come so that a text's follower is the next text, as a rule."""
    out: list[list] = [[] for _ in NAMES]
    known: tuple[str, np.ndarray, np.ndarray] | None = None  # the last follower, its hashes and its fingerprint
    for doc_id, text, following in rows:
        _, hashes, own = known if known and known[0] == text else _hashed(text)
        edited = edited_text(text, following)
        other = low_bits(bin_minima(_edited_hashes(text, edited, hashes)))
        known = _hashed(following)
        last = known[2]
        row = (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(other), likeness(own, other), likeness(own, last))
        for column, value in zip(out, row, strict=True):
            column.append(value)
        if len(out[0]) == 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=NAMES)
            out = [[] for _ in NAMES]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=NAMES)


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def with_follower(docs: DataFrame) -> DataFrame:
    """Rows dealt into runs of neighbouring documents, in descending order of (doc_id, hash of text).

    The result has ``run``, ``guest``, ``doc_id`` and ``text``, sorted within partitions so that each row's
    follower is the next row of its run. The first document of a run also stands, as a guest, at
    the end of the run before it (the first of all at the end of the last). Only ids and hashes
    are sorted to find the runs' first documents; texts are shuffled once, to their run.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    keys = rows.select("doc_id", "tie")
    n = max(2, 4 * shuffle_partitions(spark))
    # Cuts between runs: some (doc_id, tie) keys, about evenly spaced by doc_id.
    shares = ", ".join(str(i / n) for i in range(1, n))
    found = keys.agg(F.expr(f"approx_percentile(doc_id, array({shares}), {max(10_000, 10 * n)})").alias("cuts")).first().cuts
    cuts = sorted(set(found or []))
    if not cuts:
        cuts = [0]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    depth = len(cuts).bit_length()
    # Runs count from 0 at the highest ids: binary search for the number of cuts above doc_id.
    below = F.aggregate(
        F.array(*[F.lit(1 << j) for j in reversed(range(depth))]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(cuts)) & (F.element_at(bounds, F.least(at + step, F.lit(len(cuts)))) <= F.col("doc_id")), at + step).otherwise(at),
    )
    with_run = lambda df: df.withColumn("run", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(len(cuts) - below).cast("int"))
    # The first document of each run; at most n rows.
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie")
    heads = [r for r in with_run(keys).groupBy("run").agg(F.max(order).alias("first")).orderBy("run").collect()]
    runs = [r.run for r in heads]
    before = {runs[i]: runs[i - 1] for i in range(len(runs))}  # the first run's goes to the last
    firsts = [(r.first.id, r.first.tie, r.run, before[r.run]) for r in heads]
    guests = spark.createDataFrame(firsts or [(0, 0, 0, 0)], "id long, tie long, run int, to int")
    marked = with_run(rows).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    marked = marked.join(F.broadcast(guests.select("id", "tie", "to")), ["id", "tie"], "left")
    spread = marked.select(
        "doc_id", "tie", "text", "run",
        F.explode(F.when(F.col("to").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array(F.lit(None).cast("int"), "to"))).alias("as_guest"),
    )
    placed = spread.select(F.coalesce("as_guest", "run").alias("run"), F.col("as_guest").isNotNull().alias("guest"), "doc_id", "tie", "text")
    return placed.repartition(n, "run").sortWithinPartitions(F.col("run"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; a row for each document.

    A null or empty text has no shingles and the fingerprint of all zeros' bits, like any
    other such text. Fewer than five words are one shingle. The follower of a document is the
    next in descending order of doc_id; ties are ordered by a hash of the text, a null doc_id
    is lowest, and the last document is followed by the first.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, str, str]]:
            held = None
            for batch in steps(batches):
                for run, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if held is not None and held[0] == run:
                        yield held[1], held[2], text
                    held = None if guest else (run, doc_id, text)

        return _compare(rows())

    return with_follower(docs).select("run", "guest", "doc_id", "text").mapInArrow(compare, RESULT)
