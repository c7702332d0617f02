"""Product codes of vectors: each part of a vector is stored as the number of its nearest codebook entry.

Nearest entries are found by annular pruning. An entry at distance d of a vector has a norm within d of the vector's.
So the entries are sorted by norm; a binary search finds the one of the nearest norm, its distance bounds the annulus,
and two more searches give the interval of entries in it. Going outwards, every entry of the interval is evaluated in
exact integers, and each better one narrows the interval. Both ends are inclusive, as an entry at just the best
distance may have the lower index.

The codebooks are learned in rounds over the whole table. A task adds up the parts of each entry in its rows, Spark adds
the tasks' sums, and the driver gets one number for each entry's component: as many as a codebook holds, whatever
the table's size. A round's codebooks go to the tasks with the code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, spread_join, written
from .vectors import as_float, finite, lengths, longs, matrix, scaled, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that one vectorised step takes.
_STEP = 8192
#: Sums travel in digits of this many bits, so that no total of theirs leaves 64 bits.
_DIGIT = 30

CODED = "vec_id long, label string, code string, error long"
SUMS = "part int, entry int, place int, digit int, total long, n long"


class Codebook:
    """Entries of one part, by index, and their order by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = lengths(entries)
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.most = max((abs(int(v)) for v in entries.ravel()), default=0)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, ties to the lower index; entries evaluated in all."""
        n, k = len(parts), len(self.order)
        most = max(self.most, max(abs(int(parts.max())), abs(int(parts.min()))) if parts.size else 0)
        entries = self.entries
        if parts.shape[1] * 4 * most * most >= 1 << 62:  # the exact squares leave 64 bits
            parts, entries = parts.astype(object), entries.astype(object)

        def distance(rows, entry: np.ndarray) -> np.ndarray:
            gap = parts[rows] - entries[entry]
            return (gap * gap).sum(axis=1)

        norm = lengths(parts)
        right = np.searchsorted(self.norms, norm).clip(0, k - 1)
        left = (right - 1).clip(0)
        with np.errstate(invalid="ignore"):
            begin = np.where(norm - self.norms[left] < self.norms[right] - norm, left, right)
        which = self.order[begin].copy()
        best = distance(slice(None), which)
        evaluated = n
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)

        def narrow(rows) -> None:
            reach = np.sqrt(as_float(best[rows])) * (1 + 1e-9) + 1e-9 * (1 + norm[rows])
            reach = np.where(np.isfinite(reach), reach, np.inf)
            with np.errstate(invalid="ignore"):
                low[rows] = np.searchsorted(self.norms, np.where(np.isinf(reach), -np.inf, norm[rows] - reach), "left")
                high[rows] = np.searchsorted(self.norms, np.where(np.isinf(reach), np.inf, norm[rows] + reach), "right")

        narrow(slice(None))
        for step in range(1, k):
            for at in (begin - step, begin + step):
                rows = np.flatnonzero((at >= low) & (at < high))
                if not len(rows):
                    continue
                index = self.order[at[rows]]
                found = distance(rows, index)
                evaluated += len(rows)
                better = (found < best[rows]) | ((found == best[rows]) & (index < which[rows]))
                better = better.astype(bool)
                rows = rows[better]
                best[rows], which[rows] = found[better], index[better]
                narrow(rows)
        return which, best, evaluated


def _cut(x: np.ndarray, part: int) -> np.ndarray:
    width = x.shape[1] // PARTS
    return x[:, part * width : (part + 1) * width]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors as integers; the vectors are the last column."""
    for batch in batches:
        for start in range(0, batch.num_rows, _STEP):
            piece = batch.slice(start, _STEP)
            x = scaled(matrix(piece.column(piece.num_columns - 1)), SCALE)
            if x.shape[1] % PARTS:
                raise ValueError(f"the vectors' length must divide by {PARTS}")
            yield piece, x


def digits(value: int) -> list[int]:
    """``value`` in base 2 ** ``_DIGIT``, lowest first; the highest has the sign."""
    out = []
    while not -(1 << 32) <= value < 1 << 32:
        out.append(value & ((1 << _DIGIT) - 1))
        value >>= _DIGIT
    return [*out, value]


def _learned(kept: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks after one round over ``kept``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.entries.shape, object) for b in books]
        counts = np.zeros((PARTS, len(books[0].entries)), np.int64)
        for _, x in _rows(batches):
            for p, book in enumerate(books):
                parts = _cut(x, p)
                which, _, _ = book.nearest(parts)
                counts[p] += np.bincount(which, minlength=len(book.entries))
                narrow = parts.dtype != object and (not parts.size or np.abs(parts).max() < 1 << 48)
                sums = np.zeros(book.entries.shape, np.int64 if narrow else object)
                np.add.at(sums, which, parts if narrow else parts.astype(object))
                totals[p] = totals[p] + sums.astype(object)
        rows = [(p, e, i, d, v, int(counts[p, e])) for p in range(PARTS) for e in np.flatnonzero(counts[p]).tolist() for i, total in enumerate(totals[p][e].tolist()) for d, v in enumerate(digits(int(total)))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "entry", "place", "digit", "total", "n"])

    sums = kept.select("vec").mapInArrow(add, SUMS).groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    totals: dict[tuple[int, int, int], int] = {}
    counts: dict[tuple[int, int], int] = {}
    for r in sums:
        totals[r.part, r.entry, r.place] = totals.get((r.part, r.entry, r.place), 0) + (r.total << (_DIGIT * r.digit))
        if r.digit == 0:  # every sum has this digit
            counts[r.part, r.entry] = r.n
    out = []
    for p, book in enumerate(books):
        entries = book.entries.astype(object)
        for e in range(len(entries)):
            for i in range(entries.shape[1]):
                if (p, e, i) in totals:
                    entries[e, i] = totals[p, e, i] // counts[p, e]
        out.append(Codebook(_narrowed(entries)))
    return out


def _narrowed(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if all(abs(v) < 1 << 62 for v in entries.ravel().tolist()) else entries


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.entries.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row whose vector is there and finite.

    Rows with a null, NaN or infinite component or no vector are left out; repeated rows are kept. Equal ids start the
    codebooks in the order of their vectors, a null id last; fewer than 16 rows make shorter codebooks. A null label is
    a label. An error beyond 64 bits is null, as is its label's. An empty table gives an empty result. Vectors of
    different lengths, or of one that 8 does not divide, raise an error.
    """
    kept = written(embeddings.filter(finite(embeddings)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), stored(embeddings).alias("vec")), "vectors")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).select("vec").collect()
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    x = np.array([r.vec for r in first], np.float64)
    if x.shape[1] % PARTS:
        raise ValueError(f"the vectors' length must divide by {PARTS}")
    x = scaled(x, SCALE)
    books = [Codebook(_cut(x, p)) for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = _learned(kept, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _rows(batches):
            found = [book.nearest(_cut(x, p)) for p, book in enumerate(books)]
            codes = np.stack([which for which, _, _ in found], axis=1).astype(np.uint8)
            error = sum((best.astype(object) for _, best, _ in found), np.zeros(len(x), object))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes]), longs(error)], names=["vec_id", "label", "code", "error"])

    coded = written(kept.mapInArrow(encode, CODED).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))).drop("label"), "codes")
    forget(kept)
    by_label = coded.groupBy("key").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    return spread_join(coded, by_label, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    width = f"(len(q) // {PARTS})"
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(q, p * {width} + 1, (p + 1) * {width}) AS v FROM kept, range({PARTS}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"near{r} AS MATERIALIZED (SELECT s.vec_id, s.label, s.p, any_value(s.v) AS v, min(list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + b.e) AS k FROM parts s JOIN book{r} b ON s.p = b.p GROUP BY s.vec_id, s.label, s.p)")
        if r < ROUNDS:
            ctes.append(f"mean{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT p, k % {ENTRIES} AS e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e)")
            ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(k % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"""


#: For distinct vec_ids.
ORACLE = _oracle()
