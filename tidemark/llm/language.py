"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of bits. One binary classifier per bit tells, from the n-grams of
a text, which of two groups of languages it belongs to. Decoding sums, over the bits, the
classifier's loss against each codeword, weighted by how well that classifier did on rows that
it was not fitted on; the nearest codeword wins. A text whose two nearest codewords are about
as far is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, steps, written

BUCKETS = 4096
ROWS_PER_LANGUAGE = 250  # the classifiers are fitted on about so many labelled rows of each language
FIT_ROWS = 10_000  # and, where languages are many, on about so many of all, but at least one of each
BITS_PER_LOG = 16  # classifiers for each doubling of the number of languages, at most
RIDGE = 0.05
AMBIGUOUS = 0.6  # a best probability below this is flagged
UNDETERMINED = "und"

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters stay, other ASCII is a blank, bytes of other characters stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed 2-, 3- and 4-byte n-grams of the lower-cased text."""
    data = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)].astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 20):
        part = data[at : at + (1 << 20) + 3]
        code = part[:-1] << 8 | part[1:]
        for size in (2, 3, 4):
            if size > 2:
                if len(code) < 2:
                    break
                code = code[:-1] << 8 | part[size - 1 :]
            bucket = (code * np.uint32(2654435761) + np.uint32(size * 97)) >> np.uint32(20)
            counts += np.bincount(bucket[part[: len(bucket)] + part[1 : len(bucket) + 1] != 64], minlength=BUCKETS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(1e-9, float(np.linalg.norm(x)))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: rows of a simplex code, of which every two differ in half of the bits.

    Language i has a vector of k = log2(n) + 1 bits, zero and the unit vectors first; a bit of its codeword is the
    parity of what the vector shares with one of the 2^k - 1 others. Up to four languages that is every split.
    At most BITS_PER_LOG k of these bits are kept, drawn from a fixed seed; ``least_distance`` tells what distance is left.
    """
    if n <= 1:
        return np.ones((n, 1))
    k = int(np.ceil(np.log2(n))) + 1
    vectors = np.array(sorted(range(1 << k), key=lambda v: (v.bit_count(), v))[:n])
    splits = np.random.default_rng(5).permutation(np.arange(1, 1 << k))[: BITS_PER_LOG * k]
    code = 1 - 2 * (np.bitwise_count(vectors[:, None] & splits[None, :]).astype(np.int64) & 1)
    return np.unique(code[:, np.abs(code.sum(axis=0)) < n], axis=1)


def least_distance(code: np.ndarray) -> float:
    """The fewest bits in which two rows differ."""
    n, bits = code.shape
    signs, least = code.astype(np.float32), float(bits)
    for at in range(0, n, 1024):
        distance = (bits - signs[at : at + 1024] @ signs.T) / 2
        distance[np.arange(len(distance)), np.arange(at, at + len(distance))] = bits
        least = min(least, float(distance.min()))
    return least


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Codes:
        languages = sorted(set(labels))
        code = codewords(len(languages))
        place = {v: i for i, v in enumerate(languages)}
        at = np.array([place[v] for v in labels])
        y = code[at].astype(np.float64)
        # Each language counts alike, however many rows it has.
        row = np.sqrt(1 / np.bincount(at)[at])

        def ridge(keep: np.ndarray) -> np.ndarray:
            if keep.sum() > x.shape[1]:
                return in_features(np.flatnonzero(keep))
            scaled = x[keep] * row[keep, None]
            gram = scaled @ scaled.T
            gram[np.diag_indices_from(gram)] += RIDGE * gram.diagonal().mean() + 1e-6
            return scaled.T @ np.linalg.solve(gram, y[keep] * row[keep, None])

        def in_features(keep: np.ndarray) -> np.ndarray:
            """The same weights from a system of the features' size, however many rows there are."""
            gram, target, norm = np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1], y.shape[1])), 0.0
            for start in range(0, len(keep), 1024):
                part = keep[start : start + 1024]
                scaled = x[part] * row[part, None]
                gram += scaled.T @ scaled
                target += scaled.T @ (y[part] * row[part, None])
                norm += (scaled**2).sum()
            gram[np.diag_indices_from(gram)] += RIDGE * norm / len(keep) + 1e-6
            return np.linalg.solve(gram, target)

        inner = np.arange(len(labels)) % 4 != 0
        accuracy = np.full(code.shape[1], 0.99)
        if inner.any() and not inner.all():
            accuracy = ((x[~inner] @ ridge(inner) > 0) == (y[~inner] > 0)).mean(axis=0)
        accuracy = np.clip(accuracy, 0.501, 0.999)
        return cls(languages, code, ridge(np.ones(len(labels), bool)).astype(np.float32), np.log(accuracy / (1 - accuracy)))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest language's place and its probability."""
        margin = np.clip(x @ self.weights, -1, 1)
        # The loss exp(-2 * margin * bit) summed over the bits, for bits of +1 and of -1.
        loss = (np.exp(-2 * margin) * self.bit_weight) @ (self.code > 0).T + (np.exp(2 * margin) * self.bit_weight) @ (self.code < 0).T
        distance = loss / self.bit_weight.sum()
        p = np.exp(-4 * (distance - distance.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame) -> Codes | None:
    """Codes learned from rows that are not held out and have a lang; None if there are none.

    Every language is learned. The sample is drawn by a hash of the row, at a rate that makes about
    ROWS_PER_LANGUAGE rows of each language, or fewer where languages are so many that this would
    exceed FIT_ROWS; the row of the least hash is always drawn. Features are made on the executors, so the driver gets bounded rows.
    """
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    languages = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(drawn).alias("least"))
    languages = written(languages, "languages")
    known = languages.count()
    if not known:
        return None
    each = min(ROWS_PER_LANGUAGE, max(1, FIT_ROWS // known))
    below = F.greatest(F.least(F.lit(1.0), F.lit(each) / F.col("n")) * (1 << 20), F.col("least") + 1)
    sample = usable.join(F.broadcast(languages.select("lang", below.alias("below"))), "lang").filter(drawn < F.col("below")).select("doc_id", "lang", "text").distinct()  # a drawn row that repeats is one

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])

    rows = sorted(sample.mapInArrow(extract, "doc_id long, lang string, x binary").collect(), key=lambda r: (r.doc_id, r.lang, r.x))
    if not rows:
        return None
    return Codes.fit(np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, BUCKETS), [r.lang for r in rows])


def identify(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """A row for each document: held_out, predicted language, score in [0, 1], ambiguous.

    ``und`` with score 0 for a null text, a text without a letter (Unicode category L), and without a model.
    Equal rows have equal predictions; of languages at an equal distance the first by name wins.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = batch.column(1).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if codes and _LETTER.search(t)]
            for at in range(0, len(real), 256):
                rows = real[at : at + 256]
                best, p = codes.decode(np.stack([features(texts[i]) for i in rows]))
                score[rows] = p
                for i, k in zip(rows, best.tolist(), strict=True):
                    lang[i] = codes.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score), pc.less(pa.array(score), AMBIGUOUS)], names=[c.split()[0] for c in RESULT.split(", ")])

    rows = id_and_text(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows.mapInArrow(predict, RESULT)


def identify_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
