"""Toxicity: cumulative-link ordinal regression over sparse text features.

A grade y in 0..3 has P(y >= k | x) = sigmoid(w x - theta_k) with theta_1 < theta_2 < theta_3: the
thresholds are ordered and share the weights w. The result is the expected severity, the sum
of these probabilities. Features are counts of words and of word beginnings of four to six
letters, which catch the inflected forms of a stem, and the number of words: what is a sign of
toxicity in a short text may be chance in a long one.

Labels tell only toxic or not. The grade of a toxic training row is the third of the toxic rows,
by number of words that stand out in toxic texts, in which it lies; other rows have grade 0.
A document is rejected if P(y >= 1) reaches a threshold: the middle of those that best tell apart
rows scored by models that were fitted without them (``FOLDS``).

Fitting uses a sample of at most about ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other labelled
rows. A feature is used if the lower confidence bound of its log-odds ratio, toxic against
clean, exceeds ``LEAST_BOUND``; there is no other limit to the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, steps, written
from .fingerprints import bin_minima
from .shingles import hash_words
from .shingles import words_of as shingle_words

TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
LEAST_BOUND = 1.0  # of the log-odds ratio of a feature, at 95 % confidence
GRADES = 3
FOLDS = 3

RESULT = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"

LENGTH = "#words"

_STEMS = (4, 5, 6)
#: ASCII letters stay, other ASCII is a blank, bytes of other characters stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of a column without nulls, and the n + 1 places between texts."""
    lower = pc.utf8_lower(texts)
    offsets = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if lower.buffers()[2] else np.empty(0, np.uint8)
    folded = pa.Array.from_buffers(pa.string(), len(lower), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(_FOLD[data])])
    lists = pc.ascii_split_whitespace(folded)
    parts, bounds = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(parts), 0)  # blanks at an end leave an empty part
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return parts.filter(real), ends[bounds - bounds[0]]


def word_features(word: str) -> list[str]:
    """The word itself and its longer beginnings, which end in a hyphen."""
    return [word, *(word[:n] + "-" for n in _STEMS if len(word) >= n)] if word else []


def _best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the first range of cuts at which recall less false alarms is highest."""
    order = np.argsort(p, kind="stable")
    gain = np.concatenate([[0.0], np.cumsum(np.where(toxic[order], -1 / toxic.sum(), 1 / (~toxic).sum()))])
    held = np.concatenate([[0.0], p[order], [1.0]])
    gain[1:-1][held[1:-2] == held[2:-1]] = -1  # no cut lies between equal values
    k = int(gain.argmax())
    return float((held[k] + held[k + 1]) / 2)


@dataclass
class Sparse:
    """A matrix of n rows as (row, column, value) triples, by row and column."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def transposed_times(self, r: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], columns)

    def rows(self, chosen: np.ndarray) -> Sparse:
        place = np.cumsum(chosen) - 1
        own = chosen[self.row]
        return Sparse(int(chosen.sum()), place[self.row[own]], self.column[own], self.value[own])


@dataclass
class Ordinal:
    """Cumulative-link model over named features."""

    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    reject: float = 0.5

    @classmethod
    def fit(cls, features: list[str], x: Sparse, grade: np.ndarray, l2: float = 10.0, rounds: int = 600, rate: float = 0.05) -> Ordinal:
        n, k, d = len(grade), GRADES, len(features)
        target = grade[:, None] > np.arange(k)[None, :]
        # Toxic and other rows weigh alike.
        weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum())) * n
        # Parameters: weights, first threshold, logarithms of the steps between thresholds.
        p = np.zeros(d + k)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, rounds + 1):
            w, first, gaps = p[:d], p[d], np.exp(p[d + 1 :])
            theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
            residual = (1 / (1 + np.exp(-np.clip(x.times(w)[:, None] - theta[None, :], -30, 30))) - target) * weight[:, None] / n
            by_threshold = -residual.sum(axis=0)
            gradient = np.concatenate([x.transposed_times(residual.sum(axis=1), d) + l2 * w / n, [by_threshold.sum()], [by_threshold[j + 1 :].sum() * g for j, g in enumerate(gaps)]])
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(features, p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]))

    def at_least(self, x: Sparse) -> np.ndarray:
        """P(y >= 1), P(y >= 2), ... for each row."""
        return 1 / (1 + np.exp(-np.clip(x.times(self.weights)[:, None] - self.thresholds[None, :], -30, 30)))


def design(texts: pa.Array, features: list[str]) -> Sparse:
    """log(1 + count) of each feature in each text."""
    place = {f: i for i, f in enumerate(features)}
    words, bounds = words_of(texts)
    coded = words.dictionary_encode()
    own = [[place[f] for f in word_features(w) if f in place] for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(o) for o in own], np.int64)
    flat, starts = np.array([i for o in own for i in o], np.int64), np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(sizes[codes]) if len(codes) else np.empty(0, np.int64)
    code = codes[at]
    n = sizes[code] if len(code) else np.empty(0, np.int64)
    row = np.repeat(np.searchsorted(bounds, at, side="right") - 1, n)
    column = flat[np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(code) else np.empty(0, np.int64)
    if LENGTH in place:
        length = np.diff(bounds)
        row, column = np.append(row, np.repeat(np.arange(len(texts)), length)), np.append(column, np.full(length.sum(), place[LENGTH]))
    keys, counts = np.unique(row * len(features) + column, return_counts=True)
    return Sparse(len(texts), keys // len(features), keys % len(features), np.log1p(counts))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the training rows: drawn by a hash of doc_id at rates that bound their number."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marks.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    rate = F.when(F.col("toxic") > 0, min(1.0, TOXIC_ROWS / max(1, counts.toxic))).otherwise(min(1.0, CLEAN_ROWS / max(1, counts.clean)))
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < rate * (1 << 20))
    rows = id_and_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")  # drawn: some thousand ids by its rates

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = [bin_minima(hash_words(shingle_words(t), 5), 4).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in minima], pa.int64()) for i in range(4))], names=["doc_id", "text", "toxic", "s0", "s1", "s2", "s3"])

    # Copies would make the words of one text look like signs of its label.
    signed = rows.mapInArrow(sign, "doc_id long, text string, toxic int, s0 long, s1 long, s2 long, s3 long")
    for column in ("s0", "s1", "s2", "s3"):
        first = Window.partitionBy("toxic", column).orderBy("doc_id", "text")
        signed = signed.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return written(signed.select("doc_id", "text", "toxic"), "toxic-sample")


def _feature_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            words, bounds = words_of(batch.column(1))
            words = words.to_pylist()
            for a, b, toxic in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                seen[toxic > 0].update({f for w in set(words[a:b]) for f in word_features(w)})
            names = list(seen[True] | seen[False])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[t][f] for f in names], pa.int64()) for t in (True, False))], names=["feature", "toxic", "clean"])

    return sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal | None:
    """The model, or None without both toxic and clean labelled rows."""
    sample = _sample(docs, labels)
    sizes = {r.toxic: r["count"] for r in sample.groupBy(F.expr("toxic > 0").alias("toxic")).count().collect()}
    if len(sizes) < 2:
        return None
    # The lower confidence bound of the log-odds ratio of having the feature, toxic against clean.
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (sizes[True] - F.col("toxic") + 0.5)) - F.log(b / (sizes[False] - F.col("clean") + 0.5))
    ranked = _feature_counts(sample).withColumn("bound", odds - 1.64 * F.sqrt(1 / a + 1 / b))
    features = [r.feature for r in ranked.filter(F.col("bound") > LEAST_BOUND).select("feature").collect()]
    if not features:
        return None
    features = [*sorted(features), LENGTH]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = design(batch.column(1), features)
            bounds = np.searchsorted(x.row, np.arange(x.n + 1)).tolist()
            cut = lambda v, kind: pa.array([v[a:b].astype(kind).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cut(x.column, np.int32), cut(x.value, np.float32)], names=["doc_id", "toxic", "at", "value"])

    rows = sorted(sample.mapInArrow(extract, "doc_id long, toxic int, at binary, value binary").collect(), key=lambda r: (r.doc_id, r.at, r.value))
    sizes = np.array([len(r.at) // 4 for r in rows])
    x = Sparse(len(rows), np.repeat(np.arange(len(rows)), sizes), np.frombuffer(b"".join(r.at for r in rows), np.int32).astype(np.int64), np.frombuffer(b"".join(r.value for r in rows), np.float32).astype(np.float64))
    return fit_rows(features, x, np.array([r.toxic > 0 for r in rows]))


def fit_rows(features: list[str], x: Sparse, toxic: np.ndarray) -> Ordinal:
    words = x.column < len(features) - 1
    strength = np.bincount(x.row[words], np.expm1(x.value[words]), x.n)
    cuts = np.quantile(strength[toxic], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic, 1 + (strength[:, None] > cuts[None, :]).sum(axis=1), 0)
    model, fold = Ordinal.fit(features, x, grade), np.arange(x.n) % FOLDS
    p = model.at_least(x)[:, 0]
    for k in range(FOLDS):
        rest, own = fold != k, fold == k
        if toxic[rest].any() and not toxic[rest].all() and own.any():
            p[own] = Ordinal.fit(features, x.rows(rest), grade[rest]).at_least(x.rows(own))[:, 0]
    model.reject = _best_cut(p, toxic)
    return model


def _scores(texts: pa.Array, model: Ordinal | None) -> np.ndarray:
    return model.at_least(design(texts, model.features)) if model else np.zeros((len(texts), GRADES))


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """A row for each document: expected severity (0 to 3), likeliest grade, P(y >= 1), toxic.

    A null or empty text has no features. Without a model all is 0 and false. Equal texts, and so
    repeated rows, have equal results; of equally likely grades the lowest is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            p = _scores(batch.column(1), model)
            each = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= model.reject if model else np.zeros(len(p), bool))],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return id_and_text(docs).mapInArrow(run, RESULT)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """``docs`` without the rows that the model rejects; rows of a null text stay."""
    schema, at = docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            p = _scores(pc.fill_null(batch.column(at), ""), model)
            yield batch.filter(pa.array(p[:, 0] < model.reject)) if model else batch

    return docs.mapInArrow(keep, schema)
