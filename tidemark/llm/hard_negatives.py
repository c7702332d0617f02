"""Hard negatives of anchors: rows of another label whose score lies in a window below a positive's.

All rows are candidates, sorted by norm into Parquet files whose row groups are the buckets; the footer's statistics
give each bucket's largest norm. A block of anchors goes through the buckets from the largest norm down. By
Cauchy-Schwarz no score in a bucket exceeds the anchor's norm times the bucket's, so an anchor is done with a search
when that product is below all that it still looks for: its running fifth positive, then for each window the lower
limit or, once three negatives are found, the third. Both only rise and norms only fall, so a finished anchor stays
finished, and buckets beyond the last unfinished one are never read.

Scores are exact: matrix products in floats where the norms bound every partial sum by 2 ** 24, in doubles below 2 ** 53,
in Python's integers beyond.

Blocks hold at most ``ANCHORS`` anchors and one bucket; they are dealt by row, so neither a frequent label nor copies of
one vector gather anywhere. A table of N rows has N / 50 anchors against all rows, so the work grows as N squared where
the norms prune nothing; the buckets are read (not shuffled) once for each block and search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, opened, written
from .vectors import as_float, finite, lengths, longs, matrix, scaled, stored

SCALE, EVERY, RELABELLED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Limits of a window, in hundredths of the positive's score.
LOW, HIGH = 50, 95
ANCHORS = 1024
#: Bytes of a row group, which is a bucket: about 3,000 vectors of 64 floats.
BUCKET_BYTES = 1 << 20
#: Norms are rounded; bounds are taken so much larger.
_SLACK = 1 + 1e-9

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def candidates(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, norm, vec) of all rows that take part, written in files and row groups of falling norm."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = ((label.cast("decimal(20,0)") + 1) % LABELS).cast("long")
    own = embeddings.filter(F.col("label").isNotNull() & finite(embeddings)).select(
        F.monotonically_increasing_id().alias("row"),
        vec_id.alias("vec_id"),
        F.when(vec_id % RELABELLED == 0, moved).otherwise(label).alias("label"),
        stored(embeddings).alias("vec"),
    )
    whole = lambda x: F.when(F.abs(x) < 1e12, F.floor(SCALE * x).cast("double")).otherwise(SCALE * x)
    norm = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))
    # The row's hash cuts a norm that many rows share.
    dealt = own.withColumn("norm", norm).repartitionByRange(F.desc("norm"), F.xxhash64("row")).sortWithinPartitions(F.desc("norm"))
    return written(dealt.select("row", "vec_id", "label", "norm", "vec"), "buckets", {"parquet.block.size": str(BUCKET_BYTES)})


class Buckets:
    """The candidates' files, by falling norm."""

    def __init__(self, folder: str, names: list[str]):
        store, root = opened(folder)
        files = [pq.ParquetFile(store.open_input_file(f"{root}/{name}")) for name in names]
        found = []
        for file in files:
            for g in range(file.num_row_groups):
                group = file.metadata.row_group(g)
                column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "norm")
                known = column.statistics is not None and column.statistics.has_min_max
                found.append((column.statistics.max if known else float("inf"), file, g))
        self.found = sorted(found, key=lambda x: -x[0])

    def down(self) -> Iterator[tuple[float, Callable[[], pa.Table]]]:
        """(largest norm, a function that reads it) of each bucket."""
        for norm, file, g in self.found:
            yield norm, lambda file=file, g=g: file.read_row_group(g).combine_chunks()


class Best:
    """The k best candidates of each of n searches: score falling, then id rising, a null id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.zeros((n, k), np.int64)
        self.null = np.zeros((n, k), bool)
        self.row = np.full((n, k), -1, np.int64)

    @property
    def least(self) -> np.ndarray:
        """The kth score; minus infinity while there are fewer."""
        return self.score[:, -1]

    def offer(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        if not len(search):
            return
        if score.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        own, k = np.unique(search), self.k
        search = np.concatenate([np.repeat(own, k), search])
        score = np.concatenate([self.score[own].ravel(), score.astype(self.score.dtype)])
        ids, null, row = (np.concatenate([mine[own].ravel(), new]) for mine, new in ((self.id, ids), (self.null, null), (self.row, row)))
        if score.dtype == object:
            keys = list(zip(search.tolist(), (-score).tolist(), null.tolist(), ids.tolist(), row.tolist(), strict=True))
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        else:
            order = np.lexsort((row, ids, null, -score, search))
        search = search[order]
        starts = np.searchsorted(search, own)
        take = order[(starts[:, None] + np.arange(k)).ravel()]
        for mine, new in ((self.score, score), (self.id, ids), (self.null, null), (self.row, row)):
            mine[own] = new[take].reshape(len(own), k)


def scores(a: np.ndarray, a_norm: float, b: np.ndarray, b_norm: float) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``, whose largest norms are given."""
    most = a_norm * b_norm * _SLACK
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    return np.dot(a.astype(kind), b.astype(kind).T)


class Block:
    """Anchors with what the searches know of them."""

    def __init__(self, table: pa.Table):
        self.vec_id, self.label, self.row = (table.column(c).to_numpy() for c in ("vec_id", "label", "row"))
        self.q = scaled(matrix(table.column("vec").combine_chunks()), SCALE)
        self.norm = lengths(self.q)

    def search(self, buckets: Buckets, wanted, take) -> int:
        """Goes down the buckets. ``wanted``: the least score that each anchor still looks for; ``take``: gets what a
        bucket holds, as (anchors, their scores, the bucket's columns). The number of buckets read."""
        n = 0
        for norm, read in buckets.down():
            with np.errstate(invalid="ignore"):
                bound = self.norm * norm * _SLACK
            least = wanted()
            active = np.flatnonzero((as_float(least) <= np.where(np.isnan(bound), np.inf, bound)) & (as_float(least) < np.inf))
            if not len(active):
                break
            table = read()
            n += 1
            q = scaled(matrix(table.column("vec").combine_chunks()), SCALE)
            if q.shape[1] != self.q.shape[1]:
                raise ValueError("the vectors differ in length")
            found = scores(self.q[active], self.norm[active].max(), q, norm)
            ids = table.column("vec_id").combine_chunks()
            take(active, found, table.column("label").to_numpy(), ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table.column("row").to_numpy())
        return n

    def positives(self, buckets: Buckets) -> Best:
        best = Best(len(self.row), POSITIVES)

        def take(active, found, label, ids, null, row):
            good = (found >= best.least[active, None]) & (self.label[active, None] == label) & (self.row[active, None] != row)
            a, c = np.nonzero(good)
            best.offer(active[a], found[a, c], ids[c], null[c], row[c])

        self.search(buckets, lambda: best.least, take)
        return best

    def negatives(self, buckets: Buckets, positives: Best) -> Best:
        """Three for each anchor and positive, whose search is number anchor * ``POSITIVES`` + rank."""
        own = positives.row.ravel() >= 0
        score = [int(s) if o else 0 for s, o in zip(positives.score.ravel().tolist(), own.tolist(), strict=True)]
        exact = positives.score.dtype
        low = np.array([-(-LOW * s // 100) if o else np.inf for s, o in zip(score, own, strict=True)], exact)
        high = np.array([HIGH * s // 100 if o else -np.inf for s, o in zip(score, own, strict=True)], exact)
        low[low > high] = np.inf  # an empty window
        best = Best(len(score), NEGATIVES)

        def wanted() -> np.ndarray:
            return np.maximum(low, best.least).reshape(-1, POSITIVES)

        def take(active, found, label, ids, null, row):
            least = wanted()[active]
            most = high.reshape(-1, POSITIVES)[active]
            a, c = np.nonzero((found >= least.min(axis=1)[:, None]) & (found <= most.max(axis=1)[:, None]) & (self.label[active, None] != label))
            score = found[a, c]
            for w in range(POSITIVES):
                good = np.flatnonzero((score >= least[a, w]) & (score <= most[a, w]))
                best.offer(active[a[good]] * POSITIVES + w, score[good], ids[c[good]], null[c[good]], row[c[good]])

        self.search(buckets, lambda: wanted().min(axis=1), take)
        return best

    def mined(self, buckets: Buckets) -> pa.RecordBatch:
        positives = self.positives(buckets)
        negatives = self.negatives(buckets, positives)
        search, rank = np.nonzero(negatives.row >= 0)
        anchor, nth = search // POSITIVES, search % POSITIVES
        named = lambda best, i, j: pa.array(best.id[i, j], pa.int64(), mask=best.null[i, j])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.vec_id[anchor], pa.int64()), named(positives, anchor, nth), pa.array(rank + 1, pa.int32()), named(negatives, search, rank), longs(positives.score[anchor, nth]), longs(negatives.score[search, rank])],
            names=[f.split()[0] for f in SCHEMA.split(", ")],
        )


def mine(embeddings: DataFrame) -> DataFrame:
    """For each anchor and positive the first negatives of its window, as the module says.

    Rows with a null label, no vector or a component that is null or not finite take no part. A repeated row is another
    row: it can be the positive of its copy, and as an anchor it has rows of its own. A null id is no anchor's and comes
    last among ties. A score beyond 64 bits is null, in its right place. No anchors: an empty result. Vectors of different
    lengths raise an error.
    """
    spark = embeddings.sparkSession
    held = candidates(embeddings)
    folder, names = held._written_to, sorted(path.rsplit("/", 1)[1] for path in held.inputFiles())
    anchors = held.filter(F.col("vec_id") % EVERY == 0)
    n = anchors.count()
    tasks = max(min(2 * spark.sparkContext.defaultParallelism, -(-n // 32)), -(-n // ANCHORS), 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, buckets = [], None
        for batch in batches:
            while batch.num_rows:
                room = ANCHORS - sum(b.num_rows for b in rows)
                rows.append(batch.slice(0, room))
                batch = batch.slice(min(room, batch.num_rows))
                if sum(b.num_rows for b in rows) == ANCHORS:
                    buckets = buckets or Buckets(folder, names)
                    yield Block(pa.Table.from_batches(rows)).mined(buckets)
                    rows = []
        if sum(b.num_rows for b in rows):
            yield Block(pa.Table.from_batches(rows)).mined(buckets or Buckets(folder, names))

    found = written(anchors.repartition(tasks, "row").mapInArrow(search, SCHEMA), "negatives")
    forget(held)
    return found


#: For distinct vec_ids. The anchors are a stated set of queries against all rows.
ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % {RELABELLED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
    FROM kept a JOIN kept c ON a.vec_id <> c.vec_id WHERE a.vec_id % {EVERY} = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
