"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

The items of this bin-packing problem have at most ``capacity`` different lengths, so the
whole instance is a histogram, whatever the number of documents. The histogram goes to the
driver (at most ``capacity`` rows), is solved there as groups of equal bins, and the plan
(also bounded by ``capacity``, not by the data) goes back to the executors, which place each
piece from its rank among the pieces of its length.

Solving follows Martello and Toth: a small set of items that dominates every other feasible
way to fill the bin of its largest item is fixed for good and leaves the instance; what no
rule can fix is packed by best fit in descending order of length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, shuffle_partitions, steps, written

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class BinGroup:
    """``count`` equal bins; each holds ``runs`` of (length, number of items)."""

    count: int
    free: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def _largest(count: np.ndarray, most: int) -> int:
    """The largest length of at most ``most`` that is left, or 0."""
    if most < 1:
        return 0
    held = np.flatnonzero(count[1 : most + 1])
    return int(held[-1]) + 1 if len(held) else 0


def _smallest(count: np.ndarray, n: int) -> list[int]:
    """The ``n`` smallest items that are left."""
    found: list[int] = []
    for length in np.flatnonzero(count).tolist():
        found += [length] * min(int(count[length]), n - len(found))
        if len(found) == n:
            break
    return found


def _dominating(count: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """The items to fix with one item of length ``w``, which ``count`` no longer has; None if no rule holds.

    With r = capacity - w, and s1 <= s2 <= s3 the smallest items left:

    * none fits (s1 > r): the item alone;
    * the largest y <= r fills the bin, or no two items fit (s1 + s2 > r): with y, since any
      other filling is one item of at most y, or sums to at most y;
    * at most two fit (s1 + s2 + s3 > r) and y >= every pair that fits: with y;
    * at most two fit, and a pair (y, b) is at least as large, part by part, as every pair that
      fits (and y as every single item): with y and b.
    """
    r = capacity - w
    y = _largest(count, r)
    if not y:
        return ()
    small = _smallest(count, 3)
    if y == r or len(small) < 2 or small[0] + small[1] > r:
        return (y,)
    if len(small) == 3 and sum(small) <= r:
        return None
    # The best partner of each length, for pairs (c, d) with c >= d that fit.
    best_sum, best_minor = 0, 0
    lengths = np.flatnonzero(count[: r + 1])
    for c in lengths[::-1].tolist():
        rest = count
        if count[c] == 1:
            rest = count.copy()
            rest[c] = 0
        d = _largest(rest, min(c, r - c))
        if d:
            best_sum, best_minor = max(best_sum, c + d), max(best_minor, d)
    if y >= best_sum:
        return (y,)
    rest = count.copy()
    rest[y] -= 1
    b = _largest(rest, r - y)
    return (y, b) if b and b >= best_minor else None


def reduce_by_dominance(count: np.ndarray, capacity: int) -> tuple[list[BinGroup], np.ndarray]:
    """Bins that some optimal packing has, and the counts of what remains."""
    count, fixed = count.copy(), []
    changed = True
    while changed:
        changed = False
        for w in np.flatnonzero(count)[::-1].tolist():
            while count[w]:
                count[w] -= 1
                others = _dominating(count, w, capacity)
                count[w] += 1
                if others is None:
                    break
                need = dict(zip(*map(np.ndarray.tolist, np.unique([w, *others], return_counts=True)), strict=True))
                # The rule looks only at which lengths are left, at the three smallest and at single
                # copies, so the same set is fixed again while more than three copies of each remain.
                times = max(1, min((int(count[x]) - 3) // k for x, k in need.items()))
                for x, k in need.items():
                    count[x] -= k * times
                fixed.append(BinGroup(times, capacity - w - sum(others), sorted(need.items(), reverse=True)))
                changed = True
    return fixed, count


def best_fit(count: np.ndarray, capacity: int) -> list[BinGroup]:
    """Best fit in descending order of length, whole groups of equal bins at a time."""
    groups: list[BinGroup] = []
    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        for group in sorted((g for g in groups if g.free >= length), key=lambda g: g.free):
            if not left:
                break
            each = group.free // length
            full = min(group.count, left // each)
            rest, part = group.count - full, 0
            if rest and full * each < left:
                part = left - full * each
                groups.append(BinGroup(1, group.free - part * length, [*group.runs, (length, part)]))
                rest -= 1
            if rest:
                groups.append(BinGroup(rest, group.free, list(group.runs)))
            group.count = full
            if full:
                group.runs = [*group.runs, (length, each)]
                group.free -= each * length
            left -= full * each + part
        groups = [g for g in groups if g.count]
        each = capacity // length
        if left >= each:
            groups.append(BinGroup(left // each, capacity - each * length, [(length, each)]))
        if left % each:
            groups.append(BinGroup(1, capacity - left % each * length, [(length, left % each)]))
    return groups


def solve(histogram: dict[int, int], capacity: int) -> list[BinGroup]:
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    fixed, rest = reduce_by_dominance(count, capacity)
    return fixed + best_fit(rest, capacity)


def plan_of(groups: list[BinGroup]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, ranks in each bin, first sequence, offset), by first rank."""
    ranks: dict[int, int] = {}
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for group in groups:
        offset = 0
        for length, each in group.runs:
            at = ranks.get(length, 0)
            plan.setdefault(length, []).append((at, each, sequence, offset))
            ranks[length] = at + each * group.count
            offset += each * length
        sequence += group.count
    return {length: np.array(rows, dtype=np.int64) for length, rows in plan.items()}


def cut_into_pieces(docs: DataFrame, vocabulary: str, cut: str = "space", end_id: int = 0, capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, cut)
        for batch in steps(batches):
            ids, places = encoder.encode(batch.column(1))
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, a, b in zip(batch.column(0).to_pylist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                bounds = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                for k, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    part = own[start:end]
                    for column, value in zip(rows, (doc_id, k, start, end - start, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(rows, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(rows[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return id_and_text(docs).mapInArrow(pieces, PIECES + (", ids array<long>" if with_ids else ""))


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... among the pieces of the same length.

    A length may hold any share of the rows, so ranks are counted within (length, salt) and
    shifted by the sums of the salts before. There are as many salts as shuffle partitions.
    """
    salts = max(64, shuffle_partitions(pieces.sparkSession))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("within", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("within") + F.col("base"))
        .drop("salt", "within", "base")
    )


def place(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is read more than once: give a written table."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_of(solve(histogram, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by capacity squared, in fact a few thousand rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = batch.schema.get_field_index("rank")
            rank = batch.column(at).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length).tolist():
                own, rows = length == value, shared.value[value]
                first, each, base, inside = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                bin_, slot = np.divmod(rank[own] - first, each)
                sequence[own], offset[own] = base + bin_, inside + slot * value
            kept = [(c, f.name) for i, (c, f) in enumerate(zip(batch.columns, batch.schema, strict=True)) if i != at]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(sequence), pa.array(offset)], names=[n for _, n in kept] + ["sequence_id", "offset"])

    with_rank = ranked(pieces)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in with_rank.schema if f.name != "rank"]
    return with_rank.mapInArrow(assign, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, vocabulary: str, cut: str = "space", end_id: int = 0, capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``capacity`` ids; a row for each piece.

    A null or empty text is one piece, the end id alone. A document of more than ``capacity``
    ids is cut into full pieces, of which the first may be shorter. Repeated rows are separate
    items. An empty table has no piece.
    """
    pieces = written(cut_into_pieces(docs, vocabulary, cut, end_id, capacity, with_ids), "pieces")
    return place(pieces, capacity)
