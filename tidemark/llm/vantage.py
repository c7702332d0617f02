"""Exact neighbours of 64-bit fingerprints in Hamming distance, by vantage-point trees.

Routing. Cut the 64 bits into blocks. Two fingerprints that differ in at most r bits differ in
at most floor(r / blocks) bits of some block, and with more blocks than r they agree on
blocks - r of them. The distance on a block is a metric of its own, so a vantage point v of that
block gives |d(x, v) - d(y, v)| <= that bound: x and y lie in the same shell around v or in
shells that near. A shard is the list of shells around the vantage points of a block, or, where
several blocks agree, of those blocks together; a fingerprint is indexed in its own shard and
asked in every shard whose boundary lies within the bound. With more blocks than r the bound
is 0, so each choice of blocks asks in exactly one shard; the more fingerprints there are, the more
blocks are used, so that shards stay small.

In a shard. A vantage-point tree over the full distance: each node takes the member nearest to
none, splits the rest at the median distance, and a block of queries goes down a branch only
if the triangle inequality lets a neighbour be there. Leaves are compared by popcount.

Shards above ``SHARD_MOST`` members are cut into parts, and each pair of parts is a cell that is
searched by itself, so a dense crowd of near copies is spread and still searched exactly: a cell
holds two parts, whatever the shard holds. Each cell returns stars, which connect what the
links it finds connect with fewer rows than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, spread_join, written
from .components import local_stars

BITS = 64
BLOCKS = 4
SHARD_MEAN = 1 << 10  # members of a shard on average, up to which few blocks are used
LEVELS = 10
LEVELS_OVERLAPPING = 2
LEAF = 48
SHARD_MOST = 4096


def _vantage_points(width: int, levels: int) -> np.ndarray:
    """Fixed words of ``width`` bits, from a fixed seed."""
    return np.random.default_rng(64).integers(0, 1 << width, levels, dtype=np.uint64)


def blocks_for(n: int, radius: int) -> int:
    """Blocks that keep ``n`` evenly spread fingerprints at about SHARD_MEAN in a shard, or fewer."""
    blocks = BLOCKS
    while blocks > radius and n >> (BITS * (blocks - radius) // blocks) > SHARD_MEAN and blocks < 2 * radius:
        blocks += 1
    return blocks


def routes(words: np.ndarray, radius: int, blocks: int = BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, shard, asked) arrays: the home shards of every row, and those its ball also meets."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    bound, agree = radius // blocks, max(1, blocks - radius)
    rows = np.arange(len(words))
    shells = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = (words >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        points = _vantage_points(high - low, LEVELS_OVERLAPPING if bound else LEVELS)
        shells.append(np.stack([np.bitwise_count(part ^ p).astype(np.int64) for p in points]))
    for which, chosen in enumerate(combinations(range(blocks), agree)):
        own = np.concatenate([shells[i] for i in chosen])
        for shift in product(range(-bound, bound + 1), repeat=len(own)) if bound else [(0,) * len(own)]:
            near = own + np.array(shift)[:, None]
            inside = ((near >= 0) & (near <= BITS // blocks)).all(axis=0) if bound else np.ones(len(words), bool)
            key = np.full(len(words), which, dtype=np.uint64)
            with np.errstate(over="ignore"):  # equal shells have equal keys; a chance meeting of others only adds comparisons
                for row in near:
                    key = (key ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
            yield rows[inside], key[inside].view(np.int64), any(shift)


class Tree:
    """A vantage-point tree over distinct words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.root = self._build(np.arange(len(words)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        # The member farthest from the first one splits a crowd better than a central member.
        own = self.words[members]
        point = members[int(np.bitwise_count(own ^ own[0]).argmax())]
        distance = np.bitwise_count(own ^ self.words[point]).astype(np.int64)
        middle = int(np.median(distance))
        inner = distance <= middle
        if inner.all():
            inner = distance < middle
            middle -= 1
            if not inner.any():
                return members
        return point, middle, self._build(members[inner]), self._build(members[~inner])

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query row, member row) pairs at distance ``radius`` or less."""
        left, right = [], []
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asking = stack.pop()
            if not len(asking):
                continue
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), 1024):
                    near = np.bitwise_count(queries[asking][:, None] ^ self.words[node[at : at + 1024]][None, :]) <= radius
                    q, m = np.nonzero(near)
                    left.append(asking[q])
                    right.append(node[at + m])
                continue
            point, middle, inner, outer = node
            distance = np.bitwise_count(queries[asking] ^ self.words[point]).astype(np.int64)
            stack.append((inner, asking[distance - radius <= middle]))
            stack.append((outer, asking[distance + radius > middle]))
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def near_links(home: np.ndarray, asked: np.ndarray, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``radius`` between ``asked`` and ``home``, as places in home + asked.

    Equal words are one place: the first.
    """
    everything = np.concatenate([home, asked])
    if len(home) <= LEAF and len(asked) <= 4 * LEAF:
        near = np.bitwise_count(asked[:, None] ^ home[None, :]) <= radius
        near &= asked[:, None] != home[None, :]
        if not near.any():
            return (np.empty(0, np.int64),) * 2
        pairs = [np.nonzero(near)]
        pairs = [(pairs[0][0] + len(home), pairs[0][1])]
    else:
        tree, pairs = Tree(home), []
        for at in range(0, len(asked), step):
            q, m = tree.within(asked[at : at + step], radius)
            # Stars of what one block of queries finds, so that a crowd's pairs never pile up.
            pairs.append(_one_place(everything, q + at + len(home), m))
    q, m = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    return _one_place(everything, q, m)


def _one_place(words: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = words[q] != words[m]
    q, m = q[other], m[other]
    _, first, at = np.unique(words, return_index=True, return_inverse=True)
    return local_stars(first[at[q]], first[at[m]])


def cells(fingerprints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(shard, cell, id, word, first): every cell is searched by itself, its ``first`` rows against the others.

    The cell of one part with itself has ``first`` rows only. Cells are numbered by (whether the
    others come from another shard, part, part).
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word = batch.column(0), batch.column(1)
            for rows, shard, asked in routes(word.to_numpy().view(np.uint64), radius, blocks):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([ids.take(at), word.take(at), pa.array(shard), pa.array(np.full(len(rows), asked))], names=["id", "word", "shard", "asked"])

    routed = written(fingerprints.select("id", "word").mapInArrow(route, "id long, word long, shard long, asked boolean"), "routed")
    parts = lambda n: F.ceil(n / F.lit(0.75 * SHARD_MOST)).cast("int")  # noqa: E731  # a hash deals the parts unevenly
    sizes = routed.groupBy("shard").agg(F.count("*").alias("n"), parts(F.count_if(~F.col("asked"))).alias("parts"), parts(F.count_if(F.col("asked"))).alias("guest_parts"))
    crowded = written(sizes.filter("parts > 1 OR guest_parts > 1"), "crowded")
    placed = spread_join(routed, crowded.drop("n"), "shard", "left", crowded.select("shard", F.col("n").alias("_n"))).withColumn("crowded", F.col("parts").isNotNull())
    placed = placed.withColumns({"parts": F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)), "guest_parts": F.coalesce("guest_parts", F.lit(int(radius >= blocks)))})
    own = F.pmod(F.xxhash64("word"), F.when(F.col("asked"), F.greatest("guest_parts", F.lit(1))).otherwise(F.col("parts"))).cast("int")
    placed = placed.withColumn("part", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    number = lambda guest, x, y: F.lit(guest << 62) + F.shiftleft(x.cast("long"), 31) + y.cast("long")
    cell = lambda guest, x, y, first: F.struct(number(guest, x, y).alias("cell"), first.alias("first"))
    at_home = F.transform(upto(F.col("parts")), lambda w: cell(0, F.least("part", w), F.greatest("part", w), F.col("part") <= w))
    hosts = F.transform(upto(F.col("guest_parts")), lambda q: cell(1, F.col("part"), q, F.lit(True)))
    guests = F.transform(upto(F.col("parts")), lambda w: cell(1, w, F.col("part"), F.lit(False)))
    dealt = placed.select("shard", "id", "word", F.explode(F.when(F.col("asked"), guests).otherwise(F.concat(at_home, hosts))).alias("at"))
    return dealt.select("shard", "at.cell", "id", "word", "at.first")


def links_within(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) of fingerprint ids that connect all that lies within ``radius``.

    ``fingerprints``: a written table of distinct ``word`` (64 bits as a long) with ``id`` (long). The result has at
    most a few rows for each fingerprint; its components are those of all exact pairs.
    """
    dealt = cells(fingerprints, radius, blocks_for(fingerprints.count(), radius))
    dealt = dealt.repartition(shuffle_partitions(fingerprints.sparkSession), "shard", "cell").sortWithinPartitions("shard", "cell")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, first in _cells(batches):
            if first.all():
                q, m = near_links(words, words, radius)
                both = np.concatenate([ids, ids])
            else:
                q, m = near_links(words[first], words[~first], radius)
                both = np.concatenate([ids[first], ids[~first]])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(both[q]), pa.array(both[m])], names=["a", "b"])

    return dealt.mapInArrow(search, "a long, b long").filter("a <> b")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, first) of each cell that has two rows at least; rows come sorted by cell."""
    rest: list[np.ndarray] = []
    for batch in batches:
        shard, cell, ids, words, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        rows = np.stack([shard, cell, ids, words, first.astype(np.int64)])
        if rest:
            rows = np.concatenate([*rest, rows], axis=1)
        cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield from _cell(rows[:, a:b])
        rest = [rows[:, starts[-1] :]]
    if rest:
        yield from _cell(rest[0])


def _cell(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    first = rows[4].astype(bool)
    if rows.shape[1] > 1 and first.any():
        yield rows[2], rows[3].view(np.uint64), first
