"""Vector codes and hard negatives against plain statements of their rules, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tests.compare import compare, connect
from tidemark.llm import hard_negatives, vector_codes
from tidemark.llm.queries import op11_vector_codes, op13_hard_negatives

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def whole(x, factor):
    return [math.floor(v) * factor + math.floor((v - math.floor(v)) * factor) for v in x]


def sound(vec):
    return vec is not None and all(v is not None and math.isfinite(v) for v in vec)


def plain_codes(rows):
    """rows: (vec_id, label, vec). The contract, step by step."""
    kept = [(i, label, whole(vec, 4096)) for i, label, vec in rows if sound(vec)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:16]
    width = len(kept[0][2]) // 8 if kept else 0
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, _, q in first] for p in range(8)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = [[] for _ in books[p]]
            for _, _, q in kept:
                own[near(cut(q, p), books[p])[1]].append(cut(q, p))
            books[p] = [[sum(c) // len(vs) for c in zip(*vs, strict=True)] if vs else e for vs, e in zip(own, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coded = []
    for i, label, q in kept:
        found = [near(cut(q, p), books[p]) for p in range(8)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    long = lambda v: v if -(1 << 63) <= v < 1 << 63 else None
    by_label = {label: sum(e for _, other, _, e in coded if other == label) for _, label, _, _ in coded}
    lost = {label for _, label, _, e in coded if long(e) is None}
    return sorted((str(i), code, str(long(e)), str(None if label in lost else long(by_label[label])), sha) for i, label, code, e in coded)


def codes_of(df):
    return sorted((str(r.vec_id), r.code, str(r.error), str(r.label_error), r.codebooks_sha256) for r in vector_codes.compress(df).collect())


def plain_negatives(rows):
    kept = []
    for row, (i, label, vec) in enumerate(rows):
        if label is not None and sound(vec):
            kept.append((row, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, whole(vec, 256)))
    out = []
    for row, i, label, q in kept:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, o, strict=True)), j is None, j or 0, other, j, same == label) for other, j, same, o in kept if other != row), key=lambda s: s[:4])
        for neg, _, _, _, positive, _ in [s for s in scored if s[5]][:5]:
            window = [s for s in scored if not s[5] and 50 * -neg <= -100 * s[0] <= 95 * -neg][:3]
            out += [(i, positive, rank, s[4], -neg, -s[0]) for rank, s in enumerate(window, 1)]
    return sorted(out, key=str)


def negatives_of(df):
    return sorted((tuple(r) for r in hard_negatives.mine(df).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_whole_tables_equal_their_sql(spark, con):
    assert compare(op11_vector_codes(spark, SF), con, vector_codes.ORACLE) == ""
    assert compare(op13_hard_negatives(spark, SF), con, hard_negatives.ORACLE) == ""


def table_of(seed, n, spread, labels=4, width=8, copies=False):
    rng = random.Random(seed)
    pool = [[round(rng.gauss(0, 1) * rng.choice(spread), 3) for _ in range(width)] for _ in range(max(2, n // 6 if copies else n))]
    return [(i, rng.choice([None, *range(labels)]), list(rng.choice(pool)) if copies else pool[i]) for i in range(n)]


@pytest.mark.parametrize("copies", [False, True])
def test_tables_of_other_kinds_equal_the_plain_rules(spark, copies):
    """Ties by copies, unlike norms, null labels, few rows."""
    for n, spread in ((1, [1]), (9, [1]), (260, [0.01, 1, 30])):
        rows = table_of(n, n, spread, copies=copies)
        df = frame(spark, rows)
        assert codes_of(df) == plain_codes(rows)
        assert negatives_of(df) == plain_negatives(rows)


def test_odd_rows(spark):
    rows = table_of(3, 60, [1])
    rows += [(0, 1, [0.5] * 8), (0, 1, [0.5] * 8), (50, 1, [0.5] * 8), (None, 1, [0.5] * 8), (None, None, [0.25] * 8)]
    rows += [(100, 2, None), (101, 2, [1.0] * 7 + [None]), (102, 2, [1.0] * 7 + [NAN]), (103, 2, [INF] + [1.0] * 7), (150, None, [1.0] * 8)]
    df = frame(spark, rows)
    assert codes_of(df) == plain_codes(rows) and negatives_of(df) == plain_negatives(rows)
    more = df.selectExpr("*", "'x' AS code", "1 AS rank", "label AS row", "embedding AS vec", "'k' AS key")
    assert codes_of(more) == plain_codes(rows) and negatives_of(more) == plain_negatives(rows)
    for empty in (df.limit(0), df.filter("vec_id = 100")):
        assert vector_codes.compress(empty).count() == 0 and hard_negatives.mine(empty).count() == 0
    assert vector_codes.compress(frame(spark, [(1, 1, [])])).collect()[0].code == "00" * 8


def test_values_beyond_doubles_and_longs(spark):
    """Exact in 64 bits, in Python's integers, and null where a result is no long."""
    rng = random.Random(9)
    for size in (3e4, 1e6, 3e9, 1e30):
        rows = [(i, i % 3, [round(rng.uniform(0.5, 1), 6) * size for _ in range(8)]) for i in range(0, 240, 5)]
        rows += [(i, i % 3, [rng.uniform(0, 1) for _ in range(8)]) for i in range(301, 340)]
        df = frame(spark, rows)
        assert codes_of(df) == plain_codes(rows), size
        long = lambda r: (*r[:4], *(v if v < 1 << 63 else None for v in r[4:]))
        assert negatives_of(df) == sorted(map(long, plain_negatives(rows)), key=str), size


def test_vectors_that_cannot_be_cut_are_refused(spark):
    with pytest.raises(Exception, match="divide by 8"):
        vector_codes.compress(frame(spark, [(1, 1, [1.0] * 9)]))
    with pytest.raises(Exception, match="differ in length"):
        hard_negatives.mine(frame(spark, [(50, 1, [1.0] * 8), (51, 1, [1.0] * 9)]))


def test_annulus_is_inclusive_and_prunes():
    rng = np.random.default_rng(4)
    entries = rng.integers(-900, 900, (16, 8)) * np.arange(1, 17)[:, None]
    book = vector_codes.Codebook(entries)
    parts = entries[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    which, best, evaluated = book.nearest(parts)
    every = ((parts[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < 0.3 * every.size
    tied = vector_codes.Codebook(np.array([[3, 4], [5, 0], [-5, 0], [0, 5], [0, 1]]))
    assert tied.nearest(np.array([[0, 0], [5, 5], [1, 1]]))[0].tolist() == [4, 0, 4]
    assert vector_codes.Codebook(np.array([[0, 5], [5, 0]])).nearest(np.array([[0, 0], [4, 4]]))[0].tolist() == [0, 0]


def test_buckets_beyond_the_bounds_are_not_read(spark, monkeypatch):
    """With norms over a wide range most buckets stay unread."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 16)) * np.geomspace(0.001, 10, 20_000)[:, None]
    df = spark.createDataFrame([(i, int(rng.integers(3)), v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(hard_negatives, "BUCKET_BYTES", 1 << 16)
    held = hard_negatives.candidates(df)
    buckets = hard_negatives.Buckets(held._written_to, sorted(p.rsplit("/", 1)[1] for p in held.inputFiles()))
    block = hard_negatives.Block(held.filter("vec_id % 50 = 0 AND vec_id > 10000").limit(100).toArrow())
    read = []
    search = hard_negatives.Block.search
    monkeypatch.setattr(hard_negatives.Block, "search", lambda self, *a: read.append(search(self, *a)) or read[-1])
    assert block.mined(buckets).num_rows > 100
    assert len(buckets.found) >= 8 and max(read) < len(buckets.found) / 2
