"""Fingerprints, neighbours and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, components, fingerprints, shingles, simhash, vantage


def plain_shingles(text, size):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def plain_simhash(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in plain_shingles(text, 3)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_classes(links, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            for x in (a, b):
                if root[x] != least:
                    root[x], changed = least, True
    return root


def prose(rng, n):
    return " ".join("".join(rng.choices(("er", "on", "Th", "an", "ré", "st"), k=rng.randint(1, 4))) for _ in range(n))


def sample():
    rng = random.Random(3)
    texts = ["", " \t\n", "one", "two words", "x\x1cy z", "A b C d"] + [prose(rng, rng.randint(3, 300)) for _ in range(30)]
    for t in texts[6:26]:
        words = t.split()
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts += [t, t.upper()]
    return texts


def test_hashes_and_simhash_equal_plain_ones():
    for t in sample():
        for size in (3, 5):
            assert shingles.hash_words(shingles.words_of(t), size).tolist() == [xxhash.xxh64_intdigest(s, 42) for s in plain_shingles(t, size)]
        assert shingles.simhash(shingles.hash_words(shingles.words_of(t), 3)) == plain_simhash(t)


@pytest.mark.parametrize("radius", [3, 5])
def test_links_within_finds_exactly_what_brute_force_finds(spark, monkeypatch, radius):
    monkeypatch.setattr(vantage, "SHARD_MOST", 40)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    words = [int(c) for c in centres]
    for c in centres[:30]:
        for _ in range(12 if c != centres[0] else 300):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            words.append(int(c) ^ sum(1 << int(f) for f in flips))
    words = sorted(set(words))
    links = [(i, j) for i in range(len(words)) for j in range(i) if (words[i] ^ words[j]).bit_count() <= radius]
    frame = spark.createDataFrame([(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "id long, word long")
    found = [tuple(r) for r in vantage.links_within(frame, radius).collect()]
    assert plain_classes(found, range(len(words))) == plain_classes(links, range(len(words)))
    tree = vantage.Tree(np.array(words, np.uint64))
    q, m = tree.within(np.array(words, np.uint64), radius)
    assert {(a, b) for a, b in zip(q.tolist(), m.tolist()) if a > b} == set(links)


@pytest.mark.parametrize("radius, blocks", [(3, 4), (3, 5), (3, 6), (2, 4), (0, 4)])
def test_routes_meet_for_all_neighbours(radius, blocks):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = np.array([w ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, radius, replace=False))) for w in words])
    shards = [{(int(r), int(k)) for rows, keys, _ in vantage.routes(x, radius, blocks) for r, k in zip(rows, keys)} for x in (words, near)]
    assert {r for r, _ in shards[0] & shards[1]} == set(range(400))


def test_more_fingerprints_use_more_blocks():
    assert [vantage.blocks_for(n, 3) for n in (1, 1 << 26, 1 << 28, 1 << 40)] == [4, 4, 5, 6]
    assert vantage.blocks_for(1 << 40, 5) == vantage.BLOCKS


@pytest.mark.parametrize("radius", [3, 5])
def test_a_crowded_shard_makes_cells_of_two_parts(spark, monkeypatch, radius):
    monkeypatch.setattr(vantage, "SHARD_MOST", 100)
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 63))
    words = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(1500)})
    frame = spark.createDataFrame([(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "id long, word long")
    sizes = vantage.cells(frame, radius, 4).groupBy("shard", "cell").count().agg({"count": "max"}).first()[0]
    assert sizes <= 2 * 100


@pytest.mark.parametrize("apart", [1, 0, 250])
def test_a_crowd_is_compared_in_cells_of_two_parts(spark, monkeypatch, apart):
    """Of 600 texts of one band the first 600 - ``apart`` are alike, the others are so in pairs."""
    monkeypatch.setattr(simhash, "CELL_MOST", 100)
    alike = np.zeros(simhash.SKETCH_BINS, np.uint16)
    other = [np.append(alike[:200], np.full(56, 1 + i // 2, np.uint16)) for i in range(apart)]
    rows = [(i, s.astype(np.uint16).tobytes()) for i, s in enumerate([alike] * (600 - apart) + other)]
    sketches = spark.createDataFrame(rows, "id long, sketch binary")
    dealt, plain = [], simhash._dealt

    def seen(cells, *columns):
        dealt.append(cells.groupBy("group", "x", "y").count().agg({"count": "max"}).first()[0] or 0)
        return plain(cells, *columns)

    monkeypatch.setattr(simhash, "_dealt", seen)
    links = [tuple(r) for r in simhash._band_links(sketches, 0.9).collect()]
    want = [(0, i) for i in range(600 - apart)] + [(i, i + 1) for i in range(600 - apart, 599, 2)]
    assert plain_classes(links, range(600)) == plain_classes(want, range(600))
    assert max(dealt) <= 2 * 100


def test_hubs_and_frequent_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_LEAST", 3)
    monkeypatch.setattr(components, "FREQUENT", 20)
    links = [(0, x) for x in range(1, 400)] + [(x, x + 1000) for x in range(1, 300, 3)] + [(5000 + i, 5001 + i) for i in range(30)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: b for a, b in plain_classes(links, {n for l in links for n in l}).items() if a != b}
    monkeypatch.setattr(common, "FREQUENT", 10)
    left = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3 if i < 900 else i) for i in range(1000)], "i long, k long")
    right = spark.createDataFrame([(k, k * 2) for k in (0, 1, 905, 906)], "k long, v long")
    for how in ("inner", "left"):
        want = left.join(right, "k", how).select("i", "k", "v")
        got = common.spread_join(left, right, "k", how).select("i", "k", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_classes(links, {n for l in links for n in l})
    assert got == {a: b for a, b in want.items() if a != b}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def frame(spark, texts):
    rows = [(3 * i + 1, t, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (10, texts[3], 1), (500_000, None, 1), (None, "null id", 1)], "doc_id long, text string, fingerprint int")


def test_simhash_classes(spark):
    docs = frame(spark, sample())
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    prints = [plain_simhash(t) for _, t in rows]
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    links = [(rows[i][0], rows[j][0]) for i in known for j in known if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = plain_classes(links, {rows[i][0] for i in known})
    got = sorted((tuple(r) for r in simhash.simhash_classes(docs).collect()), key=str)
    want = [(d, f"{p:016x}", root.get(d)) for (d, _), p in zip(rows, prints)]
    assert sorted(((d, f, c) for d, f, c in got if d is not None), key=str) == sorted((w for w in want if w[0] is not None), key=str)
    assert len(got) == len(rows) and simhash.simhash_classes(docs.limit(0)).count() == 0


def jaccard(a, b):
    x, y = set(plain_shingles(a, 5)), set(plain_shingles(b, 5))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_are_found_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_MOST", 16)
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(60, 400)) for _ in range(40)]
    for t in texts[:12]:
        for _ in range(6):
            words = t.split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "new" + str(rng.random())
            texts.append(" ".join(words))
    texts += [texts[0]] * 30 + ["", "", "short text"]
    docs = frame(spark, texts)
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None]
    near = [(a, b) for a, s in rows for b, t in rows if a < b and jaccard(s, t) >= 0.8]
    loose = [(a, b) for a, s in rows for b, t in rows if a < b and jaccard(s, t) >= 0.65]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(docs).collect()}
    assert all(got[a] == got[b] for a, b in near)
    root = plain_classes(loose, {d for d, _ in rows})
    assert all(root[d] == root[c] for d, c in got.items())
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and set(got.values()) == {d for d in ids if d is not None}


def test_near_duplicate_classes_are_chains_of_exact_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_MOST", 16)
    rng = random.Random(21)
    texts = ["", "one", "one two", "some five words of text"]
    for i in range(60):
        words = [str(rng.random()) for _ in range(200)]
        texts.append(" ".join(words))
        # Replacing every word from some place on leaves similarities from 0.66 to 0.9.
        for _ in range(2):
            kept = 196 * 2 * (s := 0.66 + 0.24 * i / 59) / (1 + s)
            n = round(kept) + 4
            texts.append(" ".join(words[:n] + [str(rng.random()) for _ in range(200 - n)]))
    words = texts[4].split()
    texts += [" ".join([*words[:at], "changed", *words[at + 1 :]]) for at in range(20, 180, 4)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    links = [(a, b) for a, s in rows for b, t in rows if a < b and jaccard(s, t) >= 0.8]
    root = plain_classes(links, range(len(texts)))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(docs).collect()} == root


@pytest.mark.parametrize("fake", [lambda hashes: len(hashes) - 96, lambda hashes: 0])
def test_simhash_neighbours_need_not_resemble_their_first(spark, monkeypatch, fake):
    monkeypatch.setattr(simhash, "simhash", fake)
    monkeypatch.setattr(simhash, "BANDS", 0)
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(102)]
    texts = [" ".join(str(rng.random()) for _ in range(100)), " ".join(words[:101]), " ".join(words)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(docs).collect()} == {0: 0, 1: 1, 2: 1}


def test_fingerprints_match_texts(spark):
    docs = frame(spark, sample())
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    rows = [r for r in rows if r[0] != 10]  # ids that repeat are ordered by a hash
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs.filter("doc_id IS NULL OR doc_id <> 10")).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, nxt = map(fingerprints.fingerprint, (text, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.packed(own), fingerprints.packed(other))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, other), fingerprints.likeness(own, nxt))
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    assert fingerprints.fingerprint_documents(docs.filter("doc_id = 4")).first().near_next == 1.0
    assert fingerprints.fingerprint_documents(docs).count() == docs.count()


def test_likeness_is_unbiased():
    rng = random.Random(4)
    errors = []
    for _ in range(150):
        words = [str(rng.random()) for _ in range(400)]
        changed = words[: rng.randint(50, 400)]
        changed += [str(rng.random()) for _ in range(400 - len(changed))]
        a, b = " ".join(words), " ".join(changed)
        errors.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
