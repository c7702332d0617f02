"""FM-index and decontamination against direct search."""

import hashlib
import random
import re

import numpy as np

from tidemark.llm import contamination, fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_rows(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, own = plain_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    own |= found
        own = sorted(str(x) for x in own if x is not None)
        yield doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    for n, most in ((1, 1), (50, 2), (400, 3), (3000, 40), (64, 63)):
        text = rng.integers(1, most + 1, n)
        index = fmindex.FMIndex(text, most)
        assert sorted(range(n + 1), key=lambda i: [*text[i:], 0]) == fmindex.suffix_array(np.append(text, 0)).tolist()
        for size in (1, 2, 4):
            phrases = rng.integers(1, most + 1, (60, size))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high):
                want = [i for i in range(n - size + 1) if (text[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def fixture():
    rng = random.Random(6)
    vocabulary = ["the", "of", "Énd", "x1", "öl"] + ["w%d" % i for i in range(60)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(rng.randint(11, 40))) for i in range(25)] + [(30, "only three rare"), (31, "..."), (32, None), (None, prose(14)), (2, prose(20))]
    docs = [(0, None), (1, ""), (2, "!?"), (3, "Only, THREE-rare words")]
    for i in range(60):
        text = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            piece = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 8)
            text += rng.choice((" ", ", ", ".\n", " zz ")) + " - ".join(piece[a : a + rng.randint(5, 25)]).upper() + " " + prose(5)
        docs.append((10 + i, text))
    docs += [(200, docs[20][1] * 30), (200, docs[20][1] * 30), (None, items[0][1])]
    return docs, items


def test_rows_equal_direct_search(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(*i, 1) for i in items * 2], "item_id long, text string, doc_id int")
    want = sorted(plain_rows(docs, items), key=str)
    for block_chars in (contamination.BLOCK_CHARS, 300):
        got = contamination.find_contamination(frame, bench, block_chars=block_chars).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == want
        for r in got:
            assert sum(int(b) - int(a) for a, b in (s.split(":") for s in r.spans.split(",") if s)) == r.n_hit
    kept = contamination.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_empty_tables(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination.find_contamination(frame.limit(0), bench).count() == 0
    assert contamination.find_contamination(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination.drop_contaminated(frame, bench.limit(0)).count() == len(docs)
