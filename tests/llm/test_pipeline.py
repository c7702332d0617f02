"""The corpus pipeline on a small fixture against plain versions of its stages, and on empty input."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_contamination import plain_rows
from tests.llm.test_near import jaccard
from tests.llm.test_spans import plain_pii
from tidemark.llm import pii, tokens
from tidemark.llm.queries import vocabulary

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices(("er", "on", "th", "an", "re", "st"), k=rng.randint(2, 5))) for _ in range(n))
    texts = [prose(rng.randint(30, 200)) for _ in range(60)]
    for i in range(0, 60, 2):
        words = texts[i].split()
        words.insert(rng.randrange(len(words)), "nasty")
        words.insert(rng.randrange(len(words)), "nastier")
        texts.append(" ".join(words))  # toxic
    items = [(i, prose(20)) for i in range(5)]
    clean = [prose(rng.randint(60, 200)) for _ in range(40)]
    copies = [t for t in clean[:8] for _ in range(3)] + [" ".join(t.split()[:-1] + ["edited"]) for t in clean[8:16]]
    leaked = [t + " " + items[i % 5][1] for i, t in enumerate(prose(50) for _ in range(10))]
    private = [prose(20) + f" mail a{i}@example.com call +1 (555) 010-44{i:02} " + prose(5) for i in range(10)]
    texts += clean + copies + leaked + private + [None, "", prose(3000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 90)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    stage = dict(corpus_pipeline.STAGES)
    before = rows(kept)

    kept = stage["toxicity"](spark, kept, sf_dir)
    after = rows(kept)
    assert kept.columns == columns and set(before) - set(after) == {d for d, t in before.items() if "nast" in (t or "")}

    kept, before = stage["near_duplicates"](spark, kept, sf_dir), after
    after = rows(kept)
    gone = set(before) - set(after)
    same = lambda a, b: jaccard(a or "", b or "") >= 0.8
    assert kept.columns == columns and gone == {d for d, t in before.items() if any(e < d and same(t, u) for e, u in before.items())}

    kept, before = stage["decontamination"](spark, kept, sf_dir), after
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    after = rows(kept)
    assert kept.columns == columns and set(before) - set(after) == {r[0] for r in plain_rows(before.items(), items) if r[5]}

    kept, before = stage["pii"](spark, kept, sf_dir), after
    after = rows(kept)
    assert kept.columns == columns
    assert after == {d: t if t is None else pii.masked(t, plain_pii(t)) for d, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)

    pieces = stage["packing"](spark, kept, sf_dir).collect()
    encoder = tokens.encoder(vocabulary("byte_bpe_50k.json"), "space")
    sizes = {d: len(encoder.encode_whole([t or ""])[0]) + 1 for d, t in after.items()}
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    assert len({r.sequence_id for r in pieces}) == -(-sum(sizes.values()) // 2048)  # as few as can be, here

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
