"""Language codes, ordinal regression and boosted trees: held-out accuracy and odd rows."""

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import boosting, language, toxicity

DATA = "/root/testdata/sf0.1"


def test_codewords_are_apart():
    splits = {tuple(s * s[0]) for s in language.codewords(4).T}
    assert splits == {(1, *b) for b in product((1, -1), repeat=3) if -1 in b}  # of four languages every split
    for n in (2, 3, 4, 6, 9, 30, 300):
        code = language.codewords(n)
        distance = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert distance == language.least_distance(code) and distance >= (1 if n < 4 else 0.28 * code.shape[1])
    for n in (1, 2, 3, 4, 6, 9, 30):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
        assert n == 1 or (np.abs(code.sum(axis=0)) < n).all()


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_languages_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, "the house of the rising sun " * 3, "en", 1) for i in range(1, 40)] + [(i, "das haus der aufgehenden sonne " * 3, "de", 1) for i in range(40, 80)] + [(100, None, "en", 1), (101, "12 !", "en", 1), (102, "", None, 1), (None, "das haus der sonne", None, 1), (103, "x", None, 1)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[None].lang_pred == "de" and got[1].lang_pred == "en"
    assert language.identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify_languages(docs.filter("doc_id > 99")).collect()} <= {"und", "en"}


def test_rare_languages_are_learned_however_many(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 300)
    rows = [(900 * k + i, f"l{k}", f"{chr(0x4E00 + 7 * k)}{chr(0x5E00 + 11 * k)} " * 20) for k in range(230) for i in range(30 if k < 200 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    codes = language.fit(docs)
    assert set(codes.languages) == {r.lang for r in docs.filter(~language.held_out()).select("lang").distinct().collect()}
    got = language.identify(docs, codes).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_decoding_equals_the_sums_of_weighted_losses():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 12)).astype(np.float32)
    codes = language.Codes.fit(x, [f"l{i % 5}" for i in range(40)])
    best, p = codes.decode(x)
    for row, k, share in zip(x, best, p):
        distance = []
        for word in codes.code:
            terms = [w * np.exp(-2 * np.clip(float(row @ codes.weights[:, j]), -1, 1) * bit) for j, (w, bit) in enumerate(zip(codes.bit_weight, word))]
            distance.append(sum(terms) / sum(codes.bit_weight))
        near = np.exp(-4 * np.array(distance))
        assert int(np.argmin(distance)) == k and abs(near.max() / near.sum() - share) < 1e-4


def test_a_text_without_a_letter_is_undetermined(spark):
    rows = [(i, "the house of the rising sun", "en") for i in range(40)] + [(100, "½ ² Ⅷ 12", "en"), (101, "٣", None), (102, "ª", None), (7, "the house of the rising sun", "en")]
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100], got[101], got[102], got[7]) == ("und", "und", "en", "en")


def test_toxicity_on_unseen_labels(spark):
    """Two thousand labels, of which two hundred toxic, teach this much; check_s's ten times as many teach all."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    unseen = labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "label")
    rows = toxicity.score(docs.join(unseen.select("doc_id"), "doc_id", "left_semi"), model).join(unseen, "doc_id").select("severity", "grade", "toxic", "p_toxic", "label").collect()
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in rows)
    recall = np.mean([r[2] for r in rows if r.label])
    false = np.mean([r[2] for r in rows if not r.label])
    assert recall > 0.9 and false < 0.04


def test_scores_equal_the_cumulative_link_formula(spark):
    model = toxicity.Ordinal(["vile", "vile-", toxicity.LENGTH], np.array([1.5, 0.5, -0.2]), np.array([0.5, 1.5, 2.5]), 0.6)
    texts = ["a vile vileness", "", "kind words only", "VILE " * 400_000, "a vile vileness"]
    got = {(r.doc_id, r.severity): r for r in toxicity.score(spark.createDataFrame([*enumerate(texts), (4, "a vile vileness"), (9, None)], "doc_id long, text string"), model).collect()}
    assert len(got) == 6  # the repeated row has an equal result
    for doc_id, text in [*enumerate(texts), (9, "")]:
        words = text.lower().split()
        counts = (words.count("vile"), sum(w.startswith("vile") for w in words), len(words))
        margin = sum(w * np.log1p(c) for w, c in zip(model.weights, counts))
        p = [1 / (1 + np.exp(-(margin - t))) for t in model.thresholds]
        row = next(r for (d, _), r in got.items() if d == doc_id)
        each = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert abs(row.severity - sum(p)) < 1e-6 and row.grade == int(np.argmax(each)) and row.toxic == (p[0] >= 0.6)


def test_toxicity_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("you vile creature, vileness " if i % 2 else "a kind word ") + " ".join(f"w{i * j}" for j in range(1, 30)), 3) for i in range(1, 60)] + [(100, None, 1), (101, "", 1), (None, "vile vile", 1), (1, "vile vile vile", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 60)] + [(2, 1, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[None].toxic and not by[100].toxic and not by[101].toxic and not by[4].toxic
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and {100, 101, 4} <= {r.doc_id for r in kept.collect()} and 1 not in {r.doc_id for r in kept.collect()}
    assert toxicity.score_toxicity(docs, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_design_counts_words_and_stems():
    x = toxicity.design(pa.array(["Vile, VILENESS été", "", "été"]), ["vile", "vile-", "vilen-", "été"])
    dense = np.zeros((3, 4))
    dense[x.row, x.column] = np.expm1(x.value).round()
    assert dense.tolist() == [[1, 2, 1, 1], [0, 0, 0, 0], [0, 0, 0, 1]]


def test_equal_scores_are_calibrated_as_one():
    fitted = boosting.Isotonic.fit(np.array([0.0, 0, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert fitted(np.array([0.0, 0.5, 1])).tolist() == [0.5] * 3
    fitted = boosting.Isotonic.fit(np.array([0.0, 0, 1, 2, 3, 3]), np.array([0.0, 0, 1, 0, 1, 1]))
    assert fitted(np.array([-1.0, 0, 1, 1.5, 2, 3, 9])).tolist() == [0, 0, 0.5, 0.5, 0.5, 1, 1]


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.BoostedTrees.fit(x[:1000], y[:1000])
    margin = trees.margin(x[1000:])
    assert ((margin > 0) == (y[1000:] > 0)).mean() > 0.95
    p = boosting.Isotonic.fit(margin, y[1000:])(margin)
    assert (np.diff(p[np.argsort(margin)]) >= -1e-12).all() and abs(p.mean() - y[1000:].mean()) < 0.05


@pytest.mark.parametrize("text", ["", " ", "é", "a" * 5_000_000])
def test_features_of_any_length(text):
    x = language.features(text)
    assert x.shape == (language.BUCKETS,) and np.isfinite(x).all()
