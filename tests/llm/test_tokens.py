"""Tokens against whole-text encoding, shards against the same, packing against exhaustive search."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from tidemark.llm import packing, token_files, tokens

VOCABULARIES = {"space": public_tokenizers.path("byte_bpe_50k.json"), "white": public_tokenizers.path("word_bpe_49k.json")}
PARTS = ["the", "Thntble", " ", "  ", "\n", "\n ", " \n", "\t", "é", "é", "́", "don't", "'s", "12", "3.5", ",", "!!", " ", " ", "\x1c", "\x85", "ß", "İ", "<|endoftext|>", "日本", "🙂", "a b c"]


@pytest.mark.parametrize("cut", ["space", "white"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_whole_texts(cut, texts):
    ids, places = tokens.encoder(VOCABULARIES[cut], cut).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == whole(cut, texts)


LIBRARY = {cut: Tokenizer.from_file(path) for cut, path in VOCABULARIES.items()}


def whole(cut, texts):
    """Ids from the library alone, as it comes."""
    return [LIBRARY[cut].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("cut", ["space", "white"])
def test_a_full_memo_keeps_what_is_used_often(cut, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 60)
    monkeypatch.setattr(tokens, "MEMO_WORDS", 20)
    rng = random.Random(3)
    encoder = tokens.Encoder(VOCABULARIES[cut], cut)
    kept = []
    for _ in range(60):
        new = ["".join(rng.choice("abcéñ") for _ in range(6)) + rng.choice(["", ",", "'s", "9"]) for _ in range(15)]
        texts = ["often seen, often", " ".join(rng.sample(new, 15)), "Often " + " ".join(new[:5]), ""]
        ids, places = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == whole(cut, texts)
        assert len(encoder.memo.place) <= 60 + 40 and sorted(encoder.memo.place.values()) == list(range(len(encoder.memo.place)))
        if encoder.memo.uses.max() > 1:
            kept.append((" often" if cut == "space" else "often") in encoder.memo.place)
    assert kept and all(kept)


def test_a_memo_of_equally_used_pieces_gets_smaller_too():
    memo = tokens.Memo()
    memo.add([str(i) for i in range(tokens.MEMO_PIECES + 2)], np.ones(tokens.MEMO_PIECES + 2, np.int64), np.zeros(tokens.MEMO_PIECES + 2, np.uint16))
    memo.uses[: tokens.MEMO_PIECES + 2] = 5
    memo.uses[7], memo.flat[7] = 6, 77
    memo.thin()
    assert list(memo.place) == ["7"] and memo.ids(0) == np.uint16(77).tobytes()


def test_added_tokens_in_a_text_have_their_own_ids():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|", "plain"]
    for cut, known in (("space", {50256}), ("white", {49406, 49407})):
        ids, places = tokens.encoder(VOCABULARIES[cut], cut).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == whole(cut, texts)
        assert known <= set(ids.tolist())


def test_ranges_of_a_shard_are_read_alike_with_and_without_mapping(spark, tmp_path, monkeypatch):
    manifest = token_files.write_shards(rows_of(spark).repartition(3), f"file://{tmp_path}/t", VOCABULARIES["white"], "white", 1).collect()
    for row in manifest:
        mapped = token_files.Shard(row.path, f"file://{tmp_path}/t")
        store = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
        monkeypatch.setattr(token_files, "opened", lambda folder, store=store: (store, folder))
        ranged = token_files.Shard(row.path, "")
        monkeypatch.undo()
        assert (mapped.n_docs, mapped.n_ids, mapped.width) == (ranged.n_docs, ranged.n_ids, ranged.width) == (row.n_docs, row.n_ids, 2)
        assert mapped.doc_ids(0, row.n_docs).tolist() == ranged.doc_ids(0, row.n_docs).tolist()
        for i in range(row.n_docs):
            assert mapped.document(i).tolist() == ranged.document(i).tolist() and mapped.document(i)[-1] == 1
        for most in (1, 4, 1 << 21):
            monkeypatch.setattr(token_files, "READ_IDS", most)
            parts = list(ranged.documents(ranged.offsets(0, row.n_docs + 1)))
            assert [p.tolist() for p in parts] == [mapped.document(i).tolist() for i in range(row.n_docs)]
            monkeypatch.undo()


def test_what_failed_attempts_left_is_deleted(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = spark.createDataFrame(token_files.write_shards(rows_of(spark), folder, VOCABULARIES["white"], "white", 1).collect(), token_files.MANIFEST)
    (tmp_path / "t/shard-000000-dead.tok").write_bytes(b"half")
    token_files.keep_named(manifest, folder)
    assert sorted(str(p) for p in (tmp_path / "t").glob("*.tok")) == sorted(r.path for r in manifest.collect())
    token_files.keep_named(manifest.limit(0), f"file://{tmp_path}/none")


def rows_of(spark):
    texts = [None, "", "one two three " * 900, "Él dijo:  hola <|endoftext|> x", "same", "same"]
    return spark.createDataFrame([(i if i < 5 else 4, t, 0) for i, t in enumerate(texts)] + [(None, "lost id", 0)], "doc_id long, text string, start int")


def test_token_files_round_trip(spark):
    got = token_files.tokenize_to_files(rows_of(spark), VOCABULARIES["white"]).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in rows_of(spark).collect()), key=lambda x: (x[0] is not None, x[0]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.append(whole("white", [text])[0], 1).astype("<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_files.tokenize_to_files(rows_of(spark).limit(0), VOCABULARIES["white"]).count() == 0


def test_packing_is_gapless_and_whole(spark):
    rows = packing.pack(rows_of(spark), VOCABULARIES["space"], capacity=64, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4")) == r.ids_crc32 and len(r.ids) == r.length <= 64
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= 64
    long = sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.piece)
    assert all(r.length == 64 for r in long[1:]) and [r.start for r in long] == np.cumsum([0] + [r.length for r in long])[:-1].tolist()
    assert sum((r.ids for r in long), []) == [*whole("space", ["one two three " * 900])[0], 0]
    assert packing.pack(rows_of(spark).limit(0), VOCABULARIES["space"]).count() == 0


def fewest(items, capacity):
    best = [len(items)]

    def search(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for free in {b for b in bins if b >= items[i]}:
            k = bins.index(free)
            search(i + 1, [*bins[:k], free - items[i], *bins[k + 1 :]])
        search(i + 1, [*bins, capacity - items[i]])

    search(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.choice((10, 20, 50))
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        count = np.bincount(items, minlength=capacity + 1)
        fixed, rest = packing.reduce_by_dominance(count, capacity)
        left = [x for x in range(capacity, 0, -1) for _ in range(rest[x])]
        assert sum(g.count for g in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
        groups = packing.solve(dict(enumerate(count.tolist())), capacity)
        held = np.zeros(capacity + 1, dtype=int)
        for g in groups:
            assert sum(x * n for x, n in g.runs) == capacity - g.free
            for x, n in g.runs:
                held[x] += n * g.count
        assert held.tolist() == count.tolist()
