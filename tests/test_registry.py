"""Avro records, registered schemas and framed messages."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import avro, registry
from tidemark.sources.tables import TableIO

record = lambda *fields: json.dumps({"type": "record", "name": "R", "fields": [dict(zip(("name", "type", "default"), f, strict=False)) for f in fields]})
PLAIN = record(("a", "long"), ("b", ["null", "string"]), ("c", {"type": "enum", "name": "E", "symbols": ["X", "Y"]}), ("d", "double"), ("e", "boolean"), ("f", "bytes"), ("g", "int"), ("h", ["string", "null"]))


@settings(max_examples=200, deadline=None)
@given(st.tuples(st.integers(-(2**63), 2**63 - 1), st.none() | st.text(), st.sampled_from("XY"), st.floats(allow_nan=False), st.booleans(), st.binary(), st.integers(-(2**31), 2**31 - 1), st.none() | st.text()))
def test_records_come_back(values):
    data = avro.writer(PLAIN)(dict(zip("abcdefgh", values, strict=True)))
    read = avro.reader(PLAIN, PLAIN)
    assert tuple(read(data)) == values
    for broken in (data[:-1], data + b"\0"):
        with pytest.raises(avro.BadRecord):
            read(broken)


def test_bytes_are_those_of_the_specification():
    assert avro.writer(record(("a", "long"), ("b", "string")))({"a": 27, "b": "foo"}) == bytes.fromhex("3606666f6f")
    assert avro.writer(record(("a", "long")))({"a": -64}) == b"\x7f" and avro.writer(record(("a", "long")))({"a": 64}) == b"\x80\x01"
    assert avro.writer(record(("a", ["null", "string"])))({"a": "a"}) == bytes.fromhex("020261")


def test_a_reader_resolves_other_versions():
    old, new = record(("id", "int"), ("gone", "string"), ("n", "int")), json.dumps({"type": "record", "name": "R", "fields": [{"name": "n", "type": ["null", "double"]}, {"name": "key", "aliases": ["id"], "type": "long"}, {"name": "more", "type": "string", "default": "?"}, {"name": "none", "type": ["null", "long"]}]})
    assert avro.reader(old, new)(avro.writer(old)({"id": 3, "gone": "x", "n": 4})) == [4.0, 3, "?", None]
    with pytest.raises(ValueError, match="no default"):
        avro.reader(old, record(("other", "string")))
    with pytest.raises(ValueError, match="cannot be read"):
        avro.reader(old, record(("gone", "long")))
    enum = lambda *s, **more: record(("e", {"type": "enum", "name": "E", "symbols": list(s), **more}))
    data = avro.writer(enum("A", "B"))({"e": "B"})
    assert avro.reader(enum("A", "B"), enum("A", default="A"))(data) == ["A"] and avro.reader(enum("A", "B"), record(("e", "string")))(data) == ["B"]
    with pytest.raises(avro.BadRecord):
        avro.reader(enum("A", "B"), enum("A"))(data)


def test_registry_gives_ids_and_refuses_breaks(spark, tmp_path):
    own = registry.SchemaRegistry(TableIO(str(tmp_path / "schemas")))
    first, second = record(("a", "long")), record(("a", "long"), ("b", ["null", "string"], None))
    assert [own.register(spark, "s", x) for x in (first, second, first)] == [1, 2, 1]
    assert own.register(spark, "t", second) == 2 and own.latest(spark, "s")[0] == 2 and set(own.schemas(spark)) == {1, 2}
    with pytest.raises(ValueError, match="cannot be read"):
        own.register(spark, "s", record(("a", "string")))
    with pytest.raises(KeyError):
        own.latest(spark, "u")


def test_bad_frames_become_error_rows(spark):
    good = b"\0" + (1).to_bytes(4, "big") + avro.writer(record(("a", "long")))({"a": 5})
    rows = [(1, good), (2, None), (3, b""), (4, b"\0\0\0\0"), (5, b"\1" + good[1:]), (6, good[:1] + b"\0\0\0\7" + good[5:]), (7, good + b"x"), (8, good[:5]), (9, b"\0\xff\xff\xff\xff\2")]
    df = spark.createDataFrame(rows, "offset int, value binary")
    found = {r.offset: (r.error, r.a, r.value is None) for r in registry.unframed(df, {1: record(("a", "long"))}, record(("a", "long"))).collect()}
    assert found[1] == (None, 5, True)
    assert [found[i][0] for i in (2, 3, 4)] == ["Short message"] * 3 and found[5][0] == "Bad magic byte"
    assert found[6][0] == "Unknown schema 7" and found[9][0] == "Unknown schema 4294967295"
    assert found[7][0].startswith("Bad record: ") and found[8][0].startswith("Bad record: ") and not found[7][2]
    assert registry.unframed(df.limit(0), {}, record(("a", "long"))).count() == 0
    with pytest.raises(ValueError, match="both"):
        registry.unframed(df.withColumnRenamed("offset", "a"), {}, record(("a", "long")))
