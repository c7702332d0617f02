"""Avro records of plain fields in Arrow batches: for sessions without Spark's Avro package.

A schema is the JSON of a record whose fields are null, boolean, int, long, float, double, bytes, string, an enum, or a
union of these. A reader is made for each pair of a writer's and a reader's schema: fields go by name or by the
reader's aliases, one that the writer lacks takes its default, or null where it may be; a number may widen.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

#: What a writer's type may be read as.
_WIDER = {
    "int": ("long", "float", "double"),
    "long": ("float", "double"),
    "float": ("double",),
    "string": ("bytes",),
    "bytes": ("string",),
}


class BadRecord(ValueError):
    """Bytes that are no record of the schema."""


def _zigzag(value: int) -> bytes:
    n, out = (value << 1) ^ (value >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadRecord("a number has no end")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


def _bytes(data: bytes, at: int) -> tuple[bytes, int]:
    size, at = _number(data, at)
    if size < 0 or at + size > len(data):
        raise BadRecord("a text is longer than the message")
    return data[at : at + size], at + size


def _fixed(form: str) -> Callable[[bytes, int], tuple]:
    size = struct.calcsize(form)

    def read(data: bytes, at: int) -> tuple:
        if at + size > len(data):
            raise BadRecord("the message ends early")
        return struct.unpack_from(form, data, at)[0], at + size

    return read


def _text(data: bytes, at: int) -> tuple[str, int]:
    found, at = _bytes(data, at)
    try:
        return found.decode(), at
    except UnicodeDecodeError as e:
        raise BadRecord("a text is not UTF-8") from e


_READ: dict[str, Callable[[bytes, int], tuple]] = {
    "null": lambda data, at: (None, at),
    "boolean": _fixed("<?"),
    "int": _number,
    "long": _number,
    "float": _fixed("<f"),
    "double": _fixed("<d"),
    "bytes": _bytes,
    "string": _text,
}
_WRITE: dict[str, Callable[[object], bytes]] = {
    "null": lambda v: b"",
    "boolean": lambda v: b"\1" if v else b"\0",
    "int": _zigzag,
    "long": _zigzag,
    "float": lambda v: struct.pack("<f", v),
    "double": lambda v: struct.pack("<d", v),
    "bytes": lambda v: _zigzag(len(v)) + v,
    "string": lambda v: _zigzag(len(b := v.encode())) + b,
}


def _kind(spec) -> str:
    return spec if isinstance(spec, str) else spec["type"]


def _branches(spec) -> list:
    return spec if isinstance(spec, list) else [spec]


def _value_reader(spec) -> Callable[[bytes, int], tuple]:
    if isinstance(spec, list):
        readers = [_value_reader(s) for s in spec]

        def union(data: bytes, at: int) -> tuple:
            which, at = _number(data, at)
            if not 0 <= which < len(readers):
                raise BadRecord("no such branch of a union")
            return readers[which](data, at)

        return union
    if _kind(spec) == "enum":
        symbols = spec["symbols"]

        def enum(data: bytes, at: int) -> tuple:
            which, at = _number(data, at)
            if not 0 <= which < len(symbols):
                raise BadRecord("no such symbol")
            return symbols[which], at

        return enum
    return _READ[_kind(spec)]


def _convert(written, wanted) -> Callable[[object], object]:
    """From a value as written to one of the reader's type."""
    kinds = {_kind(s) for s in _branches(wanted)}
    symbols = next((s for s in _branches(wanted) if _kind(s) == "enum"), None)

    def fits(kind: str) -> bool:
        return kind in kinds or kind == "enum" and "string" in kinds or any(w in kinds for w in _WIDER.get(kind, ()))

    if not all(fits(_kind(s)) for s in _branches(written) if _kind(s) != "null" or len(_branches(written)) == 1):
        raise ValueError(f"{written} cannot be read as {wanted}")

    def convert(value):
        if value is None:
            if "null" not in kinds:
                raise BadRecord("a null where the reader has none")
            return None
        if symbols and "string" not in kinds and value not in symbols["symbols"]:
            if "default" not in symbols:
                raise BadRecord(f"{value!r} is no symbol of the reader's")
            return symbols["default"]
        if isinstance(value, bytes) and "bytes" not in kinds:
            return _text(_zigzag(len(value)) + value, 0)[0]
        if isinstance(value, str) and not kinds & {"string", "enum"}:
            return value.encode()
        if isinstance(value, int) and not isinstance(value, bool) and not kinds & {"int", "long"}:
            return float(value)
        return value

    return convert


def reader(written: str, wanted: str) -> Callable[[bytes], list]:
    """A function from a record's bytes to its values in the order of the schema ``wanted``; ``BadRecord`` if they are none."""
    fields, wish = json.loads(written)["fields"], json.loads(wanted)["fields"]
    place = {f["name"]: i for i, f in enumerate(fields)}
    readers = [_value_reader(f["type"]) for f in fields]
    take: list[tuple[int | None, object]] = []
    for f in wish:
        at = next((place[n] for n in (f["name"], *f.get("aliases", ())) if n in place), None)
        if at is not None:
            take.append((at, _convert(fields[at]["type"], f["type"])))
        elif "default" in f or any(_kind(s) == "null" for s in _branches(f["type"])):
            take.append((None, f.get("default")))
        else:
            raise ValueError(f"the writer has no {f['name']!r}, and it has no default")

    def read(data: bytes) -> list:
        at, values = 0, []
        for r in readers:
            value, at = r(data, at)
            values.append(value)
        if at != len(data):
            raise BadRecord("the message goes on after its record")
        return [x if i is None else x(values[i]) for i, x in take]

    return read


def writer(schema: str) -> Callable[[dict], bytes]:
    """A function from a record's values by name to its bytes; a missing name takes its default or null."""
    fields = json.loads(schema)["fields"]

    def value(spec, v) -> bytes:
        if isinstance(spec, list):
            which = next((i for i, s in enumerate(spec) if (_kind(s) == "null") == (v is None)), None)
            if which is None:
                raise ValueError(f"{v!r} is none of {spec}")
            return _zigzag(which) + value(spec[which], v)
        if _kind(spec) == "enum":
            return _zigzag(spec["symbols"].index(v))
        if v is None and _kind(spec) != "null":
            raise ValueError(f"null is no {_kind(spec)}")
        return _WRITE[_kind(spec)](v)

    return lambda row: b"".join(value(f["type"], v if (v := row.get(f["name"])) is not None else f.get("default")) for f in fields)
