"""Secret scanning: Aho-Corasick keywords, anchored expressions at hits, embedded checksums.

One pass of the automaton over the lower-cased text finds every keyword. Only there an
expression is tried, anchored at the hit, so its cost does not depend on the text between
hits. Formats that carry a checksum or an encoded header are kept only if it verifies.
Runs of hexadecimal digits have no keyword; they are found by one linear scan.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, steps

KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE_KINDS = KINDS[:3]

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_KEYWORDS = {w: "assign" for w in _ASSIGN_WORDS} | {"akia": "access", "npm_": "npm", "eyj": "jwt"} | {w: "github" for w in _GITHUB_PREFIXES}
_ANCHORED = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
_PART, _TAIL = re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_IN = "[0-9a-f]{24}"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base62_crc(body: str) -> str:
    """The six base-62 digits of the body's CRC-32 that such tokens end with."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits


def _verifies(kind: str, match: re.Match) -> bool:
    found = match.group()
    if kind == "assign":
        return len(match.group(2)) >= 6
    if kind == "access":
        return len(found) >= 20
    if kind in ("github", "npm"):
        return base62_crc(found[4:-6]) == found[-6:]
    head = found.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


class _Tails:
    """Whether a token's first part, the run of ``_PART`` signs that a place is in, is followed by the two others.

    That depends on where the run ends alone, so each run is read once, however many hits are in it.
    """

    def __init__(self, text: str):
        self.text, self.end, self.sound = text, -1, False

    def may_match(self, start: int) -> bool:
        if start >= self.end:
            self.end = _PART.match(self.text, start).end()
            self.sound = _TAIL.match(self.text, self.end) is not None
        return self.sound


def find_secrets(text: str, automaton: ahocorasick.Automaton, hex_runs: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed.

    Per kind matches are leftmost and do not overlap; one that fails its check still
    occupies its text. ``hex_runs`` may be False for a text known to have none.
    """
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in automaton.iter(lower):
        hits.setdefault(kind, []).append(last - length + 1)
    found = []
    for kind, starts in hits.items():
        expression, free = _ANCHORED[kind], 0
        tails = _Tails(text) if kind == "jwt" else None
        for start in sorted(starts):
            if start >= free and (tails is None or tails.may_match(start)) and (match := expression.match(text, start)):
                free = match.end()
                if _verifies(kind, match):
                    found.append((kind, start, free))
    if hex_runs:
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in steps(batches):
        texts = batch.column(1)
        has_hex = pc.match_substring_regex(texts, _HEX_IN).to_pylist()
        rows: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for text, may_hex in zip(texts.to_pylist(), has_hex, strict=True):
            spans = find_secrets(text, automaton, may_hex)
            base = [s for s in spans if s[0] in BASE_KINDS]
            for kind in BASE_KINDS:
                rows[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(spans))
        counts = [pa.array(rows[f"n_{kind}"], pa.int64()) for kind in BASE_KINDS]
        strings = [pa.array(rows[c], pa.string()) for c in ("base_sha256", "spans")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *strings], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row for each document: counts by base kind, digest of the base spans, all spans.

    Null or empty text: no spans. One narrow pass, no shuffle; repeated rows and ties are
    independent rows. A text of any length is scanned in time linear in it.
    """
    return id_and_text(docs).mapInArrow(_scan, SCHEMA)
