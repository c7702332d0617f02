"""Personal data: candidate spans from high-recall generators, chosen by boosted trees.

Three steps for each text:

1. the base rules (email, ip, card, phone) give spans that always stay;
2. generators of high recall propose further, overlapping candidates: written-out or
   bracketed addresses of any length, defanged addresses, version 6 addresses in full or with
   ``::``, card numbers with other separators and groups, telephone numbers without a leading
   plus. Of a run of digit groups several stretches are proposed;
3. boosted trees score each candidate from its format and its context, an isotonic map makes
   the score a probability, and a candidate is taken at the threshold of its kind.

The trees are fitted on candidates found in sentences composed from a fixed seed
(``TRAIN_SENTENCES`` of them), so the model needs no labelled corpus, is the same on every
run, and is a few kilobytes in size. A half of the sentences is for the trees, a quarter for
the isotonic map, and a quarter, which neither has seen, for the thresholds: the lowest
probability at which precision reaches ``PRECISION``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .boosting import BoostedTrees, Isotonic
from .common import id_and_text, steps

KINDS = ("email", "ip", "card", "phone")
TRAIN_SENTENCES = 8_000
PRECISION = 0.98
CONTEXT = 32

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so none can start inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: In which texts each base rule can match at all; evaluated on whole Arrow columns.
_MAY = {
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
#: The sign between the two parts of an address, and a domain with its dots written in any way.
_AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?|\s{1,2}at\s{1,2}", re.IGNORECASE | re.ASCII)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]+)+", re.IGNORECASE | re.ASCII)
_DEFANGED = re.compile(r"(?<![0-9A-Za-z.:])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\.)[0-9]{1,3}){2}(?![0-9A-Za-z:])", re.ASCII)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]+(?:\.[0-9]{1,3}){0,3}(?![0-9A-Za-z])")
#: Digit groups with up to three signs between them, or one alone; any may stand in brackets.
_GROUPS = re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]+\)|[0-9]+)(?:[\x20./_-]{1,3}(?:\([0-9]+\)|[0-9]+)|(?<=\))[0-9]+|\([0-9]+\))*(?![0-9A-Za-z])")
_GROUP = re.compile(r"\(?[0-9]+\)?")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (7, 15)
#: In which texts any generator can match; white space in RE2 lacks \v.
_MAY_BE_CANDIDATE = r"(?i)[\[({\s\x0b]at[\])}\s\x0b]|@|\[\.\]|\(\.\)|\[dot\]|:[0-9a-f]{0,4}:|[0-9][)(./_ -]{0,4}[0-9][)(./_ -]{0,4}[0-9][)(./_ -]{0,4}[0-9][)(./_ -]{0,4}[0-9][)(./_ -]{0,4}[0-9][)(./_ -]{0,4}[0-9]"
_CUES = {
    "email": ("mail", "contact", "write", "reach", "schreib", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "from"),
    "card": ("card", "visa", "master", "amex", "pay", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "ring", "anruf", "llama", "appel"),
}
_ANTI = ("version", "section", "isbn", "page", "serial", "order", "ref", "date", "figure", "table", "chapter", "build", "invoice", "tracking", "item", "total", "population", "id ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _AT_DOMAIN.match(text, at) if start < at else None
        # The text between two signs is walked once, as a failing sign is no local character.
        free = match.end() if match else at + 1
        if match:
            yield "email", start, free
        at = text.find("@", free)


def base_spans(text: str, may: frozenset[str] = frozenset(("ip", "card", "phone"))) -> list[Span]:
    """Leftmost, non-overlapping spans of each kind, by kind and start. ``may``: kinds that can occur."""
    found = list(_emails(text)) if "@" in text else []
    if "ip" in may:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    if "card" in may:
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "phone" in may:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def _addresses(text: str) -> Iterator[Span]:
    free = 0
    for sign in _AT.finditer(text):
        if sign.start() < free:
            continue
        start = sign.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign.end()) if start < sign.start() else None
        # The text between two signs is walked once; a sign within a domain is part of it.
        free = domain.end() if domain else sign.end()
        if domain:
            yield "email", start, free


def _hosts(text: str) -> Iterator[Span]:
    for m in _DEFANGED.finditer(text):
        yield "ip", m.start(), m.end()
    for m in _COLONS.finditer(text):
        run = m.group()
        if run.endswith(":") and not run.endswith("::"):
            run = run[:-1]
        if 2 < len(run) <= 45 and run.count(":") >= 2:
            try:
                ipaddress.IPv6Address(run)
            except ValueError:
                continue
            yield "ip", m.start(), m.start() + len(run)


def _numbers(text: str) -> Iterator[Span]:
    """Every stretch of a run of digit groups that has a telephone number's or a card's digits. Of a run of several items, and of
    one alone, the right stretch is so among them; one start has no more stretches than a card has digits."""
    for m in _GROUPS.finditer(text):
        groups = [(g.start(), g.end(), g.end() - g.start() - (g.group()[0] == "(") - (g.group()[-1] == ")")) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _, _) in enumerate(groups):
            digits, least = 0, CARD_DIGITS[1]
            for _, end, more in groups[i:]:
                digits, least = digits + more, min(least, more)
                if digits > CARD_DIGITS[1]:
                    break
                if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                    yield "phone", start, end
                if digits >= CARD_DIGITS[0] and least >= 3 and text[start] != "(":
                    yield "card", start, end


def candidates(text: str) -> list[Span]:
    return [*_addresses(text), *_hosts(text), *_numbers(text)]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    kind, start, end = span
    inside = text[start:end]
    digits = _NOT_DIGIT.sub("", inside)
    groups = [g for g in re.split(r"[^0-9]+", inside) if g]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    near = before + " " + after
    word_tail = re.split(r"[^a-z]+", inside.lower())[-1]
    gaps = re.findall(r"[^0-9()]+", inside) if kind in ("card", "phone") else []
    return [
        float(KINDS.index(kind)),
        float(len(inside)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(set(map(len, groups)))),
        float(len({c for c in inside if not c.isalnum()})),
        float("@" in inside),
        float(bool(re.search(r"[\[({](?:at|dot|\.)[\])}]", inside, re.IGNORECASE))),
        float(bool(re.search(r"\s(?:at|dot)\s", inside, re.IGNORECASE))),
        float(len(word_tail)),
        float(luhn(digits) if digits else 0),
        float(all(len(g) < 4 and int(g) <= 255 for g in groups) if groups else 0),
        float("::" in inside),
        float(sum(c in "abcdefABCDEF" for c in inside) if kind == "ip" else 0),
        float(inside.count(":")),
        float(len(set(gaps))),
        float(max(map(len, gaps), default=0)),
        float(len(groups[-1]) if groups else 0),
        float(before.rstrip(" ./_-")[-1:].isdigit()),
        float(after.lstrip(" ./_-")[:1].isdigit()),
        float(len(re.findall(r"\.\s+[A-Z]", inside))),
        float(sum(c.isupper() for c in inside.split("@")[-1][-8:])),
        float(inside.startswith("(")),
        float(inside.startswith("00")),
        float(digits.startswith("0")),
        float(inside.startswith(("19", "20")) and len(groups[0]) == 4 if groups else 0),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(any(c in near for c in _CUES[kind])),
        float(any(c in before for c in _ANTI)),
        float(len(digits) == len(inside)),
        float(len(groups[0]) if groups else 0),
        float(gaps[0] in before[-3:] or gaps[0] in after[:3] if gaps else 0),
        float(before.endswith(("$", "€", "£", "#", "no. ", "nr. "))),
    ]


_LIST_SIGNS = (", ", "; ", " or ", " and ", "\n", "\n- ", "\n* ", " | ", ",", "\t", " / ", ",\n")


class _Composer:
    """Texts with private items, and with ones that only look like it: one or many, in prose, lists and rows of a table."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(("er", "on", "th", "an", "re", "st", "en", "la", "mi", "ch", "ou", "do"), k=self.rng.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def number(self, n: int) -> str:
        return self.rng.choice("123456789") + self.digits(n - 1)

    def email(self) -> str:
        rng, word = self.rng, self.word
        at = rng.choice((" (at) ", "[at]", " [at] ", "(at)", " at ", "{at}", " @ ", "@ "))
        dot = rng.choice((".", " dot ", "[dot]", "(dot)", " [dot] "))
        dot = " dot " if at == " at " else "[dot]" if at == "@ " else dot
        names = rng.choice("._-").join(word() + rng.choice(("", self.digits(2))) for _ in range(rng.choice((1, 2, 2, 3, 8))))
        return names + at + dot.join([*(word() for _ in range(rng.choice((1, 1, 1, 2, 5)))), rng.choice(("com", "org", "net", "de", "fr", "es", "io"))])

    def no_email(self) -> str:
        word, digits = self.word, self.digits
        return self.rng.choice((f"{word()} at {word()}. {word().title()}", f"{word()} at {word()} . {word()}", f"{word()}@ {word()}.{word()}{word()}x", f"{word()} at {word()}.{word().title()}", f"{digits(2)} at {digits(1)}.{digits(2)}", f"{word()} at {word()}. " + ". ".join(word().title() for _ in range(self.rng.randint(2, 5))), f"{word()}{self.rng.choice('-_')}{word()} at {word()}.{self.rng.choice((' ', chr(10)))}{word().title()}"))

    def ip(self) -> str:
        rng = self.rng
        gap, short = rng.choice(("[.]", "(.)", "[dot]")), lambda: f"{rng.randrange(1, 1 << rng.choice((1, 4, 8, 16, 16))):x}"
        head = rng.choice(("2001:db8", "fe80", "fd00", f"fe80:{short()}", f"{rng.randrange(8192, 16384):x}:{short()}"))
        return rng.choice((
            gap.join(str(rng.randint(1, 255)) for _ in range(4)),
            ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)),
            ":".join([*(head.split(":") * 2)[:2], *(rng.choice(("0", "0000", short())) for _ in range(5)), short()]),
            f"{head}::{short()}",
            f"{head}::{short()}:{short()}",
            f"::ffff:{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        ))

    def no_ip(self) -> str:
        rng = self.rng
        return rng.choice(("[.]".join(str(rng.randint(256, 999)) for _ in range(4)), ":".join(f"{rng.randint(0, 59):02}" for _ in range(8)), "(.)".join(str(rng.randint(300, 999)) for _ in range(4)), f"{rng.choice('abcdef')}::{rng.choice('abcdef')}", f"{rng.choice(('add', 'dec', 'ab', 'fade'))}::{rng.choice(('bad', 'ace', 'fed', 'be'))}", f"{self.digits(1)}::{self.digits(1)}"))

    def _card(self, real: bool) -> str:
        rng = self.rng
        size = rng.choice((16, 16, 16, 15, 15, 19))
        body = ("3" + rng.choice("47") if size == 15 else rng.choice("456") + self.digits(1)) + self.digits(size - 3)
        body += next(c for c in "0123456789" if luhn(body + c))
        if not real:
            body = body[:-1] + rng.choice([c for c in "0123456789" if c != body[-1]])
        cuts = (0, 4, 10, 15) if size == 15 else (*range(0, size, 4), size)
        # Whole runs of 16 to 19 digits are the base rules'; others are not.
        gaps = (".", "/", "_", " - ", "  ", " . ", " / ", " ", "-", *([""] * 4 if size == 15 else ()))
        return rng.choice(gaps).join(body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def card(self) -> str:
        return self._card(True)

    def no_card(self) -> str:
        d = self.digits
        return self.rng.choice((self._card(False), self._card(False), f"97{self.rng.choice('89')}{d(10)}", f"97{self.rng.choice('89')}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{self.number(4)} {d(4)} {d(4)} {d(4)}", f"1{d(12)}"))

    def phone(self) -> str:
        rng, d, n = self.rng, self.digits, self.number
        gap = rng.choice((" ", ".", "-", "/", " - ", " "))
        return rng.choice((
            f"({n(3)}) {n(3)}-{d(4)}", f"{n(3)}-{n(3)}-{d(4)}", f"{n(3)}.{n(3)}.{d(4)}", f"{n(3)} {n(3)} {d(4)}", f"({n(3)}){rng.choice((' ', '-', '.'))}{n(3)}{gap}{d(4)}", f"1-{rng.choice(('800', '888', n(3)))}-{n(3)}-{d(4)}", f"1 ({n(3)}) {n(3)}-{d(4)}",
            f"00{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}", gap.join([f"00{rng.randint(1, 99)}", n(rng.randint(1, 3)), *(d(rng.choice((2, 2, 3))) for _ in range(rng.randint(2, 4)))]), f"00{rng.randint(1, 99)}{gap}{n(rng.choice((2, 3)))}{gap}{d(rng.randint(5, 8))}", f"00{rng.randint(1, 99)} {n(rng.randint(9, 11))}", f"00{rng.randint(10, 99)}{n(rng.randint(8, 11))}",
            gap.join(["0" + d(rng.randint(1, 4)), *(d(rng.randint(2, 4)) for _ in range(rng.randint(2, 4)))]), f"0{d(3)}/{d(rng.randint(5, 8))}", f"0{n(rng.randint(1, 4))}{gap}{d(rng.randint(6, 9))}", f"(0{n(rng.randint(1, 4))}) {d(rng.randint(5, 8))}", f"0{n(rng.randint(8, 11))}",
        ))

    def no_phone(self) -> str:
        rng, d, n = self.rng, self.digits, self.number
        year, month, day = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
        return rng.choice((
            f"{year}-{d(4)}-{d(2)}", f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day:02}/{month:02}/{year}", f"{year}-{rng.randint(1900, 2030)}", f"{year}{month:02}{day:02}", f"{year}{month:02}{day:02}{d(rng.choice((4, 6)))}", f"{day:02}.{month:02}.{year} {rng.randint(0, 23):02}.{rng.randint(0, 59):02}", f"{year}-{month:02}-{day:02} {rng.randint(0, 23):02}.{rng.randint(0, 59):02}",
            f"{n(4)} {d(4)} {d(4)} {d(4)}", f"{n(2)}.{d(3)}.{d(3)}", f"{n(2)} {d(3)} {d(2)} {d(2)} {d(2)}", f"{n(3)} {d(3)} {d(3)}", f"{n(1)} {d(3)} {d(3)}", n(7), n(8), f"17{d(8)}", f"17{d(11)}", n(rng.randint(11, 15)), f"{n(1)}.{d(rng.randint(6, 12))}", f"0.{d(rng.randint(6, 12))}", f"{n(rng.randint(4, 7))}.{d(2)} - {n(rng.randint(4, 7))}.{d(2)}",
            " ".join(n(rng.randint(1, 4)) for _ in range(rng.randint(3, 9))), "-".join(n(rng.randint(1, 2)) for _ in range(rng.randint(5, 9))),
        ))

    def text(self) -> tuple[str, list[Span]]:
        """A text, and where its private items are."""
        rng = self.rng
        n = rng.choice((1, 1, 1, 1, 2, 2, 3, 4, rng.randint(5, 20)))
        share, kinds = rng.choice((0.0, 0.5, 0.5, 0.8, 1.0, 1.0)), rng.sample(KINDS, rng.choice((1, 1, 2, 4)))
        sign, named, cues = rng.choice(_LIST_SIGNS), rng.random() < 0.3, rng.random() < 0.4
        out, spans = self.words(rng.randint(0, 6)), []
        for i in range(n):
            kind, real = rng.choice(kinds), rng.random() < share
            lead = rng.choice((" ", ": ", ", ", "\n", sign)) if i == 0 else sign
            out += lead if out else ""
            if named:
                out += f"{self.word().title()} {self.word().title()}" + rng.choice((" ", ", ", ": ", " - ", ","))
            if cues and rng.random() < (0.8 if real else 0.15):
                out += rng.choice(_CUES[kind]) + rng.choice((" ", ": ", " is "))
            elif not real and rng.random() < 0.4:
                out += rng.choice(_ANTI).strip() + rng.choice((" ", ": "))
            item = getattr(self, kind if real else f"no_{kind}")()
            if real:
                spans.append((kind, len(out), len(out) + len(item)))
            out += item
            if rng.random() < 0.15:
                out += " " + self.words(rng.randint(1, 4))
        return out + rng.choice(("", ".", " " + self.words(rng.randint(1, 6)) + ".", "\n")), spans


@dataclass
class Selector:
    trees: BoostedTrees
    calibrated: Isotonic
    threshold: dict[str, float]

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        return self.calibrated(self.trees.margin(np.array(rows))) if rows else np.empty(0)

    def choose(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates at or above their kind's threshold that touch no base span; ties: the longer, then the earlier."""
        proposed = candidates(text)
        if not proposed:
            return []
        starts, ends = sorted(s for _, s, _ in base), sorted(e for _, _, e in base)  # of spans apart from one another, but for kinds
        chosen = []
        scores = self.probability([features(text, c) for c in proposed]).tolist()
        for score, (kind, start, end) in sorted(zip(scores, proposed, strict=True), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1][1])):
            # Those that begin before the end, less those that end by the start, touch the span.
            if score >= self.threshold[kind] and bisect_left(starts, end) == bisect_right(ends, start):
                insort(starts, start)
                insort(ends, end)
                chosen.append((kind, start, end))
        return chosen


@cache
def selector(sentences: int = TRAIN_SENTENCES, seed: int = 17) -> Selector:
    composer = _Composer(seed)
    rows, targets, kinds, sentence = [], [], [], []
    for i in range(sentences):
        text, true = composer.text()
        taken = [(a, b) for _, a, b in base_spans(text)]
        for span in candidates(text):
            if any(span[1] < b and a < span[2] for a, b in taken):  # such are never chosen
                continue
            rows.append(features(text, span))
            targets.append(float(any(span[0] == k and min(span[2], b) - max(span[1], a) >= 0.95 * (max(span[2], b) - min(span[1], a)) for k, a, b in true)))
            kinds.append(span[0])
            sentence.append(i)
    x, y, kind = np.array(rows), np.array(targets), np.array(kinds)
    quarter = np.array(sentence) % 4
    trees = BoostedTrees.fit(x[quarter < 2], y[quarter < 2], n_trees=100, depth=4)
    calibrated = Isotonic.fit(trees.margin(x[quarter == 2]), y[quarter == 2])
    held, threshold = quarter == 3, {}
    p = calibrated(trees.margin(x[held]))
    for k in KINDS:
        own = kind[held] == k
        cuts = [c for c in np.unique(p[own]) if c >= 0.5 and y[held][own][p[own] >= c].mean() >= PRECISION]
        threshold[k] = float(min(cuts, default=1.1))
    return Selector(trees, calibrated, threshold)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def _spans(texts: pa.Array, chooser: Selector) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """For each text: itself, its base spans, the spans that the model adds."""
    may = {kind: pc.match_substring_regex(texts, expression).to_pylist() for kind, expression in _MAY.items()}
    propose = pc.match_substring_regex(texts, _MAY_BE_CANDIDATE).to_pylist()
    for i, text in enumerate(texts.to_pylist()):
        base = base_spans(text, frozenset(k for k, m in may.items() if m[i]))
        yield text, base, chooser.choose(text, base) if propose[i] else []


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of base spans, their digest, and all spans.

    Null or empty text: no spans. One narrow pass without a shuffle; equal rows give equal results.
    """
    chooser = selector()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for _, base, added in _spans(batch.column(1), chooser):
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=COLUMNS)

    return id_and_text(docs).mapInArrow(scan, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span as ``[KIND]``; of overlapping spans the earliest, then longest, names the whole."""
    parts, free = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= free:
            parts += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    return "".join(parts) + text[free:]


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data masked in ``text_col``; null stays null."""
    chooser, schema = selector(), docs.schema
    at = docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            texts = batch.column(at)
            out = [masked(t, base + added) for t, base, added in _spans(pc.fill_null(texts, ""), chooser)]
            out = pa.array([None if null else t for t, null in zip(out, texts.is_null().to_pylist(), strict=True)], texts.type)
            columns = [out if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, schema)
