"""Exact tokenisation of Arrow text columns through a memo of pieces.

A text is cut where the tokenizer's own pre-tokenizer is certain to cut, so the ids of the
text are the ids of its pieces in order. Pieces repeat, so each distinct one is encoded by
the ``tokenizers`` library once and then looked up:

* ``space``: byte-level vocabularies whose words carry a leading blank. A cut before a
  blank is certain if no two white-space characters stand together; a text in which they do
  is encoded whole.
* ``white``: vocabularies that drop white space, cut at any run of ASCII white space.

A text that holds the string of an added token, such as an end-of-text mark, is encoded whole by
the library, which gives the token's own id, as it does by default.

The memo lives in the Python worker. Once it has ``MEMO_PIECES`` pieces, which take about 100 MB, only
those that more than one step has used since the last time stay in it, less than half of them. A new
piece of ASCII letters is one pre-token, which the library's model encodes; one of other plain Latin
signs is cut into pre-tokens, looked up among the pieces and in a memo of their own (``MEMO_WORDS``);
any other piece goes through the whole library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

MEMO_PIECES = 500_000
MEMO_WORDS = 200_000

#: All that either engine takes for white space, and the controls that only one of them does.
_WHITE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE_PAIR = _WHITE + "{2}"

#: Pieces for which the expressions below cut as the pre-tokenizers do: ASCII and the letters of Latin-1.
_PLAIN = {"space": re.compile(r"[ \n!-~À-ÿ]*"), "white": re.compile(r"[!-~À-ÿ]*")}
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PRE_TOKENS = {
    "space": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"),
    "white": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+"),
}
#: Byte-level vocabularies write a byte as a character: itself if it is printable, else one from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARACTERS = [chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256)]
_BLANK = _BYTE_CHARACTERS[32]

_encoders: dict[tuple[str, str], Encoder] = {}


class Memo:
    """Ids by piece: a dict to a place in flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.uses = (np.zeros(1024, np.int32) for _ in range(3))
        self.flat, self.used = np.empty(8192, np.uint16), 0

    def add(self, pieces: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        n, m = len(self.place), len(self.place) + len(pieces)
        while len(self.starts) < m:
            self.starts, self.lengths, self.uses = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lengths, self.uses))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[n:m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:m], self.uses[n:m] = lengths, 0
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.place.update(zip(pieces, range(n, m), strict=True))

    def ids(self, at: int) -> bytes:
        start = self.starts[at]
        return self.flat[start : start + self.lengths[at]].tobytes()

    def thin(self) -> None:
        """Keep the pieces used more than once since the last time; of very many, the most used."""
        pieces, half = list(self.place), MEMO_PIECES // 2  # in the order of their places
        n = len(pieces)
        least = 1 if n <= half else max(1, int(np.partition(self.uses[:n], n - half)[n - half]))
        kept = np.flatnonzero(self.uses[:n] > least)
        if self.lengths[kept].sum() > 4 * MEMO_PIECES:
            kept = kept[:0]
        lengths, starts = self.lengths[kept].astype(np.int64), self.starts[kept]
        before = np.cumsum(lengths) - lengths
        flat = self.flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]
        self.clear()
        self.add([pieces[i] for i in kept.tolist()], lengths, flat)


class Encoder:
    def __init__(self, path: str, cut: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.cut = cut
        self.model = self.tokenizer.model
        self.memo = Memo()
        self.words: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, from the library's model."""
        if word.isascii() and "\n" not in word:  # such bytes write themselves, but for the blank
            written = word.replace(" ", _BLANK)
        else:
            written = "".join(map(_BYTE_CHARACTERS.__getitem__, word.encode()))
        return array("H", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        """16-bit ids. Pieces of plain Latin letters are cut into pre-tokens here; the library cuts all others."""
        plain, cut, white = _PLAIN[self.cut].fullmatch, _PRE_TOKENS[self.cut].findall, self.cut == "white"
        words, place, word_of = self.words, self.memo.place, self._word
        if len(words) > MEMO_WORDS:
            words.clear()
        fresh: dict[str, bytes] = {}  # pre-tokens that are pieces, and so will be in the memo of pieces

        def known(word: str) -> bytes | None:
            if (ids := words.get(word) or fresh.get(word)) is None and (at := place.get(word)) is not None:
                ids = self.memo.ids(at)
            return ids

        out: list[bytes | None] = [None] * len(pieces)
        others = []
        for i, piece in enumerate(pieces):
            if piece.isascii() and (piece.isalpha() or not white and piece[0:1] == " " and piece[1:].isalpha()):  # one pre-token
                word = piece.lower() if white else piece
                if (ids := known(word)) is None:
                    ids = fresh[word] = word_of(word)
                out[i] = ids
            else:
                others.append(i)
        rest = []
        for i in others:
            piece = pieces[i]
            if not plain(piece):
                rest.append(i)
                continue
            cuts = cut(piece.lower() if white else piece)
            own = b""
            for word in cuts:
                if (ids := words.get(word)) is None and (ids := known(word)) is None:
                    ids = (fresh if len(cuts) == 1 else words)[word] = word_of(word)
                own += ids
            out[i] = own
        for i, ids in zip(rest, self.encode_whole([pieces[i] for i in rest]), strict=True):
            out[i] = array("H", ids).tobytes()
        return out

    def _places(self, pieces: list[str]) -> np.ndarray:
        """The places of the pieces, which differ, in the memo, which has them all afterwards."""
        memo = self.memo
        if len(memo.place) > MEMO_PIECES or memo.used > 8 * MEMO_PIECES:
            memo.thin()
        found = list(map(memo.place.get, pieces))
        missing = [i for i, at in enumerate(found) if at is None]
        if missing:
            new = [pieces[i] for i in missing]
            ids = self._encode_new(new)
            n = len(memo.place)
            memo.add(new, np.fromiter(map(len, ids), np.int64, len(ids)) // 2, np.frombuffer(b"".join(ids), np.uint16))
            for at, i in enumerate(missing, n):
                found[i] = at
        places = np.array(found, np.int64)
        memo.uses[places] += 1
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n + 1 places between texts. No nulls."""
        n = len(texts)
        whole = np.zeros(n, dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.cut == "space":
            whole |= pc.match_substring_regex(texts, _WHITE_PAIR).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        lists = pc.ascii_split_whitespace(cut) if self.cut == "white" else pc.split_pattern(cut, " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        if self.cut == "space":
            # The first piece of a text has no blank before it; all others do.
            firsts, at = np.unique(codes[bounds[:-1]], return_inverse=True)
            codes = codes.astype(np.int64)
            codes[bounds[:-1]] = len(pieces) + at
            pieces = [" " + p for p in pieces] + [pieces[i] for i in firsts.tolist()]
        at = self._places(pieces)
        lengths, starts = self.memo.lengths[at], self.memo.starts[at]
        piece_lengths = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(piece_lengths, dtype=np.int64)])
        out = self.memo.flat[np.repeat((starts[codes] - ends[:-1]).astype(np.int32), piece_lengths) + np.arange(ends[-1], dtype=np.int32)]
        places = ends[bounds]
        if not whole.any():
            return out, places
        at = np.flatnonzero(whole)
        replaced = dict(zip(at.tolist(), (np.array(x, np.uint16) for x in self.encode_whole(texts.take(pa.array(at)).to_pylist())), strict=True))
        parts = [replaced.get(i, out[places[i] : places[i + 1]]) for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(path: str, cut: str) -> Encoder:
    """This worker's encoder, made on first use."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]
