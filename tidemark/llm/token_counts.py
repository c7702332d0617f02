"""Token counts of whole texts, equal to the library's, with huge documents encoded in overlapping chunks.

A text of up to ``2 * CHUNK_CHARS`` characters is counted through the memo of pieces (``tokens.py``). A longer one is
cut into chunks of ``CHUNK_CHARS`` that reach ``overlap`` characters into the next one. Each chunk is encoded with
offsets, and neighbours are spliced where both have a boundary between pre-tokens in their overlap.

Why such a splice is exact, for a byte-level vocabulary without a normaliser (others are encoded whole):

* The pre-tokenizer matches from left to right and looks at nothing before its place, and a pre-token is encoded by
  itself. So what follows a boundary is the same whatever comes before it: behind a boundary that is also one of the
  whole text, a chunk's tokens are the whole text's.
* The pre-tokenizer looks at most ``_AHEAD`` characters past the end of a match, and an added token is found only
  where all of it is there. So a chunk's boundaries are certain up to ``_AHEAD`` characters and the longest added
  token before its end.
* A boundary of the left chunk, itself spliced to a true boundary, is therefore one of the whole text, and if the
  right chunk has it too, its tokens from there on are the whole text's.

Where an overlap has no common boundary (a run of one kind of sign longer than it), the left chunk's last certain
boundary starts a longer stretch, whose reach into the right chunk doubles until both agree or the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, steps
from .tokens import Encoder, encoder

CHUNK_CHARS = 16_384
OVERLAP = 128
LIMIT = 512
#: Chunks that are encoded at a time.
_GROUP = 64
#: "'re": a match that ends at the quote depends on two signs after it; one more for the sign after white space.
_AHEAD = 3

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"
COLUMNS = ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"]


class Boundaries:
    """A stretch of text, encoded: where its pre-tokens begin, and how many tokens come before each."""

    def __init__(self, encoding, start: int, sure_to: int):
        self.encoding, self.start, self.total = encoding, start, len(encoding)
        #: No boundary beyond this place in the text is certain.
        self.sure_to = sure_to

    def _is(self, i: int) -> bool:
        return i == 0 or self.encoding.token_to_word(i) != self.encoding.token_to_word(i - 1)

    def _place(self, i: int) -> int:
        return self.start + self.encoding.token_to_chars(i)[0]

    def up_to(self, end: int) -> dict[int, int]:
        """Tokens before each boundary at a place up to ``end``, without the start."""
        found = {}
        for i in range(1, self.total):
            if (at := self._place(i)) > end:
                break
            if self._is(i):
                found[at] = i
        return found

    def certain_from(self, begin: int) -> dict[int, int]:
        """Tokens before each certain boundary from ``begin`` on, without the start; the last first."""
        found = {}
        for i in range(self.total - 1, 0, -1):
            if (at := self._place(i)) < begin:
                break
            if at <= self.sure_to and self._is(i):
                found[at] = i
        return found

    def last_certain(self, after: int) -> tuple[int, int] | None:
        """The last certain boundary beyond ``after``, and the tokens before it."""
        for i in range(self.total - 1, 0, -1):
            at = self._place(i)
            if at <= after:
                return None
            if at <= self.sure_to and self._is(i):
                return at, i
        return None


class Splicer:
    """Counts of huge texts by one tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        cutter = self.tokenizer.pre_tokenizer
        #: Whether the proof above holds.
        self.exact = plain and self.tokenizer.normalizer is None and isinstance(cutter, pre_tokenizers.ByteLevel) and not cutter.add_prefix_space and self.tokenizer.post_processor is None
        self.unsure = _AHEAD + max((len(t.content) for t in added), default=0)

    def _encoded(self, text: str, stretches: list[tuple[int, int]]) -> list[Boundaries]:
        found = self.tokenizer.encode_batch([text[a:b] for a, b in stretches], add_special_tokens=False)
        return [Boundaries(e, a, b if b == len(text) else b - self.unsure) for e, (a, b) in zip(found, stretches, strict=True)]

    def _chunks(self, text: str, chunk: int, overlap: int) -> Iterator[Boundaries]:
        bounds = [(a, min(a + chunk + overlap, len(text))) for a in range(0, len(text), chunk)]
        for i in range(0, len(bounds), _GROUP):
            yield from self._encoded(text, bounds[i : i + _GROUP])

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> tuple[int, int, int]:
        """(tokens, chunks, splices that needed a wider overlap)."""
        chunks = self._chunks(text, chunk, overlap)
        left = next(chunks)
        # The tokens before ``since``, a true boundary, are counted; ``skip`` of left's tokens come before it.
        done, since, skip, n, widened = 0, 0, 0, 1, 0
        for right in chunks:
            n += 1
            if since >= right.start + chunk:  # a widened stretch has gone beyond this chunk
                continue
            reach, wide = max(overlap, 1), False
            while True:
                theirs = right.up_to(right.start + reach)
                theirs[right.start] = 0  # where the chunk begins
                common = next(((at, before) for at, before in left.certain_from(max(right.start, since + 1)).items() if at in theirs), None)
                if common or left.sure_to == len(text):
                    break
                wide = True
                # Begin anew at the last certain boundary, and reach further.
                if last := left.last_certain(since):
                    done, since, skip = done + last[1] - skip, last[0], 0
                reach *= 2
                left, skip = self._encoded(text, [(since, min(right.start + reach, len(text)))])[0], 0
            widened += wide
            if common is None:  # left reaches the end of the text
                break
            done, since, skip = done + common[1] - skip, common[0], theirs[common[0]]
            left = right
        return done + left.total - skip, n, widened


_splicers: dict[str, Splicer] = {}


def splicer(path: str) -> Splicer:
    """This worker's splicer, made on first use."""
    if path not in _splicers:
        _splicers[path] = Splicer(path)
    return _splicers[path]


def counts(texts: pa.Array, short: Encoder, long: Splicer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, chunks and widened splices of each text. No nulls."""
    n_chunks, n_widened = np.ones(len(texts), np.int32), np.zeros(len(texts), np.int32)
    huge = np.zeros(len(texts), bool)
    if long.exact:
        huge = pc.greater(pc.utf8_length(texts), 2 * chunk).to_numpy(zero_copy_only=False)
    _, places = short.encode(pc.if_else(pa.array(huge), "", texts) if huge.any() else texts)
    n_tokens = np.diff(places)
    for i in np.flatnonzero(huge).tolist():
        n_tokens[i], n_chunks[i], n_widened[i] = long.count(texts[i].as_py(), chunk, overlap)
    return n_tokens, n_chunks, n_widened


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """A row for each document: bytes, tokens, whether there are more than ``limit``, chunks and widened splices.

    One narrow pass without a shuffle. Null or empty text: 0 bytes, 0 tokens, one chunk. Equal rows give equal
    results. A document is read by one task, as a row is; what that task holds beyond the text is ``_GROUP`` chunks.
    A run of one kind of sign (a word of a million letters) is one pre-token, which any encoder takes whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = encoder(vocabulary, "space"), splicer(vocabulary)
        for batch in steps(batches):
            texts = batch.column(1)
            n_tokens, n_chunks, n_widened = counts(texts, short, long, chunk, overlap)
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit), pa.array(n_chunks), pa.array(n_widened)], names=COLUMNS)

    return id_and_text(docs).mapInArrow(count, SCHEMA)
