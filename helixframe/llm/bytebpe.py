"""Byte-level BPE ids of texts, as the tokenizer file gives them.

The tokenizer cuts a text by a pattern before it merges, and never merges across a cut.
Where two neighbouring bytes alone show that the pattern cuts between them, a text is cut
here into units; a text's ids are its units' ids end to end. Each distinct unit goes to
the tokenizer once and is remembered by the Python worker, up to a bound. Texts with
characters that the bytes don't tell (white space beyond ASCII, the tokenizer's own
special token) go to the tokenizer whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from helixframe.llm.tokens import Pieces

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Distinct units that a worker remembers, about.
REMEMBERED = 600_000
#: Texts that go to the tokenizer whole: white space that isn't ASCII, control characters that some call white space, the special token.
WHOLE = "[\x1c-\x1f\u0085   -     　]|<\\|endoftext\\|>"

_LETTER, _DIGIT, _MARK, _APOSTROPHE, _WHITE, _SPACE, _OTHER = range(7)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    for i in range(128):
        c = chr(i)
        kinds[i] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _APOSTROPHE if c == "'" else _SPACE if c == " " else _WHITE if 9 <= i <= 13 else _MARK if 33 <= i <= 126 else _OTHER
    return kinds


def _kind_cuts() -> np.ndarray:
    """Whether the pattern always cuts between bytes of two kinds, at 8 * first + second."""
    cuts = np.zeros((8, 8), bool)
    black = (_LETTER, _DIGIT, _MARK, _APOSTROPHE)
    for a in black:
        for b in black:
            # an apostrophe may begin a contraction, or stand among marks
            cuts[a, b] = a != b and (a, b) not in ((_MARK, _APOSTROPHE), (_APOSTROPHE, _MARK), (_APOSTROPHE, _LETTER))
    for a in (*black, _OTHER):
        cuts[a, _WHITE] = cuts[a, _SPACE] = cuts[_WHITE, a] = True
    return cuts.ravel()


_KINDS, _CUTS = _byte_kinds(), _kind_cuts()


def _kinds(body: np.ndarray) -> np.ndarray:
    """What each byte belongs to; letters beyond ASCII are known up to U+017F."""
    kinds = _KINDS[body]
    lead = (body >= 0xC3) & (body <= 0xC5)
    kinds[lead] = _LETTER
    kinds[1:][lead[:-1]] = _LETTER
    signs = np.flatnonzero((body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7)))  # times and division
    kinds[signs] = kinds[signs + 1] = _OTHER
    return kinds


def cut_units(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of all texts (no nulls), numbered, and where each text's units begin and end."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    cut = np.zeros(len(body) + 1, bool)
    if len(body):
        kinds = _kinds(body)
        cut[1:-1] = _CUTS[kinds[:-1] * 8 + kinds[1:]]
        white = kinds >= _WHITE
        white &= kinds <= _SPACE
        before = white[:-1] & ~white[1:]  # the last white space before a word goes with it or stands alone
        before[ends[(ends > 0) & (ends < len(body))] - 1] = False  # the next word is another text's
        cut[: len(body) - 1] |= before
    cut[ends] = True
    cuts = np.flatnonzero(cut)
    units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body)) if len(cuts) > 1 else pa.array([], pa.string())
    return units.dictionary_encode(), np.searchsorted(cuts, ends)


class ByteEncoder:
    """Ids of texts, by units; about ``most`` of them are remembered from call to call."""

    def __init__(self, path: str = TOKENIZER, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # the vocabulary writes each byte as one character
        self._forget()

    def _forget(self) -> None:
        self.known, self.parts = pa.array([], pa.string()), Pieces(np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _each(self, texts: list[str]) -> Pieces:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return Pieces(np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found)))

    def _together(self, units: list[str], widths: np.ndarray) -> Pieces:
        """Ids of units that begin with a space and a letter, so that the pattern cuts before each also when they stand side by side."""
        ids, count = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(units), 1000):
            some = units[i : i + 1000]
            laid = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops, ends = np.cumsum(self.width[laid]), np.cumsum(widths[i : i + 1000])
            at = np.searchsorted(stops, ends)
            found = Pieces(laid, np.diff(at + 1, prepend=0)) if len(stops) and (stops[np.minimum(at, len(stops) - 1)] == ends).all() else self._each(some)
            ids.append(found.ids)
            count.append(found.count)
        return Pieces(np.concatenate(ids), np.concatenate(count))

    def _units(self, units: pa.Array) -> Pieces:
        """Ids of distinct units."""
        if len(self.known) > self.most:
            self._forget()
        new = units.filter(pc.invert(pc.is_in(units, value_set=self.known)))
        if len(new):
            worded = pc.match_substring_regex(new, "^ [A-Za-z]")
            words, rest = new.filter(worded), new.filter(pc.invert(worded))
            self.parts = self.parts.join(self._together(words.to_pylist(), pc.binary_length(words).to_numpy(zero_copy_only=False))).join(self._each(rest.to_pylist()))
            self.known = pa.concat_arrays([self.known, words, rest])
        return self.parts.take(pc.index_in(units, value_set=self.known).to_numpy(zero_copy_only=False))

    def ids(self, texts: pa.StringArray) -> Pieces:
        """The ids of each text; a null has none."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WHOLE)
        units, ends = cut_units(pc.if_else(whole, "", texts))
        laid = self._units(units.dictionary).take(units.indices.to_numpy(zero_copy_only=False))
        found = Pieces(laid.ids, np.diff(np.concatenate(([0], np.cumsum(laid.count)))[ends]))
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd) == 0:
            return found
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(len(odd))
        return found.join(self._each(texts.filter(whole).to_pylist())).take(at)


@lru_cache(maxsize=1)
def encoder(path: str = TOKENIZER) -> ByteEncoder:
    """The worker's encoder."""
    return ByteEncoder(path)
