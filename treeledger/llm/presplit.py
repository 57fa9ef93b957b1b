"""Pre-splitting of text as the public BPE vocabularies do, on bytes of whole batches.

Texts of characters below U+0250 and of U+2010-U+2027, U+2030-U+205E (general punctuation) take the vectorised way. ``odd``
names the others (any further character, white space beyond ASCII, or a special token's text); the caller gives those to
the tokenizers library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import packed, raw

SPACE, LETTER, NUMBER, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
_CLASS[48:58] = NUMBER
#: Second bytes after C2 (U+0080-U+00BF).
_LATIN = np.full(256, OTHER, np.uint8)
_LATIN[[0xAA, 0xB5, 0xBA]] = LETTER
_LATIN[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
_LATIN[[0x85, 0xA0]] = SPACE
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[*range(0x80, 0x90), 0xA8, 0xA9, 0xAA, 0xAB, 0xAC, 0xAD, 0xAE, 0xAF, 0x9F]] = True


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte (a character's bytes share it), and places of bytes that the vectorised way doesn't cover."""
    kind = _CLASS[data]
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    after = padded[two + 1]
    latin = data[two] == 0xC2
    kind[two[latin]] = _LATIN[after[latin]]
    kind[two[(data[two] == 0xC3) & ((after == 0x97) | (after == 0xB7))]] = OTHER
    bad = [two[(latin & (_LATIN[after] == SPACE)) | ((data[two] == 0xC4) & (after == 0xB0))]]
    kind[two + 1] = kind[two]
    high = np.flatnonzero(data >= 0xCA)
    fine = (data[high] == 0xE2) & (padded[high + 1] == 0x80) & ~_WIDE_SPACE[padded[high + 2]]
    bad.append(high[~fine])
    return kind, np.concatenate(bad)


def odd(texts: pa.Array, specials: list[str]) -> np.ndarray:
    data, offsets = raw(texts)
    mark = np.zeros(len(texts), bool)
    _, bad = classes(data)
    mark[np.searchsorted(offsets, bad, "right") - 1] = True
    for s in specials:
        mark |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return mark


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, _ = classes(data)
    begin = np.ones(len(data) + 1, bool)
    begin[1:-1] = kind[1:] != kind[:-1]
    begin[offsets] = True
    starts = np.flatnonzero(begin[:-1])
    ends = np.append(starts[1:], len(data)).astype(np.int64)
    return kind, begin, starts, ends


def _contract(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """An apostrophe that stands alone takes s, t, m, d, re, ve or ll from the letters after it."""
    lone = np.flatnonzero((ends - starts == 1) & (data[starts] == 39) & begin[starts])
    lone = lone[lone + 1 < len(starts)]
    closed = np.isin(ends[lone], offsets)
    for r in lone[~closed & (kind[starts[lone + 1]] == LETTER)]:
        a, b = starts[r + 1], ends[r + 1]
        word = data[a : min(b, a + 2)].tobytes()
        n = 1 if word[:1] in (b"s", b"t", b"m", b"d") else 2 if word in (b"re", b"ve", b"ll") else 0
        if n:
            begin[a] = False
            begin[a + n] = True


def gpt_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, which cover every byte, and
    the offsets of the texts in pieces. No text may be odd."""
    data, offsets = raw(texts)
    if not len(data):
        return packed(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    kind, begin, starts, ends = _runs(data, offsets)
    closes = np.zeros(len(data) + 1, bool)
    closes[offsets] = True
    gap = (kind[starts] == SPACE) & ~closes[ends]
    last, after = ends[gap] - 1, ends[gap]
    begin[last] = True
    begin[after] = data[last] != 0x20
    _contract(data, offsets, kind, begin, starts, ends)
    at = np.flatnonzero(begin[:-1])
    return packed(data, np.append(at, len(data))), np.searchsorted(at, offsets)


def lower_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` of the lower-cased texts, white space dropped, and the
    offsets of the texts in pieces. No text may be odd."""
    data, offsets = raw(pc.utf8_lower(texts))
    if not len(data):
        return packed(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    kind, begin, starts, ends = _runs(data, offsets)
    begin[:-1] |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    _contract(data, offsets, kind, begin, starts, ends)
    solid = kind != SPACE
    at = np.flatnonzero(begin[:-1] & solid)
    before = np.concatenate(([0], np.cumsum(solid)))
    return packed(data[solid], np.append(before[at], before[-1])), np.searchsorted(at, offsets)
