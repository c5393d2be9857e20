"""Word and shingle hashes of Arrow string columns, vectorised with numpy.

Used inside Spark tasks (``mapInArrow``, ``applyInArrow``) by the operators
that are free to leave the JVM. A word is a maximal run of bytes outside
space and ``\\x09-\\x0D``; ``fold`` maps bytes before hashing (lower-casing
A-Z, or treating ASCII punctuation as space). Work is done on blocks of at
most ``BLOCK`` bytes, cut at white space, so memory stays bounded for texts
of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
"""About 50 bytes a byte of a block are held while it is hashed."""
_SPACES = [32, 9, 10, 11, 12, 13]
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MUL = [_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F),
        _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)]


def _fold_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[_SPACES] = 32
    t[65:91] += 32
    return t


def _fold_words() -> np.ndarray:
    t = _fold_lower()
    for b in range(33, 128):
        if not chr(b).isalnum():
            t[b] = 32
    return t


FOLD_LOWER = _fold_lower()
"""A-Z to a-z; white space to one byte."""
FOLD_WORDS = _fold_words()
"""Also ASCII punctuation to white space."""


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    h = h ^ (h >> _U(30))
    h = h * _MUL[0]
    h ^= h >> _U(27)
    h *= _MUL[1]
    h ^= h >> _U(31)
    return h


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_CODE[32] = 0


def hash_words(raw: np.ndarray, cuts: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in ``raw`` (bytes) and the byte at which it starts;
    a word never crosses a position in ``cuts`` (sorted starts of texts)."""
    b = fold[raw]
    word = b != 32
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = cuts[cuts < len(b)]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    span = np.diff(np.append(starts, len(b)))
    at = np.arange(starts[0], len(b)) - np.repeat(starts, span)
    power = np.full(int(span.max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    h = np.add.reduceat(_CODE[b[starts[0]:]] * power[at], starts - starts[0])
    return mix(h), starts


def text_batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of at most ``BLOCK`` bytes (or one text):
    (first row, end row, bytes, start of each text within them, with the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, side="right")) - 1)
        yield lo, hi, data[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo]
        lo = hi


def words_of(raw: np.ndarray, offs: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice, the bytes at which they start, and the index of
    each text's first word (with the end)."""
    if len(raw) <= 2 * BLOCK:
        h, at = hash_words(raw, offs[:-1], fold)
    else:  # one very long text: block by block, each ending before white space
        parts, starts, lo = [], [], 0
        while lo < len(raw):
            hi = min(lo + BLOCK, len(raw))
            while hi < len(raw):
                gap = np.flatnonzero(fold[raw[hi: hi + BLOCK]] == 32)
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(hi + BLOCK, len(raw))
            x, y = hash_words(raw[lo:hi], np.zeros(1, np.int64), fold)
            parts.append(x)
            starts.append(y + lo)
            lo = hi
        h, at = np.concatenate(parts), np.concatenate(starts)
    return h, at, np.searchsorted(at, offs)


def combine(words: np.ndarray) -> np.ndarray:
    """One hash of a whole word sequence, as a one-element array."""
    n = len(words)
    order = np.full(n, _MUL[2], np.uint64)
    np.multiply.accumulate(order, out=order)
    return mix(np.array([np.sum(words * order, dtype=np.uint64)], np.uint64) + _U(n))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words (over the whole array)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    g = np.zeros(m, np.uint64)
    order = np.full(n, _MUL[3], np.uint64)
    np.multiply.accumulate(order, out=order)
    for i in range(n):
        g += words[i: i + m] * order[i]
    return mix(g)


def shingle_rows(words: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per text: its ``n``-word shingles in order; a text of fewer words has
    its whole sequence as one shingle, a text without words has none."""
    g = grams(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield g[a: b - n + 1]
        elif b > a:
            yield combine(words[a:b])
        else:
            yield np.empty(0, np.uint64)
