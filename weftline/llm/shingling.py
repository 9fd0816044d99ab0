"""Vectorised word and shingle hashing shared by the text operators.

Words are maximal runs of characters other than ASCII white space
(space, tab, newline, vertical tab, form feed, carriage return).  Everything
works on one Arrow slice at a time and keeps memory proportional to that slice.
A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multipliers, one for each word position of a shingle.
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    begin = 0
    total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > max_bytes:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes: a sum of pseudo-random values for (place, byte)."""
    values = values.cast(pa.large_string())
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=_U)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    terms = mix(((place.astype(_U) << _U(8)) | data) * _STEP + _U(1))
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(terms, out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + lengths.astype(_U))


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat words of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels get a buffer that starts at its first row
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    keep = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not keep.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)
        words = words.filter(pa.array(keep))
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), words


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text and a 64-bit hash for each of its words."""
    offsets, words = word_lists(texts, lower)
    if len(words) == 0:
        return offsets, np.zeros(0, dtype=_U)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return offsets, _string_hashes(coded.dictionary)[np.asarray(coded.indices)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i : i + width] for each i where all of them exist (across texts too)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n, dtype=_U)
    factor = _STEP
    for j in range(width):
        total += words[j : j + n] * factor
        factor = _U((int(factor) * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(total)


def shingle_sets(offsets: np.ndarray, words: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, with offsets.

    A text with fewer words than the width has its whole sequence as its one
    shingle; a text without words has none.
    """
    counts = np.diff(offsets)
    flat = window_hashes(words, width)
    starts = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), starts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    hashes = flat[offsets[owner] + place] if len(owner) else np.zeros(0, dtype=_U)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [window_hashes(words[offsets[i] : offsets[i + 1]], int(counts[i]))[0] ^ _U(int(counts[i])) for i in short]
        owner = np.concatenate([owner, short])
        hashes = np.concatenate([hashes, np.array(whole, dtype=_U)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(owner):
        keep = np.ones(len(owner), dtype=bool)
        keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[keep], hashes[keep]
    sizes = np.bincount(owner, minlength=len(counts)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), hashes
