"""Cutting text for byte-level BPE where a token can never cross.

A pretoken holds white space only at its front or is white space throughout, so
the place between a character that isn't white space and one that is always
separates pretokens, and what follows it doesn't change how the part before it
is tokenized.  Chunks between such places recur a lot (they are mostly single
words with a leading space), which makes a memo of chunks worthwhile.
"""

from __future__ import annotations

import re

import numpy as np

_RUN = re.compile(r"\s\s")
_CHUNK = re.compile(r"\s*\S+|\s+")


def chunks(text: str) -> list[str]:
    """Pieces that concatenate to text, cut only between a non-space and a space character."""
    if "\x00" in text or _RUN.search(text):
        return _CHUNK.findall(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and what a pair of kinds says of the place between: 0 no cut, 1 a cut, 2 a look at the character before."""
    kinds = np.zeros(256, dtype=np.uint8)  # 0: control characters, never next to a cut
    kinds[[9, 10, 13, 32]] = 1
    kinds[33:127] = [3 if chr(b).isalnum() else 2 for b in range(33, 127)]
    kinds[128:] = 4
    pairs = np.zeros((5, 5), dtype=np.uint8)
    pairs[[2, 3], 1] = pairs[3, 2] = 1
    pairs[4, [1, 2]] = 2
    return kinds, pairs.ravel()


_KIND, _PAIR = _kinds()


def places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin, which lie one after another in data (UTF-8 bytes) from their offsets on.

    A text is cut before white space that follows something else, as by chunks(), and before
    punctuation that follows a letter or a digit: no pretoken has that order either.  Where it
    isn't plain from the bytes that both hold, there is no cut, which is always right.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    cut = np.ones(len(data), dtype=np.uint8)
    cut[1:] = _PAIR[kind[:-1] * np.uint8(5) + kind[1:]]
    look = np.flatnonzero(cut == 2)
    a, b, c = data[look - 3], data[look - 2], data[look - 1]
    # U+0085, U+00A0, U+1680, U+2000 to U+200F, U+2028 to U+202F, U+2040 to U+207F, U+3000 to U+303F: all white space beyond ASCII, and more
    blank = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A)
    blank |= (a == 0xE2) & ((b == 0x80) & ((c < 0x90) | (c >= 0xA8) & (c < 0xB0)) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)
    letter = (b == 0xC3) & (c != 0x97) & (c != 0xB7)  # U+00C0 to U+00FF but for the two signs
    cut[look] = np.where(kind[look] == 1, ~blank, letter)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = 1
    return np.flatnonzero(cut)


class Memo(dict):
    """A dictionary of two generations: when the young one is full it becomes the old one, and what is asked for again moves over.

    A bound on memory, never on results.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.half = most // 2
        self.old: dict = {}

    def make_room(self, n: int) -> bool:
        """Whether the generations moved on, to make room for n entries."""
        if len(self) + n <= self.half:
            return False
        self.old = dict(self)
        self.clear()
        return True

    def recall(self, key):
        """The old generation's value, which becomes young again; None if it has none."""
        value = self.old.get(key)
        if value is not None:
            self.make_room(1)
            self[key] = value
        return value
