"""Vectorised 64-bit hashes of the words of a batch of texts, straight from Arrow's buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes handled at once; bounds the working arrays, not the texts (a longer text goes alone).
SLICE_BYTES = 1 << 20

# Lower-cased letters, digits and all bytes above ASCII are parts of words; the rest part them.
LETTERS = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    LETTERS[_b] = _b
for _b in range(65, 91):
    LETTERS[_b] = _b + 32
#: As above, but only white space parts words.
NON_SPACE = np.arange(256, dtype=np.uint8)
NON_SPACE[65:91] += 32
NON_SPACE[[0, 9, 10, 11, 12, 13, 32]] = 0


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalizer that spreads all bits."""
    x = x + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """The words of a slice of texts. ``text``: index of each word's text."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    _sums: np.ndarray
    _powers: np.ndarray

    def prefix(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """``(words, hashes)`` of the first bytes of the words that are at least so long."""
        which = np.flatnonzero(self.end - self.start >= length)
        a = self.start[which]
        return which, (self._sums[a + length] - self._sums[a]) * self._powers[a + length]


_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LETTERS) -> Words:
    """``data``: the bytes of the texts in a row; ``offsets``: where each begins, and the end."""
    codes = table[data]
    inside = codes != 0
    n = len(codes)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False  # a text's first byte has no byte before it
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    up, down = _powers(n + 2)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    found = mixed((sums[ends] - sums[starts]) * up[ends])
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(np.repeat(np.arange(len(offsets) - 1), counts), starts, ends, found, sums, up)


def slices(texts: pa.Array):
    """``(first, data, offsets)``: runs of whole texts of about SLICE_BYTES; nulls are empty."""
    texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(texts))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
