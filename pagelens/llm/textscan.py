"""Words of many texts at once: byte-level scans of Arrow string buffers with numpy.

A text is taken as UTF-8 bytes. ASCII separators never occur inside a longer character, so byte classes are exact for
the word patterns used here. Hashes are 64 bits wide; each caller says what a collision would do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}

#: Bytes of a word when words are what white space leaves: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word of digits, letters and all non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        n = max(n, SLICE_BYTES + 1)
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


@dataclass
class Scan:
    """Consecutive texts: lower-cased bytes, word borders, and per text the range of its words."""

    first: int  # row of the first text in its batch
    data: np.ndarray
    text_at: np.ndarray  # byte offsets, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray  # word offsets, one more than texts

    @property
    def texts(self) -> int:
        return len(self.text_at) - 1

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ones: a polynomial, by differences of one running sum."""
        n = len(self.data)
        if not len(self.starts):
            return np.empty(0, np.uint64)
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n + 1)[:n], out=sums[1:])
        value = (sums[ends] - sums[self.starts]) * _power_table(_INVERSE, n + 1)[self.starts]
        return mix(value + (ends - self.starts).astype(np.uint64))

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k successive words of one text, and for each the index of its first word."""
        at = self.gram_starts(k)
        if not len(at):
            return np.empty(0, np.uint64), at
        out = words[at].copy()
        for j in range(1, k):
            out = out * np.uint64(_BASE) + words[at + j]
        return mix(out), at

    def gram_starts(self, k: int) -> np.ndarray:
        ok = np.ones(len(self.starts), dtype=bool)
        for j in range(1, k):
            last = self.word_at[1:] - j
            ok[last[last >= self.word_at[:-1]]] = False
        return np.flatnonzero(ok)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0 or at is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most that many bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def scan(column: pa.Array, kind: np.ndarray, most: int = SLICE_BYTES) -> Iterator[Scan]:
    """Words of lower-cased texts (A-Z only), a bounded number of bytes at a time."""
    raw, offsets = buffers(column)
    for i, j in slices(offsets, most):
        data = _LOWER[raw[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = kind[data]
        here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        border = at[1:-1][at[1:-1] < len(data)]
        before[border] = False
        after[border[border > 0] - 1] = False
        starts = np.flatnonzero(here & ~before)
        ends = np.flatnonzero(here & ~after) + 1
        yield Scan(i, data, at, starts, ends, np.searchsorted(starts, at))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by doubling."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x
