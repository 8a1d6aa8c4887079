"""Words, word hashes and word n-grams of whole Arrow text columns at once, with NumPy.

A word is a maximal run of ASCII digits and letters and of bytes from 0x80 (all non-ASCII characters), after
lower-casing A-Z only: the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Texts are cut into slices of
whole texts, so that the working arrays stay small; one very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_RANDOM = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
LOWER_ASCII = bytes(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES), U64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of one slice: ``doc`` (row in the slice), ``hash``, and ``start`` and ``end`` in the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        self.lower = b = _LOWER[data]
        inside = _IS_WORD[b]
        first, last = inside.copy(), inside.copy()
        if len(b):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = offsets[1:] > offsets[:-1]
            at = offsets[:-1][filled]
            first[at] = inside[at]
            at = offsets[1:][filled] - 1
            last[at] = inside[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(self.start):
            total = np.cumsum(_RANDOM[b] * powers(int(_BASE), len(b)))
            before = np.where(self.start > 0, total[self.start - 1], U64(0))
            self.hash = mix((total[self.end - 1] - before) * powers(int(_INVERSE), len(b))[self.start] + (self.end - self.start).astype(U64))
        else:
            self.hash = np.zeros(0, U64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(n, U64)
        for j in range(k):
            total = total * U64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        return at, mix(total[at])

    def whole(self, seed: int) -> np.ndarray:
        """One hash of each text's whole word sequence; 0 for a text without words."""
        out = np.zeros(self.n_docs, U64)
        if len(self.hash):
            step = mix(np.arange(1, int(self.count.max()) + 1, dtype=U64) * _BASE + U64(seed)) | U64(1)
            place = np.arange(len(self.hash)) - self.first[self.doc]
            total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(self.hash + U64(seed)) * step[place])))
            out = mix(total[self.first[1:]] - total[self.first[:-1]] + self.count.astype(U64))
            out[self.count == 0] = 0
        return out


def gram_hash(words: list[str], k: int) -> list[int]:
    """The hashes that ``Words.grams`` gives for the k-grams of one list of lower-case words."""
    data = " ".join(words).encode()
    return [int(x) for x in Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).grams(k)[1]]
