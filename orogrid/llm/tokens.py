"""Token ids of whole texts by the tokenizers library; each worker gives a chunk of text to the library once.

The vocabularies in use split a text into pieces before they merge pairs, so a text may be cut wherever a piece is sure to
begin, and its ids are those of its chunks laid end to end. Rules on two neighbouring bytes find such places in whole
Arrow columns at once: before white space that follows a word, between letters, digits and marks. Where two bytes can't tell
(apostrophes, most characters beyond ASCII) there is no cut, and the chunk is longer. A hash table of NumPy arrays holds the ids
of chunks seen before under two 64-bit hashes; it is emptied at ``CACHE_CHUNKS`` entries. A text that holds the
string of an added token is one chunk, so that the library sees it whole. A tokenizer of another kind gets whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

from .common import held
from .words import LOWER_ASCII, U64, mix, text_slices

CACHE_CHUNKS, TABLE_BITS = 1_200_000, 21
#: Longest chunk, in bytes, that is hashed eight bytes at a time with all others.
LONG = 256
#: the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_OTHER, _BREAK, _SPACE, _LETTER, _DIGIT, _MARK, _QUOTE = range(7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[9:14], _CLASS[32], _CLASS[39], _CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = _BREAK, _SPACE, _QUOTE, _DIGIT, _LETTER, _LETTER
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LENGTH, _STEP, _CHECK = U64(0x9E3779B97F4A7C15), U64(0xA24BAED4963EE407), U64(0xD6E8FEB86659FD93)


def _cuts(kind: str) -> np.ndarray:
    """By class of the byte before * 8 + class of the byte: whether a piece begins there."""
    cut = np.zeros((8, 8), bool)
    known = [_LETTER, _DIGIT, _MARK, _QUOTE]
    for before in known:
        cut[before, [_BREAK, _SPACE]] = True
        cut[_BREAK, before] = True
    for a in (_LETTER, _DIGIT, _MARK):
        cut[a, [x for x in (_LETTER, _DIGIT, _MARK) if x != a]] = True
    cut[[_LETTER, _DIGIT], _QUOTE] = True
    if kind == "bare":  # white space is dropped: it may be cut off everywhere
        for white in (_BREAK, _SPACE):
            cut[white, [_OTHER, *known]] = cut[[_OTHER, *known], white] = True
    return cut.ravel()


_CUT = {kind: _cuts(kind) for kind in ("byte", "bare")}


class Chunks:
    """ids of chunks by hash: an open-addressing table whose entries name runs of one array of ids."""

    def __init__(self, dtype: type, bits: int = TABLE_BITS):
        self.bits, self.dtype = bits, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.check, self.start, self.count = np.zeros(1024, U64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, self.dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 where there is none."""
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        out, open_, last = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (1 << self.bits) - 1
        while len(open_):
            at = slot[open_]
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.entry[at[hit]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) & last
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New entries for keys that the table lacks, none twice; their numbers."""
        n, used = self.n + len(keys), self.used + len(ids)
        for name, need in (("check", n), ("start", n), ("count", n), ("ids", used)):
            have = getattr(self, name)
            if len(have) < need:
                more = np.zeros(max(need, len(have) * 3 // 2), have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)
        new = np.arange(self.n, n)
        self.check[new], self.count[new], self.ids[self.used : used] = check, count, ids
        self.start[new] = self.used + np.cumsum(count) - count
        self.n, self.used = n, used
        slot, open_, last = (keys >> U64(64 - self.bits)).astype(np.int64), np.arange(len(keys)), (1 << self.bits) - 1
        while len(open_):
            at = slot[open_]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[open_[free]]
            won = self.keys[at] == keys[open_]
            self.entry[at[won]] = new[open_[won]]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + 1) & last
        return new


class Encoder:
    """ids of Arrow columns of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = json.dumps([spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"]])
        first = spec["pre_tokenizer"] or {}
        byte_level = spec["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        bare = '"end_of_word_suffix": "</w>"' in json.dumps(spec["model"] | {"vocab": 0, "merges": 0}) and '"Removed", "invert": true' in kinds
        self.kind = "byte" if byte_level else "bare" if bare else None
        self.added = [t["content"].encode().translate(LOWER_ASCII) for t in spec.get("added_tokens") or []]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.chunks, self.cache_chunks = Chunks(self.dtype), cache_chunks

    def encode(self, column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets of each text in them) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
        for lo, hi, data, offsets in text_slices(column, limit):
            yield lo, hi, *(self._slice(data, offsets) if self.kind else self._whole(data, offsets))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)])
        return np.array([i for x in found for i in x], self.dtype), np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))

    def _pieces(self, b: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of every chunk, in order; texts in ``whole`` are one chunk."""
        kind = _CLASS[b]
        two = np.flatnonzero(b[:-1] == 0xC3) + 1  # letters of Latin-1, all but the signs for times and divided by
        two = two[(b[two] != 0x97) & (b[two] != 0xB7)]
        kind[two] = kind[two - 1] = _LETTER
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = _CUT[self.kind][kind[:-1] << 3 | kind[1:]]
        white = (kind == _BREAK) | (kind == _SPACE)
        if self.kind == "byte":
            # a space after another character: unless that is white space itself
            at = np.flatnonzero((kind[:-1] == _OTHER) & white[1:]) + 1
            x, y, z = b[at - 1], b[at - 2], b[at - 3]
            low = (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
            blank = (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | low | (z == 0xE2) & (y == 0x81) & (x == 0x9F) | (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
            cut[at] = (x >= 0x80) & ~blank
            # of white space before a word the last character is a piece of its own or the word's
            known = kind[2:] >= _LETTER
            known[offsets[(offsets > 1) & (offsets < len(b))] - 2] = False
            cut[np.flatnonzero(white[:-2] & white[1:-1] & known) + 1] = True
            cut[np.flatnonzero((kind[:-2] == _OTHER) & (kind[1:-1] == _BREAK) & known) + 2] = False
        cut[offsets] = True
        first, last = cut[:-1], cut[1:]
        if self.kind == "bare":
            first, last = first & ~white, last & ~white
        for lo, hi in whole:
            first[lo:hi] = last[lo:hi] = False
            first[lo] = last[hi - 1] = True
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _hashes(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every chunk; for up to eight bytes they hold the bytes and the length exactly."""
        padded = np.concatenate((b, np.zeros(8, np.uint8)))
        word = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))
        length = end - start
        check = word[start] & _MASKS[np.minimum(length, 8)]
        key = mix(check ^ length.astype(U64) * _LENGTH)
        long = np.flatnonzero((length > 8) & (length <= LONG))
        at = 8
        while len(long):
            w = word[start[long] + at] & _MASKS[np.minimum(length[long] - at, 8)]
            key[long], check[long] = mix(key[long] * _STEP + w), mix(check[long] + w) * _CHECK
            at += 8
            long = long[length[long] > at]
        for k in np.flatnonzero(length > LONG).tolist():
            whole = xxhash.xxh3_128_intdigest(b[start[k] : end[k]].tobytes())
            key[k], check[k] = whole >> 64, whole & (1 << 64) - 1
        key[key == 0] = 1
        return key, check

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        b, lower = data, data.tobytes().translate(LOWER_ASCII)
        if self.kind == "bare":  # lower case first, but for a letter that a combining mark may follow
            b = np.where(np.append(data[1:], np.uint8(0)) < 0x80, np.frombuffer(lower, np.uint8), data)
        whole = []
        if any(x in lower for x in self.added):  # texts with the string of an added token stay whole, as they are
            whole = [(lo, hi) for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False) if any(x in lower[lo:hi] for x in self.added)]
            b = b.copy()
            for lo, hi in whole:
                b[lo:hi] = data[lo:hi]
        start, end = self._pieces(b, offsets, whole)
        key, check = self._hashes(b, start, end)
        coded = pa.array(key).dictionary_encode()
        code, own = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        own[code] = np.arange(len(code))
        keys, checks, cache = coded.dictionary.to_numpy(), check[own], self.chunks
        entry = cache.find(keys)
        if (check != checks[code]).any() or (cache.check[entry[entry >= 0]] != checks[entry >= 0]).any():
            return self._whole(data, offsets)  # two chunks share a hash: the library does these texts itself
        new = np.flatnonzero(entry < 0)
        if len(new):
            if cache.n + len(new) > self.cache_chunks and cache.n:
                cache.clear()
                new, entry = np.arange(len(keys)), np.full(len(keys), -1, np.int64)
            if cache.n + len(new) > 3 << (cache.bits - 2):  # more chunks in one slice than the table holds
                return self._whole(data, offsets)
            count, ids = self._learned([b[x:y].tobytes().decode() for x, y in zip(start[own[new]].tolist(), end[own[new]].tolist(), strict=True)])
            entry[new] = cache.add(keys[new], checks[new], count, ids)
        entry = entry[code]
        count = cache.count[entry]
        total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        ids = cache.ids[np.repeat(cache.start[entry] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of chunks. A run of letters is one piece and goes straight to the model, others the library's whole way."""
        merge, bare, found, rest = self.tokenizer.model.tokenize, self.kind == "bare", [], []
        for c in chunks:
            body = c[1:] if c[0] == " " and not bare else c
            if body.isascii():
                if body.isalpha() or not bare and body.isdigit():
                    found.append([t.id for t in merge(c.lower() if bare else c.replace(" ", "Ġ"))])
                    continue
            elif body.isalpha() and max(body) < "ƀ" and (piece := c.lower() if bare else c).lstrip().isalpha():
                found.append([t.id for t in merge(piece.encode().decode("latin-1").translate(_BYTE_CHARS))])
                continue
            found.append(None)
            rest.append(c)
        left = iter(self._ids(rest))
        found = [next(left) if x is None else x for x in found]
        return np.array([len(x) for x in found], np.int32), np.array([i for x in found for i in x], self.dtype)


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, loaded once and kept while this worker does nothing else that is large."""
    return held(f"encoder {path}", lambda: Encoder(path))


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with ``end_id`` after each text, their offsets)."""
    n = len(offsets) - 1
    at = offsets[1:] + np.arange(n)
    inside = np.ones(len(ids) + n, bool)
    inside[at] = False
    out = np.full(len(inside), end_id, ids.dtype)
    out[inside] = ids
    return out, np.concatenate(([0], at + 1))
