"""Token ids in compressed, independently reset, checksummed blocks.

Ids are below 2**16. Each block starts from a fresh model. For every id the model predicts with order 2 (the id that last
followed the two ids before), order 1 (the one before) and order 0 (the id that outnumbers the others so far), each with a confidence;
the probabilities of orders 2 and 1 are mixed with an adaptive weight into one choice: the order-2 id, the order-1 id, the order-0 id
or none of them. An id that none predicts is coded by order 0 within its class: its low byte together with whether it is the id that
last had this low byte, with the adaptive probability of that prediction's confidence, or else its high byte.
A 48-bit range coder with carries turns the choices into 16-bit words. Its state is whole numbers below 2**49 in double precision,
on which every operation used here is exact, so any machine decodes what any other wrote. Blocks are coded in lockstep: one NumPy step
codes one id of every block.

A block is self-contained: magic, sizes, CRC-32 of its ids, the table of its documents and the coded ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS, LANES = 2048, 4096
MAGIC = b"OTB3"
_HEAD = struct.Struct("<4sIIIIBB2x")  # magic, ids, documents, coded bytes, crc32 of the ids, first continues, last continues
NO_ID = -(1 << 63)  # stands for a null doc_id; the same number as a doc_id is refused
_SLOTS = 1 << 10
#: Every so many ids the probabilities and the order-0 id adapt (a power of two); what follows a context is learned at every id.
_PACE = 4
_FULL, _LEAST, _WORD = float(1 << 48), float(1 << 32), float(1 << 16)


class _Coder:
    """The range coder's state of all lanes; 16-bit words of ``data`` are written or read at ``at``, a place in all lanes' words.

    ``low`` stays below 2**49: what it has above 2**48 is a carry, leaves with the next word as that word's 17th bit and is passed on by ``words``.
    """

    def __init__(self, lanes: int, data: np.ndarray, encode: bool):
        self.low, self.range = np.zeros(lanes), np.full(lanes, _FULL)
        self.flat, self.first, self.encoding = data.reshape(-1), np.arange(lanes) * data.shape[1], encode
        self.at = self.first.copy()
        if encode:
            self.at += 1  # before a lane's first word stands a zero
        else:
            for _ in range(3):
                self.low = self.low * _WORD + self.flat[self.at]
                self.at += 1

    def narrow(self, low: np.ndarray, rng: np.ndarray) -> None:
        """The first lanes' new intervals: words until all are wide again. A lane has one word an id mostly, so the first one goes in all lanes at once."""
        m = len(low)
        at = self.at[:m]
        small = rng < _LEAST
        one = small.astype(np.float64)
        if self.encoding:
            word = low * 2.0**-32
            np.floor(word, out=word)
            self.flat[at] = word.astype(np.int32)  # where the lane needs none, the next one comes here
            word *= one
            word *= _LEAST
            low -= word
        scale = one * (_WORD - 1)
        scale += 1
        low *= scale
        rng *= scale
        if not self.encoding:
            one *= self.flat.take(at, mode="clip").astype(np.float64)
            low += one
        at += small.astype(np.int64)
        own = (rng < _LEAST).nonzero()[0]
        if len(own):  # a second word at most: no interval is below 8
            place, part = at.take(own, mode="clip"), low.take(own, mode="clip")
            if self.encoding:
                word = np.floor(part * 2.0**-32)
                self.flat[place] = word.astype(np.int32)
                low[own] = (part - word * _LEAST) * _WORD
            else:
                low[own] = part * _WORD + self.flat.take(place)
            rng[own] *= _WORD
            at[own] = place + 1
        if m == len(self.low):
            self.low, self.range = low, rng
        else:
            self.low[:m], self.range[:m] = low, rng

    def flush(self) -> None:
        high = np.floor(self.low * 2.0**-32)  # with its carry
        for word in (high, *(np.floor(self.low * scale) % _WORD for scale in (2.0**-16, 1.0))):
            self.flat[self.at] = word
            self.at += 1

    def words(self, lane: int) -> np.ndarray:
        """All words of a lane, carries passed on; before the first one stood none."""
        out = self.flat[self.first[lane] : self.at[lane]]
        over = np.flatnonzero(out >> 16)
        while len(over):
            out[over] -= 1 << 16
            over -= 1
            out[over] += 1  # a word that was over has room for it now
            over = over[out[over] >> 16 > 0]
        return out[1:]


def _lockstep(ids: np.ndarray, lengths: np.ndarray, coder: _Coder) -> None:
    """Code (or fill in) ids (steps, lanes); lengths descend, so that the lanes still active are the first ones. Rows of pairs are orders 2 and 1."""
    n, encoding = ids.shape[1], coder.encoding
    known = np.zeros(2 * n * _SLOTS, np.int32)  # by order and context: predicted id * 8 + confidence
    hit = np.full(2 * n * 8, 32768, np.int32)  # by order and confidence: how likely the prediction holds
    weight, hit0 = np.full(n, 128, np.int32), np.full(n, 4096, np.int32)
    most, lead = np.zeros(n, np.int32), np.zeros(n, np.int32)  # order 0: the id that outnumbers the others, by how much
    recent, again = np.zeros(n * 256, np.int16), np.full(n * 8, 32768, np.int32)  # by low byte: the last id's high byte * 8 + confidence
    hashes = np.zeros((2, n), np.uint16)  # of the contexts of orders 2 and 1; slots are bits 5 to 14
    lanes = np.arange(n)
    slots, hits = (np.stack((lanes * size, (lanes + n) * size))for size in (_SLOTS, 8))
    steps = int(lengths[0]) if n else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
    m, edges = n, np.zeros((5, n))
    edges[4] = 65536
    # A choice by a mask is a sum with a factor 0 or 1 here: np.where takes several times as long. Masks become the type that they meet first, as mixed types do.
    for t, now in enumerate(active):
        if now < m:  # some lanes are done
            m = now
            slots, hits, edges, hashes = (np.ascontiguousarray(z[:, :m]) for z in (slots, hits, edges, hashes))
        slot = hashes >> 5
        slot &= _SLOTS - 1
        slot = slot.astype(np.int64)
        slot += slots
        k = known.take(slot, mode="clip")
        p, c = k >> 3, k & 7
        at = c.astype(np.int64)
        at += hits
        h = hit.take(at, mode="clip")
        p2, p1, p0, h2, h1, w, h0 = p[0], p[1], most[:m], h[0], h[1], weight[:m], hit0[:m]
        same = (p1 == p2).astype(np.int32)
        says1 = 65536 - h1
        says1 >>= 2
        says1 += same * (h1 - says1)
        rest = says1 >> 1
        f2 = h2 >> 1  # of both, by weight
        f2 -= rest
        f2 *= w
        f2 >>= 7
        rest <<= 1
        f2 += rest
        np.maximum(f2, 32, out=f2)
        np.minimum(f2, 64000, out=f2)
        f1 = 65536 - f2
        f1 >>= 4
        f1 *= h1 >> 5
        f1 >>= 8
        f1 += 8
        f1 -= same * (f1 - 1)
        a1 = f2 + f1
        f0 = 65536 - a1
        f0 >>= 5
        f0 *= h0 >> 4
        f0 >>= 8
        f0 += 8
        a0 = a1 + f0
        edges[1], edges[2], edges[3] = f2, a1, a0
        low, unit = coder.low[:m], np.floor(coder.range[:m] * 2.0**-16)
        if encoding:
            x = ids[t, :m].astype(np.int32)
            wrong = p != x
            past2, not1 = wrong
            past1 = past2 & not1
            none = past1 & (x != p0)
            choice = past2.view(np.int8) + past1.view(np.int8) + none.view(np.int8)
        else:
            v = np.minimum(low / unit, 65535.0).astype(np.int32)
            none = v >= a0
            choice = (v >= f2).view(np.int8) + (v >= a1).view(np.int8) + none.view(np.int8)
        kind = choice.astype(np.int64)  # the row of its interval
        kind *= m
        kind += lanes[:m]
        if not encoding:
            x = np.concatenate((p2, p1, p0, p0)).take(kind, mode="clip")
        start = edges.take(kind, mode="clip")
        rng = unit * (edges.take(kind + m, mode="clip") - start)
        unit *= start
        low = low + unit if encoding else low - unit
        e = none.nonzero()[0]
        if len(e):  # one symbol of 2**24: the low byte, and in its share the id that last had it or a high byte
            part, unit = low.take(e, mode="clip"), np.floor(rng.take(e, mode="clip") * 2.0**-24)
            if encoding:
                value = x.take(e, mode="clip")
                byte = value & 255
            else:
                v = np.minimum(part / unit, 16777215.0).astype(np.int32)
                byte = v >> 16
            place = (e << 8) + byte.astype(np.int64)
            r = recent.take(place, mode="clip").astype(np.int32)
            cr = r & 7
            at0 = (e << 3) + cr.astype(np.int64)
            ha = again.take(at0, mode="clip")
            fr = ha >> 8
            np.maximum(fr, 8, out=fr)
            np.minimum(fr, 248, out=fr)
            other, mine = 256 - fr, fr << 8  # the shares of a high byte and of the id that last had the low byte
            if encoding:
                high = value >> 8
                held = (high == r >> 3).astype(np.int32)
            else:
                v = (v & 65535) - mine
                held = (v < 0).astype(np.int32)
                high = np.minimum(v / other, 255.0).astype(np.int32)
                high += held * ((r >> 3) - high)
                value = (high << 8) | byte
            start = high * other
            start += mine
            start *= 1 - held
            start += byte << 16
            start = unit * start.astype(np.float64)
            low[e] = part + start if encoding else part - start
            mine -= other
            mine *= held
            mine += other
            rng[e] = unit * mine.astype(np.float64)
            again[at0] = ha + ((held * 65535 - ha) >> 5)
            fresh = high << 3
            fresh += (cr > 1).astype(np.int32) * (r - 2 - fresh)
            r += (cr < 7).astype(np.int32)
            fresh += held * (r - fresh)
            recent[place] = fresh.astype(np.int16)
            if not encoding:
                x[e] = value
        coder.narrow(low, rng)
        if not encoding:
            ids[t, :m] = x
            wrong = p != x
        right = (~wrong).astype(np.int32)
        if t % _PACE == 0:
            is0 = choice == 2
            hit[at] = h + ((right * 65535 - h) >> 4)
            hit0[:m] = h0 + ((is0 * 65535 - h0) >> 4)
            better = ((h2 == says1) | ((h2 > says1) != wrong[0])).astype(np.int32)
            down = w >> 3
            w = w + better * (((256 - w) >> 3) + down) - down
            weight[:m] = np.minimum(np.maximum(w, 8), 248)
            ahead = 2 * (x == p0).astype(np.int32) - 1
            ahead += lead[:m]
            gone = np.flatnonzero(ahead < 0)
            most[gone] = x.take(gone)
            lead[:m] = np.abs(ahead)
        fresh = (wrong & (c == 0)).astype(np.int32)  # nothing is predicted any more: the id that came is
        fresh *= x - p
        fresh += p
        fresh <<= 3
        less = c >> 1
        c += 1
        np.minimum(c, 7, out=c)
        c -= less
        c *= right
        c += less
        c += fresh
        known[slot] = c
        np.left_shift(hashes[1], 1, out=hashes[0])
        np.multiply(x.astype(np.uint16), 40503, out=hashes[1])
        hashes[0] += hashes[1]


def compress(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each array of ids (uint16)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order], np.int64)
    steps = int(lengths[0]) if len(order) else 0
    ids = np.zeros((steps, len(blocks)), np.uint16)
    for k, i in enumerate(order):
        ids[: lengths[k], k] = blocks[i]
    data = np.zeros((len(blocks), 2 * steps + 4), np.int32)  # two words an id at most, and four in the end
    coder = _Coder(len(blocks), data, True)
    _lockstep(ids, lengths, coder)
    coder.flush()
    out = [b""] * len(blocks)
    for k, i in enumerate(order):
        out[i] = coder.words(k).astype("<u2").tobytes()
    return out


def decompress(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids that ``compress`` coded; ``sizes`` are their numbers."""
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    lengths = np.array([sizes[i] for i in order], np.int64)
    data = np.zeros((len(coded), max(map(len, coded), default=0) // 2 + 4), np.uint16)
    for k, i in enumerate(order):
        data[k, : len(coded[i]) // 2] = np.frombuffer(coded[i], "<u2")
    ids = np.zeros((int(lengths[0]) if len(order) else 0, len(coded)), np.uint16)
    _lockstep(ids, lengths, _Coder(len(coded), data, False))
    by_lane = np.ascontiguousarray(ids.T)
    out = [by_lane[:0, :0].ravel()] * len(coded)
    for k, i in enumerate(order):
        out[i] = by_lane[k, : lengths[k]]
    return out


def pack_block(ids: np.ndarray, coded: bytes, doc_ids: list[int], counts: list[int], continues: bool, continued: bool) -> bytes:
    head = _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(coded), zlib.crc32(ids.astype("<u2").tobytes()), continues, continued)
    return head + np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes() + coded


def unpack_block(block: bytes) -> tuple[int, int, bytes, np.ndarray, np.ndarray, bool, bool]:
    """(number of ids, their crc32, coded bytes, doc_ids, counts, first continues, last continues)."""
    magic, n, docs, size, crc, continues, continued = _HEAD.unpack_from(block)
    at = _HEAD.size
    if magic != MAGIC or len(block) != at + 12 * docs + size:
        raise ValueError("not a token block, or cut short")
    return n, crc, block[at + 12 * docs :], np.frombuffer(block, "<i8", docs, at), np.frombuffer(block, "<u4", docs, at + 8 * docs), bool(continues), bool(continued)


def read_blocks(blocks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """(ids, doc_ids, counts, first continues, last continues) of each block; a wrong checksum raises an error."""
    heads = [unpack_block(b) for b in blocks]
    out = []
    for ids, (_, crc, _, doc_ids, counts, continues, continued) in zip(decompress([h[2] for h in heads], [h[0] for h in heads]), heads, strict=True):
        if zlib.crc32(ids.astype("<u2").tobytes()) != crc:
            raise ValueError("token block fails its checksum")
        out.append((ids, doc_ids, counts, continues, continued))
    return out
