"""Exact dedup with counting quotient filters.

Every partition of the input builds a counting quotient filter over 64-bit fingerprints of its normalised
texts (A-Z lower-cased, null as empty). A fingerprint's high bits choose a slice, the next ones, its quotient, a home slot in it, and the
slot keeps the rest, the remainder. Remainders of one quotient are a sorted run that starts at its home slot or right after the run
before; one bit a slot tells whether a quotient occurs, one whether a run ends there, one whether the slot holds a digit of
the count of the remainder before it (a count of one takes no slot). Slices of the same range from all partitions meet in one
group and merge losslessly by merging their sorted remainders and adding counts. Fingerprints with a merged count above
one route to byte verification: only texts with such a fingerprint are grouped by their bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checked, lean, new_names, partitions, released, saved
from .words import LOWER_ASCII

#: Texts after which a partition sends its filter, and fingerprints of one slice of the merged filter: they size the pieces, results don't depend on them.
FILTER_TEXTS, SLICE_TEXTS = 1 << 20, 1 << 22
_HEAD = struct.Struct("<iiqq")  # bits of the slice's number, bits of a quotient, slots, slice


def normalised(column: pa.Array) -> list[bytes]:
    """The texts in UTF-8 with A-Z lower-cased; null is empty."""
    return [x.translate(LOWER_ASCII) if x else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def counted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints without repeats, their counts added."""
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(prints)), bool), prints[1:] != prints[:-1])))
    return prints[head], np.add.reduceat(counts, head) if len(head) else counts[:0]


def merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending (fingerprints, counts) as one: every element's place is its own index and the number of smaller ones on the other side."""
    prints, counts = np.empty(len(a[0]) + len(b[0]), np.uint64), np.empty(len(a[0]) + len(b[0]), np.int64)
    for (x, n), (y, _), side in ((a, b, "left"), (b, a, "right")):
        at = np.arange(len(x)) + np.searchsorted(y, x, side)
        prints[at], counts[at] = x, n
    return counted(prints, counts)


class QuotientFilter:
    """A counting quotient filter of the fingerprints of one slice, those whose top ``bits`` bits are ``slice_``."""

    def __init__(self, prints: np.ndarray, counts: np.ndarray, bits: int = 0, slice_: int = 0):
        """From ascending fingerprints without repeats."""
        n = len(prints)
        self.bits, self.slice = bits, slice_
        self.quotient_bits = q = min(max(1, int(n * 4 / 3).bit_length()), 64 - bits - 1)
        self.width = -(-(64 - bits - q) // 8)  # bytes of a slot
        quotient = (prints << np.uint64(bits) >> np.uint64(64 - q)).astype(np.int64) if n else np.zeros(0, np.int64)
        rest = prints & np.uint64((1 << (64 - bits - q)) - 1)
        digits = np.zeros(n, np.int64)  # slots for the count less one
        left = counts - 1
        while (left > 0).any():
            digits += left > 0
            left = left >> 8 * self.width if self.width < 8 else np.zeros(n, np.int64)
        before = np.cumsum(digits + 1) - (digits + 1)
        place = before + np.maximum.accumulate(quotient - before) if n else before
        slots = max(1 << q, int(place[-1] + digits[-1] + 1) if n else 0)
        self.occupied, self.ends, self.counting = np.zeros(1 << q, bool), np.zeros(slots, bool), np.zeros(slots, bool)
        values = np.zeros(slots, np.uint64)
        self.occupied[quotient] = True
        last = np.append(quotient[1:] != quotient[:-1], np.ones(min(1, n), bool))
        self.ends[(place + digits)[last]] = True
        values[place] = rest
        left, step = counts - 1, 1
        while len(at := np.flatnonzero(digits >= step)):
            self.counting[place[at] + step] = True
            values[place[at] + step] = (left[at] & ((1 << 8 * self.width) - 1) if self.width < 8 else left[at]).astype(np.uint64)
            left = left >> 8 * self.width if self.width < 8 else left * 0
            step += 1
        self.slots = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, counts), ascending."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.ends)
        start = np.maximum(quotient, np.append(np.zeros(min(1, len(end)), np.int64), end[:-1] + 1))
        length = end - start + 1
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        of = np.repeat(quotient, length)
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.width] = self.slots[at]
        values, digit = wide.view("<u8").ravel(), self.counting[at]
        own = np.flatnonzero(~digit)
        counts, step = np.ones(len(own), np.int64), 1
        has = np.append(digit, False)
        more = np.ones(len(own), bool)
        while (more := more & has[np.minimum(own + step, len(at))]).any():
            counts[more] += values[own[more] + step].astype(np.int64) << 8 * self.width * (step - 1)
            step += 1
        prints = values[own] | of[own].astype(np.uint64) << np.uint64(64 - self.bits - self.quotient_bits)
        return prints | np.uint64(self.slice << (64 - self.bits) if self.bits else 0), counts

    def pack(self) -> bytes:
        bit = lambda x: np.packbits(x, bitorder="little").tobytes()
        return _HEAD.pack(self.bits, self.quotient_bits, len(self.ends), self.slice) + bit(self.occupied) + bit(self.ends) + bit(self.counting) + self.slots.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        out = cls.__new__(cls)
        out.bits, out.quotient_bits, slots, out.slice = _HEAD.unpack_from(data)
        out.width = -(-(64 - out.bits - out.quotient_bits) // 8)
        at, found = _HEAD.size, []
        for n in (1 << out.quotient_bits, slots, slots):
            found.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n, bitorder="little").astype(bool))
            at += -(-n // 8)
        out.occupied, out.ends, out.counting = found
        out.slots = np.frombuffer(data, np.uint8, slots * out.width, at).reshape(slots, out.width)
        return out


def slices(prints: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(slice, packed filter) of each slice that has fingerprints; they ascend without repeats."""
    part = prints >> np.uint64(64 - bits) if bits else np.zeros(len(prints), np.uint64)
    found, first = np.unique(part, return_index=True)
    return [(int(s), QuotientFilter(prints[a:b], counts[a:b], bits, int(s)).pack()) for s, a, b in zip(found, first, [*first[1:], len(prints)], strict=True)]


def merged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, counts) of packed filters of one slice, merged two by two."""
    left = [QuotientFilter.unpack(x).items() for x in parts]
    while len(left) > 1:
        left = [merge_sorted(*left[k : k + 2]) if k + 1 < len(left) else left[k] for k in range(0, len(left), 2)]
    return left[0]


def fingerprint(text: bytes, bits: int = 64) -> int:
    return xxhash.xxh3_64_intdigest(text) >> (64 - bits) << (64 - bits)


def repeated_fingerprints(docs: DataFrame, text: str = "text", slice_bits: int | None = None, print_bits: int = 64) -> DataFrame:
    """(fp) of every fingerprint with a count above one over all texts. Null counts as the empty text, repeated rows count each, an empty table gives no rows.

    A slice holds 1/2**slice_bits of the filter; by default the number of rows decides: slices of ``SLICE_TEXTS`` fingerprints at most,
    and smaller ones where there would be fewer than shuffle partitions.
    """
    if slice_bits is None:
        n = docs.count()
        slice_bits = max(0, (max(-(-n // SLICE_TEXTS), min(partitions(docs.sparkSession), n >> 10)) - 1).bit_length())

    @lean
    def build(batches):
        have, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []

        def joined():
            new = np.sort(np.array(waiting, np.uint64))
            return merge_sorted(have, counted(new, np.ones(len(new), np.int64)))

        for batch in batches:
            waiting += [fingerprint(x, print_bits) for x in normalised(batch.column(0))]
            if len(waiting) >= FILTER_TEXTS // 16:
                have, waiting = joined(), []
                if len(have[0]) >= FILTER_TEXTS:
                    yield sent(have)
                    have = have[0][:0], have[1][:0]
        have = joined()
        if len(have[0]):
            yield sent(have)

    def sent(have):
        parts = slices(*have, slice_bits)
        return pa.RecordBatch.from_pydict({"slice": pa.array([x[0] for x in parts], pa.int32()), "filter": pa.array([x[1] for x in parts], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        prints, counts = merged(group.column("filter").to_pylist())
        return pa.table({"fp": pa.array(prints[counts > 1].view(np.int64), pa.int64())})

    return docs.select(text).mapInArrow(build, "slice int, filter binary").groupBy("slice").applyInArrow(merge, "fp long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_bits: int | None = None, print_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays (a null doc_id sorts below all). Rows repeated with the same doc_id and equal text
    share ``kept``. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    again = checked(saved(repeated_fingerprints(docs, "text", slice_bits, print_bits), "fingerprints"))

    @lean
    def facts(batches):
        for batch in batches:
            texts = normalised(batch.column(1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "fp": pa.array(np.array([fingerprint(x, print_bits) for x in texts], np.uint64).view(np.int64)),
                "sha": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), "norm": pa.array(texts, pa.binary()),
            })

    rows = docs.mapInArrow(facts, "doc_id long, fp long, sha string, norm binary")
    routed = rows.join(again, "fp", "left_semi")
    groups = routed.groupBy("fp", "norm", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = saved(groups.withColumn("variant", F.row_number().over(_by_sha())).select("sha", "norm", "variant", "keep_id", "group_size"), "groups")
    narrow = rows.select("doc_id", "sha")
    if groups.where("variant > 1").limit(1).count():  # two different texts share a SHA-256: join on the bytes themselves
        joined = rows.join(groups.drop("variant"), ["sha", "norm"], "left")
    else:  # byte verification has shown one text for each SHA-256 among repeated fingerprints
        joined = narrow.join(checked(groups.select("sha", "keep_id", "group_size")), "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def _by_sha():
    return Window.partitionBy("sha").orderBy("norm")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: one of each group of equal texts, that with the largest doc_id.

    Where rows repeat that doc_id with equal texts, one of them stays: that whose text as it is written sorts first (null before empty), then
    whose other columns do, in their order (nulls first, maps not counted), whatever partitions the rows are in.
    A null doc_id stays only where no other has its text. An empty table gives no rows.
    """
    own, hashed, kept = new_names(docs, "gone", "sha", "kept")
    with released(docs.sparkSession):
        found = saved(exact_groups(docs, doc_id, text), "exact")
        gone = checked(saved(found.where("not kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(hashed)).distinct(), "gone", keep=True))
        twice = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias(own))
        twice = saved(twice.distinct(), "twice", keep=True)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), 256)
    # two inequalities, not one equality: the digest is then made only for rows whose doc_id matches
    out = docs.join(gone, F.col(doc_id).eqNullSafe(F.col(own)) & (sha <= F.col(hashed)) & (sha >= F.col(hashed)), "left_anti")
    if not twice.limit(1).count():
        return out
    same, again = F.col(doc_id).eqNullSafe(F.col(own)), checked(twice)
    order = F.struct(F.col(text), *[F.col(f"`{c}`") for c, kind in docs.dtypes if c != text and "map<" not in kind])
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    variants = out.join(again, same, "left_semi").groupBy(F.col(doc_id).alias(own), sha.alias(hashed)).agg(F.min_by(every, order).alias(kept))
    return out.join(again, same, "left_anti").unionByName(variants.select(*[F.col(kept)[c].alias(c) for c in docs.columns]))
