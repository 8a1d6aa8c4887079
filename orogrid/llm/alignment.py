"""Two tokenizers side by side: which of their tokens overlap, and how often each pair of ids does so in the whole corpus.

Both encode a space and the text, so their tokens cover the same bytes. Between two neighbouring ends of either kind lies just one
token of each, so every such stretch is one link, and ends that both share cut the tokens into groups.

Pair counts come from an inverted index of bitmaps. Documents are numbered within blocks of at most ``BLOCK_DOCS``; for each
id pair and block the index holds a stack of compressed bitmaps over these numbers, one for each binary digit of the number of links
that a document has of the pair (multiplicity planes). Slices of texts are OR-merged into their block's bitmaps as they are
read. A plane with fewer than ``BLOCK_DOCS`` / 16 documents is a sorted list of 16-bit numbers, a fuller one a plain bitset; the
length tells which. The population count of all planes' union gives a pair's documents, the planes' own counts times their
digit give its links; both add up over blocks. Then the scores go back along the postings: each pair's count is joined to its rows, and
a block's rows, dealt by block, are added up for each number in it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checked, held, lean, partitions, released, saved
from .tokens import CACHE_CHUNKS, Chunks, Encoder

#: Documents of a block; numbers in it are 16 bits wide.
BLOCK_DOCS = 4096
#: (pair, document) entries after which a block ends early, so that very long documents don't fill a task's memory.
BLOCK_ENTRIES = 3 << 20
#: Stands for a chunk whose tokens' bytes are not its own.
BAD = 65535
_SPACE = "▁"
_DIGITS = np.array([list(f"{i:5d},".encode()) for i in range(1 << 16)], np.uint8)
_SHOWN = _DIGITS != ord(" ")


class Lossless(Encoder):
    """Byte-level ids, special tokens' strings as plain text; a chunk whose tokens' bytes differ from it becomes the one id ``BAD``."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        super().__init__(path, cache_chunks)
        self.tokenizer.encode_special_tokens, self.added = True, []
        if self.kind != "byte" or self.dtype != np.uint16:
            raise ValueError(f"{path} is not a byte-level vocabulary of at most 65535 ids")
        code = {c: b for b, c in enumerate(_byte_chars())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self._table({i: bytes(code[c] for c in t) if all(c in code for c in t) else t.encode() for t, i in vocab.items()})

    def _table(self, tokens: dict[int, bytes]) -> None:
        if max(tokens, default=0) >= BAD:
            raise ValueError("ids must be below 65535")
        self.bytes_of = [tokens.get(i, b"") for i in range(BAD)] + [b""]
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)

    def _true(self, texts: list[str], found: list[list[int]]) -> list[list[int]]:
        return [ids if b"".join([self.bytes_of[i] for i in ids]) == t.encode() else [BAD] for t, ids in zip(texts, found, strict=True)]

    def _flat(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(x) for x in found], np.int32), np.array([i for x in found for i in x], self.dtype)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
        filled = [t for t in texts if t]
        known = iter(self._true(filled, self._ids(filled)))
        count, ids = self._flat([next(known) if t else [] for t in texts])
        return ids, np.concatenate(([0], np.cumsum(count, dtype=np.int64)))

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        count, ids = super()._learned(chunks)
        end = np.cumsum(count).tolist()
        flat = ids.tolist()
        return self._flat(self._true(chunks, [flat[b - n : b] for b, n in zip(end, count.tolist(), strict=True)]))


class Pieces(Lossless):
    """Ids of a sentencepiece model for texts that begin with the space which the model adds.

    No piece of the vocabularies in use has a space after another character, so a text may be cut at every space that
    follows one, and its ids are those of the chunks.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.added, self.dtype = "piece", [], np.uint16
        self.chunks, self.cache_chunks = Chunks(self.dtype), cache_chunks
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in n.lstrip(_SPACE) for n in names):
            self.kind = None  # whole texts
        self.space = [self.model.piece_to_id(_SPACE)]
        self._table({i: b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids if len(t) > 1 else self.space for t, ids in zip(texts, found, strict=True)]

    def _pieces(self, b: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        space = b == 32
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[offsets] = True
        return np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:]) + 1

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat(self._true(chunks, self._ids(chunks)))


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    from .tokens import _BYTE_CHARS

    return [_BYTE_CHARS.get(b, chr(b)) for b in range(256)]


def _kept(ids: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets without the tokens of texts that are not good."""
    count = np.diff(offsets)
    return ids[np.repeat(good, count)], np.concatenate(([0], np.cumsum(np.where(good, count, 0))))


def _bad(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(ids == BAD)))
    return seen[offsets[1:]] > seen[offsets[:-1]]


class Links:
    """Links and groups of one slice of texts: per text counts and digests, per link its text and ``pair`` (A id * 65536 + B id)."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray]):
        good = ~(_bad(*a) | _bad(*b))
        (ids_a, at_a), (ids_b, at_b) = _kept(*a, good), _kept(*b, good)
        self.n_docs, self.n_a, self.n_b = len(good), np.diff(at_a), np.diff(at_b)
        end_a, end_b = np.cumsum(lengths[0][ids_a]), np.cumsum(lengths[1][ids_b])
        mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 0, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        kind = mark[np.flatnonzero(mark)]
        is_a, is_b, both = (kind & 1).astype(bool), kind >= 2, kind == 3
        own_a, own_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        self.doc = np.repeat(np.arange(self.n_docs), self.n_a)[own_a]
        self.pair = ids_a[own_a].astype(np.uint64) << np.uint64(16) | ids_b[own_b]
        self.n_links = np.bincount(self.doc, minlength=self.n_docs)
        self.n_groups = np.bincount(self.doc[both], minlength=self.n_docs)
        self.digests = self._digests(ids_a, at_a, ids_b, at_b, is_a, is_b, both)

    def _digests(self, ids_a, at_a, ids_b, at_b, is_a, is_b, both) -> list[str]:
        """SHA-256 of the groups' decimal ids of each text: a1,a2|b1;a3|b2 and so on; '' for a text without tokens."""
        group = np.cumsum(both) - both
        of_a, of_b = group[is_a], group[is_b]
        n = int(both.sum())
        first_b = np.concatenate(([0], np.cumsum(np.bincount(of_b, minlength=n))))
        end_a = np.cumsum(np.bincount(of_a, minlength=n))
        place_a, place_b = np.arange(len(ids_a)) + first_b[of_a], np.arange(len(ids_b)) + (end_a[of_b] if n else 0)
        ids, mark = np.zeros(len(ids_a) + len(ids_b), np.uint16), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark[place_a[both[is_a]]], mark[place_b[both[is_b]]] = ord("|"), ord(";")
        at = at_a + at_b
        filled = np.flatnonzero(at[1:] > at[:-1])
        signs, shown = _DIGITS[ids], _SHOWN[ids]
        signs[:, 5] = mark
        shown[at[filled + 1] - 1, 5] = False  # nothing after a text's last group
        size = np.concatenate(([0], np.cumsum(shown.sum(1))))[at].tolist()
        text = memoryview(signs[shown])
        out = [""] * self.n_docs
        for k in filled.tolist():
            out[k] = hashlib.sha256(text[size[k] : size[k + 1]]).hexdigest()
        return out

    def entries(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair * 65536 + number of the text counted from ``first``, links) of all that occur, sorted."""
        keys = np.sort(self.pair << np.uint64(16) | (self.doc + first).astype(np.uint64))
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        return keys[new], np.diff(np.append(new, len(keys)))


def planes_of(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(pairs, stacks of bitmaps, links, documents) from sorted keys (pair * 65536 + number) and the links of each."""
    pair, doc = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype(np.uint16)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
    most = np.maximum.reduceat(links, first) if len(first) else links
    depth = np.frexp(most.astype(np.float64))[1].astype(np.int64)  # binary digits
    list_at = np.concatenate(([0], np.cumsum(depth)))
    of, member = [], []
    for plane in range(int(depth.max(initial=0))):
        chosen = np.flatnonzero(links >> plane & 1)
        of.append(list_at[row[chosen]] + plane)
        member.append(doc[chosen])
    of, member = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, member))
    order = np.argsort(of, kind="stable")
    of, member = of[order], member[order].astype(np.uint16)
    count = np.bincount(of, minlength=int(list_at[-1]))
    full = count >= BLOCK_DOCS // 16
    width = np.where(full, BLOCK_DOCS // 16, count)  # in numbers of 16 bits
    at = np.concatenate(([0], np.cumsum(width)))
    data = np.zeros(int(at[-1]), np.uint16)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    short = ~full[of]
    data[at[of[short]] + inside[short]] = member[short]
    for k in np.flatnonzero(full).tolist():
        bits = np.zeros(BLOCK_DOCS, np.uint8)
        lo = int(np.searchsorted(of, k))
        bits[member[lo : lo + count[k]]] = 1
        data[at[k] : at[k + 1]] = np.packbits(bits, bitorder="little").view(np.uint16)
    stack = pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(data)])
    plane = np.arange(len(count)) - np.repeat(list_at[:-1], depth)
    total = np.add.reduceat(count << plane, list_at[:-1]) if len(first) else count
    return pair[first], pa.ListArray.from_arrays(pa.array(list_at.astype(np.int32)), stack), total, np.diff(np.append(first, len(pair)))


def numbers_in(stacks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the text, links that the plane stands for) of every bit that is set in the stacks of bitmaps."""
    depth = stacks.value_lengths().to_numpy()
    flat = stacks.flatten()
    row = np.repeat(np.arange(len(depth)), depth)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = (at - at[0]) // 2
    width = np.diff(at)
    full = width == BLOCK_DOCS // 16
    value = data.view(np.uint16)
    listed = np.repeat(~full, width)
    which = np.repeat(np.arange(len(width)), width)[listed]
    member = value[listed].astype(np.int64)
    for k in np.flatnonzero(full).tolist():
        hit = np.flatnonzero(np.unpackbits(value[at[k] : at[k + 1]].view(np.uint8), bitorder="little"))
        which, member = np.concatenate((which, np.full(len(hit), k))), np.concatenate((member, hit))
    return row[which], member, np.int64(1) << plane[which]


_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_POST = [("pair", pa.int64()), ("planes", pa.list_(pa.binary())), ("links", pa.int64()), ("docs", pa.int64())]
_ALL = pa.schema([("block", pa.int64()), ("number", pa.int32()), *_DOC, *_POST])
_SCHEMA = "block long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, planes array<binary>, links long, docs long"


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ALL], schema=_ALL)


def aligned(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: a row for each document (``pair`` null) and one for each (block, pair) with its stack of bitmaps, links and documents."""
    bounded_batches(docs.sparkSession)

    @lean(keep_held=True)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = held(f"aligned {byte_level} {pieces}", lambda: (Lossless(byte_level), Pieces(pieces)))
        block, n, parts, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def posted() -> Iterator[pa.RecordBatch]:
            keys, links = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
            parts.clear()
            order = np.argsort(keys)
            pair, stacks, total, docs_of = planes_of(keys[order], links[order])
            for lo in range(0, len(pair), 10_000):
                hi = min(len(pair), lo + 10_000)
                yield _batch(hi - lo, block=np.full(hi - lo, block), pair=pair[lo:hi].astype(np.int64), planes=stacks.slice(lo, hi - lo), links=total[lo:hi], docs=docs_of[lo:hi])

        for batch in batches:
            for (lo, hi, *of_a), (_, _, *of_b) in zip(a.encode(batch.column(1), 1 << 19), b.encode(batch.column(1), 1 << 19), strict=True):
                for start in range(lo, hi, BLOCK_DOCS):
                    end = min(hi, start + BLOCK_DOCS)
                    if n and (n + end - start > BLOCK_DOCS or size > BLOCK_ENTRIES):
                        yield from posted()
                        block, n, size = block + 1, 0, 0
                    cut = lambda ids, at: (ids[at[start - lo] : at[end - lo]], at[start - lo : end - lo + 1] - at[start - lo])  # noqa: E731, B023
                    x = Links(cut(*of_a), cut(*of_b), (a.lengths, b.lengths))
                    yield _batch(end - start, block=np.full(end - start, block), number=np.arange(n, n + end - start), doc_id=batch.column(0).slice(start, end - start), n_a=x.n_a, n_b=x.n_b, n_groups=x.n_groups, n_links=x.n_links, groups_sha256=x.digests)
                    parts.append(x.entries(n))
                    n, size = n + end - start, size + len(parts[-1][0])
        if n:
            yield from posted()

    body = F.when(F.length(F.col(text)) > 0, F.concat(F.lit(" "), F.col(text))).otherwise("")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text")).mapInArrow(work, _SCHEMA)


def pair_counts(index: DataFrame) -> DataFrame:
    """pair, a, b, links (of the two ids, in the whole corpus), docs (that have one) and best (no other pair of the B id has more)."""
    pair = F.col("pair")
    found = index.where("pair is not null").groupBy("pair").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    found = saved(found.withColumn("a", F.shiftright(pair, 16).cast("int")).withColumn("b", pair.bitwiseAND(F.lit(65535)).cast("int")), "pairs")
    most = saved(found.groupBy("b").agg(F.max("links").alias("most")), "most")
    return saved(found.join(checked(most), "b").select("pair", "a", "b", "links", "docs", (F.col("links") == F.col("most")).alias("best")), "scores")


def scored_documents(index: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: the pairs' counts returned along the postings to their documents."""
    spark = index.sparkSession
    posts = index.where("pair is not null").select("block", "pair", "planes")
    posts = posts.join(checked(scores.select("pair", "links", F.col("best").cast("long").alias("best"))), "pair")
    docs = index.where("pair is null").select("block", "number", *[c for c, _ in _DOC])
    both = docs.unionByName(posts.select("block", "planes", F.col("links").alias("count"), "best"), allowMissingColumns=True)
    both = both.repartition(partitions(spark), "block").sortWithinPartitions("block", F.col("number").asc_nulls_last())
    names = [*(c for c, _ in _DOC[:5]), "n_best", "count_sum", "groups_sha256"]

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_docs: list[pa.RecordBatch] = []
        own, best, total = None, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            for rows in held_docs:
                at = rows.column("number").to_numpy()
                columns = {"n_best": pa.array(best[at]), "count_sum": pa.array(total[at])}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else rows.column(c) for c in names], names)
            held_docs.clear()
            best[:], total[:] = 0, 0

        for batch in batches:
            block = batch.column("block").to_numpy()
            edge = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
            for lo, hi in zip(edge, edge[1:], strict=False):
                if own is not None and block[lo] != own:
                    yield from done()
                own, part = block[lo], batch.slice(lo, hi - lo)
                n = hi - lo - part.column("number").null_count
                if n:
                    held_docs.append(part.slice(0, n))
                if n < hi - lo:
                    part = part.slice(n)
                    row, number, links = numbers_in(part.column("planes"))
                    np.add.at(total, number, links * part.column("count").to_numpy()[row])
                    np.add.at(best, number, links * part.column("best").to_numpy()[row])
        yield from done()

    return both.mapInArrow(work, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its tokens, groups, links and the scores of its links; see ``scored_documents``.

    Texts are encoded whole, each after a space. A text that is null or empty, or whose tokens of either kind don't give its bytes back, has no
    tokens: zeros and ''. Null or repeated doc_ids are rows like others, ties for a B id's highest count are all best, an empty table
    gives no rows, other columns are ignored. Nothing but numbers of rows comes to the driver; counts of pairs are broadcast only
    while they are few.
    """
    with released(docs.sparkSession):
        index = saved(aligned(docs, os.fspath(byte_level), os.fspath(pieces), doc_id, text), "aligned")
        return saved(scored_documents(index, pair_counts(index)), "alignment", keep=True)
