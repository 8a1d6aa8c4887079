"""A corpus as token ids in ascending doc_id order, in files of self-contained blocks.

Documents are dealt by ranges of doc_id, tokenized and coded where they land; a shard is one range, its blocks are
numbered, and laid end to end by shard and block they are the corpus. The files are Parquet tables with one block a row,
so Spark's committers make them whole in any store that Spark writes. ``tokencoder`` has the block's format. A row also tells
how many ids of its shard come before the block, and how many of its first document's ids do, so blocks are read wherever they lie;
only the parts of documents, narrow rows with their checksums, meet again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, partitions, shared_path
from .tokencoder import BLOCK_IDS, LANES, NO_ID, compress, pack_block, read_blocks
from .tokens import encoder, with_end


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write the ids of every text, each followed by ``end_id``; return the path.

    Ids of 2**16 and more are an error. Null texts are empty, null doc_ids come first, rows repeated in doc_id lie next to
    each other, dealt by a hash of their texts, an empty table gives no blocks, other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not 0 <= end_id < 1 << 16:
        raise ValueError(f"the end id {end_id} is not below 65536")

    @lean(keep_held=True)
    def write(batches):
        from pyspark import TaskContext

        shard, number, tokens = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        waiting: list[np.ndarray] = []
        docs_of: list[tuple] = []  # (doc_id, ids not yet in a block, ids that already are)
        first = 0  # ids of the shard before the next block

        def coded(all_: bool):
            nonlocal waiting, docs_of, number, first
            joined = np.concatenate(waiting) if waiting else np.zeros(0, "<u2")
            n = len(joined) if all_ else len(joined) // BLOCK_IDS * BLOCK_IDS
            cuts = [joined[i : min(n, i + BLOCK_IDS)] for i in range(0, n, BLOCK_IDS)]
            waiting, rows, k = [joined[n:].copy()], [], 0
            for part, data in zip(cuts, compress(cuts), strict=True):
                room, names, counts, before = len(part), [], [], docs_of[k][2]
                while room:
                    name, left, coded_ids = docs_of[k]
                    take = min(left, room)
                    names.append(NO_ID if name is None else name)
                    counts.append(take)
                    room -= take
                    docs_of[k] = (name, left - take, coded_ids + take)
                    k += left == take
                continued = k < len(docs_of) and docs_of[k][2] > 0
                rows.append((shard, number, len(part), first, before, pack_block(part, data, names, counts, before > 0, continued)))
                number, first = number + 1, first + len(part)
            docs_of = docs_of[k:]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["shard", "block", "n_ids", "first", "before", "data"])

        size = 0
        for batch in batches:
            if pc.any(pc.equal(batch.column(0), NO_ID)).as_py():
                raise ValueError(f"a doc_id of {NO_ID} cannot be told from null")
            for lo, hi, ids, offsets in tokens.encode(batch.column(1)):
                if ids.dtype.itemsize > 2 and ids.max(initial=0) >= 1 << 16:
                    raise ValueError("ids of 65536 and more do not fit the file format")
                ids, offsets = with_end(ids.astype("<u2"), offsets, end_id)
                waiting.append(ids)
                docs_of += [(name, n, 0) for name, n in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), np.diff(offsets).tolist(), strict=True)]
                size += len(ids)
                if size >= LANES * BLOCK_IDS:
                    yield from coded(False)
                    size = len(waiting[0])
        yield from coded(True)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    path = path or shared_path(spark, "tokens")
    ranged.mapInArrow(write, "shard int, block int, n_ids long, first long, before long, data binary").write.parquet(path)
    return path


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reversed, elementwise."""
    out = np.zeros(len(a), np.uint32)
    for k in range(32):
        out ^= np.where(a >> np.uint32(31 - k) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def joined_crc32(sizes: np.ndarray, crcs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of parts laid end to end, from every part's bytes and CRC-32; ``first`` are the runs' first parts, none empty.

    A part's checksum counts times x ** (8 * bytes after it in its run), so all parts are shifted at once, bit by bit of that number.
    """
    total = np.cumsum(sizes)
    ends = np.append(first[1:], len(sizes)) - 1
    left = np.repeat(total[ends], np.diff(np.append(first, len(sizes)))) - total
    out, power = crcs.astype(np.uint32), np.full(1, 1 << 23, np.uint32)  # x ** 8
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _product(out[odd], np.broadcast_to(power, len(odd)))
        power, left = _product(power, power), left >> 1
    return np.bitwise_xor.reduceat(out, first) if len(first) else out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one number a shard comes to the driver.

    Null doc_ids and documents without ids but the end's come back as they were written, repeated doc_ids each with its own place; no blocks give no rows.
    Blocks are decoded where the result is asked for, each time: ``saved`` keeps it.
    """
    blocks = spark.read.parquet(path)
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = {}, 0
    for shard in sorted(totals):
        bases[shard], total = total, total + totals[shard]
    shared = spark.sparkContext.broadcast(bases)
    names = ["doc_id", "start", "at", "n_tokens", "ids_crc32"]

    @lean
    def read(batches):
        bases = shared.value
        waiting: list[tuple[int, int, bytes]] = []  # ids before the block, its first document's ids before it, the block

        def parts() -> pa.RecordBatch:
            rows = []
            for (at, before, _), (ids, docs, counts, *_) in zip(waiting, read_blocks([b for *_, b in waiting]), strict=True):
                data, place = memoryview(ids.astype("<u4")).cast("B"), 0
                for k, (name, n) in enumerate(zip(docs.tolist(), counts.tolist(), strict=True)):
                    rows.append((None if name == NO_ID else name, at + place - (before if k == 0 else 0), at + place, n, zlib.crc32(data[4 * place : 4 * (place + n)])))
                    place += n
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5, strict=True)], names)

        for batch in batches:
            for shard, first, before, block in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "before", "data")), strict=True):
                waiting.append((bases[shard] + first, before, block))
                if len(waiting) == LANES:
                    yield parts()
        if waiting:
            yield parts()

    def joined(parts: pa.Table) -> pa.Table:
        """One row for each run of parts of one document, at its first part's place."""
        start, n, crc = (parts.column(c).to_numpy() for c in ("start", "n_tokens", "ids_crc32"))
        first = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
        own = parts.select(["doc_id", "start", "at"]).take(pa.array(first))
        return own.append_column("n_tokens", pa.array(np.add.reduceat(n, first))).append_column("ids_crc32", pa.array(joined_crc32(4 * n, crc, first).astype(np.int64)))

    @lean
    def join(batches):
        last: list[pa.RecordBatch] = []  # one row: the document that may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                done = joined(pa.Table.from_batches([*last, batch]).combine_chunks()).combine_chunks()
                yield from done.slice(0, done.num_rows - 1).to_batches()
                last = done.slice(done.num_rows - 1).to_batches()
        yield from last

    schema = "doc_id long, start long, at long, n_tokens long, ids_crc32 long"
    found = blocks.select("shard", "first", "before", "data").mapInArrow(read, schema)
    return found.repartition("start").sortWithinPartitions("start", "at").mapInArrow(join, schema).select("doc_id", "start", "n_tokens", "ids_crc32")
