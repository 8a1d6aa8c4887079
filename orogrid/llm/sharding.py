"""Two-pass external shuffle into shards.

Pass one scatters whole records into memory-sized buckets by a seeded hash of all their columns but maps; the number of buckets
follows from the measured bytes. Pass two loads one bucket at a time, orders it canonically and Fisher-Yates
shuffles it with a generator seeded by (seed, bucket), so a rerun task gives the same order. The buckets
laid end to end are one uniform permutation; record p of it goes to shard p mod n at slot p div n: shard
row counts differ by at most one (law ``rows``) and slots have no gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, new_names, shared_path

BUCKET_BYTES = 24 << 20
#: A bucket this many times too large holds rows that repeat; they are then told apart by their number.
HOT = 4


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): position i swaps with a position drawn from i..n-1."""
    order = np.arange(n)
    with_ = np.arange(n) + (rng.random(n) * (n - np.arange(n))).astype(np.int64)
    for i, j in enumerate(with_.tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def scattered(docs: DataFrame, buckets: int, bucket_bytes: int, seed: int, doc_id: str, text: str, bucket: str) -> tuple[DataFrame, np.ndarray]:
    """(``docs`` with their bucket, rows of each bucket). Rows equal in all columns, where they overfill a bucket, are counted and dealt out by number."""
    (copies,) = new_names(docs, "copies")
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (doc_id, text) and "map<" not in kind]
    place = lambda *more: F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), *rest, *more), F.lit(buckets)).cast("int")
    keyed = docs.withColumn(bucket, place())
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64

    def stats(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).toArrow()  # two numbers a bucket
        rows, total = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        at = got.column(bucket).to_numpy()
        rows[at], total[at] = got.column("n").to_numpy(), got.column("bytes").to_numpy()
        return rows, total

    rows, total = stats(keyed)
    hot = np.flatnonzero(total > HOT * bucket_bytes).tolist()
    if not hot:
        return keyed, rows
    in_hot = F.col(bucket).isin(hot)
    apart = keyed.where(in_hot).groupBy(*docs.columns).agg(F.count("*").alias(copies))
    apart = apart.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).withColumn(bucket, place(F.col(copies)))
    keyed = keyed.where(~in_hot).unionByName(apart.drop(copies))
    return keyed, stats(keyed)[0]


def shuffled(docs: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(the records of ``docs`` with their place in one uniform permutation, from 0 without gaps, and the name of that column).

    One pass measures the bytes, another the rows of each bucket; two numbers a bucket come to the driver. Null ids and
    texts are allowed, rows may repeat (rows equal in all columns are interchangeable), an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    bucket, place = new_names(docs, "bucket", "at")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64).cast("long"))).head()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows, counts = scattered(docs, buckets, bucket_bytes, seed, doc_id, text, bucket)
    before = docs.sparkSession.sparkContext.broadcast(np.cumsum(counts) - counts)
    schema = rows.drop(bucket).withColumn(place, F.lit(0).cast("long")).schema
    order = [(c, "ascending") for c in (doc_id, text, *(c for c, kind in docs.dtypes if c not in (doc_id, text) and "<" not in kind))]

    def shuffle(group: pa.Table) -> pa.Table:
        own = group.column(bucket)[0].as_py()
        ranks = pc.sort_indices(group, sort_keys=order).to_numpy()
        taken = ranks[fisher_yates(len(ranks), np.random.default_rng([seed, own]))]
        out = group.drop_columns([bucket]).take(pa.array(taken))
        return out.append_column(place, pa.array(before.value[own] + np.arange(len(taken)), pa.int64())).cast(to_arrow_schema(schema))

    return rows.groupBy(bucket).applyInArrow(shuffle, schema), place


def write_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write ``docs`` with columns ``shard`` and ``slot`` (which replace columns of those names) as Parquet; return the path.

    Nulls and repeated rows are records like others, an empty table gives no rows, all other columns are kept.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows, at = shuffled(docs.drop("shard", "slot"), seed, bucket_bytes, doc_id, text)
    placed = rows.withColumn("shard", F.expr(f"cast(`{at}` % {n_shards} as int)")).withColumn("slot", F.expr(f"`{at}` div {n_shards}")).drop(at)
    path = path or shared_path(docs.sparkSession, "shards")
    placed.write.parquet(path)
    return path
