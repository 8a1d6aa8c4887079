"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast Walsh-Hadamard
transform. Its cross-polytope hash is the coordinate of largest magnitude with its sign; a table's bucket is two such
hashes. Each vector also probes, in every table, the two buckets that its runner-up coordinates name. Buckets
hold narrow rows; only buckets where something can meet get the vectors, and a large bucket is dealt out as
pairs of blocks, so that no task holds a whole hot bucket. Each pair of a block pair is verified by its cosine
in double precision and counted at one place only, the smallest (table, bucket) where the two meet. Two vectors meet in a
bucket that is one's own and the other's own or probe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, connected_components, lean, on_runs, released, saved

TABLES = 10
#: Vectors in one block of a large bucket, and their bytes; rows of a block that are compared at a time.
BLOCK_ROWS, BLOCK_BYTES, PART_ROWS = 4096, 8 << 20, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, seed: int = 5) -> np.ndarray:
    """int64 array (rows, tables, 3): the own bucket and two probes of every row in every table."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.zeros((n, tables, 3), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for part in range(2):
            signs = np.random.default_rng([seed, t, part]).choice([-1.0, 1.0], (3, size))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            a = np.abs(y)
            top = np.argpartition(-a, 1, axis=1)[:, :2]
            swap = a[rows, top[:, 0]] < a[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            value = [2 * top[:, k] + (y[rows, top[:, k]] < 0) for k in (0, 1)]
            best.append(value[0])
            second.append(value[1])
        wide = 2 * size
        out[:, t, 0] = best[0] * wide + best[1]
        out[:, t, 1] = second[0] * wide + best[1]
        out[:, t, 2] = best[0] * wide + second[1]
    return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two vectors with these codes of one table (last axis: own, two probes) share a bucket that is one's own and the other's own or probe."""
    own_a, own_b = a[..., 0], b[..., 0]
    return (own_a == own_b) | (own_a == b[..., 1]) | (own_a == b[..., 2]) | (own_b == a[..., 1]) | (own_b == a[..., 2])


def first_met(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether this bucket is the smallest of the first table where each pair meets; codes (..., tables, 3) of pairs that meet in it."""
    x, y = a[..., table, :], b[..., table, :]
    own_a, own_b = x[..., 0], y[..., 0]
    out = ~(((own_a == y[..., 1]) | (own_a == y[..., 2])) & (own_a < bucket) | ((own_b == x[..., 1]) | (own_b == x[..., 2])) & (own_b < bucket))
    for t in range(table):
        out &= ~meets(a[..., t, :], b[..., t, :])
    return out


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component once the links (a, b) are added to components that ``root`` names so."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def linked(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two vectors link when their labels are equal and not null, their lengths agree and their cosine in double
    precision is at least ``threshold``. Null or zero vectors and those with null or non-finite components link
    with nothing. Vectors equal in label and components are one class while hashing and count each other as
    links. Rows that repeat a vec_id are separate vectors, each with its own links and component, and equal ones count each other; a null
    vec_id is kept with no links and null component. An empty table gives no rows; other columns are ignored.
    """
    with released(vectors.sparkSession):
        return saved(_linked(vectors, threshold, tables, vec_id, embedding, label), "linked", keep=True)


def _linked(vectors: DataFrame, threshold: float, tables: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``linked``, read from tables that go with the caller's ``released`` block."""
    at = F.col(embedding)
    fine = F.col(label).isNotNull() & at.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(at, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(at, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), at.cast("array<double>").alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    good = rows.where("fine").withColumn("key", F.xxhash64("label", "v"))
    classes = good.groupBy("label", "v", "key").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # a number that is read back from the table

    @lean
    def hashed(batches):
        for batch in batches:
            dims = np.array([len(x) for x in batch.column("v")])
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = np.array(part.column("v").flatten()).reshape(-1, d)
                c = codes(x, tables)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(np.full(len(x), d), pa.int32()), pa.array(list(c.reshape(len(x), -1)), pa.list_(pa.int64()))], ["id", "label", "dim", "codes"])

    label_type = dict(rows.dtypes)["label"]
    marks = saved(classes.select("id", "label", "v").mapInArrow(hashed, f"id long, label {label_type}, dim int, codes array<long>"), "codes")
    entries = marks.select("id", "label", "dim", F.posexplode("codes").alias("at", "bucket")).select("id", "label", "dim", F.expr("cast(at div 3 as int)").alias("t"), "bucket", (F.col("at") % 3 == 0).alias("own")).groupBy("label", "dim", "t", "bucket", "id").agg(F.max("own").alias("own"))
    buckets = entries.groupBy("label", "dim", "t", "bucket").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("n") * F.col("dim") * 8 / BLOCK_BYTES)).cast("int")
    buckets = saved(buckets.withColumn("blocks", blocks).withColumn("b", F.monotonically_increasing_id()).drop("any_own", "n"), "buckets")
    mine = F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int")
    dealt = entries.join(checked(buckets), ["label", "dim", "t", "bucket"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "b", "t", "bucket", "own", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    full = dealt.join(classes.select("id", "v", "size"), "id").join(marks.select("id", "codes"), "id")

    def verify(run: pa.Table) -> pa.Table:
        lo, hi, table, bucket = (run.column(c)[0].as_py() for c in ("lo", "hi", "t", "bucket"))
        mine, ids, size, own = (run.column(c).to_numpy() for c in ("mine", "id", "size", "own"))
        x, c = (run.column(k).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for k in ("v", "codes"))
        c = c.reshape(len(ids), -1, 3)
        if c.max() < 1 << 31:
            c = c.astype(np.int32)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        for part in np.array_split(left, -(-len(left) // PART_ROWS)) if len(left) and len(right) else []:
            near = x[part] @ x[right].T >= threshold
            near &= (own[part][:, None] | own[right][None, :]) & (part[:, None] != right[None, :])
            if near.mean() > 0.05:
                near &= first_met(c[part][:, None], c[right][None, :], table, bucket)
                a, b = np.nonzero(near)
            else:
                a, b = np.nonzero(near)
                met = first_met(c[part[a]], c[right[b]], table, bucket)
                a, b = a[met], b[met]
            a, b = part[a], right[b]
            np.add.at(links, a, size[b])
            if lo != hi:
                np.add.at(links, b, size[a])
            root = united(root, a, b)
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    keys = ["b", "lo", "hi"]
    found = saved(on_runs(full, keys, verify, "id long, links long, root long"), "links")
    comp = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = saved(classes.select("id", "first", "size", "key", "label", "v").join(links, "id", "left").join(comp, "id", "left"), "named")
    first = saved(named.where("component is not null").groupBy("component").agg(F.min("first").alias("component_id")), "first")
    per_class = saved(
        named.join(checked(first), "component", "left")
        .select("key", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")),
        "per_class",
    )
    in_class = good.join(per_class, ["key", "label", "v"]).select("vec_id", "n_links", "component_id")
    apart = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return in_class.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
