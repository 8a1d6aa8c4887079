"""Helpers that several operators share: shared-folder tables, size-checked joins, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys (some tens of bytes each) up to which a checked side is broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session in one process (tests) gets a temporary folder; a cluster's session is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orogrid/{name}-{uuid.uuid4().hex}"


#: The tables to delete, by block, of this thread's ``released`` blocks.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and lost executors lose nothing.

    Inside ``released`` the table goes when the block ends, unless it is to be kept.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if (open_ := _scratch.get()) and not keep:
        open_[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``saved`` writes in this block once it ends: nothing that outlives the block may read them."""
    mine: list[str] = []
    token = _scratch.set((*_scratch.get(), mine))
    try:
        yield
    finally:
        _scratch.reset(token)
        for name in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes in this session, so that batches of whole texts stay small in Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken |= {name, f"{name}_"}
        out.append(name)
    return out


def lean(work: Callable[[Iterator], Iterator] | None = None, keep_held: bool = False) -> Callable:
    """``work`` on a task's batches; the worker, which lives on, then gives the memory that it no longer uses back to the system.

    Unless told to keep it, the task first drops the object that the worker has ``held`` for tasks of another kind.
    """
    if work is None:
        return functools.partial(lean, keep_held=keep_held)

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        if not keep_held:
            let_go()
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
            if trim is not None:
                trim(0)

    return run


def on_runs(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each combination of keys (whole numbers) with two rows or more.

    Rows are sorted by their keys in each partition and stream through; one run and one Arrow batch are held at a time.
    """

    @lean
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of one run
        for batch in batches:
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for k in keys:
                x = batch.column(k).to_numpy()
                change |= x[1:] != x[:-1]
            edge = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edge, edge[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if waiting and any(waiting[-1].column(k)[0] != part.column(k)[0] for k in keys):
                    yield from done(waiting)
                    waiting = []
                waiting.append(part)
        yield from done(waiting)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in parts) > 1:
            yield from work(pa.Table.from_batches(parts).combine_chunks()).to_batches()

    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


_held: dict[str, Any] = {}


def let_go() -> None:
    """In a worker: drop what it holds. A function of the module, as the module's own dictionary is meant, not a copy that travels with a task."""
    _held.clear()


def held(name: str, make: Callable[[], Any]) -> Any:
    """In a worker: what ``make`` gave for ``name``, kept for later tasks until another name is asked for, so that one large object stays."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already saved: counting reads footers) with a broadcast hint if it has at most ``limit`` rows.

    Above the limit it comes back unchanged, and the join shuffles with adaptive skew splitting.
    """
    return F.broadcast(df) if df.count() <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge; the component is its smallest id.

    Contraction: every vertex hooks to its smallest neighbour, hooks are followed twice, edges are renamed
    to their ends' hooks and loops and repeats fall away. The graph shrinks by a constant factor a round, so
    rounds grow with the logarithm of the longest chain. Every round is a written table; only the number of
    edges left comes to the driver. An empty input gives an empty result.
    """
    left = saved(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    comp = None
    while left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("h")).select(F.col("a").alias("id"), "h"), "hook")
        up = hook.select(F.col("id").alias("h"), F.col("h").alias("h2"))
        jump = saved(hook.join(up, "h", "left").select("id", F.coalesce("h2", "h").alias("h")), "jump")
        if comp is None:
            comp = jump.select("id", F.col("h").alias("component"))
        else:
            names = jump.select(F.col("id").alias("component"), "h")
            comp = comp.join(names, "component", "left").select("id", F.coalesce("h", "component").alias("component"))
        comp = saved(comp, "components")
        ja, jb = jump.select(F.col("id").alias("a"), F.col("h").alias("ha")), jump.select(F.col("id").alias("b"), F.col("h").alias("hb"))
        left = saved(left.join(ja, "a").join(jb, "b").where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "edges")
    if comp is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return comp
