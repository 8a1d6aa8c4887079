"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Sources are cut into blocks of ``block_rows`` documents. Block j of a source with weight w of W in all may not come
before its release floor(j * W / w) and is due at ceil((j + 1) * W / w); in every slot the released block with the
earliest deadline runs. Every deadline is met so, and no source is ever a whole block ahead of or behind its target
weight, however long the schedule is. Weights are whole numbers (``whole_weights``), releases and deadlines are carried
on in whole numbers with their remainders. The schedule is a fold over the slots whose state is the next block of each source. It goes in
segments of ``SEGMENT`` slots: a task reads the state that the segment before has written, folds its own slots and writes
them with its last state, so a row or task holds one segment (some 10 MB) and the sources, however long the schedule is. Segments follow one
another, so the time grows with slots times sources, some 2 s for 54,000 slots of 20 sources; ``block_rows`` sets how many slots a table has.

Every document is placed at least once: the schedule runs until the last source has been through its documents,
and sources that end earlier start over (another epoch). Documents are numbered within their source in two
levels, (source, salt) and within, so a source with a third of all rows is not numbered by one task.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, partitions, saved, shared_path

PERIOD = 1000
BLOCK_ROWS = 8
#: Exponent that flattens the natural shares where no weights are given.
TEMPER = 0.7
#: Slots of one inner fold: appending to an array copies it.
FOLD = 1000
#: Slots that one task folds and one row holds.
SEGMENT = 200_000
#: Rows of one source that one window numbers, about.
WINDOW_ROWS = 20_000_000


def target_weights(counts: list[tuple[str | None, int]], weights: dict[str, float] | None = None, temper: float = TEMPER) -> list[Fraction]:
    """The weight of each (source, n): as given, decimals as they are written, or else n ** temper."""
    given = weights or {}
    if any(not (math.isfinite(w) and w > 0) for w in given.values()):
        raise ValueError("weights must be positive")
    return [Fraction(repr(float(given[s]))) if s in given else Fraction(float(n) ** temper) for s, n in counts]


def whole_weights(exact: list[Fraction]) -> list[int]:
    """Whole numbers in the ratio of the weights; where those exceed 2^60 in all, the nearest at that size, which is as exact as a double."""
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole) or 1
    if sum(whole) // common < 1 << 60:
        return [w // common for w in whole]
    return [max(1, round(w * ((1 << 60) - len(exact)) / sum(exact))) for w in exact]


def whole_shares(exact: list[Fraction], period: int) -> list[int]:
    """Whole slots of a period, at least one each, ``period`` in all: largest remainders; what the ones take comes from the largest shares."""
    if len(exact) > period:
        raise ValueError(f"{len(exact)} sources do not fit a period of {period} slots")
    part = [w * period / sum(exact) for w in exact]
    out = [max(1, math.floor(x)) for x in part]
    spare = period - sum(out) if out else 0
    for k in sorted(range(len(out)), key=lambda k: out[k] - part[k])[: max(0, spare)]:
        out[k] += 1
    for _ in range(-spare):
        out[max(range(len(out)), key=lambda k: (out[k] > 1, out[k] - part[k]))] -= 1
    return out


def _counts(sizes: DataFrame) -> list[tuple[str | None, int]]:
    return sorted(((r["source"], r["n"]) for r in sizes.collect()), key=lambda x: (x[0] is not None, x[0] or ""))


def shares(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, temper: float = TEMPER) -> DataFrame:
    """(source, n, share): the weights as whole slots of a stated period; see ``whole_shares``. ``mixed`` rounds to them only if it is given a period."""
    counts = _counts(sizes)
    rows = [(*c, w) for c, w in zip(counts, whole_shares(target_weights(counts, weights, temper), period), strict=True)]
    return sizes.sparkSession.createDataFrame(rows, "source string, n long, share int")


_BLOCK = "struct<i:int,j:bigint>"
_STATE = "struct<due:bigint,i:int,rel:bigint,j:bigint,q:bigint,r:bigint,w:bigint,a:bigint,b:bigint>"


def schedule(spark, whole: list[int], slots: int) -> DataFrame:
    """(slot, i, j): block j of source i runs in the slot; at least the first ``slots`` slots, by whole weights.

    The state of a source is its next block j: its release, (j + 1) * W as quotient q and remainder r of its weight w, and
    its deadline. The next slot goes to the released block that is due first (ties: the first source).
    """
    total = sum(whole)
    first = [(total // w + (total % w > 0), i, 0, 0, total // w, total % w, w, total // w, total % w) for i, w in enumerate(whole)]
    state = spark.createDataFrame([(first,)] if first else [], f"s array<{_STATE}>")
    carried = "named_struct('rel', x.q, 'q', x.q + x.a + if(x.r >= x.w - x.b, 1L, 0L), 'r', if(x.r >= x.w - x.b, x.r - (x.w - x.b), x.r + x.b))"
    after = f"transform(array({carried}), y -> named_struct('due', y.q + if(y.r > 0, 1L, 0L), 'i', x.i, 'rel', y.rel, 'j', x.j + 1L, 'q', y.q, 'r', y.r, 'w', x.w, 'a', x.a, 'b', x.b))[0]"
    chosen = "array_min(filter(u.s, x -> x.rel <= t))"
    step = f"transform(array({chosen}), c -> named_struct('s', transform(u.s, x -> if(x.i = c.i, {after}, x)), 'run', concat(u.run, array(named_struct('i', c.i, 'j', c.j)))))[0]"
    inner = f"aggregate(sequence(k * {FOLD}L, k * {FOLD}L + {FOLD - 1}L), named_struct('s', v.s, 'run', cast(array() as array<{_BLOCK}>)), (u, t) -> {step})"
    outer = f"transform(array({inner}), z -> named_struct('s', z.s, 'runs', concat(v.runs, array(z.run))))[0]"
    each, last, path = max(1, SEGMENT // FOLD), max(0, slots - 1) // FOLD, shared_path(spark, "schedule")
    for number, low in enumerate(range(0, last + 1, each)):
        folds = f"sequence({low}L, {min(last, low + each - 1)}L)"
        row = state.select(F.lit(low).cast("long").alias("low"), F.expr(f"aggregate({folds}, named_struct('s', s, 'runs', cast(array() as array<array<{_BLOCK}>>)), (v, k) -> {outer})").alias("z"))
        row.select("low", "z.*").write.parquet(f"{path}/segment={number}")
        state = spark.read.parquet(f"{path}/segment={number}").select("s")
    run = spark.read.parquet(path).select("low", F.posexplode("runs").alias("k", "run")).select("low", "k", F.posexplode("run").alias("p", "x"))
    return run.select(((F.col("low") + F.col("k")) * FOLD + F.col("p")).alias("slot"), F.col("x.i").alias("i"), F.col("x.j").alias("j"))


def _placed(cells: DataFrame, order: list[str], names: list[str], weights: dict[str, float] | None, block_rows: int, period: int | None, temper: float) -> DataFrame:
    """source, epoch, slot, position and the columns ``names`` of every placement of the rows of ``cells``, a written table.

    Rows are numbered within (source, salt), in ``order`` there; a row stands for as many as its column ``times`` says, if there is one.
    """
    spark = cells.sparkSession
    several = "times" in cells.columns
    counts = saved(cells.groupBy("source", "salt").agg((F.sum("times") if several else F.count("*")).alias("m")), "cells")
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))), "bases")
    found = _counts(counts.groupBy("source").agg(F.sum("m").alias("n")))
    exact = target_weights(found, weights, temper)
    whole = whole_weights(exact) if period is None else whole_shares(exact, period)
    last = [(n - 1) // block_rows for _, n in found]  # the last block of the first epoch
    slots = max((-(-(k + 1) * sum(whole) // w) for k, w in zip(last, whole, strict=True)), default=0)
    plan = saved(schedule(spark, whole, slots), "plan")
    ends = saved(spark.createDataFrame([(i, s, n, k) for i, ((s, n), k) in enumerate(zip(found, last, strict=True))], "i int, s2 string, n long, last long"), "ends")
    end = plan.join(checked(ends), "i").where("j = last").agg(F.max("slot")).head()[0]
    plan = saved(plan.where(F.col("slot") <= F.lit(-1 if end is None else end)), "plan")
    quota = {r["i"]: r["blocks"] * block_rows for r in plan.groupBy("i").agg(F.count("*").alias("blocks")).collect()}
    quotas = saved(spark.createDataFrame([(i, s, n, quota[i]) for i, (s, n) in enumerate(found)], "k int, s2 string, n long, quota long"), "quotas")
    within = Window.partitionBy("source", "salt").orderBy(*order)
    ahead = F.coalesce(F.sum("times").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if several else F.row_number().over(within) - 1
    numbered = cells.withColumn("ahead", ahead)
    base = counts.select(F.col("source").alias("s1"), F.col("salt").alias("t1"), "base")
    x = numbered.join(checked(base), F.col("source").eqNullSafe(F.col("s1")) & (F.col("salt") == F.col("t1"))).join(checked(quotas), F.col("source").eqNullSafe(F.col("s2")))
    x = x.withColumn("at", F.explode(F.expr("sequence(base + ahead, base + ahead + times - 1)")) if several else F.col("base") + F.col("ahead"))
    x = x.withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - 1 - at) div n)"))).withColumn("g", F.col("epoch") * F.col("n") + F.col("at"))
    x = x.withColumn("block", F.expr(f"g div {block_rows}")).join(checked(plan), (F.col("k") == F.col("i")) & (F.col("block") == F.col("j")))
    position = (F.col("slot") * block_rows + F.expr(f"g % {block_rows}")).cast("long")
    return x.select(*names, "source", F.col("epoch").cast("int").alias("epoch"), "slot", position.alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, temper: float = TEMPER, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, epoch, slot, position for every placement; positions ascend in training order.

    ``position`` is slot * block_rows + place in the block. A null source is a source of its own, null or repeated
    doc_ids are rows like others, an empty table gives no rows,
    other columns are ignored. Weights are kept exactly unless a ``period`` is given, which rounds them to whole shares of it.
    To the driver come the sources with their numbers of documents and of blocks.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source")).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "ids")  # the salt comes from a written row number, so that no value of a column decides how many rows a window holds
    cells = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(max(64, rows.count() // WINDOW_ROWS))).cast("int"))
    return _placed(cells, ["doc_id", "row"], ["doc_id"], weights, block_rows, period, temper)


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_rows: int = BLOCK_ROWS, period: int | None = None, temper: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` as often as the mixture places them, in the order of the mixture, with the same columns.

    A row is named by doc_id, source and a hash of all its columns that can be hashed; rows equal in them are interchangeable, and one of them stands in
    all their places. Nulls are values like others, an empty table gives no rows.

    Rows are numbered by their hashes, so those of a source in one part of the order (there are as many parts as shuffle partitions) are ranges of hashes.
    These ranges, a small table, tell a row the parts that hold it; whole rows are shuffled once, to those parts, and meet their places there.
    """
    spark = docs.sparkSession
    every = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    key = [F.col(doc_id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), every.alias("hash")]
    name = ["id", "source", "hash"]
    keys = saved(docs.select(*key, F.spark_partition_id().alias("scan")).groupBy(*name, "scan").agg(F.count("*").alias("times")), "keys")
    cell = F.shiftright("hash", 64 - max(6, (keys.count() // WINDOW_ROWS).bit_length())).alias("salt")  # cells of a source ascend with the hash
    placed = _placed(keys.select("*", cell), ["hash", "id", "scan"], [*name[::2], "salt"], weights, block_rows, period, temper)
    places = saved(placed.select(*name, "salt", "position"), "places")
    parts, last = partitions(spark), places.agg(F.max("position")).head()[0] or 0
    places = places.withColumn("part", F.expr(f"cast(position * {parts} div {last + 1} as int)"))
    ranges = saved(places.groupBy(F.col("source").alias("s"), F.col("salt").alias("t"), "part").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")), "ranges")
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if keys.groupBy(*name).agg(F.sum("times").alias("n")).where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(name)
    held = F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t")) & F.col("hash").between(F.col("lo"), F.col("hi"))
    moved = rows.select("*", cell).join(checked(ranges), held).select("part", *name, F.lit(None).cast("long").alias("position"), "row")
    there = places.select("part", *name, "position", F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    before = Window.partitionBy("part", *name).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # a null position, the row itself, is first
    met = moved.unionByName(there).repartitionById(parts, "part").withColumn("row", F.first("row", ignorenulls=True).over(before)).where("position IS NOT NULL")
    return met.sortWithinPartitions("position").select("row.*")
