"""Transforms and stencils on lattices that need not fit into a task.

A Fourier transform goes by axes: lines along j are transformed where they lie, cut into runs of columns, dealt by column run (the transposing
shuffle), transformed along i, and the way back is the same. A task holds one line, or one run of columns with about ``RUN_VALUES`` values.

A stencil goes by square tiles with borders of their neighbours' nodes as wide as the steps of one pass: after that many steps only the
borders have gone wrong. Each pass is one shuffle of tiles and strips, which end where their lattice ends; a task holds some ``STACKED`` bytes of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fields
from ..session import bounded_batches, partitions, saved

#: Values of one run of columns, all lines together.
RUN_VALUES = 1 << 18
#: Nodes of a tile's side, and steps of one pass.
TILE, HALO = 64, 16
#: Bytes of the tiles that take their steps side by side.
STACKED = 1 << 20

_LINE = "cell_id long, run int, i int, ni int, nj int, dy double, dx double, re array<double>, im array<double>"
_NAMES = [x.split()[0] for x in _LINE.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's array, a view of the batch."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str], arrays: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with equal keys; rows are tuples of ``rest`` and ``arrays``, copied, one run held at a time."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*keys, *rest)]
        for *values, in zip(*columns, *(_arrays(batch.column(c)) for c in arrays), strict=True):
            key = tuple(values[: len(keys)])
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append((*values[len(keys) : len(keys) + len(rest)], *(x.copy() for x in values[len(keys) + len(rest) :])))
    if rows:
        yield now, rows


def _lines_out(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes from (cell_id, run, i, ni, nj, dy, dx, complex or real values)."""
    waiting, size = [], 0

    def batch() -> pa.RecordBatch:
        *heads, values = zip(*waiting, strict=True)
        columns = [pa.array(c, t) for c, t in zip(heads, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, _lists([v.real for v in values]), _lists([v.imag if np.iscomplexobj(v) else v[:0] for v in values])], _NAMES)

    for row in rows:
        waiting.append(row)
        size += row[-1].nbytes
        if size >= limit:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()


def _columns_of(points: DataFrame, dy: str | float, dx: str | float, run_values: int) -> DataFrame:
    """The lines of each whole lattice (cell_id, i, j from 0, z), transformed along j and cut into runs of columns, dealt by run and in order of i."""
    spark = points.sparkSession
    bounded_batches(spark)
    step = lambda x: F.first(F.col(x)) if isinstance(x, str) else F.lit(float(x))
    lines = points.groupBy(F.col("cell_id").cast("long").alias("cell_id"), F.col("i").cast("int").alias("i")).agg(F.array_sort(F.collect_list(F.struct("j", F.col("z").cast("double").alias("z")))).alias("line"), step(dy).alias("dy"), step(dx).alias("dx"))
    lines = saved(lines.select("cell_id", "i", "dy", "dx", F.size("line").alias("nj"), F.col("line.z").alias("z")), "lines")
    sizes = lines.groupBy("cell_id").agg(F.count("*").cast("int").alias("ni"), F.min("nj").alias("short"), F.max("nj").alias("long"), F.min("i").alias("low"), F.max("i").alias("high"))
    whole = (F.col("short") == F.col("long")) & (F.col("low") == 0) & (F.col("high") == F.col("ni") - 1)
    sizes = sizes.select("cell_id", F.when(whole, F.col("ni")).otherwise(F.raise_error(F.concat(F.lit("cell "), F.col("cell_id"), F.lit(": not a whole lattice")))).cast("int").alias("ni"))

    def along_j(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                heads = [batch.column(c).to_pylist() for c in ("cell_id", "i", "ni", "nj", "dy", "dx")]
                for cell, i, ni, nj, high, wide, z in zip(*heads, _arrays(batch.column("z")), strict=True):
                    values, side = np.fft.rfft(z), max(1, run_values // ni)
                    for run, at in enumerate(range(0, len(values), side)):
                        yield cell, run, i, ni, nj, high, wide, values[at : at + side]

        yield from _lines_out(rows())

    parts = lines.join(sizes, "cell_id").select("cell_id", "i", "ni", "nj", "dy", "dx", "z").repartition(partitions(spark)).mapInArrow(along_j, _LINE)
    return parts.repartition(partitions(spark), "cell_id", "run").sortWithinPartitions("cell_id", "run", "i")


def _along_i(work: Callable[[tuple, np.ndarray, np.ndarray], np.ndarray], run_values: int) -> Callable:
    """A task over column runs: ``work((ni, nj, dy, dx), first columns' number, matrix)`` gives the matrix whose rows are lines again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (cell, number), lines in _grouped(batches, ["cell_id", "run"], ["i", "ni", "nj", "dy", "dx"], ["re", "im"]):
                shape = lines[0][1:5]
                matrix = np.array([re for *_, re, _ in lines]) + 1j * np.array([im for *_, im in lines])
                columns = number * max(1, run_values // shape[0]) + np.arange(matrix.shape[1])
                for i, values in enumerate(work(shape, columns, matrix)):
                    yield cell, number, i, *shape, values

        yield from _lines_out(rows())

    return run


def low_passed(points: DataFrame, dy: str | float, dx: str | float, scale: float = 5000.0, run_values: int = RUN_VALUES) -> DataFrame:
    """(cell_id, i, j, z): whole lattices without features below ``scale`` metres, demeaned; ``dy`` and ``dx`` are spacings or columns that hold them.

    A lattice with missing nodes is an error, a repeated node as well (its line is too long); a null z makes its whole lattice NaN; an empty table gives no rows.
    """
    spark = points.sparkSession

    def gain(shape: tuple, columns: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        ni, nj, high, wide = shape
        ky, kx = 2 * np.pi * np.fft.fftfreq(ni, high), 2 * np.pi * np.fft.rfftfreq(nj, wide)[columns]
        factor = np.exp(-(ky[:, None] ** 2 + kx[None, :] ** 2) / (2 * np.pi / scale) ** 2)
        factor[0, columns == 0] = 0  # the mean
        return np.fft.ifft(np.fft.fft(matrix, axis=0) * factor, axis=0)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (cell, i), runs in _grouped(batches, ["cell_id", "i"], ["run", "ni", "nj", "dy", "dx"], ["re", "im"]):
                values = np.concatenate([re for *_, re, _ in runs]) + 1j * np.concatenate([im for *_, im in runs])
                yield cell, 0, i, *runs[0][1:5], np.fft.irfft(values, runs[0][2])

        yield from _lines_out(rows())

    passed = _columns_of(points, dy, dx, run_values).mapInArrow(_along_i(gain, run_values), _LINE)
    lines = passed.repartition(partitions(spark), "cell_id", "i").sortWithinPartitions("cell_id", "i", "run").mapInArrow(back, _LINE)
    return lines.select("cell_id", "i", F.posexplode("re").alias("j", "z"))


def spectrum(points: DataFrame, run_values: int = RUN_VALUES) -> DataFrame:
    """(cell_id, l_idx, k_idx, ampl): amplitudes of each lattice's real transform over half its nodes, l_idx in ascending wavenumber."""

    def amplitude(shape: tuple, columns: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        return np.abs(np.fft.fft(matrix, axis=0)) / (shape[0] * shape[1] / 2)

    lines = _columns_of(points, 1.0, 1.0, run_values).mapInArrow(_along_i(amplitude, run_values), _LINE)
    first = F.col("run") * F.greatest(F.lit(1), F.expr(f"{run_values} div ni"))
    out = lines.select("cell_id", F.expr("cast((i + ni div 2) % ni as int)").alias("l_idx"), first.alias("first"), F.posexplode("re").alias("k", "ampl"))
    return out.select("cell_id", "l_idx", (F.col("first") + F.col("k")).cast("int").alias("k_idx"), "ampl")


_TILE = "cell_id long, ti int, tj int, di int, dj int, ni int, nj int, p array<double>, held array<byte>"
_TILE_NAMES = [x.split()[0] for x in _TILE.split(", ")]


def _tiles_out(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0

    def batch() -> pa.RecordBatch:
        *heads, p, held = zip(*waiting, strict=True)
        columns = [pa.array(c, pa.int64() if k == 0 else pa.int32()) for k, c in enumerate(heads)]
        return pa.RecordBatch.from_arrays([*columns, _lists(list(p)), _lists(list(held))], _TILE_NAMES)

    for row in rows:
        waiting.append(row)
        size += row[-2].nbytes
        if size >= limit:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()


def diffused(points: DataFrame, padding: int, steps: int, stencil: str = "OP", dt: float = 0.5, scale: float = 1.0, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """(cell_id, i, j, p): the mask ``inside`` of each lattice (i, j from 0) with ``padding`` nodes around it, diffused outwards, its inside held at one.

    Nodes that are missing or whose mask is null are not inside, repeated ones are inside if one of them is; zeros lie outside the padded lattice. A
    cell has the nodes up to its largest i and j. An empty table gives no rows.
    """
    if not 1 <= halo <= tile:
        raise ValueError("a halo has from 1 to a tile's side of nodes")
    spark = points.sparkSession
    bounded_batches(spark)
    gamma = fields.STENCILS[stencil]
    nodes = points.select(F.col("cell_id").cast("long").alias("cell_id"), (F.col("i") + padding).cast("int").alias("i"), (F.col("j") + padding).cast("int").alias("j"), "inside")
    sizes = nodes.groupBy("cell_id").agg((F.max("i") + 1 + padding).alias("ni"), (F.max("j") + 1 + padding).alias("nj"))
    grid = sizes.withColumn("ti", F.explode(F.expr(f"sequence(0, (ni - 1) div {tile})"))).withColumn("tj", F.explode(F.expr(f"sequence(0, (nj - 1) div {tile})")))
    place = F.expr(f"cast((i % {tile}) * {tile} + j % {tile} as int)")
    own = nodes.where("inside").groupBy("cell_id", F.expr(f"cast(i div {tile} as int)").alias("ti"), F.expr(f"cast(j div {tile} as int)").alias("tj")).agg(F.collect_set(place).alias("at"))
    first = saved(grid.select("cell_id", F.col("ti").cast("int").alias("ti"), F.col("tj").cast("int").alias("tj"), "ni", "nj").join(own.hint("merge"), ["cell_id", "ti", "tj"], "left"), "tiles")

    def window(key: tuple, shape: tuple, axis: int) -> tuple[int, int, int]:
        """How many nodes of the lattice stand before, in and after a tile on one axis, those beyond the halo not counted."""
        at, n = key[1 + axis] * tile, shape[axis]
        return (halo if at else 0), min(tile, n - at), max(0, min(halo, n - at - tile))

    def sent(key: tuple, shape: tuple, p: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        """A tile, for itself and, as strips, for the neighbours that the lattice has."""
        cell, ti, tj = key
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if 0 <= ti + a <= (shape[0] - 1) // tile and 0 <= tj + b <= (shape[1] - 1) // tile:
                    rows, columns = (slice(None) if x == 0 else slice(tile - halo, None) if x > 0 else slice(0, halo) for x in (a, b))
                    yield cell, ti + a, tj + b, -a, -b, *shape, p[rows, columns].ravel(), held[rows, columns].ravel()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for cell, ti, tj, ni, nj, at in zip(*(batch.column(c).to_pylist() for c in ("cell_id", "ti", "tj", "ni", "nj", "at")), strict=True):
                    key, shape = (cell, ti, tj), (ni, nj)
                    held = np.zeros([window(key, shape, x)[1] for x in (0, 1)], np.int8)
                    held[np.divmod(np.array(at or [], int), tile)] = 1
                    yield from sent(key, shape, held.astype(float), held)

        yield from _tiles_out(rows())

    def stepped(n: int, last: bool) -> Callable:
        def moved(waiting: list[tuple]) -> Iterator[tuple]:
            """The tiles of one shape, side by side, after n steps."""
            p, held = np.array([x[2] for x in waiting]), np.array([x[3] for x in waiting])
            for _ in range(n):
                q = np.pad(p, ((0, 0), (1, 1), (1, 1)))
                cross = q[:, :-2, 1:-1] + q[:, 2:, 1:-1] + q[:, 1:-1, :-2] + q[:, 1:-1, 2:] - 4 * p
                diagonal = (q[:, :-2, :-2] + q[:, :-2, 2:] + q[:, 2:, :-2] + q[:, 2:, 2:] - 4 * p) / 2
                p = p + dt * scale * ((1 - gamma) * cross + gamma * diagonal)
                p[held] = 1
            for k, (key, shape, *_) in enumerate(waiting):
                centre = tuple(slice(before, before + own) for before, own, _ in (window(key, shape, x) for x in (0, 1)))
                own_p, own_held = p[k][centre], held[k][centre].astype(np.int8)
                if last:
                    yield *key, 0, 0, *shape, own_p.ravel(), own_held.ravel()
                else:
                    yield from sent(key, shape, own_p, own_held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                waiting: dict[tuple, list[tuple]] = {}
                size = 0
                for key, parts in _grouped(batches, ["cell_id", "ti", "tj"], ["di", "dj", "ni", "nj"], ["p", "held"]):
                    shape = parts[0][2:4]
                    sides = [window(key, shape, x) for x in (0, 1)]
                    p = np.zeros([sum(x) for x in sides])
                    held = np.zeros(p.shape, bool)
                    for di, dj, _, _, values, mask in parts:
                        at = tuple(slice(sum(x[: d + 1]), sum(x[: d + 2])) for d, x in ((di, sides[0]), (dj, sides[1])))
                        p[at], held[at] = values.reshape(p[at].shape), mask.reshape(p[at].shape)
                    waiting.setdefault(p.shape, []).append((key, shape, p, held))
                    size += p.nbytes
                    if size >= STACKED:
                        for own in waiting.values():
                            yield from moved(own)
                        waiting, size = {}, 0
                for own in waiting.values():
                    yield from moved(own)

            yield from _tiles_out(rows())

        return run

    moving = first.repartition(partitions(spark)).mapInArrow(start, _TILE)
    passes = max(1, math.ceil(steps / halo))
    for k in range(passes):
        n = min(halo, steps - k * halo)
        dealt = moving.repartition(partitions(spark), "cell_id", "ti", "tj").sortWithinPartitions("cell_id", "ti", "tj")
        moving = dealt.mapInArrow(stepped(n, k == passes - 1), _TILE)
    out = moving.select("cell_id", "ti", "tj", "ni", "nj", F.posexplode("p").alias("at", "p"))
    wide = f"least({tile}, nj - tj * {tile})"
    return out.select("cell_id", F.expr(f"cast(ti * {tile} + at div {wide} as int)").alias("i"), F.expr(f"cast(tj * {tile} + at % {wide} as int)").alias("j"), "p")
