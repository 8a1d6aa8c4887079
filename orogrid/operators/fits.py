"""Fits on arbitrary supports, and per-cell kernels on grouped Arrow batches.

A refit's normal equations add up over points, so cells are dealt in blocks of points, as many as their number asks for. Each block yields its
part of the Gram matrix and right-hand side, cut into blocks of ``BLOCK_COLUMNS`` columns; a row holds one of them (128 KB at most), however many
modes a fit has. Parts add up by (cell, block row, block column) in a tree of ``FAN`` rows a node. No task ever holds the points of a whole
cell; a task that solves holds one cell's system, or, for spatial cross-validation, those of one fold, and the selectors of modes and
penalties work on the same sums.

Rows are dealt by cell, sorted, and stream through Python in Arrow batches bounded by bytes, so that many small cells share a batch and
a large one spans several.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import linear
from ..session import bounded_batches, partitions, saved

#: Points of one block, and those whose design matrix is formed at a time.
BLOCK_POINTS, PART_POINTS = 1 << 16, 4096
#: Columns of one block of a Gram matrix, and the rows that a node of the tree adds up.
BLOCK_COLUMNS, FAN = 128, 16
#: Bytes of the matrices that selectors treat at once.
TOGETHER = 8 << 20
#: (system, m_i, m_j, more) -> rows
Kernel = Callable[..., list[tuple]]

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """(first, end) of the runs of rows that are equal in whole-number keys."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in keys:
        x = batch.column(c).fill_null(-1).to_numpy()
        change |= x[1:] != x[:-1]
    edge = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    return list(zip(edge, edge[1:], strict=False)) if batch.num_rows else []


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0)))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's array, a view of the batch."""
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _block_rows(fields: list[tuple[str, pa.DataType]], limit: int = 4 << 20):
    """(add, done): ``add(keys, n, total, values)`` gives a batch of block rows once some bytes have come together, ``done()`` the rest."""
    rows: list[tuple] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if rows:
            *keys, n, total, values = zip(*rows, strict=True)
            columns = [pa.array(c, t) for c, (_, t) in zip(keys, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(total, pa.float64()), _lists(list(values))], [*(c for c, _ in fields), "n", "total", "values"])
        rows.clear()
        size = 0

    def add(row: tuple) -> Iterator[pa.RecordBatch]:
        nonlocal size
        rows.append(row)
        size += row[-1].nbytes + 64
        if size >= limit:
            yield from done()

    return add, done


def normal_equations(points: DataFrame, selected: DataFrame, ni: float, nj: float, block_points: int = BLOCK_POINTS, block_columns: int = BLOCK_COLUMNS, more: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, more, br, bc, n, total, values): the normal equations of the selected modes (cell_id, k_idx, l_idx, m_i, m_j) over each cell's points, in blocks.

    A row with bc >= br holds that block of the Gram matrix, row-major (those below the diagonal are its mirror), a row with bc -1 that piece of the right-hand
    side; n and total (of squared values) are the cell's. ``more`` names whole-number columns of the points that split a cell into several systems.
    Columns are the modes' cosines by (l_idx, k_idx), then their sines. Cells without points or modes have no rows; a mode counts as often as it comes.
    """
    spark = points.sparkSession
    bounded_batches(spark)
    keys = ["cell_id", *more]
    points = points.select(*[F.col(c).cast("long").alias(c) for c in keys], F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    sizes = saved(points.groupBy(*keys).agg(F.ceil(F.count("*") / block_points).cast("int").alias("blocks")), "sizes")
    most = sizes.agg(F.max("blocks")).head()[0] or 0
    dealt = points.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int"))
    own = selected.select(F.col("cell_id").cast("long").alias("cell_id"), "l_idx", "k_idx", F.col("m_i").cast("double").alias("x"), F.col("m_j").cast("double").alias("y")).join(sizes, "cell_id")
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select(*[F.col(c).alias(c) for c in keys], "block", F.lit(0).alias("kind"), "l_idx", "k_idx", "x", "y", F.lit(0.0).alias("z"))
    both = own.unionByName(dealt.select(*keys, "block", F.lit(1).alias("kind"), "x", "y", "z"), allowMissingColumns=True)
    whole = [*keys, "block"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, done = _block_rows([*((c, pa.int64()) for c in keys), ("block", pa.int32()), ("br", pa.int32()), ("bc", pa.int32())])
        now, m_i, m_j, gram, rhs, n, total = None, [], [], None, None, 0, 0.0

        def ended() -> Iterator[pa.RecordBatch]:
            if gram is None:
                return
            for r, top in enumerate(range(0, len(rhs), block_columns)):
                rows = slice(top, top + block_columns)
                yield from add((*now, r, -1, n, total, rhs[rows].copy()))
                for c in range(r, -(-len(rhs) // block_columns)):
                    yield from add((*now, r, c, n, total, gram[rows, c * block_columns : (c + 1) * block_columns].ravel()))

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in whole]
            kind, x, y, z = (batch.column(c).to_numpy() for c in ("kind", "x", "y", "z"))
            for lo, hi in _runs(batch, [*whole, "kind"]):
                key = tuple(c[lo] for c in names)
                if key != now:
                    yield from ended()
                    now, m_i, m_j, gram, rhs, n, total = key, [], [], None, None, 0, 0.0
                if kind[lo] == 0:
                    m_i, m_j = np.append(m_i, x[lo:hi]), np.append(m_j, y[lo:hi])
                elif len(m_i):
                    for at in range(lo, hi, PART_POINTS):
                        rows = slice(at, min(hi, at + PART_POINTS))
                        m = linear.basis(x[rows], y[rows], m_i, m_j, ni, nj)
                        gram, rhs = (m.T @ m, m.T @ z[rows]) if gram is None else (gram + m.T @ m, rhs + m.T @ z[rows])
                        n, total = n + rows.stop - rows.start, total + float(z[rows] @ z[rows])
        yield from ended()
        yield from done()

    schema = ", ".join(f"{c} long" for c in keys) + ", block int, br int, bc int, n long, total double, values array<double>"
    parts = both.repartition(partitions(spark), *whole).sortWithinPartitions(*whole, "kind", "l_idx", "k_idx").mapInArrow(part, schema)
    for _ in range(math.ceil(math.log(most, FAN) - 1e-9) if most > 1 else 0):
        parts = _added(parts.withColumn("part", F.col("block")).withColumn("block", F.expr(f"block div {FAN}").cast("int")), [*keys, "block", "br", "bc"], schema)
    return parts.drop("block")


def _added(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Sums of n, total and values by whole-number keys, rows streaming in order of the keys, one sum held at a time.

    The rows of one sum come in order of their ``part``, so all block rows of a system have the same total to the last bit, however a shuffle mixes them.
    """
    types = [(c, _ARROW[t]) for c, t in (x.split() for x in schema.split(", ")) if c in keys]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, done = _block_rows(types)
        now, n, total, values = None, 0, 0.0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "n", "total")]
            for *key, m, t, v in zip(*columns, _arrays(batch.column("values")), strict=True):
                if key == now:
                    n, total, values = n + m, total + t, values + v
                    continue
                if now is not None:
                    yield from add((*now, n, total, values))
                now, n, total, values = key, m, t, v.copy()
        if now is not None:
            yield from add((*now, n, total, values))
        yield from done()

    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "part").select(*[x.split()[0] for x in schema.split(", ")]).mapInArrow(add_up, schema)


def systems(points: DataFrame, selected: DataFrame, ni: float, nj: float, **options) -> DataFrame:
    """``normal_equations`` with a row for each cell's modes (br -1): l_idx, k_idx, m_i and m_j of each, in the order of the columns."""
    rows = normal_equations(points, selected, ni, nj, **options)
    one = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("l_idx", "k_idx", "m_i", "m_j")])))
    flat = F.flatten(F.transform(one, lambda m: F.array(m["l_idx"], m["k_idx"], m["m_i"], m["m_j"])))
    lists = selected.groupBy(F.col("cell_id").cast("long").alias("cell_id")).agg(flat.alias("values"))
    return rows.unionByName(lists.withColumns({"br": F.lit(-1), "bc": F.lit(-1)}), allowMissingColumns=True)


class Cell(NamedTuple):
    """A cell's modes and further columns, as its systems are read."""

    cell_id: int
    modes: np.ndarray  # l_idx, k_idx, m_i, m_j by row
    more: tuple

    @property
    def m_i(self) -> np.ndarray:
        return self.modes[:, 2]

    @property
    def m_j(self) -> np.ndarray:
        return self.modes[:, 3]


def _systems_of(batches: Iterator[pa.RecordBatch], split: tuple[str, ...], more: tuple[str, ...]) -> Iterator[tuple[Cell, tuple, linear.System]]:
    """(cell, values of ``split``, system) one by one from sorted rows: a cell's modes come first, then the blocks of each system."""
    cell = now = gram = rhs = side = None
    n, total = 0, 0.0

    def finished():
        if gram is not None:
            yield cell, now, linear.System(gram, rhs, total, n)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cell_id", "br", "bc", "n", "total")]
        splits, mores = ([batch.column(c).to_pylist() for c in names] for names in (split, more))
        for k, (cell_id, br, bc, m, t, values) in enumerate(zip(*columns, _arrays(batch.column("values")), strict=True)):
            if br < 0:
                yield from finished()
                cell, now, gram = Cell(cell_id, values.reshape(-1, 4).copy(), tuple(c[k] for c in mores)), None, None
                continue
            key = tuple(c[k] for c in splits)
            if gram is None or key != now:
                yield from finished()
                size = len(cell.modes) + int(((cell.m_i != 0) | (cell.m_j != 0)).sum())
                now, gram, rhs, n, total = key, np.zeros((size, size)), np.zeros(size), m, t
            if br == 0 and bc < 0:
                side = len(values)
            if bc < 0:
                rhs[br * side : br * side + len(values)] = values
            else:
                block = values.reshape(min(side, len(rhs) - br * side), -1)
                rows, across = slice(br * side, br * side + block.shape[0]), slice(bc * side, bc * side + block.shape[1])
                gram[rows, across], gram[across, rows] = block, block.T
    yield from finished()


def on_systems(rows: DataFrame, work: Callable[[Cell, Iterator[tuple[tuple, linear.System]]], list[tuple]], schema: str, split: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``work(cell, its systems one by one)`` for every cell of ``systems`` that has points; ``split`` names the columns that tell a cell's systems apart."""
    return on_cells(rows, lambda cells: (work(cell, own) for cell, own in cells), schema, split, more)


def on_cells(rows: DataFrame, work: Callable[[Iterator[tuple[Cell, Iterator[tuple[tuple, linear.System]]]]], Iterator[list[tuple]]], schema: str, split: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """``on_systems`` for work that takes the stream of a task's (cell, its systems), so that it may treat several cells at once."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells():
            for _, group in groupby(_systems_of(batches, split, more), key=lambda x: x[0].cell_id):
                cell, key, system = next(group)
                rest = ((k, s) for _, k, s in group)
                yield cell, (x for part in ([(key, system)], rest) for x in part)

        out: list[tuple] = []
        for found in work(cells()):
            out += found
            if len(out) >= 10_000:
                yield _batch(out, fields)
                out = []
        yield _batch(out, fields)

    rows = rows.select("cell_id", *split, "br", "bc", "n", "total", "values", *more)
    return rows.repartition(partitions(rows.sparkSession), "cell_id").sortWithinPartitions("cell_id", *(F.col(c).asc_nulls_first() for c in split), "br", "bc").mapInArrow(run, schema)


def by_system(rows: DataFrame, kernel: Kernel, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``kernel(system, m_i, m_j, *more)`` for every cell of ``systems``; the cell_id comes first. ``more`` names further columns."""
    return on_systems(rows, lambda cell, own: [(cell.cell_id, *r) for _, s in own for r in kernel(s, cell.m_i, cell.m_j, *cell.more)], schema, more=more)


def _batch(rows: list[tuple], fields: list[list[str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_MODE = "cell_id long, k_idx int, l_idx int, m_i int, m_j int"


def _named(cell: Cell) -> list[tuple[int, int, int, int, int]]:
    return [(cell.cell_id, k, l, i, j) for l, k, i, j in cell.modes.astype(int).tolist()]


def selected_by(systems_: DataFrame, selector: Callable[[linear.System, int], np.ndarray], n: int) -> DataFrame:
    """(cell_id, k_idx, l_idx, m_i, m_j, rank): the modes of the first n columns that ``selector(system, n)`` picks; a mode counts once."""

    def pick(cell: Cell, own) -> list[tuple]:
        names, out = _named(cell), []
        column = [*range(len(names)), *np.flatnonzero((cell.m_i != 0) | (cell.m_j != 0)).tolist()]
        for _, system in own:
            picked = dict.fromkeys(column[c] for c in selector(system, 2 * n).tolist())
            out += [(*names[k], r + 1) for r, k in enumerate(list(picked)[:n])]
        return out

    return on_systems(systems_, pick, f"{_MODE}, rank int")


def refit(points: DataFrame, selected: DataFrame, ni: float, nj: float, lam: float | Column, alpha: float | Column = 0.0, prior: Callable | None = None, **options) -> DataFrame:
    """(cell_id, k_idx, l_idx, m_i, m_j, a_cos, a_sin, ampl): the second approximation, a fit of the selected modes on the points.

    The penalty is lam times the mean diagonal, weighted by (|m| / max + 0.001) ** alpha; numbers, or columns of the points that are
    constant by cell. ``prior(system, m_i, m_j, lam)`` replaces it by a diagonal of its own. Cells without points have no rows.
    """
    rows = systems(points, selected, ni, nj, **options)
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    if isinstance(lam, Column) or isinstance(alpha, Column):
        own = points.groupBy(F.col("cell_id").cast("long").alias("cell_id")).agg(F.first(as_column(lam)).alias("lam"), F.first(as_column(alpha)).alias("alpha"))
        rows = rows.join(own, "cell_id")
    else:
        rows = rows.withColumns({"lam": F.lit(float(lam)), "alpha": F.lit(float(alpha))})

    def solve(cell: Cell, own) -> list[tuple]:
        out, (lam, alpha) = [], cell.more
        m_i, m_j = cell.m_i, cell.m_j
        k, wave = linear.wavenumbers(m_i, m_j), (m_i != 0) | (m_j != 0)
        for _, s in own:
            penalty = linear.spectral(s.gram, lam, k, alpha) if prior is None else np.asarray(prior(s, m_i, m_j, lam), float)
            if penalty.shape != s.rhs.shape:
                raise ValueError(f"the prior gives {penalty.shape} weights for {len(s.rhs)} columns")
            a = linear.solve(s.gram, s.rhs, penalty)
            sine = np.zeros(len(m_i))
            sine[wave] = a[len(m_i) :]
            out += [(*name, float(c), float(b), float(np.hypot(c, b))) for name, c, b in zip(_named(cell), a, sine, strict=False)]
        return out

    return on_systems(rows, solve, f"{_MODE}, a_cos double, a_sin double, ampl double", more=("lam", "alpha"))


def tilings(points: DataFrame, n_folds: int, seed: int | None, x: str = "j", y: str = "i") -> DataFrame:
    """(cell_id, left, bottom, wide, high, across, down, folds): each cell's ``Tiling``; ``folds`` has the fold of every tile, -1 for none."""
    box = points.groupBy("cell_id").agg(*[f(c).cast("double").alias(f"{f.__name__}_{n}") for n, c in (("x", x), ("y", y)) for f in (F.min, F.max)], F.count("*").alias("size"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell_id", "left", "bottom", "wide", "high", "across", "down", "folds"]
        types = [pa.int64(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            out = []
            for cell, *ends, size in zip(*(batch.column(c).to_pylist() for c in ("cell_id", "min_x", "max_x", "min_y", "max_y", "size")), strict=True):
                if size < 2 * n_folds:
                    raise ValueError(f"cell {cell}: {size} points are too few for {n_folds} folds")
                t = linear.Tiling.drawn(tuple(ends[:2]), tuple(ends[2:]), n_folds, seed)
                out.append((cell, t.left, t.bottom, t.wide, t.high, t.across, t.down, t.fold))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return box.mapInArrow(tile, "cell_id long, left double, bottom double, wide double, high double, across int, down int, folds array<long>")


def folds_of(place: Column, line: Column, buffer: float) -> Column:
    """The folds whose tile, or its surroundings by ``buffer`` of a side, hold a point; ``place`` and ``line`` are in units of tiles, beside the columns of ``tilings``."""

    def near(u: Column, tiles: str) -> Column:
        first, last = F.greatest(F.floor(u - 1 - buffer) + 1, F.lit(0)), F.least(F.floor(u + buffer), F.col(tiles) - 1)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    number = F.flatten(F.transform(near(line, "down"), lambda r: F.transform(near(place, "across"), lambda c: r * F.col("across") + c)))
    return F.filter(F.transform(number, lambda t: F.element_at("folds", (t + 1).cast("int"))), lambda f: f >= 0)


def fold_systems(points: DataFrame, selected: DataFrame, ni: float, nj: float, n_folds: int = 5, buffer: float = 0.1, seed: int | None = None, x: str = "j", y: str = "i", **options) -> DataFrame:
    """``systems`` by (fold, part): sums over all points (fold -1) and over each fold's tile (part 0) and tile with buffer (part 1).

    A fold trains on all points less those of its tile with buffer, so every point is met once and copied only into the tiles it lies in.
    """
    points = points.withColumn("cell_id", F.col("cell_id").cast("long"))
    place, line = (F.col(x).cast("double") - F.col("left")) / F.col("wide"), (F.col(y).cast("double") - F.col("bottom")) / F.col("high")
    member = lambda part, by: F.transform(folds_of(place, line, by), lambda f: F.struct(f.alias("fold"), F.lit(part).alias("part")))
    every = F.array(F.struct(F.lit(-1).cast("long").alias("fold"), F.lit(0).alias("part")))
    spread = points.repartition(partitions(points.sparkSession))
    dealt = spread.join(tilings(points, n_folds, seed, x, y), "cell_id").withColumn("in", F.explode(F.concat(every, member(0, 0.0), member(1, buffer))))
    dealt = saved(dealt.select("cell_id", F.col("in.fold").alias("fold"), F.col("in.part").alias("part"), "i", "j", "z"), "folds")
    return systems(dealt, selected, ni, nj, more=("fold", "part"), **options)


def fold_pairs(cell: Cell, own: Iterator[tuple[tuple, linear.System]], n_folds: int | None = None) -> Iterator[tuple[linear.System, linear.System, linear.System]]:
    """(whole, train, held out) of each fold of a cell of ``fold_systems``, one fold at a time; a fold without points is an error."""
    (_, whole), found = next(own), 0
    for fold, parts in groupby(own, key=lambda x: x[0][0]):
        held = {part: s for (_, part), s in parts}
        if 0 not in held or 1 not in held or whole.n - held[1].n < 2:
            raise ValueError(f"cell {cell.cell_id}: fold {fold} has no points to hold out or too few to train on")
        found += 1
        yield whole, whole - held[1], held[0]
    if n_folds is not None and found != n_folds:
        raise ValueError(f"cell {cell.cell_id}: {n_folds - found} folds have no points to hold out")


def spatial_cv(folds: DataFrame, alpha: float = 0.0, grid: np.ndarray | None = None, n_folds: int | None = None) -> DataFrame:
    """(cell_id, lam, mse): the penalty of least mean held-out error by cell, from ``fold_systems``; a fold without points is an error."""

    def choose(cell: Cell, own) -> list[tuple]:
        k = linear.wavenumbers(cell.m_i, cell.m_j) if alpha else None
        steps, errors, count = grid, 0.0, 0
        for whole, train, held in fold_pairs(cell, own, n_folds):
            steps = linear.lambda_grid(whole.gram) if steps is None else steps
            errors, count = errors + linear.fold_errors(train, held, linear.fold_weights(train, k, alpha), steps), count + 1
        best = int(np.argmin(errors))
        return [(cell.cell_id, float(steps[best]), float(errors[best] / count))]

    return on_systems(folds, choose, "cell_id long, lam double, mse double", split=("fold", "part"))


def selector_errors(folds: DataFrame, selectors: dict[str, Callable[[linear.System, int], np.ndarray] | None], n: int, lam: float, base: str, n_folds: int | None = None) -> DataFrame:
    """(cell_id, selector, jaccard, mse) by nested cross-validation on ``fold_systems``: every fold chooses its own n modes on its training sums, fits them there with
    penalty ``lam`` and is judged on its held-out sums; mse is the mean over folds. ``jaccard`` is the overlap of the modes chosen on all points with those of ``base``.

    A selector maps (system, number of columns) to columns; None stands for the modes of largest amplitude in the regularised fit of all. Ties go to the earlier
    column. The points are never met again: training sums are the whole's less those near the held-out tile. Small systems are gathered up to ``TOGETHER`` bytes, over
    cells, for selectors that take many at once (``linear.SIDE_BY_SIDE``); of large ones a task holds one fold.
    """

    def chosen(trials: list[_Trial], selector) -> list[list[int]]:
        """The modes that a selector picks on each trial's training sums."""
        if selector is None:
            out = []
            for t in trials:
                a = linear.solve(t.train.gram, t.train.rhs, linear.isotropic(t.train.gram, lam))
                size = np.abs(a[: t.of.count])
                size[t.of.waves] = np.hypot(a[t.of.waves], a[t.of.count :])
                out.append(np.argsort(-size, kind="stable")[:n].tolist())
            return out
        many = linear.SIDE_BY_SIDE.get(selector)
        picked = many([t.train for t in trials], 2 * n) if many else [selector(t.train, 2 * n) for t in trials]
        return [list(dict.fromkeys(t.of.column[c] for c in p.tolist()))[:n] for t, p in zip(trials, picked, strict=True)]

    def judge(trials: list[_Trial]) -> None:
        for name, f in selectors.items():
            for t, modes in zip(trials, chosen(trials, f), strict=True):
                if t.held is None:
                    t.of.sets[name] = set(modes)
                    continue
                own_columns = np.array([*modes, *(t.of.sine[k] for k in modes if k in t.of.sine)], int)
                grid = np.ix_(own_columns, own_columns)
                gram = t.train.gram[grid]
                a = linear.solve(gram, t.train.rhs[own_columns], linear.isotropic(gram, lam))
                t.of.errors[name] += linear.System(t.held.gram[grid], t.held.rhs[own_columns], t.held.total, t.held.n).error(a)

    def result(of: _Judged) -> list[tuple]:
        overlap = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        return [(of.cell_id, name, overlap(of.sets[name], of.sets[base]), float(of.errors[name] / of.folds)) for name in selectors]

    def compare(cells) -> Iterator[list[tuple]]:
        trials, size, ended = [], 0, []
        for cell, own in cells:
            of = _Judged(cell, selectors)
            for whole, train, held in fold_pairs(cell, own, n_folds):
                trials += [_Trial(of, train, held)] if of.folds else [_Trial(of, whole, None), _Trial(of, train, held)]
                size += (3 if not of.folds else 2) * whole.gram.nbytes
                of.folds += 1
                if size >= TOGETHER:
                    judge(trials)
                    trials, size = [], 0
            ended.append(of)
            if not trials:
                yield [r for of in ended for r in result(of)]
                ended = []
        if trials:
            judge(trials)
        yield [r for of in ended for r in result(of)]

    return on_cells(folds, compare, "cell_id long, selector string, jaccard double, mse double", split=("fold", "part"))


class _Judged:
    """What a comparison of selectors knows of one cell so far."""

    def __init__(self, cell: Cell, selectors: dict):
        self.cell_id, self.count, self.folds = cell.cell_id, len(cell.modes), 0
        self.waves = np.flatnonzero((cell.m_i != 0) | (cell.m_j != 0))
        self.column = [*range(self.count), *self.waves.tolist()]
        self.sine = {int(k): self.count + p for p, k in enumerate(self.waves)}
        self.errors, self.sets = dict.fromkeys(selectors, 0.0), {}


class _Trial(NamedTuple):
    """Training sums on which modes are chosen, and those that they are judged on (none for the choice on all points)."""

    of: _Judged
    train: linear.System
    held: linear.System | None


def by_cell(points: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``kernel`` (i, j, z arrays of one cell, sorted) for every cell: for kernels on one whole lattice, such as filters.

    A cell's lattice is held by one task; its size is the resolution's, not the table's.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, group):
        group = group.sort_by([("i", "ascending"), ("j", "ascending")])
        rows = [(key[0].as_py(), *r) for r in kernel(*(group.column(c).to_numpy() for c in ("i", "j", "z")))]
        return pa.table(dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}).cast(pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))]))

    return points.select("cell_id", "i", "j", "z").groupBy("cell_id").applyInArrow(run, schema)
