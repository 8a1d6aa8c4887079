"""A raster cut into quads of grid lines and their triangles, as relations.

The lines of quads are evenly spread over the raster and truncated to whole indices; a quad is halved by its falling diagonal, so triangles 2q and
2q + 1 share quad q. All follows from indices in whole numbers: a node finds its quad by one division, whatever the raster's size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Grid(NamedTuple):
    """``rows`` by ``columns`` lines of quads over a raster of ni x nj nodes, ``padding`` nodes from its low edges and as many from its high ends."""

    ni: int
    nj: int
    rows: int
    columns: int
    padding: int = 0

    def checked(self) -> Grid:
        if min(self.rows, self.columns) < 2 or self.padding < 0:
            raise ValueError("quads need two lines on each axis and no negative padding")
        if self.ni - 1 - 2 * self.padding < self.rows - 1 or self.nj - 1 - 2 * self.padding < self.columns - 1:
            raise ValueError("more lines than nodes")
        return self


def _line(k: Column, n: int, lines: int, padding: int) -> Column:
    """The index of line k: the evenly spread place, truncated."""
    return F.lit(padding) + F.floor(k * (n - 1 - 2 * padding) / (lines - 1) + 1e-9)


def _quad_of(at: Column, n: int, lines: int, padding: int) -> Column:
    """The quad whose low line is the last at or below the index; the last line belongs to the last quad, null beyond the lines."""
    span = n - 1 - 2 * padding
    k = F.least(F.floor(((at - padding + 1) * (lines - 1) - 1) / span + 1e-9), F.lit(lines - 2).cast("long"))
    return F.when((at >= padding) & (at <= n - 1 - padding), k)


def grid_of(raster: DataFrame, rows: int, columns: int, padding: int = 0) -> Grid:
    """A grid over a raster whose i and j count from 0; their largest values come to the driver. An empty raster is an error."""
    top = raster.agg(F.max("i").alias("i"), F.max("j").alias("j")).head()
    if top["i"] is None:
        raise ValueError("a raster without nodes cannot be cut")
    return Grid(top["i"] + 1, top["j"] + 1, rows, columns, padding).checked()


def triangles(spark: SparkSession, grid: Grid) -> DataFrame:
    """(tri_id, quad, i_verts, j_verts, ci, cj, neighbours): vertices by index, their mean, and the triangles across the edges (partner first)."""
    down, across = grid.rows - 1, grid.columns - 1
    quads = spark.range(down * across).select(F.col("id").cast("int").alias("quad"), F.expr(f"id div {across}").alias("qi"), (F.col("id") % across).alias("qj"))
    i, j = ([_line(F.col(q) + k, n, lines, grid.padding).cast("int") for k in (0, 1)] for q, n, lines in (("qi", grid.ni, grid.rows), ("qj", grid.nj, grid.columns)))
    quad = F.col("quad")
    near = lambda here, step, half: F.when(here, (quad + step) * 2 + half)
    low = F.struct((quad * 2).alias("tri_id"), F.array(i[0], i[1], i[0]).alias("i_verts"), F.array(j[0], j[0], j[1]).alias("j_verts"), F.array(quad * 2 + 1, near(F.col("qi") > 0, -across, 1), near(F.col("qj") > 0, -1, 1)).alias("near"))
    high = F.struct((quad * 2 + 1).alias("tri_id"), F.array(i[1], i[1], i[0]).alias("i_verts"), F.array(j[0], j[1], j[1]).alias("j_verts"), F.array(quad * 2, near(F.col("qi") < down - 1, across, 0), near(F.col("qj") < across - 1, 1, 0)).alias("near"))
    t = quads.withColumn("t", F.explode(F.array(low, high))).select("quad", "t.*")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / 3
    return t.select(F.col("tri_id").cast("int").alias("tri_id"), "quad", "i_verts", "j_verts", mean("i_verts").alias("ci"), mean("j_verts").alias("cj"), F.transform(F.array_compact("near"), lambda x: x.cast("int")).alias("neighbours"))


def located(raster: DataFrame, grid: Grid) -> DataFrame:
    """The raster's nodes in the grid with ``quad``, ``tri_id``, their place ``qi``, ``qj`` in the quad and its numbers of lines ``qni``, ``qnj``.

    A quad has its low lines, the last ones their high lines too; nodes on the diagonal belong to the lower triangle. Nodes in the padding, and with null i or j, are left out.
    """
    out = raster
    for at, quad, place, n_lines, n, lines in (("i", "_qi", "qi", "qni", grid.ni, grid.rows), ("j", "_qj", "qj", "qnj", grid.nj, grid.columns)):
        k = _quad_of(F.col(at), n, lines, grid.padding)
        out = out.withColumn(quad, k).where(F.col(quad).isNotNull())
        low, high = (_line(F.col(quad) + step, n, lines, grid.padding) for step in (0, 1))
        last = (F.col(quad) == lines - 2).cast("int")
        out = out.withColumns({place: (F.col(at) - low).cast("int"), n_lines: (high - low + last).cast("int"), f"_u{at}": (F.col(at) - low) / (high - low)})
    quad = (F.col("_qi") * (grid.columns - 1) + F.col("_qj")).cast("int")
    return out.withColumn("quad", quad).withColumn("tri_id", (quad * 2 + (F.col("_ui") + F.col("_uj") > 1 + 1e-9).cast("int")).cast("int")).drop("_qi", "_qj", "_ui", "_uj")
