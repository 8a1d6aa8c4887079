"""Approximation and refinement of pairs of triangles, held against the quad that they make up.

A quad's terrain is fitted whole; its strongest modes are refitted on each of its two triangles. While the pair's flux is off the quad's own by more
than the tolerance, what the quad's fits leave is fitted again, with the sign of the error, and the triangles' amplitudes go down or up by it.
The active set is one of quads: a round's tables hold open quads and their triangles alone, and a pair closes whatever the others do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import flux
from ..operators import diagnostics, fits, lattices, lsff, modes
from ..session import saved
from .pipeline import Settings, candidates

_MODE = "k_idx", "l_idx", "m_i", "m_j"


def _waves(rows: DataFrame, dy: float, dx: float) -> DataFrame:
    """kk and ll of modes (m_i, m_j) on quads of qni x qnj lines that are dy and dx metres apart."""
    turn = F.lit(2 * math.pi)
    return rows.withColumns({"kk": turn * F.col("m_i") / (F.col("qni") * dy), "ll": turn * F.col("m_j") / (F.col("qnj") * dx)})


def reference_fluxes(nodes: DataFrame, s: Settings, dy: float, dx: float) -> DataFrame:
    """(quad, ref): the flux of every wave of each quad's discrete transform; waves that differ in sign alone count once."""
    shapes = nodes.groupBy("quad").agg(F.first("qni").alias("qni"), F.first("qnj").alias("qnj"))
    found = lattices.spectrum(nodes.select(F.col("quad").alias("cell_id"), F.col("qi").alias("i"), F.col("qj").alias("j"), "z"))
    both = found.join(shapes, found.cell_id == shapes.quad).withColumns({"m_i": F.col("l_idx") - F.expr("qni div 2"), "m_j": F.col("k_idx")})
    waves = _waves(both.where("m_j > 0 or m_i > 0"), dy, dx)
    return waves.groupBy("quad").agg(F.sum(flux("ampl", "kk", "ll", s.u, s.v)).alias("ref"))


def _fitted(left: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(fit of each whole quad, refit of its strongest modes on each triangle) of nodes (quad, tri_id, i, j, z); places are shares of the quad."""
    whole = left.select(F.col("quad").cast("long").alias("cell_id"), "i", "j", "z")
    first = saved(fits.refit(whole, candidates(whole.select("cell_id").distinct(), s), 1.0, 1.0, s.lmbda_fa), "quads")
    chosen = modes.top_modes(first, s.n_modes).select(F.explode(F.array(F.col("cell_id") * 2, F.col("cell_id") * 2 + 1)).alias("cell_id"), *_MODE)
    mean = left.groupBy("tri_id").agg(F.avg("z").alias("_mean"))
    inside = left.join(mean, "tri_id").select(F.col("tri_id").cast("long").alias("cell_id"), "i", "j", (F.col("z") - F.col("_mean")).alias("z"))
    second = fits.refit(inside, chosen, 1.0, 1.0, s.lmbda_sa, s.alpha, s.prior)
    return first, second.select(F.expr("cast(cell_id div 2 as int)").alias("quad"), F.col("cell_id").cast("int").alias("tri_id"), *_MODE, "ampl")


def pair_fluxes(spectra: DataFrame, shapes: DataFrame, s: Settings, dy: float, dx: float, share: float = 1.0) -> DataFrame:
    """(quad, uw_0, uw_1, uw_sum, uw_spec_sum): both triangles' fluxes, their sum times ``share``, and half the flux of their added amplitudes times ``share``."""
    own = _waves(spectra.join(shapes, "quad"), dy, dx).withColumn("uw", flux("ampl", "kk", "ll", s.u, s.v))
    half = lambda h: F.coalesce(F.sum(F.when(F.col("tri_id") % 2 == h, F.col("uw"))), F.lit(0.0))
    single = own.groupBy("quad").agg(half(0).alias("uw_0"), half(1).alias("uw_1"))
    added = own.groupBy("quad", *_MODE, "kk", "ll").agg(F.sum("ampl").alias("ampl"))
    summed = added.groupBy("quad").agg((F.sum(flux("ampl", "kk", "ll", s.u, s.v)) / 2 * share).alias("uw_spec_sum"))
    return single.join(summed, "quad").select("quad", "uw_0", "uw_1", ((F.col("uw_0") + F.col("uw_1")) * share).alias("uw_sum"), "uw_spec_sum")


def refined_pairs(nodes: DataFrame, s: Settings, dy: float = 1000.0, dx: float = 1000.0, tolerance: float = 0.2, cap: int = 10, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(spectra, pairs) of the nodes that ``decomposition.located`` gives (quad, tri_id, qi, qj, qni, qnj, z), each quad a whole lattice.

    ``spectra``: (quad, tri_id, k_idx, l_idx, m_i, m_j, ampl) at the end. ``pairs``: (quad, ref, uw_fa, uw_0, uw_1, uw_sum, uw_spec_sum, rel_err, rounds, converged),
    rel_err as a share. A pair's flux is the sum of both triangles', so that a wave which either holds whole counts twice; with a ``share`` of 0.5 it is their mean. At most ``cap`` rounds refine; ``converged`` tells the pairs within the tolerance. A quad without reference flux
    has a null rel_err and is not refined. After a round a triangle keeps its n_modes largest positive amplitudes (ties go to the smaller l, then k).
    """
    nodes = nodes.withColumn("quad", F.col("quad").cast("int"))
    mean = nodes.groupBy("quad").agg(F.avg("z").alias("_mean"))
    z = nodes.join(mean, "quad").select("quad", "tri_id", "qi", "qj", "qni", "qnj", (F.col("qi") / F.col("qni")).alias("i"), (F.col("qj") / F.col("qnj")).alias("j"), (F.col("z") - F.col("_mean")).alias("z"))
    z = saved(z, "pairs")
    shapes = saved(z.groupBy("quad").agg(F.first("qni").alias("qni"), F.first("qnj").alias("qnj")), "shapes")
    reference = saved(reference_fluxes(z, s, dy, dx), "reference")
    first, spectra = _fitted(z, s)
    spectra = saved(spectra, "spectra")
    waves = _waves(first.withColumn("quad", F.col("cell_id").cast("int")).join(shapes, "quad"), dy, dx)
    whole = saved(waves.groupBy("quad").agg(F.sum(flux("ampl", "kk", "ll", s.u, s.v)).alias("uw_fa")), "whole")
    near = F.when(F.col("ref") != 0, F.col("uw_sum") / F.col("ref") - 1)

    def judged(found: DataFrame, of: DataFrame, step: int) -> DataFrame:
        rows = of.select("quad").join(reference, "quad", "left").join(whole, "quad", "left").join(pair_fluxes(found, shapes, s, dy, dx, share), "quad", "left")
        rows = rows.fillna(0.0, ["ref", "uw_0", "uw_1", "uw_sum", "uw_spec_sum"]).withColumn("rel_err", near).withColumn("rounds", F.lit(step))
        return saved(rows.withColumn("converged", F.coalesce(F.abs("rel_err") <= tolerance, F.lit(True))), "judged")

    pairs = judged(spectra, shapes, 0)
    left, sign, closed, done = z.withColumn("recon", F.lit(0.0)), None, [], []
    for step in range(1, cap + 1):
        open_ = saved(pairs.where("not converged").select("quad", F.signum("rel_err").alias("sign")), "open")
        if not open_.limit(1).count():
            break
        done.append(pairs.where("converged"))
        closed.append(spectra.join(open_.select("quad"), "quad", "left_anti"))
        # what the fits so far add up to, each with the sign that its residual had
        grown = lsff.reconstruction(left.withColumnRenamed("recon", "before").withColumn("cell_id", F.col("quad").cast("long")).join(open_.select("quad"), "quad", "left_semi"), first, 1, 1, ("cell_id",))
        turn = F.lit(1.0) if sign is None else -F.col("last")
        grown = grown if sign is None else grown.join(sign.select("quad", F.col("sign").alias("last")), "quad")
        grown = saved(grown.select("quad", "tri_id", "i", "j", "z", (F.col("before") + turn * F.col("recon")).alias("recon")), "grown")
        rest = grown.join(open_, "quad").select("quad", "tri_id", "i", "j", (-F.col("sign") * (F.col("z") - F.col("recon"))).alias("r"))
        means = rest.groupBy("quad").agg(F.avg("r").alias("_mean"))
        first, more = _fitted(saved(rest.join(means, "quad").select("quad", "tri_id", "i", "j", (F.col("r") - F.col("_mean")).alias("z")), "rest"), s)
        old = spectra.join(open_.select("quad"), "quad", "left_semi").withColumn("by", F.col("ampl"))
        new = more.join(open_, "quad").select("quad", "tri_id", *_MODE, "ampl", (-F.col("sign") * F.col("ampl")).alias("by"))
        both = old.unionByName(new).groupBy("quad", "tri_id", *_MODE).agg(F.sum("by").alias("ampl")).where("ampl > 0")
        spectra = saved(modes.top_modes(both, s.n_modes, ("tri_id",)).select("quad", "tri_id", *_MODE, "ampl"), "spectra")
        pairs, left, sign = judged(spectra, open_, step), grown, open_
    for more in closed:
        spectra = spectra.unionByName(more)
    for more in done:
        pairs = pairs.unionByName(more)
    return spectra, pairs


def pair_errors(pairs: DataFrame) -> DataFrame:
    """(tri_id, quad, rel_err, max_err): each pair's errors in percent, relative to its own and to the largest reference, given to both triangles."""
    rows = diagnostics.relative_errors(pairs.select("quad", "uw_sum", F.when(F.col("ref") != 0, F.col("ref")).alias("ref")), "uw_sum", "ref")
    return rows.select(F.explode(F.array(F.col("quad") * 2, F.col("quad") * 2 + 1)).alias("tri_id"), "quad", "rel_err", "max_err")
