"""The whole approximation: fit on the rectangle, choice of modes and penalty, refit on the triangle, fluxes, records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import flux
from ..kernels import linear
from ..operators import diagnostics, fits, lsff, modes, sinks
from ..operators import raster as R
from ..session import saved
from .spectral_queries import wave


@dataclass(frozen=True)
class Settings:
    """A run's settings. ``rect`` has the first fit on the whole rectangle; a coarse-grained spectrum (``cg_spsp``) turns it off, and the points inside are fitted.

    ``selector`` names how the strongest modes are chosen: "top" by amplitude, "omp" or "lasso" on the points inside, or a callable
    (system, n) -> columns. ``penalty`` names where the refit's lambda and alpha come from: "fixed" takes ``lmbda_sa`` and ``alpha``,
    "gcv", "evidence" and "cv" choose lambda at ``alpha``, "joint" chooses both. ``prior`` is a callable (system, m_i, m_j, lam) -> diagonal
    in place of the spectral prior.
    """

    nhi: int = 12
    nhj: int = 10
    n_modes: int = 10
    lmbda_fa: float = 0.1
    lmbda_sa: float = 0.1
    u: float = 10.0
    v: float = 0.0
    alpha: float = 0.0
    cg_spsp: bool = False
    full_spectrum: bool = False
    tag: str = "run"
    selector: str | Callable = "top"
    penalty: str = "fixed"
    prior: Callable | None = None
    folds: int = 5
    seed: int | None = 0

    def __post_init__(self):
        if min(self.nhi, self.nhj, self.n_modes) < 1:
            raise ValueError("nhi, nhj and n_modes must be positive")
        if min(self.lmbda_fa, self.lmbda_sa) < 0:
            raise ValueError("penalties must not be negative")
        if not callable(self.selector) and self.selector not in SELECTORS:
            raise ValueError(f"unknown selector {self.selector!r}")
        if self.penalty not in PENALTIES:
            raise ValueError(f"unknown penalty {self.penalty!r}")

    @property
    def rect(self) -> bool:
        return not self.cg_spsp

    def name(self, topo: str, stamp: str) -> str:
        """tag_topo_stamp, the parts that are set."""
        return "_".join(x for x in (self.tag, topo, stamp) if x)


SELECTORS: dict[str, Callable | None] = {"top": None, "omp": linear.omp, "lasso": linear.lasso}
PENALTIES = ("fixed", "gcv", "evidence", "cv", "joint")


def resolved(explicit: dict, context: dict | None = None, compulsory: tuple[str, ...] = ()) -> Settings:
    """Settings from explicit options, then a context's, then the defaults; None counts as not given.

    A compulsory option that neither gives, and an option that does not exist, raise an error.
    """
    known = {f.name for f in fields(Settings)}
    given = {k: v for source in (context or {}, explicit) for k, v in source.items() if v is not None}
    if unknown := sorted(given.keys() - known):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    if missing := [c for c in compulsory if c not in given]:
        raise ValueError(f"compulsory options are missing: {', '.join(missing)}")
    return Settings(**given)


def first_fit(points: DataFrame, s: Settings, ni: int, nj: int) -> DataFrame:
    """The spectrum of every cell on its full rectangle; a cell whose lattice has holes is refitted with its Gram matrix."""
    spark = points.sparkSession
    columns = modes.basis_columns(modes.mode_table(spark, s.nhi, s.nhj))
    whole = points.groupBy("cell_id").agg((F.count("*") == ni * nj).alias("whole"))
    full = points.join(whole.where("whole"), "cell_id").drop("whole")
    fa = lsff.spectrum(lsff.rectangle_fit(full, columns, ni, nj, s.lmbda_fa, ("cell_id",)), ("cell_id",))
    holed = points.join(whole.where("not whole"), "cell_id").drop("whole")
    rest = fits.refit(holed, candidates(whole.where("not whole"), s), ni, nj, s.lmbda_fa)
    return fa.withColumn("cell_id", F.col("cell_id").cast("long")).unionByName(rest)


def candidates(cells: DataFrame, s: Settings) -> DataFrame:
    """All modes of the settings for each cell; the mode table's size is a parameter."""
    table = modes.mode_table(cells.sparkSession, s.nhi, s.nhj).where("not (m_i = 0 and m_j < 0)")
    return cells.select("cell_id").crossJoin(F.broadcast(table))


def chosen_modes(fa: DataFrame, inside: DataFrame, s: Settings, ni: int, nj: int) -> DataFrame:
    """(cell_id, k_idx, l_idx, m_i, m_j): the modes that the second approximation keeps."""
    if s.full_spectrum:
        return fa
    if s.selector == "top":
        return modes.top_modes(fa, s.n_modes)
    selector = s.selector if callable(s.selector) else SELECTORS[s.selector]
    every = fits.systems(inside, candidates(fa.select("cell_id").distinct(), s), ni, nj)
    return fits.selected_by(every, selector, s.n_modes)


def chosen_penalty(inside: DataFrame, selected: DataFrame, s: Settings, ni: int, nj: int) -> DataFrame:
    """(cell_id, alpha, lam) by cell, in the unit that a fit takes: multiples of the mean diagonal."""
    if s.penalty == "cv":
        chosen = fits.spatial_cv(fits.fold_systems(inside, selected, ni, nj, s.folds, seed=s.seed), s.alpha)
        return chosen.select("cell_id", F.lit(float(s.alpha)).alias("alpha"), "lam")
    alpha = s.alpha

    def choose(system: linear.System, m_i: np.ndarray, m_j: np.ndarray) -> list[tuple]:
        k = linear.wavenumbers(m_i, m_j)
        if s.penalty == "joint":
            return [linear.joint_gcv(system, k)[:2]]
        return [(float(alpha), linear.gcv(system, k, alpha)[0] if s.penalty == "gcv" else linear.marginal_likelihood(system))]

    return fits.by_system(fits.systems(inside, selected, ni, nj), choose, "cell_id long, alpha double, lam double")


def empirical_alpha(points: DataFrame, ni: int, nj: int) -> DataFrame:
    """(cell_id, alpha): the exponent at which each lattice's power falls with the wavenumber; a cell whose spectrum gives no slope has 0."""
    every = points.sparkSession.range(ni * nj).select(F.expr(f"cast(id div {nj} as int)").alias("k_idx"), (F.col("id") % nj).cast("int").alias("l_idx"))
    every = every.withColumns({"m_i": F.col("k_idx"), "m_j": F.col("l_idx")})
    power = lsff.periodogram(R.demeaned(points), every, ni, nj, ("cell_id",))
    freq = lambda c, n: F.when(F.col(c) * 2 >= n, F.col(c) - n).otherwise(F.col(c)) / n
    power = power.select("cell_id", F.hypot(freq("m_i", ni), freq("m_j", nj)).alias("kmag"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power"))
    slopes = diagnostics.radial_slope(power, low=0.02 * 0.5, high=0.5 * 0.5, keys=("cell_id",))
    return points.select("cell_id").distinct().join(slopes.select("cell_id", "alpha"), "cell_id", "left").select(F.col("cell_id").cast("long").alias("cell_id"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"))


def built_prior(points: DataFrame, inside: DataFrame, selected: DataFrame, ni: int, nj: int, alpha: float | None = None, lam: float | None = None, joint: bool = False, coords: bool = True, n_folds: int = 5, seed: int | None = 0) -> DataFrame:
    """(cell_id, alpha, lam): the spectral prior of each cell for ``fits.refit``.

    ``joint`` chooses both by one GCV and goes before all else. Otherwise alpha is as given or each lattice's empirical slope, and lam as given or by
    spatial cross-validation at alpha 0 where the points have ``coords``, by GCV at the cell's alpha where not.
    """
    own = fits.systems(inside, selected, ni, nj)
    if joint:
        return fits.by_system(own, lambda s, i, j: [linear.joint_gcv(s, linear.wavenumbers(i, j))[:2]], "cell_id long, alpha double, lam double")
    slope = empirical_alpha(points, ni, nj) if alpha is None else own.select("cell_id", F.lit(float(alpha)).alias("alpha"))
    if lam is not None:
        return slope.withColumn("lam", F.lit(float(lam)))
    if coords:
        return slope.join(fits.spatial_cv(fits.fold_systems(inside, selected, ni, nj, n_folds, seed=seed)).select("cell_id", "lam"), "cell_id")
    return fits.by_system(own.join(slope, "cell_id"), lambda s, i, j, a: [(a, linear.gcv(s, linear.wavenumbers(i, j), a)[0])], "cell_id long, alpha double, lam double", ("alpha",))


def compared_selectors(points: DataFrame, inside, s: Settings, ni: int, nj: int, base: str = "top", lam: float | None = None) -> DataFrame:
    """(cell_id, selector, jaccard, mse) of every selector on each cell's points inside; see ``fits.selector_errors``. lam is ``lmbda_sa`` unless given."""
    z = saved(R.demeaned(points).select("cell_id", "i", "j", "z"), "demeaned")
    within = saved(R.demeaned(inside(z).where("inside").select("cell_id", "i", "j", "z")), "inside")
    folds = fits.fold_systems(within, candidates(within.select("cell_id").distinct(), s), ni, nj, s.folds, seed=s.seed)
    return fits.selector_errors(folds, SELECTORS, s.n_modes, s.lmbda_sa if lam is None else lam, base)


def approximated(points: DataFrame, inside, s: Settings, ni: int, nj: int) -> DataFrame:
    """(cell_id, k_idx, l_idx, m_i, m_j, a_cos, a_sin, ampl, kk, ll, uw): the refit of each cell's chosen modes where ``inside`` holds.

    The demeaned raster is written once, as every branch of the plan reads it.
    """
    z = saved(R.demeaned(points).select("cell_id", "i", "j", "z"), "demeaned")
    within = R.demeaned(inside(z).where("inside").select("cell_id", "i", "j", "z"))
    fa = first_fit(z, s, ni, nj) if s.rect else fits.refit(within, candidates(within.select("cell_id").distinct(), s), ni, nj, s.lmbda_fa)
    selected = chosen_modes(fa, within, s, ni, nj)
    if s.penalty == "fixed":
        sa = fits.refit(within, selected, ni, nj, s.lmbda_sa, s.alpha, s.prior)
    else:
        selected = saved(selected.select("cell_id", "k_idx", "l_idx", "m_i", "m_j"), "selected")
        own = chosen_penalty(within, selected, s, ni, nj)
        sa = fits.refit(within.withColumn("cell_id", F.col("cell_id").cast("long")).join(own, "cell_id"), selected, ni, nj, F.col("lam"), F.col("alpha"), s.prior)
    return wave(sa).withColumn("uw", flux("ampl", "kk", "ll", s.u, s.v))


def records(points: DataFrame, centres: DataFrame, inside, s: Settings, ni: int, nj: int) -> DataFrame:
    """One record per cell: land flag, statistics over the triangle without deep ocean, spacings and packed spectra."""
    z = saved(R.demeaned(points).select("cell_id", "i", "j", "z"), "demeaned")
    land = R.land_flags(z).select("cell_id", "is_land")
    stats = inside(z).where("inside and z >= -200").groupBy("cell_id").agg(F.avg("z").alias("topo_mean"), F.max("z").alias("topo_peak"))
    packed = sinks.packed_spectra(approximated(points.join(land.where("is_land = 1").select("cell_id"), "cell_id"), inside, s, ni, nj), s.n_modes if not s.full_spectrum else s.nhi * s.nhj)
    out = centres.join(land, "cell_id").join(stats, "cell_id", "left").join(packed.withColumnsRenamed({"ampl": "h_spec", "kk": "kks", "ll": "lls"}), "cell_id", "left")
    on_land = F.col("is_land") == 1
    return out.withColumn("dk", F.when(on_land, 1.0 / ni)).withColumn("dl", F.when(on_land, 1.0 / nj)).withColumn("chunk", F.expr(f"cast(cell_id div {sinks.CHUNK} as int)"))


def _fluxes(spectra: DataFrame, s: Settings) -> DataFrame:
    return wave(spectra.withColumn("ampl", F.hypot("a_cos", "a_sin"))).withColumn("uw", flux("ampl", "kk", "ll", s.u, s.v)).groupBy("cell_id").agg(F.sum("uw").alias("uw"))


def refined(points: DataFrame, inside, s: Settings, ni: int, nj: int, tolerance: float = 0.2, cap: int = 10) -> DataFrame:
    """Repeated fits of what is left: while a cell's flux differs from the reference by more than ``tolerance``, its residual is fitted
    again and the amplitudes add up, keeping the strongest. At most ``cap`` rounds; the cells still open are the only ones refitted, and
    ``converged`` tells those that are not open at the end.
    """
    z = saved(R.demeaned(points).select("cell_id", "i", "j", "z"), "demeaned")
    reference = saved(_fluxes(first_fit(z, s, ni, nj), s).withColumnRenamed("uw", "ref"), "reference")
    names = ["cell_id", "k_idx", "l_idx", "m_i", "m_j", "a_cos", "a_sin"]
    total = saved(approximated(points, inside, s, ni, nj).select(*names, F.lit(0).alias("round")), "round")
    for step in range(1, cap + 2):
        off = _fluxes(total, s).join(reference, "cell_id").where(F.abs(F.col("uw") / F.col("ref") - 1) > tolerance).select("cell_id")
        open_ = saved(off, "open")
        if step > cap or not open_.limit(1).count():
            break
        left = lsff.reconstruction(z.join(open_, "cell_id"), total, ni, nj, ("cell_id",)).select("cell_id", "i", "j", (F.col("z") - F.col("recon")).alias("z"))
        more = approximated(left, inside, s, ni, nj).select(names)
        again = total.join(open_, "cell_id", "left_semi").select(names)
        both = again.unionByName(more).groupBy("cell_id", "k_idx", "l_idx", "m_i", "m_j").agg(F.sum("a_cos").alias("a_cos"), F.sum("a_sin").alias("a_sin"))
        kept = modes.top_modes(both.withColumn("ampl", F.hypot("a_cos", "a_sin")), s.n_modes).select(*names, F.lit(step).alias("round"))
        total = saved(total.join(open_, "cell_id", "left_anti").unionByName(kept), "round")
    return total.join(open_.withColumn("_open", F.lit(True)), "cell_id", "left").withColumn("converged", F.col("_open").isNull()).drop("_open")


def compared(points: DataFrame, inside, variants: dict[str, Settings], base: str, ni: int, nj: int) -> tuple[DataFrame, DataFrame]:
    """(spectra, figures) of several settings of the pipeline on the same cells.

    Figures by (variant, cell_id): rmse and rel_rmse of the reconstruction inside, rel_diff (largest flux difference from the base variant
    over its largest flux) and improvement (percent by which the error is below the base's); both are null for the base itself.
    """
    within = saved(R.demeaned(inside(R.demeaned(points)).where("inside").select("cell_id", "i", "j", "z")).withColumn("cell_id", F.col("cell_id").cast("long")), "inside")
    found = [approximated(points, inside, s, ni, nj).withColumn("variant", F.lit(name)) for name, s in variants.items()]
    spectra = found[0]
    for x in found[1:]:
        spectra = spectra.unionByName(x)
    spectra = saved(spectra, "variants")
    names = within.sparkSession.createDataFrame([(n,) for n in variants], "variant string")
    recon = lsff.reconstruction(within.crossJoin(F.broadcast(names)), spectra, ni, nj, ("variant", "cell_id"))
    errors = saved(diagnostics.rmse(recon, ("variant", "cell_id")), "errors")
    every = spectra.select("cell_id", "k_idx", "l_idx").distinct().crossJoin(F.broadcast(names))
    fluxes = every.join(spectra.select("variant", "cell_id", "k_idx", "l_idx", "uw"), ["variant", "cell_id", "k_idx", "l_idx"], "left").fillna(0.0, ["uw"])
    diff = diagnostics.flux_differences(fluxes, "uw", base, ("k_idx", "l_idx"))
    better = diagnostics.improvements(errors, "rmse", base)
    return spectra, errors.join(diff, ["variant", "cell_id"], "left").join(better, ["variant", "cell_id"], "left")
