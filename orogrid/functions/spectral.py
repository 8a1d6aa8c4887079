"""Wavenumbers, basis terms and the momentum flux as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import TWO_PI, col


def phase(m_i, m_j, i, j, ni: int, nj: int) -> Column:
    """2 pi (m_i i / ni + m_j j / nj)."""
    return F.lit(TWO_PI) * (col(m_i) * col(i) / F.lit(float(ni)) + col(m_j) * col(j) / F.lit(float(nj)))


def amplitude(a_cos, a_sin) -> Column:
    """The modulus of a mode's coefficient; a missing sine part is zero."""
    c, s = col(a_cos), F.coalesce(col(a_sin), F.lit(0.0))
    return F.sqrt(c * c + s * s)


def flux(ampl, k, l, u: float | Column, v: float | Column, n: float = 0.02) -> Column:  # noqa: E741
    """Vertical flux of zonal momentum of one mode in a uniform wind; 0 where the wave does not move or is not finite."""
    k, l, ampl = col(k), col(l), col(ampl)  # noqa: E741
    om = -k * u - l * v
    kk = k * k + l * l
    m2 = n * n * kk / (om * om) - kk
    m = F.when(om != 0, F.sqrt(F.greatest(m2, F.lit(0.0)))).otherwise(0.0)
    a = F.when(om != 0, -0.5 * ampl * ampl * n * n / om).otherwise(0.0)
    d = kk + m * m
    cg = F.when(d > 0, n * F.sqrt(kk) * m / (d * F.sqrt(d))).otherwise(0.0)
    return F.coalesce(F.nanvl(a * k * cg, F.lit(0.0)), F.lit(0.0))


def prior_weight(k, l, largest, alpha: float, eps: float = 1e-3) -> Column:  # noqa: E741
    """A mode's share of the penalty: (|k| / largest + eps) ** alpha."""
    return F.pow(F.sqrt(col(k) * col(k) + col(l) * col(l)) / col(largest) + eps, alpha)
