"""Every registered query against its SQL on DuckDB, and the shape of those without SQL."""

import duckdb
import numpy as np
import pytest

from orogrid.kernels import linear
from orogrid.operators import raster as R
from orogrid.plans import catalog
from orogrid.plans.raster_queries import inside_triangle
from orogrid.sources import tables as T

SMALL, WHOLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# complete lattices by return flag exist from sf0.01 on
NEEDS_WHOLE = {"full_spectrum_fit", "pipeline_fa_sa", "pipeline_one_mode", "pipeline_selected", "pipeline_variants", "cell_records", "refinement_loop"}


def folder(name):
    return WHOLE if name in NEEDS_WHOLE else SMALL


@pytest.fixture(scope="module")
def duck():
    found = {}
    for sf in (SMALL, WHOLE):
        found[sf] = c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


def rows(pdf, columns):
    return sorted(map(repr, pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    sf = folder(name)
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck[sf].execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, folder(name)).count() > 0


def test_fit_inside_triangles_equals_a_dense_one(spark):
    """The flagship's amplitudes against NumPy on the points inside, at the scale where lattices are whole."""
    got = catalog.QUERIES["pipeline_fa_sa"](spark, WHOLE).toPandas()
    inside = inside_triangle(R.demeaned(T.cells_raster(spark, WHOLE))).where("inside").toPandas()
    for cell, part in got.groupby("cell_id"):
        p, o = inside[inside.cell_id == cell], part.sort_values(["l_idx", "k_idx"])
        m = linear.basis(p.i.values, p.j.values, o.m_i.values, o.m_j.values, 50, 11)
        a = linear.solve(m.T @ m, m.T @ (p.z - p.z.mean()).values, linear.isotropic(m.T @ m, 0.1))
        assert np.allclose(o.a_cos, a[: len(o)], atol=1e-5)
        assert np.allclose(o.ampl[(o.m_i == 0) & (o.m_j == 0)], np.abs(o.a_cos[(o.m_i == 0) & (o.m_j == 0)]))


def test_tapers_are_not_broadcast(spark):
    """Tiles of like masks are a small file, whose bytes tell nothing of the nodes that come out of it."""
    plan = catalog.QUERIES["taper_field"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
