"""The registry of queries and the SQL views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

NODE = "CAST(l_quantity AS INT) - 1 AS i, CAST(round(l_discount * 100) AS INT) AS j"
CELL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cell_id"
RASTER = f"raster AS (SELECT {NODE}, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2)"
CELLS = f"cells AS (SELECT {CELL}, {NODE}, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2, 3)"
SERIES = "series AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, avg(value) AS z FROM events GROUP BY 1)"
POINTS = "points AS (SELECT c_custkey AS point_id, c_nationkey * 7.0 - 84.0 AS lat, (c_acctbal + 1000.0) / 11000.0 * 360.0 - 180.0 AS lon FROM customer)"
CENTRES = "centres AS (SELECT s_suppkey AS cell_id, s_nationkey * 7.0 - 84.0 AS lat, (s_acctbal + 1000.0) / 11000.0 * 360.0 - 180.0 AS lon FROM supplier)"


def register(name: str, sql: str | None = None):
    """Add a query (spark, sf_dir) -> DataFrame under ``name``, with the SQL that it must equal."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: Added before rounding, so that means of whole cents, which often lie half way between two roundings, don't.
OFF = 1.7e-8


def rounded(df: DataFrame, places: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, so that the last digits of sums taken in another order don't count; no negative zero."""
    def r(c: str, kind: str) -> Column:
        return (F.round(F.col(c) + OFF, own.get(c, places)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)

    return df.select(*[r(c, k) for c, k in df.dtypes])


def rnd(x: str, places: int = 6) -> str:
    return f"(round({x} + {OFF!r}, {places}) + 0.0)"
