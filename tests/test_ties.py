"""Fixed digits of exact ties: queries round them as their SQL's printf does."""

import duckdb
import pytest
from pyspark.sql import functions as F

from angula.functions import columns as C
from angula.plans.queries import ORACLE, QUERIES
from conftest import DATA, TABLES, same_rows

TIED = [12500.0 + 50000 * i for i in range(12)] + [100500.0, 267500.0, 112499.99, 112500.01]  # prices whose resolution ends in 5, and neighbours


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The tables' folder with orders of tied prices, and DuckDB on it."""
    path, con = tmp_path_factory.mktemp("tied"), duckdb.connect()
    for t in TABLES:
        sql = f"SELECT * FROM '{DATA}/{t}.parquet'"
        if t == "orders":
            sql = f"SELECT * REPLACE (CAST({TIED}[o_orderkey % {len(TIED)} + 1] AS DOUBLE) AS o_totalprice) FROM ({sql})"
        con.execute(f"COPY ({sql}) TO '{path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["f5_resolution_label", "l4_entry_table", "k1_observation_export"])
def test_queries_with_ties(spark, tied, name):
    path, con = tied
    mine, theirs = same_rows(QUERIES[name](spark, path), con, ORACLE[name])
    assert mine == theirs and len(mine) > 0


@pytest.mark.parametrize("digits", [0, 2, 3, 6])
def test_even_digits_are_those_of_printf(spark, digits):
    import math

    scale = 10**digits
    v = [x for k in [*range(40), 99, 999, 12345, 999999] for t in [(k + 0.5) / scale] for x in (t, math.nextafter(t, 0), math.nextafter(t, 1e9))]
    v += [k / 2**m for k in range(1, 64) for m in (1, 2, 3, 4, 7, 20)] + [2.0**52 - 0.5, 2.0**52 - 1.5, 1e15 + 0.5, 999.5, 0.9999995, 1e10 + 0.125]
    v += [-x for x in v]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").select("i", C.fixed(F.col("v"), digits, even=True).alias("t")).orderBy("i").collect()
    assert [(v[r.i], r.t) for r in got] == [(x, f"{x:.{digits}f}") for x in v]
