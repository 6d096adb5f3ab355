"""Entries and observations as views of the star-schema tables, the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from angula.spec import EntryFilter, FamilySpec, ObsFilter, ParameterSpec

V_ENTRIES = """SELECT o_orderkey AS pid, concat('e', CAST(o_orderkey AS string)) AS entry_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'adna' WHEN '2-HIGH' THEN 'bdna' WHEN '3-MEDIUM' THEN 'zdna' WHEN '4-NOT SPECIFIED' THEN 'quadruplex' ELSE 'other' END AS form,
  CASE o_orderstatus WHEN 'F' THEN 'xray' WHEN 'O' THEN 'nmr' ELSE 'em' END AS method,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 1e5 END AS resolution, o_orderkey % 10 <> 0 AS resolution_known,
  o_custkey % 4 = 0 AS passes_conservative, o_custkey % 4 <= 1 AS passes_mw100, o_custkey % 4 <= 2 AS passes_relaxed, o_custkey % 3 = 0 AS has_duplex_core, o_custkey % 6 = 0 AS all_residues_paired,
  CASE WHEN o_custkey % 5 = 0 THEN 'ZN' ELSE '-' END AS het_names, CAST(o_custkey % 90 + 2 AS int) AS residue_count
  FROM orders"""
V_RESIDUE = """SELECT l_orderkey AS pid, concat('r', CAST(l_linenumber AS string)) AS site_label, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS edge_flag,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS context, l_linestatus AS secondary_context, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS lin,
  l_extendedprice % 720e0 - 360e0 AS ang, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
  FROM lineitem"""
V_PAIR = """SELECT l_orderkey AS pid, concat('r', CAST(l_linenumber AS string), '--r', CAST(l_linenumber + 1 AS string)) AS site_label, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS edge_flag,
  l_extendedprice / 1000 AS shear, CAST((l_partkey * 37) % 360 AS double) AS opening, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
  FROM lineitem"""
ORDER = ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")

LIN = ParameterSpec("lin", range_default=(5.0, 45.0))
ANG = ParameterSpec("ang", circular=True)
SHEAR, OPENING = ParameterSpec("shear"), ParameterSpec("opening", circular=True)
RESIDUE = FamilySpec("backbone", (LIN, ANG), "residue", "context", ("A", "R", "Missing"), "Missing", "secondary_context", ("F", "O"), "", order=ORDER)
SUGAR = FamilySpec("sugar", (LIN, ANG), "residue", "context", ("A", "R", "Missing"), "Missing", "secondary_context", ("F", "O"), "", order=ORDER)
UNLABELLED = FamilySpec("pucker", (LIN, ANG), "residue", "context", ("A", "R", "Missing"), "Missing", None, site=None, order=("site_label", *ORDER))
PAIR = FamilySpec("base_pair", (SHEAR, OPENING), "pair", order=ORDER)
ENTRY = EntryFilter("relaxed", "any", ("xray", "nmr"), "le_2_5", ("adna", "bdna", "zdna", "quadruplex"))
OBS = ObsFilter("exclude", ("A", "Missing"))
ALL = ObsFilter()


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, residue family, pair family)"""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    view = lambda sql, df, name: spark.sql(sql.replace(f"FROM {name}", "FROM {df}"), df=df)
    return view(V_ENTRIES, orders, "orders"), view(V_RESIDUE, lines, "lineitem"), view(V_PAIR, lines, "lineitem")


def standard(df: DataFrame, cols: str) -> DataFrame:
    """Columns 'name:kind': d rounded to 6 places, i as bigint, s and b as they are."""
    from pyspark.sql import functions as F

    how = {"d": lambda c: F.round(c, 6) + 0.0, "i": lambda c: c.cast("long"), "s": lambda c: c, "b": lambda c: c}
    return df.select(*[how[k](F.col(n)).alias(n) for n, k in (x.split(":") for x in cols.split())])


def standard_sql(sql: str, cols: str) -> str:
    how = {"d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "i": "CAST({0} AS BIGINT)", "s": "{0}", "b": "{0}"}
    return sql.replace("SELECT_STANDARD", "SELECT " + ", ".join(how[k].format(n) + f" AS {n}" for n, k in (x.split(":") for x in cols.split())))
