"""Derivation jobs: which entries are canonical, torsions, sugar pucker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from angula.operators.order import in_order
from angula.spec import FamilySpec, ParameterSpec

# Canonical residues; IUPAC torsions as (atom, residue offset).
CANONICAL = ("DA", "DC", "DG", "DT")
PURINES = ("DA", "DG")
BACKBONE = {
    "alpha": (("O3'", -1), ("P", 0), ("O5'", 0), ("C5'", 0)), "beta": (("P", 0), ("O5'", 0), ("C5'", 0), ("C4'", 0)), "gamma": (("O5'", 0), ("C5'", 0), ("C4'", 0), ("C3'", 0)),
    "delta": (("C5'", 0), ("C4'", 0), ("C3'", 0), ("O3'", 0)), "epsilon": (("C4'", 0), ("C3'", 0), ("O3'", 0), ("P", 1)), "zeta": (("C3'", 0), ("O3'", 0), ("P", 1), ("O5'", 1)),
}
SUGAR = {
    "nu0": ("C4'", "O4'", "C1'", "C2'"), "nu1": ("O4'", "C1'", "C2'", "C3'"), "nu2": ("C1'", "C2'", "C3'", "C4'"), "nu3": ("C2'", "C3'", "C4'", "O4'"), "nu4": ("C3'", "C4'", "O4'", "C1'"),
}


def canonical_entries(chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries whose residues are all canonical; scanned and kept counts)."""
    each = chains.groupBy("entry_id").agg(F.every(F.coalesce(F.col("residue").isin(list(CANONICAL)), F.lit(False))).alias("canonical"))
    return each.filter("canonical").select("entry_id"), each.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("canonical").alias("kept"))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Torsion in degrees of four points (structs x, y, z); null if one is missing."""
    sub = lambda p, q: [p[k] - q[k] for k in "xyz"]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    u, v, w = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    return F.degrees(F.atan2(F.sqrt(dot(v, v)) * dot(u, n2), dot(n1, n2)))


def _residues(atoms: DataFrame, names: set[str]) -> DataFrame:
    """One row a residue with a struct for each named atom."""
    at = lambda n: F.first(F.when(F.col("atom") == n, F.struct("x", "y", "z")), ignorenulls=True).alias(n)
    return atoms.filter(F.col("atom").isin(sorted(names))).groupBy("entry_id", "chain_id", "res_seq", "res_name").agg(*[at(n) for n in sorted(names)])


KEY = ["entry_id", "chain_id", "res_seq", "res_name"]
TORSION_ATOMS = {a for t in BACKBONE.values() for a, _ in t} | {"O4'", "C1'", "N9", "C4", "N1", "C2"}
SUGAR_ATOMS = {a for t in SUGAR.values() for a in t}


def _with_torsions(r: DataFrame) -> DataFrame:
    """Residues with alpha to zeta and chi."""
    w = W.partitionBy("entry_id", "chain_id").orderBy("res_seq")

    def atom(name: str, offset: int) -> Column:
        if offset == 0:
            return F.col(f"`{name}`")
        other = F.lag if offset < 0 else F.lead
        return F.when(other("res_seq").over(w) == F.col("res_seq") + offset, other(F.col(f"`{name}`")).over(w))

    near = {(a, k): f"{a}@{k}" for t in BACKBONE.values() for a, k in t if k}
    r = r.withColumns({v: atom(*k) for k, v in near.items()})
    at = lambda a, k: F.col(f"`{near.get((a, k), a)}`")
    purine = F.col("res_name").isin(list(PURINES))
    chi = F.when(purine, dihedral(*[F.col(f"`{n}`") for n in ("O4'", "C1'", "N9", "C4")])).otherwise(dihedral(*[F.col(f"`{n}`") for n in ("O4'", "C1'", "N1", "C2")]))
    return r.withColumns({**{name: dihedral(*[at(a, k) for a, k in t]) for name, t in BACKBONE.items()}, "chi": chi})


def _with_pucker(r: DataFrame) -> DataFrame:
    """Residues with nu0 to nu4, phase and amplitude."""
    r = r.withColumns({name: dihedral(*[F.col(f"`{a}`") for a in t]) for name, t in SUGAR.items()})
    s = 2 * (math.sin(math.radians(36)) + math.sin(math.radians(72)))
    up, across = (F.col("nu4") + F.col("nu1")) - (F.col("nu3") + F.col("nu0")), F.col("nu2") * s
    return r.withColumn("phase", F.pmod(F.degrees(F.atan2(up, across)), F.lit(360.0))).withColumn("amplitude", F.hypot(up, across) / s)


def backbone_torsions(atoms: DataFrame) -> DataFrame:
    """alpha to zeta and chi of each residue; those that need a neighbour are null where numbers are not consecutive."""
    return _with_torsions(_residues(atoms, TORSION_ATOMS)).select(*KEY, *BACKBONE, "chi")


def sugar_pucker(atoms: DataFrame) -> DataFrame:
    """nu0 to nu4, phase in [0, 360) and amplitude of each residue."""
    return _with_pucker(_residues(atoms, SUGAR_ATOMS)).select(*KEY, *SUGAR, "phase", "amplitude")


def _family(name: str, *params: ParameterSpec) -> FamilySpec:
    return FamilySpec(name, params, "residue", "base", ("A", "C", "G", "T"))


#: The families that atoms lead to.
RESIDUE_FAMILIES = {
    "backbone": _family("backbone", *[ParameterSpec(p, True, unit="deg") for p in (*BACKBONE, "chi")]),
    "sugar": _family("sugar", *[ParameterSpec(p, True, unit="deg") for p in SUGAR]),
    "pucker": _family("pucker", ParameterSpec("phase", True, unit="deg"), ParameterSpec("amplitude", range_default=(0.0, 60.0), unit="deg")),
}


def residue_rows(atoms: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each residue of entries(entry_id, pid): pid, row_index, edge_flag, site_label, base and all parameters as float.

    Residues of a chain whose numbers follow one another are a segment; its first and last have edge_flag 1. Rows are numbered in
    order of pid, chain and residue over all entries, without one task. A residue that is listed under two names is two
    rows, each the other's neighbour by number, and so at an edge. Torsions that need an absent atom are null.
    """
    r = _with_pucker(_with_torsions(_residues(atoms, TORSION_ATOMS | SUGAR_ATOMS)))
    w = W.partitionBy("entry_id", "chain_id").orderBy("res_seq", "res_name")
    inner = (F.lag("res_seq").over(w) == F.col("res_seq") - 1) & (F.lead("res_seq").over(w) == F.col("res_seq") + 1)
    label = F.concat_ws(".", "chain_id", F.concat("res_name", F.col("res_seq").cast("string")))
    base = F.when(F.col("res_name").isin(list(CANONICAL)), F.right("res_name", F.lit(1))).otherwise("")
    params = [p.param_id for s in RESIDUE_FAMILIES.values() for p in s.params]
    shown = r.select(*KEY, F.when(F.coalesce(inner, F.lit(False)), 0).otherwise(1).alias("edge_flag"), label.alias("site_label"), base.alias("base"), *[F.col(p).cast("float").alias(p) for p in params])
    shown = shown.join(entries.select("entry_id", "pid"), "entry_id")
    return in_order(shown, "pid", "chain_id", "res_seq", "res_name", keep=["pid", "edge_flag", "site_label", "base", *params]).rows("row_index")


def residue_families(atoms: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """The tables of RESIDUE_FAMILIES, as load_family() gives them: written tables, so that they can be read time and again."""
    rows = residue_rows(atoms, entries)
    return {name: rows.select("pid", "edge_flag", "site_label", "base", *[p.param_id for p in s.params], "row_index") for name, s in RESIDUE_FAMILIES.items()}
