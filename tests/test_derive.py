"""From atoms to distributions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from angula.operators import derive, distribution as D
from angula.sources import tables as S
from angula.sources.catalog import Catalog
from angula.spec import EntryFilter, ObsFilter, View

NAMES = ["P", "O5'", "C5'", "C4'", "C3'", "O3'", "O4'", "C1'", "C2'", "N9", "C4", "N1", "C2"]


def dihedral(p):
    b = [np.subtract(p[i + 1], p[i]) for i in range(3)]
    n1, n2 = np.cross(b[0], b[1]), np.cross(b[1], b[2])
    return math.degrees(math.atan2(np.linalg.norm(b[1]) * np.dot(b[0], n2), np.dot(n1, n2)))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    chains = {("e1", "A"): [1, 2, 3, 4, 7, 8, 12], ("e1", "B"): [5], ("e2", "A"): list(range(-2, 9)), ("e3", "A"): [1, 2]}
    return {(e, c, s, rng.choice(["DA", "DC", "DG", "DT"])): {a: tuple(rng.uniform(-5, 5) for _ in range(3)) for a in NAMES if rng.random() > 0.04} for (e, c), seqs in chains.items() for s in seqs}


@pytest.fixture(scope="module")
def atoms(spark, model):
    rows = [(*k, a, *xyz) for k, at in model.items() for a, xyz in at.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "entry_id string, chain_id string, res_seq int, res_name string, atom string, x double, y double, z double").repartition(5)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("e2", 1, "bdna"), ("e1", 2, "adna"), ("e4", 3, "adna")]  # e3 isn't kept
    return spark.createDataFrame(rows, "entry_id string, pid int, form string").withColumns({"method": F.lit("xray"), "resolution": F.lit(1.0), "resolution_known": F.lit(True)})


def expected(model):
    """pid, site, edge, base, torsions by name; in order."""
    pid, out, by = {"e1": 2, "e2": 1}, [], {k[:3]: (k[3], v) for k, v in model.items()}
    for (e, c, s, name), at in model.items():
        if e not in pid:
            continue
        before, after = by.get((e, c, s - 1)), by.get((e, c, s + 1))
        atom = lambda a, k: ({-1: before, 0: (name, at), 1: after}[k] or (None, {}))[1].get(a)  # noqa: E731, B023
        t = {}
        for p, four in {**derive.BACKBONE, "chi": tuple((a, 0) for a in (("O4'", "C1'", "N9", "C4") if name in ("DA", "DG") else ("O4'", "C1'", "N1", "C2"))), **{k: tuple((a, 0) for a in v) for k, v in derive.SUGAR.items()}}.items():
            pts = [atom(a, k) for a, k in four]
            t[p] = None if None in pts else dihedral(pts)
        if any(t[f"nu{i}"] is None for i in range(5)):
            t["phase"] = t["amplitude"] = None
        else:
            k = 2 * (math.sin(math.radians(36)) + math.sin(math.radians(72)))
            up, across = t["nu4"] + t["nu1"] - t["nu3"] - t["nu0"], t["nu2"] * k
            t["phase"], t["amplitude"] = math.degrees(math.atan2(up, across)) % 360, math.hypot(up, across) / k
        out.append(((pid[e], c, s), f"{c}.{name}{s}", int(not (before and after)), name[1], t))
    return sorted(out, key=lambda x: x[0])


def test_residues_are_rows_of_families(model, atoms, entries):
    want, got = expected(model), derive.residue_rows(atoms, entries).orderBy("row_index").collect()
    assert [(r.pid, r.site_label, r.edge_flag, r.base) for r in got] == [(k[0], site, edge, base) for k, site, edge, base, _ in want]
    assert [r.row_index for r in got] == list(range(len(want)))
    for r, (_, site, _, _, t) in zip(got, want):
        for p, v in t.items():
            assert (r[p] is None) == (v is None) and (v is None or abs(r[p] - v) < 1e-3), (site, p)


def test_atoms_lead_to_a_summary(spark, model, atoms, entries):
    fams, f, o = derive.residue_families(atoms, entries), EntryFilter(), ObsFilter("exclude", ("A", "G", "T"))
    inner = [x for x in expected(model) if not x[2] and x[3] in "AGT"]
    for family, param in (("backbone", "alpha"), ("sugar", "nu2"), ("pucker", "phase")):
        spec = derive.RESIDUE_FAMILIES[family]
        p = next(p for p in spec.params if p.param_id == param)
        series, summary = D.distribution(entries, fams[family], spec, p, f, o, View())
        got = {r.form: r for r in summary.collect()}
        for form, pid in (("adna", 2), ("bdna", 1)):
            v = [math.radians(x[4][param]) for x in inner if x[0][0] == pid and x[4][param] is not None]
            if not v:
                assert form not in got
                continue
            c, s = sum(map(math.cos, v)), sum(map(math.sin, v))
            assert (got[form].n, got[form].entries) == (len(v), 1)
            assert abs(got[form].resultant - math.hypot(c, s) / len(v)) < 1e-5 and abs((got[form]["mean"] - math.degrees(math.atan2(s, c)) + 180) % 360 - 180) < 1e-3
        assert abs(series.agg(F.sum("y")).first()[0] - len(got)) < 1e-9 and got
    spec = derive.RESIDUE_FAMILIES["pucker"]
    amp = D.distribution(entries, fams["pucker"], spec, spec.params[1], f, ObsFilter(), View())[1].collect()
    every = [x[4]["amplitude"] for x in expected(model) if x[4]["amplitude"] is not None]
    assert sum(r.n for r in amp) == len(every)


def test_derived_families_are_written_and_found_by_a_catalogue(spark, atoms, entries, tmp_path):
    manifest = {
        "parameter_registry": [{"param_id": p.param_id, "value_type": "numeric_circular" if p.circular else "numeric", "display_range_default": list(p.range_default) if p.range_default else None} for s in derive.RESIDUE_FAMILIES.values() for p in s.params],
        "families": {}, "defaults": {"family_id": "pucker", "parameter_id": "phase", "cleanliness": "all", "methods": ["xray"], "resolution": "any", "forms": ["adna", "bdna"], "terminal_policy": "include"}, "file_map": {"pdb_manifest": "entries.tsv"},
    }
    (tmp_path / "entries.tsv").write_text("pid\tpdb_id\tform\texp_method_group\n1\te2\tbdna\txray\n2\te1\tadna\txray\n3\te4\tadna\txray\n")
    fams = derive.residue_families(atoms, entries)
    for name, s in derive.RESIDUE_FAMILIES.items():
        n = S.write_family(fams[name], f"{tmp_path}/{name}", 3)
        manifest["families"][name] = {"file": name, "row_count": n, "param_ids": [p.param_id for p in s.params], "context_column": "base", "context_options": [{"id": b} for b in "ACGT"]}
    c = Catalog(spark, manifest, str(tmp_path))
    clustered = c.clustered(f"{tmp_path}/clustered", 3)
    spec = derive.RESIDUE_FAMILIES["pucker"]
    want = D.distribution(entries, fams["pucker"], spec, spec.params[0], EntryFilter(forms=("adna", "bdna")), ObsFilter(), View())
    for got in (c.distribution(), clustered.distribution()):
        for a, b in zip(got, want):
            assert sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in a.collect()), key=repr) == sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in b.collect()), key=repr)
