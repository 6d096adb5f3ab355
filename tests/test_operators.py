"""Literal fixtures for the traps and for what SQL doesn't cover."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from angula.functions import columns as C
from angula.operators import derive, distribution as D, filters as E, histogram as H, joint as J, report as R
from angula.plans.views import ENTRY, OBS, RESIDUE, tables
from angula.sources import tables as S
from angula.spec import EntryFilter, FamilySpec, ObsFilter, ParameterSpec, View, chosen, selected_forms
from conftest import DATA


def values(df, col):
    return [r[col] for r in df.collect()]


def test_wrap_and_signed(spark):
    d = spark.createDataFrame([(v,) for v in (-0.5, 0.0, 359.999, 360.0, 720.0, 180.0, -1e-20)], "v double")
    assert [round(x, 3) for x in values(d.select(C.wrap(F.col("v")).alias("w")), "w")] == [359.5, 0, 359.999, 0, 0, 180, 0]
    assert values(d.filter("v = 180").select(C.signed_angle(F.col("v")).alias("w")), "w") == [180]


def test_parse_prefixes(spark):
    d = spark.createDataFrame([("12abc",), ("NaN",), ("Infinity",), ("",), (None,), (" -1.5e2x",), (".5",)], "v string")
    assert values(d.select(S.parse_number(F.col("v")).alias("n")), "n") == [12, None, None, None, None, -150, 0.5]
    assert values(d.select(S.parse_int(F.col("v"), 7).alias("n")), "n") == [12, 7, 7, 7, 7, -1, 7]


def test_ingest_round_trip(spark, tmp_path):
    text = 'pid\tpdb_id\tform\tresolution\tresolution_known\thet_names\r\n1\tab"c\t\t2.5\t1\t \r\n\r\n2\t"q\tbdna\tNaN\t0\tZN\r\n'
    p = tmp_path / "e.tsv.gz"
    p.write_bytes(gzip.compress(text.encode()))
    rows = S.load_entries(spark, str(p)).orderBy("pid").collect()
    assert [(r.pid, r.entry_id, r.form, r.resolution, r.resolution_known, r.het_names, r.residue_count) for r in rows] == [(1, 'ab"c', "other", 2.5, True, "-", 0), (2, '"q', "bdna", None, False, "ZN", 0)]
    f = tmp_path / "f.tsv"
    f.write_text("pid\tis_terminal_any\tsite_label\tctx\ta\n1\t1\t x \tA\t1.5\n1\t0\ty\t\t\n")
    got = S.load_family(spark, str(f), ["a", "missing"], "ctx")
    assert [(r.pid, r.edge_flag, r.site_label, r.ctx or "", r.a) for r in got.orderBy("row_index").collect()] == [(1, 1, "x", "A", 1.5), (1, 0, "y", "", None)]
    assert got.schema["row_index"].dataType.typeName() == "long"
    out = got.unionByName(got.withColumn("pid", F.lit(2)))
    assert S.write_family(out, str(tmp_path / "w"), 2) == S.write_family_parquet(out, str(tmp_path / "p"), 2) == 4
    assert S.row_counts(spark, {"b": 4, "a": 1}).collect() == [("a", 1), ("b", 4)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == sorted(map(tuple, out.collect()), key=repr)
    again = S.load_family(spark, str(tmp_path / "w"), ["a"], "ctx")
    assert sorted((r.pid, r.row_index, r.a) for r in again.collect()) == sorted((r.pid, r.row_index, r.a) for r in out.collect())


def test_row_index_follows_files_and_lines(spark, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        (tmp_path / f"{name}.tsv").write_text("pid\tv\n" + "".join(f"1\t{first + i}\n" for i in range(50)))
    got = S.load_family(spark, str(tmp_path), ["v"])
    assert values(got.orderBy("row_index"), "v") == [*range(50), *range(100, 150)] and got.select("row_index").distinct().count() == 100


def test_fixed_digits_round_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    v = [1.005, 2.675, 0.125, -0.125, -0.001, 9.9999995, 0.0, -0.0, 1e15 + 0.5, None, math.nan, math.inf]
    wide = [9e18, 1e19, -1e19, 12345678901234567890.0, 2.0**63, 2.0**62, 9.3e20, 2.0**53, 2.0**53 - 1, 4503599627370496.5, 1e9 + 0.0000005, 99999.9999995, 0.4999995, 1e-7, 5e-7, 12345.6789, 1e10 / 3]
    w = spark.createDataFrame([(x,) for x in wide], "v double")
    for digits in (0, 2, 6):
        want = [str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, None) if abs(x) < 1e20 else Decimal(x)) for x in wide]
        want = [t if abs(x) < 1e20 else t + ("." + "0" * digits if digits else "") for t, x in zip(want, wide)]
        assert values(w.select(C.fixed(F.col("v"), digits).alias("t")), "t") == want
    far = spark.createDataFrame([(1e21,), (-1.5e300,), (1.7976931348623157e308,)], "v double")
    assert values(far.select(C.fixed(F.col("v"), 2).alias("t")), "t") == ["1e+21", "-1.5e+300", "1.7976931348623157e+308"]
    d = spark.createDataFrame([(x,) for x in v], "v double")
    assert values(d.select(C.fixed(F.col("v"), 2).alias("t")), "t") == ["1.00", "2.67", "0.13", "-0.13", "-0.00", "10.00", "0.00", "0.00", "1000000000000000.50", "-", "-", "-"]
    assert values(d.select(C.fixed(F.col("v"), 0).alias("t")), "t")[:6] == ["1", "3", "0", "-0", "-0", "10"]


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"parameter_registry": [{"param_id": "a", "value_type": "numeric_circular", "period": 360}, {"param_id": "b", "value_type": "numeric", "display_range_default": [0, 5]}]}, indent=1))
    got = {r.param_id: (r.is_circular, r.period, r.range_default) for r in S.parameter_dim(S.read_manifest(spark, str(p))).collect()}
    assert got == {"a": (True, 360.0, None), "b": (False, None, [0.0, 5.0])}


def test_csv_quotes(spark, tmp_path):
    S.write_csv(spark.createDataFrame([('a"b,c', 1)], "x string, y int").coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part*")).read_text()
    assert text == 'x,y\n"a""b,c",1\n'
    assert S.export_name("Twist (°)", "20260101") == "twist_20260101"


def test_families_are_read_once():
    seen = []
    f = S.Families(lambda x: seen.append(x) or x)
    assert f["a"] == f["a"] == "a" and seen == ["a"]


def test_choices():
    assert chosen(None, ["a", "b"]) == ["a", "b"] and chosen(["b", "z"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        chosen([], ["a"])
    assert chosen(None, ["a", "b"], ["b", "z"]) == ["b"] and chosen(None, ["a", "b"], ["z"]) == ["a", "b"]
    assert chosen(["z"], ["a", "b"], ["b"], refill=True) == ["b"] and chosen([], ["a", "b"], refill=True) == ["a", "b"]
    assert len(selected_forms([])) == 9 and selected_forms(["zdna", "x", "adna"]) == ["adna", "zdna"]
    assert View().bins(True) == 72 and View(fine=True).bins(False) == 128 and View(fine=True).bins(False, True) == 96


def test_preset_replaces_filters_but_series_keep_forms(spark):
    e, r, _ = tables(spark, DATA)
    ids = values(e.filter("form = 'other'").limit(3), "entry_id") + values(e.filter("form = 'adna'").limit(3), "entry_id")
    f = EntryFilter("conservative", forms=("adna",), preset=ids)
    assert E.allowed_entries(e, f).count() == 6
    series, _ = D.distribution(e, r, RESIDUE, ParameterSpec("lin"), f, ObsFilter(), View())
    assert set(values(series.select("form").distinct(), "form")) <= {"adna"}


def test_bin_edges(spark):
    d = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 9.999, 10.0, 50.0)], "v double")
    assert values(d.select(C.bin_of(F.col("v"), F.lit(0.0), F.lit(10.0), 10).alias("b")), "b") == [0, 0, 9, 9, 9]
    assert values(d.select(C.bin_of(F.col("v"), F.lit(1.0), F.lit(1.0), 10).alias("b")), "b") == [None] * 5
    assert values(d.select(C.circular_bin(F.col("v"), 10.0, 5).alias("b")), "b") == [2, 0, 4, 0, 0]


def test_degenerate_and_default_ranges(spark):
    d = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert H.effective_range(d, d, "v").first() == (2.5, 3.5)
    assert H.effective_range(d, d, "v", (0.0, 10.0)).first() == (0.0, 10.0)
    none = d.filter("v > 9")
    assert H.effective_range(none, none, "v").first() == (0.0, 1.0)
    assert H.effective_range(none, d, "v").first() == (2.0, 4.0)


def test_moments(spark):
    d = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 180.0), ("b", 2, 350.0), ("b", 3, 10.0)], "form string, pid int, v double")
    m = {r.form: r for r in D.circular_moments(d, "v", ["form"]).collect()}
    assert m["a"].resultant < 1e-12
    assert min(m["b"].mean, 360 - m["b"].mean) < 1e-9
    assert {r.form: r.std for r in D.linear_moments(d, "v", ["form"]).collect()} == {"a": 90.0, "b": 170.0}


def pool(spark, counts):
    return spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "bin int, n long")


def brute_seam(n):
    bins, total = len(n), sum(n)
    if total < 8:
        return "sparse", 0
    best = (0, 0)
    for s in range(bins):
        if n[s] == 0 and (n[s - 1] != 0):
            k = 0
            while n[(s + k) % bins] == 0:
                k += 1
            if k > best[0]:
                best = (k, s)
    if best[0] >= 2:
        return "gap", int(best[1] + best[0] / 2 + 0.5) % bins
    y = [sum(n[(i - o) % bins] * w for o, w in C.kernel(1.2)) for i in range(bins)]
    w = min(bins - 1, max(5, int(36 / (360 / bins) + 0.5)))
    sums = [round(sum(y[(i + j) % bins] for j in range(w)), 9) for i in range(bins)]
    if min(sums) > 0.85 * total * w / bins:
        return "flat", 0
    return "quiet", (sums.index(min(sums)) + w // 2) % bins


@pytest.mark.parametrize("kind", ["across zero", "quiet", "flat", "sparse", "ties"])
def test_seam(spark, kind):
    n = {"across zero": [0, 0, 0] + [4] * 64 + [0] * 5, "quiet": [9 + (i % 3) if i < 50 else 1 for i in range(72)], "flat": [5 + i % 2 for i in range(72)], "sparse": [1] * 5 + [0] * 67, "ties": ([3] * 30 + [0] * 6) * 2}[kind]
    got = H.seam(pool(spark, n), 72, "auto").first()
    assert (got.kind, got.shift) == brute_seam(n)


def test_smoothing_properties(spark):
    d = pool(spark, [0, 5, 0, 0, 7, 1, 0, 2, 0, 0, 0, 3])
    y = {r.bin: r.y for r in H.smooth(d, [], 12, 1.0, True).collect()}
    assert abs(sum(y.values()) - 18) < 1e-9
    turned = {r.bin: r.y for r in H.rotate(H.smooth(d, [], 12, 1.0, True), F.lit(3), 12).collect()}
    other = {r.bin: r.y for r in H.smooth(H.rotate(d, F.lit(3), 12), [], 12, 1.0, True).collect()}
    assert all(abs(turned[b] - other[b]) < 1e-12 for b in range(12))
    assert sum(values(H.smooth(d, [], 12, 1.0, False), "y")) < 18
    assert values(H.smooth(d, [], 12, 0, False).orderBy("bin"), "y") == [0, 5, 0, 0, 7, 1, 0, 2, 0, 0, 0, 3]


def test_series_sums(spark):
    e, r, _ = tables(spark, DATA)
    p, _ = D.distribution(e, r, RESIDUE, ParameterSpec("ang", True), ENTRY, OBS, View(mode="auto"))
    d, _ = D.distribution(e, r, RESIDUE, ParameterSpec("ang", True), ENTRY, OBS, View(mode="auto", scale="density"))
    assert all(abs(x - 1) < 1e-9 for x in values(p.groupBy("form").agg(F.sum("y").alias("s")), "s"))
    assert all(abs(x * 5 - 1) < 1e-9 for x in values(d.groupBy("form").agg(F.sum("y").alias("s")), "s"))


def test_last_row_wins_and_empty_labels(spark):
    f1 = spark.createDataFrame([(1, "", 0, 1.0, 1), (1, "", 0, 2.0, 2), (1, "a", 0, None, 3), (1, "a", 0, 5.0, 0)], "pid int, site_label string, edge_flag int, v double, row_index int")
    f2 = spark.createDataFrame([(1, "", 0, 7.0, 1), (1, "", 0, 8.0, 2), (1, "a", 0, 9.0, 3)], "pid int, site_label string, edge_flag int, w double, row_index int")
    allowed = spark.createDataFrame([(1,)], "pid int")
    s = FamilySpec("backbone", ())
    got = J.same_level(f1, s, "v", f2, FamilySpec("sugar", ()), "w", allowed, ObsFilter())
    assert sorted((r.x, r.y) for r in got.collect()) == [(2, 7), (2, 8), (5, 9)]
    pairs = spark.createDataFrame([(1, "a--a", 0, 3.0, 1), (1, "a--", 0, 4.0, 2), (1, "a--b--c", 0, 5.0, 3), (1, "a---b", 0, 6.0, 4)], "pid int, site_label string, edge_flag int, v double, row_index int")
    both = J.pair_to_residue(pairs, FamilySpec("base_pair", (), "pair"), "v", f2, FamilySpec("sugar", ()), "w", allowed, ObsFilter(), ObsFilter())
    assert sorted((r.x, r.y) for r in both.collect()) == [(3, 9), (3, 9), (4, 9), (6, 9)]


def test_families_and_modes():
    assert J.compatible_families("base_pair", "pair_residue") == ["backbone", "sugar", "pucker"] and J.compatible_families("nothing") == []
    with pytest.raises(ValueError):
        J.join_mode(FamilySpec("step", (), "step"), FamilySpec("sugar", ()), "same_level")


def test_correlations(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0)], "pid int, x double, y double")
    assert d.agg(J.pearson().alias("r")).first().r is None and J.circular_correlation(d).first().r is None
    d = spark.createDataFrame([(1, float(i), float((i + 30) % 360)) for i in range(0, 200, 7)], "pid int, x double, y double")
    assert abs(J.circular_correlation(d).first().r - 1) < 1e-9


def test_contours(spark):
    c = spark.createDataFrame([(0.0,), (1.0,)], "z double")
    steps = {r.width: r.step for r in J.contour_levels(c).collect()}
    assert steps["standard"] == 0.1 and steps["wide"] == 0.2 and steps["tight"] < 0.1
    assert J.contour_levels(c.filter("z < 0")).count() == 0
    assert J.contour_levels(c, True).count() > 0


def test_page_is_clamped(spark):
    e, _, _ = tables(spark, DATA)
    last = R.entry_page(e, 10_000)
    assert 0 < last.count() <= 100 and R.entry_page(e.filter("pid < 0"), 3).count() == 0


def test_canonical(spark):
    c = spark.createDataFrame([("a", "A", "DA"), ("a", "A", "DT"), ("b", "A", "DA"), ("b", "B", "U"), ("c", "A", None)], "entry_id string, chain_id string, residue string")
    kept, counts = derive.canonical_entries(c)
    assert values(kept, "entry_id") == ["a"] and counts.first() == (3, 1)


def test_torsions_and_pucker(spark):
    pts = {"C4'": (0, 0, 0), "O4'": (1.4, 0.2, 0.1), "C1'": (1.9, 1.5, 0.2), "C2'": (0.9, 2.3, -0.5), "C3'": (-0.3, 1.4, 0.3), "C5'": (-0.6, -1.2, 0.8), "O3'": (-1.4, 1.9, -0.4), "P": (-2.8, 2.2, 0.3), "O5'": (0.2, -2.4, 0.6), "N9": (3.2, 1.6, 0.9), "C4": (4.1, 0.7, 1.2), "N1": (3.0, 1.7, 1.0), "C2": (4.0, 1.0, 1.9)}
    rows = [("e", "A", s, "DA", a, x + 6.5 * s, y + s, z) for s in (1, 2, 4) for a, (x, y, z) in pts.items()]
    atoms = spark.createDataFrame([(a, b, c, d, e, float(x), float(y), float(z)) for a, b, c, d, e, x, y, z in rows], "entry_id string, chain_id string, res_seq int, res_name string, atom string, x double, y double, z double")

    def dihedral(p):
        import numpy as np

        b = [np.subtract(p[i + 1], p[i]) for i in range(3)]
        n1, n2 = np.cross(b[0], b[1]), np.cross(b[1], b[2])
        return math.degrees(math.atan2(np.linalg.norm(b[1]) * np.dot(b[0], n2), np.dot(n1, n2)))

    t = {r.res_seq: r for r in derive.backbone_torsions(atoms).collect()}
    assert abs(t[1].gamma - dihedral([pts[a] for a in ("O5'", "C5'", "C4'", "C3'")])) < 1e-9
    assert t[1].alpha is None and t[2].alpha is not None and t[2].zeta is None and t[4].alpha is None
    s = derive.sugar_pucker(atoms).filter("res_seq = 1").first()
    assert abs(s.nu2 - dihedral([pts[a] for a in ("C1'", "C2'", "C3'", "C4'")])) < 1e-9 and 0 <= s.phase < 360


def test_plan_has_no_python_and_pushes_filters(spark):
    e, r, _ = tables(spark, DATA)
    obs = E.observations(E.allowed_entries(e, ENTRY), r, RESIDUE, OBS)
    plan = D.raw_histogram(obs, r, ParameterSpec("lin"), 64, ["form"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "PushedFilters: [" in plan and "BroadcastHashJoin" in plan
