"""Row numbers, pages and exports in a global order."""

import random

from pyspark.sql import functions as F

from angula.operators import report as R
from angula.operators.order import in_order
from angula.plans.views import ALL, OBS, RESIDUE, tables
from angula.spec import EntryFilter, FamilySpec, ObsFilter, ParameterSpec
from conftest import DATA


def numbers(rng, n):
    return [rng.choice([None, *range(50)]) for _ in range(n)]


def test_numbers_and_pages(spark):
    v = numbers(random.Random(1), 1234)
    d = spark.createDataFrame([(x, i) for i, x in enumerate(v)], "v int, i int").repartition(5)
    t = in_order(d, F.col("v").desc_nulls_last(), "i", parts=7)
    want = sorted(enumerate(v), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    got = t.rows().orderBy("row").collect()
    assert [(r.row, r.i, r.v) for r in got] == [(k, i, x) for k, (i, x) in enumerate(want)] and len(t) == 1234 and t.rows().columns == ["row", "v", "i"]
    for k in (0, 3, 12, 99, -4):
        at = min(max(k, 0), 12)
        assert [r.i for r in t.page(k).collect()] == [i for i, _ in want[at * 100 : at * 100 + 100]]
    assert [r.i for r in t.between(150, 900).collect()] == [i for i, _ in want[150:900]] and t.between(5, 5).count() == 0


def test_a_page_reads_the_partitions_that_it_lies_in(spark):
    d = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"), F.lit("x" * 20).alias("text"))
    t = in_order(d, "v", parts=20)
    page = t.page(500, 10)
    rows = page.collect()
    assert [r.v for r in rows] == sorted(i * 7919 % 100_003 for i in range(100_000))[5000:5010]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(nth," in plan
    assert page.select(F.input_file_name()).distinct().count() <= 2


def test_empty_and_tied_tables(spark):
    none = in_order(spark.createDataFrame([], "v int"), "v")
    assert len(none) == 0 and none.page(3).count() == 0 and none.rows().count() == 0
    same = in_order(spark.createDataFrame([(1,)] * 250, "v int").repartition(6), "v")
    assert sorted(r.row for r in same.rows().collect()) == list(range(250)) and same.page(2).count() == 50


def test_entries_in_locale_order(spark):
    e = spark.createDataFrame([(3, "b"), (1, "B"), (2, "a"), (4, "Ä"), (5, "a")], "pid int, entry_id string")
    assert [r.pid for r in R.ordered_entries(e).page(0).collect()] == [r.pid for r in R.sorted_entries(e).collect()] == [2, 5, 4, 3, 1]


def test_export_names_labels_and_order(spark):
    e = spark.createDataFrame([(2, "ab1", "zdna", "xray", 2.0, True, True, True, True, "ZN", 4), (1, "cd2", "adna", "nmr", None, False, False, False, True, "-", 9), (7, "ef3", "other", "em", 1.0, True, False, False, False, "-", 1)], "pid int, entry_id string, form string, method string, resolution double, resolution_known boolean, passes_conservative boolean, passes_mw100 boolean, passes_relaxed boolean, het_names string, residue_count int")
    rows = [(p, k, f"r{k}", 0, float(p) + k / 10) for p in (7, 2, 1) for k in (11, 2, 0)] + [(1, 5, None, 1, float("nan")), (1, 6, None, 1, 5e19)]
    fam = spark.createDataFrame(rows, "pid int, row_index long, site_label string, edge_flag int, alpha double")
    spec = FamilySpec("backbone", (ParameterSpec("alpha"),))
    t = R.ordered_export(e, fam, spec, "alpha", EntryFilter(forms=("zdna", "other", "adna")), ObsFilter())
    assert t.columns == ["alpha", "pdb_id", "site_label", "form_nakb", "method", "resolution_angstrom", "cleanliness", "het_names", "residue_count", "sequence_context", "backbone_state", "terminal_flag"]
    got = [(r.alpha, r.pdb_id, r.site_label, r.form_nakb, r.resolution_angstrom) for r in t.page(0).collect()]
    assert got == [("2.000000", "AB1", "r0", "Z-DNA", "2.00"), ("2.200000", "AB1", "r2", "Z-DNA", "2.00"), ("3.100000", "AB1", "r11", "Z-DNA", "2.00"), ("1.000000", "CD2", "r0", "A-DNA", ""), ("1.200000", "CD2", "r2", "A-DNA", ""), ("50000000000000000000.000000", "CD2", "", "A-DNA", ""), ("2.100000", "CD2", "r11", "A-DNA", "")]
    assert R.export_observations(e, fam, spec, "alpha", EntryFilter(), ObsFilter()).count() == 7


def test_export_pages_join_to_the_whole(spark):
    e, r, _ = tables(spark, DATA)
    t = R.ordered_export(e, r, RESIDUE, "lin", EntryFilter(), ALL)
    rows = t.rows().orderBy("row").drop("row").collect()
    assert len(rows) == len(t) == R.export_observations(e, r, RESIDUE, "lin", EntryFilter(), ALL).count()
    assert t.page(7).collect() == rows[700:800] and OBS
