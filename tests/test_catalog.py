"""The catalogue of a manifest, tables clustered by entry, and the order of rows over files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from angula.operators import distribution as D, filters as E, joint as J
from angula.sources import tables as S
from angula.sources.catalog import Catalog
from angula.spec import EntryFilter, FamilySpec, ObsFilter, ParameterSpec, View

MANIFEST = {
    "parameter_registry": [
        {"param_id": "alpha", "display_name": "Alpha", "unit": "deg", "value_type": "numeric_circular", "period": 360},
        {"param_id": "turn", "value_type": "numeric_circular"},
        {"param_id": "amp", "value_type": "numeric", "display_range_default": [0, 60]},
        {"param_id": "shear", "value_type": "numeric", "period": None},
    ],
    "families": {
        "backbone": {
            "family_id": "backbone", "display_name": "Backbone", "file": "./families/backbone.tsv.gz", "row_count": 7, "param_ids": ["alpha", "turn", "amp"], "context_column": "base", "context_label": "Base",
            "context_options": [{"id": "A", "label": "Adenine"}, {"id": "G"}, {"id": "Missing", "label": "None"}], "context_empty_value": "Missing",
            "secondary_context_column": "state", "secondary_context_options": [{"id": "BI"}, {"id": "BII"}, {"id": "Missing"}], "secondary_context_empty_value": "Missing",
        },
        "base_pair": {"family_id": "base_pair", "file": "families/pairs.tsv.gz", "param_ids": ["shear"], "context_column": None},
        "pucker": {"family_id": "pucker", "file": "families/pucker.tsv", "param_ids": ["amp"], "context_column": "base", "context_options": [{"id": "A"}, {"id": "G"}], "context_empty_value": "G"},
    },
    "controls": {"form_options": [{"id": "adna", "label": "A"}, {"id": "bdna", "label": "B"}], "method_options": [{"id": "xray", "label": "X-ray"}]},
    "defaults": {"family_id": "backbone", "parameter_id": "alpha", "cleanliness": "relaxed", "methods": ["xray", "nmr"], "resolution": "any", "contexts": ["G", "nothing", "A"], "terminal_policy": "exclude"},
    "file_map": {"pdb_manifest": "./entries.tsv.gz"},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = random.Random(1), tmp_path_factory.mktemp("set")
    (at / "families").mkdir()
    put = lambda name, lines: (at / name).write_bytes(gzip.compress("\r\n".join(lines).encode()) if name.endswith("gz") else "\n".join(lines).encode())
    put("entries.tsv.gz", ["pid\tpdb_id\tform\texp_method_group\tpasses_clean_relaxed"] + [f"{i}\te{i}\t{rng.choice(['adna', 'bdna', 'zdna', ''])}\t{rng.choice(['xray', 'nmr', 'em'])}\t{int(rng.random() < 0.8)}" for i in range(60)])
    sites = [(p, s) for p in range(60) for s in range(rng.randrange(1, 9))]
    put("families/backbone.tsv.gz", ["pid\tedge_flag\tsite_label\tbase\tstate\talpha\tamp"] + [f"{p}\t{int(s == 0)}\tr{s}\t{rng.choice(['A', 'G', '', 'T'])}\t{rng.choice(['BI', '', 'BX'])}\t{rng.choice(['', str(rng.uniform(-400, 400))])}\t{rng.uniform(1, 70)}" for p, s in sites])
    put("families/pairs.tsv.gz", ["pid\tis_terminal_any\tsite_label\tshear"] + [f"{p}\t0\tr{s}--r{s + 1}\t{rng.gauss(0, 2)}" for p, s in sites])
    put("families/pucker.tsv", ["pid\tamp"] + [f"{p}\t{rng.uniform(0, 50)}" for p, _ in sites])
    (at / "manifest.json").write_text(json.dumps(MANIFEST, indent=1))
    return str(at)


@pytest.fixture(scope="module")
def catalog(spark, folder):
    return Catalog.open(spark, f"{folder}/manifest.json")


@pytest.fixture(scope="module")
def clustered(catalog, tmp_path_factory):
    return catalog.clustered(str(tmp_path_factory.mktemp("clustered")), 4)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_specs_come_from_the_manifest(catalog):
    assert catalog.parameters["alpha"] == ParameterSpec("alpha", True, 360.0, None, "deg") and catalog.parameters["amp"].range_default == (0.0, 60.0) and catalog.parameters["turn"].period == 360
    s = catalog.spec("backbone")
    assert (s.context, s.context_options, s.context_empty, s.context_default, s.secondary_options, s.level) == ("base", ("A", "G", "Missing"), "Missing", ("G", "A"), ("BI", "BII", "Missing"), "residue")
    assert catalog.spec("base_pair").level == "pair" and catalog.spec("base_pair").context is None and catalog.spec("pucker").context_default == () and catalog.spec("pucker").site is None
    assert catalog.defaults.entries == EntryFilter("relaxed", "any", ("xray", "nmr"), "any", ("adna", "bdna")) and catalog.defaults.observations == ObsFilter("exclude")
    assert ("backbone.context", "A", "Adenine") in map(tuple, catalog.options().collect()) and ("form", "bdna", "B") in map(tuple, catalog.options().collect())
    assert {r.family_id: r.row_count for r in catalog.row_counts().collect()} == {"backbone": 7, "base_pair": 0, "pucker": 0}


def test_the_same_distribution_as_by_hand(spark, catalog, folder):
    spec = FamilySpec("backbone", (ParameterSpec("alpha", True), ParameterSpec("turn", True), ParameterSpec("amp", range_default=(0.0, 60.0))), "residue", "base", ("A", "G", "Missing"), "Missing", "state", ("BI", "BII", "Missing"), "Missing")
    entries, family = S.load_entries(spark, f"{folder}/entries.tsv.gz"), S.load_family(spark, f"{folder}/families/backbone.tsv.gz", ["alpha", "turn", "amp"], "base", "state")
    f, o = EntryFilter("relaxed", "any", ("xray", "nmr"), "any", ("adna", "bdna")), ObsFilter("exclude", ("A", "G"))
    for p, chosen in ((spec.params[0], None), (spec.params[2], "amp")):
        for got, want in zip(catalog.distribution(chosen), D.distribution(entries, family, spec, p, f, o, View())):
            assert rows(got) == rows(want) and got.count() > 0
    every = catalog.distribution("amp", "pucker", EntryFilter(), ObsFilter())[1]
    assert rows(every) == rows(D.distribution(entries, S.load_family(spark, f"{folder}/families/pucker.tsv", ["amp"], "base"), FamilySpec("pucker", (spec.params[2],), "residue", "base", ("A", "G"), "G", site=None), spec.params[2], EntryFilter(), ObsFilter(), View())[1])
    assert rows(every) == rows(catalog.distribution(None, "pucker", EntryFilter(), ObsFilter())[1]) and every.count() > 0


def test_wrong_names_are_errors(spark, catalog, folder):
    with pytest.raises(ValueError, match="no parameter shear"):
        catalog.distribution("shear")
    with pytest.raises(KeyError):
        catalog.family("nothing")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        Catalog.open(spark, f"{folder}/none.json")
    with pytest.raises(ValueError, match="registry"):
        Catalog(spark, {"families": {"x": {"param_ids": ["y"]}}}, folder)
    with pytest.raises(ValueError, match="defaults"):
        Catalog(spark, {k: v for k, v in MANIFEST.items() if k != "defaults"}, folder).distribution("alpha", "backbone")


def test_clustered_tables_hold_the_same(spark, catalog, clustered):
    again = Catalog.open(spark, f"{clustered.root}/manifest")
    for name in MANIFEST["families"]:
        assert rows(clustered.family(name)) == rows(catalog.family(name)) == rows(again.family(name))
    assert {r.row_count for r in again.row_counts().collect()} == {catalog.family("backbone").count()}
    for a, b in zip(catalog.distribution("amp"), again.distribution("amp")):
        assert rows(a) == rows(b)
    for a, b in zip(catalog.overview(), again.overview()):
        assert rows(a) == rows(b)


def test_joins_of_clustered_tables_dont_shuffle(spark, clustered):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e, b, p, u = clustered.entries(), *map(clustered.family, ("backbone", "base_pair", "pucker"))
        bs, ps, us = map(clustered.spec, ("backbone", "base_pair", "pucker"))
        allowed = E.allowed_entries(e, EntryFilter("relaxed"))
        some = ObsFilter("exclude")
        for df in (
            E.observations(allowed, b, bs, some), J.same_level(b, bs, "alpha", b, bs, "amp", allowed, some), J.pair_to_residue(p, ps, "shear", b, bs, "amp", allowed, ObsFilter(), some),
            J.same_level(u, us, "amp", u, us, "amp", allowed, ObsFilter()), D.entries_with_value(b, "amp", ["pid"]),
        ):
            text = plan(df)
            assert "Exchange" not in text and "SelectedBucketsCount: 4 out of 4" in text and df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_by_entry_reach_the_files(spark, clustered):
    one = clustered.family("backbone").filter("pid = 7").select("pid", "amp")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says it
    try:
        text = plan(one)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in text and "ReadSchema: struct<pid:int,amp:float>" in text and one.count() > 0
    text = plan(clustered.family("backbone").filter("pid between 10 and 20").select("amp"))
    assert "GreaterThanOrEqual(pid,10)" in text and "LessThanOrEqual(pid,20)" in text


def test_shared_tables_are_kept_until_released(clustered):
    a = clustered.shared("backbone", "amp")
    assert a is clustered.shared("backbone", "amp") and a.columns == ["pid", "row_index", "edge_flag", "site_label", "base", "state", "amp"] and a.storageLevel.useMemory
    clustered.release()
    assert not a.storageLevel.useMemory


def test_row_index_over_folders_files_and_splits(spark, tmp_path):
    want = []
    for d in ("b", "a", "c"):
        (tmp_path / d).mkdir()
    for d, name, n in (("a", "fam.tsv", 3), ("a", "gam.tsv", 4000), ("b", "fam.tsv", 3), ("c", "z.tsv", 1)):
        (tmp_path / d / name).write_text("pid\tv\n" + "".join(f"{i}\t{i}\n\n" for i in range(n)))
        want += [(f"{d}/{name}", i) for i in range(n)]
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = S.load_family(spark, str(tmp_path / "*"), ["v"])
        assert got.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "*")).rdd.getNumPartitions() > 8
        assert [(r.row_index, r.v) for r in got.orderBy("row_index").collect()] == [(k, float(i)) for k, (_, i) in enumerate(want)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_row_index_of_many_small_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03}.tsv").write_text(f"pid\tv\n1\t{2 * i}\n1\t{2 * i + 1}\n")
    got = S.load_family(spark, str(tmp_path), ["v"]).orderBy("row_index").collect()
    assert [r.v for r in got] == [float(i) for i in range(600)] and [r.row_index for r in got] == list(range(600))
