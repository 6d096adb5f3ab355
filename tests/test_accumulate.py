"""States that are kept and merged, and series worked out within a row."""

import random

import pytest
from pyspark.sql import functions as F

from angula.functions import columns as C
from angula.operators import accumulate as A, distribution as D, filters as E, histogram as H, series as S
from angula.plans.views import ANG, ENTRY, LIN, OBS, RESIDUE, tables
from angula.spec import FamilySpec, ObsFilter, ParameterSpec, View, selected_forms
from conftest import DATA
from test_operators import brute_seam

FORMS = selected_forms(ENTRY.forms)
V = View(mode="auto")


def rows(df):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_a_kept_state_takes_in_new_entries_without_the_old_ones(spark, tmp_path):
    e, r, _ = tables(spark, DATA)
    middle = e.selectExpr("percentile_approx(pid, 0.5)").first()[0]
    allowed = E.allowed_entries(e, ENTRY)
    one = A.frame(allowed, r, RESIDUE, OBS)
    fixed = spark.createDataFrame(one.collect(), one.schema)
    old, new = (A.accumulate(allowed.filter(c), r, RESIDUE, OBS, V, FORMS, fixed) for c in (f"pid <= {middle}", f"pid > {middle}"))
    old.write.parquet(f"{tmp_path}/old")
    kept = A.merged(spark.read.parquet(f"{tmp_path}/old"), new)
    assert "lineitem" in str(new._jdf.queryExecution().optimizedPlan()) or kept.count()
    whole = A.accumulate(allowed, r, RESIDUE, OBS, V, FORMS, one)
    assert rows(kept.drop("a", "b")) == rows(whole.drop("a", "b"))
    for p, (series, summary) in ((p, D.distribution(e, r, RESIDUE, p, ENTRY, OBS, V)) for p in (LIN, ANG)):
        done = A.finished(kept, RESIDUE, V, FORMS)
        assert rows(A.series(done, RESIDUE).filter(F.col("param_id") == p.param_id).drop("param_id")) == rows(series)
        assert rows(A.summaries(done, RESIDUE, V, p)) == rows(summary)


def test_entries_in_two_states_count_once(spark):
    entries = spark.createDataFrame([(i, "adna") for i in (0, 63, 64, 5_000_000_000)], "pid long, form string")
    family = spark.createDataFrame([(i, 0, float(v)) for i in (0, 63, 64, 5_000_000_000, 7) for v in (1, 2)], "pid long, edge_flag int, x double")
    spec = FamilySpec("sugar", (ParameterSpec("x", range_default=(0.0, 10.0)),))
    one = A.frame(entries, family, spec, ObsFilter())
    s = A.accumulate(entries, family, spec, ObsFilter(), V, ["adna"], one)
    got = A.summaries(A.finished(A.merged(s, s), spec, V, ["adna"]), spec, V, spec.params[0]).first()
    assert (got.n, got.entries, got.mean) == (16, 4, 1.5)
    assert A.distinct_entries(family).first().entries == 5 and A.distinct_entries(family.filter("x > 9")).first().entries == 0


def test_states_of_unequal_frames_do_not_merge(spark):
    e, r, _ = tables(spark, DATA)
    allowed = E.allowed_entries(e, ENTRY)
    a, b = (A.accumulate(allowed, r, RESIDUE, OBS, V, FORMS, spark.createDataFrame([(lo, 50.0, 0.0, 360.0)], "lo0 double, hi0 double, lo1 double, hi1 double")) for lo in (0.0, 1.0))
    with pytest.raises(Exception, match="different frames"):
        A.merged(a, b).collect()


@pytest.mark.parametrize("kind", ["across zero", "quiet", "flat", "sparse", "ties", "random"])
def test_cut_within_a_row(spark, kind):
    rng = random.Random(2)
    n = {"across zero": [0, 0, 0] + [4] * 64 + [0] * 5, "quiet": [9 + (i % 3) if i < 50 else 1 for i in range(72)], "flat": [5 + i % 2 for i in range(72)], "sparse": [1] * 5 + [0] * 67, "ties": ([3] * 30 + [0] * 6) * 2, "random": [rng.choice([0, 1, 5, 9]) if i % 11 else 20 for i in range(72)]}[kind]
    d = spark.createDataFrame([(n,)], "n array<long>").repartition(1)
    got = d.select(F.expr(S.cut("n", 72, "auto")).alias("c")).first().c
    assert (got.kind, got.shift) == brute_seam(n)


def test_arrays_say_what_tables_say(spark):
    n = [0, 5, 0, 0, 7, 1, 0, 2, 0, 0, 0, 3]
    d, t = spark.createDataFrame([(n,)], "n array<long>").repartition(1), spark.createDataFrame(list(enumerate(n)), "bin int, n long")
    for circular in (False, True):
        for sigma in (0.0, 1.0, 2.5):
            got = d.select(F.expr(S.smoothed("n", 12, sigma, circular)).alias("y")).first().y
            want = [r.y for r in H.smooth(t, [], 12, sigma, circular).orderBy("bin").collect()]
            assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))
    got = d.select(*[F.expr(S.percentile("n", 12, q)).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95))], F.expr(S.peak("CAST(n AS array<double>)")).alias("peak"), F.expr(S.rotated("n", "3", 12)).alias("turned")).first()
    want = [H.percentile(t, [], q, F.col("bin")).first().p for q in (0.05, 0.5, 0.95)]
    assert [got.q0, got.q1, got.q2] == want and got.peak == 4 and got.turned == n[3:] + n[:3]
    none = spark.createDataFrame([([0] * 12,)], "n array<long>").select(F.expr(S.percentile("n", 12, 0.5)).alias("p"), F.expr(S.scaled("CAST(n AS array<double>)")).alias("y")).first()
    assert none.p is None and none.y == [0.0] * 12


def test_frame_is_the_effective_range(spark):
    e, r, _ = tables(spark, DATA)
    allowed = E.allowed_entries(e, ENTRY)
    for default in (None, (5.0, 45.0), (0.0, 100.0)):
        for odd in (r, r.filter("pid < 0"), r.withColumn("lin", F.when(F.col("edge_flag") == 1, F.col("lin")))):
            p = ParameterSpec("lin", range_default=default)
            spec = FamilySpec("backbone", (p,), context=RESIDUE.context, context_options=RESIDUE.context_options, context_empty=RESIDUE.context_empty)
            want = H.effective_range(E.observations(allowed, odd, spec, OBS), odd, "lin", default).first()
            assert tuple(A.frame(allowed, odd, spec, OBS).first()) == pytest.approx(tuple(want))


def test_reads_and_shuffles(spark):
    """Observations are read twice at most; three shuffles at most, the range's included."""
    e, r, _ = tables(spark, DATA)
    for out in (*D.distribution(e, r, RESIDUE, LIN, ENTRY, OBS, V), *D.distribution(e, r, RESIDUE, ANG, ENTRY, OBS, V), *D.family_overview(e, r, RESIDUE, ENTRY, OBS, V)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        own = [x for x in plan.splitlines() if "Reused" not in x]
        assert sum(" Exchange " in x for x in own) <= 3 and sum("lineitem" in x and "FileScan" in x for x in own) <= 2, plan
        assert "Python" not in plan and not [x for x in own if "Window" in x]
