"""One query for each operator of the inventory, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from angula.functions import columns as C
from angula.operators import accumulate as A
from angula.operators import distribution as D
from angula.operators import filters as E
from angula.operators import histogram as H
from angula.operators import joint as J
from angula.operators import report as R
from angula.plans.views import ALL, ANG, ENTRY, LIN, OBS, OPENING, PAIR, RESIDUE, SHEAR, SUGAR, UNLABELLED, V_ENTRIES, V_PAIR, V_RESIDUE, standard, standard_sql, tables
from angula.spec import EntryFilter, ParameterSpec, View, selected_forms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- SQL parts ---------------------------------------------------------------------------------------------------
FORM_SET = "('adna', 'bdna', 'zdna', 'quadruplex')"
ENTRY_SQL = f"passes_relaxed AND resolution_known AND resolution <= 2.5 AND method IN ('xray', 'nmr') AND form IN {FORM_SET}"
OBS_SQL = "edge_flag <> 1 AND coalesce(nullif(context, ''), 'Missing') IN ('A', 'Missing') AND secondary_context IN ('F', 'O')"
WRAP = "(({0}) - 360e0 * floor(({0}) / 360e0))"
LAST = "l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"


def padded_sql(src: str, value: str, default: tuple[float, float] | None) -> str:
    lo, hi = f"min({value})", f"max({value})"
    pad = f"CASE WHEN {hi} - {lo} < 1e-9 THEN greatest(0.5, abs({hi}) * 0.1) ELSE greatest(({hi} - {lo}) * 0.05, 0.5) END"
    if default is None:
        return f"SELECT {lo} - {pad} AS lo, {hi} + {pad} AS hi FROM {src}"
    a, b = default
    return f"SELECT CASE WHEN {lo} >= {a} AND {hi} <= {b} THEN {a} ELSE least({a}, {lo} - {pad}) END AS lo, CASE WHEN {lo} >= {a} AND {hi} <= {b} THEN {b} ELSE greatest({b}, {hi} + {pad}) END AS hi FROM {src}"


def kernel_sql(sigma: float) -> str:
    weight, reach = f"exp(-(o * o) / (2e0 * {sigma}e0 * {sigma}e0))", f"CAST(greatest(2, ceil(3 * {sigma}e0)) AS INT)"
    return f"SELECT o, {weight} / sum({weight}) OVER () AS w FROM (SELECT unnest(range(-{reach}, {reach} + 1)) AS o)"


def smooth_sql(src: str, bins: int, sigma: float, circular: bool, by: str = "form", at: str = "bin", value: str = "n") -> str:
    to = f"(({at} + o) % {bins} + {bins}) % {bins}" if circular else f"{at} + o"
    b = f"{by}, " if by else ""
    return f"SELECT {b}t AS {at}, sum({value} * w) AS y FROM (SELECT {b}{to} AS t, {value}, w FROM {src}, ({kernel_sql(sigma)}) AS k) AS s WHERE t BETWEEN 0 AND {bins - 1} GROUP BY ALL"


SEAM_SQL = """SELECT *, CASE WHEN total < 8 THEN 'sparse' WHEN gap_len >= 2 THEN 'gap' WHEN q_sum > 0.85 * total * 7 / 72 THEN 'flat' ELSE 'quiet' END AS kind FROM (
  SELECT (SELECT sum(n) FROM {pool}) AS total, (SELECT len FROM runs ORDER BY len DESC, b LIMIT 1) AS gap_len, (SELECT b FROM runs ORDER BY len DESC, b LIMIT 1) AS gap_at, (SELECT s FROM quiet ORDER BY s, b LIMIT 1) AS q_sum, (SELECT b FROM quiet ORDER BY s, b LIMIT 1) AS q_at)"""

CTE = {
    "v_entries": V_ENTRIES, "v_residue": V_RESIDUE, "v_pair": V_PAIR,
    "allowed": f"SELECT * FROM v_entries WHERE {ENTRY_SQL}",
    "obs": f"SELECT a.form, r.* FROM v_residue r JOIN allowed a ON a.pid = r.pid WHERE {OBS_SQL}",
    "rng": padded_sql("obs", "lin", (5.0, 45.0)),
    "hist": "SELECT form, greatest(0, least(63, CAST(floor((lin - lo) / ((hi - lo) / 64)) AS INT))) AS bin, count(*) AS n FROM obs, rng WHERE lin IS NOT NULL GROUP BY ALL",
    "dense": "SELECT g.form, g.bin, coalesce(n, 0) AS n FROM (SELECT form, unnest(range(64)) AS bin FROM (SELECT DISTINCT form FROM hist)) AS g LEFT JOIN hist h ON h.form = g.form AND h.bin = g.bin",
    "smoothed": smooth_sql("dense", 64, 1.0, False),
    "chist": f"SELECT form, CASE WHEN floor({WRAP.format('ang')} / 5e0) >= 72 THEN 0 ELSE CAST(floor({WRAP.format('ang')} / 5e0) AS INT) END AS bin, count(*) AS n FROM obs WHERE ang IS NOT NULL GROUP BY ALL",
    "cdense": "SELECT g.form, g.bin, coalesce(n, 0) AS n FROM (SELECT form, unnest(range(72)) AS bin FROM (SELECT DISTINCT form FROM chist)) AS g LEFT JOIN chist h ON h.form = g.form AND h.bin = g.bin",
    "pooled": "SELECT bin, sum(n) AS n FROM cdense GROUP BY bin",
    "narrow": "SELECT bin, CASE WHEN bin BETWEEN 66 AND 71 OR bin < 4 THEN 0 ELSE n END AS n FROM pooled",
    "csmoothed": smooth_sql("cdense", 72, 1.0, True),
}


def seam_ctes(pool: str) -> dict[str, str]:
    return {
        "twice": f"SELECT bin, n FROM {pool} UNION ALL SELECT bin + 72, n FROM {pool}",
        "runs": f"SELECT b.bin AS b, coalesce((SELECT min(t.bin) FROM twice t WHERE t.n > 0 AND t.bin >= b.bin), 144) - b.bin AS len FROM {pool} b",
        "calm": smooth_sql(pool, 72, 1.2, True, ""),
        "calm2": "SELECT bin, y FROM calm UNION ALL SELECT bin + 72, y FROM calm",
        "quiet": f"SELECT b.bin AS b, round(sum(c.y), 9) AS s FROM {pool} b JOIN calm2 c ON c.bin BETWEEN b.bin AND b.bin + 6 GROUP BY b.bin",
        "seam0": SEAM_SQL.format(pool=pool),
        "seam": "SELECT kind, CASE kind WHEN 'gap' THEN CAST(floor(gap_at + gap_len / 2e0 + 0.5) AS INT) % 72 WHEN 'quiet' THEN (q_at + 3) % 72 ELSE 0 END AS shift FROM seam0",
    }


def query(name: str, cols: str, sql: str | None, *ctes: str, extra: dict[str, str] | None = None):
    """Register a function of (entries, residues, pairs); sql has SELECT_STANDARD for its columns."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: standard(f(*tables(spark, sf_dir)), cols)
        if sql is not None:
            have = {**{k: CTE[k] for k in ("v_entries", "v_residue", "v_pair", *ctes)}, **(extra or {})}
            ORACLE[name] = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in have.items()) + " " + standard_sql(sql, cols)
        return f

    return put


def allowed(e: DataFrame, f: EntryFilter = ENTRY) -> DataFrame:
    return E.allowed_entries(e, f)


def obs_of(e: DataFrame, r: DataFrame, f: EntryFilter = ENTRY) -> DataFrame:
    return E.observations(allowed(e, f), r, RESIDUE, OBS)


HIST = ("allowed", "obs", "rng", "hist")
DENSE = (*HIST, "dense")
CHIST = ("allowed", "obs", "chist", "cdense", "pooled")


def dense_lin(e, r):
    hist, one = D.raw_histogram(obs_of(e, r), r, LIN, 64, ["form"])
    return H.dense(hist, hist.select("form").distinct(), 64, ["form"]), one


def dense_ang(e, r):
    hist, _ = D.raw_histogram(obs_of(e, r), r, ANG, 72, ["form"])
    return H.dense(hist, hist.select("form").distinct(), 72, ["form"])


def pooled_ang(e, r):
    return dense_ang(e, r).groupBy("bin").agg(F.sum("n").alias("n"))


# --- entries -----------------------------------------------------------------------------------------------------
query("e1_cleanliness", "pid:i entry_id:s", "SELECT_STANDARD FROM v_entries WHERE passes_mw100")(lambda e, r, p: e.filter(E.cleanliness("mw100")))
query("e2_duplex_gate", "pid:i entry_id:s", "SELECT_STANDARD FROM v_entries WHERE all_residues_paired")(lambda e, r, p: e.filter(E.duplex_gate("all_paired")))
query("e3_method", "pid:i method:s", "SELECT_STANDARD FROM v_entries WHERE method IN ('xray', 'em')")(lambda e, r, p: allowed(e, EntryFilter(methods=("xray", "em"))))
query("e4_resolution", "pid:i resolution:b", "SELECT_STANDARD FROM v_entries WHERE resolution_known AND resolution <= 2.0")(lambda e, r, p: e.filter(E.resolution_tier("le_2_0")))
query("e5_form", "pid:i form:s", "SELECT_STANDARD FROM v_entries WHERE form IN ('bdna', 'other')")(lambda e, r, p: allowed(e, EntryFilter(forms=("bdna", "other"))))
PRESET = ("e1", "e10", "e77", "e100", "e1001", "none")
query("e6_preset", "pid:i form:s", f"SELECT_STANDARD FROM v_entries WHERE entry_id IN {PRESET}")(lambda e, r, p: allowed(e, replace(ENTRY, preset=PRESET)))
query("e7_allowed_entries", "pid:i form:s", "SELECT_STANDARD FROM allowed", "allowed")(lambda e, r, p: allowed(e))
query("e8_selected_forms", "form:s n:i", "SELECT_STANDARD FROM (SELECT form, count(*) AS n FROM v_entries WHERE form IN ('zdna', 'adna') GROUP BY form)")(lambda e, r, p: e.filter(F.col("form").isin(selected_forms(["zdna", "adna", "nothing"]))).groupBy("form").agg(F.count("*").alias("n")))
query("e9_entries_by_form", "form:s n:i", f"SELECT_STANDARD FROM (SELECT form, count(*) AS n FROM v_entries WHERE passes_relaxed AND form IN {FORM_SET} GROUP BY form)")(lambda e, r, p: allowed(e, EntryFilter("relaxed")).filter(F.col("form").isin(selected_forms(None))).groupBy("form").agg(F.count("*").alias("n")))

# --- observations ------------------------------------------------------------------------------------------------
OCOLS = "pid:i site_label:s lin:d ang:d"
query("o1_terminal_policy", OCOLS, "SELECT_STANDARD FROM v_residue WHERE edge_flag <> 1")(lambda e, r, p: r.filter(E.terminal_policy("exclude")))
query("o2_context", OCOLS, "SELECT_STANDARD FROM v_residue WHERE context IN ('R', '')")(lambda e, r, p: r.filter(E.context_in("context", ["R", "Missing"], "Missing")))
query("o3_secondary_context", OCOLS, "SELECT_STANDARD FROM v_residue WHERE secondary_context = 'O'")(lambda e, r, p: r.filter(E.context_in("secondary_context", ["O"], "")))
def dirty(df: DataFrame, value: str = "lin") -> DataFrame:
    """df with some NaN and infinities among its values."""
    kind = F.col("l_partkey") % 9
    return df.withColumn(value, F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, float("-inf")).otherwise(F.col(value)))


CLEANED = "SELECT a.form, r.* REPLACE (CASE WHEN l_partkey % 9 > 2 THEN lin END AS lin) FROM v_residue r JOIN allowed a ON a.pid = r.pid WHERE " + OBS_SQL
query("o4_finite", "form:s pid:i site_label:s lin:d", "SELECT_STANDARD FROM cleaned", "allowed", extra={"cleaned": CLEANED})(lambda e, r, p: obs_of(e, dirty(r)))
query("o5_observation_stack", OCOLS, f"SELECT_STANDARD FROM v_residue WHERE {OBS_SQL}")(lambda e, r, p: r.filter(E.obs_condition(RESIDUE, OBS)))
query("o6_residue_stack", OCOLS, "SELECT_STANDARD FROM v_residue WHERE context = 'R' AND secondary_context = 'F'")(lambda e, r, p: r.filter(E.obs_condition(RESIDUE, replace(OBS, terminal="include", contexts=("R",), secondary=("F",)))))

# --- joins -------------------------------------------------------------------------------------------------------
XY = "pid:i x:d y:d"
R2 = f"SELECT r.* FROM v_residue r SEMI JOIN allowed a ON a.pid = r.pid WHERE {OBS_SQL}"
query("j1_entries_observations", "form:s pid:i site_label:s lin:d", "SELECT_STANDARD FROM obs", "allowed", "obs")(lambda e, r, p: obs_of(e, r))
query("j2_same_row", XY, "SELECT_STANDARD FROM (SELECT pid, lin AS x, ang AS y FROM obs WHERE lin IS NOT NULL AND ang IS NOT NULL)", "allowed", "obs")(lambda e, r, p: J.joint_pairs(r, RESIDUE, "lin", r, RESIDUE, "ang", allowed(e), OBS, OBS))
SAME = f"SELECT b.pid, a.lin AS x, b.ang AS y FROM (SELECT *, row_number() OVER (PARTITION BY pid, site ORDER BY {', '.join(c + ' DESC' for c in LAST.split(', '))}) AS k FROM f WHERE lin IS NOT NULL) a JOIN (SELECT * FROM f WHERE ang IS NOT NULL) b ON a.pid = b.pid AND a.site = b.site WHERE a.k = 1"
query("j3_same_level_join", XY, "SELECT_STANDARD FROM j", "allowed", extra={"f": R2.replace("r.*", "r.*, r.site_label AS site"), "j": SAME})(lambda e, r, p: J.joint_pairs(r, RESIDUE, "lin", r, SUGAR, "ang", allowed(e), OBS, OBS))
ORD = f"SELECT *, CAST(row_number() OVER (PARTITION BY pid ORDER BY site_label, {LAST}) - 1 AS VARCHAR) AS site FROM v_residue"
query("j4_ordinal_key", XY, "SELECT_STANDARD FROM j", "allowed", extra={"g": ORD, "f": f"SELECT r.* FROM g r SEMI JOIN allowed a ON a.pid = r.pid WHERE {OBS_SQL.replace(' AND secondary_context IN (' + chr(39) + 'F' + chr(39) + ', ' + chr(39) + 'O' + chr(39) + ')', '')}", "j": SAME})(lambda e, r, p: J.same_level(r, UNLABELLED, "lin", r, UNLABELLED, "ang", allowed(e), OBS))
query("j5_split_label", "pid:i a:s b:s", "SELECT_STANDARD FROM (SELECT pid, split_part(site_label, '--', 1) AS a, split_part(site_label, '--', 2) AS b FROM v_pair)")(lambda e, r, p: p.withColumn("s", J.split_label(F.col("site_label"))).filter("s is not null").select("pid", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b")))


def residue_join_sql(sides: str) -> dict[str, str]:
    return {
        "res": f"SELECT * FROM (SELECT r.pid, r.site_label AS site, r.lin AS y, row_number() OVER (PARTITION BY r.pid, r.site_label ORDER BY {', '.join('r.' + c + ' DESC' for c in LAST.split(', '))}) AS k FROM v_residue r SEMI JOIN allowed a ON a.pid = r.pid WHERE {OBS_SQL} AND lin IS NOT NULL) AS q WHERE k = 1",
        "pr": f"SELECT p.pid, p.shear AS x, unnest({sides}) AS site FROM v_pair p SEMI JOIN allowed a ON a.pid = p.pid WHERE shear IS NOT NULL",
        "j": "SELECT pr.pid, x, y FROM pr JOIN res ON res.pid = pr.pid AND res.site = pr.site",
    }


def pair_join(e, r, p, side="both"):
    return J.joint_pairs(p, PAIR, "shear", r, RESIDUE, "lin", allowed(e), ALL, OBS, "pair_residue", side)


query("j6_pair_residue_join", XY, "SELECT_STANDARD FROM j", "allowed", extra=residue_join_sql("[split_part(site_label, '--', 1), split_part(site_label, '--', 2)]"))(pair_join)
query("j7_residue_side", XY, "SELECT_STANDARD FROM j", "allowed", extra=residue_join_sql("[split_part(site_label, '--', 2)]"))(lambda e, r, p: pair_join(e, r, p, "nt2"))

# --- one parameter -----------------------------------------------------------------------------------------------
query("a1_effective_range", "lo:d hi:d", "SELECT_STANDARD FROM rng", "allowed", "obs", "rng")(lambda e, r, p: H.effective_range(obs_of(e, r), r, "lin", LIN.range_default))
query("a2_fallback_range", "lo:d hi:d", "SELECT_STANDARD FROM (SELECT min(lin) - (max(lin) - min(lin)) * 0.1 AS lo, max(lin) + (max(lin) - min(lin)) * 0.1 AS hi FROM v_residue)")(lambda e, r, p: H.effective_range(r.filter("lin > 1e9"), r, "lin"))
query("a4_linear_histogram", "form:s bin:i n:i", "SELECT_STANDARD FROM hist", *HIST)(lambda e, r, p: D.raw_histogram(obs_of(e, r), r, LIN, 64, ["form"])[0])
query("a5_circular_histogram", "form:s bin:i n:i", "SELECT_STANDARD FROM chist", "allowed", "obs", "chist")(lambda e, r, p: D.raw_histogram(obs_of(e, r), r, ANG, 72, ["form"])[0])
LM = "SELECT form, count(lin) AS n, avg(lin) AS mean, sqrt(greatest(0, avg(lin * lin) - avg(lin) * avg(lin))) AS std FROM obs WHERE lin IS NOT NULL GROUP BY form"
query("a6_linear_moments", "form:s n:i mean:d std:d", f"SELECT_STANDARD FROM ({LM})", "allowed", "obs")(lambda e, r, p: D.linear_moments(obs_of(e, r), "lin", ["form"]))
CM = f"SELECT form, n, {WRAP.format('degrees(atan2(s, c))')} AS mean, least(1, sqrt(s * s + c * c) / n) AS resultant, degrees(sqrt(-2 * ln(least(1, sqrt(s * s + c * c) / n)))) AS std FROM (SELECT form, count(*) AS n, sum(cos(radians({WRAP.format('ang')}))) AS c, sum(sin(radians({WRAP.format('ang')}))) AS s FROM obs WHERE ang IS NOT NULL GROUP BY form)"
query("a7_circular_moments", "form:s n:i mean:d resultant:d std:d", f"SELECT_STANDARD FROM ({CM})", "allowed", "obs")(lambda e, r, p: D.circular_moments(obs_of(e, r), "ang", ["form"]))
query("a8_distinct_entries", "form:s entries:i", "SELECT_STANDARD FROM (SELECT form, count(DISTINCT pid) AS entries FROM obs WHERE lin IS NOT NULL GROUP BY form)", "allowed", "obs")(lambda e, r, p: D.entries_with_value(obs_of(e, r), "lin", ["form"]))
PCT = "SELECT form, min(bin) AS bin FROM (SELECT *, sum(n) OVER (PARTITION BY form ORDER BY bin) AS up, sum(n) OVER (PARTITION BY form) AS total FROM dense) WHERE up >= total * {q} GROUP BY form"
query("a9_percentile", "form:s p:d", f"SELECT_STANDARD FROM (SELECT form, lo + (hi - lo) / 64 * (bin + 0.5) AS p FROM ({PCT.format(q=0.95)}), rng)", *DENSE)(lambda e, r, p: H.percentile(H.with_row(*dense_lin(e, r)), ["form"], 0.95, F.col("lo") + (F.col("hi") - F.col("lo")) / 64 * (F.col("bin") + 0.5)))
AUTO_SERIES = "SELECT c.form, (c.bin - shift + 72) % 72 AS bin, y / sum(y) OVER (PARTITION BY c.form) AS y, ((c.bin - shift + 72) % 72 + 0.5) * 5 + shift * 5 AS x FROM csmoothed c, seam"
PEAK = f"SELECT form, {WRAP.format('x')} AS peak FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY round(y, 12) DESC, bin) AS k FROM ({AUTO_SERIES})) WHERE k = 1"
AUTO = replace(View(), mode="auto")
query("a10_circular_peak", "form:s peak:d", f"SELECT_STANDARD FROM ({PEAK})", *CHIST, "csmoothed", extra=seam_ctes("pooled"))(lambda e, r, p: D.distribution(e, r, RESIDUE, ANG, ENTRY, OBS, AUTO)[1])
query("a11_visible_observations", "n:i", "SELECT_STANDARD FROM (SELECT sum(n) AS n FROM hist)", *HIST)(lambda e, r, p: D.raw_histogram(obs_of(e, r), r, LIN, 64, ["form"])[0].agg(F.sum("n").alias("n")))
query("a12_pooled_histogram", "bin:i n:i", "SELECT_STANDARD FROM pooled", *CHIST)(lambda e, r, p: pooled_ang(e, r))
LSERIES = "SELECT form, bin, lo + (hi - lo) / 64 * (bin + 0.5) AS x, y / sum(y) OVER (PARTITION BY form) AS y FROM smoothed, rng"
query("a13_linear_distribution", "form:s bin:i x:d y:d", f"SELECT_STANDARD FROM ({LSERIES})", *DENSE, "smoothed")(lambda e, r, p: D.distribution(e, r, RESIDUE, LIN, ENTRY, OBS, View())[0])
query("a13_circular_distribution", "form:s bin:i x:d y:d", f"SELECT_STANDARD FROM (SELECT form, bin, {WRAP.format('x')} AS x, y FROM ({AUTO_SERIES}))", *CHIST, "csmoothed", extra=seam_ctes("pooled"))(lambda e, r, p: D.distribution(e, r, RESIDUE, ANG, ENTRY, OBS, AUTO)[0])
BOTH = f"SELECT 'lin' AS param_id, form, bin, x, y FROM ({LSERIES}) UNION ALL SELECT 'ang', form, bin, {WRAP.format('x')}, y FROM ({AUTO_SERIES})"
OVERVIEW = (*DENSE, "smoothed", *CHIST[2:], "csmoothed")
with_none = lambda r: r.withColumn("none", F.lit(None).cast("double")).withColumn("rare", F.when(F.col("context") == "R", F.col("lin")))
MORE = replace(RESIDUE, params=(*RESIDUE.params, ParameterSpec("none"), ParameterSpec("rare")))
query("a14_family_overview", "param_id:s form:s bin:i x:d y:d", f"SELECT_STANDARD FROM ({BOTH})", *OVERVIEW, extra=seam_ctes("pooled"))(lambda e, r, p: D.family_overview(e, with_none(r), MORE, ENTRY, OBS, AUTO)[0])
PANELS = "SELECT 'lin' AS param_id, lo, hi, 0 AS shift, 0 AS cut, 'linear' AS kind, (SELECT sum(n) FROM hist) AS rows FROM rng UNION ALL SELECT 'ang', 0, 360, shift, shift * 5, kind, (SELECT sum(n) FROM chist) FROM seam UNION ALL SELECT 'none', 0, 1, 0, 0, 'linear', 0 UNION ALL SELECT 'rare', min(lin) - (max(lin) - min(lin)) * 0.1, max(lin) + (max(lin) - min(lin)) * 0.1, 0, 0, 'linear', 0 FROM v_residue WHERE context = 'R'"
query("a14_overview_panels", "param_id:s lo:d hi:d shift:i cut:d kind:s rows:i", f"SELECT_STANDARD FROM ({PANELS})", *HIST, *CHIST[2:], extra=seam_ctes("pooled"))(lambda e, r, p: D.family_overview(e, with_none(r), MORE, ENTRY, OBS, AUTO)[1])
SUM15 = f"SELECT m.*, d.entries, lo + (hi - lo) / 64 * (a.bin + 0.5) AS p05, lo + (hi - lo) / 64 * (b.bin + 0.5) AS p95 FROM ({LM}) m JOIN (SELECT form, count(DISTINCT pid) AS entries FROM obs WHERE lin IS NOT NULL GROUP BY form) d USING (form) JOIN ({PCT.format(q=0.05)}) a USING (form) JOIN ({PCT.format(q=0.95)}) b USING (form), rng"
query("o4_finite_summary", "form:s n:i entries:i mean:d std:d p05:d p95:d", f"SELECT_STANDARD FROM ({SUM15})", "allowed", extra={"obs": CLEANED, **{k: CTE[k] for k in DENSE[2:]}})(lambda e, r, p: D.distribution(e, dirty(r), RESIDUE, LIN, ENTRY, OBS, View())[1])
query("a15_linear_summary", "form:s n:i entries:i mean:d std:d p05:d p95:d", f"SELECT_STANDARD FROM ({SUM15})", *DENSE)(lambda e, r, p: D.distribution(e, r, RESIDUE, LIN, ENTRY, OBS, View())[1])
query("a15_circular_summary", "form:s n:i entries:i mean:d resultant:d std:d peak:d", f"SELECT_STANDARD FROM ({CM}) m JOIN (SELECT form, count(DISTINCT pid) AS entries FROM obs WHERE ang IS NOT NULL GROUP BY form) d USING (form) JOIN ({PEAK}) USING (form)", *CHIST, "csmoothed", extra=seam_ctes("pooled"))(lambda e, r, p: D.distribution(e, r, RESIDUE, ANG, ENTRY, OBS, AUTO)[1])
def kept_state(e: DataFrame, r: DataFrame) -> DataFrame:
    """The states of the rows of either secondary context, in the frame of all of them, merged."""
    a, forms = allowed(e), selected_forms(ENTRY.forms)
    one = A.frame(a, r, RESIDUE, OBS)
    parts = [A.accumulate(a, r, RESIDUE, replace(OBS, secondary=(k,)), AUTO, forms, one) for k in ("F", "O")]
    return A.finished(A.merged(*parts), RESIDUE, AUTO, forms)


query("a13_merged_state", "param_id:s form:s bin:i x:d y:d", f"SELECT_STANDARD FROM ({BOTH})", *OVERVIEW, extra=seam_ctes("pooled"))(lambda e, r, p: A.series(kept_state(e, r), RESIDUE))
query("a15_merged_linear_summary", "form:s n:i entries:i mean:d std:d p05:d p95:d", f"SELECT_STANDARD FROM ({SUM15})", *DENSE)(lambda e, r, p: A.summaries(kept_state(e, r), RESIDUE, AUTO, LIN))
query("a15_merged_circular_summary", "form:s n:i entries:i mean:d resultant:d std:d peak:d", f"SELECT_STANDARD FROM ({CM}) m JOIN (SELECT form, count(DISTINCT pid) AS entries FROM obs WHERE ang IS NOT NULL GROUP BY form) d USING (form) JOIN ({PEAK}) USING (form)", *CHIST, "csmoothed", extra=seam_ctes("pooled"))(lambda e, r, p: A.summaries(kept_state(e, r), RESIDUE, AUTO, ANG))
query("a16_selection_counts", "entries:i plotted:i family_rows:i", "SELECT_STANDARD FROM (SELECT (SELECT count(*) FROM allowed) AS entries, (SELECT count(lin) FROM obs) AS plotted, (SELECT count(*) FROM v_residue) AS family_rows)", "allowed", "obs")(lambda e, r, p: D.selection_counts(e, r, RESIDUE, LIN, ENTRY, OBS))
query("a17_universe_counts", "kind:s id:s n:i", "SELECT_STANDARD FROM (SELECT 'all' AS kind, 'entries' AS id, count(*) AS n FROM v_entries UNION ALL SELECT 'form', form, count(*) FROM v_entries GROUP BY form UNION ALL SELECT 'method', method, count(*) FROM v_entries GROUP BY method UNION ALL SELECT 'cleanliness', 'conservative', count(*) FROM v_entries WHERE passes_conservative UNION ALL SELECT 'cleanliness', 'relaxed', count(*) FROM v_entries WHERE passes_relaxed UNION ALL SELECT 'cleanliness', 'mw100', count(*) FROM v_entries WHERE passes_mw100 UNION ALL SELECT 'family', 'residue', count(*) FROM v_residue UNION ALL SELECT 'family', 'pair', count(*) FROM v_pair)")(lambda e, r, p: R.universe_counts(e, {"residue": r, "pair": p}))
query("a18_rows_per_entry", "pid:i residue_rows:i pair_rows:i", "SELECT_STANDARD FROM (SELECT e.pid, coalesce(a.n, 0) AS residue_rows, coalesce(b.n, 0) AS pair_rows FROM v_entries e LEFT JOIN (SELECT pid, count(*) AS n FROM v_residue GROUP BY pid) a USING (pid) LEFT JOIN (SELECT pid, count(*) AS n FROM v_pair GROUP BY pid) b USING (pid))")(lambda e, r, p: R.rows_per_entry(e, {"residue": r, "pair": p}))

# --- series ------------------------------------------------------------------------------------------------------
query("t1_dense_grid", "form:s bin:i n:i", "SELECT_STANDARD FROM dense", *DENSE)(lambda e, r, p: dense_lin(e, r)[0])
query("t2_gaussian_kernel", "form:s o:i w:d", f"SELECT_STANDARD FROM (SELECT DISTINCT form, o, w FROM hist, ({kernel_sql(1.7)}) AS k)", *HIST)(lambda e, r, p: D.raw_histogram(obs_of(e, r), r, LIN, 64, ["form"])[0].select("form").distinct().select("form", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in C.kernel(1.7)])).alias("k")).select("form", "k.*"))
query("t3_linear_smoothing", "form:s bin:i y:d", "SELECT_STANDARD FROM smoothed", *DENSE, "smoothed")(lambda e, r, p: H.smooth(dense_lin(e, r)[0], ["form"], 64, 1.0, False))
query("t4_circular_smoothing", "form:s bin:i y:d", f"SELECT_STANDARD FROM ({smooth_sql('cdense', 72, 2.5, True)})", *CHIST)(lambda e, r, p: H.smooth(dense_ang(e, r), ["form"], 72, 2.5, True))
query("t5_probability", "form:s bin:i y:d", f"SELECT_STANDARD FROM ({LSERIES})", *DENSE, "smoothed")(lambda e, r, p: H.scaled(H.smooth(dense_lin(e, r)[0], ["form"], 64, 1.0, False), ["form"]))
query("t6_density", "form:s bin:i x:d y:d", f"SELECT_STANDARD FROM (SELECT form, bin, x, y / ((hi - lo) / 64) AS y FROM ({LSERIES}), rng)", *DENSE, "smoothed")(lambda e, r, p: D.distribution(e, r, RESIDUE, LIN, ENTRY, OBS, View(scale="density"))[0])
query("t7_bin_centres", "form:s bin:i x:d", f"SELECT_STANDARD FROM (SELECT form, bin, {WRAP.format('(bin + 0.5) * 5 + 180')} AS x FROM cdense)", *CHIST)(lambda e, r, p: D.distribution(e, r, RESIDUE, ANG, ENTRY, OBS, View(mode="signed_180"))[0])
query("t8_rotate", "form:s bin:i n:i", "SELECT_STANDARD FROM (SELECT form, (bin - 17 + 72) % 72 AS bin, n FROM cdense)", *CHIST)(lambda e, r, p: H.rotate(dense_ang(e, r), F.lit(17), 72))
query("t9_seam_by_gap", "kind:s shift:i", "SELECT_STANDARD FROM seam", *CHIST, "narrow", extra=seam_ctes("narrow"))(lambda e, r, p: H.seam(pooled_ang(e, r).withColumn("n", F.when((F.col("bin") >= 66) | (F.col("bin") < 4), 0).otherwise(F.col("n"))), 72, "auto"))
query("t10_seam_by_quiet_window", "kind:s shift:i", "SELECT_STANDARD FROM seam", *CHIST, extra={"hollow": "SELECT bin, CASE WHEN bin BETWEEN 40 AND 48 THEN CAST(1 + bin % 3 AS BIGINT) ELSE n END AS n FROM pooled", **seam_ctes("hollow")})(lambda e, r, p: H.seam(pooled_ang(e, r).withColumn("n", F.when(F.col("bin").between(40, 48), (1 + F.col("bin") % 3).cast("long")).otherwise(F.col("n"))), 72, "auto"))
query("t11_circular_view", "mode:s shift:i cut:d", "SELECT_STANDARD FROM (SELECT 'wrap_360' AS mode, 0 AS shift, 0 AS cut UNION ALL SELECT 'signed_180', 36, 180 UNION ALL SELECT 'auto', shift, shift * 5 FROM seam)", *CHIST, extra=seam_ctes("pooled"))(lambda e, r, p: _views(pooled_ang(e, r)))


def _views(pooled: DataFrame) -> DataFrame:
    one = [H.seam(pooled, 72, m).withColumn("mode", F.lit(m)) for m in ("wrap_360", "signed_180", "auto")]
    return one[0].unionByName(one[1]).unionByName(one[2])


# --- two parameters ----------------------------------------------------------------------------------------------
PR = residue_join_sql("[split_part(site_label, '--', 1), split_part(site_label, '--', 2)]")
AXES = {**PR, "ax": padded_sql("j", "x", None), "ay": padded_sql("j", "y", (5.0, 45.0))}
cell = lambda v, ax: f"greatest(0, least(47, CAST(floor(({v} - {ax}.lo) / ({ax}.hi - {ax}.lo) * 48) AS INT)))"
GRID = {
    **AXES,
    "g0": f"SELECT {cell('x', 'ax')} AS bx, {cell('y', 'ay')} AS \"by\", count(*) AS n FROM j, ax, ay GROUP BY ALL",
    "g": 'SELECT c.bx, d."by", coalesce(n, 0) AS z FROM (SELECT unnest(range(48)) AS bx) c CROSS JOIN (SELECT unnest(range(48)) AS "by") d LEFT JOIN g0 ON g0.bx = c.bx AND g0."by" = d."by"',
    "s1": smooth_sql("g", 48, 1.0, False, '"by"', "bx", "z"),
    "s2": smooth_sql("s1", 48, 1.0, False, "bx", '"by"', "y"),
}


def points(e, r, p):
    return J.placed(J.placed(pair_join(e, r, p), "x", SHEAR, 48, "wrap_360"), "y", LIN, 48, "wrap_360")


def plain_grid(e, r, p):
    return J.grid(points(e, r, p), 48, 48).withColumnRenamed("by", "b_y")


GCOLS = "bx:i b_y:i z:d"
query("p1_joint_linear_axis", "lo:d hi:d", "SELECT_STANDARD FROM ax", "allowed", extra=AXES)(lambda e, r, p: J.linear_axis(pair_join(e, r, p), "x"))
query("p2_joint_circular_axis", "kind:s shift:i cut:d", "SELECT_STANDARD FROM (SELECT kind, shift, shift * 5 AS cut FROM seam)", *CHIST, extra=seam_ctes("pooled"))(lambda e, r, p: J.circular_axis(obs_of(e, r).filter("ang is not null").select(F.col("ang").alias("x")), "x", 72, "auto"))
query("p4_grid", GCOLS, 'SELECT_STANDARD FROM (SELECT bx, "by" AS b_y, z FROM g)', "allowed", extra=GRID)(plain_grid)
query("p5_grid_smoothing", GCOLS, 'SELECT_STANDARD FROM (SELECT bx, "by" AS b_y, y AS z FROM s2)', "allowed", extra=GRID)(lambda e, r, p: J.smooth_grid(J.grid(points(e, r, p), 48, 48), 48, 48, 1.0, False, False).withColumnRenamed("by", "b_y"))
query("p6_grid_scaling", GCOLS, 'SELECT_STANDARD FROM (SELECT bx, "by" AS b_y, z / sum(z) OVER () / 2.5 AS z FROM g)', "allowed", extra=GRID)(lambda e, r, p: J.scaled_grid(J.grid(points(e, r, p), 48, 48), F.lit(2.5)).withColumnRenamed("by", "b_y"))
query("p7_cell_centres", "bx:i b_y:i x:d y:d", 'SELECT_STANDARD FROM (SELECT bx, "by" AS b_y, ax.lo + (bx + 0.5) * (ax.hi - ax.lo) / 48 AS x, ay.lo + ("by" + 0.5) * (ay.hi - ay.lo) / 48 AS y FROM g, ax, ay)', "allowed", extra=GRID)(lambda e, r, p: J.joint_distribution(pair_join(e, r, p), SHEAR, LIN, View())[0].withColumnRenamed("by", "b_y"))
query("p8_log_intensity", "bx:i b_y:i z:d top:d", 'SELECT_STANDARD FROM (SELECT bx, "by" AS b_y, log10(greatest(z, 1e-8)) AS z, max(z) OVER () AS top FROM g)', "allowed", extra=GRID)(lambda e, r, p: _log(plain_grid(e, r, p)))


def _log(cells: DataFrame) -> DataFrame:
    return H.with_row(cells, cells.agg(F.max("z").alias("top"))).withColumn("z", J.log_intensity(F.col("z").cast("double")))


query("o4_finite_pairs", XY, "SELECT_STANDARD FROM j", "allowed", extra={k: v.replace("lin IS NOT NULL", "l_partkey % 9 > 2 AND lin IS NOT NULL").replace("shear IS NOT NULL", "l_partkey % 9 > 2") for k, v in PR.items()})(lambda e, r, p: pair_join(e, dirty(r), dirty(p, "shear")))
query("p9_pearson", "r:d r2:d", "SELECT_STANDARD FROM (SELECT corr(x, y) AS r, corr(x, y) * corr(x, y) AS r2 FROM j)", "allowed", extra=PR)(lambda e, r, p: pair_join(e, r, p).agg(J.pearson().alias("r")).withColumn("r2", F.col("r") * F.col("r")))
CC = "SELECT count(*) AS n, sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(sin(a - ma) ** 2) * sum(sin(b - mb) ** 2)) AS r FROM (SELECT radians(x) AS a, radians(y) AS b FROM cj), (SELECT atan2(sum(sin(radians(x))), sum(cos(radians(x)))) AS ma, atan2(sum(sin(radians(y))), sum(cos(radians(y)))) AS mb FROM cj)"
CJ = "SELECT o.ang AS x, CAST(o.l_partkey * 37 % 360 AS DOUBLE) AS y, o.pid FROM obs o WHERE o.ang IS NOT NULL"
ang_pairs = lambda e, r: obs_of(e, r).filter("ang is not null").select("pid", F.col("ang").alias("x"), (F.col("l_partkey") * 37 % 360).cast("double").alias("y"))
query("p10_circular_correlation", "n:i r:d", f"SELECT_STANDARD FROM ({CC})", "allowed", "obs", extra={"cj": CJ})(lambda e, r, p: J.circular_correlation(ang_pairs(e, r)))
query("p11_matched_counts", "n:i entries:i", "SELECT_STANDARD FROM (SELECT count(*) AS n, count(DISTINCT pid) AS entries FROM j)", "allowed", extra=PR)(lambda e, r, p: J.matched_counts(pair_join(e, r, p)))
CONTOURS = {
    **GRID,
    "span": "SELECT max(CASE WHEN y > 0 THEN y END) / sum(y) AS hi FROM s2",
    "steps": "SELECT DISTINCT m * power(10e0, e) AS s FROM (SELECT unnest([1e0, 2e0, 2.5e0, 5e0, 10e0]) AS m), (SELECT unnest(range(CAST(floor(log10(hi)) AS INT) - 3, CAST(floor(log10(hi)) AS INT) + 2)) AS e FROM span)",
    "usual": "SELECT min(s) AS u FROM steps, span WHERE s >= hi / 10 * (1 - 1e-12)",
    "widths": "SELECT 'standard' AS width, u AS step FROM usual UNION ALL SELECT 'wide', min(s) FROM steps, span, usual WHERE s >= hi / 7 * (1 - 1e-12) AND s > u * (1 + 1e-9) UNION ALL SELECT 'tight', least((SELECT max(s) FROM steps, span WHERE s <= hi / 14 * (1 + 1e-12)), (SELECT max(s) FROM steps, usual WHERE s < u * (1 - 1e-9)))",
}
query("p12_contour_levels", "width:s step:d level:d", "SELECT_STANDARD FROM (SELECT width, step, unnest(range(1, greatest(1, CAST(floor(hi / step + 1e-9) AS INT)) + 1)) * step AS level FROM widths, span)", "allowed", extra=CONTOURS)(lambda e, r, p: J.contour_levels(J.joint_distribution(pair_join(e, r, p), SHEAR, LIN, View())[0]))
query("p13_joint_distribution", "bx:i b_y:i x:d y:d z:d", 'SELECT_STANDARD FROM (SELECT bx, "by" AS b_y, ax.lo + (bx + 0.5) * (ax.hi - ax.lo) / 48 AS x, ay.lo + ("by" + 0.5) * (ay.hi - ay.lo) / 48 AS y, s2.y / sum(s2.y) OVER () AS z FROM s2, ax, ay)', "allowed", extra=GRID)(lambda e, r, p: J.joint_distribution(pair_join(e, r, p), SHEAR, LIN, View())[0].withColumnRenamed("by", "b_y"))
query("p13_joint_statistics", "n:i entries:i r:d r2:d circular_r:d", f"SELECT_STANDARD FROM (SELECT (SELECT count(*) FROM cj) AS n, (SELECT count(DISTINCT pid) FROM cj) AS entries, (SELECT corr({WRAP.format('x')}, {WRAP.format('y')}) FROM cj) AS r, (SELECT corr({WRAP.format('x')}, {WRAP.format('y')}) ** 2 FROM cj) AS r2, (SELECT r FROM ({CC})) AS circular_r)", "allowed", "obs", extra={"cj": CJ})(lambda e, r, p: J.joint_distribution(ang_pairs(e, r), ANG, OPENING, View())[1])

# --- scalar functions --------------------------------------------------------------------------------------------
query("f1_wrap", "pid:i v:d", f"SELECT_STANDARD FROM (SELECT pid, {WRAP.format('ang')} AS v FROM v_residue)")(lambda e, r, p: r.select("pid", C.wrap(F.col("ang")).alias("v")))
SIGNED = f"CASE WHEN {WRAP.format('ang')} > 180 THEN {WRAP.format('ang')} - 360 ELSE {WRAP.format('ang')} END"
query("f2_signed_angle", "pid:i v:d", f"SELECT_STANDARD FROM (SELECT pid, {SIGNED} AS v FROM v_residue)")(lambda e, r, p: r.select("pid", C.signed_angle(F.col("ang")).alias("v")))
query("f3_display_value", "pid:i a:d b:d c:d", f"SELECT_STANDARD FROM (SELECT pid, {WRAP.format(WRAP.format('ang') + ' - 35')} AS a, {SIGNED} AS b, lin AS c FROM v_residue)")(lambda e, r, p: r.select("pid", C.display_value(F.col("ang"), True, "auto", F.lit(35.0)).alias("a"), C.display_value(F.col("ang"), True, "signed_180").alias("b"), C.display_value(F.col("lin"), False, "auto").alias("c")))
CLEAN = "CASE WHEN passes_conservative THEN 'Conservative' WHEN passes_mw100 THEN 'No large het' WHEN passes_relaxed THEN 'Relaxed' ELSE 'All' END"
RESL = "CASE WHEN resolution_known AND resolution IS NOT NULL THEN printf('%.2f Å', resolution) ELSE '-' END"
query("f4_cleanliness_label", "pid:i v:s", f"SELECT_STANDARD FROM (SELECT pid, {CLEAN} AS v FROM v_entries)")(lambda e, r, p: e.select("pid", C.cleanliness_label().alias("v")))
query("f5_resolution_label", "pid:i v:s", f"SELECT_STANDARD FROM (SELECT pid, {RESL} AS v FROM v_entries)")(lambda e, r, p: e.select("pid", C.resolution_label(even=True).alias("v")))
FORML = "CASE form WHEN 'adna' THEN 'A-DNA' WHEN 'bdna' THEN 'B-DNA' WHEN 'zdna' THEN 'Z-DNA' WHEN 'quadruplex' THEN 'Quadruplex' ELSE form END"
query("f6_form_label", "pid:i v:s", f"SELECT_STANDARD FROM (SELECT pid, {FORML} AS v FROM v_entries)")(lambda e, r, p: e.select("pid", C.form_label(F.col("form")).alias("v")))
query("f7_fixed_digits", "pid:i v:s", "SELECT_STANDARD FROM (SELECT pid, CASE WHEN lin IS NULL THEN '-' ELSE printf('%.3f', lin * ang / 7) END AS v FROM v_residue)")(lambda e, r, p: r.select("pid", C.fixed(F.col("lin") * F.col("ang") / 7, 3, even=True).alias("v")))
query("f8_entry_url", "pid:i v:s", "SELECT_STANDARD FROM (SELECT pid, 'https://example.org/entry/' || upper(entry_id) AS v FROM v_entries)")(lambda e, r, p: e.select("pid", C.entry_url(F.col("entry_id")).alias("v")))

# --- tables and exports ------------------------------------------------------------------------------------------
query("l1_sorted_entries", "pid:i entry_id:s", "SELECT_STANDARD FROM v_entries ORDER BY entry_id, pid")(lambda e, r, p: R.sorted_entries(e))
query("l2_filtered_entries", "pid:i entry_id:s form:s", "SELECT_STANDARD FROM allowed ORDER BY entry_id, pid", "allowed")(lambda e, r, p: R.sorted_entries(allowed(e)))
query("l3_page", "pid:i entry_id:s", "SELECT_STANDARD FROM (SELECT * FROM allowed ORDER BY entry_id, pid LIMIT 100 OFFSET 100)", "allowed")(lambda e, r, p: R.entry_page(allowed(e), 1))
query("l4_entry_table", "pid:i entry:s form_label:s method:s resolution_label:s cleanliness:s het_names:s residue_count:i", f"SELECT_STANDARD FROM (SELECT pid, upper(entry_id) AS entry, {FORML} AS form_label, method, {RESL} AS resolution_label, {CLEAN} AS cleanliness, het_names, residue_count FROM v_entries)")(lambda e, r, p: R.entry_table(e, even=True))
EXPORT = f"SELECT o.pid, o.form, {LAST}, printf('%.6f', o.lin) AS lin, upper(entry_id) AS pdb_id, site_label, {FORML.replace('form', 'o.form')} AS form_nakb, method, CASE WHEN resolution_known AND resolution IS NOT NULL THEN printf('%.2f', resolution) ELSE '' END AS resolution_angstrom, {CLEAN} AS cleanliness, het_names, residue_count, coalesce(nullif(context, ''), 'Missing') AS sequence_context, secondary_context AS backbone_state, edge_flag AS terminal_flag FROM obs o JOIN allowed a ON a.pid = o.pid WHERE lin IS NOT NULL"
query("l1_row_numbers", "row:i pid:i entry_id:s", "SELECT_STANDARD FROM (SELECT row_number() OVER (ORDER BY entry_id, pid) - 1 AS row, pid, entry_id FROM v_entries)")(lambda e, r, p: R.ordered_entries(e).rows())
query("l3_page_by_number", "pid:i entry_id:s", "SELECT_STANDARD FROM (SELECT * FROM allowed ORDER BY entry_id, pid LIMIT 100 OFFSET 200)", "allowed")(lambda e, r, p: R.ordered_entries(allowed(e)).page(2))
query("k1_ordered_export", "row:i lin:s pdb_id:s site_label:s form_nakb:s terminal_flag:i", f"SELECT_STANDARD FROM (SELECT *, row_number() OVER (ORDER BY list_position(['zdna', 'adna', 'bdna', 'quadruplex'], form), pid, {LAST}) - 1 AS row FROM ({EXPORT}))", "allowed", "obs")(lambda e, r, p: R.ordered_export(e, r, RESIDUE, "lin", replace(ENTRY, forms=("zdna", "adna", "bdna", "quadruplex")), OBS, even=True).rows())
query(
    "k1_observation_export", "lin:s pdb_id:s site_label:s form_nakb:s method:s resolution_angstrom:s cleanliness:s het_names:s residue_count:i sequence_context:s backbone_state:s terminal_flag:i",
    f"SELECT_STANDARD FROM ({EXPORT})", "allowed", "obs",
)(lambda e, r, p: R.export_observations(e, r, RESIDUE, "lin", ENTRY, OBS, even=True))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a13_linear_distribution"](spark, sf_dir)
