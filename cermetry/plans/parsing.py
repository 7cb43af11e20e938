"""Registered queries: composition extraction."""

from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions import constants as K
from cermetry.functions.common import pinned, r6
from cermetry.operators import parsing as P
from cermetry.plans import bridge as B
from cermetry.plans.parsed_sql import SYM, formula_text, parsed
from cermetry.plans.registry import query

ALLOYS = B.sql("alloys")
SH = B.shares_sql("sh", "alloys", "alloy_id", "formula")
HARD = B.in_list(K.HARD_PHASES)
HARD_LOWER = B.in_list([p.lower() for p in K.HARD_PHASES])
SHEET_METALS = B.in_list(K.SHEET_METALS)


def _experiments(spark, sf):
    return B.view(spark, sf, "experiments", heavy=True).select("exp_id", "raw_composition")


def _alloys(spark, sf):
    return B.view(spark, sf, "alloys", heavy=True).select("alloy_id", "formula", "ceramic", "binder_pct")


def _parsed_rows(df):
    """Flat comparison columns of a struct column ``p``."""
    return df.filter("p IS NOT NULL").select(
        "exp_id", "p.format", r6("p.binder_wt_pct").alias("binder_wt_pct"), "p.ceramic_formula",
        "p.secondary_phase", C.standard_text(F.col("p.binder"), one="1").alias("formula"),
    )


def _one_format(fmt):
    """The cascade's records of one format, by SQL."""
    return f"""WITH {parsed()}, f AS ({formula_text()})
SELECT exp_id, format, round(wt, 6) + 0e0 AS binder_wt_pct, phase AS ceramic_formula, secondary AS secondary_phase, formula
FROM chosen JOIN f USING (exp_id) WHERE format = '{fmt}'"""


@query("c1_clean_text", f"WITH {B.sql('experiments')} SELECT exp_id, trim(regexp_replace(translate(raw_composition, '–—，,;', '--   '), '\\s+', ' ', 'g')) AS cleaned FROM experiments")
def c1(spark, sf):
    return _experiments(spark, sf).select("exp_id", C.clean_text("raw_composition").alias("cleaned"))


@query("c2_formula_shares", f"WITH {ALLOYS}, {SH} SELECT alloy_id, el, round(c, 9) + 0e0 AS share FROM sh")
def c2(spark, sf):
    return _alloys(spark, sf).select("alloy_id", F.explode(C.formula_shares("formula")).alias("el", "share")).withColumn(
        "share", r6("share", 9))


_C3 = f"""WITH {B.sql('experiments')}, s AS (SELECT exp_id, regexp_replace(trim(raw_composition), '^[a-z]\\s+', '') AS s FROM experiments),
t AS (SELECT exp_id, list_filter(regexp_split_to_array(s, '\\s+'), lambda k: k <> '') AS t FROM s),
p AS (SELECT exp_id, t[i] AS k, t[i + 1] AS nxt FROM (SELECT exp_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)),
a AS (SELECT exp_id, CASE WHEN TRY_CAST(nxt AS DOUBLE) IS NOT NULL THEN k ELSE regexp_extract(k, '^{SYM}', 1) END AS k,
        coalesce(TRY_CAST(nxt AS DOUBLE), TRY_CAST(nullif(regexp_extract(k, '^{SYM}', 2), '') AS DOUBLE), 1) AS v
      FROM p WHERE TRY_CAST(k AS DOUBLE) IS NULL),
w AS (SELECT * FROM a WHERE k <> '' UNION ALL SELECT exp_id, 'WC', 100 - sum(CASE WHEN k NOT IN {HARD} THEN v END) FROM a WHERE k <> '' GROUP BY exp_id
  HAVING count(CASE WHEN k = 'WC' THEN 1 END) = 0 AND sum(CASE WHEN k NOT IN {HARD} THEN v END) > 0),
n AS (SELECT exp_id, k, v / sum(v) OVER (PARTITION BY exp_id) * 100 AS v FROM w)"""


@query("c3_cermet_text", f"{_C3} SELECT exp_id, k AS el, round(v, 6) + 0e0 AS pct FROM n")
def c3(spark, sf):
    e = _experiments(spark, sf)
    return e.select("exp_id", F.explode(C.cermet_amounts("raw_composition")).alias("el", "pct")).withColumn("pct", r6("pct"))


@query("c3_cermet_binder_only", f"{_C3} SELECT exp_id, k AS el, round(v / sum(v) OVER (PARTITION BY exp_id), 6) + 0e0 AS share FROM n WHERE k NOT IN {HARD}")
def c3b(spark, sf):
    e = _experiments(spark, sf)
    return e.select("exp_id", F.explode(C.cermet_binder("raw_composition")).alias("el", "share")).withColumn("share", r6("share"))


_FORMATS = {
    "c4_dash_format": ("dash", C.dash_format),
    "c5_space_format": ("space", C.space_format),
    "c6_prefix_format": ("prefix", C.prefix_format),
    "c7_placeholder_format": ("placeholder", C.placeholder_format),
    "c8_number_first_format": ("number_first", C.number_first_format),
    "c9_pure_alloy_format": ("pure_alloy", C.pure_alloy_format),
}


def _register_format(name, fmt, parser):
    @query(name, _one_format(fmt))
    def run(spark, sf):
        return _parsed_rows(_experiments(spark, sf).select("exp_id", pinned(parser(C.clean_text("raw_composition"))).alias("p")))


for _name, (_fmt, _parser) in _FORMATS.items():
    _register_format(_name, _fmt, _parser)


@query("c10_parse_cascade", f"""WITH {parsed()}, f AS ({formula_text()})
SELECT exp_id, format, round(wt, 6) + 0e0 AS binder_wt_pct, phase AS ceramic_formula, secondary AS secondary_phase, formula
FROM chosen JOIN f USING (exp_id)""")
def c10(spark, sf):
    return _parsed_rows(_experiments(spark, sf).select("exp_id", pinned(C.parse_cascade("raw_composition")).alias("p")))


# Token scan of the implicit-amount reading.  A number at an even distance from
# the start of its run of numbers opens a pair; the next token is its symbol.
_IS_CERAMIC = f"(lower(k) IN {HARD_LOWER} OR (regexp_matches(k, '[CNO]') AND length(k) > 2 AND k NOT IN {SHEET_METALS}))"
_SHEET_TEXT = f"{B.sql('sheet')}, st AS (SELECT *, regexp_replace(trim(composition), '^[bB]\\s+', '') AS s FROM sheet), tk AS (SELECT row_id, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda k: k <> '') AS t FROM st)"
_ITEMS = f"""{_SHEET_TEXT},
alt AS (SELECT row_id, t, len(t) % 2 = 0 AND len(list_filter(range(1, len(t) + 1), lambda i: (TRY_CAST(t[i] AS DOUBLE) IS NOT NULL) <> (i % 2 = 0))) = 0 AS pairs
        FROM tk WHERE NOT list_contains(list_transform(t, lambda k: lower(k)), 'x')),
ps AS (SELECT row_id, pairs, t, unnest(range(1, len(t) + 1)) AS i FROM alt),
it AS (SELECT row_id, regexp_replace(t[i], '[^a-zA-Z0-9]', '', 'g') AS k, CAST(t[i + 1] AS DOUBLE) AS v FROM ps WHERE pairs AND i % 2 = 1
       UNION ALL
       SELECT row_id, regexp_replace(t[i], '[^a-zA-Z0-9]', '', 'g'), coalesce(TRY_CAST(t[i - 1] AS DOUBLE), 1) FROM ps WHERE NOT pairs AND TRY_CAST(t[i] AS DOUBLE) IS NULL),
am AS (SELECT row_id, k, sum(v) AS v FROM it GROUP BY ALL),
cl AS (SELECT *, {_IS_CERAMIC} AS cer FROM am),
ag AS (SELECT row_id, count(CASE WHEN cer THEN 1 END) AS nc, count(CASE WHEN NOT cer THEN 1 END) AS nb,
  coalesce(sum(CASE WHEN NOT cer THEN v END), 0) AS sb, coalesce(sum(CASE WHEN cer AND v > 0 THEN v END), 0) AS sn, coalesce(sum(CASE WHEN cer THEN v END), 0) AS sc,
  count(CASE WHEN cer AND v = 1 THEN 1 END) AS ones, coalesce(sum(CASE WHEN cer AND v > 0 AND v <> 1 THEN v END), 0) AS adds,
  coalesce(sum(CASE WHEN NOT cer OR v <> 1 THEN v END), 0) AS expl FROM cl GROUP BY row_id),
cs AS (SELECT *, CASE WHEN nb = 0 THEN NULL WHEN nc = 0 THEN '4' WHEN ones > 0 AND adds < 5 THEN CASE WHEN sb > 0 AND sb < 100 THEN '1a' ELSE '1b' END
  WHEN expl < 100 AND expl > 10 AND ones > 0 THEN '2' ELSE '3' END AS kase FROM ag),
rc AS (SELECT *, CASE kase WHEN '1a' THEN sb WHEN '1b' THEN 100 * sb / nullif(sb + sn, 0) WHEN '2' THEN sb WHEN '3' THEN 100 * sb / nullif(sb + sc, 0) WHEN '4' THEN 100 END AS wt FROM cs),
imp AS (SELECT row_id, wt, CAST(nc AS BIGINT) AS nc, CAST(nb AS BIGINT) AS nb, (SELECT sum(CASE WHEN kase = '1a' AND v > 0 THEN v / sn * (100 - sb) WHEN kase = '1a' THEN 0 WHEN kase = '2' AND v = 1 THEN (100 - expl) / ones ELSE v END) FROM cl WHERE cl.row_id = rc.row_id AND cer) AS ceramic_sum
  FROM rc WHERE wt IS NOT NULL)"""


@query("c11_implicit_amounts", f"WITH {_ITEMS} SELECT row_id, round(wt, 6) + 0e0 AS binder_wt_pct, nb AS n_binder, nc AS n_ceramic, round(coalesce(ceramic_sum, 0), 6) + 0e0 AS ceramic_sum FROM imp")
def c11(spark, sf):
    s = B.view(spark, sf, "sheet", heavy=True).select("row_id", F.regexp_replace(F.trim("composition"), r"^[bB]\s+", "").alias("s"))
    s = s.filter(~F.array_contains(C.tokens(F.lower("s")), "x")).select("row_id", pinned(C.reconcile(C.sheet_items(F.col("s")))).alias("p"))
    return s.filter("p IS NOT NULL").select(
        "row_id", r6("p.binder_wt_pct").alias("binder_wt_pct"), F.size("p.binder").cast("bigint").alias("n_binder"),
        F.size("p.ceramic").cast("bigint").alias("n_ceramic"),
        r6(F.aggregate(F.map_values("p.ceramic"), F.lit(0.0), lambda a, v: a + v)).alias("ceramic_sum"),
    )


_KNOWN = f"""kn AS (SELECT row_id, list_filter(t, lambda k: lower(k) IN {HARD_LOWER})[-1] AS phase, list_filter(t, lambda k: k IN {SHEET_METALS})[-1] AS metal,
  100 - TRY_CAST(nullif(regexp_extract(s, '^([\\d.]+)\\s+', 1), '') AS DOUBLE) AS w FROM tk WHERE list_contains(t, 'x') AND regexp_matches(s, '^\\d'))"""


@query("c12_known_ceramic", f"WITH {_SHEET_TEXT}, {_KNOWN} SELECT row_id, phase, metal, round(w, 6) + 0e0 AS binder_wt_pct FROM kn WHERE w > 0 AND w < 100 AND phase IS NOT NULL AND metal IS NOT NULL")
def c12(spark, sf):
    s = B.view(spark, sf, "sheet", heavy=True)
    return s.select("row_id", pinned(C.known_ceramic_format("composition")).alias("p")).filter("p IS NOT NULL").select(
        "row_id", F.map_keys("p.ceramic")[0].alias("phase"), F.map_keys("p.binder")[0].alias("metal"), r6("p.binder_wt_pct").alias("binder_wt_pct"))


def _quick(vol, metal, phase):
    rho = lambda e, d: "CASE " + " ".join(f"WHEN {e} = '{k}' THEN {v}e0" for k, v in K.QUICK_DENSITY.items()) + f" ELSE {d} END"
    return f"({vol} * ({rho(metal, '85e-1')}) / nullif((1 - {vol} / 1e2) * ({rho(phase, '15e0')}) + {vol} / 1e2 * ({rho(metal, '85e-1')}), 0))"


_VOL = "TRY_CAST(binder_vol AS DOUBLE)"
_PH = f"""ph AS (SELECT row_id, phase, metal, vol, CASE WHEN vol IS NULL THEN NULL ELSE {_quick('vol', 'metal', 'phase')} END AS w FROM (
  SELECT tk.row_id, list_filter(t, lambda k: lower(k) IN {HARD_LOWER})[-1] AS phase, list_filter(t, lambda k: k IN {SHEET_METALS})[-1] AS metal, {_VOL} AS vol
  FROM tk JOIN sheet USING (row_id) WHERE list_contains(t, 'x') AND NOT regexp_matches(tk.s, '^\\d')) WHERE phase IS NOT NULL AND metal IS NOT NULL AND (vol IS NULL OR (vol > 0 AND vol < 100)))"""


@query("c13_placeholder_volume", f"WITH {_SHEET_TEXT}, {_PH} SELECT row_id, phase, metal, round(w, 6) + 0e0 AS binder_wt_pct, w IS NULL AS has_unknown FROM ph")
def c13(spark, sf):
    s = B.view(spark, sf, "sheet", heavy=True).filter(F.array_contains(C.tokens("composition"), "x") & ~F.col("composition").rlike(r"^\d"))
    return s.select("row_id", pinned(C.placeholder_with_volume("composition", F.col("binder_vol").try_cast("double"))).alias("p")).filter("p IS NOT NULL").select(
        "row_id", F.map_keys("p.ceramic")[0].alias("phase"), F.map_keys("p.binder")[0].alias("metal"),
        r6("p.binder_wt_pct").alias("binder_wt_pct"), "p.has_unknown")


def _m(c):
    return f"TRY_CAST(nullif(trim(replace({c}, ',', '')), '-') AS DOUBLE)"


_BULK = f"""{_ITEMS}, {_KNOWN}, {_PH},
alltypes AS (SELECT row_id, wt FROM imp UNION ALL SELECT row_id, w FROM kn WHERE w > 0 AND w < 100 UNION ALL SELECT row_id, w FROM ph)"""


@query("c14_bulk_sheet_parse", f"""WITH {_BULK} SELECT row_id, round(wt, 6) + 0e0 AS binder_wt_pct, round(100 - wt, 6) + 0e0 AS ceramic_wt_pct,
 CASE WHEN isnan({_m('hv_text')}) THEN NULL ELSE {_m('hv_text')} END AS hv, {_m('kic_text')} AS kic, {_m('trs_text')} AS trs, {_m('temp_text')} AS sinter_temp_c, {_m('grain')} AS grain_size_um
FROM alltypes JOIN sheet USING (row_id)""")
def c14(spark, sf):
    return P.parse_sheet(B.view(spark, sf, "sheet", heavy=True)).select(
        "row_id", r6("binder_wt_pct").alias("binder_wt_pct"), r6("ceramic_wt_pct").alias("ceramic_wt_pct"),
        "hv", "kic", "trs", "sinter_temp_c", "grain_size_um")


_DIRECT = "CASE WHEN row_id % 5 < 2 THEN {} END"


@query("c15_source_priority", f"""WITH {_BULK} SELECT row_id, CASE WHEN row_id % 5 < 2 THEN 'NbC' END AS direct_ceramic,
 CASE WHEN row_id % 5 = 0 THEN 80e0 WHEN row_id % 5 = 1 THEN 90e0 ELSE round(greatest(0, least(100, 100 - wt)), 6) + 0e0 END AS ceramic_wt_pct,
 CASE WHEN row_id % 5 < 2 THEN 10e0 ELSE round(greatest(0, least(100, wt)), 6) + 0e0 END AS binder_wt_pct
FROM sheet LEFT JOIN alltypes USING (row_id) LEFT JOIN (SELECT row_id, nc FROM imp) USING (row_id)
WHERE row_id % 5 < 2 OR (wt IS NOT NULL AND coalesce(nc, 1) > 0)""")
def c15(spark, sf):
    s = B.view(spark, sf, "sheet", heavy=True).withColumns({
        "cer": F.expr(_DIRECT.format("' NbC '")), "cer_wt": F.expr("CASE WHEN row_id % 5 = 0 THEN 80D END"),
        "bind": F.expr(_DIRECT.format("'Co4Ni'")), "bind_wt": F.lit(None).cast("double"),
        "p": pinned(C.sheet_parse("composition", F.col("binder_vol").try_cast("double"))),
    })
    out = s.select("row_id", pinned(P.prioritized("cer", "cer_wt", "bind", "bind_wt", "p")).alias("r")).filter("r IS NOT NULL")
    return out.select(
        "row_id", F.when(F.col("row_id") % 5 < 2, F.col("r.ceramic_type")).alias("direct_ceramic"),
        r6("r.ceramic_wt_pct").alias("ceramic_wt_pct"), r6("r.binder_wt_pct").alias("binder_wt_pct"))


_CENT1 = "CAST(round_even(c * 100 * 10, 0) AS BIGINT)"
_SHORT1 = f"concat(CAST({_CENT1} // 10 AS VARCHAR), CASE WHEN {_CENT1} % 10 = 0 THEN '' ELSE concat('.', CAST({_CENT1} % 10 AS VARCHAR)) END)"


@query("c16_standard_strings", f"""WITH {ALLOYS}, {SH}, a AS ({formula_text('sh', 'alloy_id', '')}), b AS ({formula_text('sh', 'alloy_id', '1', 3)}),
r AS (SELECT alloy_id, string_agg(concat(el, {_SHORT1}), '' ORDER BY c DESC, el) AS ranked FROM sh WHERE c * 100 > 1e-1 GROUP BY alloy_id)
SELECT alloy_id, a.formula AS plain, b.formula AS with_one, ranked FROM a JOIN b USING (alloy_id) JOIN r USING (alloy_id)""")
def c16(spark, sf):
    a = _alloys(spark, sf).withColumn("m", C.formula_shares("formula"))
    m = F.col("m")
    return a.select("alloy_id", C.standard_text(m).alias("plain"), C.standard_text(m, 3, "1").alias("with_one"), C.ranked_text(m).alias("ranked"))


@query("c17_normalized_formula", f"WITH {ALLOYS}, {B.shares_sql('sh', 'alloys', 'alloy_id', 'formula', K.BINDER_METALS)} {formula_text('sh', 'alloy_id', '1')}")
def c17(spark, sf):
    return _alloys(spark, sf).select("alloy_id", C.standard_text(C.binder_shares("formula"), one="1").alias("formula"))


@query("c18_mass_atomic", f"""WITH {ALLOYS}, {B.ELEMENTS_SQL}, {SH}, w AS (SELECT alloy_id, el, c / mass AS n, c * mass AS g FROM sh JOIN elements ON symbol = el)
SELECT alloy_id, el, round(n / sum(n) OVER (PARTITION BY alloy_id), 6) + 0e0 AS atomic, round(g / sum(g) OVER (PARTITION BY alloy_id), 6) + 0e0 AS mass FROM w""")
def c18(spark, sf):
    a = _alloys(spark, sf).withColumn("m", C.formula_amounts("formula"))
    pair = F.map_zip_with(C.to_atomic(F.col("m")), C.to_mass(F.col("m")), lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))
    return a.select("alloy_id", F.explode(pair).alias("el", "v")).select("alloy_id", "el", r6("v.x").alias("atomic"), r6("v.y").alias("mass"))


@query("c19_element_columns", f"""WITH {ALLOYS}, {SH} SELECT alloy_id, """ + ", ".join(
    f"round(coalesce(sum(CASE WHEN el = '{e}' THEN c END), 0), 6) + 0e0 AS x_{e}" for e in ("Co", "Ni", "Fe", "Cr", "Mo")) + " FROM sh GROUP BY alloy_id")
def c19(spark, sf):
    a = _alloys(spark, sf).withColumn("m", C.formula_shares("formula"))
    wide = P.element_columns(a, "m", ("Co", "Ni", "Fe", "Cr", "Mo"), "x_")
    return wide.select("alloy_id", *[r6(c).alias(c) for c in wide.columns if c.startswith("x_")])


@query("c20_rebuild_text", f"""WITH {ALLOYS} SELECT alloy_id, CASE WHEN binder_pct * 3 > 0 AND binder_pct * 3 < 100
 THEN concat(CAST(CAST(100 - binder_pct * 3 AS BIGINT) AS VARCHAR), '% ', ceramic, ' ', CAST(CAST(binder_pct * 3 AS BIGINT) AS VARCHAR), '% ', formula) END AS text FROM alloys""")
def c20(spark, sf):
    a = _alloys(spark, sf).withColumn("b", F.col("binder_pct") * 3)
    return a.select("alloy_id", P.rebuilt_text(100 - F.col("b"), "ceramic", "b", "formula").alias("text"))


_HITS = " + ".join(f"CAST(contains(upper(raw_composition), '{s.upper()}') AS INT)" for s in K.HEA_SYMBOLS)


@query("c21_hea_by_name", f"WITH {B.sql('experiments')} SELECT exp_id, coalesce({_HITS} >= 5, false) AS is_hea FROM experiments")
def c21(spark, sf):
    return _experiments(spark, sf).select("exp_id", C.hea_by_name("raw_composition").alias("is_hea"))


@query("c22_hea_strict", f"WITH {parsed()} SELECT exp_id, count(*) >= 5 AND min(c) >= 5e-2 AND max(c) <= 35e-2 AS is_hea FROM binder GROUP BY exp_id")
def c22(spark, sf):
    p = _experiments(spark, sf).select("exp_id", pinned(C.parse_cascade("raw_composition")).alias("p")).filter("p IS NOT NULL")
    return p.select("exp_id", C.hea_strict(F.col("p.binder")).alias("is_hea"))


@query("c23_element_count", f"""WITH {ALLOYS}, {SH}, r AS (SELECT alloy_id, count(CASE WHEN c > 1e-2 THEN 1 END) AS real_count FROM sh GROUP BY alloy_id)
SELECT alloy_id, CAST(len(regexp_extract_all(formula, '[A-Z][a-z]?')) AS BIGINT) AS symbols, real_count FROM alloys JOIN r USING (alloy_id)""")
def c23(spark, sf):
    a = _alloys(spark, sf).withColumn("m", C.formula_shares("formula"))
    return a.select("alloy_id", P.symbol_count("formula").cast("bigint").alias("symbols"), P.real_element_count("m").cast("bigint").alias("real_count"))


@query("c24_main_phase", f"WITH {ALLOYS} SELECT alloy_id, ceramic AS main_phase FROM alloys")
def c24(spark, sf):
    a = _alloys(spark, sf).withColumn("mix", F.concat(F.lit(" "), "ceramic", F.lit(" , TaC")))
    return a.select("alloy_id", C.main_phase("mix").alias("main_phase"))


@query("c25_known_elements", f"""WITH {B.sql('experiments')}, {B.shares_sql('sh', 'experiments', 'exp_id', 'raw_composition', list(K.ELEMENTS))}
SELECT exp_id, el, round(c, 6) + 0e0 AS share FROM sh""")
def c25(spark, sf):
    return _experiments(spark, sf).select("exp_id", F.explode(C.known_shares("raw_composition")).alias("el", "share")).withColumn("share", r6("share"))


@query("c26_parse_coverage", f"""WITH {parsed()}, n AS (SELECT count(*) AS n FROM experiments), k AS (SELECT count(*) AS k FROM chosen)
SELECT n AS n_rows, k AS parsed, n - k AS failed, round(k / n * 100, 6) + 0e0 AS retention_pct FROM n, k""")
def c26(spark, sf):
    return P.coverage(P.parse_compositions(_experiments(spark, sf))).withColumn("retention_pct", r6("retention_pct"))


@query("c26_failure_sample", f"WITH {parsed()} SELECT exp_id, raw_composition FROM experiments WHERE exp_id NOT IN (SELECT exp_id FROM chosen) ORDER BY exp_id LIMIT 10")
def c26b(spark, sf):
    return P.failure_sample(P.parse_compositions(_experiments(spark, sf)), "exp_id", "raw_composition")


@query("c27_clean_sheet", f"""WITH {_BULK} SELECT row_id, round(wt, 6) + 0e0 AS binder_wt_pct, {_m('hv_text')} AS hv, coalesce({_m('temp_text')}, 14e2) AS sinter_temp_c,
 coalesce({_m('grain')}, 1e0) AS grain_size_um, CASE WHEN trim(method) = 'NA' THEN NULL ELSE trim(method) END AS method
FROM alltypes JOIN sheet USING (row_id) WHERE NOT isnan({_m('hv_text')})""")
def c27(spark, sf):
    return P.clean_sheet(B.view(spark, sf, "sheet", heavy=True)).select(
        "row_id", r6("binder_wt_pct").alias("binder_wt_pct"), "hv", "sinter_temp_c", "grain_size_um", "method")
