"""Registered queries: joins, set operations, storage-level queries."""

from pyspark.sql import functions as F

from cermetry.functions import physics as P
from cermetry.functions.common import r6
from cermetry.operators import parsing
from cermetry.operators import relational as R
from cermetry.plans import bridge as B
from cermetry.plans.parsed_sql import formula_text, parsed
from cermetry.plans.physics import INJECT, rd
from cermetry.plans.registry import query
from cermetry.session import cut_lineage, shared_dir
from cermetry.sources import dims, versions

STAR = f"""{parsed('properties', 'proxies')}, {B.METAL_DENSITY_SQL}, {B.COMPOUNDS_SQL}, {B.INTERFACE_SQL}, ft AS ({formula_text()}),
bs AS (SELECT exp_id, count(*) AS n, min(c) AS lo, max(c) AS hi, sum(c * e.mass) / sum(c * e.mass / coalesce(md.rho, 8)) AS rho_b,
  CASE WHEN count(*) = count(e.vec) THEN sum(c * e.vec) END AS vec_binder, sum(c * e.r) AS mean_atomic_radius, sum(c * e.mass) AS mean_atomic_mass, sum(c * e.chi) AS xb
  FROM binder LEFT JOIN elements e ON e.symbol = el LEFT JOIN metal_density md ON md.symbol = el GROUP BY exp_id),
bx AS (SELECT exp_id, sqrt(sum(c * pow(e.chi - xb, 2))) AS std_chi FROM binder JOIN elements e ON e.symbol = el JOIN bs USING (exp_id) GROUP BY exp_id),
compositions AS (SELECT exp_id, ft.formula AS binder_formula, CAST(wt AS DOUBLE) AS binder_wt_pct, (wt / rho_b) / (wt / rho_b + (100 - wt) / coalesce(k.density, 15)) * 100 AS binder_vol_pct,
  phase AS ceramic_formula, secondary AS secondary_phase, CAST(100 - wt AS DOUBLE) AS ceramic_wt_pct, n >= 5 AND lo >= 5e-2 AND hi <= 35e-2 AS is_hea, n AS element_count
  FROM chosen JOIN ft USING (exp_id) JOIN bs USING (exp_id) LEFT JOIN compounds k ON k.formula = phase),
features AS (SELECT exp_id, vec_binder, mean_atomic_radius, rho_b AS binder_density, mean_atomic_mass, std_chi AS std_electronegativity, pred_formation_energy, pred_lattice_param, pred_magnetic_moment,
  abs(pred_lattice_param / sqrt(2e0) - coalesce(f.neighbor, 2906e-3)) / coalesce(f.neighbor, 2906e-3) AS lattice_mismatch,
  CASE exp_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_full
  FROM chosen JOIN bs USING (exp_id) JOIN bx USING (exp_id) JOIN proxies USING (exp_id) LEFT JOIN interface f ON f.phase = coalesce(chosen.phase, 'WC') WHERE exp_id % 5 <> 0)"""


def star(spark, sf, key=None):
    """The four stored tables; every fifth experiment has no features yet.  With
    ``key`` only that experiment, filtered at the scans, ahead of the parse."""
    view = lambda name, heavy=False: B.view(spark, sf, name, heavy=heavy and key is None).where("true" if key is None else f"exp_id = {int(key)}")
    e = view("experiments", heavy=True)
    comps = parsing.composition_columns(e.select("exp_id", "raw_composition"))
    feats = R.feature_columns(comps.where("exp_id % 5 <> 0"), view("proxies").drop("pred_bulk_modulus", "pred_shear_modulus"))
    feats = feats.withColumn("has_full", F.expr("CASE exp_id % 3 WHEN 0 THEN true WHEN 1 THEN false END"))
    return {"experiments": e, "compositions": comps.drop("binder", "format"), "properties": view("properties"), "features": feats}


_STORED = {}


def stored_star(spark, sf):
    """The star in buckets by experiment, with the surrogate moduli as a fifth table.

    Parsed and stored once per session and folder.  One pass over the parsed rows makes the
    compositions and what features need of them; these meet the surrogates bucket by bucket.
    """
    known = _STORED.get(sf)
    if known is None or known[0] is not spark:
        e = B.view(spark, sf, "experiments", heavy=True)
        buckets = max(16, 2 * spark.sparkContext.defaultParallelism)
        parsed, _ = parsing.split_parsed(e.select("exp_id", "raw_composition"))
        parsed = cut_lineage(parsed.withColumn("parsed", F.col("parsed").dropFields("ceramic", "needs_volume")), "parsed")
        both = R.binder_features(parsing.composition_record(parsed, keep=("rows", "rho_b")).drop("binder", "format"))
        # the shuffle into buckets spreads the experiments
        tables = R.store_star({"experiments": B.view(spark, sf, "experiments"), "compositions": both, "properties": B.view(spark, sf, "properties"),
                               "moduli": B.view(spark, sf, "proxies").select("exp_id", "pred_bulk_modulus", "pred_shear_modulus")}, spark, buckets)
        both, proxies = tables["compositions"], B.view(spark, sf, "proxies").drop("pred_bulk_modulus", "pred_shear_modulus")
        feats = R.feature_columns(both.where("exp_id % 5 <> 0"), proxies.repartition(buckets, "exp_id"))
        feats = feats.withColumn("has_full", F.expr("CASE exp_id % 3 WHEN 0 THEN true WHEN 1 THEN false END"))
        tables |= R.store_star({"features": feats}, spark, buckets, ("features",))
        known = _STORED[sf] = (spark, tables | {"compositions": both.drop(*R.BINDER_FEATURES)})
    return dict(known[1])


def _rounded(df, rounded, *plain):
    return df.select(*plain, *[r6(c).alias(c) for c in rounded])


@query("e1_training_data", f"""WITH {STAR}, t AS (SELECT exp_id, hv, grain_size_um, sinter_temp_c, vec_binder FROM experiments JOIN compositions USING (exp_id) JOIN properties USING (exp_id) LEFT JOIN features USING (exp_id) WHERE hv IS NOT NULL),
m AS (SELECT quantile_cont(grain_size_um, 5e-1) AS g, quantile_cont(sinter_temp_c, 5e-1) AS s, quantile_cont(vec_binder, 5e-1) AS v FROM t)
SELECT exp_id, {rd('hv', 'hv')}, coalesce(grain_size_um, g) AS grain_size_um, coalesce(sinter_temp_c, s) AS sinter_temp_c, {rd('coalesce(vec_binder, v)', 'vec_binder')} FROM t, m""")
def e1(spark, sf):
    t = R.training_data(stored_star(spark, sf), "hv", ["grain_size_um", "sinter_temp_c", "vec_binder"])
    return _rounded(t, ["hv", "vec_binder"], "exp_id", "grain_size_um", "sinter_temp_c")


_E2 = ["hv", "binder_vol_pct", "vec_binder", "mean_atomic_radius", "binder_density", "mean_atomic_mass", "std_electronegativity", "lattice_mismatch", "pred_formation_energy",
       "pred_lattice_param", "pred_magnetic_moment", "pred_bulk_modulus", "pred_shear_modulus", "ceramic_vol_pct", "young_modulus"]
_E2P = ["exp_id", "source_id", "raw_composition", "sinter_temp_c", "grain_size_um", "sinter_method", "load_kgf", "binder_formula", "binder_wt_pct",
        "ceramic_formula", "secondary_phase", "ceramic_wt_pct", "is_hea", "element_count", "kic", "trs", "has_full",
        "hardness_grade", "toughness_grade", "has_features", "created_at"]


@query("e2_full_export", f"""WITH {STAR}, j AS (SELECT experiments.*, compositions.* EXCLUDE (exp_id), hv, kic, trs, features.* EXCLUDE (exp_id, pred_formation_energy),
  CASE WHEN features.exp_id IS NOT NULL THEN features.pred_formation_energy END AS pred_formation_energy,
  p.pred_bulk_modulus, p.pred_shear_modulus, 100 - binder_vol_pct AS ceramic_vol_pct, 9 * p.pred_bulk_modulus * p.pred_shear_modulus / (3 * p.pred_bulk_modulus + p.pred_shear_modulus) AS young_modulus,
  CASE WHEN hv IS NULL THEN 'Unknown' WHEN hv < 800 THEN 'Low' WHEN hv < 1200 THEN 'Medium' WHEN hv < 1600 THEN 'High' ELSE 'Very High' END AS hardness_grade,
  CASE WHEN kic IS NULL THEN 'Unknown' WHEN kic < 10 THEN 'Low' WHEN kic < 15 THEN 'Medium' WHEN kic < 20 THEN 'High' ELSE 'Very High' END AS toughness_grade,
  features.exp_id IS NOT NULL AS has_features
FROM experiments JOIN compositions ON compositions.exp_id = experiments.exp_id JOIN properties ON properties.exp_id = experiments.exp_id
LEFT JOIN features ON features.exp_id = experiments.exp_id LEFT JOIN proxies p ON p.exp_id = experiments.exp_id)
SELECT {', '.join(_E2P)}, {', '.join(rd(c, c, 8) for c in _E2)} FROM j""")
def e2(spark, sf):
    s = stored_star(spark, sf)
    return R.full_export(s, s.pop("moduli")).select(*_E2P, *[r6(c, 8).alias(c) for c in _E2])


@query("e3_query_tab", f"""WITH {STAR} SELECT exp_id, raw_composition, binder_formula, {rd('hv', 'hv')}, {rd('vec_binder', 'vec_binder')} FROM experiments LEFT JOIN compositions USING (exp_id) LEFT JOIN properties USING (exp_id) LEFT JOIN features USING (exp_id)
WHERE is_hea = true AND raw_composition ILIKE '%ni%' ORDER BY exp_id LIMIT 200""")
def e3(spark, sf):
    t = R.query_tab(stored_star(spark, sf), {"is_hea": True}, {"raw_composition": "ni"}, 200)
    return _rounded(t, ["hv", "vec_binder"], "exp_id", "raw_composition", "binder_formula")


@query("e4_without_features", f"WITH {STAR} SELECT exp_id, raw_composition FROM experiments WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.exp_id = experiments.exp_id)")
def e4(spark, sf):
    s = star(spark, sf)
    return R.without_features(s["experiments"], s["features"]).select("exp_id", "raw_composition")


@query("e5_null_or_false", f"WITH {STAR} SELECT count(CASE WHEN coalesce(has_full, false) = false THEN 1 END) AS pending, count(CASE WHEN has_full = false THEN 1 END) AS only_false FROM features")
def e5(spark, sf):
    return star(spark, sf)["features"].agg(
        F.count_if(R.not_flagged("has_full")).alias("pending"), F.count_if(F.col("has_full") == F.lit(False)).alias("only_false"))


@query("e6_work_list", f"""WITH {STAR} SELECT exp_id FROM experiments WHERE exp_id NOT IN (SELECT exp_id FROM features) OR exp_id IN (SELECT exp_id FROM features WHERE coalesce(has_full, false) = false)""")
def e6(spark, sf):
    s = star(spark, sf)
    return R.work_list(s["experiments"], s["features"], "has_full").select("exp_id")


_PAGE = "FROM experiments LEFT JOIN properties USING (exp_id) LEFT JOIN compositions USING (exp_id) WHERE is_hea = false AND hv >= 800 AND hv <= 2500 AND kic >= 6 AND raw_composition ILIKE '%co%'"
_PAGE_ARGS = dict(binder_type="Traditional", hv=(800, 2500), kic=(6, None), keyword="co")


@query("e7_page_rows", f"""WITH {STAR} SELECT exp_id AS id, coalesce(substring(raw_composition, 1, 60), '') AS composition, coalesce(ceramic_formula, '') AS ceramic, coalesce(binder_formula, '') AS binder,
 CASE WHEN is_hea THEN 'Yes' ELSE 'No' END AS hea, {rd('hv', 'hv')}, kic, trs, sinter_temp_c, grain_size_um, source_id {_PAGE} ORDER BY exp_id LIMIT 50 OFFSET 100""")
def e7(spark, sf):
    rows, _ = R.page(stored_star(spark, sf), 3, 50, **_PAGE_ARGS)
    return rows.withColumn("hv", r6("hv"))


@query("e7_page_total", f"WITH {STAR} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 5e1) AS BIGINT)) AS pages {_PAGE}")
def e7b(spark, sf):
    return R.page(stored_star(spark, sf), 3, 50, **_PAGE_ARGS)[1]


@query("e9_nested_record", f"""WITH {STAR} SELECT exp_id, source_id, binder_formula, {rd('hv', 'hv')}, {rd('vec_binder', 'vec_binder')}
FROM experiments LEFT JOIN compositions USING (exp_id) LEFT JOIN properties USING (exp_id) LEFT JOIN features USING (exp_id) WHERE exp_id = 1006""")
def e9(spark, sf):
    return R.record(star(spark, sf, 1006), 1006).select(
        "exp_id", "experiment.source_id", "compositions.binder_formula", r6("properties.hv").alias("hv"), r6("features.vec_binder").alias("vec_binder"))


@query("e9_stored_record", f"""WITH {STAR} SELECT exp_id, raw_composition, binder_formula, {rd('hv', 'hv')}, {rd('vec_binder', 'vec_binder')}
FROM experiments LEFT JOIN compositions USING (exp_id) LEFT JOIN properties USING (exp_id) LEFT JOIN features USING (exp_id) WHERE exp_id IN (SELECT max(exp_id) FROM compositions)""")
def e9b(spark, sf):
    """The record of the last parsed experiment, from one bucket of each table."""
    s = stored_star(spark, sf)
    key = s["compositions"].agg(F.max("exp_id")).first()[0]
    return R.record(s, key).select("exp_id", "experiment.raw_composition", "compositions.binder_formula", r6("properties.hv").alias("hv"), r6("features.vec_binder").alias("vec_binder"))


@query("e10_summary_counts", f"WITH {STAR} SELECT count(*) AS total, count(CASE WHEN is_hea THEN 1 END) AS hea, count(CASE WHEN is_hea = false THEN 1 END) AS traditional FROM compositions")
def e10(spark, sf):
    return R.summary_counts(star(spark, sf)["compositions"])


@query("e11_field_completeness", f"""WITH {B.sql('properties')}, n AS (SELECT count(*) AS n, count(hv) AS hv, count(kic) AS kic, count(trs) AS trs FROM properties)
SELECT 'hv' AS field, hv AS non_null, {rd('hv / n * 100', 'pct', 4)} FROM n UNION ALL SELECT 'kic', kic, {rd('kic / n * 100', 'pct', 4)} FROM n UNION ALL SELECT 'trs', trs, {rd('trs / n * 100', 'pct', 4)} FROM n""")
def e11(spark, sf):
    p = B.view(spark, sf, "properties")
    wide = p.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("hv", "kic", "trs")])
    return wide.unpivot("n", ["hv", "kic", "trs"], "field", "non_null").select("field", "non_null", r6(F.col("non_null") / F.col("n") * 100, 4).alias("pct"))


@query("e12_intake", f"""WITH {STAR} SELECT 'experiments' AS tab, count(*) AS n, CAST(NULL AS DOUBLE) AS mean FROM experiments JOIN chosen USING (exp_id)
UNION ALL SELECT 'compositions', count(*), {rd('avg(binder_vol_pct)', 'm')} FROM compositions UNION ALL SELECT 'properties', count(*), {rd('avg(hv)', 'm')} FROM properties JOIN chosen USING (exp_id)
UNION ALL SELECT 'features', count(*), {rd('avg(vec_binder)', 'm')} FROM bs UNION ALL SELECT 'rejected', count(*), NULL FROM experiments WHERE exp_id NOT IN (SELECT exp_id FROM chosen)""")
def e12(spark, sf):
    out = R.intake(B.view(spark, sf, "experiments"), B.view(spark, sf, "properties"), B.view(spark, sf, "proxies"))
    means = {"compositions": "binder_vol_pct", "properties": "hv", "features": "vec_binder"}
    parts = [t.agg(F.lit(n).alias("tab"), F.count(F.lit(1)).alias("n"),
                   (r6(F.avg(means[n])) if n in means else F.lit(None).cast("double")).alias("mean")) for n, t in out.items()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


_GRADES = """CASE WHEN hv IS NULL THEN 'Unknown' WHEN hv < 800 THEN 'Low' WHEN hv < 1200 THEN 'Medium' WHEN hv < 1600 THEN 'High' ELSE 'Very High' END AS hardness_grade,
  CASE WHEN kic IS NULL THEN 'Unknown' WHEN kic < 10 THEN 'Low' WHEN kic < 15 THEN 'Medium' WHEN kic < 20 THEN 'High' ELSE 'Very High' END AS toughness_grade"""


@query("e12_stored_intake", f"""WITH {STAR} SELECT exp_id, raw_composition, binder_formula, {rd('binder_vol_pct', 'binder_vol_pct')}, {rd('100 - binder_vol_pct', 'ceramic_vol_pct')}, is_hea, {rd('hv', 'hv')}, kic, {_GRADES},
  {rd('bs.vec_binder', 'vec_binder')}, CASE WHEN exp_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch
FROM experiments JOIN compositions USING (exp_id) JOIN properties USING (exp_id) JOIN bs USING (exp_id)""")
def e12b(spark, sf):
    """Two batches stored in one commit each, the first replayed without effect, then read back and joined."""
    root = shared_dir(spark, "intake")
    views = [B.view(spark, sf, n) for n in ("experiments", "properties", "proxies")]
    for batch, part in (("even", "exp_id % 2 = 0"), ("odd", "exp_id % 2 = 1"), ("even", "exp_id % 2 = 0")):
        R.store_intake(spark, root, batch, views[0].where(part).withColumn("batch", F.lit(batch)), *[v.where(part) for v in views[1:]])
    t = {n: versions.read(spark, root, n) for n in ("experiments", "compositions", "properties", "features")}
    j = t["experiments"].join(t["compositions"], "exp_id").join(t["properties"], "exp_id").join(t["features"], "exp_id")
    return _rounded(j, ["binder_vol_pct", "ceramic_vol_pct", "hv", "vec_binder"], "exp_id", "raw_composition", "binder_formula", "is_hea", "kic", "hardness_grade", "toughness_grade", "batch")


@query("e13_stored_upsert", f"""WITH {B.sql('properties')}, n AS (SELECT exp_id + 100000000 * (exp_id % 2) AS exp_id, CASE WHEN exp_id % 3 > 0 THEN 1e3 END AS hv, 7e0 AS kic FROM properties),
m AS (SELECT exp_id, 5e0 AS kic FROM properties WHERE exp_id % 7 = 0)
SELECT exp_id, {rd('coalesce(n.hv, o.hv)', 'hv')}, coalesce(m.kic, n.kic, o.kic) AS kic, o.trs FROM properties o FULL JOIN n USING (exp_id) LEFT JOIN m USING (exp_id)""")
def e13b(spark, sf):
    """Stored properties, two upserts (one replayed), read merged."""
    p = B.view(spark, sf, "properties")
    root = shared_dir(spark, "properties")
    new = p.selectExpr("exp_id + 100000000 * (exp_id % 2) AS exp_id", "CASE WHEN exp_id % 3 > 0 THEN 1000D END AS hv", "7D AS kic")
    fix = p.where("exp_id % 7 = 0").selectExpr("exp_id", "5D AS kic")
    versions.commit(spark, root, "base", {"properties": p})
    for batch, rows in (("new", new), ("fix", fix), ("new", new)):
        versions.commit(spark, root, batch, {"properties": rows}, mode="upsert")
    return versions.read(spark, root, "properties", "exp_id").withColumn("hv", r6("hv"))


@query("e13_upsert", f"""WITH {B.sql('properties')}, n AS (SELECT exp_id + 100000000 * (exp_id % 2) AS exp_id, CASE WHEN exp_id % 3 > 0 THEN 1e3 END AS hv, 7e0 AS kic FROM properties)
SELECT exp_id, {rd('coalesce(n.hv, o.hv)', 'hv')}, coalesce(n.kic, o.kic) AS kic, o.trs FROM properties o FULL JOIN n USING (exp_id)""")
def e13(spark, sf):
    p = B.view(spark, sf, "properties")
    new = p.selectExpr("exp_id + 100000000 * (exp_id % 2) AS exp_id", "CASE WHEN exp_id % 3 > 0 THEN 1000D END AS hv", "7D AS kic")
    return R.upsert(p, new, "exp_id").withColumn("hv", r6("hv"))


@query("e14_positional_concat", f"WITH {B.sql('sheet', 'properties')} SELECT row_id, composition, kic FROM sheet JOIN properties ON row_id = exp_id")
def e14(spark, sf):
    left = B.view(spark, sf, "sheet").select("row_id", "composition")
    return left.join(B.view(spark, sf, "properties").select(F.col("exp_id").alias("row_id"), "kic"), "row_id")


@query("e15_union_by_name", f"""WITH {B.sql('alloys', 'experiments')} SELECT alloy_id AS id, formula, grain_size_um, CAST(NULL AS VARCHAR) AS source_id FROM alloys
UNION ALL SELECT exp_id, raw_composition, grain_size_um, source_id FROM experiments""")
def e15(spark, sf):
    a = B.view(spark, sf, "alloys").selectExpr("alloy_id AS id", "formula", "grain_size_um")
    e = B.view(spark, sf, "experiments").selectExpr("exp_id AS id", "raw_composition AS formula", "grain_size_um", "source_id")
    return a.unionByName(e, allowMissingColumns=True)


@query("e16_enrich_library", f"""WITH {B.sql('library', 'alloys')} SELECT entry_id, energy, bulk, shear FROM library l LEFT JOIN (SELECT alloy_id, bulk, shear FROM alloys WHERE bulk IS NOT NULL) ON alloy_id = entry_id""")
def e16(spark, sf):
    elastic = B.view(spark, sf, "alloys").where("bulk IS NOT NULL").selectExpr("alloy_id AS entry_id", "bulk", "shear")
    return B.view(spark, sf, "library").select("entry_id", "energy").join(elastic, "entry_id", "left")


_LIB = (INJECT.replace(B.sql("runs"), B.sql("alloys").replace("alloys AS (", "runs AS (", 1)))


@query("e17_library_columns", f"""WITH {_LIB} SELECT r.alloy_id, {rd('mn.vec', 'vec')}, {rd('delta', 'delta')}, {rd('dchi', 'delta_chi')}, {rd('h', 'h_mix')}, {rd('s_r * 8314e-3', 's_mix')},
 {rd('CASE WHEN abs(h) >= 1e-4 THEN tm * s_r * 8314e-3 / (abs(h) * 1000) END', 'omega')}, {rd('CASE WHEN bulk > 0 AND shear <> 0 THEN greatest(0e0, 2 * pow((shear / bulk) * (shear / bulk) * shear, 585e-3) - 3) END', 'hv_chen')},
 {rd('CASE WHEN bulk > 0 AND shear <> 0 THEN 92e-2 * pow(shear / bulk, 1137e-3) * pow(shear, 708e-3) END', 'hv_tian')}
FROM runs r JOIN mn ON mn.alloy_id = formula JOIN sp ON sp.alloy_id = formula JOIN hm ON hm.alloy_id = formula""")
def e17(spark, sf):
    r = F.col("rows")
    a = B.view(spark, sf, "alloys").withColumn("rows", P.formula_rows("formula"))
    a = a.withColumns({"h": P.enthalpy(r), "s": P.entropy(r), "tm": P.weighted(r, "tm")})
    cols = {"vec": P.vec(r), "delta": P.size_mismatch(r), "delta_chi": P.chi_spread(r), "h_mix": F.col("h"), "s_mix": F.col("s"),
            "omega": P.omega(F.col("tm"), F.col("s"), F.col("h")), "hv_chen": P.chen_hardness("bulk", "shear"), "hv_tian": P.tian_hardness("bulk", "shear")}
    return a.select("alloy_id", *[r6(v).alias(k) for k, v in cols.items()])


_PARTNERS = ("C", "N", "B", "Si")


@query("e18_target_systems", f"""WITH {B.sql('alloys')}, m AS (SELECT DISTINCT unnest(regexp_extract_all(formula, '[A-Z][a-z]?')) AS m FROM alloys),
p(p) AS (VALUES {', '.join(f"('{p}')" for p in _PARTNERS)}) SELECT m AS system FROM m UNION ALL SELECT concat(least(m, p), '-', greatest(m, p)) FROM m, p""")
def e18(spark, sf):
    metals = B.view(spark, sf, "alloys").select(
        F.explode(F.regexp_extract_all("formula", F.lit("[A-Z][a-z]?"), F.lit(0))).alias("metal")).distinct()
    return R.target_systems(metals, _PARTNERS)


@query("e19_lowest_energy", f"""WITH {B.sql('library')} SELECT formula, entry_id, energy, min(density) AS density FROM (
 SELECT *, rank() OVER (PARTITION BY formula ORDER BY energy NULLS LAST, entry_id) AS rn FROM library) WHERE rn = 1 GROUP BY ALL""")
def e19(spark, sf):
    return R.lowest_energy(B.view(spark, sf, "library"))


@query("e20_hull_density", f"""WITH {B.sql('library')} SELECT formula, min(density) AS density FROM (
 SELECT *, rank() OVER (PARTITION BY formula ORDER BY coalesce(e_hull, 'inf'::DOUBLE)) AS rn FROM library) WHERE rn = 1 GROUP BY formula""")
def e20(spark, sf):
    return R.hull_density(B.view(spark, sf, "library"))


@query("e21_library_counts", f"WITH {B.sql('library')} SELECT count(*) AS entries, count(DISTINCT formula) AS formulas FROM library")
def e21(spark, sf):
    return B.view(spark, sf, "library").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("formula").alias("formulas"))


@query("e22_extended_record", f"""WITH {B.sql('library')}, b AS (SELECT formula, entry_id, energy, min(density) AS density FROM (
 SELECT *, rank() OVER (PARTITION BY formula ORDER BY energy NULLS LAST, entry_id) AS rn FROM library) WHERE rn = 1 GROUP BY ALL)
SELECT formula, entry_id AS material_id, coalesce(energy, 0e0) AS formation_energy, density, CAST(NULL AS DOUBLE) AS bulk_modulus FROM b""")
def e22(spark, sf):
    best = R.lowest_energy(B.view(spark, sf, "library"))
    best = R.add_missing_columns(best, {"bulk_modulus": "double"})
    return best.select("formula", F.col("entry_id").alias("material_id"), F.coalesce("energy", F.lit(0.0)).alias("formation_energy"), "density", "bulk_modulus")


_SYM = "regexp_extract(formula, '^([A-Z][a-z]?)([A-Z][a-z]?)', {})"


@query("e23_pair_lookup", f"""WITH {B.sql('library')}, {B.ENTHALPY_SQL}, p AS (SELECT DISTINCT {_SYM.format(1)} AS x, {_SYM.format(2)} AS y FROM library)
SELECT x, y, coalesce(h, 0) AS h FROM p LEFT JOIN enthalpy ON a = least(x, y) AND b = greatest(x, y)""")
def e23(spark, sf):
    p = B.view(spark, sf, "library").select(F.expr(_SYM.format(1)).alias("x"), F.expr(_SYM.format(2)).alias("y")).distinct()
    return R.pair_lookup(p, "x", "y", dims.enthalpy(spark))


@query("e24_fallback_lookup", f"""WITH {B.sql('alloys', 'library')}, {B.COMPOUNDS_SQL}, l AS (SELECT formula, min(density) AS density FROM library GROUP BY formula),
k AS (SELECT alloy_id, CASE WHEN alloy_id % 2 = 0 THEN ceramic ELSE concat(substring(formula, 1, 2), 'Ni') END AS name FROM alloys)
SELECT alloy_id, name AS formula, coalesce(c.density, l.density) AS density FROM k LEFT JOIN compounds c ON c.formula = name LEFT JOIN l ON l.formula = name""")
def e24(spark, sf):
    k = B.view(spark, sf, "alloys").select("alloy_id", F.expr("CASE WHEN alloy_id % 2 = 0 THEN ceramic ELSE concat(substring(formula, 1, 2), 'Ni') END").alias("formula"))
    library = B.view(spark, sf, "library").groupBy("formula").agg(F.min("density").alias("density"))
    return R.fallback_lookup(k, "formula", dims.compounds(spark), library, ["density"]).select("alloy_id", "formula", "density")


@query("e25_flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS p_k FROM events")
def e25(spark, sf):
    return R.flatten_json(B.table(spark, sf, "events").select("event_id", "props"), "props", "p_").drop("props")


@query("e26_pack_columns", f"WITH {B.sql('proxies')} SELECT exp_id, {rd('pred_formation_energy', 'energy')}, pred_bulk_modulus AS bulk, 5 AS n FROM proxies")
def e26(spark, sf):
    m = R.pack_columns(B.view(spark, sf, "proxies"), "pred_", "m")
    return m.select("exp_id", r6(F.col("m")["formation_energy"]).alias("energy"), F.col("m")["bulk_modulus"].alias("bulk"), F.size("m").alias("n"))


@query("e28_migration", f"""WITH {B.sql('sheet')}, o AS (SELECT CASE WHEN row_id % 10 = 0 THEN NULL ELSE row_id END AS old_id, composition, hv_text FROM sheet)
SELECT old_id AS exp_id, composition AS raw_composition, CASE WHEN isnan(TRY_CAST(replace(hv_text, ',', '') AS DOUBLE)) THEN NULL ELSE TRY_CAST(replace(hv_text, ',', '') AS DOUBLE) END AS hv FROM o WHERE old_id IS NOT NULL""")
def e28(spark, sf):
    old = B.view(spark, sf, "sheet").selectExpr("CASE WHEN row_id % 10 = 0 THEN NULL ELSE row_id END AS old_id", "composition", "hv_text")
    rows, _ = R.migrate(old, {"exp_id": "old_id", "raw_composition": "composition", "hv": "nullif(try_cast(replace(hv_text, ',', '') AS DOUBLE), double('NaN'))"})
    return rows


@query("e28_migration_counts", "SELECT count(CASE WHEN o_orderkey % 10 <> 0 THEN 1 END) AS migrated, count(CASE WHEN o_orderkey % 10 = 0 THEN 1 END) AS failed FROM orders")
def e28b(spark, sf):
    old = B.view(spark, sf, "sheet").selectExpr("CASE WHEN row_id % 10 = 0 THEN NULL ELSE row_id END AS old_id")
    return R.migrate(old, {"exp_id": "old_id"})[1]


@query("e29_add_columns", f"WITH {B.sql('alloys')} SELECT alloy_id, formula, CAST(NULL AS VARCHAR) AS ceramic_json, CAST(NULL AS BOOLEAN) AS has_full FROM alloys")
def e29(spark, sf):
    return R.add_missing_columns(B.view(spark, sf, "alloys").select("alloy_id", "formula"), {"formula": "string", "ceramic_json": "string", "has_full": "boolean"})


@query("e30_record_age", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-01-31 00:00:00' - INTERVAL 30 DAYS AS fresh FROM orders")
def e30(spark, sf):
    return R.by_age(B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-01-31 00:00:00").drop("o_orderdate")


@query("e32_latest_entries", f"WITH {B.sql('activity')} SELECT log_id, activity, status FROM activity ORDER BY ts DESC, log_id DESC LIMIT 20")
def e32(spark, sf):
    return R.latest(B.view(spark, sf, "activity"), "ts", "log_id").select("log_id", "activity", "status")


@query("e33_subset_test", """SELECT count(*) AS missing, count(*) = 0 AS subset FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""")
def e33(spark, sf):
    small = B.table(spark, sf, "orders").selectExpr("o_custkey AS k")
    return R.is_subset(small, B.table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS k"), "k")


@query("e34_best_per_system", f"""WITH {B.sql('library')}, s AS (SELECT *, array_to_string(list_sort([{_SYM.format(1)}, {_SYM.format(2)}]), '-') AS system FROM library)
SELECT system, entry_id, is_stable, energy FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY is_stable DESC, energy NULLS LAST, entry_id) AS rn FROM s) WHERE rn = 1""")
def e34(spark, sf):
    lib = B.view(spark, sf, "library").withColumn("system", F.concat_ws("-", F.sort_array(F.array(F.expr(_SYM.format(1)), F.expr(_SYM.format(2))))))
    return R.best_per_system(lib, "system")


