"""Registered queries: feature engineering and selection."""

from pyspark.sql import functions as F

from cermetry.functions import physics as P
from cermetry.functions.common import pinned, r6
from cermetry.operators import features as G
from cermetry.operators import ml
from cermetry.operators import physics as O
from cermetry.operators import quality as Q
from cermetry.operators.boosting import Model
from cermetry.plans import bridge as B
from cermetry.plans.physics import BASE, rd, scored
from cermetry.plans.registry import query
from cermetry.session import cut_lineage

PHASE_PROPS = ("mass", "chi", "tm", "number")


def phase_means(spark, sf):
    a = B.view(spark, sf, "alloys", heavy=True).select("alloy_id", "formula", "ceramic", "binder_pct", "grain_size_um")
    # pinned, so that the parsed rows and the means are worked out once each
    a = a.withColumns({"r": pinned(P.formula_rows("formula")), "q": pinned(P.formula_rows("ceramic"))})
    return a.select(
        "alloy_id", "grain_size_um", "binder_pct", (F.col("binder_pct") / 100).alias("binder_vol_frac"), (1 - F.col("binder_pct") / 100).alias("ceramic_vol_frac"),
        *[pinned(P.weighted(F.col("r"), p)).alias(f"binder_mean_{p}") for p in PHASE_PROPS],
        *[pinned(P.weighted(F.col("q"), p)).alias(f"ceramic_mean_{p}") for p in PHASE_PROPS])


_PM = f"""{BASE}, {B.shares_sql('cs', 'alloys', 'alloy_id', 'ceramic')}, bm AS (SELECT alloy_id, {', '.join(f'sum(c * {p}) AS b_{p}' for p in PHASE_PROPS)} FROM j GROUP BY alloy_id),
cm AS (SELECT alloy_id, {', '.join(f'sum(c * {p}) AS c_{p}' for p in PHASE_PROPS)} FROM cs JOIN elements ON symbol = el GROUP BY alloy_id),
pm AS (SELECT *, binder_pct / 1e2 AS f, 1 - binder_pct / 1e2 AS g FROM alloys JOIN bm USING (alloy_id) JOIN cm USING (alloy_id))"""


@query("g1_two_phase_columns", f"""WITH {_PM} SELECT alloy_id, {', '.join(rd(f'c_{p} * g + b_{p} * f', f'composite_mean_{p}') for p in PHASE_PROPS)}, {', '.join(rd(f'abs(c_{p} - b_{p})', f'diff_{p}') for p in PHASE_PROPS)},
 {rd('c_tm / (b_tm + 1e-6)', 'ratio_tm')}, {rd('c_mass / (b_mass + 1e-6)', 'ratio_mass')}, {rd('g * (1 - g) * 4', 'interface_complexity')}, {rd('grain_size_um * f / (1 - f + 1e-6)', 'mean_free_path')} FROM pm""")
def g1(spark, sf):
    d = G.two_phase_columns(phase_means(spark, sf), PHASE_PROPS)
    made = [c for c in d.columns if c.startswith(("composite_", "diff_", "ratio_", "interface", "mean_free"))]
    return d.select("alloy_id", *[r6(c).alias(c) for c in made])


_G2 = " UNION ALL ".join(
    f"SELECT alloy_id, '{p}' AS prop, {rd(f'c_{p} * (100 - binder_pct) / 100 + b_{p} * binder_pct / 100', 'mean')}, {rd(f'abs(c_{p} - b_{p})', 'diff')}, {rd(f'c_{p} / (b_{p} + 1e-6)', 'ratio')}, {rd('(100 - binder_pct) * binder_pct / 1e4', 'complexity')}, {rd('grain_size_um / (binder_pct + 1)', 'path')} FROM pm"
    for p in ("mass", "chi", "number"))


@query("g2_two_phase_maps", f"WITH {_PM} {_G2}")
def g2(spark, sf):
    d = phase_means(spark, sf)
    pack = lambda side, props: F.create_map(*[x for p in props for x in (F.lit(p), F.col(f"{side}_mean_{p}"))])
    d = d.withColumns({"cm": pack("ceramic", ("mass", "chi", "number")), "bm": pack("binder", PHASE_PROPS), "cp": 100 - F.col("binder_pct")})
    d = G.two_phase_maps(d, "cm", "bm", "cp", "binder_pct", "grain_size_um")
    return d.select("alloy_id", "diff", "ratio", "interface_complexity", "mean_free_path", F.explode("mean").alias("prop", "m")).select(
        "alloy_id", "prop", r6("m").alias("mean"), r6(F.col("diff")[F.col("prop")]).alias("diff"), r6(F.col("ratio")[F.col("prop")]).alias("ratio"),
        r6("interface_complexity").alias("complexity"), r6("mean_free_path").alias("path"))


_GC = lambda c: f"TRY_CAST(nullif(nullif(trim({c}), '-'), 'n/a') AS DOUBLE)"


@query("g3_prepare_matrix", f"""WITH {B.sql('sheet')}, c AS (SELECT row_id, {_GC('kic_text')} AS kic_text, {_GC('trs_text')} AS trs_text, {_GC('temp_text')} AS temp_text, {_GC('grain')} AS grain FROM sheet),
k AS (SELECT * FROM c WHERE kic_text IS NOT NULL), m AS (SELECT quantile_cont(trs_text, 5e-1) AS t, quantile_cont(temp_text, 5e-1) AS p, quantile_cont(grain, 5e-1) AS g FROM k)
SELECT row_id, kic_text, coalesce(trs_text, t) AS trs_text, coalesce(temp_text, p) AS temp_text, {rd('coalesce(grain, g)', 'grain')} FROM k, m""")
def g3(spark, sf):
    s = B.view(spark, sf, "sheet").select("row_id", "kic_text", "trs_text", "temp_text", "grain", F.lit("7").alias("flat"))
    return G.prepare_matrix(s, "kic_text", ["trs_text", "temp_text", "grain", "flat"]).withColumn("grain", r6("grain"))


_RK = ("hv", "kic", "trs", "grain_size_um")
_T = f"{B.sql('experiments', 'properties')}, t AS (SELECT * FROM experiments JOIN properties USING (exp_id))"
_RANKS = f"""{_T}, m AS (SELECT {', '.join(f'quantile_cont({c}, 5e-1) AS m_{c}' for c in _RK)} FROM t), fl AS (SELECT exp_id, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in _RK)} FROM t, m),
rk AS (SELECT exp_id, {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}' for c in _RK)} FROM fl)"""


def _table(spark, sf):
    e = B.view(spark, sf, "experiments").select("exp_id", "grain_size_um")
    return e.join(B.view(spark, sf, "properties"), "exp_id")


@query("g4_spearman_matrix", f"WITH {_RANKS}, n AS (SELECT count(*) AS n FROM rk), c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rk" for a in _RK for b in _RK) + f") SELECT a, b, n, {rd('r', 'r')}, {rd('1 - abs(r)', 'distance')} FROM c, n")
def g4(spark, sf):
    m = G.spearman_matrix(_table(spark, sf), "exp_id", list(_RK))
    return m.withColumns({"r": r6("r"), "distance": r6("distance")})


MATRIX = ["vec", "delta_r", "h_mix", "s_mix", "delta_chi", "lattice_mismatch", "grain_size_um", "binder_pct", "sinter_temp_c"]


def alloy_matrix(spark, sf):
    """Training matrix of all alloys; the target is the heuristic hardness."""
    a = scored(O.with_rows(B.view(spark, sf, "alloys", heavy=True)))
    a = a.select("alloy_id", "hv", "kic", "t.vec", "t.delta_r", "t.h_mix", "t.s_mix", "t.delta_chi", "s.lattice_mismatch",
                 "grain_size_um", "binder_pct", "sinter_temp_c", "pred_magnetic_moment", "pred_formation_energy", "volume_per_atom", "ceramic")
    return cut_lineage(a, "matrix")


@query("g5_cluster_selection")
def g5(spark, sf):
    return G.cluster_selection(alloy_matrix(spark, sf), "alloy_id", "hv", MATRIX, 0.7, ["sinter_temp_c"])


@query("g6_strongest_features", f"WITH {_RANKS}, c AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({f}, hv)) AS abs_rho FROM rk" for f in ("kic", "trs", "grain_size_um")) + f""") SELECT feature, {rd('abs_rho', 'abs_rho')}, feature = 'trs' AS critical FROM c ORDER BY critical DESC, abs_rho DESC, feature LIMIT 2""")
def g6(spark, sf):
    return G.strongest_features(_table(spark, sf), "exp_id", "hv", ["kic", "trs", "grain_size_um"], ["trs"], 2).withColumn("abs_rho", r6("abs_rho"))


_IMP = "imp AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, hv)) AS importance FROM t" for c in ("kic", "trs", "grain_size_um", "sinter_temp_c", "load_kgf")) + ")"


def _importance(spark, sf):
    t = B.view(spark, sf, "experiments").join(B.view(spark, sf, "properties"), "exp_id")
    r = Q.correlations(t, [(c, "hv") for c in ("kic", "trs", "grain_size_um", "sinter_temp_c", "load_kgf")])
    return r.select(F.col("a").alias("feature"), F.abs("r").alias("importance"))


@query("g7_critical_first", f"WITH {_T}, {_IMP} SELECT feature, {rd('importance', 'importance')}, feature IN ('grain_size_um', 'sinter_temp_c') AS critical FROM imp ORDER BY critical DESC, importance DESC LIMIT 3")
def g7(spark, sf):
    return G.critical_first(_importance(spark, sf), ["grain_size_um", "sinter_temp_c"], 3).withColumn("importance", r6("importance"))


#: the forest that ranks features
FOREST = Model("forest", rounds=1, rate=1.0, depth=5, l2=0.0, parallel=100, subsample=0.63, columns=0.4)


@query("g8_recursive_elimination")
def g8(spark, sf):
    """Best feature count by cross-validated R2 of a forest."""
    steps = ml.eliminate(alloy_matrix(spark, sf), "alloy_id", MATRIX, "hv", FOREST, 5, 2)
    return spark.createDataFrame([(n, ",".join(f), float(s)) for n, f, s in steps], "size int, features string, r2 double")


@query("g9_manual_set", f"WITH {_T}, {_IMP}, n AS (SELECT DISTINCT sinter_method AS feature FROM experiments WHERE sinter_method IS NOT NULL) SELECT feature FROM imp WHERE feature NOT IN ('kic', 'trs') UNION SELECT feature FROM n")
def g9(spark, sf):
    auto = _importance(spark, sf).select("feature")
    removed = auto.where(F.col("feature").isin("kic", "trs"))
    added = B.view(spark, sf, "experiments").where("sinter_method IS NOT NULL").select(F.col("sinter_method").alias("feature"))
    return G.manual_set(auto, removed, added)


@query("g10_label_encoding", f"WITH {B.sql('alloys')}, l AS (SELECT ceramic, CAST(row_number() OVER (ORDER BY ceramic) - 1 AS INT) AS code FROM (SELECT DISTINCT ceramic FROM alloys)) SELECT alloy_id, ceramic, code FROM alloys JOIN l USING (ceramic)")
def g10(spark, sf):
    return G.label_encode(B.view(spark, sf, "alloys", heavy=True).select("alloy_id", "ceramic"), "ceramic", "code")


@query("g11_train_split", f"WITH {B.sql('properties')} SELECT CAST(floor({B.uni('exp_id', 0)} * 10000) AS INT) < 8000 AS is_train, count(*) AS n FROM properties GROUP BY ALL")
def g11(spark, sf):
    return G.train_flag(B.view(spark, sf, "properties").select("exp_id"), "exp_id").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))




@query("g12_scaling", f"""WITH {_T}, s AS (SELECT avg(kic) AS m, stddev_pop(kic) AS d, min(grain_size_um) AS lo, max(grain_size_um) AS hi FROM t WHERE exp_id % 5 > 0)
SELECT exp_id, {rd('(kic - m) / d', 'kic')}, {rd('(grain_size_um - lo) / (hi - lo)', 'grain_size_um')} FROM t, s""")
def g12(spark, sf):
    t = _table(spark, sf).select("exp_id", "kic", "grain_size_um")
    t = G.scale(t, ["kic"], F.col("exp_id") % 5 > 0)
    t = G.scale(t, ["grain_size_um"], F.col("exp_id") % 5 > 0, "minmax")
    return t.withColumns({"kic": r6("kic"), "grain_size_um": r6("grain_size_um")})


@query("g13_fold_assignment", f"WITH {B.sql('properties')} SELECT CAST(floor({B.uni('exp_id', 0)} * 5) AS INT) AS fold, count(*) AS n FROM properties GROUP BY ALL")
def g13(spark, sf):
    return G.folds(B.view(spark, sf, "properties").select("exp_id"), "exp_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("g14_group_folds", f"WITH {B.sql('experiments')} SELECT exp_id, source_id, CAST(dense_rank() OVER (ORDER BY source_id) - 1 AS INT) AS fold FROM experiments")
def g14(spark, sf):
    return G.group_folds(B.view(spark, sf, "experiments").select("exp_id", "source_id"), "source_id")


@query("g15_align_features", f"WITH {_T} SELECT exp_id, coalesce(trs, 0) AS trs, 0e0 AS absent, CASE WHEN kic > 20 THEN 0 ELSE kic END AS kic FROM t")
def g15(spark, sf):
    t = _table(spark, sf).withColumn("kic", F.when(F.col("kic") > 20, float("inf")).otherwise(F.col("kic")))
    return G.align(t, ["trs", "absent", "kic"], keep=["exp_id"])


@query("g16_importance_ranking")
def g16(spark, sf):
    m = alloy_matrix(spark, sf)
    model = ml.pipeline("regression", "boosted", MATRIX, "hv", maxIter=100).fit(m)
    return ml.importances(spark, model, MATRIX)
