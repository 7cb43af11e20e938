"""Registered queries: aggregation, profiling, cleaning, validation."""

from pyspark.sql import functions as F

from cermetry.functions.common import r6
from cermetry.operators import features as G
from cermetry.operators import ml
from cermetry.operators import ordering as O
from cermetry.operators import quality as Q
from cermetry.plans import bridge as B
from cermetry.plans.physics import rd
from cermetry.plans.registry import query
from cermetry.plans.relational import STAR, star

PROPS = ["hv", "kic", "trs"]
PV = B.sql("properties")


def _props(spark, sf):
    return B.view(spark, sf, "properties")


def _round(df, cols, digits=6):
    return df.withColumns({c: r6(c, digits) for c in cols})


def _line(spark, sf):
    return B.table(spark, sf, "lineitem").selectExpr(
        "l_quantity AS qty", "l_extendedprice AS price", "l_discount AS disc", "l_tax AS tax", "l_returnflag AS flag", "l_linestatus AS status")


LINE = "line AS (SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"


@query("f1_mean_fill", f"WITH {PV}, m AS (SELECT avg(hv) AS h, avg(trs) AS t FROM properties) SELECT exp_id, {rd('coalesce(hv, h)', 'hv')}, kic, {rd('coalesce(trs, t)', 'trs')} FROM properties, m")
def f1(spark, sf):
    return _round(Q.fill_mean(_props(spark, sf), ["hv", "trs"]), ["hv", "trs"])


@query("f2_median_fill", f"WITH {PV}, m AS (SELECT quantile_cont(hv, 5e-1) AS h, quantile_cont(trs, 5e-1) AS t FROM properties) SELECT exp_id, {rd('coalesce(hv, h)', 'hv')}, kic, coalesce(trs, t) AS trs FROM properties, m")
def f2(spark, sf):
    return _round(Q.fill_median(_props(spark, sf), ["hv", "trs"]), ["hv"])


@query("f3_median_fill_missing_only", f"WITH {PV}, m AS (SELECT quantile_cont(hv, 5e-1) AS h, quantile_cont(trs, 5e-1) AS t FROM properties) SELECT exp_id, {rd('coalesce(hv, h)', 'hv')}, kic, coalesce(trs, t) AS trs FROM properties, m")
def f3(spark, sf):
    p = _props(spark, sf)
    gaps = [r["column"] for r in Q.missing_report(p, PROPS).select("column").collect()]
    return _round(Q.fill_median(p, gaps), ["hv"])


_MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("f4_mode_fill", f"""WITH {B.sql('experiments')} SELECT exp_id, coalesce(sinter_method, {_MODE.format(c='sinter_method', t='experiments')}) AS sinter_method,
 coalesce(sinter_temp_c, {_MODE.format(c='sinter_temp_c', t='experiments')}) AS sinter_temp_c FROM experiments""")
def f4(spark, sf):
    e = B.view(spark, sf, "experiments").select("exp_id", "sinter_method", "sinter_temp_c")
    return Q.fill_mode(e, ["sinter_method", "sinter_temp_c"])


def _describe(c, t):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, {rd(f'avg({c})', 'mean', 4)}, {rd(f'stddev_samp({c})', 'std', 4)}, {rd(f'min({c})', 'min')}, {rd(f'max({c})', 'max')}, "
            + ", ".join(rd(f"quantile_cont({c}, {q}e-2)", f"q{q}") for q in (25, 50, 75)) + f" FROM {t}")


@query("f5_describe", f"WITH {PV} " + " UNION ALL ".join(_describe(c, "properties") for c in PROPS))
def f5(spark, sf):
    d = Q.describe(_props(spark, sf), PROPS)
    return _round(_round(d, ["mean", "std"], 4), ["min", "max", "q25", "q50", "q75"])


@query("f6_column_info", f"WITH {PV} SELECT 'exp_id' AS \"column\", count(exp_id) AS non_null, 'bigint' AS dtype FROM properties " + " ".join(
    f"UNION ALL SELECT '{c}', count({c}), 'double' FROM properties" for c in PROPS))
def f6(spark, sf):
    return Q.column_info(_props(spark, sf))


def _missing(c, t):
    return f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 4) + 0e0 AS missing_pct FROM {t}"


@query("f7_missing_report", f"WITH {B.sql('experiments')} SELECT * FROM (" + " UNION ALL ".join(
    _missing(c, "experiments") for c in ("sinter_temp_c", "grain_size_um", "sinter_method", "load_kgf")) + ") WHERE missing > 0")
def f7(spark, sf):
    e = B.view(spark, sf, "experiments").select("sinter_temp_c", "grain_size_um", "sinter_method", "load_kgf")
    return _round(Q.missing_report(e), ["missing_pct"], 4)


@query("f8_target_statistics", f"WITH {PV} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {rd(f'avg({c})', 'mean', 4)}, {rd(f'stddev_samp({c})', 'std', 4)}, {rd(f'min({c})', 'min')}, {rd(f'max({c})', 'max')} FROM properties" for c in PROPS))
def f8(spark, sf):
    return _round(_round(Q.target_statistics(_props(spark, sf), PROPS), ["mean", "std"], 4), ["min", "max"])


@query("f9_feature_coverage", f"WITH {STAR} SELECT count(*) AS n, count(vec_binder) AS with_physics, count(pred_formation_energy) AS with_surrogate, count(CASE WHEN has_full THEN 1 END) AS with_full FROM experiments LEFT JOIN features USING (exp_id)")
def f9(spark, sf):
    s = star(spark, sf)
    return s["experiments"].join(s["features"], "exp_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("vec_binder").alias("with_physics"), F.count("pred_formation_energy").alias("with_surrogate"), F.count_if("has_full").alias("with_full"))


@query("f10_worst_columns", f"WITH {PV} SELECT * FROM (" + " UNION ALL ".join(_missing(c, "properties") for c in PROPS) + ") WHERE missing_pct > 50 ORDER BY missing_pct DESC, 1 LIMIT 10")
def f10(spark, sf):
    return _round(Q.worst_columns(_props(spark, sf).select(*PROPS)), ["missing_pct"], 4)


@query("f11_drop_constant", "SELECT o_orderkey, o_totalprice FROM orders")
def f11(spark, sf):
    o = B.table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", "1 AS one", "CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS only_x", "CAST(NULL AS DOUBLE) AS nothing")
    return Q.drop_constant(o, o.columns)


@query("f12_zero_variance", "SELECT l_orderkey, l_quantity FROM lineitem")
def f12(spark, sf):
    li = B.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_quantity * 0 AS flat")
    return Q.drop_zero_variance(li, ["l_quantity", "flat"])


def _profile(c):
    return f"""SELECT '{c}' AS "column", valid, {rd('m', 'mean', 4)}, {rd('s', 'std', 4)}, {rd('md', 'median')}, outliers, round(valid / n * 100, 4) + 0e0 AS valid_pct,
 CASE WHEN valid / n * 100 < 30 THEN 'poor' WHEN valid / n * 100 < 70 THEN 'fair' WHEN outliers / valid > 1e-1 THEN 'outliers' ELSE 'good' END AS grade
FROM (SELECT count(*) AS n, count({c}) AS valid, any_value(m) AS m, any_value(s) AS s, any_value(md) AS md, count(CASE WHEN abs({c} - m) > 3 * s THEN 1 END) AS outliers
 FROM spiky, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 5e-1) AS md FROM spiky))"""


@query("f13_quality_profile", f"WITH {PV}, spiky AS (SELECT CASE WHEN exp_id % 100 = 1 THEN hv * 20 ELSE hv END AS hv, kic, trs FROM properties) " + " UNION ALL ".join(_profile(c) for c in PROPS))
def f13(spark, sf):
    p = _props(spark, sf).withColumn("hv", F.expr("CASE WHEN exp_id % 100 = 1 THEN hv * 20 ELSE hv END"))
    return _round(_round(Q.quality_profile(p, PROPS), ["mean", "std", "valid_pct"], 4), ["median"])


@query("f14_outlier_impact", f"""WITH {PV}, spiky AS (SELECT CASE WHEN exp_id % 50 = 1 THEN hv * 20 ELSE hv END AS hv FROM properties), q AS (SELECT quantile_cont(hv, 25e-2) AS q1, quantile_cont(hv, 75e-2) AS q3, avg(hv) AS m, stddev_samp(hv) AS s FROM spiky),
f AS (SELECT q1 - 15e-1 * (q3 - q1) AS lo, q3 + 15e-1 * (q3 - q1) AS hi, m, s FROM q), a AS (SELECT count(hv) AS n, count(CASE WHEN hv < lo OR hv > hi THEN 1 END) AS o, count(CASE WHEN hv < m - 3 * s THEN 1 END) AS x, any_value(lo) AS lo, any_value(hi) AS hi FROM spiky, f)
SELECT o AS outlier_count, x AS extreme_low, {rd('o / n * 100', 'outlier_ratio', 4)}, CASE WHEN o / n * 100 > 5 THEN 'warning' ELSE 'ok' END AS severity, {rd('lo', 'lower_bound', 4)}, {rd('hi', 'upper_bound', 4)} FROM a""")
def f14(spark, sf):
    p = _props(spark, sf).select(F.expr("CASE WHEN exp_id % 50 = 1 THEN hv * 20 ELSE hv END").alias("hv"))
    return _round(Q.outlier_impact(p, "hv"), ["outlier_ratio", "lower_bound", "upper_bound"], 4)


@query("f15_isolation_outliers")
def f15(spark, sf):
    """Forest scores and flags of every row (seeded, so repeatable)."""
    p = _props(spark, sf).select("exp_id", "hv", "kic")
    return ml.isolation_outliers(p, "exp_id", ["hv", "kic"], contamination=0.05, seed=42)


_C16 = ["hv", "kic", "trs", "grain_size_um", "sinter_temp_c"]
_T16 = f"{B.sql('experiments', 'properties')}, t AS (SELECT * FROM experiments JOIN properties USING (exp_id))"


def _joined(spark, sf):
    return B.view(spark, sf, "experiments").join(_props(spark, sf), "exp_id")


@query("f16_correlation_matrix", f"WITH {_T16} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, {rd(f'corr({a}, {b})', 'r')} FROM t" for a in _C16 for b in _C16))
def f16(spark, sf):
    return _round(Q.correlation_matrix(_joined(spark, sf), _C16), ["r"])


@query("f16_correlation_wide", """WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(p.i - 1 AS BIGINT) AS i, CAST(q.i - 1 AS BIGINT) AS j, count(*) AS n, round(corr(p.x, q.x), 6) + 0e0 AS r FROM v p JOIN v q ON p.vec_id = q.vec_id AND p.i <= q.i GROUP BY ALL""")
def f16b(spark, sf):
    """All pairs of the 64 vector components from per-partition moment matrices."""
    e = B.table(spark, sf, "embeddings")
    return _round(G.wide_correlation(e, "embedding", 64), ["r"])


@query("f17_leakage", f"""WITH {_T16}, l AS (SELECT hv, hv * 2 + grain_size_um AS hv_twin, grain_size_um, sinter_temp_c, kic AS toughness_raw FROM t),
c AS (SELECT 'hv_twin' AS feature, corr(hv_twin, hv) AS r FROM l UNION ALL SELECT 'grain_size_um', corr(grain_size_um, hv) FROM l UNION ALL SELECT 'sinter_temp_c', corr(sinter_temp_c, hv) FROM l UNION ALL SELECT 'toughness_raw', corr(toughness_raw, hv) FROM l)
SELECT feature, 'high_correlation' AS issue, {rd('r', 'r')} FROM c WHERE abs(r) > 95e-2 UNION ALL SELECT feature, 'suspicious_name', NULL FROM c WHERE feature IN ('hv_twin', 'toughness_raw')""")
def f17(spark, sf):
    t = _joined(spark, sf).selectExpr("hv", "hv * 2 + grain_size_um AS hv_twin", "grain_size_um", "sinter_temp_c", "kic AS toughness_raw")
    return _round(Q.leakage(t, "hv", ["hv_twin", "grain_size_um", "sinter_temp_c", "toughness_raw"]), ["r"])


_F18 = ["hv", "twin", "kic", "grain_size_um", "g2"]


@query("f18_collinear_pairs", f"""WITH {_T16}, l AS (SELECT hv, hv * 3 + kic AS twin, kic, grain_size_um, grain_size_um * grain_size_um AS g2 FROM t), m AS (SELECT quantile_cont(hv, 5e-1) AS hv, quantile_cont(twin, 5e-1) AS twin FROM l),
f AS (SELECT coalesce(l.hv, m.hv) AS hv, coalesce(l.twin, m.twin) AS twin, kic, grain_size_um, g2 FROM l, m), n AS (SELECT count(*) AS n FROM f)
SELECT a, b, n, {rd('r', 'r')} FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM f" for i, a in enumerate(_F18) for b in _F18[i + 1:]) + "), n WHERE abs(r) > 9e-1")
def f18(spark, sf):
    t = _joined(spark, sf).selectExpr("hv", "hv * 3 + kic AS twin", "kic", "grain_size_um", "grain_size_um * grain_size_um AS g2")
    return _round(Q.collinear_pairs(t, _F18), ["r"])


@query("f19_duplicates", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem QUALIFY copies > 1")
def f19(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return Q.duplicates(li, ["l_orderkey", "l_linenumber"])


@query("f20_physics_ranges", f"""WITH {STAR}, a AS (SELECT min(lattice_mismatch) AS m0, max(lattice_mismatch) AS m1, min(vec_binder) AS v0, max(vec_binder) AS v1, min(binder_density) AS d0, max(binder_density) AS d1,
 avg(CASE WHEN pred_formation_energy > 0 THEN 1e0 WHEN pred_formation_energy IS NOT NULL THEN 0 END) * 100 AS pos FROM features)
SELECT array_to_string(list_filter([CASE WHEN m0 < 0 THEN 'lattice_mismatch: below zero' WHEN m1 > 1 THEN 'lattice_mismatch: above one' END, CASE WHEN v0 < 3 OR v1 > 12 THEN 'vec_binder: outside 3 to 12' END,
 CASE WHEN d0 < 1 OR d1 > 25 THEN 'binder_density: outside 1 to 25' END, CASE WHEN pos > 10 THEN 'pred_formation_energy: positive in over a tenth' END], lambda x: x IS NOT NULL), ',') AS issues, {rd('pos', 'positive_pct', 4)} FROM a""")
def f20(spark, sf):
    return Q.physics_issues(star(spark, sf)["features"]).select(F.array_join("issues", ",").alias("issues"), r6("pos", 4).alias("positive_pct"))


@query("f21_hea_consistency", f"""WITH {STAR}, c AS (SELECT element_count, CASE WHEN exp_id % 50 = 3 THEN true ELSE is_hea END AS is_hea FROM compositions)
SELECT element_count, count(*) AS n, count(CASE WHEN is_hea THEN 1 END) AS hea, CASE WHEN element_count = 2 AND count(CASE WHEN is_hea THEN 1 END) > 0 THEN 'flagged with two elements'
 WHEN element_count < 5 AND count(CASE WHEN is_hea THEN 1 END) > 0 THEN 'flagged below five elements' END AS issue FROM c GROUP BY element_count""")
def f21(spark, sf):
    c = star(spark, sf)["compositions"].withColumn("is_hea", F.expr("CASE WHEN exp_id % 50 = 3 THEN true ELSE is_hea END"))
    return Q.hea_consistency(c.select("element_count", "is_hea"))


_SIGNS = {"grain_size_um": "negative", "sinter_temp_c": "positive", "kic": "uncertain", "twin": "positive"}


@query("f22_expected_signs", f"""WITH {_T16}, l AS (SELECT *, hv + kic AS twin FROM t), c AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, hv) AS r, '{s}' AS expected FROM l" for f, s in _SIGNS.items()) + f""")
SELECT feature, {rd('r', 'r')}, expected, CASE expected WHEN 'positive' THEN r > 1e-1 WHEN 'negative' THEN r < -1e-1 ELSE true END AS ok FROM c""")
def f22(spark, sf):
    return _round(Q.expected_signs(_joined(spark, sf).withColumn("twin", F.col("hv") + F.col("kic")), "hv", _SIGNS), ["r"])


@query("f23_prediction_plausibility", f"WITH {PV}, p AS (SELECT hv * 2 - 1300 AS p FROM properties) SELECT count(CASE WHEN p < 0 THEN 1 END) AS negative, count(CASE WHEN p < 500 THEN 1 END) AS below_500, count(CASE WHEN p > 3000 THEN 1 END) AS above_3000, {rd('min(p)', 'lo')}, {rd('max(p)', 'hi')}, {rd('avg(p)', 'mean', 4)} FROM p")
def f23(spark, sf):
    p = _props(spark, sf).select((F.col("hv") * 2 - 1300).alias("p"))
    return _round(_round(Q.prediction_plausibility(p, "p"), ["lo", "hi"]), ["mean"], 4)


#: the second phase's volume as stored on its own; every 97th record does not close
_VOL = "100 - binder_vol_pct - CASE WHEN exp_id % 97 = 0 THEN 5e-1 WHEN exp_id % 89 = 0 THEN 5e-2 ELSE 0e0 END"


@query("f24_volume_closure", f"""WITH {STAR}, c AS (SELECT binder_vol_pct, {_VOL} AS ceramic_vol_pct FROM compositions)
SELECT {rd('max(abs(binder_vol_pct + ceramic_vol_pct - 100))', 'worst')}, count(binder_vol_pct) AS filled, count(CASE WHEN abs(binder_vol_pct + ceramic_vol_pct - 100) > 1e-1 THEN 1 END) AS open_rows FROM c""")
def f24(spark, sf):
    c = star(spark, sf)["compositions"].selectExpr("binder_vol_pct", f"{_VOL} AS ceramic_vol_pct")
    gap = F.abs(F.col("binder_vol_pct") + F.col("ceramic_vol_pct") - 100)
    return c.agg(r6(F.max(gap)).alias("worst"), F.count("binder_vol_pct").alias("filled"), F.count_if(gap > 0.1).alias("open_rows"))


@query("f25_category_counts", f"WITH {B.sql('activity')} SELECT activity, count(*) AS count FROM activity GROUP BY activity")
def f25(spark, sf):
    return Q.category_counts(B.view(spark, sf, "activity"), "activity")


@query("f26_grades", f"""WITH {PV} SELECT exp_id, CASE WHEN hv IS NULL THEN 'Unknown' WHEN hv < 800 THEN 'Low' WHEN hv < 1200 THEN 'Medium' WHEN hv < 1600 THEN 'High' ELSE 'Very High' END AS hardness,
 CASE WHEN kic IS NULL THEN 'Unknown' WHEN kic < 10 THEN 'Low' WHEN kic < 15 THEN 'Medium' WHEN kic < 20 THEN 'High' ELSE 'Very High' END AS toughness FROM properties""")
def f26(spark, sf):
    return _props(spark, sf).select("exp_id", Q.hardness_grade("hv").alias("hardness"), Q.toughness_grade("kic").alias("toughness"))


@query("f27_phase_classes", f"""WITH {B.sql('alloys')}, u AS (SELECT alloy_id, upper(formula) AS f, upper(CASE WHEN alloy_id % 10 > 0 THEN ceramic END) AS c FROM alloys)
SELECT alloy_id, CASE WHEN contains(f, 'NI') AND contains(f, 'CO') THEN 'Co-Ni' WHEN contains(f, 'CO') THEN 'Co-based' WHEN contains(f, 'NI') THEN 'Ni-based' WHEN contains(f, 'FE') THEN 'Fe-based' ELSE 'Other' END AS binder,
 CASE WHEN c IS NULL THEN 'Unknown' WHEN contains(c, 'WC') THEN 'WC-based' WHEN contains(c, 'TIC') OR contains(c, 'TIN') THEN 'Ti-carbide/nitride' ELSE 'Other' END AS ceramic FROM u""")
def f27(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("c", F.expr("CASE WHEN alloy_id % 10 > 0 THEN ceramic END"))
    return a.select("alloy_id", Q.binder_class("formula").alias("binder"), Q.ceramic_class("c").alias("ceramic"))


@query("f28_right_closed_bins", f"""WITH {B.sql('proxies')}, p AS (SELECT exp_id, abs(pred_magnetic_moment) AS m, pred_formation_energy AS e FROM proxies)
SELECT exp_id, CASE WHEN m > 0 AND m <= 5e-1 THEN 'Low' WHEN m > 5e-1 AND m <= 15e-1 THEN 'Medium' WHEN m > 15e-1 THEN 'High' END AS magnetic,
 CASE WHEN e <= -1e-1 THEN 'Excellent' WHEN e <= 0 THEN 'Good' WHEN e <= 1e-1 THEN 'Fair' WHEN e > 1e-1 THEN 'Poor' END AS stability, e > 1e-1 AS unstable FROM p""")
def f28(spark, sf):
    p = B.view(spark, sf, "proxies")
    return p.select("exp_id", Q.magnetic_class("pred_magnetic_moment").alias("magnetic"), Q.stability_class("pred_formation_energy").alias("stability"),
                    (F.col("pred_formation_energy") > 0.1).alias("unstable"))


@query("f29_histogram", f"WITH {PV} SELECT CAST(floor((hv - 600) / 50) AS BIGINT) AS bin, count(*) AS n FROM properties WHERE hv IS NOT NULL GROUP BY 1")
def f29(spark, sf):
    return Q.histogram(_props(spark, sf), "hv", 600.0, 50.0)


@query("f30_grid_counts", f"WITH {PV} SELECT CAST(floor(hv / 100) AS BIGINT) AS bx, CAST(floor(kic / 2) AS BIGINT) AS by, count(*) AS n FROM properties WHERE hv IS NOT NULL GROUP BY 1, 2")
def f30(spark, sf):
    return Q.grid_counts(_props(spark, sf), "hv", "kic", 100.0, 2.0)


@query("f31_cross_table", f"WITH {B.sql('library')} SELECT atoms, " + ", ".join(f"count(CASE WHEN space_group = {g} THEN 1 END) AS c_{g}" for g in (200, 206, 212, 218, 224, 230, 236)) + " FROM library GROUP BY atoms")
def f31(spark, sf):
    return Q.cross_table(B.view(spark, sf, "library"), "atoms", "space_group", (200, 206, 212, 218, 224, 230, 236))


@query("f32_group_rows", f"WITH {B.sql('library')} SELECT formula, count(*) AS n, count(CASE WHEN atoms <= 3 THEN 1 END) AS small, count(CASE WHEN atoms > 3 THEN 1 END) AS large, count(DISTINCT space_group) AS systems FROM library GROUP BY formula")
def f32(spark, sf):
    return B.view(spark, sf, "library").groupBy("formula").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("atoms") <= 3).alias("small"), F.count_if(F.col("atoms") > 3).alias("large"), F.count_distinct("space_group").alias("systems"))


_SYMS = ("Co", "Ni", "Fe", "Cr", "Mo", "Ti")


@query("f33_symbol_occurrences", f"WITH {B.sql('alloys')} " + " UNION ALL ".join(f"SELECT ceramic, '{s}' AS symbol, count(CASE WHEN contains(formula, '{s}') THEN 1 END) AS n FROM alloys GROUP BY ceramic" for s in _SYMS))
def f33(spark, sf):
    return Q.symbol_occurrences(B.view(spark, sf, "alloys"), "formula", _SYMS, by=["ceramic"])


@query("f34_group_quantiles", f"WITH {LINE} SELECT flag, 5e-1 AS prob, {rd('quantile_cont(price, 5e-1)', 'quantile', 4)} FROM line GROUP BY flag UNION ALL SELECT flag, 9e-1, {rd('quantile_cont(price, 9e-1)', 'quantile', 4)} FROM line GROUP BY flag")
def f34(spark, sf):
    q = O.quantiles(_line(spark, sf).select("flag", F.col("price").alias("value")), ["flag"], [0.5, 0.9])
    return _round(q, ["quantile"], 4)


@query("f35_mean_deviation", f"""WITH {LINE}, o AS (SELECT avg(price) AS m FROM line), g AS (SELECT flag, avg(price) AS m FROM line GROUP BY flag)
SELECT 'all' AS flag, {rd('avg(abs(price - m))', 'mad', 4)} FROM line, o UNION ALL SELECT flag, {rd('avg(abs(price - m))', 'mad', 4)} FROM line JOIN g USING (flag) GROUP BY flag""")
def f35(spark, sf):
    li = _line(spark, sf)
    whole = Q.mean_deviation(li, "price").select(F.lit("all").alias("flag"), "mad")
    return _round(whole.unionByName(Q.mean_deviation(li, "price", "flag")), ["mad"], 4)


@query("f36_z_scores", f"WITH {B.sql('alloys')}, s AS (SELECT avg(binder_pct) AS m, stddev_pop(binder_pct) AS s, avg(bulk) AS mb, stddev_pop(bulk) AS sb FROM alloys) SELECT alloy_id, {rd('(binder_pct - m) / s', 'binder_pct')}, {rd('(bulk - mb) / sb', 'bulk')} FROM alloys, s")
def f36(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", "binder_pct", "bulk", F.lit(3.0).alias("flat"))
    return _round(Q.standardize(a, ["binder_pct", "bulk", "flat"]), ["binder_pct", "bulk"])


@query("f37_min_max", f"WITH {B.sql('alloys')}, s AS (SELECT min(bulk) AS l, max(bulk) AS h, min(binder_pct) AS lb, max(binder_pct) AS hb FROM alloys) SELECT alloy_id, {rd('(bulk - l) / (h - l + 1e-10)', 'bulk')}, {rd('(binder_pct - lb) / (hb - lb + 1e-10)', 'binder_pct')} FROM alloys, s")
def f37(spark, sf):
    return _round(Q.min_max(B.view(spark, sf, "alloys").select("alloy_id", "bulk", "binder_pct"), ["bulk", "binder_pct"]), ["bulk", "binder_pct"])


@query("f38_pca")
def f38(spark, sf):
    """Ranked loadings of the first components of the vectors."""
    return ml.pca_loadings(B.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64, 3)


@query("f38_pca_scores", f"""WITH {PV}, t AS (SELECT exp_id, hv, kic FROM properties WHERE hv IS NOT NULL AND kic IS NOT NULL),
s AS (SELECT avg(hv) AS mh, stddev_samp(hv) AS sh, avg(kic) AS mk, stddev_samp(kic) AS sk, corr(hv, kic) AS r FROM t),
z AS (SELECT exp_id, (hv - mh) / sh AS a, (kic - mk) / sk AS b, r FROM t, s)
SELECT exp_id, {rd('(a + CASE WHEN r > 0 THEN b ELSE -b END) / sqrt(2e0)', 'pc1', 5)}, {rd('(a - CASE WHEN r > 0 THEN b ELSE -b END) / sqrt(2e0)', 'pc2', 5)} FROM z""")
def f38b(spark, sf):
    """Scores on both components of two columns, for which the components are known."""
    return _round(ml.pca_scores(_props(spark, sf), "exp_id", ["hv", "kic"], 2), ["pc1", "pc2"], 5)


@query("f39_running_best", f"WITH {PV}, t AS (SELECT exp_id AS trial, hv FROM properties WHERE hv IS NOT NULL) SELECT trial, {rd('hv', 'hv')}, {rd('max(hv) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING)', 'best')} FROM t")
def f39(spark, sf):
    t = _props(spark, sf).where("hv IS NOT NULL").selectExpr("exp_id AS trial", "hv")
    return _round(O.running_best(t, "trial", "hv"), ["hv", "best"])


@query("f40_vector_text", f"""WITH {B.sql('library')}, p AS (SELECT entry_id, atoms, volume, string_split(trim(magmom), ' ') AS t FROM library), v AS (SELECT entry_id, atoms, volume, list_transform(t, lambda x: abs(TRY_CAST(x AS DOUBLE))) AS v FROM p),
g AS (SELECT entry_id, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN list_sum(v) END AS s, len(v) AS n FROM v)
SELECT entry_id, {rd('coalesce(s / n, 0)', 'mean_abs')}, {rd('s', 'sum_abs')}, coalesce(s / n, 0) > 1e-1 AS magnetic FROM g""")
def f40(spark, sf):
    lib = B.view(spark, sf, "library").withColumns({"m": Q.vector_scalar("magmom"), "s": Q.vector_scalar("magmom", "sum")})
    return lib.select("entry_id", r6("m").alias("mean_abs"), r6("s").alias("sum_abs"), (F.col("m") > 0.1).alias("magnetic"))


@query("f41_stable_share", f"WITH {B.sql('library')} SELECT count(*) AS stable, {rd('avg(CASE WHEN space_group = 224 THEN 1e0 ELSE 0 END)', 'cubic_share')} FROM library WHERE energy < 1e-1")
def f41(spark, sf):
    return B.view(spark, sf, "library").where("energy < 0.1").agg(
        F.count(F.lit(1)).alias("stable"), r6(F.avg(F.when(F.col("space_group") == 224, 1.0).otherwise(0.0))).alias("cubic_share"))


@query("f42_kpi_row", f"WITH {STAR} SELECT count(*) AS n, count(CASE WHEN is_hea THEN 1 END) AS hea, {rd('avg(hv)', 'mean_hv', 4)}, {rd('avg(kic)', 'mean_kic', 4)} FROM compositions JOIN properties USING (exp_id)")
def f42(spark, sf):
    s = star(spark, sf)
    return s["compositions"].join(s["properties"], "exp_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_hea").alias("hea"), r6(F.avg("hv"), 4).alias("mean_hv"), r6(F.avg("kic"), 4).alias("mean_kic"))


@query("f43_screening_summary", f"""WITH {PV}, s AS (SELECT avg(hv) AS m, stddev_samp(hv) AS sd, min(hv) AS lo, max(hv) AS hi FROM properties), t AS (SELECT min(hv) AS cut FROM (SELECT hv FROM properties WHERE hv IS NOT NULL ORDER BY hv DESC, exp_id LIMIT 100))
SELECT {rd('m', 'mean', 4)}, {rd('sd', 'std', 4)}, {rd('lo', 'lo')}, {rd('hi', 'hi')}, {rd('(cut - m) / m * 100', 'uplift_pct', 4)} FROM s, t""")
def f43(spark, sf):
    from cermetry.operators.screening import screening_summary

    return _round(_round(screening_summary(_props(spark, sf), "hv", "exp_id", 100), ["mean", "std", "uplift_pct"], 4), ["lo", "hi"])


@query("f44_funnel", f"""WITH {B.sql('alloys')}, a AS (SELECT count(*) AS n, count(CASE WHEN pred_formation_energy < 0 THEN 1 END) AS s, count(CASE WHEN pred_formation_energy < 0 AND abs(pred_lattice_param - 36e-1) < 1e-1 THEN 1 END) AS i FROM alloys)
SELECT 0 AS stage, 'input' AS name, n, 1e2 AS pct FROM a UNION ALL SELECT 1, 'stable', s, {rd('s / n * 100', 'p', 4)} FROM a UNION ALL SELECT 2, 'matched', i, {rd('i / n * 100', 'p', 4)} FROM a""")
def f44(spark, sf):
    stages = [("stable", F.col("pred_formation_energy") < 0), ("matched", F.abs(F.col("pred_lattice_param") - 3.6) < 0.1)]
    return _round(Q.funnel(B.view(spark, sf, "alloys"), stages), ["pct"], 4)


@query("f45_residual_report", f"""WITH {PV}, r AS (SELECT hv - (1600 - kic * 10) AS res FROM properties WHERE hv IS NOT NULL), b AS (SELECT avg(res) AS m, stddev_samp(res) AS s, quantile_cont(abs(res), 95e-2) AS c FROM r)
SELECT {rd('any_value(m)', 'mean', 4)}, {rd('any_value(s)', 'std', 4)}, {rd('min(res)', 'min')}, {rd('max(res)', 'max')}, {rd('any_value(c)', 'high_cut', 4)}, count(CASE WHEN abs(res) > c THEN 1 END) AS high_error, count(CASE WHEN abs(res - m) > 3 * s THEN 1 END) AS outliers FROM r, b""")
def f45(spark, sf):
    p = _props(spark, sf).withColumn("pred", 1600 - F.col("kic") * 10)
    return _round(_round(Q.residual_report(p, "hv", "pred"), ["mean", "std", "high_cut"], 4), ["min", "max"])


@query("f46_import_statistics", f"WITH {B.sql('library')} SELECT count(energy) AS valid, {rd('avg(CASE WHEN energy < 0 THEN 1e0 WHEN energy IS NOT NULL THEN 0 END)', 'negative_share')}, {rd('avg(energy)', 'mean')}, count(CASE WHEN is_stable THEN 1 END) AS stable FROM library")
def f46(spark, sf):
    return B.view(spark, sf, "library").agg(
        F.count("energy").alias("valid"), r6(F.avg(F.when(F.col("energy") < 0, 1.0).when(F.col("energy").isNotNull(), 0.0))).alias("negative_share"),
        r6(F.avg("energy")).alias("mean"), F.count_if("is_stable").alias("stable"))
