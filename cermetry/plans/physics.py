"""Registered queries: physics features."""

from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions import constants as K
from cermetry.functions import physics as P
from cermetry.functions.common import pinned, r6
from cermetry.operators import physics as O
from cermetry.plans import bridge as B
from cermetry.plans.registry import query
from cermetry.sources import dims

# Alloys with an element outside the reference table now and then.
RHENIUM = "concat(formula, CASE WHEN alloy_id % 9 = 0 THEN 'Re2' ELSE '' END)"
BASE = f"""{B.sql('alloys')}, {B.ELEMENTS_SQL}, {B.shares_sql('sh', 'alloys', 'alloy_id', 'formula')},
j AS (SELECT sh.alloy_id, el, c, e.* FROM sh LEFT JOIN elements e ON symbol = el)"""
BASE_RE = f"""{B.sql('alloys')}, {B.ELEMENTS_SQL}, alloys_re AS (SELECT alloy_id, {RHENIUM} AS f FROM alloys),
{B.shares_sql('sh', 'alloys_re', 'alloy_id', 'f')},
j AS (SELECT sh.alloy_id, el, c, e.* FROM sh LEFT JOIN elements e ON symbol = el)"""
MEANS = """mn AS (SELECT alloy_id, sum(c * vec) AS vec, sum(c * r) AS rbar, sum(c * chi) AS xbar, sum(c * tm) AS tm,
 -sum(c * ln(c)) AS s_r, count(*) AS n FROM j GROUP BY alloy_id),
sp AS (SELECT alloy_id, 100 * sqrt(sum(c * pow(1 - r / rbar, 2))) AS delta, sqrt(sum(c * pow(chi - xbar, 2))) AS dchi FROM j JOIN mn USING (alloy_id) GROUP BY alloy_id)"""
PAIRS = f"""{B.ENTHALPY_SQL},
hm AS (SELECT x.alloy_id, sum(4 * coalesce(h, 0) * x.c * y.c) AS h FROM sh x JOIN sh y ON x.alloy_id = y.alloy_id AND x.el <= y.el
 LEFT JOIN enthalpy ON a = x.el AND b = y.el GROUP BY x.alloy_id)"""


def rd(expr, name, digits=6):
    return f"round({expr}, {digits}) + 0e0 AS {name}"


def _alloys(spark, sf):
    return O.with_rows(B.view(spark, sf, "alloys", heavy=True))


def _rhenium(spark, sf):
    return B.view(spark, sf, "alloys", heavy=True).select("alloy_id", P.formula_rows(F.expr(RHENIUM)).alias("rows"))


def _pick(df, *cols, key="alloy_id", **exprs):
    """Key, plain columns and rounded expressions."""
    return df.select(key, *cols, *[r6(v).alias(k) for k, v in exprs.items()])


R = "rows"


@query("d1_vec", f"WITH {BASE_RE} SELECT alloy_id, {rd('sum(c * coalesce(vec, 0))', 'vec')}, {rd('CASE WHEN count(*) = count(vec) THEN sum(c * vec) END', 'vec_strict')} FROM j GROUP BY alloy_id")
def d1(spark, sf):
    return _pick(_rhenium(spark, sf), vec=P.vec(R), vec_strict=P.vec_strict(R))


@query("d1_vec_exploded", f"WITH {BASE_RE} SELECT alloy_id, {rd('sum(c * coalesce(vec, 0))', 'vec')}, {rd('sum(c * coalesce(tm, 0))', 'tm')} FROM j GROUP BY alloy_id")
def d1b(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", F.expr(RHENIUM).alias("f"))
    s = O.exploded_sums(a, "alloy_id", "f", ["vec", "tm"])
    return _pick(s, vec=F.col("vec"), tm=F.col("tm"))


@query("d2_size_mismatch", f"WITH {BASE}, {MEANS} SELECT alloy_id, {rd('delta', 'delta')} FROM sp")
def d2(spark, sf):
    return _pick(_alloys(spark, sf), delta=P.size_mismatch(R))


@query("d3_electronegativity_spread", f"WITH {BASE}, {MEANS} SELECT alloy_id, {rd('dchi', 'delta_chi')} FROM sp")
def d3(spark, sf):
    return _pick(_alloys(spark, sf), delta_chi=P.chi_spread(R))


@query("d4_mixing_entropy", f"WITH {BASE}, {MEANS} SELECT alloy_id, {rd('s_r', 's_r')}, {rd('s_r * 8314e-3', 's_mix')} FROM mn")
def d4(spark, sf):
    return _pick(_alloys(spark, sf), s_r=P.entropy_r(R), s_mix=P.entropy(R))


@query("d5_mixing_enthalpy", f"WITH {BASE}, {PAIRS} SELECT alloy_id, {rd('h', 'h_mix')} FROM hm")
def d5(spark, sf):
    return _pick(_alloys(spark, sf), h_mix=P.enthalpy(R))


@query("d6_omega", f"WITH {BASE}, {MEANS}, {PAIRS} SELECT alloy_id, {rd('CASE WHEN abs(h) >= 1e-4 THEN tm * s_r * 8314e-3 / (abs(h) * 1000) END', 'omega')} FROM mn JOIN hm USING (alloy_id)")
def d6(spark, sf):
    a = _alloys(spark, sf).withColumns({"s": P.entropy(R), "h": P.enthalpy(R), "tm": P.weighted(R, "tm")})
    return _pick(a, omega=P.omega(F.col("tm"), F.col("s"), F.col("h")))


@query("d7_chen_hardness", f"WITH {B.sql('alloys')} SELECT alloy_id, {rd('CASE WHEN bulk > 0 AND shear <> 0 THEN greatest(0e0, 2 * pow((shear / bulk) * (shear / bulk) * shear, 585e-3) - 3) END', 'hv_gpa')} FROM alloys")
def d7(spark, sf):
    return _pick(B.view(spark, sf, "alloys"), hv_gpa=P.chen_hardness("bulk", "shear"))


@query("d8_tian_hardness", f"WITH {B.sql('alloys')} SELECT alloy_id, {rd('CASE WHEN bulk > 0 AND shear <> 0 THEN 92e-2 * pow(shear / bulk, 1137e-3) * pow(shear, 708e-3) END', 'hv_gpa')} FROM alloys")
def d8(spark, sf):
    return _pick(B.view(spark, sf, "alloys"), hv_gpa=P.tian_hardness("bulk", "shear"))


@query("d9_rule_of_mixtures", f"WITH {BASE_RE} SELECT alloy_id, {rd('sum(c * young)', 'young')}, {rd('sum(c * resistivity)', 'resistivity')} FROM j GROUP BY alloy_id")
def d9(spark, sf):
    return _pick(_rhenium(spark, sf), young=P.weighted_or_null(R, "young"), resistivity=P.weighted_or_null(R, "resistivity"))


@query("d10_bonding", f"""WITH {BASE}, {MEANS}, y AS (SELECT alloy_id, sum(c * young) AS e FROM j GROUP BY alloy_id)
SELECT alloy_id, {rd('xbar', 'mean_chi')}, {rd('100 * (1 - exp(-25e-2 * dchi * dchi))', 'ionic_pct')}, {rd('100 - 100 * (1 - exp(-25e-2 * dchi * dchi))', 'covalent_pct')}, {rd('6e-2 * e', 'hv_bond')}
FROM mn JOIN sp USING (alloy_id) JOIN y USING (alloy_id)""")
def d10(spark, sf):
    a = _alloys(spark, sf).withColumn("ionic", P.ionic_percent(P.chi_spread(R)))
    return _pick(a, mean_chi=P.weighted(R, "chi"), ionic_pct=F.col("ionic"), covalent_pct=100 - F.col("ionic"),
                 hv_bond=0.06 * P.weighted_or_null(R, "young"))


DENSITY = f"{B.METAL_DENSITY_SQL}, dn AS (SELECT alloy_id, sum(c * mass) / sum(c * mass / coalesce(md.rho, 8)) AS rho_b FROM j LEFT JOIN metal_density md ON md.symbol = el GROUP BY alloy_id)"


@query("d11_alloy_density", f"WITH {BASE}, {DENSITY} SELECT alloy_id, {rd('rho_b', 'density')} FROM dn")
def d11(spark, sf):
    return _pick(_alloys(spark, sf), density=P.alloy_density(R))


@query("d12_mean_radius", f"WITH {BASE}, {MEANS} SELECT alloy_id, {rd('rbar', 'mean_radius')} FROM mn")
def d12(spark, sf):
    return _pick(_alloys(spark, sf), mean_radius=P.weighted(R, "r"))


VOL = f"WITH {BASE}, {DENSITY}, {B.COMPOUNDS_SQL}, v AS (SELECT a.alloy_id, binder_pct AS w, rho_b AS b, coalesce(density, 15) AS k FROM alloys a JOIN dn USING (alloy_id) LEFT JOIN compounds cp ON cp.formula = a.ceramic)"


def _densities(spark, sf):
    return _alloys(spark, sf).withColumns({"rb": P.alloy_density(R), "rc": P.ceramic_density("ceramic")})


@query("d13_weight_to_volume", f"{VOL} SELECT alloy_id, {rd('(w / b) / (w / b + (100 - w) / k) * 100', 'vol_pct')} FROM v")
def d13(spark, sf):
    return _pick(_densities(spark, sf), vol_pct=P.wt_to_vol("binder_pct", "rb", "rc"))


@query("d14_volume_to_weight", f"{VOL} SELECT alloy_id, {rd('(w * b) / (w * b + (100 - w) * k) * 100', 'wt_pct')} FROM v")
def d14(spark, sf):
    return _pick(_densities(spark, sf), wt_pct=P.vol_to_wt("binder_pct", "rb", "rc"))


_QD = B.values("qd", ("name", "rho"), list(K.QUICK_DENSITY.items()))


@query("d15_quick_volume_to_weight", f"""WITH {B.sql('alloys')}, {_QD}, v AS (SELECT alloy_id, binder_pct / 1e2 AS v, coalesce(q1.rho, 85e-1) AS b, coalesce(q2.rho, 15) AS k
 FROM alloys LEFT JOIN qd q1 ON q1.name = substring(formula, 1, 2) LEFT JOIN qd q2 ON q2.name = ceramic)
SELECT alloy_id, {rd('v * 100 * b / ((1 - v) * k + v * b)', 'wt_pct')} FROM v""")
def d15(spark, sf):
    a = B.view(spark, sf, "alloys")
    return _pick(a, wt_pct=C.quick_weight(F.substring("formula", 1, 2), F.col("ceramic"), F.col("binder_pct")))


@query("d16_lattice_mismatch", f"""WITH {B.sql('alloys')}, {B.COMPOUNDS_SQL}, d AS (SELECT alloy_id, ceramic, CASE WHEN alloy_id % 2 = 0 THEN pred_lattice_param / sqrt(2e0) ELSE pred_lattice_param * sqrt(3e0) / 2 END AS d FROM alloys)
SELECT alloy_id, {rd('abs(d - neighbor) / neighbor', 'mismatch')} FROM d LEFT JOIN compounds ON formula = ceramic""")
def d16(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("s", F.expr("CASE WHEN alloy_id % 2 = 0 THEN 'fcc' ELSE 'BCC' END"))
    joined = a.join(dims.compounds(spark).select(F.col("formula").alias("ceramic"), "neighbor"), "ceramic", "left")
    return _pick(joined, mismatch=P.relative_gap(P.neighbour_distance("pred_lattice_param", "s"), "neighbor"))


_NAME = "CASE alloy_id % 6 WHEN 0 THEN ceramic WHEN 1 THEN lower(ceramic) WHEN 2 THEN concat(ceramic, ' grade') WHEN 3 THEN 'zzz' WHEN 4 THEN 'Ti(C,N)' ELSE 'Cr3c2 fine' END"
_LOOK = f"""WITH {B.sql('alloys')}, {B.INTERFACE_SQL}, n AS (SELECT alloy_id, {_NAME} AS name, pred_lattice_param / sqrt(2e0) AS d FROM alloys)"""
_ORD = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(K.CERAMIC_INTERFACE))


@query("d17_fuzzy_mismatch", f"""{_LOOK}, m AS (SELECT alloy_id, d, neighbor, row_number() OVER (PARTITION BY alloy_id ORDER BY
  CASE WHEN phase = name THEN 0 WHEN upper(phase) = upper(name) THEN 1 ELSE 2 END, CASE phase {_ORD} END) AS rn
 FROM n LEFT JOIN interface ON phase = name OR upper(phase) = upper(name) OR contains(upper(name), upper(phase)) OR contains(upper(phase), upper(name)))
SELECT alloy_id, {rd('abs(d - coalesce(neighbor, 2906e-3)) / coalesce(neighbor, 2906e-3)', 'mismatch')} FROM m WHERE rn = 1""")
def d17(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("name", F.expr(_NAME))
    return _pick(a, mismatch=P.relative_gap(F.col("pred_lattice_param") / K.SQRT2, P.ceramic_neighbour("name")))


@query("d18_coherence", f"""{_LOOK}, m AS (SELECT alloy_id, abs(d - coalesce(lattice_a, 2906e-3)) / coalesce(lattice_a, 2906e-3) AS p FROM n LEFT JOIN interface ON upper(phase) = upper(name))
SELECT alloy_id, {rd('p', 'potential')}, p < 1e-2 AS coherent FROM m""")
def d18(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("name", F.expr(_NAME)).withColumn(
        "p", P.relative_gap(F.col("pred_lattice_param") / K.SQRT2, P.ceramic_lattice("name")))
    return a.select("alloy_id", r6("p").alias("potential"), (F.col("p") < 0.01).alias("coherent"))


_VR = B.values("vr", ("symbol", "rad"), list(K.VEGARD_RADII.items()))


@query("d19_vegard", f"""WITH {B.sql('alloys')}, alloys_re AS (SELECT alloy_id, {RHENIUM} AS f FROM alloys), {B.shares_sql('sh', 'alloys_re', 'alloy_id', 'f')}, {_VR},
v AS (SELECT alloy_id, 2 * sqrt(2e0) * sum(c * coalesce(rad, 13e-1)) AS a FROM sh LEFT JOIN vr ON symbol = el GROUP BY alloy_id)
SELECT alloy_id, {rd('a', 'vegard')}, {rd('abs(pred_lattice_param - a)', 'distortion')} FROM v JOIN alloys USING (alloy_id)""")
def d19(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("v", P.vegard_lattice(C.formula_shares(F.expr(RHENIUM))))
    return _pick(a, vegard=F.col("v"), distortion=F.abs(F.col("pred_lattice_param") - F.col("v")))


@query("d20_composite_modulus", f"""WITH {B.sql('alloys')}, v AS (SELECT alloy_id, bulk AS b, bulk * 3 AS c, binder_pct / 1e2 AS v FROM alloys)
SELECT alloy_id, {rd('v * b + (1 - v) * c', 'voigt')}, {rd('1 / (v / b + (1 - v) / c)', 'reuss')}, {rd('(v * b + (1 - v) * c) / 2', 'hs_ref')} FROM v""")
def d20(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("c", F.col("bulk") * 3)
    return _pick(a, **{m: P.composite_modulus("bulk", "c", "binder_pct", m) for m in ("voigt", "reuss", "hs_ref")})


@query("d21_basic_set", f"WITH {BASE}, {MEANS} SELECT alloy_id, {rd('s_r', 's_mix_r')}, {rd('vec', 'vec')}, {rd('delta', 'delta')} FROM mn JOIN sp USING (alloy_id)")
def d21(spark, sf):
    a = _alloys(spark, sf).select("alloy_id", O.basic_set().alias("b"))
    return _pick(a, s_mix_r=F.col("b.s_mix_r"), vec=F.col("b.vec"), delta=F.col("b.delta"))


CERMET = f"""cm AS (SELECT alloy_id, count(*) = count(rho) AS known, sum(c * mass) AS m, sum(c * mass / rho) AS v,
  coalesce(sum(CASE WHEN el IN {B.in_list(K.VOLUME_BINDERS)} THEN c * mass / rho END), 0) AS hv FROM j GROUP BY alloy_id),
cr AS (SELECT alloy_id, CASE WHEN known THEN hv / v END AS f, CASE WHEN known THEN m / v END AS dens FROM cm)"""


@query("d22_cermet_set", f"""WITH {BASE_RE}, {CERMET} SELECT alloy_id, {rd('f', 'binder_vol_frac')},
 {rd('CASE WHEN f IS NULL THEN NULL WHEN f > 0 AND f < 1 THEN 2 / 3e0 * f / (1 - f) * grain_size_um ELSE 0 END', 'free_path_um', 4)}, {rd('dens', 'density')}
FROM cr JOIN alloys USING (alloy_id)""")
def d22(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", P.cermet_set(C.formula_amounts(F.expr(RHENIUM)), "grain_size_um").alias("s"))
    return a.select("alloy_id", r6("s.binder_vol_frac").alias("binder_vol_frac"), r6("s.free_path_um", 4).alias("free_path_um"), r6("s.density").alias("density"))


_CARB = f"""cb AS (SELECT symbol, coalesce(nullif(k1.enthalpy, 0), nullif(k2.enthalpy, 0) / 2, nullif(k3.enthalpy, 0) / 3, 0) AS h FROM elements
 LEFT JOIN compounds k1 ON k1.formula = concat(symbol, 'C') LEFT JOIN compounds k2 ON k2.formula = concat(symbol, '2C') LEFT JOIN compounds k3 ON k3.formula = concat(symbol, '3C2'))"""


def binder_sql(temp):
    """Descriptor items over ``jb`` (alloy_id, el, c, constants) and ``alloys``."""
    return f"""{B.COMPOUNDS_SQL}, {_CARB},
b1 AS (SELECT alloy_id, sum(c * tm) AS ideal, sum(c * tm) - 50 * -sum(c * ln(c)) AS liq, sum(c * vec) AS vec, sum(c * shear) AS g, sum(c * cte) AS al, sum(c * wet) AS wet,
  coalesce(sum(CASE WHEN el IN {B.in_list(K.ACTIVE_ELEMENTS)} THEN c END), 0) AS act, count(CASE WHEN el IN ('Cr', 'V', 'Mo') THEN 1 END) AS nf, sum(c * cb.h) AS cdef
  FROM jb JOIN cb ON cb.symbol = el GROUP BY alloy_id),
b2 AS (SELECT alloy_id, sum(jb.c * coalesce(nullif(lattice, 0), CASE WHEN b1.vec >= 8 THEN r * 2 * sqrt(2e0) ELSE r * 4 / sqrt(3e0) END)) AS a FROM jb JOIN b1 USING (alloy_id) GROUP BY alloy_id),
bp AS (SELECT alloy_id, liq AS t_liquidus, ideal AS t_liquidus_ideal, ({temp} + 27315e-2) / liq AS t_homologous, (a - 2906e-3) / 2906e-3 * 100 AS mismatch_a, (a - 2837e-3) / 2837e-3 * 100 AS mismatch_c,
  abs(g - 283) AS shear_diff, abs(al - 52e-1) AS cte_diff, wet AS wettability, act AS active_sum,
  CAST(CASE WHEN vec BETWEEN 68e-1 AND 82e-1 THEN CASE WHEN nf > 0 THEN 2 ELSE 1 END ELSE 0 END AS INT) AS sigma_risk, cdef AS carbon_deficit
  FROM b1 JOIN b2 USING (alloy_id) JOIN alloys USING (alloy_id))"""


_BP = ("t_liquidus", "t_liquidus_ideal", "t_homologous", "mismatch_a", "mismatch_c", "shear_diff", "cte_diff", "wettability", "active_sum", "carbon_deficit")
CARBON = "concat(formula, CASE WHEN alloy_id % 2 = 0 THEN 'C3N' ELSE '' END)"


@query("d23_binder_physics", f"""WITH {B.sql('alloys')}, {B.ELEMENTS_SQL}, ac AS (SELECT alloy_id, {CARBON} AS f FROM alloys), {B.shares_sql('sh', 'ac', 'alloy_id', 'f')},
nb AS (SELECT alloy_id, el, c / sum(c) OVER (PARTITION BY alloy_id) AS c FROM sh WHERE el NOT IN ('C', 'N', 'B', 'O')), jb AS (SELECT nb.*, e.* FROM nb JOIN elements e ON symbol = el),
{binder_sql('sinter_temp_c')} SELECT alloy_id, sigma_risk, {', '.join(rd(c, c) for c in _BP)} FROM bp""")
def d23(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", P.binder_physics(C.formula_amounts(F.expr(CARBON)), "sinter_temp_c").alias("s"))
    return a.select("alloy_id", "s.sigma_risk", *[r6(f"s.{c}").alias(c) for c in _BP])


@query("d24_composite_hardness", f"""WITH {B.sql('alloys')}, w AS (SELECT alloy_id, 1600 + 600 / sqrt(grain_size_um) AS w, binder_pct / 1e2 AS f, shear * 5 AS h FROM alloys)
SELECT alloy_id, {rd('CASE WHEN h IS NOT NULL THEN w END', 'wc', 4)}, {rd('(1 - f) * w + f * h', 'linear', 4)}, {rd('pow(w, 1 - f) * pow(h, f)', 'geometric', 4)} FROM w""")
def d24(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", P.composite_hardness(F.col("shear") * 5, F.col("binder_pct") / 100, "grain_size_um").alias("s"))
    return a.select("alloy_id", *[r6(f"s.{c}", 4).alias(c) for c in ("wc", "linear", "geometric")])


@query("d25_batch_extended", f"""WITH {BASE}, {MEANS}, {PAIRS}, {CERMET}, jb AS (SELECT * FROM j), {binder_sql('sinter_temp_c')}
SELECT alloy_id, {rd('s_r', 's_mix_r')}, {rd('mn.vec', 'vec')}, {rd('delta', 'delta')}, {rd('h', 'h_mix')}, {rd('f', 'binder_vol_frac')}, {rd('dens', 'density')},
 {rd('t_liquidus', 't_liquidus')}, {rd('wettability', 'wettability')}, CAST(NULL AS VARCHAR) AS error
FROM mn JOIN sp USING (alloy_id) JOIN hm USING (alloy_id) JOIN cr USING (alloy_id) JOIN bp USING (alloy_id)
UNION ALL SELECT -1 - alloy_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Invalid Composition' FROM alloys""")
def d25(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", "formula", "grain_size_um", "sinter_temp_c")
    bad = a.withColumns({"alloy_id": -1 - F.col("alloy_id"), "formula": F.lit("not a formula")})
    out = O.batch_extended(a.unionByName(bad))
    return out.select(
        "alloy_id", "error", r6("basic.s_mix_r").alias("s_mix_r"), r6("basic.vec").alias("vec"), r6("basic.delta").alias("delta"),
        r6("h_mix").alias("h_mix"), r6("cermet.binder_vol_frac").alias("binder_vol_frac"), r6("cermet.density").alias("density"),
        r6("binder.t_liquidus").alias("t_liquidus"), r6("binder.wettability").alias("wettability"))


@query("d26_brittleness", f"""WITH {B.sql('alloys')}, p AS (SELECT alloy_id, CASE WHEN shear > 0 THEN bulk / shear END AS p FROM alloys)
SELECT alloy_id, {rd('p', 'pugh')}, {rd('1 / (1 + exp(2 * (p - 175e-2)))', 'brittleness')}, CASE WHEN p > 175e-2 THEN 'Ductile' WHEN p IS NOT NULL THEN 'Brittle' END AS label FROM p""")
def d26(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("p", P.pugh("bulk", "shear"))
    return a.select("alloy_id", r6("p").alias("pugh"), r6(P.brittleness("p")).alias("brittleness"), P.ductility("p").alias("label"))


@query("d27_fcc_lattice", f"WITH {B.sql('alloys')} SELECT alloy_id, {rd('cbrt(4 * volume_per_atom)', 'lattice')} FROM alloys")
def d27(spark, sf):
    return _pick(B.view(spark, sf, "alloys"), lattice=P.fcc_lattice("volume_per_atom"))


@query("d28_youngs_modulus", f"WITH {B.sql('alloys')} SELECT alloy_id, {rd('coalesce(CASE WHEN alloy_id % 4 = 0 THEN 300e0 END, 9 * bulk * shear / (3 * bulk + shear))', 'young')} FROM alloys")
def d28(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("e", F.expr("CASE WHEN alloy_id % 4 = 0 THEN 300D END"))
    return _pick(a, young=P.young_from_moduli("e", "bulk", "shear"))


@query("d29_volume_fractions", f"""WITH {BASE}, w AS (SELECT alloy_id, el, c * mass / rho AS v FROM j)
SELECT alloy_id, el, {rd('v / sum(v) OVER (PARTITION BY alloy_id) * (binder_pct / 1e2)', 'fraction')}, {rd('1 - binder_pct / 1e2', 'phase_ceramic')} FROM w JOIN alloys USING (alloy_id)""")
def d29(spark, sf):
    a = B.view(spark, sf, "alloys").withColumns({"m": C.formula_shares("formula"), "cv": 1 - F.col("binder_pct") / 100})
    v = O.volume_fractions(a, "m", "cv")
    return v.select("alloy_id", F.explode("element_volume").alias("el", "f"), "phase_ceramic").select(
        "alloy_id", "el", r6("f").alias("fraction"), r6("phase_ceramic").alias("phase_ceramic"))


@query("d30_thermo_set", f"WITH {BASE}, {MEANS}, {PAIRS} SELECT alloy_id, {rd('vec', 'vec')}, {rd('h', 'h_mix')}, {rd('s_r * 8314e-3', 's_mix')}, {rd('delta', 'delta_r')}, {rd('dchi', 'delta_chi')} FROM mn JOIN sp USING (alloy_id) JOIN hm USING (alloy_id)")
def d30(spark, sf):
    a = _alloys(spark, sf).select("alloy_id", O.thermo_set().alias("t"))
    return _pick(a, **{c: F.col(f"t.{c}") for c in ("vec", "h_mix", "s_mix", "delta_r", "delta_chi")})


_STRUCT = "st AS (SELECT alloy_id, CASE WHEN vec >= 8 THEN 2 * sqrt(2e0) * rbar ELSE 4 * rbar / sqrt(3e0) END AS a FROM mn), ct AS (SELECT alloy_id, sum(c * coalesce(cte, 12)) AS al FROM j GROUP BY alloy_id)"


@query("d31_structure_set", f"WITH {BASE_RE}, {MEANS.replace('c * r)', 'c * coalesce(r, 0))')}, {_STRUCT} SELECT alloy_id, {rd('a', 'lattice_est')}, {rd('abs(a - 2906e-3) / 2906e-3', 'lattice_mismatch')}, {rd('al', 'cte_binder')}, {rd('abs(al - 52e-1)', 'cte_mismatch')} FROM st JOIN ct USING (alloy_id)")
def d31(spark, sf):
    a = _rhenium(spark, sf).select("alloy_id", O.structure_set("rows", F.lit(2.906), F.lit(5.2)).alias("s"))
    return _pick(a, **{c: F.col(f"s.{c}") for c in ("lattice_est", "lattice_mismatch", "cte_binder", "cte_mismatch")})


_PROC = f"""{_STRUCT}, pr AS (SELECT alloy_id, tm - 150 * (s_r * 8314e-3 / 133e-1) AS liq FROM mn),
ho AS (SELECT alloy_id, liq, CASE WHEN liq > 0 THEN (sinter_temp_c + 27315e-2) / liq ELSE 0 END AS th FROM pr JOIN alloys USING (alloy_id)),
he AS (SELECT alloy_id, 1600 + 50 * delta - greatest(0, (95e-2 - th) * 2000) - greatest(0, (vec - 85e-1) * 300) AS hv,
  10 + 5 * greatest(0, 1 - abs(vec - 82e-1)) - 20 * (abs(a - 2906e-3) / 2906e-3) AS kic FROM ho JOIN mn USING (alloy_id) JOIN sp USING (alloy_id) JOIN st USING (alloy_id))"""


def scored(a, rows="rows", temp="sinter_temp_c"):
    """Heuristic hardness and toughness of candidates (columns hv, kic)."""
    a = a.withColumns({
        "t": pinned(O.thermo_set(rows)), "s": pinned(O.structure_set(rows, F.lit(K.WC["a"]), F.lit(K.WC["cte"]))),
        "p": pinned(O.process_set(rows, temp)),
    })
    return a.withColumns({
        "hv": P.heuristic_hardness("t.vec", "t.delta_r", "p.t_homologous"),
        "kic": P.heuristic_toughness("t.vec", "s.lattice_mismatch"),
    })


@query("d32_process_set", f"WITH {BASE}, {MEANS}, {_PROC} SELECT alloy_id, {rd('liq', 't_liquidus')}, {rd('th', 't_homologous')}, {rd('hv', 'hv')}, {rd('kic', 'kic')} FROM ho JOIN he USING (alloy_id)")
def d32(spark, sf):
    a = scored(_alloys(spark, sf))
    return _pick(a, t_liquidus=F.col("p.t_liquidus"), t_homologous=F.col("p.t_homologous"), hv=F.col("hv"), kic=F.col("kic"))


@query("d33_elastic_labels", f"WITH {BASE_RE} SELECT alloy_id, {rd('sum(c * bulk)', 'bulk')}, {rd('sum(c * shear)', 'shear')}, {rd('sum(c * bulk) / nullif(sum(c * shear), 0)', 'pugh')} FROM j GROUP BY alloy_id")
def d33(spark, sf):
    a = _rhenium(spark, sf).select("alloy_id", O.elastic_set().alias("e"))
    return _pick(a, **{c: F.col(f"e.{c}") for c in ("bulk", "shear", "pugh")})


@query("d34_free_paths", f"""WITH {B.sql('alloys')}, x AS (SELECT alloy_id, grain_size_um AS d, binder_pct AS b, binder_pct / 1e2 AS f FROM alloys)
SELECT alloy_id, {rd('CASE WHEN f > 0 AND f < 1 THEN 2 / 3e0 * f / (1 - f) * d ELSE 0 END', 'exner')}, {rd('d * f / (1 - f + 1e-6)', 'guarded')}, {rd('d / (b + 1)', 'percent')},
 {rd('CASE WHEN f > 0 AND f < 1 THEN d * f / (1 - f) ELSE d * 5e-1 END', 'model')} FROM x""")
def d34(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("f", F.col("binder_pct") / 100)
    return _pick(a, exner=P.free_path("exner", "grain_size_um", "f"), guarded=P.free_path("guarded", "grain_size_um", "f"),
                 percent=P.free_path("percent", "grain_size_um", "binder_pct"), model=P.free_path("model", "grain_size_um", "f"))


def _statistics_sql(prefix, rows):
    """All statistics of all element properties; NULL where an element lacks the property."""
    known = lambda p, e: f"CASE WHEN count({p}) = count(*) THEN {e} END"
    part = lambda p: ", ".join((
        f"{known(p, f'min({p})')} AS {prefix}_min_{p}", f"{known(p, f'max({p})')} AS {prefix}_max_{p}",
        rd(known(p, f"max({p}) - min({p})"), f"{prefix}_range_{p}"), rd(known(p, f"sum(c * {p})"), f"{prefix}_mean_{p}"),
        rd(known(p, f"sum(c * abs({p} - m_{p}))"), f"{prefix}_avg_dev_{p}"), f"{known(p, f'arg_min({p}, (-c, {p}))')} AS {prefix}_mode_{p}"))
    means = ", ".join(f"sum(c * {p}) AS m_{p}" for p in K.ELEMENT_FIELDS)
    return (f"{prefix}_m AS (SELECT alloy_id, {means} FROM {rows} GROUP BY alloy_id), "
            f"{prefix}_s AS (SELECT alloy_id, {', '.join(map(part, K.ELEMENT_FIELDS))} FROM {rows} JOIN {prefix}_m USING (alloy_id) GROUP BY alloy_id)")


@query("d35_property_statistics", f"""WITH {BASE}, {B.shares_sql('csh', 'alloys', 'alloy_id', 'ceramic')}, cj AS (SELECT csh.alloy_id, el, c, e.* FROM csh LEFT JOIN elements e ON symbol = el),
{_statistics_sql('b', 'j')}, {_statistics_sql('c', 'cj')} SELECT * FROM b_s JOIN c_s USING (alloy_id)""")
def d35(spark, sf):
    """Both phases, all properties."""
    a = _alloys(spark, sf).select("alloy_id", "rows", P.element_rows(C.formula_shares("ceramic")).alias("ceramic_rows"))
    for rows, prefix in (("rows", "b"), ("ceramic_rows", "c")):
        a = O.statistics_columns(a, rows, K.ELEMENT_FIELDS, prefix)
    a = a.drop("rows", "ceramic_rows")
    exact = tuple(f"{p}_{s}" for p in "bc" for s in ("min", "max", "mode"))
    return a.select("alloy_id", *[c if c.startswith(exact) else r6(c).alias(c) for c in a.columns if c != "alloy_id"])


@query("d36_phase_statistics", f"""WITH {BASE}, {MEANS}, {B.shares_sql('cs', 'alloys', 'alloy_id', 'ceramic')},
cj AS (SELECT cs.alloy_id, c, e.* FROM cs JOIN elements e ON symbol = el), cm AS (SELECT alloy_id, sum(c * mass) AS mass, sum(c * chi) AS xb, min(number) AS z FROM cj GROUP BY alloy_id),
cd AS (SELECT alloy_id, sqrt(sum(c * pow(chi - xb, 2))) AS dx FROM cj JOIN cm USING (alloy_id) GROUP BY alloy_id), bm AS (SELECT alloy_id, sum(c * mass) AS bmass FROM j GROUP BY alloy_id)
SELECT alloy_id, {rd('bmass', 'binder_mass')}, {rd('dchi', 'binder_std_chi')}, {rd('cm.mass', 'ceramic_mass')}, {rd('dx', 'ceramic_std_chi')}, z AS ceramic_min_number
FROM sp JOIN bm USING (alloy_id) JOIN cm USING (alloy_id) JOIN cd USING (alloy_id)""")
def d36(spark, sf):
    a = _alloys(spark, sf).withColumn("q", P.formula_rows("ceramic"))
    q = F.col("q")
    return _pick(a, F.array_min(F.transform(q, lambda x: x["p"]["number"])).alias("ceramic_min_number"), binder_mass=P.weighted(R, "mass"), binder_std_chi=P.chi_spread(R),
                 ceramic_mass=P.weighted(q, "mass"), ceramic_std_chi=P.chi_spread(q))


@query("d37_stoichiometry", f"""WITH {B.sql('alloys')}, {B.shares_sql('sh', 'alloys', 'alloy_id', 'formula')} SELECT alloy_id, CAST(count(*) AS DOUBLE) AS norm0, {rd('sqrt(sum(c * c))', 'norm2')},
 {rd('pow(sum(pow(c, 3)), 1 / 3e0)', 'norm3')}, {rd(f"coalesce(sum(CASE WHEN el IN {B.in_list(K.TRANSITION_METALS)} THEN c END), 0)", 'tm_share')}, {rd("coalesce(sum(CASE WHEN el = 'Al' THEN c END), 0)", 'al_share')} FROM sh GROUP BY alloy_id""")
def d37(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("m", C.formula_shares("formula"))
    m = F.col("m")
    return _pick(a, norm0=P.norm(m, 0), norm2=P.norm(m, 2), norm3=P.norm(m, 3), tm_share=P.transition_share(m),
                 al_share=F.coalesce(F.try_element_at(m, F.lit("Al")), F.lit(0.0)))


@query("d38_property_ranges", f"WITH {BASE} SELECT alloy_id, max(number) - min(number) AS diff_number, {rd('max(chi) - min(chi)', 'diff_chi')} FROM j GROUP BY alloy_id")
def d38(spark, sf):
    return _pick(_alloys(spark, sf), P.property_range(R, "number").alias("diff_number"), diff_chi=P.property_range(R, "chi"))


_VEC_BASE = f"""WITH {BASE}, {B.values('ml', ('phase', 'a0'), list(K.MODEL_LATTICE.items()))},
ms AS (SELECT alloy_id, el, c * mass / sum(c * mass) OVER (PARTITION BY alloy_id) AS w FROM j),
f AS (SELECT alloy_id, coalesce(sum(CASE WHEN el = 'Ni' THEN c END), 0) AS ni, coalesce(sum(CASE WHEN el = 'Nb' THEN c END), 0) AS nb, CAST(count(CASE WHEN c > 1e-2 THEN 1 END) AS DOUBLE) AS n,
 sqrt(sum(c * c)) AS n2, max(number) - min(number) AS dz, max(chi) - min(chi) AS dx, max(grp) - min(grp) AS dg, sum(c * period) AS pm, max(tm) - min(tm) AS dt,
 coalesce(sum(CASE WHEN el IN {B.in_list(K.TRANSITION_METALS)} THEN c END), 0) AS tms FROM j GROUP BY alloy_id),
fe AS (SELECT alloy_id, coalesce(sum(CASE WHEN el = 'Fe' THEN w END), 0) AS fe FROM ms GROUP BY alloy_id),
lm AS (SELECT alloy_id, abs(pred_lattice_param / sqrt(2e0) - coalesce(a0, 2906e-3)) / coalesce(a0, 2906e-3) AS mis FROM alloys LEFT JOIN ml ON phase = ceramic)"""


#: surrogate outputs that are part of both vectors
SURROGATES = ("pred_formation_energy", "pred_lattice_param", "pred_magnetic_moment")


@query("d39_hardness_vector", f"""{_VEC_BASE} SELECT alloy_id, grain_size_um AS grain_um, binder_pct AS binder_vol_pct, {rd('ni', 'ni_share')}, {rd('nb', 'nb_share')}, {rd('fe', 'fe_mass')}, n AS element_count, {rd('n2', 'norm2')}, pred_formation_energy, pred_lattice_param, pred_magnetic_moment,
 dz AS diff_number, {rd('dx', 'diff_chi')}, dg AS range_group, {rd('pm', 'mean_period')}, {rd('mis', 'lattice_mismatch_wc')}, {rd('n * dx', 'interface_complexity')}
FROM alloys JOIN f USING (alloy_id) JOIN fe USING (alloy_id) JOIN lm USING (alloy_id)""")
def d39(spark, sf):
    v = O.hardness_vector(B.view(spark, sf, "alloys"))
    plain = ("grain_um", "binder_vol_pct", "element_count", "diff_number", "range_group", *SURROGATES)
    rounded = ("ni_share", "nb_share", "fe_mass", "norm2", "diff_chi", "mean_period", "lattice_mismatch_wc", "interface_complexity")
    return v.select("alloy_id", *plain, *[r6(c).alias(c) for c in rounded])


@query("d40_toughness_vector", f"""{_VEC_BASE} SELECT alloy_id, {rd('ni', 'ni_share')}, {rd('tms', 'tm_share')}, {rd('dt', 'range_tm')}, grain_size_um AS grain_um, binder_pct AS binder_vol_pct, sinter_temp_c AS temp_c, pred_formation_energy, pred_lattice_param, pred_magnetic_moment,
 {rd('mis', 'lattice_mismatch_wc')}, {rd('CASE WHEN binder_pct > 0 AND binder_pct < 100 THEN grain_size_um * (binder_pct / 1e2) / (1 - binder_pct / 1e2) ELSE grain_size_um * 5e-1 END', 'free_path')}
FROM alloys JOIN f USING (alloy_id) JOIN lm USING (alloy_id)""")
def d40(spark, sf):
    v = O.toughness_vector(B.view(spark, sf, "alloys"))
    return v.select("alloy_id", "grain_um", "binder_vol_pct", "temp_c", *SURROGATES, *[r6(c).alias(c) for c in ("ni_share", "tm_share", "range_tm", "lattice_mismatch_wc", "free_path")])


# Injection over runs: features per distinct composition, per-row surrogates.
INJECT = f"""{B.sql('runs')}, {B.ELEMENTS_SQL}, fm AS (SELECT DISTINCT formula FROM runs), {B.shares_sql('sh', 'fm', 'formula', 'formula').replace('SELECT formula, unnest', 'SELECT formula AS alloy_id, unnest').replace('SELECT formula, el', 'SELECT alloy_id, el').replace('GROUP BY formula', 'GROUP BY alloy_id').replace('PARTITION BY formula', 'PARTITION BY alloy_id')},
j AS (SELECT sh.alloy_id, el, c, e.* FROM sh JOIN elements e ON symbol = el), {MEANS}, {PAIRS}, {_VR}, {B.INTERFACE_SQL},
vg AS (SELECT alloy_id, 2 * sqrt(2e0) * sum(c * coalesce(rad, 13e-1)) AS av FROM sh LEFT JOIN vr ON symbol = el GROUP BY alloy_id),
bm AS (SELECT alloy_id, sum(c * mass) AS mm FROM j GROUP BY alloy_id), cf AS (SELECT DISTINCT ceramic FROM runs), {B.shares_sql('cs', 'cf', 'ceramic', 'ceramic')},
cm AS (SELECT ceramic, sum(c * mass) AS cmass, sum(c * chi) AS cx, min(number) AS cz FROM cs JOIN elements ON symbol = el GROUP BY ceramic),
cd AS (SELECT ceramic, sqrt(sum(c * pow(chi - cx, 2))) AS cdx FROM cs JOIN elements ON symbol = el JOIN cm USING (ceramic) GROUP BY ceramic),
inj AS (SELECT run_id, grain_size_um, pred_formation_energy, cbrt(4 * volume_per_atom) AS lat, pred_magnetic_moment, neighbor, lattice_a, mn.vec, mm, dchi, cmass, cdx, cz, delta, av,
  CASE WHEN abs(h) >= 1e-4 THEN tm * s_r * 8314e-3 / (abs(h) * 1000) END AS omega
  FROM runs JOIN mn ON mn.alloy_id = formula JOIN sp ON sp.alloy_id = formula JOIN hm ON hm.alloy_id = formula JOIN vg ON vg.alloy_id = formula JOIN bm ON bm.alloy_id = formula
  JOIN cm USING (ceramic) JOIN cd USING (ceramic) LEFT JOIN interface ON phase = ceramic)"""
_INJ = f"""SELECT run_id, {rd('pred_formation_energy', 'pred_formation_energy')}, {rd('lat', 'pred_lattice_param')}, {rd('pred_magnetic_moment', 'pred_magnetic_moment')},
 {rd('abs(lat / sqrt(2e0) - neighbor) / neighbor', 'lattice_mismatch')}, {rd('abs(lat / sqrt(2e0) - lattice_a) / lattice_a', 'coherent_potential')}, abs(lat / sqrt(2e0) - lattice_a) / lattice_a < 1e-2 AS is_coherent,
 {rd('abs(lat - av)', 'lattice_distortion')}, {rd('vec', 'vec_binder')}, {rd('mm', 'mean_mass')}, {rd('dchi', 'std_chi')}, {rd('cmass', 'ceramic_mean_mass')}, {rd('cdx', 'ceramic_std_chi')},
 cz AS ceramic_min_number, {rd('delta', 'delta')}, {rd('omega', 'omega')} FROM inj"""


def _show(df):
    keep = ("is_coherent", "ceramic_min_number")
    return df.select("run_id", *keep, *[r6(c).alias(c) for c in O.INJECTED if c not in keep])


@query("d41_inject_features", f"WITH {INJECT} {_INJ}")
def d41(spark, sf):
    return _show(O.inject_features(B.view(spark, sf, "runs", heavy=True)))


@query("d42_surrogate_defaults", f"""WITH {B.sql('alloys')} SELECT alloy_id, coalesce(CASE WHEN alloy_id % 3 > 0 THEN pred_formation_energy END, -5e-1) AS pred_formation_energy,
 coalesce(CASE WHEN alloy_id % 4 > 0 THEN pred_lattice_param END, 36e-1) AS pred_lattice_param, coalesce(CASE WHEN alloy_id % 5 > 0 THEN pred_magnetic_moment END, 5e-1) AS pred_magnetic_moment FROM alloys""")
def d42(spark, sf):
    a = B.view(spark, sf, "alloys")
    gaps = {"pred_formation_energy": 3, "pred_lattice_param": 4, "pred_magnetic_moment": 5}
    return a.select("alloy_id", *[
        F.coalesce(F.when(F.col("alloy_id") % n > 0, F.col(c)), F.lit(K.PROXY_DEFAULTS[c])).alias(c) for c, n in gaps.items()])


@query("d43_interface_complexity", f"WITH {BASE} SELECT alloy_id, {rd('count(CASE WHEN c > 1e-2 THEN 1 END) * (max(chi) - min(chi))', 'interface_complexity')} FROM j GROUP BY alloy_id")
def d43(spark, sf):
    return _pick(O.hardness_vector(B.view(spark, sf, "alloys")), interface_complexity=F.col("interface_complexity"))


@query("e27_distinct_then_join", f"WITH {INJECT} SELECT run_id, {rd('vec', 'vec')}, {rd('delta', 'delta')}, {rd('omega', 'omega')} FROM inj")
def e27(spark, sf):
    """Composition features once per distinct formula, joined back to the rows."""
    def once(df):
        d = O.with_rows(df).withColumns({"h": P.enthalpy(R), "s": P.entropy(R), "tm": P.weighted(R, "tm")})
        return d.select("formula", P.vec(R).alias("vec"), P.size_mismatch(R).alias("delta"), P.omega(F.col("tm"), F.col("s"), F.col("h")).alias("omega"))

    runs = B.view(spark, sf, "runs", heavy=True).select("run_id", "formula")
    out = O.per_distinct(runs, "formula", once)
    return _pick(out, key="run_id", vec=F.col("vec"), delta=F.col("delta"), omega=F.col("omega"))


@query("flagship_top_alloys", f"""WITH {BASE}, {MEANS}, {PAIRS} SELECT alloy_id, formula, {rd('s_r * 8314e-3', 's_mix')}, {rd('vec', 'vec')}, {rd('h', 'h_mix')}
FROM mn JOIN hm USING (alloy_id) JOIN alloys USING (alloy_id) ORDER BY round(s_r * 8314e-3, 6) DESC, alloy_id LIMIT 20""")
def flagship(spark, sf):
    a = _alloys(spark, sf)
    out = _pick(a, "formula", s_mix=P.entropy(R), vec=P.vec(R), h_mix=P.enthalpy(R))
    return out.orderBy(F.desc("s_mix"), "alloy_id").limit(20)


