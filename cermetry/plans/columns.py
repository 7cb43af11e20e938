"""Registered queries: schema standardisation, projection, predicates."""

from pyspark.sql import functions as F

from cermetry.functions import constants as K
from cermetry.functions.common import r6
from cermetry.functions.composition import formula_amounts, formula_shares
from cermetry.operators import columns as C
from cermetry.plans import bridge as B
from cermetry.plans.registry import query
from cermetry.sources import dims

ALLOY_SHARES = f"{B.sql('alloys')}, {B.shares_sql('sh', 'alloys', 'alloy_id', 'formula')}"
MISSING = B.in_list(K.MISSING_TOKENS)


@query("b1_standardize_names", f"""WITH {B.sql('sheet')} SELECT row_id, composition AS binder_composition, hv_text AS hardness,
 kic_text AS toughness, temp_text AS sinter_temp, grain AS grain_size, grp FROM sheet""")
def b1(spark, sf):
    raw = B.view(spark, sf, "sheet").selectExpr(
        "row_id", "composition AS `Composition`", "hv_text AS `Hardness HV`", "kic_text AS `KIC `",
        "temp_text AS `Temperature`", "grain AS `Grain_Size_um`", "grp",
    )
    return C.standardize_columns(raw)


@query("b2_bilingual_names", f"""WITH {B.sql('sheet')} SELECT row_id, composition AS composition_raw, hv_text AS hv,
 kic_text AS kic, temp_text AS sinter_temp_c, grain AS grain_size_um, grp AS group_id FROM sheet""")
def b2(spark, sf):
    raw = B.view(spark, sf, "sheet").selectExpr(
        "row_id", "composition AS `成分`", "hv_text AS `HV, kgf/mm2`", "kic_text AS `断裂韧性`",
        "temp_text AS `T, °C`", "grain AS `d, mm`", "grp AS `Group`",
    )
    return C.map_columns(raw)


@query("b3_find_column", f"WITH {B.sql('sheet')} SELECT row_id, hv_text AS hardness_col, composition AS comp_col FROM sheet")
def b3(spark, sf):
    df = B.view(spark, sf, "sheet")
    hv, comp = C.find_column(df.columns, ["hardness", "hv"]), C.find_column(df.columns, ["comp"])
    return df.select("row_id", F.col(hv).alias("hardness_col"), F.col(comp).alias("comp_col"))


_B4 = "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END"
_B4B = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS DOUBLE) END"
_B4C = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END"


@query("b4_merge_columns", f"""WITH t AS (SELECT o_orderkey AS id, {_B4} AS a, {_B4B} AS b, {_B4C} AS c FROM orders),
l AS (SELECT id, a AS v FROM t UNION ALL SELECT id, b FROM t UNION ALL SELECT id, c FROM t),
n AS (SELECT id, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL),
m AS (SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY n DESC, v) AS rn FROM n) WHERE rn = 1),
av AS (SELECT id, avg(v) AS mean_v FROM l GROUP BY id)
SELECT t.id, coalesce(a, b, c) AS first_v, coalesce(c, b, a) AS last_v, round(mean_v, 6) + 0e0 AS mean_v, m.v AS mode_v
FROM t JOIN av USING (id) LEFT JOIN m USING (id)""")
def b4(spark, sf):
    t = B.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_B4} AS a", f"{_B4B} AS b", f"{_B4C} AS c")
    for how in ("first", "last", "mean", "mode"):
        copies = t.withColumns({f"{k}_{how}": F.col(k) for k in "abc"})
        t = C.merge_columns(copies, f"{how}_v", [f"{k}_{how}" for k in "abc"], how)
    return t.select("id", "first_v", "last_v", r6("mean_v").alias("mean_v"), "mode_v")


@query("b5_column_conflicts", f"""WITH {B.sql('experiments')} SELECT exp_id, coalesce(sinter_temp_c, 14e2) AS filled,
 14e2 AS replaced, sinter_temp_c AS kept, sinter_temp_c AS base, 14e2 AS base_new FROM experiments""")
def b5(spark, sf):
    df = B.view(spark, sf, "experiments").selectExpr(
        "exp_id", "sinter_temp_c AS filled", "sinter_temp_c AS replaced", "sinter_temp_c AS kept", "sinter_temp_c AS base"
    )
    new = F.lit(1400.0)
    df = C.add_columns(df, {"filled": new}, "fill")
    df = C.add_columns(df, {"replaced": new}, "replace")
    df = C.add_columns(df, {"kept": new}, "keep")
    return C.add_columns(df, {"base": new}, "suffix")


def _num(c):
    return f"CASE WHEN isnan(TRY_CAST(trim({c}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({c}) AS DOUBLE) END"


@query("b6_coerce_types", f"WITH {B.sql('sheet')} SELECT row_id, {_num('trs_text')} AS trs_text, {_num('kic_text')} AS kic_text, {_num('temp_text')} AS temp_text, {_num('grain')} AS grain FROM sheet")
def b6(spark, sf):
    df = B.view(spark, sf, "sheet").select("row_id", "trs_text", "kic_text", "temp_text", "grain")
    return C.coerce_numeric(df, ["trs_text", "kic_text", "temp_text", "grain"])


@query("b7_missing_tokens", f"""WITH {B.sql('sheet')} SELECT row_id, CASE WHEN trim(method) IN {MISSING} THEN NULL ELSE trim(method) END AS method,
 CASE WHEN trim(trs_text) IN {MISSING} THEN NULL ELSE TRY_CAST(trim(trs_text) AS DOUBLE) END AS trs FROM sheet""")
def b7(spark, sf):
    return B.view(spark, sf, "sheet").select(
        "row_id", C.clean_missing("method").alias("method"), C.clean_number("trs_text").alias("trs")
    )


@query("b8_clean_numbers", f"""WITH {B.sql('sheet')} SELECT row_id, {_num("replace(hv_text, ',', '')")} AS hv, {_num("replace(kic_text, ',', '')")} AS kic FROM sheet""")
def b8(spark, sf):
    return B.view(spark, sf, "sheet").select("row_id", C.measure("hv_text").alias("hv"), C.measure("kic_text").alias("kic"))


@query("b9_number_defaults", f"""WITH {B.sql('sheet')} SELECT row_id, coalesce({_num('temp_text')}, 14e2) AS temp, coalesce({_num('grain')}, 1e0) AS grain FROM sheet""")
def b9(spark, sf):
    return B.view(spark, sf, "sheet").select(
        "row_id", C.number_or("temp_text", 1400).alias("temp"), C.number_or("grain", 1.0).alias("grain")
    )


@query("b10_field_ranges", f"""WITH {B.sql('properties')}, l AS (SELECT exp_id, 'hv' AS field, hv * 2 AS v, 0 AS lo, 5000 AS hi FROM properties
 UNION ALL SELECT exp_id, 'kic', kic * 3, 0, 50 FROM properties UNION ALL SELECT exp_id, 'trs', trs * 4, 0, 10000 FROM properties)
SELECT exp_id, field, v AS value, coalesce(v >= lo AND v <= hi, true) AS valid,
 CASE WHEN v < lo OR v > hi THEN concat(field, ' outside [', lo, ', ', hi, ']') END AS message FROM l""")
def b10(spark, sf):
    p = B.view(spark, sf, "properties").selectExpr("exp_id", "hv * 2 AS hv", "kic * 3 AS kic", "trs * 4 AS trs")
    checked = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), C.field_check(n, n).alias("c")) for n in ("hv", "kic", "trs")
    ])
    return p.select("exp_id", F.explode(checked).alias("f")).select("exp_id", "f.field", "f.value", "f.c.valid", "f.c.message")


@query("b11_target_discovery", f"""WITH {B.sql('properties')}, n AS (SELECT count(*) AS n, count(hv) AS hv, count(kic) AS kic, count(trs) AS trs FROM properties),
l AS (SELECT 'hv' AS target, hv AS valid, n FROM n UNION ALL SELECT 'kic', kic, n FROM n UNION ALL SELECT 'trs', trs, n FROM n)
SELECT target, valid FROM l WHERE valid >= 10 AND 1 - valid / n < 5e-1""")
def b11(spark, sf):
    p = B.view(spark, sf, "properties")
    good = C.usable_targets(p, ["hv", "kic", "trs"])
    return p.agg(*[F.count(c).alias(c) for c in good]).unpivot([], good, "target", "valid")


@query("b12_composition_checks", f"""WITH {ALLOY_SHARES},
x AS (SELECT alloy_id, el, CASE WHEN alloy_id % 7 = 0 THEN c * 103 / 100 WHEN alloy_id % 11 = 0 AND el = 'Co' THEN -c ELSE c END AS c FROM sh)
SELECT alloy_id, array_to_string(list_filter([CASE WHEN count(*) > 10 THEN 'too_many_elements' END,
  CASE WHEN min(c) < 0 THEN 'negative_share' END, CASE WHEN max(c) > 1 THEN 'share_above_one' END,
  CASE WHEN sum(c) < 99e-2 OR sum(c) > 101e-2 THEN 'total_off' END], lambda e: e IS NOT NULL), ',') AS errors,
 CASE WHEN min(c) < 1e-3 THEN 'trace_share' ELSE '' END AS warnings FROM x GROUP BY alloy_id""")
def b12(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("m", formula_shares("formula"))
    bad = F.transform_values("m", lambda k, v: (
        F.when(F.col("alloy_id") % 7 == 0, v * 103 / 100)
        .when((F.col("alloy_id") % 11 == 0) & (k == "Co"), -v).otherwise(v)))
    a = a.withColumn("m", bad)
    return a.select(
        "alloy_id", F.array_join(C.composition_errors(F.col("m")), ",").alias("errors"),
        F.array_join(C.composition_warnings(F.col("m")), ",").alias("warnings"),
    )


@query("b13_composition_ok", f"""WITH {ALLOY_SHARES}, x AS (SELECT alloy_id, CASE WHEN alloy_id % 4 = 0 THEN c * 9e-1 ELSE c END AS c FROM sh)
SELECT alloy_id, abs(sum(c) - 1) <= 1e-2 AND min(c) > 0 AS ok FROM x GROUP BY alloy_id""")
def b13(spark, sf):
    a = B.view(spark, sf, "alloys").withColumn("m", formula_shares("formula"))
    m = F.transform_values("m", lambda _, v: F.when(F.col("alloy_id") % 4 == 0, v * 0.9).otherwise(v))
    return a.select("alloy_id", C.composition_ok(m).alias("ok"))


@query("b14_design_checks", f"""WITH d AS (SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) / 100 AS v, CAST(p_partkey % 600 AS DOUBLE) / 10 AS g,
 CAST(950 + p_partkey % 900 AS DOUBLE) AS t, CAST(p_partkey % 700 AS DOUBLE) AS m FROM part)
SELECT id, array_to_string(list_filter([CASE WHEN NOT v BETWEEN 0 AND 95e-2 THEN 'ceramic_vol_fraction' END, CASE WHEN NOT g BETWEEN 1e-1 AND 50 THEN 'grain_size_um' END,
 CASE WHEN NOT t BETWEEN 1000 AND 1800 THEN 'sinter_temp_c' END, CASE WHEN NOT m BETWEEN 10 AND 600 THEN 'sinter_time_min' END], lambda e: e IS NOT NULL), ',') AS errors,
 array_to_string(list_filter([CASE WHEN NOT v BETWEEN 4e-1 AND 8e-1 THEN 'ceramic_vol_fraction' END, CASE WHEN NOT g BETWEEN 5e-1 AND 5 THEN 'grain_size_um' END,
 CASE WHEN NOT t BETWEEN 1350 AND 1550 THEN 'sinter_temp_c' END], lambda e: e IS NOT NULL), ',') AS warnings FROM d""")
def b14(spark, sf):
    d = B.table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "CAST(p_partkey % 100 AS DOUBLE) / 100 AS v", "CAST(p_partkey % 600 AS DOUBLE) / 10 AS g",
        "CAST(950 + p_partkey % 900 AS DOUBLE) AS t", "CAST(p_partkey % 700 AS DOUBLE) AS m",
    )
    errors, warnings = C.design_issues(
        {"ceramic_vol_fraction": "v", "grain_size_um": "g", "sinter_temp_c": "t", "sinter_time_min": "m"}
    )
    return d.select("id", F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"))


_RANGES = B.values("ranges", ("metric", "lo", "hi", "tlo", "thi"), [(m, *v) for m, v in K.PREDICTION_RANGES.items()])


@query("b15_prediction_checks", f"""WITH {B.sql('properties', 'proxies')}, {_RANGES},
l AS (SELECT exp_id, 'HV' AS metric, hv AS value FROM properties WHERE hv IS NOT NULL UNION ALL SELECT exp_id, 'KIC', kic FROM properties
 UNION ALL SELECT exp_id, 'pred_lattice_param', pred_lattice_param FROM proxies)
SELECT exp_id, metric, value, CASE WHEN value < lo OR value > hi THEN 'out_of_range' WHEN value < tlo OR value > thi THEN 'atypical' ELSE 'ok' END AS verdict
FROM l LEFT JOIN ranges USING (metric)""")
def b15(spark, sf):
    p = B.view(spark, sf, "properties").selectExpr("exp_id", "hv AS HV", "kic AS KIC").unpivot(
        "exp_id", ["HV", "KIC"], "metric", "value").filter("value IS NOT NULL")
    q = B.view(spark, sf, "proxies").unpivot("exp_id", ["pred_lattice_param"], "metric", "value")
    return C.check_predictions(p.unionByName(q), dims.prediction_ranges(spark)).select("exp_id", "metric", "value", "verdict")


@query("b16_select_columns", f"""WITH {B.sql('proxies')} SELECT pred_formation_energy, pred_lattice_param, pred_magnetic_moment, pred_bulk_modulus, pred_shear_modulus, exp_id FROM proxies""")
def b16(spark, sf):
    return C.select_columns(B.view(spark, sf, "proxies"), prefix="pred_", names=["exp_id"])


@query("b17_preview", f"WITH {B.sql('alloys')} SELECT alloy_id, formula FROM alloys ORDER BY alloy_id LIMIT 10")
def b17(spark, sf):
    return C.preview(B.view(spark, sf, "alloys").select("alloy_id", "formula"), "alloy_id")


@query("b18_percent_parts", f"""WITH {B.sql('experiments')} SELECT exp_id, round((load_kgf * 5) / 1e2, 6) + 0e0 AS fraction, 100 - load_kgf * 5 AS complement,
 greatest(0e0, least(100e0, load_kgf * 5)) AS clamped FROM experiments""")
def b18(spark, sf):
    e = B.view(spark, sf, "experiments").selectExpr("exp_id", "load_kgf * 5 AS pct")
    parts = C.percent_parts("pct")
    return e.select("exp_id", r6(parts["fraction"]).alias("fraction"), parts["complement"].alias("complement"), parts["clamped"].alias("clamped"))


@query("b19_display", f"""WITH {B.sql('experiments')} SELECT exp_id, coalesce(substring(raw_composition, 1, 60), '') AS composition,
 CASE WHEN grain_size_um < 1 THEN 'Yes' ELSE 'No' END AS fine, coalesce(sinter_method, '') AS method FROM experiments""")
def b19(spark, sf):
    return B.view(spark, sf, "experiments").select(
        "exp_id", C.display_text("raw_composition").alias("composition"),
        C.yes_no(F.col("grain_size_um") < 1).alias("fine"), C.display_text("sinter_method").alias("method"),
    )


@query("b20_timestamps", f"WITH {B.sql('activity')} SELECT log_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM activity")
def b20(spark, sf):
    return B.view(spark, sf, "activity").select("log_id", C.minute_stamp("ts").alias("stamp"))


@query("b21_filters", f"""WITH {B.sql('experiments', 'properties')} SELECT exp_id, raw_composition, hv, kic FROM experiments JOIN properties USING (exp_id)
WHERE sinter_method = 'Vacuum' AND hv BETWEEN 800 AND 2000 AND kic >= 6 AND sinter_temp_c IS NOT NULL AND raw_composition ILIKE '%co%'""")
def b21(spark, sf):
    cond = C.conjunction(
        equals={"sinter_method": "Vacuum"}, ranges={"hv": (800, 2000), "kic": (6, None)},
        present=["sinter_temp_c"], contains={"raw_composition": "co"},
    )
    e, p = B.view(spark, sf, "experiments"), B.view(spark, sf, "properties")
    return e.join(p, "exp_id").filter(cond).select("exp_id", "raw_composition", "hv", "kic")


@query("b22_drop_missing", f"""WITH {B.sql('experiments', 'properties')} SELECT 'any' AS how, count(*) AS n FROM properties WHERE hv IS NOT NULL AND trs IS NOT NULL
UNION ALL SELECT 'hv', count(*) FROM properties WHERE hv IS NOT NULL""")
def b22(spark, sf):
    p = B.view(spark, sf, "properties")
    return (
        C.drop_missing(p).agg(F.lit("any").alias("how"), F.count(F.lit(1)).alias("n"))
        .unionByName(C.drop_missing(p, ["hv"]).agg(F.lit("hv").alias("how"), F.count(F.lit(1)).alias("n")))
    )
