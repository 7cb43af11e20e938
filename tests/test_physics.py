import math

import pytest
from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions import constants as K
from cermetry.functions import physics as P
from cermetry.operators import physics as O
from cermetry.sources import dims


def value(spark, formula, fn):
    return spark.createDataFrame([(formula,)], "f string").select(fn(P.formula_rows("f")).alias("v")).first()["v"]


def test_closed_forms(spark):
    assert value(spark, "Fe", P.vec) == 8
    assert value(spark, "AlCoCrFeNi", P.vec) == pytest.approx(7.2)
    assert value(spark, "AlNi", P.enthalpy) == pytest.approx(-22)
    assert value(spark, "CoCrFe", P.enthalpy) == pytest.approx(-8 / 3)
    assert value(spark, "CoNi", P.entropy) == pytest.approx(K.R_GAS * math.log(2))
    assert value(spark, "Co", P.entropy) == pytest.approx(0)
    assert value(spark, "Fe", P.size_mismatch) == pytest.approx(0)


def test_unknown_elements(spark):
    assert value(spark, "CoXe", P.vec_strict) is None
    assert value(spark, "CoXe", P.vec) == pytest.approx(4.5)
    assert value(spark, "Xe", lambda r: P.weighted_or_null(r, "bulk")) is None


def test_exploded_path_agrees(spark):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(("AlCoCrFeNi", "Co3W", "Ti2NbXe", "C3Fe"))], "id int, f string")
    a = {r.id: r.vec for r in O.exploded_sums(df, "id", "f", ["vec"]).collect()}
    b = {r.id: r.v for r in df.select("id", P.vec(P.formula_rows("f")).alias("v")).collect()}
    assert a == pytest.approx(b)


def test_hardness_models(spark):
    df = spark.createDataFrame([(200.0, 80.0), (0.0, 80.0), (None, 80.0)], "b double, g double")
    rows = df.select(P.chen_hardness("b", "g").alias("c"), P.tian_hardness("b", "g").alias("t")).collect()
    k = 0.4
    assert rows[0].c == pytest.approx(2 * (k * k * 80) ** 0.585 - 3)
    assert rows[0].t == pytest.approx(0.92 * k ** 1.137 * 80 ** 0.708)
    assert rows[1].c is None and rows[2].t is None


def test_volume_weight_round_trip(spark):
    df = spark.range(1).select(F.lit(12.5).alias("w"), F.lit(8.9).alias("b"), F.lit(15.63).alias("c"))
    r = df.withColumn("v", P.wt_to_vol("w", "b", "c")).withColumn("back", P.vol_to_wt("v", "b", "c")).first()
    assert r.v > r.w and r.back == pytest.approx(12.5)


@pytest.mark.parametrize("name, neighbour", [
    ("WC", 2.906), ("tic", 4.328 / math.sqrt(2)), ("TiC grade", 4.328 / math.sqrt(2)), ("unknown", 2.906), ("Cr3C2", 2.7)])
def test_ceramic_neighbour(spark, name, neighbour):
    got = spark.createDataFrame([(name,)], "n string").select(P.ceramic_neighbour("n").alias("v")).first()["v"]
    assert got == pytest.approx(neighbour)


def test_injection_keeps_bad_rows(spark):
    rows = [(1, "CoCrFeNi", "WC, TiC", -0.2, 11.5, 0.1), (2, "", "WC", -0.2, 11.5, 0.1), (3, None, None, -0.1, 12.0, 0.2)]
    df = spark.createDataFrame(rows, "id int, formula string, ceramic string, energy double, vol double, mom double")
    out = {r.id: r for r in O.inject_features(df, energy="energy", volume="vol", moment="mom").collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].vec_binder == pytest.approx(8.25)
    assert out[1].pred_lattice_param == pytest.approx((4 * 11.5) ** (1 / 3))
    assert out[2].vec_binder is None and out[3].pred_lattice_param is None


def test_reference_tables(spark):
    assert dims.elements(spark).count() == 19
    assert dims.enthalpy(spark).count() == 104
    assert dims.enthalpy(spark).where("a >= b").count() == 0
    assert dims.compounds(spark).count() == 18


def test_narrow_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([("CoNi",)], "f string").select(P.vec(P.formula_rows("f")).alias("v"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_free_path_of_monolith(spark):
    r = spark.range(1).select(P.free_path("exner", F.lit(1.0), F.lit(1.0)).alias("a"), P.free_path("model", F.lit(2.0), F.lit(1.0)).alias("b")).first()
    assert (r.a, r.b) == (0.0, 1.0)


def test_statistics_mode_prefers_largest_share(spark):
    got = value(spark, "Co2Ni1Fe2", lambda r: P.property_statistics(r, "number"))
    assert (got["min"], got["max"], got["mode"]) == (26, 28, 26)


def test_norms(spark):
    r = spark.createDataFrame([("Co3Ni",)], "f string").select(
        P.norm(C.formula_shares("f"), 0).alias("n0"), P.norm(C.formula_shares("f"), 2).alias("n2")).first()
    assert r.n0 == 2 and r.n2 == pytest.approx(math.sqrt(0.75 ** 2 + 0.25 ** 2))
