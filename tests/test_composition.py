import pytest
from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.operators import parsing as P


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, shares", [
    ("AlCoCrFeNi", dict.fromkeys(("Al", "Co", "Cr", "Fe", "Ni"), 0.2)),
    ("Al10Co20Cr30Fe20Ni20", {"Al": 0.1, "Co": 0.2, "Cr": 0.3, "Fe": 0.2, "Ni": 0.2}),
    ("Al:10 Co:20 Cr:30 Fe:20 Ni:20", {"Al": 0.1, "Co": 0.2, "Cr": 0.3, "Fe": 0.2, "Ni": 0.2}),
    ("Al 20% Co 20% Cr 20% Fe 20% Ni 20%", dict.fromkeys(("Al", "Co", "Cr", "Fe", "Ni"), 0.2)),
    ("CoNiCo", {"Co": 2 / 3, "Ni": 1 / 3}),
    ("", None),
    (None, None),
])
def test_formula_spellings(spark, text, shares):
    got = one(spark, text, C.formula_shares)
    assert got == (pytest.approx(shares) if shares else None)


@pytest.mark.parametrize("text, fmt, wt, phase, secondary", [
    ("b WC 25 Co", "prefix", 25.0, "WC", None),
    ("WC 85 Co 10 Ni 5", "space", 15.0, "WC", None),
    ("WC-10CoCrFeNi", "dash", 10.0, "WC", None),
    ("80TiC-20Mo", "dash", 20.0, "TiC", None),
    ("TiCN-10Co", "dash", 10.0, "TiCN", None),
    ("WC–12CoNi", "dash", 12.0, "WC", None),
    ("90 WC 10 Co", "number_first", 10.0, "WC", None),
    ("90 WC，10 Co", "number_first", 10.0, "WC", None),
    ("80 WC TiC 20 Co", "number_first", 20.0, "WC", "TiC"),
    ("WC x Co", "placeholder", None, "WC", None),
    ("AlCoCrFeNi", "pure_alloy", 100.0, None, None),
])
def test_cascade(spark, text, fmt, wt, phase, secondary):
    p = one(spark, text, C.parse_cascade)
    assert (p.format, p.binder_wt_pct, p.ceramic_formula, p.secondary_phase) == (fmt, wt, phase, secondary)
    assert sum(p.binder.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("text", ["no entry", "n/a 5", "", "UO2", None, "-", "7"])
def test_unparsable(spark, text):
    assert one(spark, text, C.parse_cascade) is None


@pytest.mark.parametrize("text, wt, ceramic", [
    ("WC 10 Co 0.2 Mo2C", 10.0, {"WC": 75.0, "Mo2C": 15.0}),
    ("b WC 25 Co", 25.0, {"WC": 75.0}),
    ("WC 85 Co 10 Ni 5", 15.0, {"WC": 85.0}),
    ("94.12 WC x Co", 5.88, {"WC": 94.12}),
    ("20 Co 10 Ni", 100.0, {}),
    ("WC 12 TiC 6 Ni", None, None),
    ("TiC 90", None, None),
])
def test_sheet_parser(spark, text, wt, ceramic):
    p = one(spark, text, lambda c: C.sheet_parse(c, F.lit(None).cast("double")))
    if ceramic is None:
        assert p is None or p.binder_wt_pct is not None
    else:
        assert p.binder_wt_pct == pytest.approx(wt)
        assert p.ceramic == pytest.approx(ceramic)


def test_placeholder_with_volume(spark):
    p = one(spark, "WC x Co", lambda c: C.sheet_parse(c, F.lit(20.0)))
    assert p.binder_wt_pct == pytest.approx(0.2 * 100 * 8.9 / (0.8 * 15.6 + 0.2 * 8.9))
    assert one(spark, "WC x Co", lambda c: C.sheet_parse(c, F.lit(None).cast("double"))).has_unknown
    assert one(spark, "WC x Co", lambda c: C.sheet_parse(c, F.lit(120.0))) is None


def test_scaling_changes_nothing(spark):
    a, b = (one(spark, t, C.formula_shares) for t in ("Co1Ni2Fe3", "Co10Ni20Fe30"))
    assert a == pytest.approx(b)


def test_atomic_and_mass_are_inverse(spark):
    back = one(spark, "Co30Ni20W5", lambda c: C.to_atomic(C.to_mass(C.formula_amounts(c))))
    assert back == pytest.approx(one(spark, "Co30Ni20W5", C.formula_shares))


@pytest.mark.parametrize("text, out", [("Co80Ni20", "Co0.8Ni0.2"), ("Co", "Co"), ("Ni1Co7", "Co0.88Ni0.12")])
def test_standard_text(spark, text, out):
    assert one(spark, text, lambda c: C.standard_text(C.formula_shares(c))) == out


def test_hea_flags(spark):
    assert one(spark, "CoCrFeNiMn", lambda c: C.hea_strict(C.formula_shares(c)))
    assert not one(spark, "Co90Cr1Fe3Ni3Mn3", lambda c: C.hea_strict(C.formula_shares(c)))
    assert one(spark, "WC-10CoCrFeNiMn", C.hea_by_name)
    assert one(spark, None, C.hea_by_name) is False


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "WC-10Co"), (2, "junk text"), (3, None)], "exp_id int, raw_composition string")
    ok, bad = P.split_parsed(df)
    assert [r.exp_id for r in ok.collect()] == [1]
    assert sorted(r.exp_id for r in bad.collect()) == [2, 3]
