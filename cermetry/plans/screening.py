"""Registered queries: screening, inverse design, documents."""

from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions import constants as K
from cermetry.functions import physics as P
from cermetry.functions.common import pinned, r6, scalars, uniforms
from cermetry.operators import documents as D
from cermetry.operators import ml
from cermetry.operators import physics as O
from cermetry.operators import screening as S
from cermetry.plans import bridge as B
from cermetry.plans import physics as PP
from cermetry.plans.physics import BASE, MEANS, PAIRS, rd, scored
from cermetry.plans.bridge import uni
from cermetry.plans.registry import query
from cermetry.session import cut_lineage

def btw(key, stream, lo, hi):
    return f"({lo} + ({hi} - {lo}) * {uni(key, stream)})"


#: no two (order, supplier, line) triples share an id: suppliers below 2^24, lines below 8
CID = "(l_orderkey * 16777216 + l_suppkey) * 8 + l_linenumber"


def _ids(spark, sf):
    return B.table(spark, sf, "lineitem").selectExpr(f"{CID} AS cid").distinct()


CIDS = f"ids AS (SELECT DISTINCT {CID} AS cid FROM lineitem)"
EL5 = ("Co", "Cr", "Fe", "Ni", "Mo")
_G5 = " UNION ALL ".join(f"SELECT cid, '{e}' AS el, -ln({uni('cid', 10 + i)}) AS g FROM ids" for i, e in enumerate(EL5))
I1 = f"{CIDS}, gm AS ({_G5}), sh AS (SELECT cid, el, g / sum(g) OVER (PARTITION BY cid) AS c FROM gm)"


@query("i1_dirichlet_candidates", f"""WITH {I1}, w AS (SELECT cid, {', '.join(f"max(CASE WHEN el = '{e}' THEN c END) AS {e}" for e in EL5)} FROM sh GROUP BY cid)
SELECT cid, {', '.join(rd(f'w.{e}', f'x_{e}') for e in EL5)}, {rd(btw('cid', 2, 5, 30), 'binder_wt_pct')}, {rd(btw('cid', 0, 1300, 1600), 'sinter_temp_c', 4)}, {rd(btw('cid', 1, '5e-1', '3e0'), 'grain_size_um')} FROM w""")
def i1(spark, sf):
    c = S.dirichlet_candidates(_ids(spark, sf), "cid", EL5)
    return c.select("cid", *[r6(F.col("composition")[e]).alias(f"x_{e}") for e in EL5], r6("binder_wt_pct").alias("binder_wt_pct"),
                    r6("sinter_temp_c", 4).alias("sinter_temp_c"), r6("grain_size_um").alias("grain_size_um"))


_G7 = " UNION ALL ".join(f"SELECT cid, {i} AS pos, '{e}' AS el, {btw('cid', 10 + i, f'{lo}e0', f'{hi}e0')} AS g FROM ids" for i, (e, (lo, hi)) in enumerate(K.ELEMENT_SPACE.items()))
_TEN = "CAST(round_even(v * 10, 0) AS BIGINT)"


@query("i2_bounded_candidates", f"""WITH {CIDS}, gm AS ({_G7}), sh AS (SELECT cid, pos, el, g / sum(g) OVER (PARTITION BY cid) * 100 AS v FROM gm),
f AS (SELECT cid, string_agg(concat(el, CAST({_TEN} // 10 AS VARCHAR), '.', CAST({_TEN} % 10 AS VARCHAR)), '' ORDER BY pos) AS formula FROM sh WHERE v > 1e-1 GROUP BY cid)
SELECT concat('VR_', lpad(CAST(cid AS VARCHAR), CAST(greatest(6, length(CAST(cid AS VARCHAR))) AS INT), '0')) AS recipe_id, formula, {rd(btw('cid', 0, 85, 95), 'wc_content')}, {rd(btw('cid', 1, 1350, 1450), 'sinter_temp_c', 4)}, {rd(btw('cid', 2, '5e-1', '2e0'), 'grain_size_um')} FROM f""")
def i2(spark, sf):
    c = S.bounded_candidates(_ids(spark, sf), "cid")
    return c.select("recipe_id", "formula", r6("wc_content").alias("wc_content"), r6("sinter_temp_c", 4).alias("sinter_temp_c"), r6("grain_size_um").alias("grain_size_um"))


EL9 = ("Co", "Cr", "Fe", "Ni", "Mo", "Ti", "Al", "V", "Nb")
_G9 = " UNION ALL ".join(f"SELECT cid, '{e}' AS el, {uni('cid', 20 + i)} AS t, {uni('cid', 60 + i)} AS v FROM ids" for i, e in enumerate(EL9))


@query("i3_subset_candidates", f"""WITH {CIDS}, gm AS ({_G9}), rk AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY t, el) AS rn FROM gm),
ch AS (SELECT cid, el, v FROM rk WHERE rn <= CAST(floor({uni('cid', 0)} * 3) AS INT) + 4) SELECT cid, el, {rd('v / sum(v) OVER (PARTITION BY cid)', 'share')} FROM ch""")
def i3(spark, sf):
    c = S.subset_candidates(_ids(spark, sf), "cid", EL9)
    return c.select("cid", F.explode("composition").alias("el", "share")).withColumn("share", r6("share"))


@query("i4_stability_filter", f"WITH {B.sql('alloys')} SELECT alloy_id, pred_formation_energy FROM alloys WHERE pred_formation_energy < -1e-1")
def i4(spark, sf):
    return S.stable_only(B.view(spark, sf, "alloys").select("alloy_id", "pred_formation_energy"), -0.1)


_MIS = "abs(pred_lattice_param / sqrt(2e0) - 2906e-3) / 2906e-3"


@query("i5_interface_filter", f"WITH {B.sql('alloys')} SELECT 'kept' AS how, alloy_id FROM alloys WHERE {_MIS} < 11e-2 UNION ALL SELECT 'fallback', alloy_id FROM alloys")
def i5(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", P.relative_gap(F.col("pred_lattice_param") / K.SQRT2, F.lit(K.WC["a"])).alias("lattice_mismatch"))
    kept = S.interface_only(a, 0.11).select(F.lit("kept").alias("how"), "alloy_id")
    return kept.unionByName(S.interface_only(a, 0.000001).select(F.lit("fallback").alias("how"), "alloy_id"))


_SCORE = f"-pred_formation_energy * 10 + (1 - {_MIS}) * 10 + greatest(0e0, least(1e0, bulk / shear - 175e-2)) * 5 + (1 - greatest(0e0, least(1e0, pred_magnetic_moment / 10))) * 3"


def _physics_alloys(spark, sf):
    a = B.view(spark, sf, "alloys")
    return a.withColumns({"lattice_mismatch": P.relative_gap(F.col("pred_lattice_param") / K.SQRT2, F.lit(K.WC["a"])), "pugh": P.pugh("bulk", "shear")})


@query("i6_physics_score", f"WITH {B.sql('alloys')} SELECT alloy_id, CASE WHEN bulk IS NULL OR shear IS NULL THEN NULL ELSE round({_SCORE}, 6) + 0e0 END AS score FROM alloys")
def i6(spark, sf):
    return _physics_alloys(spark, sf).select("alloy_id", r6(O.screening_score("pred_formation_energy", "lattice_mismatch", "pugh", "pred_magnetic_moment")).alias("score"))


@query("i7_combined_score", f"WITH {B.sql('properties')} SELECT exp_id, {rd('hv / 2000 + kic / 15', 'score', 9)} FROM properties")
def i7(spark, sf):
    return B.view(spark, sf, "properties").select("exp_id", r6(S.combined_score("hv", "kic"), 9).alias("score"))


@query("i8_top_candidates", f"WITH {B.sql('properties')} SELECT exp_id, {rd('hv', 'hv')} FROM properties ORDER BY properties.hv DESC NULLS LAST, exp_id LIMIT 50")
def i8(spark, sf):
    return S.top(B.view(spark, sf, "properties").select("exp_id", "hv"), "hv", "exp_id", 50).withColumn("hv", r6("hv"))


@query("i9_rank_column", f"WITH {B.sql('properties')} SELECT exp_id, {rd('hv', 'hv')}, CAST(row_number() OVER (ORDER BY properties.hv DESC NULLS LAST, exp_id) AS INT) AS rank FROM properties ORDER BY rank LIMIT 100")
def i9(spark, sf):
    return S.ranked(B.view(spark, sf, "properties").select("exp_id", "hv"), "hv", "exp_id", 100).withColumn("hv", r6("hv"))


VECTOR = ["ni_share", "nb_share", "fe_mass", "element_count", "norm2", "diff_number", "diff_chi", "range_group", "mean_period", "grain_um", "lattice_mismatch_wc", "interface_complexity"]


def hardness_model(spark, sf):
    """A linear hardness model fitted on the alloys' feature vectors."""
    a = scored(O.with_rows(B.view(spark, sf, "alloys", heavy=True))).drop("t", "s", "p", "rows")
    train = cut_lineage(O.hardness_vector(a).select("hv", *VECTOR), "train")
    return ml.pipeline("regression", "ridge", VECTOR, "hv").fit(train)


def _featurize(c):
    c = c.withColumn("pred_lattice_param", P.vegard_lattice(F.col("composition")))
    return O.hardness_vector(c, binder_vol="binder_wt_pct", composition="composition")


@query("i10_run_screening")
def i10(spark, sf):
    """Candidates for every line item, features, model score, best hundred."""
    c = S.dirichlet_candidates(_ids(spark, sf), "cid", EL5)
    return S.run_screening(c, _featurize, hardness_model(spark, sf), VECTOR, "cid", 100)


@query("i11_screening_funnel", f"""WITH {B.sql('alloys')}, s AS (SELECT alloy_id, CASE WHEN bulk IS NULL OR shear IS NULL THEN NULL ELSE {_SCORE} END AS sc FROM alloys WHERE pred_formation_energy < 0 AND {_MIS} < 1e-1)
SELECT alloy_id, {rd('sc', 'score')} FROM s ORDER BY sc DESC NULLS LAST, alloy_id LIMIT 20""")
def i11(spark, sf):
    return S.screening_funnel(_physics_alloys(spark, sf), "alloy_id").select("alloy_id", r6("score").alias("score"))


@query("i11_candidate_funnel")
def i11b(spark, sf):
    """Bounded candidates through injection, filters and score to the best 20."""
    drawn = {"energy": (30, -0.6, 0.3), "volume": (31, 10.0, 13.0), "moment": (32, 0.0, 2.0), "bulk": (33, 120.0, 280.0), "shear": (34, 50.0, 130.0)}
    c = uniforms(S.bounded_candidates(_ids(spark, sf), "cid"), "cid", {f"_d_{n}": stream for n, (stream, _, _) in drawn.items()})
    c = c.withColumns({"ceramic": F.lit("WC"), **{n: pinned(S.spanned(f"_d_{n}", lo, hi)) for n, (_, lo, hi) in drawn.items()}}).drop(*[f"_d_{n}" for n in drawn])
    # all draws are pinned, so no candidate is drawn twice; no text repeats, so nothing is shuffled or stored
    c = O.inject_features(c, energy="energy", volume="volume", moment="moment", repeated=False).withColumn("pugh", P.pugh("bulk", "shear"))
    return S.screening_funnel(c, "recipe_id").select("recipe_id", "formula", "score", "lattice_mismatch", "vec_binder")


HE = f"{BASE}, {MEANS}, {PAIRS}, {PP._PROC}"
_VIO = "vi AS (SELECT alloy_id, sum(greatest(0e0, 5e-2 - c, c - 35e-2) * 10000) AS bad, min(c) AS low FROM sh GROUP BY alloy_id)"
_PEN = "bad + greatest(0e0, 1400 - hv, hv - 1700) * 50 + greatest(0e0, 8 - kic, kic - 12) * 2000"
_OBJ = f"ob AS (SELECT alloy_id, bad, low, CASE WHEN bad > 1e-1 THEN -10000 - bad ELSE hv - ({_PEN}) END AS obj_hv, CASE WHEN bad > 1e-1 THEN -10000 - bad ELSE kic - ({_PEN}) END AS obj_kic FROM he JOIN vi USING (alloy_id))"
TARGETS = ((1400, 1700), (8, 12))


def solutions(spark, sf):
    return scored(O.with_rows(B.view(spark, sf, "alloys", heavy=True))).withColumn("m", pinned(C.formula_shares("formula"))).select(
        "alloy_id", "m", "hv", "kic", "grain_size_um", "binder_pct", "sinter_temp_c")


@query("i12_constraint_penalty", f"WITH {HE}, {_VIO}, {_OBJ} SELECT alloy_id, {rd('bad', 'violation', 4)}, {rd('obj_hv', 'obj_hv', 4)}, {rd('obj_kic', 'obj_kic', 4)} FROM ob")
def i12(spark, sf):
    d = S.penalised(solutions(spark, sf), "m", "hv", "kic", *TARGETS)
    return d.select("alloy_id", r6("violation", 4).alias("violation"), r6("obj_hv", 4).alias("obj_hv"), r6("obj_kic", 4).alias("obj_kic"))


def _front(x, y, source):
    return f"SELECT a.* FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE b.{x} >= a.{x} AND b.{y} >= a.{y} AND (b.{x} > a.{x} OR b.{y} > a.{y}))"


@query("i13_pareto_front", f"""WITH {B.sql('properties')}, p AS (SELECT exp_id, hv, kic FROM properties WHERE hv IS NOT NULL), b AS (SELECT hv, max(kic) AS kic FROM p GROUP BY hv),
f AS (SELECT *, max(kic) OVER (ORDER BY hv DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b)
SELECT exp_id, {rd('p.hv', 'hv')}, p.kic FROM p JOIN f ON p.hv = f.hv AND p.kic = f.kic WHERE above IS NULL OR f.kic > above""")
def i13(spark, sf):
    return S.pareto(B.view(spark, sf, "properties").select("exp_id", "hv", "kic")).withColumn("hv", r6("hv"))


@query("i14_acceptance", f"WITH {HE}, {_VIO} SELECT alloy_id, {rd('hv', 'hv')}, {rd('kic', 'kic')} FROM he JOIN vi USING (alloy_id) WHERE hv >= 0 AND kic >= 0 AND low >= 45e-3")
def i14(spark, sf):
    return S.accepted(solutions(spark, sf), "m").select("alloy_id", r6("hv").alias("hv"), r6("kic").alias("kic"))


@query("i15_inverse_design", f"WITH {HE}, {_VIO}, {_OBJ}, fr AS ({_front('obj_hv', 'obj_kic', 'ob')}) SELECT alloy_id, {rd('obj_hv', 'obj_hv', 4)}, {rd('obj_kic', 'obj_kic', 4)} FROM fr WHERE obj_hv >= 0 AND obj_kic >= 0 AND low >= 45e-3")
def i15(spark, sf):
    wanted = S.inverse_design(solutions(spark, sf), "m", "hv", "kic", *TARGETS)
    return wanted.select("alloy_id", r6("obj_hv", 4).alias("obj_hv"), r6("obj_kic", 4).alias("obj_kic"))


KIC_VECTOR = ["ni_share", "tm_share", "range_tm", "grain_um", "binder_vol_pct", "temp_c", "lattice_mismatch_wc", "free_path"]


def toughness_model(spark, sf):
    """A linear toughness model fitted on the alloys' feature vectors."""
    a = scored(O.with_rows(B.view(spark, sf, "alloys", heavy=True))).drop("t", "s", "p", "rows")
    train = cut_lineage(O.toughness_vector(a).select("kic", *KIC_VECTOR), "train")
    return ml.pipeline("regression", "ridge", KIC_VECTOR, "kic").fit(train)


def design_tasks_of(spark, sf):
    """Design requests: per region a hardness range and a least toughness, set from the known alloys' means and deviations."""
    known = scalars(solutions(spark, sf).agg(*[f(c).alias(f"{n}_{c}") for c in ("hv", "kic") for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]))
    low = known["mean_hv"] + (F.col("r_regionkey") / 4 - 1) * known["dev_hv"]
    return B.table(spark, sf, "region").select(
        F.col("r_name").alias("task"), low.alias("hv_min"), (low + 1.5 * known["dev_hv"]).alias("hv_max"),
        (known["mean_kic"] - known["dev_kic"] / 2).alias("kic_min"), (known["mean_kic"] + 3 * known["dev_kic"]).alias("kic_max"))


@query("i15_archive_search")
def i15b(spark, sf):
    """Designs for every request, searched from Dirichlet candidates through two fitted models."""
    hard, tough = hardness_model(spark, sf), toughness_model(spark, sf)

    def evaluate(c):
        kept = [*c.columns, "pred_lattice_param"]
        x = O.hardness_vector(O.element_lattice(c, "composition", EL5), binder_vol="binder_wt_pct", composition="composition", elements=EL5)
        x = x.select(*kept, pinned(ml.linear_prediction(hard, VECTOR)).alias("hv"))
        y = O.toughness_vector(x, binder_vol="binder_wt_pct", composition="composition", elements=EL5)
        return y.select(*kept, "hv", pinned(ml.linear_prediction(tough, KIC_VECTOR)).alias("kic"))

    archive = S.archive_search(_ids(spark, sf), design_tasks_of(spark, sf), evaluate)[-1]
    found = S.accepted(archive, "composition", "obj_hv", "obj_kic")
    return found.select("task", "found", "cid", C.standard_text(F.col("composition"), 4).alias("formula"), *S.PROCESS, "hv", "kic", "obj_hv", "obj_kic")


_TASKS = "SELECT n_name AS task, CAST(1000 + n_nationkey * 40 AS DOUBLE) AS hv_min, CAST(1060 + n_nationkey * 40 AS DOUBLE) AS hv_max, CAST(5 + n_nationkey % 6 AS DOUBLE) AS kic_min, CAST(8 + n_nationkey % 6 AS DOUBLE) AS kic_max FROM nation"


@query("i16_design_tasks", f"""WITH {HE}, tasks AS ({_TASKS}), hit AS (SELECT task, hv, kic, row_number() OVER (PARTITION BY task ORDER BY hv DESC, kic DESC, alloy_id) AS rn FROM tasks JOIN he ON hv BETWEEN hv_min AND hv_max AND kic BETWEEN kic_min AND kic_max),
n AS (SELECT task, count(*) AS n, max(CASE WHEN rn = 1 THEN hv END) AS hv, max(CASE WHEN rn = 1 THEN kic END) AS kic FROM hit GROUP BY task)
SELECT task, {rd('n.hv', 'best_hv')}, {rd('n.kic', 'best_kic')}, coalesce(n, 0) AS num_solutions, CASE WHEN n > 0 THEN 'OK' ELSE 'No solutions found' END AS status FROM tasks LEFT JOIN n USING (task)""")
def i16(spark, sf):
    tasks = B.table(spark, sf, "nation").selectExpr(
        "n_name AS task", "CAST(1000 + n_nationkey * 40 AS DOUBLE) AS hv_min", "CAST(1060 + n_nationkey * 40 AS DOUBLE) AS hv_max",
        "CAST(5 + n_nationkey % 6 AS DOUBLE) AS kic_min", "CAST(8 + n_nationkey % 6 AS DOUBLE) AS kic_max")
    out = S.design_tasks(tasks, solutions(spark, sf), "alloy_id")
    return out.withColumns({"best_hv": r6("best_hv"), "best_kic": r6("best_kic")})


@query("i17_solution_export", f"""WITH {HE} SELECT alloy_id AS solution_id, printf('%.2f', hv) AS hv, printf('%.2f', kic) AS kic, {', '.join(f"printf('%.4f', coalesce((SELECT c FROM sh WHERE sh.alloy_id = he.alloy_id AND el = '{e}'), 0)) AS {e}" for e in ('Co', 'Ni', 'Fe'))} FROM he""")
def i17(spark, sf):
    return S.export_solutions(solutions(spark, sf), "alloy_id", "m", ("Co", "Ni", "Fe"))


@query("i18_mean_composition", f"""WITH {HE}, w AS (SELECT alloy_id FROM he ORDER BY hv DESC, alloy_id LIMIT 100) SELECT {', '.join(rd(f"coalesce(sum(CASE WHEN el = '{e}' THEN c END), 0) / 100", e) for e in ('Co', 'Ni', 'Fe', 'Cr', 'Mo'))} FROM sh WHERE alloy_id IN (SELECT alloy_id FROM w)""")
def i18(spark, sf):
    names = ("Co", "Ni", "Fe", "Cr", "Mo")
    best = S.top(solutions(spark, sf), "hv", "alloy_id", 100)
    return S.mean_composition(best, "m", names).select(*[r6(e).alias(e) for e in names])


_PAT_D, _PAT_M = D.PROPERTY_PATTERNS["density"], D.PROPERTY_PATTERNS["melting_point"]


@query("j1_property_mentions", f"""WITH {B.sql('texts')}, r AS (SELECT doc_id, 'density' AS property, 0 AS base, unnest(regexp_extract_all(text, '{_PAT_D}', 1)) AS v, unnest(regexp_extract_all(text, '{_PAT_D}', 2)) AS unit FROM texts
UNION ALL SELECT doc_id, 'melting_point', 1, unnest(regexp_extract_all(text, '{_PAT_M}', 1)), unnest(regexp_extract_all(text, '{_PAT_M}', 2)) FROM texts)
SELECT doc_id, property, unit, {rd("CAST(v AS DOUBLE) * CASE unit WHEN 'kg/m3' THEN 1e-3 ELSE 1 END + CASE unit WHEN '°C' THEN 27315e-2 ELSE 0 END", 'value')} FROM r""")
def j1(spark, sf):
    m = D.property_mentions(B.view(spark, sf, "texts"), "doc_id", "text")
    return m.select("doc_id", "property", "unit", r6("value").alias("value"))


_Q = "q AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS status FROM documents)"


def _queue(spark, sf):
    return B.table(spark, sf, "documents").selectExpr("doc_id", "source", "CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS status")


@query("j2_review_queue", f"WITH {_Q} SELECT doc_id, source FROM q WHERE status = 'pending'")
def j2(spark, sf):
    return D.pending(_queue(spark, sf)).select("doc_id", "source")


@query("j2_approve_records", f"WITH {_Q} SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'approved' ELSE status END AS status FROM q")
def j2b(spark, sf):
    good = B.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return D.approve(_queue(spark, sf), good, "doc_id").select("doc_id", "source", "status")
