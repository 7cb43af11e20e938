"""Registered queries: model training, evaluation and scoring."""

from functools import reduce

from pyspark.sql import functions as F

from cermetry.functions.common import r6, scalars
from cermetry.operators import boosting, ml
from cermetry.operators.boosting import Model, single_tree
from cermetry.plans import bridge as B
from cermetry.plans.features import MATRIX, alloy_matrix
from cermetry.plans.physics import _PROC, BASE, MEANS, PAIRS, rd
from cermetry.plans.registry import query
from cermetry.session import cut_lineage, shared_dir
from cermetry.operators.features import folds, hash_bucket

PV = B.sql("properties")
# Two simple predictors of hardness, so that metric queries have exact answers.
P1, P2 = "1600 - kic * 10", "900 + kic * 45"
_PRED = f"{PV}, p AS (SELECT exp_id, kic, hv, {P1} AS p1, {P2} AS p2 FROM properties WHERE hv IS NOT NULL)"


def _preds(spark, sf):
    return B.view(spark, sf, "properties").where("hv IS NOT NULL").selectExpr("exp_id", "kic", "hv", f"{P1} AS p1", f"{P2} AS p2")


def _round(df, cols, digits=6):
    return df.withColumns({c: r6(c, digits) for c in cols})


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _split(m, key="alloy_id"):
    b = hash_bucket(key, 100)
    return m.where(b < 80), m.where(b >= 80)


def _evaluate(names, m, **params):
    train, test = _split(m)
    out = []
    for n in names:
        model = ml.pipeline("regression", n, MATRIX, "hv", **params.get(n, {})).fit(train)
        out.append(ml.regression_metrics(model.transform(test), "hv", "prediction").withColumn("model", F.lit(n)))
    return _union(out)


@query("h1_linear_models")
def h1(spark, sf):
    return _evaluate(("linear", "ridge", "lasso"), alloy_matrix(spark, sf))


@query("h1_line_fit", f"""WITH {PV}, t AS (SELECT CAST(kic AS DOUBLE) AS kic, hv FROM properties WHERE hv IS NOT NULL)
SELECT count(*) AS n, {rd('regr_slope(hv, kic)', 'slope', 5)}, {rd('regr_intercept(hv, kic)', 'intercept', 4)}, {rd('regr_r2(hv, kic)', 'r2')} FROM t""")
def h1b(spark, sf):
    """One feature by least squares, which has a closed form."""
    p = B.view(spark, sf, "properties").where("hv IS NOT NULL").select("exp_id", "kic", "hv")
    model = ml.pipeline("regression", "linear", ["kic"], "hv").fit(p)
    line = model.stages[-1]
    m = ml.regression_metrics(model.transform(p), "hv", "prediction")
    return m.select("n", r6(F.lit(float(line.coefficients[0])), 5).alias("slope"), r6(F.lit(float(line.intercept)), 4).alias("intercept"), r6("r2").alias("r2"))


@query("h2_trees")
def h2(spark, sf):
    return _evaluate(("tree", "forest"), alloy_matrix(spark, sf), forest={"numTrees": 100})


@query("h3_boosted_trees")
def h3(spark, sf):
    return _evaluate(("boosted",), alloy_matrix(spark, sf), boosted={"maxIter": 100})


@query("h4_stacking")
def h4(spark, sf):
    base = {"forest": ml.pipeline("regression", "forest", MATRIX, "hv", numTrees=100), "ridge": ml.pipeline("regression", "ridge", MATRIX, "hv"),
            "boosted": ml.pipeline("regression", "boosted", MATRIX, "hv")}
    rows = ml.base_predictions(alloy_matrix(spark, sf), "alloy_id", base, MATRIX, "hv", k=5)
    out = [ml.regression_metrics(rows, "hv", f"oof_{n}").withColumn("model", F.lit(n)) for n in base]
    prepared = {False: {}, True: {}}
    for meta in ml.META:
        for passthrough in (False, True):
            stacked = ml.stacked_scores(rows, "alloy_id", list(base), MATRIX, "hv", meta, passthrough, prepared=prepared[passthrough])
            # the metrics read the predictions twice
            stacked = cut_lineage(stacked.select("hv", "prediction"), "stacked")
            out.append(ml.regression_metrics(stacked, "hv", "prediction").withColumn("model", F.lit(f"stack {meta}{' with features' if passthrough else ''}")))
    return _union(out)


TEXT = ["n_chars", "n_words", "n_lines", "n_digits", "n_caps"]


def text_matrix(spark, sf):
    """Simple text statistics with the quality label."""
    d = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id")
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    return cut_lineage(d.select(
        "doc_id", F.col("quality").cast("int").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"),
        n(r"\S+").alias("n_words"), n(r"\n").alias("n_lines"), n(r"\d").alias("n_digits"), n(r"\p{Lu}").alias("n_caps")), "texts")


@query("h5_classifiers")
def h5(spark, sf):
    m = text_matrix(spark, sf)
    train, test = _split(m, "doc_id")
    out = []
    for n in ("logistic", "linear_svc", "tree", "forest"):
        scored = ml.pipeline("classification", n, TEXT, "quality").fit(train).transform(test)
        out.append(scored.agg(F.lit(n).alias("model"), F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == F.col("prediction")).cast("double")).alias("accuracy")))
    return _union(out)


@query("h6_clusters")
def h6(spark, sf):
    assigned, score = ml.clusters(B.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    return assigned.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.lit(float(score)).alias("silhouette"))




def _metrics_sql(y, p, source, where="", group="", cols=""):
    g = f"GROUP BY {group}" if group else ""
    m = f"(SELECT {group + ',' if group else ''} avg({y}) AS m FROM {source} {where} {g})"
    join = f"JOIN {m} USING ({group})" if group else f", {m}"
    return (f"SELECT {cols} count(*) AS n, {rd(f'avg(pow({y} - {p}, 2))', 'mse', 3)}, {rd(f'avg(abs({y} - {p}))', 'mae')}, {rd(f'sqrt(avg(pow({y} - {p}, 2)))', 'rmse')}, "
            f"{rd(f'1 - avg(pow({y} - {p}, 2)) / avg(pow({y} - m, 2))', 'r2')}, {rd(f'avg(abs({y} - m))', 'mad')} FROM {source} {join} {where} {g}")


def _metric_round(df):
    return _round(_round(df, ["mse"], 3), ["mae", "rmse", "r2", "mad"])


@query("h7_regression_metrics", f"WITH {_PRED} {_metrics_sql('hv', 'p1', 'p')}")
def h7(spark, sf):
    return _metric_round(ml.regression_metrics(_preds(spark, sf), "hv", "p1"))


_CLS = "c AS (SELECT label AS actual, CAST(label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS predicted FROM embeddings)"


def _labelled(spark, sf):
    return B.table(spark, sf, "embeddings").selectExpr("label AS actual", "CAST(label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS predicted")


@query("h8_classification_report", f"""WITH {_CLS}, l AS (SELECT actual AS label FROM c UNION SELECT predicted FROM c), s AS (SELECT label, (SELECT count(*) FROM c WHERE actual = label) AS support, (SELECT count(*) FROM c WHERE predicted = label) AS called,
 (SELECT count(*) FROM c WHERE predicted = label AND actual = label) AS hit FROM l), pr AS (SELECT label, support, coalesce(hit / nullif(called, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM s), a AS (SELECT avg(CASE WHEN actual = predicted THEN 1e0 ELSE 0 END) AS a FROM c)
SELECT label, {rd('p', 'precision')}, {rd('r', 'recall')}, {rd('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')}, support, {rd('a', 'accuracy')} FROM pr, a""")
def h8(spark, sf):
    return _round(ml.classification_report(_labelled(spark, sf), "actual", "predicted"), ["precision", "recall", "f1", "accuracy"])


@query("h8_confusion_matrix", f"WITH {_CLS} SELECT actual, predicted, count(*) AS n FROM c GROUP BY ALL")
def h8b(spark, sf):
    return ml.confusion(_labelled(spark, sf), "actual", "predicted")


@query("h9_out_of_fold")
def h9(spark, sf):
    m = alloy_matrix(spark, sf)
    return ml.out_of_fold(m, "alloy_id", ml.pipeline("regression", "ridge", MATRIX, "hv"), 5).select("alloy_id", "hv", "oof", "oof_fold")


@query("h10_hyper_parameters")
def h10(spark, sf):
    """Twenty random trials of a boosted learner, scored on three folds."""
    return ml.search(alloy_matrix(spark, sf), "alloy_id", MATRIX, "hv", ml.random_trials(20))


_H11 = [(w, 10.0 * w) for w in (-4, -2, 0, 2, 4)]


@query("h11_guarded_objective", f"""WITH {PV}, {B.values('cand', ('w',), [(v,) for _, v in _H11])}, e AS (SELECT w, exp_id % 5 = 0 AS val, sqrt(avg(pow(hv - (1500 + kic * w), 2))) AS rmse FROM properties, cand WHERE hv IS NOT NULL GROUP BY ALL),
o AS (SELECT w, max(CASE WHEN val THEN rmse END) AS v, max(CASE WHEN NOT val THEN rmse END) AS t FROM e GROUP BY w)
SELECT w, {rd('v', 'val')}, {rd('t', 'train')}, {rd('v + 2 * greatest(0, v - t)', 'loss')}, v + 2 * greatest(0, v - t) = (SELECT min(v + 2 * greatest(0, v - t)) FROM o) AS best FROM o""")
def h11(spark, sf):
    """Candidates scored by validation error plus an over-fit penalty."""
    p = B.view(spark, sf, "properties").where("hv IS NOT NULL")
    val = F.col("exp_id") % 5 == 0
    err = lambda w, cond: F.sqrt(F.avg(F.when(cond, F.pow(F.col("hv") - (1500 + F.col("kic") * w), F.lit(2.0)))))
    row = p.agg(*[e.alias(f"{k}{i}") for i, (_, w) in enumerate(_H11) for k, e in (("v", err(w, val)), ("t", err(w, ~val)))])
    c = row.select(F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"v{i}").alias("val"), F.col(f"t{i}").alias("train")) for i, (_, w) in enumerate(_H11)])).alias("c")).select("c.*")
    c = c.withColumn("loss", ml.guarded_loss("val", "train", 2.0))
    best = scalars(c.agg(F.min("loss").alias("b")))["b"]
    return _round(c.withColumn("best", F.col("loss") == best), ["val", "train", "loss"])


@query("h12_blend_sweep", f"""WITH {_PRED}, {B.values('wt', ('w',), [(i / 20,) for i in range(21)])}, m AS (SELECT avg(hv) AS m FROM p)
SELECT w, {rd('1 - sum(pow(hv - (w * p1 + (1 - w) * p2), 2)) / sum(pow(hv - m, 2))', 'r2')}, {rd('avg(abs(hv - (w * p1 + (1 - w) * p2)))', 'mae')} FROM p, wt, m GROUP BY w""")
def h12(spark, sf):
    return _round(ml.blend_sweep(_preds(spark, sf), "hv", "p1", "p2"), ["r2", "mae"])


@query("h13_blended_score", f"WITH {_PRED} SELECT exp_id, {rd('65e-2 * p1 + (1 - 65e-2) * p2', 'blend')} FROM p")
def h13(spark, sf):
    return _preds(spark, sf).select("exp_id", r6(0.65 * F.col("p1") + (1 - 0.65) * F.col("p2")).alias("blend"))


@query("h14_batch_prediction")
def h14(spark, sf):
    m = alloy_matrix(spark, sf)
    model = ml.pipeline("regression", "linear", MATRIX, "hv").fit(m)
    return model.transform(m).select("alloy_id", "hv", "prediction")


@query("h15_overfit_ratio", f"""WITH {B.sql('library')}, s AS (SELECT atoms, count(*) / 1e5 + 5e-1 AS train_r2, avg(volume) / 1e2 + 2e-1 - atoms / 3e1 AS cv_r2 FROM library GROUP BY atoms), r AS (SELECT atoms, CASE WHEN cv_r2 > 0 THEN train_r2 / cv_r2 END AS ratio FROM s)
SELECT atoms, {rd('ratio', 'ratio')}, CASE WHEN ratio IS NULL OR ratio > 12e-1 THEN 'moderate' WHEN ratio > 11e-1 THEN 'mild' ELSE 'low' END AS grade FROM r""")
def h15(spark, sf):
    """Ratio ladder over per-group score pairs."""
    s = B.view(spark, sf, "library").groupBy("atoms").agg(
        (F.count(F.lit(1)) / 1e5 + 0.5).alias("train_r2"), (F.avg("volume") / 100).alias("v"))
    s = s.withColumn("cv_r2", F.col("v") + 0.2 - F.col("atoms") / 30.0)
    ratio, grade = ml.overfit_ratio("train_r2", "cv_r2")
    return s.select("atoms", r6(ratio).alias("ratio"), grade.alias("grade"))


@query("h16_fold_stability")
def h16(spark, sf):
    m = alloy_matrix(spark, sf)
    return ml.fold_stability(m, "alloy_id", single_tree("tree"), MATRIX, "hv", 5)


@query("h16_train_test_gap")
def h16b(spark, sf):
    m = alloy_matrix(spark, sf)
    return ml.train_test_gap(m, "alloy_id", ml.pipeline("regression", "tree", MATRIX, "hv"), "hv")


_STUMP = f"""WITH {BASE}, {MEANS}, {PAIRS}, {_PROC}, r AS (SELECT alloy_id, binder_pct AS x, hv AS y, CAST(floor({B.uni('alloy_id', 0)} * 5) AS INT) AS fold FROM he JOIN alloys USING (alloy_id)),
f AS (SELECT DISTINCT fold FROM r), tr AS (SELECT f.fold AS left_out, x, y FROM r JOIN f ON r.fold <> f.fold), v AS (SELECT DISTINCT x AS cut FROM r),
g AS (SELECT left_out, cut, avg(CASE WHEN x <= cut THEN y END) AS lo, avg(CASE WHEN x > cut THEN y END) AS hi,
  pow(sum(CASE WHEN x <= cut THEN y END), 2) / count(CASE WHEN x <= cut THEN 1 END) + pow(sum(CASE WHEN x > cut THEN y END), 2) / count(CASE WHEN x > cut THEN 1 END) AS gain FROM tr, v GROUP BY ALL HAVING count(CASE WHEN x > cut THEN 1 END) > 0 AND count(CASE WHEN x <= cut THEN 1 END) > 0),
b AS (SELECT left_out, arg_max(cut, gain) AS cut, arg_max(lo, gain) AS lo, arg_max(hi, gain) AS hi FROM g GROUP BY left_out)"""


@query("h16_stump_folds", f"""{_STUMP} SELECT alloy_id, fold, {rd('y', 'target')}, {rd('CASE WHEN x <= cut THEN lo ELSE hi END', 'prediction')} FROM r JOIN b ON fold = left_out""")
def h16c(spark, sf):
    """Out-of-fold predictions of trees with one split of one feature, which SQL can restate."""
    stump = single_tree("stump", depth=1)
    oof = ml.across_folds(alloy_matrix(spark, sf), "alloy_id", ["binder_pct"], "hv", [stump], 5)
    return oof.select(F.col("key").alias("alloy_id"), "fold", r6("target").alias("target"), r6("prediction").alias("prediction"))


def _round_sql(name, source, y):
    """One boosting round of a stump over ``x``: cut and steps of both sides (rate 0.3, squares shrunk by one row)."""
    side = lambda c: (f"coalesce(sum(CASE WHEN x {c} cut THEN {y} END), 0)", f"(count(CASE WHEN x {c} cut THEN 1 END) + 1e0)")
    (sl, nl), (sr, nr) = side("<="), side(">")
    return (f"{name}_g AS (SELECT cut, 3e-1 * {sl} / {nl} AS lo, 3e-1 * {sr} / {nr} AS hi, pow({sl}, 2) / {nl} + pow({sr}, 2) / {nr} AS gain FROM {source}, v GROUP BY cut HAVING count(CASE WHEN x > cut THEN 1 END) > 0), "
            f"{name} AS (SELECT arg_max(cut, gain) AS cut, arg_max(lo, gain) AS lo, arg_max(hi, gain) AS hi FROM {name}_g)")


_TWO = f"""WITH {BASE}, {MEANS}, {PAIRS}, {_PROC}, r AS (SELECT alloy_id, binder_pct AS x, hv AS y FROM he JOIN alloys USING (alloy_id)), v AS (SELECT DISTINCT x AS cut FROM r),
m AS (SELECT avg(y) AS m FROM r), r0 AS (SELECT alloy_id, x, y - m AS e, y, m FROM r, m), {_round_sql('a', 'r0', 'e')},
r1 AS (SELECT alloy_id, x, y, m, e, e - CASE WHEN x <= cut THEN lo ELSE hi END AS e1, CASE WHEN x <= cut THEN lo ELSE hi END AS s1 FROM r0, a), {_round_sql('b', 'r1', 'e1')},
r2 AS (SELECT *, CASE WHEN x <= cut THEN lo ELSE hi END AS s2 FROM r1, b)"""
_STUMPS = {"rounds": 2, "rate": 0.3, "depth": 1, "l2": 1.0}


@query("h3_two_rounds", f"{_TWO} SELECT alloy_id, {rd('m + s1 + s2', 'prediction')} FROM r2")
def h3b(spark, sf):
    """Two boosting rounds of one split each, which SQL can restate."""
    table, _ = boosting.binned(alloy_matrix(spark, sf), "alloy_id", ["binder_pct"], ["hv"])
    scored = boosting.predictions(table, [Model("stumps", **_STUMPS)])
    return scored.select(F.col("key").alias("alloy_id"), r6("prediction").alias("prediction"))


@query("h22_stump_effect", f"""{_TWO}, w AS (SELECT sum(e) / (count(*) + 1) AS root0, sum(e1) / (count(*) + 1) AS root1 FROM r1),
c AS (SELECT x, s1 + s2 - 3e-1 * (root0 + root1) AS part FROM r2, w) SELECT 'binder_pct' AS feature, {rd('avg(abs(part))', 'contribution')}, CAST(sign(covar_pop(x, part)) AS DOUBLE) AS direction FROM c""")
def h22b(spark, sf):
    """Mean contribution and direction of the one feature of two rounds, which SQL can restate."""
    found = ml.feature_effects(alloy_matrix(spark, sf), "alloy_id", ["binder_pct"], "hv", Model("stumps", **_STUMPS))
    return found.withColumn("contribution", r6("contribution"))


@query("h17_learning_curve")
def h17(spark, sf):
    m = alloy_matrix(spark, sf)
    return ml.learning_curve(m, "alloy_id", single_tree("tree"), MATRIX, "hv")


# ---- fixed values: parameters of the three presets and of the surrogates
PRESETS = {
    "light": {"rounds": 800, "depth": 5, "rate": 0.05, "min_rows": 2, "gamma": 0.1, "l1": 0.1, "l2": 0.5, "subsample": 0.8, "columns": 0.8, "level_columns": 1.0},
    "medium": {"rounds": 600, "depth": 4, "rate": 0.05, "min_rows": 3, "gamma": 0.2, "l1": 0.3, "l2": 1.0, "subsample": 0.75, "columns": 0.75, "level_columns": 0.9},
    "aggressive": {"rounds": 400, "depth": 3, "rate": 0.05, "min_rows": 5, "gamma": 0.5, "l1": 0.5, "l2": 2.0, "subsample": 0.7, "columns": 0.7, "level_columns": 0.8},
}
SURROGATE = {"rounds": 500, "rate": 0.4, "l1": 0.1, "l2": 0.01, "columns": 0.5, "level_columns": 0.7, "parallel": 6}
SURROGATE_CHANGES = {"volume": {"rounds": 800}, "moment": {"l2": 0.05, "rate": 0.3}}
# ---- end of fixed values


@query("h18_regularisation_presets")
def h18(spark, sf):
    return ml.compare_presets(alloy_matrix(spark, sf), "alloy_id", PRESETS, MATRIX, "hv", k=5)


SURROGATES = ("energy", "volume", "moment")


def surrogate_targets(m):
    """Targets that depend on the inputs, disturbed by the row's own values."""
    return m.withColumns({
        "energy": 0.02 * F.col("h_mix") + 0.1 * F.col("pred_formation_energy"),
        "volume": 8 + F.col("vec") / 2 + F.col("delta_r") / 10 + F.col("volume_per_atom") / 20,
        "moment": F.col("delta_chi") * 5 - F.col("s_mix") / 20 + F.col("pred_magnetic_moment") / 20})


@query("h19_surrogates")
def h19(spark, sf):
    """Out-of-fold scores of the three surrogates, each refitted on all rows; all eighteen
    models grow together."""
    m = surrogate_targets(alloy_matrix(spark, sf))
    inputs = ["vec", "delta_r", "h_mix", "s_mix", "delta_chi"]
    marked = folds(m, "alloy_id", 5, 42, "_fold")
    table, _ = boosting.binned(marked, "alloy_id", inputs, SURROGATES, "_fold")
    models = [Model(name, target=i, fold=f, **{**SURROGATE, **SURROGATE_CHANGES.get(name, {})}) for i, name in enumerate(SURROGATES) for f in (*range(5), None)]
    scored = cut_lineage(boosting.predictions(table, models), "surrogates")
    refit = F.pmod(F.col("model"), F.lit(6)) == 5
    scores = ml.regression_metrics(scored.where(~refit), "target", "prediction", by=["name"])
    again = ml.regression_metrics(scored.where(refit), "target", "prediction", by=["name"]).select("name", F.col("r2").alias("refit_r2"))
    return scores.join(again, "name").withColumnRenamed("name", "surrogate")


@query("h20_subpopulation_metrics", f"WITH {_PRED} {_metrics_sql('hv', 'p1', 'p', 'WHERE kic > 12')}")
def h20(spark, sf):
    return _metric_round(ml.regression_metrics(_preds(spark, sf).where("kic > 12"), "hv", "p1"))


@query("h20_grouped_metrics", f"WITH {_PRED}, g AS (SELECT *, CAST(floor(kic / 5) AS BIGINT) AS band FROM p) {_metrics_sql('hv', 'p1', 'g', group='band', cols='band,')}")
def h20b(spark, sf):
    p = _preds(spark, sf).withColumn("band", F.floor(F.col("kic") / 5).cast("bigint"))
    return _metric_round(ml.regression_metrics(p, "hv", "p1", by=["band"]))


@query("h21_model_bundle")
def h21(spark, sf):
    """Save, load and score again; the loaded model must agree."""
    m = alloy_matrix(spark, sf)
    model = ml.pipeline("regression", "ridge", MATRIX, "hv").fit(m)
    path = shared_dir(spark, "bundle")
    ml.save_bundle(model, ml.regression_metrics(model.transform(m), "hv", "prediction"), path)
    loaded, metrics = ml.load_bundle(spark, path)
    return ml.regression_metrics(loaded.transform(m), "hv", "prediction").withColumn("part", F.lit("rescored")).unionByName(
        metrics.withColumn("part", F.lit("stored")))


@query("h22_feature_effects")
def h22(spark, sf):
    """The ten features that contribute most to the predictions of a boosted model."""
    return ml.feature_effects(alloy_matrix(spark, sf), "alloy_id", MATRIX, "hv", Model("effects", rounds=100, depth=5), n=10)


@query("h23_task_detection", """SELECT 'hv' AS target, CASE WHEN count(DISTINCT o_totalprice) < 20 THEN 'classification' ELSE 'regression' END AS task FROM orders UNION ALL
SELECT 'status', 'classification' FROM orders GROUP BY 1, 2 UNION ALL SELECT 'decile', CASE WHEN count(DISTINCT o_orderkey % 10) < 20 THEN 'classification' ELSE 'regression' END FROM orders""")
def h23(spark, sf):
    o = B.table(spark, sf, "orders").selectExpr("o_totalprice AS hv", "o_orderstatus AS status", "o_orderkey % 10 AS decile")
    tasks = [(t, ml.detect_task(o, t)) for t in ("hv", "status", "decile")]
    packed = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(k).alias("task")) for t, k in tasks])
    return o.agg(F.count(F.lit(1))).select(F.explode(packed).alias("r")).select("r.*")


@query("h24_required_features", f"""WITH {B.sql('alloys')}, x AS (SELECT alloy_id, regexp_extract_all(formula, '[A-Z][a-z]?') AS have FROM alloys) SELECT alloy_id, array_to_string(list_filter(['Co', 'Ni', 'Fe'], lambda e: NOT list_contains(have, e)), ',') AS missing FROM x""")
def h24(spark, sf):
    a = B.view(spark, sf, "alloys").select("alloy_id", F.regexp_extract_all("formula", F.lit("[A-Z][a-z]?"), F.lit(0)).alias("have"))
    return a.select("alloy_id", F.array_join(ml.missing_features(["Co", "Ni", "Fe"], F.col("have")), ",").alias("missing"))


@query("h25_positive_toughness", f"WITH {PV} SELECT exp_id, {rd('abs(kic - 12)', 'pred')}, kic - 12 < 0 AS was_negative FROM properties")
def h25(spark, sf):
    p = B.view(spark, sf, "properties").select("exp_id", (F.col("kic") - 12).alias("pred"))
    return _round(ml.positive_toughness(p, "pred"), ["pred"])


