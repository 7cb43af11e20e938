import numpy as np
import pandas as pd
import pytest

from cermetry.operators import ml
from cermetry.session import shared_dir


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(600), "a": rng.normal(size=600), "b": rng.normal(size=600), "c": rng.normal(size=600)})
    pdf["y"] = 3 * pdf.a - 2 * pdf.b + 0.1 * rng.normal(size=600)
    pdf["label"] = (pdf.y > 0).astype(int)
    return spark.createDataFrame(pdf).cache()


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("name", ["linear", "ridge", "tree", "forest", "boosted"])
def test_regressors_learn(frame, name):
    params = {"maxIter": 10} if name == "boosted" else {}
    model = ml.pipeline("regression", name, FEATURES, "y", **params).fit(frame)
    assert ml.regression_metrics(model.transform(frame), "y", "prediction").first()["r2"] > 0.5


def test_metrics_against_numpy(spark):
    y, p = np.array([1.0, 2.0, 4.0, 9.0]), np.array([1.5, 2.0, 3.0, 8.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())) + [(None, 1.0)], "y double, p double")
    m = ml.regression_metrics(df, "y", "p").first()
    assert m.n == 4 and m.mse == pytest.approx(((y - p) ** 2).mean())
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m.mad == pytest.approx(np.abs(y - y.mean()).mean())


def test_out_of_fold_covers_every_row(frame):
    oof = ml.out_of_fold(frame, "id", ml.pipeline("regression", "linear", FEATURES, "y"), 4)
    assert oof.count() == 600 and oof.select("id").distinct().count() == 600
    assert ml.regression_metrics(oof, "y", "oof").first()["r2"] > 0.9


def test_stacking(frame):
    base = {"l": ml.pipeline("regression", "linear", FEATURES, "y"), "t": ml.pipeline("regression", "tree", FEATURES, "y")}
    _, _, rows = ml.stacking(frame, "id", base, FEATURES, "y", k=2)
    assert ml.regression_metrics(rows, "y", "prediction").first()["r2"] > 0.8


def test_stages_before_the_model_are_fitted_once_a_fold(spark, monkeypatch):
    """Base models share their fold's medians, and so do meta models of the same inputs; the
    predictions are those of pipelines fitted whole, one fold after the other."""
    from pyspark.sql import functions as F

    from cermetry.operators.features import folds

    rows = spark.range(400).selectExpr("id AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 20 * 1D END AS a", "id % 11 * 1D AS b").withColumn("y", F.coalesce("a", F.lit(3.0)) * 2 - F.col("b"))
    base = {n: ml.pipeline("regression", n, ["a", "b"], "y") for n in ("ridge", "lasso", "tree")}
    assert ml.same_stages(base["ridge"], base["tree"]) and not ml.same_stages(base["ridge"], ml.pipeline("regression", "tree", ["b", "a"], "y"))
    fits, fit = [], ml.Imputer._fit
    monkeypatch.setattr(ml.Imputer, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    out = ml.base_predictions(rows, "k", base, ["a", "b"], "y", k=3)
    assert len(fits) == 3
    prepared = {}
    for meta in ("ridge", "linear"):
        assert ml.stacked_scores(out, "k", list(base), ["a", "b"], "y", meta, True, k=3, prepared=prepared).count() == 400
    assert len(fits) == 6 and sorted(prepared) == [0, 1, 2]
    marked, got = folds(rows, "k", 3, 42, "f"), {r.k: r for r in out.collect()}
    assert len(got) == 400
    for name, est in base.items():
        for i in range(3):
            for r in est.fit(marked.where(F.col("f") != i)).transform(marked.where(F.col("f") == i)).collect():
                assert abs(got[r.k][f"oof_{name}"] - r.prediction) < 1e-6


def test_blend_sweep_finds_the_better_model(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": y + 0.01 * rng.normal(size=200), "q": rng.normal(size=200)}))
    best = max(ml.blend_sweep(df, "y", "p", "q").collect(), key=lambda r: r.r2)
    assert best.w == 1.0


def test_classification_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "y int, p int")
    rep = {r.label: r for r in ml.classification_report(df, "y", "p").collect()}
    assert rep[1].precision == pytest.approx(2 / 3) and rep[1].recall == 1.0
    assert rep[2].f1 == 0.0 and rep[0].accuracy == pytest.approx(0.6)


def test_isolation_flags_far_points(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(380, 2)), rng.normal(size=(20, 2)) + 12])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(400, None, 1.0)], "id int, a double, b double")
    out = {r.id: r for r in ml.isolation_outliers(df, "id", ["a", "b"], contamination=0.05).collect()}
    assert len(out) == 401 and not out[400].is_outlier
    assert sum(out[i].is_outlier for i in range(380, 400)) >= 17


def test_permutation_importance_orders_features(frame):
    model = ml.pipeline("regression", "linear", FEATURES, "y").fit(frame)
    rows = ml.permutation_importance(frame, "id", model, FEATURES, "y").collect()
    assert [r.feature for r in rows] == ["a", "b", "c"]
    assert [r.direction for r in rows][:2] == [1.0, -1.0]


def test_bundle_round_trip(spark, frame):
    model = ml.pipeline("regression", "ridge", FEATURES, "y").fit(frame)
    path = shared_dir(spark, "bundle")
    ml.save_bundle(model, ml.regression_metrics(model.transform(frame), "y", "prediction"), path)
    loaded, metrics = ml.load_bundle(spark, path)
    assert ml.regression_metrics(loaded.transform(frame), "y", "prediction").first()["r2"] == pytest.approx(metrics.first()["r2"])


def test_task_detection(frame):
    assert ml.detect_task(frame, "label") == "classification"
    assert ml.detect_task(frame, "y") == "regression"


def test_hash_places_need_no_whole_cell(spark):
    """Places equal those of one sort of the cell, though it is ordered in many ranges."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cermetry.operators import ml

    df = spark.range(5000).withColumn("_cell", F.col("id") % 2)
    whole = F.row_number().over(Window.partitionBy("_cell").orderBy(F.xxhash64("id", F.lit(43)), "id"))
    want = {r.id: r.place for r in df.withColumn("place", whole).collect()}
    assert {r.id: r.place for r in ml.hash_places(df, "_cell", "id", 43, "place").collect()} == want
