"""Model training, evaluation and scoring with Spark ML."""

from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cermetry.functions.common import col, scalars
from cermetry.operators import boosting
from cermetry.operators.features import folds, hash_bucket, recursive_elimination
from cermetry.session import checked_broadcast, cut_lineage

REGRESSORS = {
    "linear": lambda **p: MR.LinearRegression(**p),
    "ridge": lambda **p: MR.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
    "lasso": lambda **p: MR.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0, **p}),
    "tree": lambda **p: MR.DecisionTreeRegressor(**p),
    "forest": lambda **p: MR.RandomForestRegressor(**{"seed": 42, **p}),
    "boosted": lambda **p: MR.GBTRegressor(**{"seed": 42, **p}),
}
CLASSIFIERS = {
    "logistic": lambda **p: MC.LogisticRegression(**p),
    "tree": lambda **p: MC.DecisionTreeClassifier(**p),
    "forest": lambda **p: MC.RandomForestClassifier(**{"seed": 42, **p}),
    "boosted": lambda **p: MC.GBTClassifier(**{"seed": 42, **p}),
    "linear_svc": lambda **p: MC.LinearSVC(**p),
}


def pipeline(task, name, features, target, **params):
    """Median imputation, assembly and the model; imputing inside the pipeline
    keeps validation rows out of the fitted medians."""
    table = REGRESSORS if task == "regression" else CLASSIFIERS
    filled = [f"{f}__filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        table[name](featuresCol="features", labelCol=target, **params),
    ])


def linear_prediction(model, features, name="prediction"):
    """Column with the prediction of a fitted ``pipeline`` of a linear regressor, as ``transform`` adds it:
    missing values filled as fitted, products added in the order of ``features``.

    One expression of plain arithmetic, where the stages make a vector of every row.
    """
    filled, line = model.stages[0].surrogateDF.first(), model.stages[-1]
    out = F.lit(0.0)
    for f, c in zip(features, line.coefficients.toArray()):
        v = F.col(f).cast("double")
        out = out + F.when(v.isNull() | F.isnan(v), F.lit(float(filled[f]))).otherwise(v) * F.lit(float(c))
    return (out + F.lit(float(line.intercept))).alias(name)


def detect_task(df, target):
    """Classification for text or fewer than 20 distinct values.

    Twenty distinct values are enough to decide, so the scan of distinct values
    stops there.
    """
    if dict(df.dtypes)[target] == "string":
        return "classification"
    return "classification" if df.select(target).where(F.col(target).isNotNull()).distinct().limit(20).count() < 20 else "regression"


# ---------------------------------------------------------------- metrics
def with_group_mean(df, by, c, name):
    """Append the mean of ``c`` over each group.  The means are one row per group;
    a few are broadcast, so that groups with most of the rows are not shuffled."""
    means = df.groupBy(*by).agg(F.avg(c).alias(name))
    return df.join(checked_broadcast(means), list(by))


def regression_metrics(df, y, pred, by=()):
    """n, mse, rmse, mae, r2 and mad, overall or per group.

    mad is the mean absolute deviation of the truth about its mean, which is the
    only statistic that needs the mean first: one number overall, one row per
    group with ``by``.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    err, t = F.col(y) - F.col(pred), F.col(y)
    if by:
        ok = with_group_mean(ok, by, y, "_mean")
    else:
        ok = ok.withColumn("_mean", scalars(ok.agg(F.avg(y).alias("_mean")))["_mean"])
    mean = F.col("_mean")
    out = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.var_pop(t).alias("_var"), F.avg(F.abs(t - mean)).alias("mad"))
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide(F.col("mse"), F.col("_var"))}).drop("_var")


def confusion(df, y, pred):
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df, y, pred):
    """Per class precision, recall, F1, support and the overall accuracy."""
    cells = confusion(df, y, pred)
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")))).alias("s"),
        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy("s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.called").alias("called"), (F.sum("hit") / 2).alias("hit"))
    acc = scalars(cells.agg(F.try_divide(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("a")))["a"]
    p, r = F.coalesce(F.try_divide("hit", "called"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return per.select(
        "label", p.alias("precision"), r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", acc.alias("accuracy"))


def overfit_ratio(train_r2, cv_r2):
    """(ratio, grade): above 1.2 moderate, above 1.1 mild, else low; a
    non-positive validation score has no finite ratio."""
    ratio = F.when(col(cv_r2) > 0, col(train_r2) / col(cv_r2))
    grade = F.when(ratio.isNull() | (ratio > 1.2), "moderate").when(ratio > 1.1, "mild").otherwise("low")
    return ratio, grade


def guarded_loss(val, train, penalty):
    """Validation error plus a penalty for exceeding the training error."""
    return col(val) + penalty * F.greatest(F.lit(0.0), col(val) - col(train))


def blend_sweep(df, y, p1, p2, steps=21):
    """Rows (w, r2, mae) of the blend w p1 + (1 - w) p2 for w = 0 .. 1.

    Every weight is a column of one aggregation, so the data is read once and
    never multiplied.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(p1).isNotNull() & F.col(p2).isNotNull())
    mean = scalars(ok.agg(F.avg(y).alias("m")))["m"]
    weights = [i / (steps - 1) for i in range(steps)]
    blend = lambda w: w * F.col(p1) + (1 - w) * F.col(p2)
    aggs = [F.sum((F.col(y) - mean) * (F.col(y) - mean)).alias("_t")]
    for i, w in enumerate(weights):
        e = F.col(y) - blend(w)
        aggs += [F.sum(e * e).alias(f"s{i}"), F.avg(F.abs(e)).alias(f"a{i}")]
    packed = F.array(*[F.struct(F.lit(w).alias("w"), (1 - F.col(f"s{i}") / F.col("_t")).alias("r2"), F.col(f"a{i}").alias("mae")) for i, w in enumerate(weights)])
    return ok.agg(*aggs).select(F.explode(packed).alias("b")).select("b.*")


def missing_features(required, provided):
    return F.array_except(F.array(*[F.lit(r) for r in required]), provided)


def positive_toughness(df, pred):
    """Negative predictions replaced by their size, with a marker column."""
    return df.withColumns({"was_negative": F.col(pred) < 0, pred: F.abs(pred)})


# ---------------------------------------------------------------- folds
#: folds whose models are fitted at the same time; each keeps its training rows cached
FOLDS_AT_ONCE = 3


def each_at_once(spark, fn, items):
    """``[fn(x) for x in items]`` with some calls running at the same time, as small Spark
    jobs leave cores idle.  Calls keep the session's properties; results keep their order."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fn), x) for x in items]]


def fit_after(estimator, train, prepared=None):
    """(fitted pipeline, its fitted stages before the model).

    ``prepared`` holds these stages fitted before on the same rows; they are not fitted again.
    """
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    if prepared is None:
        prepared = Pipeline(stages=stages[:-1]).fit(train).stages
    ready = PipelineModel(prepared).transform(train)
    return PipelineModel([*prepared, stages[-1].fit(ready)]), prepared


def out_of_fold(df, key, estimator, k=5, seed=42, out="oof", prepared=None):
    """Each row scored by the model that did not see its fold.

    ``prepared``, a dict, keeps per fold the fitted stages before the model.  Estimators that
    share these stages, and are fitted on the same rows and folds, pass the same dict.
    """
    marked = folds(df, key, k, seed, "_fold").drop(*[c for c in ("prediction", "features", "rawPrediction", "probability") if c in df.columns])
    marked = cut_lineage(marked, "folds")
    prepared = {} if prepared is None else prepared

    def score(i):
        model, prepared[i] = fit_after(estimator, marked.where(F.col("_fold") != i), prepared.get(i))
        scored = model.transform(marked.where(F.col("_fold") == i))
        return scored.select(*df.columns, F.col("_fold").alias(f"{out}_fold"), F.col("prediction").alias(out))

    return reduce(lambda a, b: a.unionByName(b), each_at_once(df.sparkSession, score, range(k)))


def stacking(df, key, base, features, target, k=5, seed=42):
    """(base models, meta model, rows with out-of-fold and final predictions).

    ``base`` maps names to pipelines.  The meta model is a ridge regression on
    the base models' out-of-fold predictions.
    """
    rows = df.select(key, target, *features)
    for name, est in base.items():
        oof = out_of_fold(rows, key, est, k, seed, f"oof_{name}").drop(f"oof_{name}_fold")
        rows = cut_lineage(oof, "oof")
    inputs = [f"oof_{n}" for n in base]
    meta = Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="features"),
        MR.LinearRegression(labelCol=target, regParam=1.0, elasticNetParam=0.0)]).fit(rows)
    fitted = {n: e.fit(df) for n, e in base.items()}
    return fitted, meta, meta.transform(rows)


META = {
    "ridge": lambda **p: MR.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
    "linear": lambda **p: MR.LinearRegression(**p),
    "forest": lambda **p: MR.RandomForestRegressor(**{"seed": 42, "numTrees": 50, **p}),
}


def base_predictions(df, key, base, features, target, k=5, seed=42):
    """Stored rows with the base models' out-of-fold predictions (``oof_<name>``).

    Base models with equal stages before the model (``same_stages``) share them per fold."""
    rows, known = df.select(key, target, *features), []
    for name, est in base.items():
        prepared = next((p for e, p in known if same_stages(e, est)), None)
        if prepared is None:
            known.append((est, prepared := {}))
        oof = out_of_fold(rows, key, est, k, seed, f"oof_{name}", prepared)
        rows = cut_lineage(oof.drop(f"oof_{name}_fold"), "oof")
    return rows


def same_stages(one, other):
    """Whether two pipelines have the same stages, with the same parameters, before their models."""
    def told(est):
        stages = est.getStages()[:-1] if isinstance(est, Pipeline) else []
        return [(type(s), {p.name: s.getOrDefault(p) for p in s.params if s.isSet(p)}) for s in stages]

    return told(one) == told(other)


def stacked_scores(rows, key, names, features, target, meta="ridge", passthrough=False, k=5, seed=42, prepared=None, **params):
    """``rows`` of ``base_predictions`` with the stack's own out-of-sample ``prediction``:
    the meta model that scores a fold has not seen it.

    ``meta`` is a key of ``META``; with ``passthrough`` the meta model sees the features
    (medians for missing ones) beside the predictions of the base models ``names``.
    ``prepared`` as in ``out_of_fold``: one dict for all meta models with the same inputs.
    """
    inputs = [f"oof_{n}" for n in names]
    stages = []
    if passthrough:
        filled = [f"{f}__filled" for f in features]
        stages.append(Imputer(strategy="median", inputCols=list(features), outputCols=filled))
        inputs += filled
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), META[meta](labelCol=target, **params)]
    return out_of_fold(rows, key, Pipeline(stages=stages), k, seed + 1, "prediction", prepared).drop("prediction_fold")


def across_folds(df, key, features, target, models, k=5, seed=42, every=False):
    """Predictions of boosted models on every fold, all grown together.

    Each of ``models`` (``boosting.Model`` without a fold) becomes ``k`` models, one
    per fold left out.  Rows as from ``boosting.predictions``.
    """
    marked = folds(df.select(key, *features, target), key, k, seed, "_fold").withColumn("_share", hash_bucket(key, 10_000, seed))
    table, _ = boosting.binned(marked, key, features, [target], "_fold", "_share")
    return boosting.predictions(table, [replace(m, fold=f) for m in models for f in range(k)], every)


def fold_stability(df, key, model, features, target, k=5, seed=42):
    """Per-fold metrics of out-of-fold predictions of a boosted model, with the fold spread."""
    oof = cut_lineage(across_folds(df, key, features, target, [model], k, seed), "oof")
    per = regression_metrics(oof, "target", "prediction", by=["fold"]).withColumnRenamed("fold", "oof_fold")
    spread = scalars(per.agg(F.stddev_pop("r2").alias("s")))["s"]
    grade = F.when(spread < 0.03, "excellent").when(spread < 0.05, "good").when(spread < 0.1, "fair").otherwise("poor")
    return per.withColumns({"r2_std": spread, "grade": grade})


def train_test_gap(df, key, estimator, target, seed=42):
    marked = df.withColumn("_train", hash_bucket(key, 100, seed) < 80)
    model = estimator.fit(marked.where("_train"))
    return regression_metrics(model.transform(marked), target, "prediction", by=["_train"]).withColumnRenamed("_train", "is_train")


def learning_curve(df, key, model, features, target, sizes=(0.1, 0.325, 0.55, 0.775, 1.0), k=5, seed=42):
    """Cross-validated train and test scores of a boosted model for nested training samples.

    In each of ``k`` folds the sample of a smaller size is part of each larger
    one; a score covers the rows of all folds.  All sizes and folds grow together.
    """
    models = [replace(model, name=str(s), share=float(s)) for s in sizes]
    scored = cut_lineage(across_folds(df, key, features, target, models, k, seed, every=True), "curve")
    own = F.pmod(F.col("model"), F.lit(k))
    part = F.when(F.col("seen"), "train").when(F.col("fold") == own, "test")
    scored = scored.withColumn("part", part).where("part IS NOT NULL")
    out = regression_metrics(scored, "target", "prediction", by=["name", "part"])
    return out.withColumn("size", F.col("name").cast("double")).drop("name")


def compare_presets(df, key, presets, features, target, k=5, seed=42):
    """Out-of-fold metrics per boosting preset: rows (preset, metrics).

    ``presets`` maps names to parameters of ``boosting.Model``; all presets and
    folds grow together.
    """
    models = [boosting.Model(name, **params) for name, params in presets.items()]
    oof = cut_lineage(across_folds(df, key, features, target, models, k, seed), "oof")
    return regression_metrics(oof, "target", "prediction", by=["name"]).withColumnRenamed("name", "preset")


def random_trials(n=20, seed=42, rounds=(50, 300), depth=(3, 10), rate=(0.01, 0.3), subsample=(0.5, 1.0)):
    """``n`` random points of the search space of a boosted model."""
    rng = np.random.default_rng(seed)
    return [boosting.Model(f"trial {i:02d}", rounds=int(rng.integers(rounds[0], rounds[1] + 1)), depth=int(rng.integers(depth[0], depth[1] + 1)),
                           rate=float(rng.uniform(*rate)), subsample=float(rng.uniform(*subsample)), seed=seed + i) for i in range(n)]


def search(df, key, features, target, trials, k=3, seed=42):
    """Cross-validated score of every trial, best first: rows (params, rounds, depth, rate,
    subsample, score, r2); the score is the negative mean squared error, averaged over
    folds.  All trials and folds grow together."""
    oof = cut_lineage(across_folds(df, key, features, target, trials, k, seed), "trials")
    per = regression_metrics(oof, "target", "prediction", by=["name", "fold"])
    per = per.groupBy("name").agg((-F.avg("mse")).alias("score"), F.avg("r2").alias("r2"))
    rows = df.sparkSession.createDataFrame([(m.name, m.rounds, m.depth, m.rate, m.subsample) for m in trials], "name string, rounds int, depth int, rate double, subsample double")
    return rows.join(per, "name").withColumnRenamed("name", "params").orderBy(F.desc("score"), "params")


# ---------------------------------------------------------------- models
def clusters(df, vector, k, seed=42):
    """(assigned rows, silhouette); -1 if everything falls into one cluster."""
    data = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed).fit(data)
    assigned = model.transform(data)
    used = assigned.select("prediction").distinct().count()
    score = ClusteringEvaluator().evaluate(assigned) if used > 1 else -1.0
    return assigned.drop("features"), score


def importances(spark, model, features):
    """Feature importances of the last stage of a fitted pipeline, best first."""
    values = model.stages[-1].featureImportances
    rows = [(f, float(values[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_bundle(model, metrics, path):
    """Pipeline and its metrics table below one folder."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_bundle(spark, path):
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metrics")


def hash_places(df, cell, key, seed, name, buckets=1024):
    """``df`` with the place ``name`` (1, 2, ...) of each row in its ``cell`` by a hash order of ``key``.

    Ranges of the hash are ordered apart and the counts of the ranges before are
    added, so that no task holds a cell.
    """
    from pyspark.sql import Window as W

    order = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumn("_range", F.floor(order / F.lit(2.0 ** 64 / buckets)))
    before = W.partitionBy(cell).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(cell, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(cell, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(cell, "_range").orderBy(order, key))
    return rows.withColumn(name, place).join(starts, [cell, "_range"]).withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


def permutation_importance(df, key, model, features, target, seed=42, cells=1, n=None):
    """Loss of R2 when one feature is exchanged between rows, largest first (the
    first ``n`` if given).

    A shuffled copy of a column is matched by two hash orders of the rows inside
    ``cells`` hash cells, which are ordered in ranges by many tasks.  The rows
    exchanged depend on ``cells`` and ``seed`` only.
    """
    base = df.select(key, target, *features)
    rows = base.withColumn("_cell", hash_bucket(key, cells, seed))
    rows = hash_places(hash_places(rows, "_cell", key, seed + 1, "_a"), "_cell", key, seed + 2, "_b")
    rows = cut_lineage(rows, "permute")
    reference = regression_metrics(model.transform(base), target, "prediction").select(F.col("r2").alias("base_r2"))
    reference = scalars(reference)["base_r2"]
    signs = scalars(model.transform(base).agg(*[F.corr(f, "prediction").alias(f) for f in features]))
    out = []
    for f in features:
        donor = rows.select("_cell", F.col("_b").alias("_a"), F.col(f).alias("_swap"))
        mixed = rows.drop("_b").join(donor, ["_cell", "_a"]).withColumn("_own", F.col(f)).withColumn(f, F.col("_swap"))
        scored = model.transform(mixed)
        m = regression_metrics(scored, target, "prediction").select(
            F.lit(f).alias("feature"), (reference - F.col("r2")).alias("importance"))
        out.append(m.withColumn("direction", F.signum(F.coalesce(signs[f], F.lit(0.0)))))
    ranked = reduce(lambda a, b: a.unionByName(b), out).orderBy(F.desc("importance"), "feature")
    return ranked if n is None else ranked.limit(n)


def feature_effects(df, key, features, target, model, n=None):
    """Mean size of each feature's contribution to the predictions of a boosted model, and the
    sign of the correlation between its values and contributions (that of their covariance); largest first (``n`` if given).
    """
    table, _ = boosting.binned(df, key, features, [target])
    parts = boosting.contributions(table, boosting.fit(table, [model])[0], len(features))
    both = df.select(F.col(key).alias("key"), *features).join(parts, "key")
    part = lambda i: F.get(F.col("parts"), F.lit(i))
    row = both.agg(*[x for i, f in enumerate(features) for x in (
        F.avg(F.abs(part(i))).alias(f"m{i}"), F.covar_pop(F.col(f).cast("double"), part(i)).alias(f"c{i}"))])
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("contribution"),
                                F.signum(F.coalesce(F.nanvl(f"c{i}", F.lit(0.0)), F.lit(0.0))).alias("direction")) for i, f in enumerate(features)])
    ranked = row.select(F.explode(packed).alias("e")).select("e.*").orderBy(F.desc("contribution"), "feature")
    return ranked if n is None else ranked.limit(n)


def eliminate(df, key, features, target, model, k=5, min_features=1, seed=42):
    """Recursive elimination by a boosted model: steps (size, features, out-of-fold R2), best first.

    The features are binned once.  Each step grows the models of all folds and of all
    rows together; the feature with the smallest mean contribution leaves.
    """
    features = list(features)
    table, _ = boosting.binned(folds(df.select(key, *features, target), key, k, seed, "_fold"), key, features, [target], "_fold")

    def fit(some):
        own = replace(model, only=tuple(features.index(f) for f in some))
        models = [replace(own, fold=f) for f in (*range(k), None)]
        fitted = boosting.fit(table, models)
        oof = boosting.apply_models(table, models[:k], fitted[:k])
        score = regression_metrics(oof, "target", "prediction").first()["r2"]
        parts = boosting.contributions(table, fitted[k], len(features))
        sizes = parts.agg(*[F.avg(F.abs(F.get(F.col("parts"), F.lit(i)))) for i in range(len(features))]).first()
        return {f: sizes[features.index(f)] for f in some}, score

    return recursive_elimination(fit, features, min_features)


def pca_loadings(df, vector, dim, k):
    """Rows (component, feature, loading, explained) by size of the loading."""
    data = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    pipe = Pipeline(stages=[
        StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True), PCA(k=k, inputCol="z", outputCol="p")])
    pca = pipe.fit(data).stages[-1]
    pc, var = pca.pc.toArray(), pca.explainedVariance.toArray()
    rows = [(c, i, float(pc[i, c]), float(var[c])) for c in range(k) for i in range(dim)]
    return df.sparkSession.createDataFrame(rows, "component int, feature int, loading double, explained double").orderBy(
        "component", F.desc(F.abs("loading")))


def pca_scores(df, key, columns, k):
    """Rows (key, pc1, ..., pck): standardised columns projected on the first
    components.  Rows with a missing value have no scores.  A component's sign
    makes its first non-zero loading positive.
    """
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=list(columns))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="v"),
        StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True), PCA(k=k, inputCol="z", outputCol="p")])
    _, scaler, pca = pipe.fit(rows).stages
    mean, std, pc = scaler.mean.toArray(), scaler.std.toArray(), pca.pc.toArray()
    sign = [1.0 if pc[np.flatnonzero(np.abs(pc[:, c]) > 1e-9)[0], c] > 0 else -1.0 for c in range(k)]
    scores = {f"pc{c + 1}": sum(((F.col(n) - float(mean[i])) * float(sign[c] * pc[i, c] / std[i]) for i, n in enumerate(columns) if std[i] > 0), F.lit(0.0)) for c in range(k)}
    return rows.select(key, *[v.alias(n) for n, v in scores.items()])


# ---------------------------------------------------------------- isolation forest
_EULER = 0.5772156649


def _path_norm(n):
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + _EULER) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x, rng, depth, limit, nodes):
    """Append the nodes of one isolation tree; returns the root's index."""
    me = len(nodes)
    nodes.append([-1, 0.0, -1, -1, depth + float(_path_norm(len(x)))])
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    if depth >= limit or len(x) <= 1 or not (spread > 0).any():
        return me
    f = rng.choice(np.flatnonzero(spread > 0))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    nodes[me][:2] = [f, cut]
    nodes[me][2] = _grow(x[x[:, f] < cut], rng, depth + 1, limit, nodes)
    nodes[me][3] = _grow(x[x[:, f] >= cut], rng, depth + 1, limit, nodes)
    return me


def isolation_outliers(df, key, columns, contamination=0.05, seed=42, trees=100, sample=256):
    """Add ``score`` and ``is_outlier``; rows with a NULL stay inliers.

    Each tree grows in its own task from a hash sample of ``sample`` rows.  The
    trees (a fixed number of nodes) go to the scoring tasks; the score cut is an
    exact quantile over all scored rows.
    """
    from cermetry.operators.ordering import quantiles

    full = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).select(
        key, *[F.col(c).cast("double").alias(c) for c in columns])
    n = full.count()
    if n == 0:
        return df.withColumns({"score": F.lit(None).cast("double"), "is_outlier": F.lit(False)})
    # candidates per tree: a hash threshold that yields about three samples' worth
    draw = lambda t: F.pmod(F.xxhash64(F.col(key), F.lit(seed), t), F.lit(1 << 40))
    limit = int(min(1.0, 3.0 * sample / n) * (1 << 40))
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < limit)
    drawn = full.withColumn("_t", F.explode(picked)).withColumn("_h", draw(F.col("_t")))
    depth = int(np.ceil(np.log2(max(2, min(sample, n)))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_t"].iloc[0])
        x = pdf.nsmallest(sample, "_h")[columns].to_numpy()
        nodes = []
        _grow(x, np.random.default_rng(seed * 1000 + t), 0, depth, nodes)
        out = pd.DataFrame(nodes, columns=["f", "cut", "lo", "hi", "len"])
        return out.assign(t=t, i=range(len(out)))[["t", "i", "f", "cut", "lo", "hi", "len"]]

    forest = drawn.groupBy("_t").applyInPandas(grow, "t int, i int, f int, cut double, lo int, hi int, len double").toPandas()
    built = [g.sort_values("i")[["f", "cut", "lo", "hi", "len"]].to_numpy() for _, g in forest.groupby("t")]
    norm = float(_path_norm(min(sample, n)))

    def score(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy()
            total = np.zeros(len(x))
            for tree in built:
                at = np.zeros(len(x), dtype=int)
                for _ in range(depth):
                    f = tree[at, 0].astype(int)
                    inner = f >= 0
                    go = x[np.arange(len(x)), np.maximum(f, 0)] < tree[at, 1]
                    at = np.where(inner, np.where(go, tree[at, 2], tree[at, 3]), at).astype(int)
                total += tree[at, 4]
            yield pd.DataFrame({key: pdf[key], "score": np.exp2(-total / len(built) / norm)})

    key_type = dict(full.dtypes)[key]
    scored = cut_lineage(full.mapInPandas(score, f"{key} {key_type}, score double"), "isolation")
    cut = scalars(quantiles(scored, [], [1 - contamination], value="score").select("quantile"))["quantile"]
    flagged = scored.withColumn("is_outlier", F.col("score") > cut)
    return df.join(flagged, key, "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))
