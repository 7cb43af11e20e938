"""Order statistics against brute force, with skew, ties and extreme values."""

import numpy as np
import pandas as pd
import pytest

from cermetry.operators import features as G
from cermetry.operators import ordering as O
from cermetry.operators import quality as Q


def data(kind, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    return {
        "normal": rng.normal(size=n), "wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n).astype(float)),
        "constant": np.zeros(n), "powers": 2.0 ** rng.integers(-5, 6, n) * rng.choice([-1, 1], n),
        "ends": np.array([np.inf, -np.inf, 1.0, 2.0, -3.0, np.inf, 0.0]), "one": np.array([3.5]), "tiny": np.array([5e-324, -5e-324, 0.0, 1.0]),
    }[kind]


KINDS = ["normal", "wide", "hot", "constant", "powers", "ends", "one", "tiny"]


@pytest.mark.parametrize("kind", KINDS)
def test_quantiles_match_brute_force(spark, kind):
    x = data(kind)
    df = spark.createDataFrame(pd.DataFrame({"value": x}))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in O.quantiles(df, [], probs).collect()}
    s = np.sort(x)
    for p in probs:
        at = (len(s) - 1) * p
        lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
        share = at - np.floor(at)
        assert got[p] == pytest.approx(lo if lo == hi or share == 0 else lo + (hi - lo) * share, rel=1e-12, abs=0)


@pytest.mark.parametrize("kind", KINDS)
def test_ranks_match_brute_force(spark, kind):
    x = data(kind, 1000)
    df = spark.createDataFrame(pd.DataFrame({"value": x}))
    got = {r["value"]: (r["n"], r["below"]) for r in O.value_ranks(df, []).collect()}
    want = {v: (int((x == v).sum()), int((x < v).sum())) for v in np.unique(x)}
    assert got == want


def test_grouped_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0)], "k string, value double")
    got = {r["k"]: r["quantile"] for r in O.quantiles(df, ["k"], [0.5]).collect()}
    assert got == {"a": 2.0, "b": 5.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_running_best(spark, seed):
    x = np.random.default_rng(seed).normal(size=700)
    df = spark.createDataFrame(pd.DataFrame({"t": range(700), "v": x}))
    got = O.running_best(df, "t", "v").orderBy("t").toPandas()["best"]
    assert np.allclose(got, np.maximum.accumulate(x))


@pytest.mark.parametrize("levels", [5, 40, 100000])
def test_skyline(spark, levels):
    rng = np.random.default_rng(levels)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, levels, (400, 2)))]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = sorted(r.id for r in O.skyline(df, "x", "y").collect())
    beats = lambda p, q: p[1] >= q[1] and p[2] >= q[2] and (p[1] > q[1] or p[2] > q[2])
    assert got == [q[0] for q in pts if not any(beats(p, q) for p in pts)]


@pytest.mark.parametrize("kind", ["outlier", "narrow", "repeated", "ends"])
def test_running_best_of_uneven_orders(spark, kind):
    """One far point, a narrow range, 90 % equal keys and infinities all give the running maximum."""
    rng = np.random.default_rng(5)
    t = {"outlier": np.append(rng.random(500), 1e12), "narrow": 1.7e9 + rng.random(500) * 1e-3,
         "repeated": np.where(rng.random(500) < 0.9, 3.0, rng.random(500)), "ends": np.append(rng.normal(size=300), [np.inf, -np.inf])}[kind]
    v = rng.normal(size=len(t))
    got = O.running_best(spark.createDataFrame(pd.DataFrame({"t": t, "v": v})), "t", "v").toPandas().sort_values("t")
    want = pd.DataFrame({"t": t, "v": v}).groupby("t").v.max().cummax()
    assert np.array_equal(got.t, want.index) and np.allclose(got.best, want)


def test_missing_and_infinite_values(spark):
    """NaN and NULL are missing, infinities are ordered; nothing aborts."""
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),), (2.0,), (float("-inf"),), (3.0,)], "a double")
    got = {r["prob"]: r["quantile"] for r in O.quantiles(O.melt(df, ["a"]), ["column"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: float("-inf"), 0.5: 2.0, 1.0: float("inf")}
    filled = Q.fill_median(df, ["a"]) if hasattr(Q, "fill_median") else df
    assert filled.count() == 7


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(300), "a": rng.integers(0, 20, 300).astype(float), "b": rng.normal(size=300)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=300)
    got = {(r.a, r.b): r.r for r in G.spearman_matrix(spark.createDataFrame(pdf), "id", ["a", "b", "c"]).collect()}
    want = pdf[["a", "b", "c"]].rank().corr()
    assert all(got[i, j] == pytest.approx(want.loc[i, j]) for i in "abc" for j in "abc")


def test_wide_correlation_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) + 100
    x[rng.random((200, 5)) < 0.1] = np.nan
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)
    got = {(r.i, r.j): r.r for r in G.wide_correlation(df, "v", 5).collect()}
    want = pd.DataFrame(x).corr()
    assert all(got[i, j] == pytest.approx(want.iloc[i, j]) for i in range(5) for j in range(i, 5))


def ward_by_definition(points, cut):
    """Ward distance of clusters from centroids, for points in a plane."""
    groups = [[i] for i in range(len(points))]
    def dist(a, b):
        ca, cb = points[a].mean(axis=0), points[b].mean(axis=0)
        return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(ca - cb)
    while len(groups) > 1:
        d, i, j = min((dist(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("cut", [0.3, 1.0, 50.0])
def test_ward_clusters(cut):
    pts = np.random.default_rng(5).normal(size=(15, 2))
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    labels = G.ward_clusters(d, cut)
    got = sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in set(labels))
    assert got == ward_by_definition(pts, cut)


def test_cluster_selection_drops_twins(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"id": range(400), "a": a, "a2": a * 2 + 1, "b": b, "k": rng.normal(size=400), "y": a + 0.1 * b})
    got = G.cluster_selection(spark.createDataFrame(pdf), "id", "y", ["a", "a2", "b", "k"], 0.5, ["k"])
    chosen = {r.feature for r in got.where("selected").collect()}
    assert len(chosen & {"a", "a2"}) == 1 and {"b", "k"} <= chosen


def test_duplicates_with_hot_and_null_keys(spark):
    rows = [(None, i) for i in range(50)] + [(1, 0), (2, 0), (2, 1)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = Q.duplicates(df, ["k"])
    assert got.count() == 52 and got.where("k = 1").count() == 0


def test_mean_fill_of_small_frame(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (None, 55.0)], "a double, b double")
    got = Q.fill_mean(df, ["a", "b"]).orderBy("b").collect()
    assert [r.b for r in got] == [10.0, 32.5, 55.0]


def test_mode_prefers_smallest(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (10.0,), (9.0,), (None,)], "a double")
    assert Q.fill_mode(df, ["a"]).where("a = 9").count() == 3


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (1.5,), (9.0,), (None,)], "m double")
    got = [r[0] for r in df.select(Q.magnetic_class("m")).collect()]
    assert got == [None, "Low", "Medium", "Medium", "High", None]


def test_outlier_fences(spark):
    x = list(range(1, 100)) + [1000]
    r = Q.outlier_impact(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert r.upper_bound == pytest.approx(q3 + 1.5 * (q3 - q1)) and r.outlier_count == 1 and r.severity == "ok"


@pytest.mark.parametrize("front_points", [200_000, 0])
def test_grouped_skylines_against_brute_force(spark, front_points):
    rng = np.random.default_rng(8)
    rows = [(int(i), "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-6, 12, size=(400, 2)))]
    rows += [(400, "a", None, 99.0), (401, "b", float("nan"), 99.0), (402, None, 99.0, 99.0), (403, "c", -1.0, -1.0), (404, "c", -1.0, -1.0)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double").repartition(5)

    def brute(points, by):
        own = [p for p in points if p[2] is not None and p[2] == p[2] and (p[1] is not None or not by)]
        worse = lambda p, q: q[2] >= p[2] and q[3] >= p[3] and (q[2] > p[2] or q[3] > p[3]) and (not by or p[1] == q[1])
        return {p[0] for p in own if not any(worse(p, q) for q in own)}

    for by in ([], ["g"]):
        assert {r.id for r in O.skyline(df, "x", "y", by, front_points).collect()} == brute(rows, by)
    assert O.skyline(df.limit(0), "x", "y").count() == 0


def test_block_correlations_of_a_thousand_columns(spark):
    """All pairs of 1,000 columns with gaps, in one pass and without an aggregate per pair."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 1000)) + 50
    x[:, 1] = x[:, 0] * 2
    x[:, 2] = 0.1  # constant up to rounding
    x[rng.random(x.shape) < 0.02] = np.nan
    names = [f"c{i}" for i in range(1000)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    got = Q.block_correlations(df, names).toPandas()
    assert len(got) == 1000 * 1001 // 2
    known = ~np.isnan(x)
    want = np.ma.corrcoef(np.ma.masked_invalid(x[:, [0, 1, 3, 70, 999]]), rowvar=False)
    at = got.set_index(["i", "j"])
    for p, i in enumerate([0, 1, 3, 70, 999]):
        for q, j in enumerate([0, 1, 3, 70, 999]):
            if i <= j:
                both = known[:, i] & known[:, j]
                assert at.loc[(i, j), "n"] == both.sum()
                assert at.loc[(i, j), "r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
    assert at.loc[(2, 5), "r"] is None or np.isnan(at.loc[(2, 5), "r"])
    pairs = Q.correlations(df.select("c0", "c1", "c3"), [("c3", "c0"), ("c1", "c0")]).collect()
    assert {(r.a, r.b): r.r for r in pairs} == pytest.approx({("c3", "c0"): at.loc[(0, 3), "r"], ("c1", "c0"): at.loc[(0, 1), "r"]})
    matrix = Q.correlation_matrix(df.select("c0", "c3"), ["c0", "c3"]).collect()
    assert {(r.a, r.b) for r in matrix} == {("c0", "c0"), ("c0", "c3"), ("c3", "c0"), ("c3", "c3")}


def test_average_ranks_with_ties_and_gaps(spark):
    rows = [(1, 5.0, None), (2, 5.0, 1.0), (3, -1.0, float("nan")), (4, None, None), (5, 7.0, -0.0), (6, 5.0, 0.0)]
    got = {r.id: (r.a, r.b) for r in G.average_ranks(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"]).collect()}
    assert got == {1: (3.0, None), 2: (3.0, 3.0), 3: (1.0, None), 5: (5.0, 1.5), 6: (3.0, 1.5)}
