"""Aggregation, profiling, cleaning and validation."""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cermetry.functions import constants as K
from cermetry.functions.common import col, scalars, to_double, total
from cermetry.operators.ordering import column_quantiles, melt, quantiles
from cermetry.session import checked_broadcast


# ---------------------------------------------------------------- fills
def _fill_from(df, stats, columns):
    """Coalesce with the fill values of a one-row frame."""
    fill = scalars(stats)
    return df.withColumns({c: F.coalesce(F.col(c), fill[c]) for c in columns})


def fill_mean(df, columns):
    return _fill_from(df, df.agg(*[F.avg(c).alias(c) for c in columns]), columns)


def fill_median(df, columns):
    """Median fill, exact; columns without a NULL stay as they are."""
    medians = column_quantiles(df, columns, [0.5]).select(*[F.col(f"{c}_50").alias(c) for c in columns])
    return _fill_from(df, medians, columns)


def modes(df, columns):
    """One row of most frequent values as text, the smallest on a tie.

    Counting is by (column, value), so no single task holds a column's values.
    """
    items = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.explode(items).alias("i")).where("i.v IS NOT NULL").groupBy("i.c", "i.v").agg(
        F.count(F.lit(1)).alias("n"))
    number = F.col("v").try_cast("double")
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), number.alias("d"), F.col("v").alias("v"))).alias("b"))
    return best.agg(*[F.max(F.when(F.col("c") == c, F.col("b.v"))).alias(c) for c in columns])


def fill_mode(df, columns):
    types = dict(df.dtypes)
    found = modes(df, columns).select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
    return _fill_from(df, found, columns)


# ---------------------------------------------------------------- profiles
def describe(df, columns):
    """Rows (column, n, mean, std, min, q25, q50, q75, max)."""
    long = melt(df, columns)
    base = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, ["column"], [0.25, 0.5, 0.75]).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{round(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return base.join(q, "column")


def _one_pass(df, exprs, names):
    """Aggregate ``{(name, stat): expr}`` in one pass and return rows per name."""
    stats = sorted({s for _, s in exprs})
    row = df.agg(*[e.alias(f"{n}__{s}") for (n, s), e in exprs.items()])
    packed = F.array(*[
        F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{s}").alias(s) for s in stats]) for n in names])
    return row.select(F.explode(packed).alias("r")).select("r.*")


def column_info(df):
    types = dict(df.dtypes)
    rows = _one_pass(df, {(c, "non_null"): F.count(c) for c in df.columns}, df.columns)
    lookup = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    return rows.withColumn("dtype", lookup[F.col("column")])


def missing_report(df, columns=None):
    """Columns with missing values: count and percent, most first."""
    columns = columns or df.columns
    n = F.count(F.lit(1))
    exprs = {}
    for c in columns:
        exprs[(c, "missing")] = n - F.count(c)
        exprs[(c, "missing_pct")] = F.try_divide(n - F.count(c), n) * 100
    return _one_pass(df, exprs, columns).where("missing > 0").orderBy(F.desc("missing"), "column")


def worst_columns(df, n=10, over=50.0):
    return missing_report(df).where(F.col("missing_pct") > over).orderBy(F.desc("missing_pct"), "column").limit(n)


def target_statistics(df, targets):
    exprs = {}
    for t in targets:
        exprs.update({(t, "n"): F.count(t), (t, "mean"): F.avg(t), (t, "std"): F.stddev_samp(t),
                      (t, "min"): F.min(t), (t, "max"): F.max(t)})
    return _one_pass(df, exprs, targets)


def constant_columns(df, columns):
    """Columns with at most one distinct non-null value.

    Minimum against maximum decides that in one pass without a distinct count.
    """
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def drop_constant(df, columns):
    return df.drop(*constant_columns(df, columns))


def drop_zero_variance(df, columns):
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not row[c]])


def quality_profile(df, columns):
    """Validity, moments, median, three-sigma outliers and a grade per column."""
    long = melt(df, columns)
    moments = long.groupBy("column").agg(
        F.count("value").alias("valid"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    marked = long.join(F.broadcast(moments), "column")
    outliers = marked.groupBy("column").agg(
        F.count_if(F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std")).alias("outliers"))
    medians = quantiles(long, ["column"], [0.5]).select("column", F.col("quantile").alias("median"))
    pct = F.col("valid") / scalars(df.agg(F.count(F.lit(1)).alias("rows")))["rows"] * 100
    grade = (
        F.when(F.col("valid_pct") < 30, "poor").when(F.col("valid_pct") < 70, "fair")
        .when(F.col("outliers") / F.col("valid") > 0.1, "outliers").otherwise("good"))
    return (
        moments.join(outliers, "column").join(medians, "column")
        .withColumn("valid_pct", pct).withColumn("grade", grade))


def outlier_impact(df, target):
    """IQR fences, outliers beyond them, severity and values below mean - 3 std."""
    fences = column_quantiles(df, [target], [0.25, 0.75]).select(
        (F.col(f"{target}_25") - 1.5 * (F.col(f"{target}_75") - F.col(f"{target}_25"))).alias("lower_bound"),
        (F.col(f"{target}_75") + 1.5 * (F.col(f"{target}_75") - F.col(f"{target}_25"))).alias("upper_bound"))
    f = scalars(fences)
    m = scalars(df.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std")))
    t = F.col(target)
    out = df.agg(
        F.count(target).alias("n"),
        F.count_if((t < f["lower_bound"]) | (t > f["upper_bound"])).alias("outlier_count"),
        F.count_if(t < m["mean"] - 3 * m["std"]).alias("extreme_low"))
    ratio = F.col("outlier_count") / F.col("n") * 100
    return out.withColumns({
        "outlier_ratio": ratio, "severity": F.when(ratio > 5, "warning").otherwise("ok"),
        "lower_bound": f["lower_bound"], "upper_bound": f["upper_bound"]}).drop("n")


# ---------------------------------------------------------------- correlation
#: columns of a block of moments
BLOCK = 64


def _merge(a, b):
    """Combine two sets of pair moments: n, means of both, and centred squares and products."""
    n = a[0] + b[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * share
    return np.stack((n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w))


def _moments(x, y):
    """Moments of all column pairs of two matrices over rows where both are known."""
    cx, cy = (np.nan_to_num(np.where(np.isnan(m).all(axis=0), 0.0, np.nansum(m, axis=0) / np.maximum((~np.isnan(m)).sum(axis=0), 1))) for m in (x, y))
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x, y = np.where(mx > 0, x - cx, 0.0), np.where(my > 0, y - cy, 0.0)
    n, sx, sy = mx.T @ my, x.T @ my, mx.T @ y
    safe = np.maximum(n, 1)
    return np.stack((n, cx[:, None] + sx / safe, cy[None, :] + sy / safe, (x * x).T @ my - sx * sx / safe, mx.T @ (y * y) - sy * sy / safe, x.T @ y - sx * sy / safe))


def block_correlations(df, columns, pairs=None):
    """Rows (i, j, n, r) of Pearson correlations of column pairs by number, pairwise where
    both are known (NULL and NaN are missing); r is NULL where a side does not vary.

    All pairs i <= j, or the given ones.  Columns are taken in blocks of ``BLOCK``: a
    task folds its rows into moments of block pairs by matrix products, and moments of
    one block pair meet in one place, so any number of columns is one pass and
    nothing is built per pair.
    """
    p = len(columns)
    wanted = {}
    for i, j in pairs if pairs is not None else ((i, j) for i in range(p) for j in range(i, p)):
        wanted.setdefault((i // BLOCK, j // BLOCK), []).append((i, j))
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))

    def run(batches):
        total = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for a, b in wanted:
                own = _moments(x[:, a * BLOCK:(a + 1) * BLOCK], x[:, b * BLOCK:(b + 1) * BLOCK])
                total[a, b] = _merge(total[a, b], own) if (a, b) in total else own
        rows = [(a, b, t.tobytes()) for (a, b), t in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["a", "b", "data"])

    def join(frame):
        a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        shape = (6, min(BLOCK, p - a * BLOCK), min(BLOCK, p - b * BLOCK))
        total = reduce(_merge, (np.frombuffer(d).reshape(shape) for d in frame["data"]))
        i, j = np.array(wanted[a, b]).T
        n, mx, my, xx, yy, xy = total[:, i - a * BLOCK, j - b * BLOCK]
        # squares within rounding of the mean's are no variation
        flat = (xx <= 1e-24 * n * mx * mx) | (yy <= 1e-24 * n * my * my) | (n < 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(flat, np.nan, xy / np.sqrt(xx * yy))
        return pd.DataFrame({"i": i, "j": j, "n": n.astype(np.int64), "r": np.clip(r, -1, 1)})

    packed = df.select(F.array(*[number(c) for c in columns]).alias("x")).mapInArrow(run, "a int, b int, data binary")
    found = packed.groupBy("a", "b").applyInPandas(join, "i int, j int, n bigint, r double")
    return found.withColumn("r", F.nanvl("r", F.lit(None)))


def correlations(df, pairs):
    """Rows (a, b, n, r): Pearson over rows where both are known, in one pass for any number of pairs."""
    columns = list(dict.fromkeys(c for pair in reversed(pairs) for c in reversed(pair)))
    at = {c: i for i, c in enumerate(columns)}
    numbers = [(at[a], at[b]) for a, b in pairs]
    names = F.array(*[F.lit(c) for c in columns])
    found = block_correlations(df, columns, numbers)
    return found.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), "n", "r")


def correlation_matrix(df, columns):
    """Rows (a, b, n, r) of all ordered pairs of columns."""
    columns = list(columns)
    names = F.array(*[F.lit(c) for c in columns])
    half = block_correlations(df, columns)
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b"))))
    return half.select(F.explode(both).alias("p"), "n", "r").select("p.a", "p.b", "n", "r")


SUSPICIOUS = ("hv", "hardness", "kic", "toughness", "trs")


def leakage(df, target, features, limit=0.95, min_pairs=10):
    """Features that nearly equal the target, and those named like a target."""
    r = correlations(df, [(f, target) for f in features])
    strong = r.where((F.col("n") > min_pairs) & (F.abs("r") > limit)).select(
        F.col("a").alias("feature"), F.lit("high_correlation").alias("issue"), "r")
    named = [f for f in features if any(k in f.lower() for k in SUSPICIOUS)]
    names = r.where(F.col("a").isin(*named)).select(
        F.col("a").alias("feature"), F.lit("suspicious_name").alias("issue"), F.lit(None).cast("double").alias("r"))
    return strong.unionByName(names)


def collinear_pairs(df, features, limit=0.9):
    """Feature pairs (listed order) beyond ``limit`` after median fill."""
    filled = fill_median(df.select(*features), features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    return correlations(filled, pairs).where(F.abs("r") > limit).orderBy(F.desc(F.abs("r")), "a", "b")


def expected_signs(df, target, expectations):
    """Correlation against the expected sign: ``positive`` needs r > 0.1,
    ``negative`` r < -0.1, ``uncertain`` always passes."""
    r = correlations(df, [(f, target) for f in expectations])
    want = F.create_map(*[x for f, s in expectations.items() for x in (F.lit(f), F.lit(s))])[F.col("a")]
    ok = (F.when(want == "positive", F.col("r") > 0.1).when(want == "negative", F.col("r") < -0.1).otherwise(F.lit(True)))
    return r.where("n > 10").select(F.col("a").alias("feature"), "r", want.alias("expected"), F.coalesce(ok, F.lit(False)).alias("ok"))


# ---------------------------------------------------------------- checks
def duplicates(df, keys):
    """All rows whose key combination occurs more than once; NULL equals NULL.

    Counts are combined map-side and joined back, so a key that holds much of
    the data is never gathered in one window.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    renamed = repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "copies")
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(renamed, cond)
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def physics_issues(df):
    """Range problems of the stored physics features, as one array."""
    a = df.agg(
        F.min("lattice_mismatch").alias("m0"), F.max("lattice_mismatch").alias("m1"),
        F.min("vec_binder").alias("v0"), F.max("vec_binder").alias("v1"),
        F.min("binder_density").alias("d0"), F.max("binder_density").alias("d1"),
        (F.avg(F.when(F.col("pred_formation_energy") > 0, 1.0).when(F.col("pred_formation_energy").isNotNull(), 0.0)) * 100).alias("pos"))
    return a.select(F.array_compact(F.array(
        F.when(F.col("m0") < 0, "lattice_mismatch: below zero").when(F.col("m1") > 1, "lattice_mismatch: above one"),
        F.when((F.col("v0") < 3) | (F.col("v1") > 12), "vec_binder: outside 3 to 12"),
        F.when((F.col("d0") < 1) | (F.col("d1") > 25), "binder_density: outside 1 to 25"),
        F.when(F.col("pos") > 10, "pred_formation_energy: positive in over a tenth"))).alias("issues"), "pos")


def hea_consistency(df):
    """Rows per element count with flags; few elements with the flag is an error."""
    return df.groupBy("element_count").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_hea").alias("hea")).withColumn(
        "issue", F.when((F.col("element_count") == 2) & (F.col("hea") > 0), "flagged with two elements")
        .when((F.col("element_count") < 5) & (F.col("hea") > 0), "flagged below five elements"))


def prediction_plausibility(df, pred):
    p = F.col(pred)
    return df.agg(
        F.count_if(p < 0).alias("negative"), F.count_if(p < 500).alias("below_500"),
        F.count_if(p > 3000).alias("above_3000"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.avg(p).alias("mean"))


# ---------------------------------------------------------------- classes
def _grade(c, limits):
    """The level of a value among left-closed steps; missing values are unknown."""
    v = col(c)
    above = sum(F.when(v >= x, 1).otherwise(0) for x in limits)
    return F.when(v.isNull(), "Unknown").otherwise(F.element_at(F.array(*map(F.lit, K.GRADES)), above + 1))


def hardness_grade(c):
    return _grade(c, K.HARDNESS_LIMITS)


def toughness_grade(c):
    return _grade(c, K.TOUGHNESS_LIMITS)


def binder_class(c):
    u = F.upper(col(c))
    has = lambda s: u.contains(s)
    return (
        F.when(u.isNull(), "Unknown").when(has("NI") & has("CO"), "Co-Ni").when(has("CO"), "Co-based")
        .when(has("NI"), "Ni-based").when(has("FE"), "Fe-based").otherwise("Other"))


def ceramic_class(c):
    u = F.upper(col(c))
    return (
        F.when(u.isNull(), "Unknown").when(u.contains("WC"), "WC-based")
        .when(u.contains("TIC") | u.contains("TIN"), "Ti-carbide/nitride").otherwise("Other"))


def magnetic_class(c):
    """Right-closed bins of the absolute moment; exactly 0 has no class."""
    v = F.abs(col(c))
    return F.when((v > 0) & (v <= 0.5), "Low").when((v > 0.5) & (v <= 1.5), "Medium").when(v > 1.5, "High")


def stability_class(c):
    v = col(c)
    return F.when(v <= -0.1, "Excellent").when(v <= 0, "Good").when(v <= 0.1, "Fair").when(v > 0.1, "Poor")


def category_counts(df, c):
    return df.groupBy(c).count().orderBy(F.desc("count"), c)


# ---------------------------------------------------------------- distributions
def bin_of(c, lo, width):
    return F.floor((col(c) - lo) / width).cast("bigint")


def histogram(df, c, lo, width):
    return df.where(F.col(c).isNotNull()).groupBy(bin_of(c, lo, width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def grid_counts(df, x, y, wx, wy):
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(bin_of(x, 0.0, wx).alias("bx"), bin_of(y, 0.0, wy).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def cross_table(df, rows, cols, values):
    """Two-way counts over an explicit list of column values, zeros filled."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(f"c_{v}") for v in values])


def symbol_occurrences(df, c, symbols, by=()):
    """Rows whose text contains each symbol, optionally per group, in one pass."""
    agg = df.groupBy(*by).agg(*[F.count_if(F.col(c).contains(s)).alias(s) for s in symbols])
    return agg.unpivot(list(by), list(symbols), "symbol", "n")


def mean_deviation(df, c, by=None):
    """Mean absolute deviation from the mean, overall or per group."""
    if by is None:
        mean = scalars(df.agg(F.avg(c).alias("m")))["m"]
        return df.agg(F.avg(F.abs(F.col(c) - mean)).alias("mad"))
    mean = df.groupBy(by).agg(F.avg(c).alias("_m"))
    return df.join(checked_broadcast(mean), by).groupBy(by).agg(F.avg(F.abs(F.col(c) - F.col("_m"))).alias("mad"))


def standardize(df, columns):
    """Z-scores with the population deviation; constant columns drop out."""
    keep = [c for c in columns if c not in constant_columns(df, columns)]
    stats = scalars(df.agg(*[x for c in keep for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]))
    out = df.withColumns({c: F.try_divide(F.col(c) - stats[f"m_{c}"], stats[f"s_{c}"]) for c in keep})
    return out.drop(*[c for c in columns if c not in keep])


def min_max(df, columns):
    stats = scalars(df.agg(*[x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]))
    return df.withColumns({
        c: (F.col(c) - stats[f"lo_{c}"]) / (stats[f"hi_{c}"] - stats[f"lo_{c}"] + 1e-10) for c in columns})


def vector_scalar(c, how="mean"):
    """``"-0.02 0.03"`` to mean or sum of absolute values.

    ``mean`` gives 0 for unreadable text, ``sum`` gives NULL.
    """
    parts = F.transform(F.split(F.trim(col(c)), r"\s+"), lambda x: F.abs(to_double(x)))
    good = F.forall(parts, lambda x: x.isNotNull())
    if how == "sum":
        return F.when(good, total(parts))
    return F.when(good, total(parts) / F.size(parts)).otherwise(0.0)


def funnel(df, stages):
    """Rows that pass every condition up to each stage, in one pass."""
    exprs, so_far = [F.count(F.lit(1)).alias("input")], F.lit(True)
    for name, cond in stages:
        so_far = so_far & cond
        exprs.append(F.count_if(so_far).alias(name))
    names = ["input", *[n for n, _ in stages]]
    packed = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(n).alias("n"),
                                (F.try_divide(F.col(n), F.col("input")) * 100).alias("pct")) for i, n in enumerate(names)])
    return df.agg(*exprs).select(F.explode(packed).alias("s")).select("s.*")


def residual_report(df, y, pred):
    """Moments of the residual, rows above the 95th percentile of its size and
    rows beyond three standard deviations."""
    r = df.select((F.col(y) - F.col(pred)).alias("res")).where("res IS NOT NULL").withColumn("size", F.abs("res"))
    base = r.agg(F.avg("res").alias("mean"), F.stddev_samp("res").alias("std"), F.min("res").alias("min"), F.max("res").alias("max"))
    m, cut = scalars(base), scalars(column_quantiles(r, ["size"], [0.95]))["size_95"]
    counts = scalars(r.agg(
        F.count_if(F.col("size") > cut).alias("high_error"),
        F.count_if(F.abs(F.col("res") - m["mean"]) > 3 * m["std"]).alias("outliers")))
    return base.withColumns({"high_cut": cut, "high_error": counts["high_error"], "outliers": counts["outliers"]})
