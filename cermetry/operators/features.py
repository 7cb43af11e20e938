"""Feature engineering and selection."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cermetry.functions.common import col, pinned, scalars, uniform
from cermetry.operators import quality as Q
from cermetry.operators.columns import clean_number
from cermetry.operators.ordering import melt, value_ranks
from cermetry.session import checked_broadcast, cut_lineage

DIFFERENCES = ("chi", "r", "tm", "bulk", "number", "mass", "rho")
RATIOS = ("bulk", "rho", "tm", "mass")


def two_phase_columns(df, props, binder_frac="binder_vol_frac", ceramic_frac="ceramic_vol_frac", grain="grain_size_um"):
    """Composite, difference and ratio columns from ``ceramic_mean_<p>`` and
    ``binder_mean_<p>`` pairs, with interface complexity and free path."""
    new = {}
    for p in props:
        c, b = F.col(f"ceramic_mean_{p}"), F.col(f"binder_mean_{p}")
        new[f"composite_mean_{p}"] = c * F.col(ceramic_frac) + b * F.col(binder_frac)
        if p in DIFFERENCES:
            new[f"diff_{p}"] = F.abs(c - b)
        if p in RATIOS:
            new[f"ratio_{p}"] = c / (b + 1e-6)
    f = F.col(binder_frac)
    new["interface_complexity"] = F.col(ceramic_frac) * (1 - F.col(ceramic_frac)) * 4
    new["mean_free_path"] = F.col(grain) * f / (1 - f + 1e-6)
    return df.withColumns(new)


def two_phase_maps(df, ceramic, binder, ceramic_pct, binder_pct, grain):
    """Maps ``mean``, ``diff`` and ``ratio`` over the properties both maps share."""
    pc, pb = col(ceramic_pct), col(binder_pct)
    # each step pinned: the next reads its maps more than once
    df = df.withColumns({"_c": pinned(col(ceramic)), "_b": pinned(col(binder)), "_pc": pinned(pc), "_pb": pinned(pb)})
    df = df.withColumn("_shared", pinned(F.array_intersect(F.map_keys("_c"), F.map_keys("_b"))))
    pick = lambda m: pinned(F.map_filter(m, lambda k, _: F.array_contains("_shared", k)))
    df = df.withColumns({"_c": pick("_c"), "_b": pick("_b")})
    zipped = lambda fn: pinned(F.map_zip_with("_c", "_b", lambda k, c, b: fn(c, b)))
    return df.withColumns({
        "mean": zipped(lambda c, b: c * F.col("_pc") / 100 + b * F.col("_pb") / 100),
        "diff": zipped(lambda c, b: F.abs(c - b)),
        "ratio": zipped(lambda c, b: c / (b + 1e-6)),
        "interface_complexity": pc * pb / 10000,
        "mean_free_path": col(grain) / (pb + 1),
    }).drop("_c", "_b", "_pc", "_pb", "_shared")


def prepare_matrix(df, target, features):
    """Numbers from text, no NULL target, no constant feature, infinities NULL,
    medians for what is missing."""
    types = dict(df.dtypes)
    clean = {c: clean_number(c) if types[c] == "string" else F.col(c).cast("double") for c in [target, *features]}
    finite = lambda c: F.when(F.abs(c) != float("inf"), c)
    df = df.withColumns({c: F.nanvl(finite(e), F.lit(None)) for c, e in clean.items()}).na.drop(subset=[target])
    keep = [c for c in features if c not in Q.constant_columns(df, features)]
    return Q.fill_median(df.drop(*[c for c in features if c not in keep]), keep)


# ---------------------------------------------------------------- correlation
def average_ranks(df, key, columns):
    """Rows (key, one average-rank column per input column); rows without any value are left out.

    Values meet their ranks column by column: equal values are ranked once, a short
    list of ranks is broadcast, and a value held by many rows is split by adaptive
    skew handling otherwise.
    """
    long = melt(df, columns)
    ranks = cut_lineage(value_ranks(long, ["column"]).select(
        "column", "value", (F.col("below") + (F.col("n") + 1) / 2).alias("rank")), "ranks")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    out = df.select(key, *[number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        own = ranks.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("rank").alias(c))
        out = out.join(checked_broadcast(own), f"_v{i}", "left")
    return out.select(key, *columns).dropna("all", subset=list(columns))


def spearman_matrix(df, key, columns):
    """Rows (a, b, n, r, distance) of rank correlations; distance is 1 - |r|.

    Missing values take the column median first, so every pair ranks all rows.
    """
    filled = cut_lineage(Q.fill_median(df.select(key, *columns), columns), "filled")
    r = Q.correlation_matrix(average_ranks(filled, key, columns), columns)
    return r.withColumn("distance", 1 - F.abs("r"))


def wide_correlation(df, vector, dim):
    """Rows (i, j, n, r), i <= j, of Pearson correlations between the components
    of an array column.  Missing components are left out pairwise; a pair that is
    never known together has no row.
    """
    part = [F.get(F.col(vector), F.lit(i)).cast("double").alias(str(i)) for i in range(dim)]
    pairs = Q.block_correlations(df.select(*part), [str(i) for i in range(dim)])
    return pairs.where("n > 0").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "n", "r")


# ---------------------------------------------------------------- selection
def ward_clusters(distance, cut):
    """Cluster numbers of a small symmetric distance matrix, merged while the
    Ward distance stays within ``cut``.  Works on features, never on rows."""
    d = np.array(distance, dtype=float)
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d))
    label = np.arange(len(d))
    while len(d) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut:
            break
        rest = (size + size[i]) * d[i] ** 2 + (size + size[j]) * d[j] ** 2 - size * d[i, j] ** 2
        with np.errstate(invalid="ignore"):
            merged = np.sqrt(np.maximum(rest, 0.0) / (size + size[i] + size[j]))
        d[i, :] = d[:, i] = merged
        d[j, :] = d[:, j] = np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        if np.isinf(d).all():
            break
    return label


def cluster_selection(df, key, target, features, cut=0.7, critical=()):
    """Per correlation cluster the feature closest to the target, plus all
    critical features.  Rows (feature, cluster, abs_rho, selected).

    The rank correlations are a Spark job; clustering sees the p x p result
    (p features, a few hundred at most).
    """
    free = [f for f in features if f not in critical]
    rho = {(r["a"], r["b"]): r["r"] or 0.0 for r in spearman_matrix(df, key, [*features, target]).collect()}
    dist = np.array([[0.0 if a == b else 1 - abs(rho[a, b]) for b in free] for a in free])
    labels = ward_clusters(dist, cut) if len(free) > 1 else np.zeros(len(free), dtype=int)
    strength = {f: abs(rho[f, target]) for f in features}
    rows = []
    for c in sorted(set(labels)):
        members = [f for f, k in zip(free, labels) if k == c]
        best = max(members, key=lambda f: strength[f])
        rows += [(f, int(c), float(strength[f]), f == best) for f in members]
    rows += [(f, None, float(strength[f]), True) for f in critical]
    return df.sparkSession.createDataFrame(rows, "feature string, cluster int, abs_rho double, selected boolean")


def strongest_features(df, key, target, features, critical=(), n=50):
    """Critical features first, then by |rank correlation| with the target."""
    filled = cut_lineage(Q.fill_median(df.select(key, *features, target), [*features, target]), "filled")
    ranks = average_ranks(filled, key, [*features, target])
    r = Q.correlations(ranks, [(f, target) for f in features]).select(
        F.col("a").alias("feature"), F.abs("r").alias("abs_rho"), F.col("a").isin(*critical).alias("critical"))
    return r.orderBy(F.desc("critical"), F.desc_nulls_last("abs_rho"), "feature").limit(n)


def critical_first(importance, critical, n):
    flagged = importance.withColumn("critical", F.col("feature").isin(*critical))
    return flagged.orderBy(F.desc("critical"), F.desc("importance"), "feature").limit(n)


def manual_set(auto, removed, added):
    """(auto minus removed) plus added, as a feature table."""
    return auto.join(removed, "feature", "left_anti").unionByName(added).distinct()


def recursive_elimination(fit, features, min_features=1):
    """Drop the least important feature while the score does not suffer most.

    ``fit(list)`` returns ({feature: importance}, score), the score to maximise.
    Rows (size, features, score), best size first.
    """
    current, history = list(features), []
    while len(current) >= min_features:
        importances, score = fit(list(current))
        history.append((len(current), list(current), score))
        if len(current) == min_features:
            break
        current.remove(min(current, key=lambda f: (importances[f], f)))
    return sorted(history, key=lambda h: -h[2])


# ---------------------------------------------------------------- encoding, splits
def sorted_codes(labels, c, name, part_rows=500_000):
    """Distinct non-NULL values of ``c`` with their places (0, 1, ...) in sorted order.

    Ranges of the values are sorted in tasks of their own, in ``part_rows`` portions;
    a range's first place is the number of values in the ranges before, of which
    only the counts (one per range) reach the driver.
    """
    values = cut_lineage(labels.select(c).where(F.col(c).isNotNull()).distinct(), "labels")
    parts = -(-values.count() // part_rows) + 1
    ranged = values.repartitionByRange(parts, c).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")  # the ranges as dealt, whatever is recomputed later
    before, starts = 0, []
    for number, n in sorted(ranged.groupBy("_range").count().collect()):
        starts.append((number, before))
        before += n
    first = F.broadcast(labels.sparkSession.createDataFrame(starts, "_range int, _start long"))  # one row per range
    place = F.row_number().over(W.partitionBy("_range").orderBy(c)) - 1
    return ranged.withColumn("_place", place).join(first, "_range").select(c, (F.col("_start") + F.col("_place")).alias(name))


def label_encode(df, c, out):
    """Codes by sorted label order; NULL has none.

    The codes are a table of the distinct labels, joined back: labels never
    reach the driver, no task holds them all, and a short list is broadcast.
    """
    codes = sorted_codes(df, c, out).withColumn(out, F.col(out).cast("int"))
    return df.join(checked_broadcast(codes), c, "left")


def hash_bucket(key, buckets, seed=42):
    """Repeatable bucket number of a row, independent of partitioning."""
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(buckets)).cast("int")


def row_bucket(df, key, buckets, seed=42):
    """Bucket number of a row by its key: integer keys by the arithmetic draw
    (``uniform``), which any engine can restate, others by a hash."""
    if dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        return F.floor(uniform(key, 0, seed) * buckets).cast("int")
    return hash_bucket(key, buckets, seed)


def train_flag(df, key, share=0.8, seed=42, name="is_train"):
    return df.withColumn(name, row_bucket(df, key, 10000, seed) < round(share * 10000))


def folds(df, key, k=5, seed=42, name="fold"):
    return df.withColumn(name, row_bucket(df, key, k, seed))


def group_folds(df, group, name="fold"):
    """One fold per group value, numbered in sorted order; NULL is a group of its own, the first."""
    codes = sorted_codes(df, group, name).withColumn(name, F.col(name).cast("int"))
    nulls = scalars(df.agg(F.count_if(F.col(group).isNull()).alias("n")))["n"] > 0
    shift = F.when(nulls, 1).otherwise(0)
    return df.join(checked_broadcast(codes), group, "left").withColumn(name, F.coalesce(F.col(name) + shift, F.lit(0)))


def scale(df, columns, train, how="standard"):
    """Scale by statistics of the rows where ``train`` holds (population
    deviation); a constant column scales by 1."""
    base = df.where(train)
    lo = F.avg if how == "standard" else F.min
    hi = F.stddev_pop if how == "standard" else (lambda c: F.max(c) - F.min(c))
    stats = scalars(base.agg(*[x for c in columns for x in (lo(c).alias(f"o_{c}"), hi(c).alias(f"s_{c}"))]))
    unit = lambda c: F.coalesce(F.nullif(stats[f"s_{c}"], F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: (F.col(c) - stats[f"o_{c}"]) / unit(c) for c in columns})


def align(df, expected, keep=()):
    """Exactly the expected columns, in order; absent, NULL, NaN and infinite
    values become 0."""
    def value(c):
        if c not in df.columns:
            return F.lit(0.0).alias(c)
        v = F.col(c).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias(c)

    return df.select(*keep, *[value(c) for c in expected])
