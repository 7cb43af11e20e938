"""Exact order statistics without sending a whole column through one task.

The digits of a double (exponent, then slices of the mantissa) give an
order-preserving key of bounded width.  Histograms over one digit are small
whatever the data volume, so ranks and quantiles come from a few map-side
combined aggregations instead of a global sort or a per-value hash table.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cermetry.session import cut_lineage

_COARSE = 1024.0
_FINE = float(1 << 20)


def digits(v):
    """Two order-preserving integers of a double; equal pairs leave 22 mantissa
    bits open.

    The first joins the signed exponent with ten mantissa bits, the second holds
    the next twenty.  Scaling by a power of two is exact, so order is too.
    Infinities have end digits of their own; NULL and NaN have none.
    """
    inf = F.lit(float("inf"))
    plain = F.when(~F.isnan(v) & (F.abs(v) < inf), v)
    e = F.floor(F.log2(F.abs(plain)))
    exponent = F.signum(plain) * (e + 2000)
    scaled = plain / F.pow(F.lit(2.0), e) * _COARSE
    coarse = F.floor(scaled)
    ends = lambda c, end: F.when(v == 0, F.lit(0)).when(v == inf, F.lit(end)).when(v == -inf, F.lit(-end)).otherwise(c).cast("long")
    return ends(exponent * 8192 + coarse, 1 << 40), ends(F.floor((scaled - coarse) * _FINE), 0)


def melt(df, columns, keep=()):
    """Rows (keep..., column, value) of numeric columns' values; NULL and NaN are missing."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column", "value").where("value IS NOT NULL AND NOT isnan(value)")


def quantiles(long, keys, probs, value="value"):
    """Exact linear-interpolation quantiles: rows (keys..., prob, quantile).

    Three passes: first digit, second digit, value.  Each counts the values that
    share what is known so far and keeps the one entry that holds the rank.  The
    carried table has two rows per key and probability; whether it is small
    enough to broadcast is left to the optimizer, which sees its size.  NULL
    and NaN are missing; infinities are the smallest and largest values.
    """
    keys = list(keys)
    data = long.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    data = data.withColumns(dict(zip(("_d1", "_d2"), digits(F.col("_v")))))

    # first digit: histogram and the ranks wanted per key
    hist = data.groupBy(*keys, "_d1").agg(F.count(F.lit(1)).alias("_n"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    run = part.orderBy("_d1").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({"_cum": F.sum("_n").over(run), "_total": F.sum("_n").over(part)})
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    pos = (F.col("_total") - 1) * F.col("prob")
    targets = (
        hist.select(*keys, "_d1", "_n", "_cum", "_total", wanted)
        .select("*", F.explode(F.array(F.floor(pos), F.ceil(pos))).alias("_k"), (pos - F.floor(pos)).alias("_w"))
        .where("_cum - _n <= _k AND _k < _cum")
        .distinct()
        .select(*keys, "prob", "_w", "_k", "_d1", (F.col("_cum") - F.col("_n")).alias("_below"))
    )
    found = ["_d1"]
    for digit in ("_d2", "_v"):
        state = [*keys, "prob", "_w", "_k", "_below", *found]
        hist = data.join(targets, [*keys, *found]).groupBy(*state, digit).agg(F.count(F.lit(1)).alias("_n"))
        run = W.partitionBy(*keys, "prob", "_k").orderBy(digit).rowsBetween(W.unboundedPreceding, 0)
        targets = (
            hist.withColumn("_cum", F.col("_below") + F.sum("_n").over(run))
            .where("_cum - _n <= _k AND _k < _cum")
            .select(*keys, "prob", "_w", "_k", *found, digit, (F.col("_cum") - F.col("_n")).alias("_below"))
        )
        found.append(digit)
    lo, hi = F.min("_v"), F.max("_v")
    # equal ends first: the difference of two infinities is no number
    between = F.when((lo == hi) | (F.max("_w") == 0), lo).otherwise(lo + (hi - lo) * F.max("_w"))
    return targets.groupBy(*keys, "prob").agg(between.alias("quantile"))


def column_quantiles(df, columns, probs):
    """One row with ``<column>_<percent>`` exact quantiles of numeric columns."""
    q = quantiles(melt(df, columns), ["column"], probs)
    name = lambda c, p: f"{c}_{round(p * 100)}"
    return q.agg(*[
        F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("quantile"))).alias(name(c, p))
        for c in columns for p in probs
    ])


def value_ranks(long, keys, value="value"):
    """Per distinct value: count and number of smaller rows (keys..., value, n, below).

    Equal values are combined before the shuffle.  Offsets come from the bounded
    histogram over the first two digits; the rest is ranked inside one digit
    cell, so no task sees a whole column.
    """
    keys = list(keys)
    counts = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    d1, d2 = digits(F.col(value).cast("double"))
    counts = counts.withColumns({"_d1": d1, "_d2": d2})
    cells = counts.groupBy(*keys, "_d1", "_d2").agg(F.sum("n").alias("_n"))
    tops = cells.groupBy(*keys, "_d1").agg(F.sum("_n").alias("_t"))
    before = lambda part, order: W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    part = keys or [F.lit(1)]
    tops = tops.withColumn("_o1", F.coalesce(F.sum("_t").over(before(part, "_d1")), F.lit(0))).drop("_t")
    cells = cells.join(tops, [*keys, "_d1"]).withColumn(
        "_o2", F.col("_o1") + F.coalesce(F.sum("_n").over(before([*keys, "_d1"], "_d2")), F.lit(0))
    ).select(*keys, "_d1", "_d2", "_o2")
    return (
        counts.join(cells, [*keys, "_d1", "_d2"])
        .withColumn("below", F.col("_o2") + F.coalesce(
            F.sum("n").over(before([*keys, "_d1", "_d2"], value)), F.lit(0)))
        .select(*keys, value, "n", "below")
    )


def _running_max(points, order, value, descending=False, own=True, by=()):
    """Append ``best``: the largest ``value`` up to each row by ``order`` (distinct
    values per group ``by``), with or without the row's own.

    Three levels of cells: first digit, second digit, the values themselves.  Each
    level's running maximum starts from the one above, so the widest window
    holds the first digits that occur, and the others what shares a digit,
    however the values are spread.
    """
    way = F.desc if descending else F.asc
    by = list(by)
    d1, d2 = digits(F.col(order).cast("double"))
    points = points.withColumns({"_d1": d1, "_d2": d2})
    cells = points.groupBy(*by, "_d1", "_d2").agg(F.max(value).alias("_m"))
    before = lambda part, on: W.partitionBy(*part).orderBy(way(on)).rowsBetween(W.unboundedPreceding, -1)
    tops = cells.groupBy(*by, "_d1").agg(F.max("_m").alias("_t"))
    tops = tops.withColumn("_o1", F.max("_t").over(before(by, "_d1"))).drop("_t")
    cells = cells.join(tops, [*by, "_d1"]).withColumn("_o2", F.greatest("_o1", F.max("_m").over(before([*by, "_d1"], "_d2")))).drop("_o1", "_m")
    inner = W.partitionBy(*by, "_d1", "_d2").orderBy(way(order)).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    return points.join(cells, [*by, "_d1", "_d2"]).withColumn("best", F.greatest(F.max(value).over(inner), "_o2")).drop("_d1", "_d2", "_o2")


def running_best(df, order, value):
    """Running maximum of ``value`` by ``order`` (one row per order value).

    Equal orders are combined first; rows without an order have no place in it.
    """
    points = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.max(value).alias(value))
    return _running_max(points, order, value).select(order, value, "best")


#: points of tasks' own fronts that are ordered by one window; beyond, by digits
FRONT_POINTS = 200_000


def _own_fronts(points, by):
    """What no other point of the same task dominates: usually very few points."""
    columns = points.columns

    def thin(frame):
        frame = frame.drop_duplicates().sort_values([*by, "_x", "_y"], ascending=[True] * len(by) + [False, False])
        groups = frame.groupby(by, sort=False)["_y"] if by else None
        top = groups.cummax() if by else frame["_y"].cummax()
        above = top.groupby([frame[c] for c in by], sort=False).shift() if by else top.shift()
        return frame[above.isna() | (frame["_y"] > above)]

    def run(batches):
        kept = None
        for frame in batches:
            kept = thin(frame if kept is None else pd.concat([kept, frame], ignore_index=True))
        if kept is not None:
            yield kept[columns]

    return points.mapInPandas(run, points.schema)


#: rows of its own front beyond which a task hands them on and begins another
HELD_ROWS = 100_000


def thinned(df, x, y, by=()):
    """``df`` without rows that others of the same task dominate in (x, y) within their group; what ``skyline``
    finds among the rows left is what it finds among all.  Rows with a missing coordinate or group are dropped."""
    by = list(by)
    complete = df.dropna(subset=[*by, x, y])

    def thin(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        group = np.zeros(table.num_rows, dtype=np.int64)
        for c in by:
            codes = table.column(c).combine_chunks().dictionary_encode()
            group = group * max(len(codes.dictionary), 1) + codes.indices.to_numpy()
        px, py = (table.column(c).combine_chunks().cast(pa.float64()).to_numpy() for c in (x, y))
        order = np.lexsort((-py, -px, group))
        group, px, py = group[order], px[order], py[order]
        other = lambda v: np.concatenate(([True], v[1:] != v[:-1]))
        first = other(group) | other(px) | other(py)  # of equal points
        best = np.empty(int(first.sum()), dtype=bool)
        group, py = group[first], py[first]
        starts = np.flatnonzero(other(group))
        for a, z in zip(starts, [*starts[1:], len(group)]):
            best[a] = True
            best[a + 1:z] = py[a + 1:z] > np.maximum.accumulate(py[a:z])[:-1]
        return table.take(pa.array(order[best[np.cumsum(first) - 1]])).to_batches()

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            if batch.num_rows:
                kept, size = [*kept, batch], size + batch.num_rows
            if size > 2 * HELD_ROWS:
                kept = thin(kept)
                size = sum(b.num_rows for b in kept)
                if size > HELD_ROWS:
                    yield from kept
                    kept, size = [], 0
        if size:
            yield from thin(kept)

    return complete.mapInArrow(run, complete.schema)


def skyline(df, x, y, by=(), front_points=FRONT_POINTS):
    """Rows not dominated in (x, y), both maximised, overall or within each group ``by``.

    Every task first drops what its own rows dominate.  What is left is counted: up
    to ``front_points`` points one window per group compares them, beyond that the
    digits of ``x`` spread the comparison.  For each distinct ``x`` only its largest
    ``y`` counts; it is on the front if it exceeds the largest ``y`` of all larger
    ``x``.  Rows with a missing (NULL or NaN) coordinate or group are on no front.
    """
    by = list(by)
    points = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    best = cut_lineage(_own_fronts(points, by), "fronts")
    small = best.count() <= front_points
    best = best.groupBy(*by, "_x").agg(F.max("_y").alias("_y"))
    if small:
        above = W.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("_x")).rowsBetween(W.unboundedPreceding, -1)
        front = best.withColumn("best", F.max("_y").over(above))
    else:
        front = _running_max(best, "_x", "_y", descending=True, own=False, by=by)
    front = front.where("best IS NULL OR _y > best").select(*[F.col(c).alias(f"_by_{c}") for c in by], "_x", "_y")
    if small:
        front = F.broadcast(front)  # no more rows than were counted
    same = (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y"))
    for c in by:
        same &= F.col(c) == F.col(f"_by_{c}")
    return df.join(front, same, "left_semi")
