"""Small column helpers shared by every module."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain Python variable would repeat the whole expression at each use.
    """
    return F.transform(F.array(value), body)[0]


def pinned(value: Column) -> Column:
    """Keep an expensive expression in the one projection that computes it.

    A filter on its result would otherwise be pushed below that projection as a
    second copy of the expression, ahead of any repartitioning.  The condition is
    always true; being partition-dependent, it stops the copying.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def dbl(value) -> Column:
    return F.lit(None if value is None else float(value)).cast("double")


NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def to_double(c) -> Column:
    """Text to double; unparsable text and NaN become NULL.

    The pattern is tested first because a failing cast costs an exception, which
    dominates the run time where most texts are not numbers.
    """
    c = col(c)
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def r6(c, digits=6) -> Column:
    """Round for comparison; adding zero removes a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def sql_double(value) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"{float(value)!r}D"


def literal_map(values: dict) -> Column:
    """A constant map from text to double, folded to one literal by the optimizer.

    Spelled as one SQL text, which is far cheaper to build than nested calls.
    """
    return F.expr(f"map({', '.join(f'{k!r}, {sql_double(v)}' for k, v in values.items())})")


def total(values: Column, start=0.0) -> Column:
    """Sum of an array of doubles; NULL items count as zero."""
    return F.aggregate(values, F.lit(start), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def clamp(c, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def scalars(one_row) -> Column:
    """A one-row frame as a struct column for use in another query.

    A scalar subquery runs once and reaches the tasks as a constant.
    """
    return one_row.select(F.struct("*").alias("_row")).scalar()


_M = 2147483647


def uniform(key, stream, seed=42):
    """A number in (0, 1) from the row id, equal on every retry and in any
    engine with 64-bit integers; ``stream`` separates draws of one row."""
    key = col(key).cast("long")
    k = F.pmod(key, F.lit(_M))
    # the rest of the 64-bit id, so that draws do not repeat every _M ids
    rest = F.pmod(F.call_function("div", key, F.lit(_M)), F.lit(_M)) - F.when(key < 0, F.lit(1)).otherwise(F.lit(0))
    a = F.pmod(k * 48271 + rest * 69621 + (stream + 1) * 7919 + seed * 104729, F.lit(_M))
    b = (a * a + (stream + 1) * 15485863 + 12345) % _M
    c = (b * b + a) % _M
    return (c + 0.5) / _M


def uniforms(df, key, streams, seed=42):
    """``df`` with a column per item of ``streams`` (name: stream) that holds ``uniform``.

    The steps are pinned columns: written as one expression each, a draw would repeat its
    steps five times, and many draws would make a method too long to be compiled.
    """
    key = col(key).cast("long")
    rest = F.pmod(F.call_function("div", key, F.lit(_M)), F.lit(_M)) - F.when(key < 0, F.lit(1)).otherwise(F.lit(0))
    steps = {n: (f"_a_{n}", f"_b_{n}") for n in streams}
    df = df.withColumns({"_key": pinned(F.pmod(key, F.lit(_M))), "_rest": pinned(rest)})
    df = df.withColumns({a: pinned(F.pmod(F.col("_key") * 48271 + F.col("_rest") * 69621 + (streams[n] + 1) * 7919 + seed * 104729, F.lit(_M))) for n, (a, _) in steps.items()})
    df = df.withColumns({b: pinned((F.col(a) * F.col(a) + (streams[n] + 1) * 15485863 + 12345) % _M) for n, (a, b) in steps.items()})
    df = df.withColumns({n: pinned(((F.col(b) * F.col(b) + F.col(a)) % _M + 0.5) / _M) for n, (a, b) in steps.items()})
    return df.drop("_key", "_rest", *[x for ab in steps.values() for x in ab])
