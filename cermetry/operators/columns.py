"""Schema standardisation, projection and predicates (``DataFrame -> DataFrame``)."""

from functools import reduce

from pyspark.sql import functions as F

from cermetry.functions import constants as K
from cermetry.functions.common import clamp, col, to_double, total


# ---------------------------------------------------------------- names
def standard_name(name):
    return name.lower().strip().replace(" ", "_")


def standardize_columns(df, aliases=K.COLUMN_ALIASES):
    """Rename columns whose lower-cased, underscored name is a known alias.

    Of several columns with the same meaning the first keeps the plain name and
    the others get ``_2``, ``_3``, so nothing is lost before
    :func:`merge_columns` combines them.
    """
    lookup = {a: name for name, names in aliases.items() for a in [name, *names]}
    seen, renames = {}, {}
    for c in df.columns:
        target = lookup.get(standard_name(c))
        if target:
            seen[target] = seen.get(target, 0) + 1
            renames[c] = target if seen[target] == 1 else f"{target}_{seen[target]}"
    return df.withColumnsRenamed(renames)


def map_columns(df, aliases=K.SHEET_ALIASES):
    """Exact alias mapping, English or Chinese, case-sensitive."""
    lookup = {a: name for name, names in aliases.items() for a in names}
    return df.withColumnsRenamed({c: lookup[c] for c in df.columns if c in lookup})


def find_column(columns, variants):
    """The first column, in frame order, whose trimmed lower-cased name contains
    one of the variants or is contained in one; None if there is none."""
    known = [v.lower() for v in variants]
    fits = (c for c in columns if any(c.strip().lower() in v or v in c.strip().lower() for v in known))
    return next(fits, None)


def select_columns(df, dtypes=None, prefix=None, names=None):
    """Columns by type, by name prefix or by list, in frame order."""
    picked = [
        c for c, t in df.dtypes
        if (dtypes and t in dtypes) or (prefix and c.startswith(prefix)) or (names and c in names)
    ]
    return df.select(*picked)


# ---------------------------------------------------------------- merging
def merge_columns(df, target, columns, strategy="first"):
    """Combine same-meaning columns into ``target`` and drop the sources.

    ``first``/``last`` non-null, ``mean`` of the non-null ones, or ``mode``
    (smallest on a tie).  All NULL gives NULL.
    """
    cols = [F.col(c) for c in columns]
    items = F.filter(F.array(*cols), lambda x: x.isNotNull())
    if strategy == "first":
        merged = F.coalesce(*cols)
    elif strategy == "last":
        merged = F.coalesce(*reversed(cols))
    elif strategy == "mean":
        merged = F.try_divide(total(items), F.size(items).cast("double"))
    elif strategy == "mode":
        counted = F.transform(
            F.array_distinct(items),
            lambda v: F.struct((-F.size(F.filter(items, lambda x: x == v))).alias("n"), v.alias("v")),
        )
        merged = F.array_min(counted)["v"]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumn("_merged", merged).drop(*columns).withColumnRenamed("_merged", target)


def add_columns(df, new, policy="fill"):
    """Add columns ``{name: expression}`` under a conflict policy: ``fill`` NULLs
    of an existing column, ``replace`` it, ``keep`` it, or add as ``name_new``."""
    out = {}
    for name, value in new.items():
        if name not in df.columns or policy == "replace":
            out[name] = value
        elif policy == "fill":
            out[name] = F.coalesce(F.col(name), value)
        elif policy == "suffix":
            out[f"{name}_new"] = value
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- values
def coerce_numeric(df, columns):
    """Text columns to doubles; what does not parse becomes NULL."""
    return df.withColumns({c: to_double(c) for c in columns})


def clean_missing(c):
    """Trim; the missing-value words become NULL."""
    t = F.trim(col(c))
    return F.when(~t.isin(*K.MISSING_TOKENS), t)


def clean_number(c):
    return to_double(clean_missing(c))


def measure(c):
    """Sheet number: thousands commas dropped, ``-`` is missing."""
    t = F.trim(F.regexp_replace(col(c), ",", ""))
    return to_double(F.when(t != "-", t))


def number_or(c, default):
    return F.coalesce(measure(c), F.lit(float(default)))


def field_check(name, c):
    """Struct (valid, message) for a range rule; NULL and unknown fields pass."""
    value = col(c)
    if name not in K.FIELD_RANGES:
        return F.struct(F.lit(True).alias("valid"), F.lit(None).cast("string").alias("message"))
    lo, hi = K.FIELD_RANGES[name]
    bad = (value < lo) | (value > hi)
    return F.struct(
        (~F.coalesce(bad, F.lit(False))).alias("valid"),
        F.when(bad, F.lit(f"{name} outside [{lo}, {hi}]")).alias("message"),
    )


def usable_targets(df, candidates, max_missing=0.5, min_valid=10):
    """Names of the candidates with enough values; one aggregation pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in candidates]).first()
    n = row["_n"] or 1
    return [c for c in candidates if row[c] >= min_valid and 1 - row[c] / n < max_missing]


# ---------------------------------------------------------------- composition checks
def composition_errors(m):
    """Array of error words for a composition map."""
    lim, v = K.COMPOSITION_LIMITS, F.map_values(m)
    t = total(v)
    return F.array_compact(F.array(
        F.when(m.isNull() | (F.size(m) == 0), "empty"),
        F.when(F.size(m) > lim["max_elements"], "too_many_elements"),
        F.when(F.exists(v, lambda x: x < 0), "negative_share"),
        F.when(F.exists(v, lambda x: x > lim["max_share"]), "share_above_one"),
        F.when((F.size(m) > 0) & ((t < lim["min_total"]) | (t > lim["max_total"])), "total_off"),
    ))


def composition_warnings(m):
    lim = K.COMPOSITION_LIMITS
    known = [*(k for k in K.ELEMENTS if k not in ("Si", "B")), "Re", "Ru"]
    return F.array_compact(F.array(
        F.when(F.exists(F.map_keys(m), lambda k: ~k.isin(*known)), "unknown_element"),
        F.when(F.exists(F.map_values(m), lambda x: x < lim["min_share"]), "trace_share"),
    ))


def composition_ok(m, tolerance=0.01):
    v = F.map_values(m)
    return F.coalesce(
        (F.size(m) > 0) & (F.abs(total(v) - 1.0) <= tolerance) & F.forall(v, lambda x: x > 0),
        F.lit(False),
    )


def design_issues(columns):
    """(errors, warnings) arrays for ``{limit name: column}``."""
    errors, warnings = [], []
    for name, c in columns.items():
        lo, hi, rec_lo, rec_hi = K.DESIGN_LIMITS[name]
        errors.append(F.when(~col(c).between(lo, hi), name))
        if rec_lo is not None:
            warnings.append(F.when(~col(c).between(rec_lo, rec_hi), name))
    return F.array_compact(F.array(*errors)), F.array_compact(F.array(*warnings))


def check_predictions(long_df, ranges):
    """Rows (metric, value) to ``ok`` / ``atypical`` / ``out_of_range``.

    ``ranges`` is the small range table; a metric without a range passes.
    """
    v = F.col("value")
    verdict = (
        F.when((v < F.col("lo")) | (v > F.col("hi")), "out_of_range")
        .when((v < F.col("typical_lo")) | (v > F.col("typical_hi")), "atypical")
        .otherwise("ok")
    )
    return long_df.join(ranges, "metric", "left").withColumn("verdict", verdict)


# ---------------------------------------------------------------- projections and filters
def preview(df, key, n=10):
    return df.orderBy(key).limit(n)


def percent_parts(c):
    """Fraction, complement and clamped value of a percentage."""
    c = col(c)
    return {"fraction": c / 100.0, "complement": 100 - c, "clamped": clamp(c, 0.0, 100.0)}


def display_text(c, width=60):
    return F.coalesce(F.substring(col(c), 1, width), F.lit(""))


def yes_no(c):
    return F.when(col(c), "Yes").otherwise("No")


def minute_stamp(c):
    return F.date_format(col(c), "yyyy-MM-dd HH:mm")


def conjunction(equals=None, ranges=None, present=(), contains=None):
    """AND of equality, closed-range, not-null and substring conditions.

    Range ends may be None.  The substring test ignores case.
    """
    terms = [F.lit(True)]
    terms += [F.col(c) == v for c, v in (equals or {}).items()]
    for c, (lo, hi) in (ranges or {}).items():
        terms += [F.col(c) >= lo] if lo is not None else []
        terms += [F.col(c) <= hi] if hi is not None else []
    terms += [F.col(c).isNotNull() for c in present]
    terms += [F.col(c).ilike(f"%{text}%") for c, text in (contains or {}).items()]
    return reduce(lambda a, b: a & b, terms)


def drop_missing(df, subset=None):
    return df.na.drop(subset=subset)
