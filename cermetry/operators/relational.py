"""Storage-level queries over the experiment star and the materials library."""

from pyspark.sql import functions as F

from cermetry.functions import constants as K
from cermetry.functions import physics as P
from cermetry.functions.common import col
from cermetry.operators.columns import conjunction, display_text, yes_no
from cermetry.operators.parsing import composition_record, parse_compositions
from cermetry.operators.quality import fill_median, hardness_grade, toughness_grade
from cermetry.session import cut_lineage, shared_dir
from cermetry.sources import versions


# ---------------------------------------------------------------- the star
BINDER_FEATURES = ("vec_binder", "mean_atomic_radius", "binder_density", "mean_atomic_mass", "std_electronegativity")


def binder_features(df):
    """``df`` with ``BINDER_FEATURES`` in place of ``rows`` and ``rho_b`` (``composition_record``)."""
    r = F.col("rows")
    values = (P.vec_strict(r), P.weighted_or_null(r, "r"), F.col("rho_b"), P.weighted_or_null(r, "mass"), P.chi_spread(r))
    return df.select(*[c for c in df.columns if c not in ("rows", "rho_b")], *[v.alias(n) for n, v in zip(BINDER_FEATURES, values)])


def feature_columns(compositions, proxies=None):
    """The stored feature record per composition; surrogate outputs joined by id.

    ``compositions`` may hold the columns of ``binder_features`` already.
    """
    out = compositions
    if not set(BINDER_FEATURES) <= set(out.columns):
        out = out.select("exp_id", "ceramic_formula", P.element_rows(F.col("binder")).alias("rows"))
        out = binder_features(out.withColumn("rho_b", P.alloy_density(F.col("rows"))))
    out = out.select("exp_id", *BINDER_FEATURES, "ceramic_formula")
    if proxies is not None:
        out = out.join(proxies, "exp_id", "left")
        out = out.withColumn("lattice_mismatch", P.relative_gap(
            F.col("pred_lattice_param") / K.SQRT2, P.ceramic_neighbour(F.coalesce("ceramic_formula", F.lit("WC")))))
    return out.drop("ceramic_formula").withColumns({"has_full": F.lit(None).cast("boolean")})


def intake(raw, properties, proxies):
    """Four stored tables plus the rejected rows from one parse of the input.

    The parsed rows are stored once and read for all tables.  Properties carry the
    grades of hardness and toughness, compositions the volumes of both phases.
    """
    parsed = cut_lineage(parse_compositions(raw), "parsed")
    ok = parsed.where("parsed IS NOT NULL")
    comps = cut_lineage(composition_record(ok), "compositions")
    known = properties.join(ok.select("exp_id"), "exp_id", "left_semi")
    return {
        "experiments": ok.drop("parsed"),
        "compositions": comps.drop("binder", "format").withColumn("ceramic_vol_pct", 100 - F.col("binder_vol_pct")),
        "properties": known.withColumns({"hardness_grade": hardness_grade("hv"), "toughness_grade": toughness_grade("kic")}),
        "features": feature_columns(comps, proxies),
        "rejected": parsed.where("parsed IS NULL").drop("parsed"),
    }


def store_intake(spark, root, batch, raw, properties, proxies):
    """Parse a batch and add its tables to the store under ``root`` in one commit.

    Returns False, and stores nothing, if the batch was committed before.
    """
    if versions.committed(spark, root, batch):
        return False
    return versions.commit(spark, root, batch, intake(raw, properties, proxies))


def store_star(star, spark, buckets=16, spread=()):
    """The star's tables written in ``buckets`` by ``exp_id``, sorted, to the shared folder.

    Joins of two such tables by ``exp_id`` need no exchange, and a given key reads
    one bucket.  Choose ``buckets`` so that a bucket fits a task.  The tables named in
    ``spread`` come with one partition per bucket and are written without an exchange.
    """
    out = {}
    for name, df in star.items():
        path = shared_dir(spark, name)
        table = "star_" + path.rsplit("/", 1)[1].replace("-", "_")
        (df if name in spread else df.repartition(buckets, "exp_id")).write.bucketBy(buckets, "exp_id").sortBy("exp_id").option("path", path).saveAsTable(table)
        out[name] = spark.table(table)
    return out


def training_data(star, target, features, hea_only=False, min_samples=10, fill=True):
    """Joined rows whose target is known; raises when there are too few.

    ``fill`` replaces missing feature values by the column median.
    """
    df = (
        star["experiments"].join(star["compositions"], "exp_id").join(star["properties"], "exp_id")
        .join(star["features"], "exp_id", "left").where(F.col(target).isNotNull())
    )
    if hea_only:
        df = df.where("is_hea")
    # the row check and the median passes each read the result, so store it once
    df = cut_lineage(df.select("exp_id", target, *features), "training")
    found = df.limit(min_samples).count()
    if found < min_samples:
        raise ValueError(f"only {found} samples with {target}, need {min_samples}")
    return fill_median(df, features) if fill else df


def export_join(star):
    """Every experiment with what is known about it."""
    return (
        star["experiments"].join(star["compositions"], "exp_id").join(star["properties"], "exp_id")
        .join(star["features"], "exp_id", "left")
    )


def full_export(star, moduli):
    """The export with what follows from it: phase volumes, moduli, grades and
    whether features exist.  ``moduli``: (exp_id, pred_bulk_modulus, pred_shear_modulus)."""
    known = dict(star, features=star["features"].withColumn("_known", F.lit(True)))
    return export_join(known).join(moduli, "exp_id", "left").withColumns({
        "ceramic_vol_pct": 100 - F.col("binder_vol_pct"),
        "young_modulus": P.young_from_moduli(F.lit(None).cast("double"), "pred_bulk_modulus", "pred_shear_modulus"),
        "hardness_grade": hardness_grade("hv"), "toughness_grade": toughness_grade("kic"),
        "has_features": F.coalesce("_known", F.lit(False)),
    }).drop("_known")


def query_tab(star, equals=None, contains=None, limit=1000):
    df = star["experiments"]
    for name in ("compositions", "properties", "features"):
        df = df.join(star[name], "exp_id", "left")
    df = df.where(conjunction(equals=equals, contains=contains))
    return df.orderBy("exp_id").limit(limit)


def without_features(experiments, features):
    return experiments.join(features, "exp_id", "left_anti")


def not_flagged(flag):
    """True for false and for NULL."""
    return F.coalesce(col(flag), F.lit(False)) == F.lit(False)


def work_list(experiments, features, flag):
    """Experiments without features or with the flag unset, each once."""
    ids = without_features(experiments, features).select("exp_id").unionByName(
        features.where(not_flagged(flag)).select("exp_id")).distinct()
    return experiments.join(ids, "exp_id", "left_semi")


def page_filter(star, binder_type=None, hv=(None, None), kic=(None, None), keyword=None):
    df = star["experiments"].join(star["properties"], "exp_id", "left")
    df = df.join(star["compositions"], "exp_id", "left")
    equals = {} if binder_type in (None, "All") else {"is_hea": binder_type == "HEA"}
    return df.where(conjunction(
        equals=equals, ranges={"hv": hv, "kic": kic}, contains={"raw_composition": keyword} if keyword else {}))


def key_range(keys, key, offset, size, cells=1024, enough=20_000):
    """(low, high, rows before): keys between low and high hold the rows ``offset`` to
    ``offset + size`` in key order, and few others.

    ``keys`` is a stored table.  Each pass counts the rows per cell of the range
    found so far, so ``cells`` numbers reach the driver; the range shrinks until it
    holds ``enough`` rows or one key.
    """
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if offset >= n:
        return None
    before, enough = 0, max(enough, 4 * size)
    while n > enough and high > low:
        width = (high - low) // cells + 1
        place = F.floor((F.col(key).cast("decimal(20,0)") - low) / width).cast("int")
        cell = dict(keys.where(F.col(key).between(low, high)).groupBy(place.alias("c")).count().collect())
        first = last = None
        total = before
        for c in sorted(cell):
            if first is None and total + cell[c] > offset:
                first, start, n = c, total, 0
            total += cell[c]
            if first is not None:
                n, last = n + cell[c], c
                if total >= offset + size:
                    break
        low, high, before = low + first * width, min(high, low + (last + 1) * width - 1), start
        if width == 1:
            break
    return low, high, before


def page(star, number=1, size=100, **filters):
    """(page rows in id order, one-row total and page count).

    The ids that pass the filters are stored; counts of id ranges find where the page
    lies, and only that range is joined and sorted, so a late page costs what the
    first does.
    """
    hits = page_filter(star, **filters)
    keys = cut_lineage(hits.select("exp_id"), "page_keys")
    total = keys.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))
    found = key_range(keys, "exp_id", (number - 1) * size, size)
    low, high, before = found or (0, -1, 0)
    near = {n: t.where(F.col("exp_id").between(low, high)) for n, t in star.items()}
    rows = page_filter(near, **filters).orderBy("exp_id").offset((number - 1) * size - before if found else 0).limit(size).select(
        F.col("exp_id").alias("id"), display_text("raw_composition").alias("composition"),
        F.coalesce("ceramic_formula", F.lit("")).alias("ceramic"), F.coalesce("binder_formula", F.lit("")).alias("binder"),
        yes_no("is_hea").alias("hea"), "hv", "kic", "trs", "sinter_temp_c", "grain_size_um", "source_id")
    return rows, total


def record(star, exp_id):
    """One experiment as a nested record.  The key filter reaches every scan."""
    parts = {n: star[n].where(F.col("exp_id") == exp_id) for n in ("experiments", "compositions", "properties", "features")}
    df = parts["experiments"].select("exp_id", F.struct("*").alias("experiment"))
    for name in ("compositions", "properties", "features"):
        inner = [c for c in parts[name].columns if c != "exp_id"]
        df = df.join(parts[name].select("exp_id", F.struct(*inner).alias(name)), "exp_id", "left")
    return df


def summary_counts(compositions):
    return compositions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_hea").alias("hea"),
        F.count_if(F.col("is_hea") == F.lit(False)).alias("traditional"))


def upsert(old, new, key):
    """New non-null values win; unknown keys are added."""
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c != key])
    joined = o.join(new, key, "full_outer")
    return joined.select(key, *[
        F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in new.columns else F.col(f"_old_{c}").alias(c)
        for c in old.columns if c != key])


def add_missing_columns(df, columns):
    """Add ``{name: type}`` as NULLs where absent."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def migrate(old, mapping):
    """(rows of the new layout, failure count) for ``{new: old expression}``.

    A row fails when its required first column comes out NULL.
    """
    out = old.select(*[F.expr(e).alias(c) for c, e in mapping.items()])
    first = next(iter(mapping))
    return out.where(F.col(first).isNotNull()), out.agg(
        F.count(first).alias("migrated"), F.count_if(F.col(first).isNull()).alias("failed"))


# ---------------------------------------------------------------- library
def best_by(df, keys, order, take):
    """Per key the row that is smallest in ``order``; combined map-side, so a hot
    key costs no more than any other."""
    ranked = F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *[F.col(c) for c in take])).alias("_b")
    return df.groupBy(*keys).agg(ranked).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in take])


def lowest_energy(library):
    """Most stable entry per formula; NULL energies only when nothing else is there."""
    order = [F.col("energy").isNull().cast("int"), F.col("energy"), F.col("entry_id")]
    return best_by(library, ["formula"], order, ["entry_id", "energy", "density"])


def hull_density(library):
    order = [F.coalesce("e_hull", F.lit(float("inf"))), F.col("density")]
    return best_by(library, ["formula"], order, ["density"])


def best_per_system(library, system):
    order = [F.when(F.col("is_stable"), 0).otherwise(1), F.col("energy").isNull().cast("int"), F.col("energy"), F.col("entry_id")]
    return best_by(library, [system], order, ["entry_id", "is_stable", "energy"])


def target_systems(metals, partners):
    """Unaries and metal-partner pairs.  The partner list is explicit, so each
    metal row expands in place."""
    pairs = metals.select("metal", F.explode(F.array(*[F.lit(p) for p in partners])).alias("partner"))
    pairs = pairs.select(F.concat_ws("-", F.sort_array(F.array("metal", "partner"))).alias("system"))
    return metals.select(F.col("metal").alias("system")).unionByName(pairs)


def pair_lookup(df, a, b, enthalpy):
    """Order-free pair value with default 0."""
    keyed = df.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)})
    table = enthalpy.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "h")
    return keyed.join(table, ["_a", "_b"], "left").withColumn("h", F.coalesce("h", F.lit(0.0))).drop("_a", "_b")


def fallback_lookup(df, key, first, second, fields):
    """Fields from ``first`` by key, else from ``second``."""
    names = lambda t, p: t.select(F.col(key), *[F.col(f).alias(f"{p}{f}") for f in fields])
    out = df.join(names(first, "_1"), key, "left").join(names(second, "_2"), key, "left")
    return out.withColumns({f: F.coalesce(f"_1{f}", f"_2{f}") for f in fields}).drop(
        *[f"{p}{f}" for p in ("_1", "_2") for f in fields])


def map_keys_of(df, c, most=1000):
    """Sorted distinct keys of a map column.  Columns are made of them, so more
    than ``most`` is an error; no more than that reach the driver."""
    found = df.select(F.explode(F.map_keys(c)).alias("k")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} keys: name those wanted")
    return sorted(r[0] for r in found)


def flatten_json(df, c, prefix, keys=None, value_type="double"):
    """JSON-object text to ``<prefix><key>`` columns; keys found by one pass if
    not given."""
    df = df.withColumn("_m", F.from_json(col(c), f"map<string,{value_type}>"))
    keys = keys or map_keys_of(df, "_m")
    return df.withColumns({f"{prefix}{k}": F.try_element_at("_m", F.lit(k)) for k in keys}).drop("_m")


def pack_columns(df, prefix, name):
    """Columns of a prefix to one map column keyed by the rest of their names."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    packed = F.map_from_arrays(F.array(*[F.lit(c[len(prefix):]) for c in cols]), F.array(*cols))
    return df.withColumn(name, packed).drop(*cols)


def by_age(df, ts, asof, days=30):
    """Add ``fresh``: at most ``days`` old at ``asof`` (a timestamp literal)."""
    return df.withColumn("fresh", F.col(ts) >= F.expr(f"timestamp'{asof}' - interval {int(days)} days"))


def latest(df, ts, key, n=20):
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def is_subset(small, big, key):
    """One row: keys of ``small`` missing from ``big`` and whether none is."""
    return small.select(key).distinct().join(big.select(key).distinct(), key, "left_anti").agg(
        F.count(F.lit(1)).alias("missing")).withColumn("subset", F.col("missing") == 0)
