"""Feature frames: physics expressions attached to DataFrames.

The in-row path (``with_rows`` and the expressions of ``functions.physics``)
needs no shuffle.  ``exploded_sums`` is the join form of the same sums, used to
cross-check it and to work with reference tables too large for a literal.
"""

from functools import reduce

from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions import constants as K
from cermetry.functions import physics as P
from cermetry.functions.common import col, dbl, pinned
from cermetry.session import checked_broadcast
from cermetry.sources import dims


def with_rows(df, formula="formula", name="rows"):
    """Add the element array of a formula column."""
    return df.withColumn(name, P.formula_rows(formula))


def exploded_sums(df, key, formula, props, table=None):
    """Weighted property sums by explode, broadcast join and aggregation.

    ``table`` has a ``symbol`` column; the default is the built-in one.  The
    symbols of one key are at most a formula's length, so no group is large.
    """
    table = table if table is not None else dims.elements(df.sparkSession)
    long = df.select(key, F.explode(C.formula_shares(formula)).alias("symbol", "c"))
    return long.join(table, "symbol", "left").groupBy(key).agg(
        *[F.sum(F.col("c") * F.coalesce(F.col(p), F.lit(0.0))).alias(p) for p in props]
    )


def basic_set(rows="rows"):
    r = F.col(rows)
    return F.struct(
        P.entropy_r(r).alias("s_mix_r"), P.vec(r).alias("vec"), P.size_mismatch(r).alias("delta")
    )


def thermo_set(rows="rows"):
    r = F.col(rows)
    return F.struct(
        P.vec(r).alias("vec"), P.enthalpy(r).alias("h_mix"), P.entropy(r).alias("s_mix"),
        P.size_mismatch(r).alias("delta_r"), P.chi_spread(r).alias("delta_chi"),
    )


def structure_set(rows, lattice, cte):
    """Lattice by the VEC rule, mismatch and expansion gap to a ceramic."""
    r = col(rows)
    v, radius = P.vec(r), P.weighted(r, "r")
    a = F.when(v >= 8.0, 2 * K.SQRT2 * radius).otherwise(4 * radius / 3 ** 0.5)
    alpha = P.weighted(r, "cte", default=12.0)
    return F.struct(
        a.alias("lattice_est"), P.relative_gap(a, lattice).alias("lattice_mismatch"),
        alpha.alias("cte_binder"), F.abs(alpha - col(cte)).alias("cte_mismatch"),
    )


def process_set(rows, sinter_temp_c):
    """Liquidus after depression, homologous and absolute sintering temperature."""
    r = col(rows)
    liq = P.weighted(r, "tm") - 150.0 * (P.entropy(r) / 13.3)
    kelvin = col(sinter_temp_c) + 273.15
    return F.struct(
        liq.alias("t_liquidus"), F.when(liq > 0, kelvin / liq).otherwise(0.0).alias("t_homologous"),
        kelvin.alias("sinter_temp_k"),
    )


def elastic_set(rows="rows"):
    """Rule-of-mixtures moduli; NULL where no element has one."""
    r = F.col(rows)
    b, g = P.weighted_or_null(r, "bulk"), P.weighted_or_null(r, "shear")
    return F.struct(b.alias("bulk"), g.alias("shear"), P.pugh(b, g).alias("pugh"))


def volume_fractions(df, m, ceramic_vol):
    """Rows (element, fraction of the whole) plus the phase fractions.

    Elements without a density drop out of the element rows.
    """
    rho = F.create_map(*[x for s, v in K.ELEMENTS.items() for x in (F.lit(s), F.lit(v[4]))])
    by_volume = C.share_map(F.transform_values(C.to_mass(col(m)), lambda k, w: w / F.try_element_at(rho, k)))
    v_bind = 1.0 - col(ceramic_vol)
    return df.withColumns({
        "phase_ceramic": col(ceramic_vol), "phase_binder": v_bind,
        "element_volume": F.transform_values(by_volume, lambda _, v: v * v_bind),
    })


def statistics_columns(df, rows, props, prefix):
    """``<prefix>_<statistic>_<property>`` columns for element properties."""
    out = df
    for p in props:
        out = out.withColumn("_s", P.property_statistics(F.col(rows), p))
        out = out.withColumns({f"{prefix}_{s}_{p}": F.col(f"_s.{s}") for s in P.STATISTICS}).drop("_s")
    return out


def element_columns(df, composition, elements):
    """``df`` with pinned columns of a share map that is NULL or has exactly the keys ``elements`` in that
    order: ``_v0``, ... its values, ``_c0``, ... the values divided by their total (NULL if it is not positive)."""
    at = range(len(elements))
    df = df.withColumns({f"_v{i}": pinned(F.try_element_at(composition, F.lit(e))) for i, e in enumerate(elements)})
    df = df.withColumn("_whole", pinned(summed(F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) for i in at)))
    return df.withColumns({f"_c{i}": pinned(F.when(F.col("_whole") > 0, F.col(f"_v{i}") / F.col("_whole"))) for i in at}).drop("_whole")


def dropped_elements(df, elements):
    return df.drop(*[f"_{c}{i}" for c in "vc" for i in range(len(elements))])


def summed(values):
    return reduce(lambda a, v: a + v, values, F.lit(0.0))


def element_lattice(df, composition, elements, name="pred_lattice_param"):
    """``vegard_lattice`` of a share map as of ``element_columns``."""
    df = element_columns(df, composition, elements)
    radius = [K.VEGARD_RADII.get(e, K.VEGARD_DEFAULT_RADIUS) for e in elements]
    lattice = 2 * K.SQRT2 * summed(F.col(f"_c{i}") * F.lit(float(r)) for i, r in enumerate(radius))
    return dropped_elements(df.withColumn(name, pinned(lattice)), elements)


def _fixed(prop, elements):
    """An element constant of every one of ``elements``; None where there is none."""
    i = K.ELEMENT_FIELDS.index(prop)
    return [float(K.ELEMENTS[e][i]) if e in K.ELEMENTS and K.ELEMENTS[e][i] is not None else None for e in elements]


def _fixed_range(prop, elements):
    """``property_range`` of rows that have all of ``elements``."""
    known = [v for v in _fixed(prop, elements) if v is not None]
    return F.when(F.col("_c0").isNotNull(), dbl(max(known) - min(known) if known else None)).otherwise(0.0) if len(elements) > 1 else F.lit(0.0)


def _fixed_hardness(df, composition, elements):
    """The parts of ``hardness_vector`` that depend on a share map as of ``element_columns``, without a pass over maps."""
    value = lambda i: F.col(f"_v{i}")
    at, known = range(len(elements)), F.col("_c0").isNotNull()
    share = lambda s: F.coalesce(value(elements.index(s)), F.lit(0.0)) if s in elements else F.lit(0.0)
    masses = {i: F.lit(m) * value(i) for i, m in enumerate(_fixed("mass", elements)) if m is not None}
    df = df.withColumn("_mass", pinned(summed(F.coalesce(m, F.lit(0.0)) for m in masses.values())))
    fe = F.when(F.col("_mass") > 0, masses[elements.index("Fe")] / F.col("_mass")) if "Fe" in elements else dbl(None)
    counted = F.when(F.col(composition).isNotNull(), reduce(lambda a, b: a + b, [F.when(value(i) > 0.01, 1).otherwise(0) for i in at]))
    groups, period = _fixed("grp", elements), _fixed("period", elements)
    return df.withColumns({
        "ni_share": share("Ni"), "nb_share": share("Nb"), "fe_mass": F.coalesce(fe, F.lit(0.0)),
        "element_count": pinned(F.coalesce(counted, F.size(F.lit(None).cast("array<double>"))).cast("double")),
        "norm2": F.pow(summed(F.pow(value(i), F.lit(2.0)) for i in at), F.lit(0.5)),
        "diff_number": _fixed_range("number", elements), "diff_chi": pinned(_fixed_range("chi", elements)),
        "range_group": F.when(known, dbl(None if None in groups else max(groups) - min(groups))),
        "mean_period": summed(F.col(f"_c{i}") * F.lit(p or 0.0) for i, p in enumerate(period)),
    }).drop("_mass")


def hardness_vector(df, formula="formula", lattice="pred_lattice_param", ceramic="ceramic",
                    binder_vol="binder_pct", grain="grain_size_um", composition=None, elements=None):
    """The hardness model's inputs, in dependency order: composition, then
    surrogate outputs, then what derives from them.

    A share map in ``composition`` is used as it is, else ``formula`` is parsed.
    ``elements`` says that every share map is NULL or has just these keys in this order, so that
    all is plain arithmetic.
    """
    if elements:
        df = dropped_elements(_fixed_hardness(element_columns(df, composition, elements), composition, elements), elements)
        df = df.withColumns({"binder_vol_pct": F.col(binder_vol), "grain_um": F.col(grain), "lattice_mismatch_wc": P.model_mismatch(lattice, ceramic)})
        return df.withColumn("interface_complexity", F.col("element_count") * F.col("diff_chi"))
    shares = F.col(composition) if composition else C.formula_shares(formula)
    df = df.withColumn("_m", shares).withColumn("_r", P.element_rows(F.col("_m")))
    m, r = F.col("_m"), F.col("_r")
    share = lambda s: F.coalesce(F.try_element_at(m, F.lit(s)), F.lit(0.0))
    grp = P.property_statistics(r, "grp")
    df = df.withColumns({
        "binder_vol_pct": F.col(binder_vol), "ni_share": share("Ni"), "nb_share": share("Nb"),
        "fe_mass": F.coalesce(F.try_element_at(C.to_mass(m), F.lit("Fe")), F.lit(0.0)),
        "element_count": F.size(F.filter(F.map_values(m), lambda v: v > 0.01)).cast("double"),
        "norm2": P.norm(m, 2),
        "diff_number": P.property_range(r, "number"), "diff_chi": P.property_range(r, "chi"),
        "range_group": grp["range"], "mean_period": P.weighted(r, "period"),
        "grain_um": F.col(grain),
        "lattice_mismatch_wc": P.model_mismatch(lattice, ceramic),
    })
    return df.withColumn("interface_complexity", F.col("element_count") * F.col("diff_chi")).drop("_m", "_r")


def toughness_vector(df, formula="formula", lattice="pred_lattice_param", ceramic="ceramic",
                     binder_vol="binder_pct", grain="grain_size_um", temp="sinter_temp_c", composition=None, elements=None):
    """The toughness model's inputs; a share map in ``composition`` is used as it is, ``elements`` as in ``hardness_vector``."""
    process = {
        "grain_um": F.col(grain), "binder_vol_pct": F.col(binder_vol), "temp_c": F.col(temp),
        "lattice_mismatch_wc": P.model_mismatch(F.coalesce(F.col(lattice), F.lit(3.6)), ceramic),
        "free_path": P.free_path("model", grain, F.col(binder_vol) / 100.0),
    }
    if elements:
        df = element_columns(df, composition, elements)
        value = {e: F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) for i, e in enumerate(elements)}
        return dropped_elements(df.withColumns({
            "ni_share": value.get("Ni", F.lit(0.0)),
            "tm_share": F.when(F.col(composition).isNotNull(), summed(v for e, v in value.items() if e in K.TRANSITION_METALS)),
            "range_tm": _fixed_range("tm", elements), **process}), elements)
    df = df.withColumn("_m", F.col(composition) if composition else C.formula_shares(formula)).withColumn("_r", P.element_rows(F.col("_m")))
    m, r = F.col("_m"), F.col("_r")
    return df.withColumns({
        "ni_share": F.coalesce(F.try_element_at(m, F.lit("Ni")), F.lit(0.0)),
        "tm_share": P.transition_share(m),
        "range_tm": P.property_range(r, "tm"), **process,
    }).drop("_m", "_r")


INJECTED = (
    "pred_formation_energy", "pred_lattice_param", "pred_magnetic_moment", "lattice_mismatch",
    "coherent_potential", "is_coherent", "lattice_distortion", "vec_binder", "mean_mass",
    "std_chi", "ceramic_mean_mass", "ceramic_std_chi", "ceramic_min_number", "delta", "omega",
)


def _alloy_part(df, formula):
    """Features that depend on the alloy alone."""
    # pinned, so that a filter on what follows from them does not parse the formula again
    df = df.withColumn("_m", pinned(C.formula_shares(formula))).withColumn("_r", pinned(P.element_rows(F.col("_m"))))
    r = F.col("_r")
    df = df.withColumns({"_s": P.entropy(r), "_h": P.enthalpy(r), "_t": P.weighted(r, "tm")})
    return df.withColumns({
        "vec_binder": P.vec_strict(r), "mean_mass": P.weighted_or_null(r, "mass"), "std_chi": P.chi_spread(r),
        "delta": P.size_mismatch(r), "omega": P.omega(F.col("_t"), F.col("_s"), F.col("_h")),
        "vegard": P.vegard_lattice(F.col("_m")), "parsed": r.isNotNull(),
    }).drop("_m", "_r", "_s", "_h", "_t")


def _ceramic_part(df, phase):
    """Features that depend on the hard phase alone."""
    df = df.withColumn("_q", P.formula_rows(phase))
    q = F.col("_q")
    return df.withColumns({
        "ceramic_mean_mass": P.weighted(q, "mass"), "ceramic_std_chi": P.chi_spread(q),
        "ceramic_min_number": F.array_min(F.transform(q, lambda x: x["p"]["number"])),
        "target_neighbor": P.ceramic_neighbour(phase), "target_lattice": P.ceramic_lattice(phase),
    }).drop("_q")


def per_distinct(df, key, features):
    """Compute ``features(frame)`` once per distinct key and join back.

    The joined side is distinct by construction, so no row is multiplied, and it
    is broadcast only when counted to be small.  A NULL key keeps NULL features.
    """
    once = features(df.select(key).where(F.col(key).isNotNull()).distinct())
    return df.join(checked_broadcast(once), key, "left")


def inject_features(df, formula="formula", ceramic="ceramic", energy="pred_formation_energy",
                    volume="volume_per_atom", moment="pred_magnetic_moment", repeated=True):
    """Add the fifteen injected features.

    ``energy``, ``volume`` and ``moment`` are surrogate-model outputs (columns).
    Alloy and hard-phase features are computed once per distinct text; what
    depends on the row's own surrogate values is plain column arithmetic.  A
    composition that does not parse gives NULL features and keeps its row;
    columns of the same names are overwritten.  Where no text is expected twice, as in
    generated candidates, ``repeated=False`` computes them in place, without any shuffle.
    """
    lattice = F.cbrt(4 * F.col("_volume"))
    df = df.withColumns({
        "_energy": col(energy), "_volume": col(volume), "_moment": col(moment),
        "_phase": F.coalesce(C.main_phase(ceramic), F.lit("WC")),
    }).drop(*INJECTED)
    once = per_distinct if repeated else (lambda d, _, features: features(d))
    df = once(df, formula, lambda d: _alloy_part(d, formula))
    df = once(df, "_phase", lambda d: _ceramic_part(d, "_phase"))
    distance = lattice / K.SQRT2
    ok = F.coalesce(F.col("parsed"), F.lit(False))
    potential = P.relative_gap(distance, "target_lattice")
    made = {
        "pred_formation_energy": F.col("_energy"), "pred_lattice_param": lattice, "pred_magnetic_moment": F.col("_moment"),
        "lattice_mismatch": P.relative_gap(distance, "target_neighbor"),
        "coherent_potential": potential, "is_coherent": potential < 0.01,
        "lattice_distortion": F.abs(lattice - F.col("vegard")),
        **{c: F.col(c) for c in INJECTED[10:13]},
    }
    df = df.withColumns({k: F.when(ok, v) for k, v in made.items()})
    return df.drop("_energy", "_volume", "_moment", "_phase", "parsed", "vegard", "target_neighbor", "target_lattice")


def screening_score(energy, mismatch, ratio, moment):
    """-10 Ef + 10 (1 - |m|) + 5 clip(B/G - 1.75) + 3 (1 - clip(mu / 10))."""
    return (
        -col(energy) * 10 + (1 - F.abs(col(mismatch))) * 10
        + P.unit(col(ratio) - 1.75) * 5 + (1 - P.unit(col(moment) / 10)) * 3
    )


def batch_extended(df, formula="formula", grain="grain_size_um", temp="sinter_temp_c"):
    """Basic, enthalpy, cermet and binder sets for every row of a frame.

    Rows whose formula holds no known element keep NULL sets and an ``error``.
    """
    df = df.withColumn("_m", C.known_shares(formula)).withColumn("_r", P.element_rows(F.col("_m")))
    return df.withColumns({
        "basic": F.when(F.col("_m").isNotNull(), basic_set("_r")),
        "h_mix": F.when(F.col("_m").isNotNull(), P.enthalpy(F.col("_r"))),
        "cermet": F.when(F.col("_m").isNotNull(), P.cermet_set(F.col("_m"), grain)),
        "binder": F.when(F.col("_m").isNotNull(), P.binder_physics(F.col("_m"), temp)),
        "error": F.when(F.col("_m").isNull(), "Invalid Composition"),
    }).drop("_m", "_r")
