"""Physics of compositions as column expressions.

``element_rows`` turns a composition map into an array of structs that carry
each element's share and constants; every feature is then one pass over that
short array inside the row.  No shuffle, no join, no Python.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cermetry.functions import constants as K
from cermetry.functions.common import clamp, col, dbl, let, literal_map, sql_double, total
from cermetry.functions.composition import formula_amounts, share_map


def element_table() -> Column:
    """Constant map from symbol to a struct of constants."""
    def row(symbol):
        values = dict(zip(K.ELEMENT_FIELDS, K.ELEMENTS[symbol]))
        values["bulk"] = K.BULK_MODULUS.get(symbol)
        values["young"] = K.YOUNGS_MODULUS.get(symbol)
        values["resistivity"] = K.RESISTIVITY.get(symbol)
        fields = ", ".join(f"'{k}', {sql_double(v)}" for k, v in values.items())
        return f"'{symbol}', named_struct({fields})"

    return F.expr(f"map({', '.join(row(s) for s in K.ELEMENTS)})")


def enthalpy_table() -> Column:
    """Constant map first symbol -> second symbol -> kJ/mol, first < second."""
    nested = {}
    for pair, h in K.ENTHALPY.items():
        first, second = pair.split("-")
        nested.setdefault(first, []).append(f"'{second}', {sql_double(h)}")
    return F.expr(f"map({', '.join(f'{k!r}, map(' + ', '.join(v) + ')' for k, v in nested.items())})")


def element_rows(m: Column) -> Column:
    """array<struct<el, c, p>>: share ``c`` (normalised) and constants ``p``.

    ``p`` is NULL for a symbol outside the reference table.
    """
    table = element_table()
    return F.transform(
        F.map_entries(share_map(m)),
        lambda e: F.struct(
            e["key"].alias("el"), e["value"].alias("c"), F.try_element_at(table, e["key"]).alias("p")
        ),
    )


# ---------------------------------------------------------------- sums
def weighted(rows: Column, prop: str, default=0.0) -> Column:
    """Sum of share times property; a missing property counts ``default``."""
    return F.aggregate(
        rows, F.lit(0.0), lambda a, x: a + x["c"] * F.coalesce(x["p"][prop], F.lit(default))
    )


def weighted_or_null(rows: Column, prop: str) -> Column:
    """Weighted sum over the elements that have the property; NULL if none has."""
    return F.when(F.exists(rows, lambda x: x["p"][prop].isNotNull()), weighted(rows, prop))


def all_known(rows: Column, prop: str) -> Column:
    return F.forall(rows, lambda x: x["p"][prop].isNotNull())


def vec(rows: Column) -> Column:
    return weighted(rows, "vec")


def vec_strict(rows: Column) -> Column:
    """NULL as soon as one element is unknown."""
    return F.when(all_known(rows, "vec"), weighted(rows, "vec"))


def size_mismatch(rows: Column) -> Column:
    """100 sqrt(sum c (1 - r/mean r)^2); unknown radii are skipped."""
    return let(
        weighted(rows, "r"),
        lambda mean: F.when(mean == 0, F.lit(0.0)).otherwise(
            100 * F.sqrt(F.aggregate(
                rows, F.lit(0.0),
                lambda a, x: a + F.coalesce(x["c"] * F.pow(1 - x["p"]["r"] / mean, F.lit(2.0)), F.lit(0.0)),
            ))
        ),
    )


def chi_spread(rows: Column) -> Column:
    """sqrt(sum c (chi - mean chi)^2)."""
    return let(
        weighted(rows, "chi"),
        lambda mean: F.sqrt(F.aggregate(
            rows, F.lit(0.0),
            lambda a, x: a + F.coalesce(x["c"] * F.pow(x["p"]["chi"] - mean, F.lit(2.0)), F.lit(0.0)),
        )),
    )


def entropy_r(rows: Column) -> Column:
    """Mixing entropy in units of the gas constant."""
    return -F.aggregate(
        rows, F.lit(0.0), lambda a, x: a + F.when(x["c"] > 0, x["c"] * F.ln(x["c"])).otherwise(0.0)
    )


def entropy(rows: Column) -> Column:
    return entropy_r(rows) * K.R_GAS


def enthalpy(rows: Column) -> Column:
    """sum over pairs of 4 H c c; an unlisted pair is 0."""
    table = enthalpy_table()
    return F.aggregate(
        rows, F.lit(0.0),
        lambda a, x: a + let(
            F.try_element_at(table, x["el"]),
            lambda row: F.aggregate(
                rows, F.lit(0.0),
                lambda b, y: b + F.coalesce(
                    F.try_element_at(row, y["el"]) * 4 * x["c"] * y["c"], F.lit(0.0)
                ),
            ),
        ),
    )


def omega(tm: Column, s: Column, h: Column) -> Column:
    """Tm S / |1000 H|; NULL when the enthalpy vanishes."""
    return F.when(F.abs(h) >= 1e-4, F.try_divide(tm * s, F.abs(h) * 1000))


def alloy_density(rows: Column) -> Column:
    """Mass over volume; metals by the density table, others 8.0."""
    rho = literal_map(K.METAL_DENSITY)
    mass = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["c"] * F.coalesce(x["p"]["mass"], F.lit(0.0)))
    vol = F.aggregate(
        rows, F.lit(0.0),
        lambda a, x: a + x["c"] * F.coalesce(x["p"]["mass"], F.lit(0.0))
        / F.coalesce(F.try_element_at(rho, x["el"]), F.lit(K.DEFAULT_METAL_DENSITY)),
    )
    return F.try_divide(mass, vol)


# ---------------------------------------------------------------- mechanics
def chen_hardness(bulk, shear) -> Column:
    b, g = col(bulk), col(shear)
    k = F.try_divide(g, b)
    return F.when(
        (b > 0) & (g != 0),
        F.greatest(F.lit(0.0), 2 * F.pow(k * k * g, F.lit(K.CHEN_EXPONENT)) - K.CHEN_OFFSET),
    )


def tian_hardness(bulk, shear) -> Column:
    b, g = col(bulk), col(shear)
    return F.when(
        (b > 0) & (g != 0),
        K.TIAN_FACTOR * F.pow(F.try_divide(g, b), F.lit(K.TIAN_RATIO_EXPONENT)) * F.pow(g, F.lit(K.TIAN_SHEAR_EXPONENT)),
    )


def pugh(bulk, shear) -> Column:
    return F.when(col(shear) > 0, F.try_divide(col(bulk), col(shear)))


def brittleness(ratio) -> Column:
    return 1 / (1 + F.exp(2 * (col(ratio) - K.PUGH_LIMIT)))


def ductility(ratio) -> Column:
    r = col(ratio)
    return F.when(r > K.PUGH_LIMIT, "Ductile").when(r.isNotNull(), "Brittle")


def ionic_percent(spread) -> Column:
    return 100 * (1 - F.exp(-0.25 * col(spread) * col(spread)))


def young_from_moduli(young, bulk, shear) -> Column:
    """The given modulus, or 9KG / (3K + G)."""
    k, g = col(bulk), col(shear)
    return F.coalesce(col(young), F.try_divide(9 * k * g, 3 * k + g))


def composite_modulus(binder, ceramic, vol_pct, method="voigt") -> Column:
    b, c, v = col(binder), col(ceramic), col(vol_pct) / 100.0
    voigt = v * b + (1 - v) * c
    if method == "reuss":
        return F.try_divide(F.lit(1.0), F.try_divide(v, b) + F.try_divide(1 - v, c))
    if method == "hs_ref":
        return voigt / 2
    return voigt


# ---------------------------------------------------------------- volume and weight
def ceramic_density(ceramic) -> Column:
    rho = literal_map({f: v[1] for f, v in K.COMPOUNDS.items()})
    return F.coalesce(F.try_element_at(rho, col(ceramic)), F.lit(K.DEFAULT_CERAMIC_DENSITY))


def wt_to_vol(wt, rho_binder, rho_ceramic) -> Column:
    b, c = col(wt) / col(rho_binder), (100 - col(wt)) / col(rho_ceramic)
    return F.try_divide(b, b + c) * 100


def vol_to_wt(vol, rho_binder, rho_ceramic) -> Column:
    b, c = col(vol) * col(rho_binder), (100 - col(vol)) * col(rho_ceramic)
    return F.try_divide(b, b + c) * 100


# ---------------------------------------------------------------- interfaces
def fcc_lattice(volume) -> Column:
    return F.cbrt(4 * col(volume))


def neighbour_distance(lattice, structure) -> Column:
    return F.when(F.lower(col(structure)) == "bcc", col(lattice) * (3 ** 0.5) / 2).otherwise(
        col(lattice) / K.SQRT2
    )


def relative_gap(distance, target) -> Column:
    return F.abs(col(distance) - col(target)) / col(target)


def ceramic_neighbour(ceramic) -> Column:
    """Neighbour distance by exact, then case-free, then partial name; else WC.

    The first entry of the table wins within each kind of match.
    """
    name = F.trim(col(ceramic))
    upper = F.upper(name)
    entries = K.CERAMIC_INTERFACE.items()
    exact = F.try_element_at(literal_map({k: v[1] for k, v in entries}), name)
    loose = F.coalesce(*[F.when(upper == k.upper(), dbl(v[1])) for k, v in entries])
    part = F.coalesce(*[
        F.when(upper.contains(k.upper()) | F.lit(k.upper()).contains(upper), dbl(v[1])) for k, v in entries
    ])
    return F.coalesce(exact, loose, part, F.lit(K.WC["a"]))


def ceramic_lattice(ceramic) -> Column:
    """Lattice constant by case-free name, else WC."""
    table = literal_map({k.upper(): v[0] for k, v in K.CERAMIC_INTERFACE.items()})
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(col(ceramic)))), F.lit(K.WC["a"]))


def vegard_lattice(m: Column) -> Column:
    radius = literal_map(K.VEGARD_RADII)
    return 2 * K.SQRT2 * F.aggregate(
        F.map_entries(share_map(m)), F.lit(0.0),
        lambda a, e: a + e["value"] * F.coalesce(
            F.try_element_at(radius, e["key"]), F.lit(K.VEGARD_DEFAULT_RADIUS)
        ),
    )


def model_mismatch(lattice, ceramic) -> Column:
    target = F.coalesce(
        F.try_element_at(literal_map(K.MODEL_LATTICE), col(ceramic)), F.lit(K.MODEL_LATTICE["WC"])
    )
    return relative_gap(col(lattice) / K.SQRT2, target)


# ---------------------------------------------------------------- free path
def free_path(kind, grain, binder) -> Column:
    """``exner``/``guarded``/``percent``/``model`` variants, binder as fraction
    (``percent``: as percent)."""
    d, f = col(grain), col(binder)
    if kind == "exner":
        return F.when((f > 0) & (f < 1), 2.0 / 3.0 * F.try_divide(f, 1 - f) * d).otherwise(0.0)
    if kind == "guarded":
        return d * f / (1 - f + 1e-6)
    if kind == "percent":
        return d / (f + 1)
    return F.when((f > 0) & (f < 1), d * F.try_divide(f, 1 - f)).otherwise(d * 0.5)


# ---------------------------------------------------------------- cermet sets
def cermet_set(m: Column, grain) -> Column:
    """Binder volume fraction, density and Exner path of an atomic composition;
    NULL if any element's mass or density is unknown."""
    from cermetry.functions.composition import to_mass

    def build(rows):
        mass = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["c"] * x["p"]["mass"])
        vol = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["c"] * x["p"]["mass"] / x["p"]["rho"])
        held = F.aggregate(
            rows, F.lit(0.0),
            lambda a, x: a + F.when(
                x["el"].isin(*K.VOLUME_BINDERS), x["c"] * x["p"]["mass"] / x["p"]["rho"]
            ).otherwise(0.0),
        )
        return F.when(
            all_known(rows, "rho"),
            let(
                F.try_divide(held, vol),
                lambda f: F.struct(
                    f.alias("binder_vol_frac"),
                    free_path("exner", grain, f).alias("free_path_um"),
                    F.try_divide(mass, vol).alias("density"),
                ),
            ),
        )

    return let(element_rows(m), build)


def carbon_affinity() -> Column:
    """Constant map: element to the formation enthalpy of its first listed
    carbide (MC, then M2C per 2, then M3C2 per 3); zero values are passed over."""
    out = {}
    for el in K.ELEMENTS:
        for form, share in ((f"{el}C", 1), (f"{el}2C", 2), (f"{el}3C2", 3)):
            if K.COMPOUNDS.get(form, (0,))[0]:
                out[el] = K.COMPOUNDS[form][0] / share
                break
    return literal_map(out)


def binder_physics(m: Column, sinter_temp_c) -> Column:
    """Nine binder descriptors; C, N, B and O are left out of the binder."""
    binder = F.map_filter(m, lambda k, _: ~k.isin(*K.INTERSTITIALS))
    affinity = carbon_affinity()

    def build(rows):
        ideal = weighted(rows, "tm")
        return let(
            F.struct(
                ideal.alias("ideal"), (ideal - 50 * entropy_r(rows)).alias("liq"),
                vec(rows).alias("vec"), rows.alias("rows"),
            ),
            finish,
        )

    def finish(v):
        rows, t_liq = v["rows"], v["liq"]
        lattice = F.aggregate(
            rows, F.lit(0.0),
            lambda a, x: a + x["c"] * F.coalesce(
                F.nullif(x["p"]["lattice"], F.lit(0.0)),
                F.when(v["vec"] >= 8.0, x["p"]["r"] * 2 * K.SQRT2).otherwise(x["p"]["r"] * 4 / (3 ** 0.5)),
                F.lit(0.0),
            ),
        )
        active = F.aggregate(
            rows, F.lit(0.0),
            lambda a, x: a + F.when(x["el"].isin(*K.ACTIVE_ELEMENTS), x["c"]).otherwise(0.0),
        )
        risky = v["vec"].between(6.8, 8.2)
        formers = F.exists(rows, lambda x: x["el"].isin("Cr", "V", "Mo"))
        deficit = F.aggregate(
            rows, F.lit(0.0),
            lambda a, x: a + x["c"] * F.coalesce(F.try_element_at(affinity, x["el"]), F.lit(0.0)),
        )
        return F.when(
            F.size(rows) > 0,
            F.struct(
                t_liq.alias("t_liquidus"),
                v["ideal"].alias("t_liquidus_ideal"),
                F.when(col(sinter_temp_c).isNotNull() & (t_liq > 0),
                       (col(sinter_temp_c) + 273.15) / t_liq).otherwise(0.0).alias("t_homologous"),
                let(lattice, lambda a: F.when(a > 0, (a - K.WC["a"]) / K.WC["a"] * 100).otherwise(0.0)).alias("mismatch_a"),
                let(lattice, lambda a: F.when(a > 0, (a - K.WC["c"]) / K.WC["c"] * 100).otherwise(0.0)).alias("mismatch_c"),
                F.abs(weighted(rows, "shear") - K.WC["shear"]).alias("shear_diff"),
                F.abs(weighted(rows, "cte") - K.WC["cte"]).alias("cte_diff"),
                weighted(rows, "wet").alias("wettability"),
                active.alias("active_sum"),
                (risky.cast("int") + (risky & formers).cast("int")).alias("sigma_risk"),
                deficit.alias("carbon_deficit"),
            ),
        )

    return let(element_rows(binder), build)


def wc_hardness(grain) -> Column:
    d = col(grain)
    return F.when(d <= 0, F.lit(K.WC["h0"])).otherwise(K.WC["h0"] + K.WC["hall_petch"] / F.sqrt(d))


def composite_hardness(binder_hv, binder_frac, grain) -> Column:
    """Struct of linear and geometric mixtures and the hard phase's own value."""
    h, f = col(binder_hv), col(binder_frac)
    return let(
        wc_hardness(grain),
        lambda w: F.when(
            h.isNotNull() & f.isNotNull(),
            F.struct(
                ((1 - f) * w + f * h).alias("linear"),
                (F.pow(w, 1 - f) * F.pow(h, f)).alias("geometric"),
                w.alias("wc"),
            ),
        ),
    )


# ---------------------------------------------------------------- statistics
STATISTICS = ("min", "max", "range", "mean", "avg_dev", "mode")


def property_statistics(rows: Column, prop: str) -> Column:
    """Struct of min, max, range, mean, average deviation and mode of a property.

    The mode is the property of the largest share, the smallest value on a tie.
    NULL if an element lacks the property.
    """
    values = F.transform(rows, lambda x: x["p"][prop])
    return F.when(
        all_known(rows, prop),
        let(
            weighted(rows, prop),
            lambda mean: F.struct(
                F.array_min(values).alias("min"), F.array_max(values).alias("max"),
                (F.array_max(values) - F.array_min(values)).alias("range"), mean.alias("mean"),
                F.aggregate(
                    rows, F.lit(0.0), lambda a, x: a + x["c"] * F.abs(x["p"][prop] - mean)
                ).alias("avg_dev"),
                F.array_min(
                    F.transform(rows, lambda x: F.struct((-x["c"]).alias("n"), x["p"][prop].alias("v")))
                )["v"].alias("mode"),
            ),
        ),
    )


def norm(m: Column, p: int) -> Column:
    """Stoichiometry p-norm; p = 0 counts the elements."""
    if p == 0:
        return F.size(m).cast("double")
    powered = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(float(p))))
    return F.pow(powered, F.lit(1.0 / p))


def transition_share(m: Column) -> Column:
    return total(F.map_values(F.map_filter(m, lambda k, _: k.isin(*K.TRANSITION_METALS))))


def property_range(rows: Column, prop: str) -> Column:
    values = F.transform(rows, lambda x: x["p"][prop])
    return F.when(F.size(rows) > 1, F.array_max(values) - F.array_min(values)).otherwise(0.0)


def formula_rows(c) -> Column:
    return element_rows(formula_amounts(c))


# ---------------------------------------------------------------- heuristics
def heuristic_hardness(vec_col, size, t_hom) -> Column:
    porosity = F.greatest(F.lit(0.0), (0.95 - col(t_hom)) * 2000)
    softening = F.greatest(F.lit(0.0), (col(vec_col) - 8.5) * 300)
    return 1600 + 50 * col(size) - porosity - softening


def heuristic_toughness(vec_col, mismatch) -> Column:
    return 10 + 5 * F.greatest(F.lit(0.0), 1 - F.abs(col(vec_col) - 8.2)) - 20 * col(mismatch)


def unit(c) -> Column:
    return clamp(c, 0.0, 1.0)
