"""Composition text and composition maps as column expressions.

A composition is ``map<string,double>`` from symbol to amount.  Every parser
takes a text column and returns a struct that is NULL when the text does not
have that format, so a cascade is a plain ``coalesce``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cermetry.functions import constants as K
from cermetry.functions.common import col, dbl, let, literal_map, to_double, total

SYMBOL_AMOUNT = r"([A-Z][a-z]?)\s*([0-9]*\.?[0-9]*)"
WHOLE_FORMULA = r"^([A-Z][a-z]?\s*[0-9]*\.?[0-9]*\s*)+$"
PARSE_TYPE = (
    "struct<format:string,binder:map<string,double>,ceramic:map<string,double>,"
    "binder_wt_pct:double,ceramic_formula:string,secondary_phase:string,needs_volume:boolean>"
)


# ---------------------------------------------------------------- text
def clean_text(c) -> Column:
    """Collapse spaces, unify dashes, turn list separators into spaces."""
    dashed = F.translate(col(c), "–—，,;", "--   ")
    return F.trim(F.regexp_replace(dashed, r"\s+", " "))


def tokens(c) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


number = to_double


# ---------------------------------------------------------------- maps
def sum_by_key(pairs: Column) -> Column:
    """array<struct<k,v>> to map, adding the amounts of repeated keys."""

    def summed(ps, keys):
        return F.map_from_entries(F.transform(
            F.array_distinct(keys),
            lambda k: F.struct(k.alias("k"), F.aggregate(
                F.filter(ps, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["v"]
            ).alias("v")),
        ))

    return let(
        pairs,
        lambda ps: let(
            F.transform(ps, lambda p: p["k"]),
            lambda keys: F.when(
                F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(ps)
            ).otherwise(summed(ps, keys)),
        ),
    )


def share_map(m: Column) -> Column:
    """Divide a map by its total; NULL when empty or not positive."""
    return let(
        m,
        lambda a: let(
            total(F.map_values(a)),
            lambda t: F.when(t > 0, F.transform_values(a, lambda _, v: v / t)),
        ),
    )


def keep_symbols(m: Column, names) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*names))


def formula_amounts(c) -> Column:
    """``Al0.5Co2 Ni`` to summed amounts; a blank amount is 1."""
    c = col(c)
    pairs = F.zip_with(
        F.regexp_extract_all(c, F.lit(SYMBOL_AMOUNT), F.lit(1)),
        F.regexp_extract_all(c, F.lit(SYMBOL_AMOUNT), F.lit(2)),
        lambda s, a: F.struct(
            s.alias("k"), F.when(a == "", F.lit(1.0)).otherwise(F.coalesce(number(a), F.lit(1.0))).alias("v")
        ),
    )
    return sum_by_key(pairs)


def formula_shares(c) -> Column:
    """Formula text to normalised shares; separators ``: % , ;`` are ignored."""
    return share_map(formula_amounts(F.translate(col(c), ":%,;", "    ")))


def known_shares(c) -> Column:
    """Formula shares over the elements of the reference table only."""
    return share_map(keep_symbols(formula_amounts(c), K.ELEMENTS))


def binder_shares(c) -> Column:
    """Shares of the binder metals named in a text."""
    return share_map(keep_symbols(formula_amounts(c), K.BINDER_METALS))


def to_atomic(m: Column) -> Column:
    """Mass amounts to atomic shares; elements without a known mass drop out."""
    mass = literal_map({s: v[3] for s, v in K.ELEMENTS.items()})
    return share_map(
        F.transform_values(keep_symbols(m, K.ELEMENTS), lambda k, v: v / mass[k])
    )


def to_mass(m: Column) -> Column:
    """Atomic amounts to mass shares."""
    mass = literal_map({s: v[3] for s, v in K.ELEMENTS.items()})
    return share_map(
        F.transform_values(keep_symbols(m, K.ELEMENTS), lambda k, v: v * mass[k])
    )


def fixed_point(v: Column, digits: int) -> Column:
    """Decimal text with half-even rounding and trailing zeros removed."""
    scale = 10 ** digits
    cents = F.rint(v * scale).cast("bigint")
    whole = (cents - cents % scale) / F.lit(scale)
    frac = F.rtrim(F.lpad((cents % scale).cast("string"), digits, "0"), F.lit("0"))
    return F.concat(
        whole.cast("bigint").cast("string"),
        F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
    )


def standard_text(m: Column, digits=2, one="") -> Column:
    """``Co0.8Ni0.2``: sorted symbols, shares as short decimals.

    ``one`` is the text for a share of exactly 1 ("" gives ``Co``, "1" ``Co1``).
    """
    return F.array_join(
        F.transform(
            F.sort_array(F.map_entries(m)),
            lambda e: let(
                fixed_point(e["value"], digits),
                lambda s: F.concat(e["key"], F.when(s == "1", F.lit(one)).otherwise(s)),
            ),
        ),
        "",
    )


def ranked_text(m: Column, digits=1, floor=0.1) -> Column:
    """Symbols by descending share, as percentages; traces left out."""
    entries = F.filter(F.map_entries(m), lambda e: e["value"] * 100 > floor)
    ordered = F.sort_array(
        F.transform(entries, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))
    )
    return F.array_join(
        F.transform(ordered, lambda e: F.concat(e["key"], fixed_point(e["neg"] * -100, digits))), ""
    )


# ---------------------------------------------------------------- flags
def hea_by_name(c) -> Column:
    """At least five alloying symbols occur anywhere in the text, in any case."""
    upper = F.upper(col(c))
    hits = [upper.contains(s.upper()).cast("int") for s in K.HEA_SYMBOLS]
    return F.coalesce(sum(hits[1:], hits[0]) >= 5, F.lit(False))


def hea_strict(m: Column) -> Column:
    """At least five elements, each with a share of 5 to 35 percent."""
    return (F.size(m) >= 5) & F.forall(F.map_values(m), lambda v: v.between(0.05, 0.35))


def main_phase(c) -> Column:
    return F.trim(F.split(col(c), ",")[0])


# ---------------------------------------------------------------- formats
def _result(fmt, binder, ceramic, wt, formula, secondary=None, needs_volume=False):
    null = F.lit(None)
    return F.struct(
        F.lit(fmt).alias("format"),
        binder.alias("binder"),
        ceramic.cast("map<string,double>").alias("ceramic"),
        wt.cast("double").alias("binder_wt_pct"),
        formula.cast("string").alias("ceramic_formula"),
        (null if secondary is None else secondary).cast("string").alias("secondary_phase"),
        F.lit(needs_volume).alias("needs_volume"),
    )


_PHASES_LONGEST_FIRST = "|".join(sorted(K.CERAMIC_PHASES, key=lambda p: (-len(p), p)))
_LEFT = rf"^(\d*\.?\d*)\s*({_PHASES_LONGEST_FIRST})"
_RIGHT = r"^(\d*\.?\d*)\s*(.*)$"


def dash_format(s) -> Column:
    """``WC-10CoCrFeNi`` or ``80TiC-20Mo``; a missing side is 100 minus the other."""
    s = col(s)
    parts = F.split(s, "-")
    left, right = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    phase = F.regexp_extract(left, _LEFT, 2)
    given_c = number(F.nullif(F.regexp_extract(left, _LEFT, 1), F.lit("")))
    given_b = number(F.nullif(F.regexp_extract(right, _RIGHT, 1), F.lit("")))
    binder_wt = F.coalesce(given_b, 100 - given_c)
    ceramic_wt = F.coalesce(given_c, 100 - given_b)
    fits = s.contains("-") & (F.size(parts) == 2) & (phase != "") & binder_wt.isNotNull()
    return F.when(fits, let(
        binder_shares(F.regexp_extract(right, _RIGHT, 2)),
        lambda b: F.when(b.isNotNull(), _result("dash", b, F.create_map(phase, ceramic_wt), binder_wt, phase)),
    ))


def _followed_by_number(t: Column) -> Column:
    """Pairs (symbol, number) of adjacent tokens; the last pair of a symbol wins."""
    pairs = F.filter(
        F.transform(
            F.slice(t, 1, F.size(t) - 1),
            lambda a, i: F.struct(a.alias("k"), number(F.get(t, i + 1)).alias("v")),
        ),
        lambda p: p["v"].isNotNull() & number(p["k"]).isNull(),
    )
    return let(
        pairs,
        lambda ps: F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(ps, lambda p: p["k"])),
                lambda k: F.struct(
                    k.alias("k"), F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)["v"].alias("v")
                ),
            )
        ),
    )


def largest_key(m: Column) -> Column:
    """Key of the largest value, the first one on a tie."""
    top = F.array_max(F.map_values(m))
    return F.get(F.map_keys(F.map_filter(m, lambda _, v: v == top)), F.lit(0))


def space_format(s) -> Column:
    """``WC 85 Co 10 Ni 5`` (weight percent); the binder becomes atomic shares."""
    t = tokens(s)

    def build(m):
        ceramic = keep_symbols(m, K.CERAMIC_PHASES)
        binder = keep_symbols(m, K.BINDER_METALS)
        return F.when(
            (F.size(ceramic) > 0) & (F.size(binder) > 0),
            _result(
                "space", to_atomic(binder), ceramic,
                100 - total(F.map_values(ceramic)), largest_key(ceramic),
            ),
        )

    return F.when(
        col(s).rlike(r"\s[\d.]"),
        let(t, lambda tk: F.when(F.size(tk) >= 3, let(_followed_by_number(tk), build))),
    )


def prefix_format(s) -> Column:
    """``b WC 25 Co``: the number is the binder's weight percent."""
    s = col(s)

    def build(t):
        wt = number(F.get(t, F.lit(1)))
        fits = (F.size(t) >= 3) & F.get(t, F.lit(0)).isin(*K.CERAMIC_PHASES) & wt.isNotNull()
        return F.when(fits, let(
            binder_shares(F.array_join(F.slice(t, F.lit(3), F.size(t)), " ")),
            lambda b: F.when(b.isNotNull(), _result(
                "prefix", b, F.create_map(F.get(t, F.lit(0)), 100 - wt), wt, F.get(t, F.lit(0)))),
        ))

    return F.when(s.startswith("b "), let(tokens(F.substr(s, F.lit(3))), build))


def placeholder_format(s) -> Column:
    """``WC x Co``: equal binder shares, weight percent unknown."""

    def build(t):
        phases = F.filter(t, lambda k: k.isin(*K.CERAMIC_PHASES))
        metals = F.filter(t, lambda k: k.isin(*K.BINDER_METALS))
        share = share_map(
            sum_by_key(F.transform(metals, lambda k: F.struct(k.alias("k"), F.lit(1.0).alias("v"))))
        )
        phase = F.element_at(phases, -1)
        return F.when(
            F.array_contains(t, "x") & (F.size(phases) > 0) & (F.size(metals) > 0),
            _result("placeholder", share, F.create_map(phase, dbl(None)), F.lit(None), phase, None, True),
        )

    return F.when(col(s).rlike(r"(^|\s)x(\s|$)"), let(tokens(s), build))


def number_first_format(s) -> Column:
    """``90 WC 10 Co``: the first later number that closes to 100 splits the text."""

    def build(t):
        first = number(F.get(t, F.lit(0)))
        positions = F.filter(
            F.sequence(F.lit(1), F.size(t) - 1),
            lambda i: F.abs(first + number(F.get(t, i)) - 100) <= 0.5,
        )

        def at(i):
            middle = F.slice(t, 2, i - 1)
            listed = F.filter(middle, lambda k: k.isin(*K.CERAMIC_PHASES))
            phase = F.coalesce(F.get(listed, F.lit(0)), F.get(middle, F.lit(0)), F.lit("WC"))
            return let(
                binder_shares(F.array_join(F.slice(t, i + 2, F.size(t)), " ")),
                lambda b: F.when(
                    b.isNotNull(),
                    _result(
                        "number_first", b, F.create_map(phase, first), number(F.get(t, i)),
                        phase, F.get(middle, F.lit(1)),
                    ),
                ),
            )

        return F.when(
            (F.size(t) >= 3) & first.isNotNull(),
            let(F.get(positions, F.lit(0)), lambda i: F.when(i.isNotNull(), at(i))),
        )

    return F.when(col(s).rlike(r"^[\d.+-]"), let(tokens(s), build))


def pure_alloy_format(s) -> Column:
    """A bare formula whose atoms are more than 90 percent binder metals."""
    s = col(s)

    def build(m):
        metals = keep_symbols(m, K.BINDER_METALS)
        return F.when(
            total(F.map_values(metals)) > 0.9 * total(F.map_values(m)),
            _result(
                "pure_alloy", share_map(metals), F.create_map().cast("map<string,double>"),
                F.lit(100.0), F.lit(None),
            ),
        )

    return F.when(s.rlike(WHOLE_FORMULA), let(formula_amounts(s), build))


def parse_cascade(c) -> Column:
    """First format that fits: number-first, dash, space, prefix, placeholder, alloy."""
    return let(
        clean_text(c),
        lambda s: F.coalesce(
            number_first_format(s), dash_format(s), space_format(s),
            prefix_format(s), placeholder_format(s), pure_alloy_format(s),
        ),
    )


# ---------------------------------------------------------------- cermet text
def cermet_amounts(c) -> Column:
    """``b WC 25 Co`` read as token-number pairs, scaled to 100.

    A symbol not followed by a number counts 1, or carries its own amount
    (``Co0.5``).  WC is added as 100 minus the binder when it is not named.
    """
    text = F.regexp_replace(F.trim(col(c)), r"^[a-z]\s+", "")

    def build(t):
        items = F.transform(
            t,
            lambda k, i: F.struct(
                F.when(number(F.get(t, i + 1)).isNotNull(), k)
                .otherwise(F.nullif(F.regexp_extract(k, "^" + SYMBOL_AMOUNT, 1), F.lit("")))
                .alias("k"),
                F.coalesce(
                    number(F.get(t, i + 1)),
                    number(F.nullif(F.regexp_extract(k, "^" + SYMBOL_AMOUNT, 2), F.lit(""))),
                    F.lit(1.0),
                ).alias("v"),
            ),
        )
        named = F.filter(items, lambda p: p["k"].isNotNull() & number(p["k"]).isNull())
        last = let(
            named,
            lambda ps: F.map_from_entries(
                F.transform(
                    F.array_distinct(F.transform(ps, lambda p: p["k"])),
                    lambda k: F.struct(
                        k.alias("k"), F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)["v"].alias("v")
                    ),
                )
            ),
        )
        return let(last, with_wc)

    def with_wc(m):
        binder = total(F.map_values(F.map_filter(m, lambda k, _: ~k.isin(*K.HARD_PHASES))))
        return F.when(
            (binder > 0) & ~F.map_contains_key(m, F.lit("WC")),
            F.map_concat(m, F.create_map(F.lit("WC"), 100 - binder)),
        ).otherwise(m)

    return let(
        let(tokens(text), build),
        lambda m: F.transform_values(share_map(m), lambda _, v: v * 100),
    )


def cermet_binder(c) -> Column:
    """Binder part of :func:`cermet_amounts`, as shares."""
    return share_map(F.map_filter(cermet_amounts(c), lambda k, _: ~k.isin(*K.HARD_PHASES)))


# ---------------------------------------------------------------- implicit amounts
SHEET_TYPE = "struct<binder:map<string,double>,ceramic:map<string,double>,binder_wt_pct:double,has_unknown:boolean>"


def is_sheet_ceramic(k: Column) -> Column:
    """Listed hard phase in any case, or a longer compound of C, N or O."""
    listed = F.lower(k).isin(*[p.lower() for p in K.HARD_PHASES])
    compound = k.rlike("[CNO]") & (F.length(k) > 2) & ~k.isin(*K.SHEET_METALS)
    return listed | compound


def implicit_items(t: Column) -> Column:
    """Token array to amounts: a number binds to the next symbol, a symbol that
    no number precedes counts 1, a trailing number is dropped.

    Of two numbers in a row the second is taken as the first one's symbol, so
    the scan has to carry whether the previous token opened a pair.
    """
    start = F.struct(
        F.expr("cast(array() as array<struct<k:string,v:double>>)").alias("out"),
        dbl(None).alias("open"),
    )

    def step(acc, tok):
        clean = F.regexp_replace(tok, "[^a-zA-Z0-9]", "")
        item = F.struct(clean.alias("k"), F.coalesce(acc["open"], F.lit(1.0)).alias("v"))
        opens = acc["open"].isNull() & number(tok).isNotNull()
        return F.struct(
            F.when(opens, acc["out"]).otherwise(F.concat(acc["out"], F.array(item))).alias("out"),
            F.when(opens, number(tok)).alias("open"),
        )

    return sum_by_key(F.aggregate(t, start, step)["out"])


def symbol_number_items(t: Column) -> Column:
    """Token array read strictly as symbol, number, symbol, number."""
    return sum_by_key(
        F.filter(
            F.transform(
                t,
                lambda k, i: F.struct(k.alias("k"), F.when(i % 2 == 0, number(F.get(t, i + 1))).alias("v")),
            ),
            lambda p: p["v"].isNotNull(),
        )
    )


def sheet_items(s: Column) -> Column:
    """Choose the reading: an even token count that ends in a number and
    alternates is symbol-number text, everything else binds forward."""

    def choose(t):
        alternating = F.forall(
            F.transform(t, lambda k, i: (number(k).isNotNull()) == (i % 2 == 1)), lambda ok: ok
        )
        return F.when(
            (F.size(t) >= 2) & (F.size(t) % 2 == 0) & alternating, symbol_number_items(t)
        ).otherwise(implicit_items(t))

    return let(tokens(s), choose)


def reconcile(items: Column) -> Column:
    """Split amounts into phases and settle the binder weight percent.

    Cases: (1) a hard phase of amount 1 with few additives is a cermet whose
    binder carries the percentages; (2) explicit amounts between 10 and 100
    leave the rest to hard phases of amount 1; (3) otherwise the amounts are
    ratios; (4) binder only is 100; (5) no binder is NULL.
    """

    def build(m):
        ceramic = F.map_filter(m, lambda k, _: is_sheet_ceramic(k))
        binder = F.map_filter(m, lambda k, _: ~is_sheet_ceramic(k))
        return let(F.struct(ceramic.alias("c"), binder.alias("b")), settle)

    def settle(p):
        c, b = p["c"], p["b"]
        nonzero = F.map_filter(c, lambda _, v: v > 0)
        ones = F.map_filter(c, lambda _, v: v == 1.0)
        sb, sn, sc = total(F.map_values(b)), total(F.map_values(nonzero)), total(F.map_values(c))
        additives = total(F.map_values(F.map_filter(nonzero, lambda _, v: v != 1.0)))
        explicit = sb + total(F.map_values(F.map_filter(c, lambda _, v: v != 1.0)))
        both = (F.size(c) > 0) & (F.size(b) > 0)
        cermet = both & (F.size(ones) > 0) & (additives < 5.0)
        closes = (sb > 0) & (sb < 100)
        fills = (explicit < 100) & (explicit > 10) & (F.size(ones) > 0)
        wt = (
            F.when(cermet & closes, sb)
            .when(cermet, 100 * F.try_divide(sb, sb + sn))
            .when(both & fills, sb)
            .when(both, 100 * F.try_divide(sb, sb + sc))
            .when(F.size(b) > 0, F.lit(100.0))
        )
        scaled = (
            F.when(cermet & closes, F.transform_values(nonzero, lambda _, v: v / sn * (100 - sb)))
            .when(
                both & ~cermet & fills,
                F.transform_values(
                    c, lambda _, v: F.when(v == 1.0, (100 - explicit) / F.size(ones)).otherwise(v)
                ),
            )
            .otherwise(c)
        )
        return F.when(
            (F.size(b) > 0) & wt.isNotNull(),
            F.struct(
                b.alias("binder"), scaled.alias("ceramic"), wt.alias("binder_wt_pct"),
                F.lit(False).alias("has_unknown"),
            ),
        )

    return let(items, build)


def _named_pair(s: Column):
    """(ceramic, metal) symbols of a text with a stand-alone ``x`` removed."""
    t = F.transform(tokens(s), lambda k: F.regexp_replace(k, "[^a-zA-Z0-9]", ""))
    phase = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(
        t, lambda k: F.lower(k).isin(*[p.lower() for p in K.HARD_PHASES]))), -1)
    metal = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(
        t, lambda k: k.isin(*K.SHEET_METALS)
        & ~F.lower(k).isin(*[p.lower() for p in K.HARD_PHASES]))), -1)
    return phase, metal


def known_ceramic_format(s) -> Column:
    """``94.12 WC x Co``: the binder is what the hard phase leaves."""
    s = col(s)
    phase, metal = _named_pair(s)
    wt = 100 - number(F.nullif(F.regexp_extract(s, r"^([\d.]+)\s+", 1), F.lit("")))
    return let(
        F.struct(phase.alias("p"), metal.alias("m"), wt.alias("w")),
        lambda v: F.when(
            v["p"].isNotNull() & v["m"].isNotNull() & (v["w"] > 0) & (v["w"] < 100),
            F.struct(
                F.create_map(v["m"], v["w"]).alias("binder"),
                F.create_map(v["p"], 100 - v["w"]).alias("ceramic"),
                v["w"].alias("binder_wt_pct"), F.lit(False).alias("has_unknown"),
            ),
        ),
    )


def quick_weight(binder: Column, ceramic: Column, vol_pct: Column) -> Column:
    """Binder volume percent to weight percent with the short density table."""
    rho = literal_map(K.QUICK_DENSITY)
    rb = F.coalesce(F.try_element_at(rho, binder), F.lit(K.QUICK_METAL_DENSITY))
    rc = F.coalesce(F.try_element_at(rho, ceramic), F.lit(K.DEFAULT_CERAMIC_DENSITY))
    v = vol_pct / 100.0
    return F.try_divide(v * 100 * rb, (1 - v) * rc + v * rb)


def placeholder_with_volume(s, vol_pct) -> Column:
    """``WC x Co`` with a known binder volume percent; unknown stays NULL."""
    phase, metal = _named_pair(col(s))
    vol = col(vol_pct)
    return let(
        F.struct(phase.alias("p"), metal.alias("m"), vol.alias("v")),
        lambda r: F.when(
            r["p"].isNotNull() & r["m"].isNotNull() & (r["v"].isNull() | ((r["v"] > 0) & (r["v"] < 100))),
            let(
                quick_weight(r["m"], r["p"], r["v"]),
                lambda w: F.struct(
                    F.create_map(r["m"], w).alias("binder"),
                    F.create_map(r["p"], 100 - w).alias("ceramic"),
                    w.alias("binder_wt_pct"), w.isNull().alias("has_unknown"),
                ),
            ),
        ),
    )


def sheet_parse(c, vol_pct) -> Column:
    """Experiment-sheet parser: placeholder texts first, then implicit amounts."""
    return let(
        F.regexp_replace(F.trim(col(c)), r"^[bB]\s+", ""),
        lambda s: F.when(
            F.array_contains(tokens(F.lower(s)), "x"),
            F.when(s.rlike(r"^\d"), known_ceramic_format(s)).otherwise(
                placeholder_with_volume(s, vol_pct)
            ),
        ).otherwise(reconcile(sheet_items(s))),
    )
