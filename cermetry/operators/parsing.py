"""Bulk composition parsing: one pass per table, failures kept apart."""

from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions.common import clamp, col, let, pinned
from cermetry.operators.columns import clean_missing, measure


def parse_compositions(df, text="raw_composition"):
    """Add the struct column ``parsed`` (NULL where no format fits)."""
    return df.withColumn("parsed", pinned(C.parse_cascade(text)))


def split_parsed(df, text="raw_composition"):
    """(parsed rows, quarantined rows).  Both are plain filters of one plan."""
    p = parse_compositions(df, text)
    return p.filter("parsed IS NOT NULL"), p.filter("parsed IS NULL").drop("parsed")


def composition_columns(df, id_col="exp_id", text="raw_composition", hea="strict"):
    """The stored composition record of every parsable row."""
    ok, _ = split_parsed(df, text)
    return composition_record(ok, id_col, text, hea)


def composition_record(ok, id_col="exp_id", text="raw_composition", hea="strict", keep=()):
    """The composition record of rows that hold a ``parsed`` struct.

    ``keep`` may name ``rows``, the binder's elements with their constants, and ``rho_b``,
    its density, for a caller that works on with them.
    """
    from cermetry.functions import physics as P

    flag = C.hea_strict(F.col("binder")) if hea == "strict" else C.hea_by_name(text)
    return (
        ok.select(id_col, text, "parsed.*")
        .withColumn("rows", P.element_rows(F.col("binder")))
        .withColumn("rho_b", P.alloy_density(F.col("rows")))
        .select(
            id_col, "format", "binder",
            C.standard_text(F.col("binder"), one="1").alias("binder_formula"),
            "binder_wt_pct",
            P.wt_to_vol("binder_wt_pct", "rho_b", P.ceramic_density("ceramic_formula")).alias("binder_vol_pct"),
            "ceramic_formula", "secondary_phase",
            (100 - F.col("binder_wt_pct")).alias("ceramic_wt_pct"),
            flag.alias("is_hea"), F.size("binder").cast("bigint").alias("element_count"), *keep,
        )
    )


def coverage(df):
    """Rows, parsed, failed and retention percent of a parsed frame."""
    done = F.count("parsed")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), done.alias("parsed"), (n - done).alias("failed"),
        (F.try_divide(done, n) * 100).alias("retention_pct"),
    )


def failure_sample(df, key, text, n=10):
    return df.filter("parsed IS NULL").select(key, text).orderBy(key).limit(n)


def parse_sheet(df):
    """Clean the measures of an experiment sheet, parse, and drop what fails.

    Expects text columns composition, binder_vol, grain, hv_text, kic_text,
    trs_text, temp_text and any others, which pass through.
    """
    vol = measure("binder_vol")
    return (
        df.withColumn("p", pinned(C.sheet_parse("composition", vol)))
        .filter("p IS NOT NULL")
        .withColumns({
            "binder_vol_pct": vol, "grain_size_um": measure("grain"), "hv": measure("hv_text"),
            "kic": measure("kic_text"), "trs": measure("trs_text"), "sinter_temp_c": measure("temp_text"),
            "binder_wt_pct": F.col("p.binder_wt_pct"),
            "ceramic_wt_pct": 100 - F.col("p.binder_wt_pct"),
            "ceramic_type": F.array_join(F.sort_array(F.map_keys("p.ceramic")), ", "),
            "binder_atomic": F.when(F.col("p.has_unknown"), F.transform_values("p.binder", lambda k, v: F.lit(1.0)))
            .otherwise(C.to_atomic(F.col("p.binder"))),
        })
        .drop("binder_vol", "grain", "hv_text", "kic_text", "trs_text", "temp_text", "p")
    )


def clean_sheet(df, target="hv"):
    """Parsed sheet with defaulted process columns and no row without target."""
    return (
        parse_sheet(df)
        .withColumns({
            "sinter_temp_c": F.coalesce("sinter_temp_c", F.lit(1400.0)),
            "grain_size_um": F.coalesce("grain_size_um", F.lit(1.0)),
            "method": clean_missing("method"),
        })
        .na.drop(subset=[target])
    )


def prioritized(ceramic, ceramic_wt, binder_text, binder_wt, parsed):
    """Dedicated columns if both phases are named there, else the parsed record.

    Missing weights of dedicated columns default to 90 and 10; parsed weights
    are clamped to [0, 100].  Neither gives NULL.
    """
    shares = C.formula_shares(binder_text)
    named = F.trim(col(ceramic))
    direct = F.when(
        (F.length(named) > 0) & shares.isNotNull(),
        F.struct(
            named.alias("ceramic_type"),
            F.coalesce(col(ceramic_wt), F.lit(90.0)).alias("ceramic_wt_pct"),
            shares.alias("binder"),
            F.coalesce(col(binder_wt), F.lit(10.0)).alias("binder_wt_pct"),
        ),
    )
    from_text = let(
        col(parsed),
        lambda p: F.when(
            (F.size(p["ceramic"]) > 0) & p["binder_wt_pct"].isNotNull() & (F.size(p["binder"]) > 0),
            F.struct(
                F.array_join(F.sort_array(F.map_keys(p["ceramic"])), ", ").alias("ceramic_type"),
                clamp(100 - p["binder_wt_pct"], 0.0, 100.0).alias("ceramic_wt_pct"),
                C.to_atomic(p["binder"]).alias("binder"),
                clamp(p["binder_wt_pct"], 0.0, 100.0).alias("binder_wt_pct"),
            ),
        ),
    )
    return F.coalesce(direct, from_text)


def element_columns(df, m, symbols, prefix=""):
    """One column per listed symbol (0 where absent); the list is explicit, so
    no pass over the data is needed to find the columns."""
    return df.withColumns({
        f"{prefix}{s}": F.coalesce(F.try_element_at(col(m), F.lit(s)), F.lit(0.0)) for s in symbols
    })


def rebuilt_text(ceramic_pct, ceramic, binder_pct, binder):
    """``90% WC 10% Co`` where both parts exist and 0 < binder < 100."""
    ok = (col(binder_pct) > 0) & (col(binder_pct) < 100) & col(ceramic).isNotNull() & col(binder).isNotNull()
    return F.when(
        ok,
        F.concat(
            C.fixed_point(col(ceramic_pct), 2), F.lit("% "), col(ceramic), F.lit(" "),
            C.fixed_point(col(binder_pct), 2), F.lit("% "), col(binder),
        ),
    )


def symbol_count(c):
    """Number of symbols written in a formula text; NULL counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(col(c), F.lit("[A-Z][a-z]?"), F.lit(0))), F.lit(0))


def real_element_count(m, floor=0.01):
    return F.size(F.filter(F.map_values(col(m)), lambda v: v > floor))


