"""Property mentions in text and the review queue."""

from pyspark.sql import functions as F

from cermetry.functions.common import literal_map

# --- fixed values: property patterns; group 1 value, group 2 unit ------------
PROPERTY_PATTERNS = {
    "density": r"(?i)density[^.0-9]*?(\d+(?:\.\d+)?)\s*(g/cm3|g/cm³|g cm-3|kg/m3)",
    "melting_point": r"(?i)melting (?:point|temperature)[^.0-9]*?(\d+(?:\.\d+)?)\s*(K|°C)",
}
# --- fixed values: unit -> (factor, offset) to g/cm3 and K -------------------
UNITS = {
    "g/cm3": (1.0, 0.0), "g/cm³": (1.0, 0.0), "g cm-3": (1.0, 0.0), "kg/m3": (0.001, 0.0),
    "K": (1.0, 0.0), "°C": (1.0, 273.15),
}


def property_mentions(df, key, text, patterns=PROPERTY_PATTERNS):
    """Rows (key, property, position, value in base units, unit) of whole texts."""
    def mentions(name, pattern):
        return F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)),
            lambda v, u: F.struct(F.lit(name).alias("property"), v.cast("double").alias("raw"), u.alias("unit")))

    found = F.concat(*[mentions(name, p) for name, p in patterns.items()])
    factor = F.coalesce(F.try_element_at(literal_map({u: f for u, (f, _) in UNITS.items()}), F.col("m.unit")), F.lit(1.0))
    offset = F.coalesce(F.try_element_at(literal_map({u: o for u, (_, o) in UNITS.items()}), F.col("m.unit")), F.lit(0.0))
    return df.select(key, F.posexplode(found).alias("position", "m")).select(
        key, "position", "m.property", (F.col("m.raw") * factor + offset).alias("value"), "m.unit")


def pending(queue):
    return queue.where(F.col("status") == "pending")


def approve(queue, keys, key):
    """Queue with the listed records approved."""
    marks = keys.select(key).distinct().withColumn("_new", F.lit("approved"))
    return queue.join(marks, key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
