"""Reference tables as DataFrames.  Each has at most a few hundred rows, a
fixed number that does not grow with any input, so broadcasting is safe."""

from pyspark.sql import functions as F

from cermetry.functions import constants as K

ELEMENT_COLUMNS = ("symbol", *K.ELEMENT_FIELDS, "bulk", "young", "resistivity")


def elements(spark):
    rows = [
        (s, *[float(x) for x in v], *[
            None if t.get(s) is None else float(t[s])
            for t in (K.BULK_MODULUS, K.YOUNGS_MODULUS, K.RESISTIVITY)
        ])
        for s, v in K.ELEMENTS.items()
    ]
    schema = "symbol string, " + ", ".join(f"{c} double" for c in ELEMENT_COLUMNS[1:])
    return F.broadcast(spark.createDataFrame(rows, schema))


def enthalpy(spark):
    rows = [(*k.split("-"), float(h)) for k, h in K.ENTHALPY.items()]
    return F.broadcast(spark.createDataFrame(rows, "a string, b string, h double"))


def compounds(spark):
    rows = [(f, *v) for f, v in K.COMPOUNDS.items()]
    return F.broadcast(spark.createDataFrame(
        rows,
        "formula string, enthalpy double, density double, structure string, "
        "lattice_a double, lattice_c double, neighbor double",
    ))


def prediction_ranges(spark):
    rows = [(m, *v) for m, v in K.PREDICTION_RANGES.items()]
    return F.broadcast(spark.createDataFrame(
        rows, "metric string, lo double, hi double, typical_lo double, typical_hi double"
    ))


def element_json():
    """The element table as the text of one keyed JSON object."""
    import json

    return json.dumps({s: dict(zip(K.ELEMENT_FIELDS, map(float, v))) for s, v in K.ELEMENTS.items()})
