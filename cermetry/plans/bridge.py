"""Domain-shaped views over the given tables.

Each view is one SELECT list of plain arithmetic over a driver table, spelled
so that Spark and any ANSI engine read it alike.  Parsing and physics are never
done here; they belong to the operators.
"""

from cermetry.functions import constants as K
from cermetry.sources.files import spread

METALS = "Co,Ni,Fe,Cr,Mo,Ti,Al,V,Nb,Mn,Cu,W,Ta,Zr,Hf"


def _pick(index):
    return f"split_part('{METALS}', ',', 1 + CAST(({index}) % 15 AS INT))"


def _str(expr):
    return f"CAST({expr} AS STRING)"


def formula_sql(key):
    """An alloy formula of three to six symbols, with repeats now and then."""
    return (
        f"concat({_pick(key)}, {_str(f'5 + {key} % 31')}, "
        f"{_pick(f'{key} * 4 + 1')}, {_str(f'1 + {key} % 17')}, '.5', "
        f"{_pick(f'{key} * 7 + 3')}, "
        f"CASE WHEN {key} % 3 > 0 THEN concat({_pick(f'{key} * 2 + 5')}, {_str(f'2 + {key} % 13')}) ELSE '' END, "
        f"CASE WHEN {key} % 4 > 0 THEN concat({_pick(f'{key} * 8 + 9')}, {_str(f'3 + {key} % 7')}) ELSE '' END, "
        f"CASE WHEN {key} % 5 > 0 THEN concat({_pick(f'{key} * 11 + 2')}, {_str(f'1 + {key} % 11')}) ELSE '' END)"
    )


def ceramic_sql(key):
    return (
        f"CASE {key} % 6 WHEN 0 THEN 'WC' WHEN 1 THEN 'TiC' WHEN 2 THEN 'TiN' "
        f"WHEN 3 THEN 'VC' WHEN 4 THEN 'NbC' ELSE 'Cr3C2' END"
    )


_k = "o_orderkey"
RAW_COMPOSITION = f"""CASE {_k} % 8
 WHEN 0 THEN concat('WC-', {_str(f'6 + {_k} % 15')}, CASE WHEN {_k} % 3 = 0 THEN 'CoCrFeNi' ELSE 'CoCrFeNiMn' END)
 WHEN 1 THEN concat({_str(f'60 + {_k} % 30')}, 'TiC-', {_str(f'40 - {_k} % 30')}, CASE WHEN {_k} % 3 = 0 THEN 'Mo' ELSE 'NiMo2' END)
 WHEN 2 THEN concat('b WC ', {_str(f'5 + {_k} % 30')}, CASE WHEN {_k} % 3 = 0 THEN ' Co' ELSE ' Co Ni' END)
 WHEN 3 THEN concat('WC ', {_str(f'70 + {_k} % 20')}, '  Co ', {_str(f'20 - {_k} % 15')}, ' Ni ', {_str(f'1 + {_k} % 9')})
 WHEN 4 THEN concat({_str(f'70 + {_k} % 25')}, CASE WHEN {_k} % 3 = 0 THEN ' WC TiC ' ELSE ' WC, ' END, {_str(f'30 - {_k} % 25')}, ' Co Fe')
 WHEN 5 THEN CASE WHEN {_k} % 3 = 0 THEN 'WC x Co' ELSE 'TiC x Ni Mo' END
 WHEN 6 THEN concat('Co', {_str(f'10 + {_k} % 21')}, 'Cr', {_str(f'15 + {_k} % 11')}, 'Fe20Ni', {_str(f'10 + {_k} % 13')}, 'Mn15')
 ELSE CASE WHEN {_k} % 3 = 0 THEN 'no entry' ELSE concat('n/a ', {_str(f'{_k} % 10')}) END END"""

VIEWS = {
    "experiments": ("orders", {
        "exp_id": _k,
        "source_id": f"concat('S', {_str('o_custkey % 20')})",
        "raw_composition": RAW_COMPOSITION,
        "sinter_temp_c": f"CASE WHEN {_k} % 3 = 0 THEN NULL ELSE CAST(1250 + {_k} % 300 AS DOUBLE) END",
        "grain_size_um": f"CAST(2 + {_k} % 40 AS DOUBLE) / 10",
        "sinter_method": f"CASE {_k} % 4 WHEN 0 THEN 'Vacuum' WHEN 1 THEN 'HIP' WHEN 2 THEN 'SPS' ELSE NULL END",
        "load_kgf": f"CAST(10 + 10 * ({_k} % 3) AS DOUBLE)",
        "created_at": "o_orderdate",
    }),
    "properties": ("orders", {
        "exp_id": _k,
        "hv": f"CASE WHEN {_k} % 11 = 0 THEN NULL ELSE 600 + o_totalprice / 200 END",
        "kic": f"CAST(50 + {_k} % 170 AS DOUBLE) / 10",
        "trs": f"CASE WHEN {_k} % 10 < 7 THEN NULL ELSE CAST(1000 + {_k} % 2500 AS DOUBLE) END",
    }),
    "proxies": ("orders", {
        "exp_id": _k,
        "pred_formation_energy": f"CAST({_k} % 101 - 75 AS DOUBLE) / 100",
        "pred_lattice_param": f"CAST(350 + {_k} % 40 AS DOUBLE) / 100",
        "pred_magnetic_moment": f"CAST({_k} % 61 - 20 AS DOUBLE) / 20",
        "pred_bulk_modulus": f"CAST(120 + {_k} % 160 AS DOUBLE)",
        "pred_shear_modulus": f"CAST(40 + {_k} % 97 AS DOUBLE)",
    }),
    "sheet": ("orders", {
        "row_id": _k,
        "grp": f"concat('G', {_str(f'{_k} % 12')})",
        "composition": f"""CASE {_k} % 9
 WHEN 0 THEN concat('b WC ', {_str(f'5 + {_k} % 30')}, ' Co')
 WHEN 1 THEN concat('WC ', {_str(f'70 + {_k} % 20')}, ' Co ', {_str(f'20 - {_k} % 15')}, ' Ni ', {_str(f'1 + {_k} % 9')})
 WHEN 2 THEN concat('WC ', {_str(f'8 + {_k} % 10')}, ' Co 0.5 Mo2C')
 WHEN 3 THEN concat('WC ', {_str(f'12 + {_k} % 9')}, ' TiC ', {_str(f'6 + {_k} % 10')}, ' Ni')
 WHEN 4 THEN 'WC x Co'
 WHEN 5 THEN concat({_str(f'80 + {_k} % 15')}, '.5 WC x Ni')
 WHEN 6 THEN concat({_str(f'20 + {_k} % 60')}, ' Co ', {_str(f'10 + {_k} % 20')}, ' Ni')
 WHEN 7 THEN concat('WC ', {_str(f'101 + {_k} % 60')}, ' Co')
 ELSE concat('TiC ', {_str(f'90 + {_k} % 5')}) END""",
        "binder_vol": f"CASE WHEN {_k} % 4 = 0 THEN '-' ELSE {_str(f'10 + {_k} % 35')} END",
        "grain": f"CASE WHEN {_k} % 7 = 0 THEN '-' ELSE concat({_str(f'{_k} % 5')}, '.', {_str(f'1 + {_k} % 9')}) END",
        "hv_text": f"CASE WHEN {_k} % 11 = 0 THEN '-' WHEN {_k} % 13 = 0 THEN 'NaN' ELSE concat('1,', {_str(f'100 + {_k} % 800')}) END",
        "kic_text": f"CASE WHEN {_k} % 6 = 0 THEN ' ' ELSE concat(' ', {_str(f'5 + {_k} % 20')}, '.25 ') END",
        "trs_text": f"CASE WHEN {_k} % 5 = 0 THEN 'n/a' ELSE {_str(f'1000 + {_k} % 2500')} END",
        "temp_text": f"CASE WHEN {_k} % 3 = 0 THEN '-' ELSE {_str(f'1250 + {_k} % 300')} END",
        "method": f"CASE {_k} % 4 WHEN 0 THEN 'Vacuum' WHEN 1 THEN 'NA' WHEN 2 THEN ' SPS ' ELSE NULL END",
    }),
    "alloys": ("part", {
        "alloy_id": "p_partkey",
        "formula": formula_sql("p_partkey"),
        "ceramic": ceramic_sql("p_partkey"),
        "binder_pct": "CAST(5 + p_partkey % 36 AS DOUBLE)",
        "grain_size_um": "CAST(2 + p_partkey % 40 AS DOUBLE) / 10",
        "sinter_temp_c": "CAST(1250 + p_partkey % 300 AS DOUBLE)",
        "volume_per_atom": "CAST(1000 + p_partkey % 400 AS DOUBLE) / 100",
        "pred_formation_energy": "CAST(p_partkey % 101 - 75 AS DOUBLE) / 100",
        "pred_lattice_param": "CAST(350 + p_partkey % 40 AS DOUBLE) / 100",
        "pred_magnetic_moment": "CAST(p_partkey % 61 - 20 AS DOUBLE) / 20",
        "bulk": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(120 + p_partkey % 160 AS DOUBLE) END",
        "shear": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(40 + p_partkey % 97 AS DOUBLE) END",
    }),
    "runs": ("lineitem", {
        "run_id": "(l_orderkey * 16777216 + l_suppkey) * 8 + l_linenumber",
        "formula": formula_sql("l_partkey"),
        "ceramic": ceramic_sql("l_suppkey"),
        "binder_pct": "l_quantity",
        "grain_size_um": "2e-1 + l_discount * 20",
        "sinter_temp_c": "1250 + l_tax * 3000",
        "volume_per_atom": "CAST(1000 + l_partkey % 400 AS DOUBLE) / 100",
        "pred_formation_energy": "CAST(l_partkey % 101 - 75 AS DOUBLE) / 100",
        "pred_magnetic_moment": "CAST(l_partkey % 61 - 20 AS DOUBLE) / 20",
    }),
    "library": ("lineitem", {
        "entry_id": "(l_orderkey * 16777216 + l_suppkey) * 8 + l_linenumber",
        "formula": f"concat({_pick('l_partkey')}, {_pick('l_suppkey * 3 + 1')})",
        "energy": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE round((l_discount - 5e-2) * 10, 2) END",
        "e_hull": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE round(l_tax, 2) END",
        "density": "CAST(40 + l_partkey % 160 AS DOUBLE) / 10",
        "is_stable": "l_tax < 2e-2",
        "volume": "l_quantity",
        "magmom": f"concat({_str('l_discount')}, ' -', {_str('l_tax')}, CASE WHEN l_partkey % 13 = 0 THEN ' ?' ELSE '' END)",
        "space_group": "CAST(194 + l_linenumber * 6 AS BIGINT)",
        "atoms": "CAST(l_linenumber AS BIGINT)",
    }),
    "activity": ("events", {
        "log_id": "event_id", "ts": "ts", "activity": "event_type",
        "details": "props", "status": "CASE WHEN value < 5 THEN 'failed' ELSE 'ok' END",
    }),
    "texts": ("documents", {
        "doc_id": "doc_id",
        "text": f"concat(text, ' The density of ', {ceramic_sql('doc_id')}, ' was ', {_str('3 + doc_id % 13')}, '.', "
                f"{_str('doc_id % 10')}, ' g/cm3. Melting point: ', {_str('1500 + doc_id % 1500')}, "
                "CASE WHEN doc_id % 2 = 0 THEN ' K.' ELSE ' °C.' END)",
        "source": "source",
    }),
}


def sql(*names):
    """WITH-clause items that define the named views in SQL."""
    out = []
    for name in names:
        table, columns = VIEWS[name]
        items = ",\n  ".join(f"{expr} AS {alias}" for alias, expr in columns.items())
        out.append(f"{name} AS (SELECT {items} FROM {table})")
    return ",\n".join(out)


#: bytes of a method beyond which the JVM leaves it to its interpreter
COMPILED_BYTES = 8000


def table(spark, sf_dir, name):
    """A given table.

    A stage whose rows run through one generated method that the JVM would not compile is
    run by operators with short methods instead; sessions are set to that, as many columns
    of one query make such methods and slow them down many times.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > COMPILED_BYTES:
        spark.conf.set(key, COMPILED_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark, sf_dir, name, heavy=False):
    """The named view as a DataFrame; unused columns are pruned to the scan.

    ``heavy`` spreads an under-split scan over all cores for per-row heavy work.
    """
    source, columns = VIEWS[name]
    scan = table(spark, sf_dir, source)
    return (spread(scan) if heavy else scan).selectExpr(
        *[f"{expr} AS {alias}" for alias, expr in columns.items()]
    )


# ------------------------------------------------------- reference tables in SQL
def values(name, columns, rows):
    """A literal table as a WITH-clause item."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


ELEMENTS_SQL = values(
    "elements",
    ("symbol", *K.ELEMENT_FIELDS, "bulk", "young", "resistivity"),
    [
        (s, *[float(x) for x in v], *[
            None if t.get(s) is None else float(t[s])
            for t in (K.BULK_MODULUS, K.YOUNGS_MODULUS, K.RESISTIVITY)
        ])
        for s, v in K.ELEMENTS.items()
    ],
)
ENTHALPY_SQL = values(
    "enthalpy", ("a", "b", "h"), [(*k.split("-"), float(h)) for k, h in K.ENTHALPY.items()]
)
COMPOUNDS_SQL = values(
    "compounds", ("formula", *K.COMPOUND_FIELDS), [(f, *v) for f, v in K.COMPOUNDS.items()]
)
INTERFACE_SQL = values(
    "interface", ("phase", "lattice_a", "neighbor"), [(p, *v) for p, v in K.CERAMIC_INTERFACE.items()]
)
METAL_DENSITY_SQL = values("metal_density", ("symbol", "rho"), list(K.METAL_DENSITY.items()))


M = 2147483647


def uni(key, stream, seed=42):
    """The candidate draw restated in SQL."""
    a = f"(({key} % {M} * 48271 + ({key} // {M}) % {M} * 69621 + {(stream + 1) * 7919 + seed * 104729}) % {M})"
    b = f"(({a} * {a} + {(stream + 1) * 15485863 + 12345}) % {M})"
    return f"((({b} * {b} + {a}) % {M} + 5e-1) / {M})"


def in_list(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def shares_sql(name, source, key, text, keep=None):
    """WITH-clause items: one row (key, el, c) per symbol of a formula column."""
    pattern = r"'([A-Z][a-z]?)\s*([0-9]*\.?[0-9]*)'"
    where = f"WHERE el IN {in_list(keep)}" if keep else ""
    return f"""{name}_raw AS (
  SELECT {key}, unnest(regexp_extract_all({text}, {pattern}, 1)) AS el,
         unnest(regexp_extract_all({text}, {pattern}, 2)) AS amt FROM {source}),
{name}_amt AS (
  SELECT {key}, el, sum(CASE WHEN amt = '' THEN 1e0 ELSE CAST(amt AS DOUBLE) END) AS amt
  FROM {name}_raw {where} GROUP BY {key}, el),
{name} AS (SELECT {key}, el, amt / sum(amt) OVER (PARTITION BY {key}) AS c FROM {name}_amt)"""
