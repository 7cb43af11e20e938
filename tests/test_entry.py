"""The registered queries against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import close, normal, ordered

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "a6_keyed_json_library", "b4_merge_columns", "b12_composition_checks", "c10_parse_cascade", "c11_implicit_amounts",
    "c16_standard_strings", "d5_mixing_enthalpy", "d23_binder_physics", "d35_property_statistics", "d41_inject_features",
    "e1_training_data", "e2_full_export", "e6_work_list", "e7_page_rows", "e9_stored_record", "e12_stored_intake", "e13_stored_upsert", "e19_lowest_energy", "f5_describe", "f16_correlation_wide", "f19_duplicates",
    "f39_running_best", "g2_two_phase_maps", "g4_spearman_matrix", "g10_label_encoding", "h3_two_rounds", "h8_classification_report", "h16_stump_folds", "h22_stump_effect", "h12_blend_sweep",
    "i2_bounded_candidates", "i13_pareto_front", "i16_design_tasks", "j1_property_mentions",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 220


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["alloy_id", "formula", "s_mix", "vec", "h_mix"] and df.count() == 20


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    got = ordered([tuple(normal(r[c]) for c in order) for r in df.collect()])
    want = ordered([tuple(normal(r[cols.index(c)]) for c in order) for r in res.fetchall()])
    assert len(got) == len(want) > 0
    assert all(close(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_registry_loads_without_a_session():
    """Listing the queries and their SQL needs no running Spark."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert done.returncode == 0, done.stderr
