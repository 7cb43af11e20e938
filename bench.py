"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores.  Every query is run to its last row into a sink that
discards them.
"""

import json
import os
import sys
import time

QUERIES = (
    "flagship_top_alloys", "c10_parse_cascade", "c14_bulk_sheet_parse", "d41_inject_features", "e1_training_data",
    "e19_lowest_energy", "f2_median_fill", "f16_correlation_matrix", "f16_correlation_wide", "f19_duplicates",
    "g4_spearman_matrix", "i1_dirichlet_candidates", "i10_run_screening", "i11_candidate_funnel", "i13_pareto_front",
    "i16_design_tasks",
)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from cermetry.plans import load
    from cermetry.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(queries["a2_read_parquet"](spark, sf))
    times = {}
    for name in QUERIES:
        start = time.time()
        sink(queries[name](spark, sf))
        times[name] = round(time.time() - start, 3)
    runs = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
        "rows_per_sec": {
            "d41_inject_features": round(runs / times["d41_inject_features"]),
            "i10_run_screening": round(runs / times["i10_run_screening"]),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
