"""Registered queries: sources and sinks."""

from pyspark.sql import functions as F

from cermetry.functions.composition import formula_amounts
from cermetry.plans import bridge as B
from cermetry.plans.registry import query
from cermetry.sources import dims, files

ORDER_CSV = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"


def _orders(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("a1_read_csv", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def a1(spark, sf):
    path = files.write_csv_report(_orders(spark, sf), files.exchange_path(spark, "a1"))
    return files.read_csv(spark, path, ORDER_CSV)


@query("a2_read_parquet", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 25")
def a2(spark, sf):
    return files.read_parquet(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_discount"]
    ).filter("l_quantity > 25")


@query("a3_csv_to_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def a3(spark, sf):
    csv = files.save_dataset(_orders(spark, sf), files.exchange_path(spark, "a3c"), "csv")
    return files.csv_to_parquet(spark, csv, files.exchange_path(spark, "a3p"), ORDER_CSV)


@query("a4_save_dataset", """SELECT 'csv' AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT 'parquet', count(*), round(sum(o_totalprice), 2) FROM orders""")
def a4(spark, sf):
    out = []
    for kind in ("csv", "parquet"):
        path = files.save_dataset(_orders(spark, sf), files.exchange_path(spark, "a4"), kind)
        df = files.read_csv(spark, path, ORDER_CSV) if kind == "csv" else files.read_parquet(spark, path)
        out.append(df.agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
        ))
    return out[0].unionByName(out[1])


@query("a5_json_dims", f"""WITH {B.sql('alloys')}, {B.ELEMENTS_SQL}, {B.shares_sql('sh', 'alloys', 'alloy_id', 'formula')}
SELECT symbol, mass, rho, vec, count(*) AS n_alloys FROM sh JOIN elements ON el = symbol GROUP BY ALL""")
def a5(spark, sf):
    """The element table read from keyed JSON, joined with its use in the data."""
    path = files.exchange_path(spark, "a5")
    spark.range(1).select(F.lit(dims.element_json()).alias("value")).write.text(path)
    table = files.read_keyed_json(spark, path, "mass double, rho double, vec double").select(
        F.col("key").alias("symbol"), "record.*"
    )
    used = (
        B.view(spark, sf, "alloys").select(F.explode(F.map_keys(formula_amounts("formula"))).alias("symbol"))
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("n_alloys"))
    )
    return used.join(F.broadcast(table), "symbol")


@query("a6_keyed_json_library", f"WITH {B.sql('alloys')} SELECT CAST(alloy_id AS VARCHAR) AS material_id, formula, bulk, shear FROM alloys")
def a6(spark, sf):
    rows = B.view(spark, sf, "alloys").select("alloy_id", "formula", "bulk", "shear", F.expr("alloy_id div 500").alias("shard"))
    path = files.write_keyed_json(rows, "alloy_id", files.exchange_path(spark, "a6"), "shard")
    return files.read_keyed_json(spark, path, "formula string, bulk double, shear double", per_line=True).select(
        F.col("key").alias("material_id"), "record.*"
    )


@query("a7_stored_table_scan", f"WITH {B.sql('experiments')} SELECT exp_id, source_id, grain_size_um FROM experiments")
def a7(spark, sf):
    path = files.save_dataset(B.view(spark, sf, "experiments"), files.exchange_path(spark, "a7"))
    return files.read_parquet(spark, path, ["exp_id", "source_id", "grain_size_um"])


@query("a8_text_documents", "SELECT item_id, CAST(length(text) AS BIGINT) AS n_chars, substring(text, 1, 200) AS preview FROM benchmark")
def a8(spark, sf):
    """One file per passage, read back whole."""
    path = files.exchange_path(spark, "a8")
    B.table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return files.read_documents(spark, f"{path}/*").select(
        F.regexp_extract("file", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "n_chars", "preview"
    )


@query("a9_csv_report", f"WITH {B.sql('alloys')} SELECT alloy_id, formula, binder_pct FROM alloys")
def a9(spark, sf):
    path = files.write_csv_report(
        B.view(spark, sf, "alloys").select("alloy_id", "formula", "binder_pct"), files.exchange_path(spark, "a9")
    )
    return files.read_csv(spark, path, "alloy_id bigint, formula string, binder_pct double")


@query("a10_json_report", "SELECT count(*) AS total_rows, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 2) AS top FROM orders")
def a10(spark, sf):
    report = _orders(spark, sf).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("o_custkey").alias("customers"),
        F.round(F.max("o_totalprice"), 2).alias("top"),
    )
    path = files.write_json_report(report, files.exchange_path(spark, "a10"))
    return spark.read.schema(report.schema).json(path)


@query("a11_append_log", f"""WITH {B.sql('activity')} SELECT log_id, activity, status FROM activity
UNION ALL SELECT log_id, activity, 'replayed' FROM activity WHERE status = 'failed'""")
def a11(spark, sf):
    path = files.exchange_path(spark, "a11")
    log = B.view(spark, sf, "activity").select("log_id", "activity", "status")
    files.append_log(log, path)
    files.append_log(log.filter("status = 'failed'").withColumn("status", F.lit("replayed")), path)
    return files.read_parquet(spark, path)
