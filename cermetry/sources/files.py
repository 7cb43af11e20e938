"""File sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cermetry.session import shared_dir

BOM = "﻿"


def read_csv(spark, path, schema=None, **options):
    """CSV with a header.  A byte-order mark in front of the first name is
    dropped; without ``schema`` the types are inferred (one more scan)."""
    reader = spark.read.options(header=True, encoding="UTF-8", **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumnsRenamed({c: c.lstrip(BOM) for c in df.columns if c.startswith(BOM)})


def read_parquet(spark, path, columns=None):
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv_to_parquet(spark, source, target, schema=None, mode="overwrite"):
    read_csv(spark, source, schema).write.mode(mode).parquet(target)
    return read_parquet(spark, target)


def save_dataset(df, path, kind="parquet", mode="overwrite"):
    """Write as ``parquet`` or ``csv`` (with a header)."""
    if kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown dataset kind {kind!r}")
    return path


def write_csv_report(df, path):
    """CSV whose header starts with a byte-order mark, for spreadsheet programs."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json_report(df, path):
    """A small report (one row per part) as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def append_log(df, path):
    """Append-only log table; concurrent writers never rewrite old entries."""
    df.write.mode("append").parquet(path)
    return path


def read_keyed_json(spark, path, value_type, per_line=False):
    """JSON objects keyed by record id, to rows (key, record).

    By default each file is one object, possibly over many lines; ``per_line``
    reads one object per line, which also lets large files be split.
    """
    text = spark.read.text(path, wholetext=not per_line)
    parsed = F.from_json("value", T.MapType(T.StringType(), T._parse_datatype_string(value_type)))
    return text.select(F.explode(parsed).alias("key", "record"))


def write_keyed_json(df, key, path, shard):
    """Write rows as keyed JSON objects, one line per value of ``shard``.

    The caller picks shards of bounded size (an id range, say).
    """
    fields = [c for c in df.columns if c not in (key, shard)]
    packed = F.struct(F.col(key).cast("string").alias("k"), F.struct(*fields).alias("v"))
    (
        df.groupBy(shard)
        .agg(F.to_json(F.map_from_entries(F.collect_list(packed))).alias("value"))
        .select("value").write.mode("overwrite").text(path)
    )
    return path


def read_documents(spark, path, preview=200):
    """One row per text file: its name, length and first characters."""
    text = F.regexp_replace("value", r"\n$", "")
    return (
        spark.read.text(path, wholetext=True)
        .withColumn("file", F.input_file_name())
        .select(
            "file", F.length(text).cast("bigint").alias("n_chars"),
            F.substring(text, 1, preview).alias("preview"),
        )
    )


def exchange_path(spark, name):
    return shared_dir(spark, name)


def spread(scan):
    """Redistribute a scan that has fewer partitions than the cluster has cores.

    Small or badly split files would otherwise leave per-row heavy work to a few
    tasks.  A scan that is already well split stays as it is, without a shuffle.
    Only for frames straight from a source: their partitions are known before
    anything runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
