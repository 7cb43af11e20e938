"""Versioned tables in a shared folder, changed together by one log entry.

A commit first writes new files for all its tables to folders of their own, then
one log file that names them.  Readers list the log, so they see all of a commit
or nothing: a run that stops before the log file leaves the old state, and files
that no log entry names are never read.  A batch that the log knows is not
committed again, and if two writers raced with one batch, readers take one of
its entries only.

Log rows: version, batch, table name, path, mode.  Modes: ``append``, ``replace``
(what was there before no longer counts) and ``upsert`` (newer non-NULL values win
per key and column, merged on reading until ``compact`` replaces the table).
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

LOG = "version long, batch string, name string, path string, mode string"


def entries(spark, root):
    """The log as sorted rows, one per (batch, table): one row per commit and table."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{root}/log").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    # a batch committed twice by a race counts once
    first = {}
    for r in sorted(rows):
        first.setdefault(r.batch, r.version)
    chosen = {}
    for r in sorted(rows):
        if r.version == first[r.batch]:
            chosen.setdefault((r.batch, r.name), r)
    return sorted(chosen.values())


def committed(spark, root, batch):
    return any(r.batch == batch for r in entries(spark, root))


def commit(spark, root, batch, tables, mode="append"):
    """Store ``{name: DataFrame}`` as one change; False if ``batch`` is already there."""
    log = entries(spark, root)
    if any(r.batch == batch for r in log):
        return False
    version = max((r.version for r in log), default=0) + 1
    rows = []
    for name, df in tables.items():
        path = f"{root}/data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows.append((version, batch, name, path, mode))
    # one file: it appears whole or not at all
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return True


def read(spark, root, name, key=None, version=None):
    """The table as of ``version`` (default: now).  ``key`` is needed once it has upserts."""
    log = [r for r in entries(spark, root) if r.name == name and (version is None or r.version <= version)]
    start = max((i for i, r in enumerate(log) if r.mode == "replace"), default=0)
    log = log[start:]
    if not log:
        raise ValueError(f"no stored table {name!r}")
    if all(r.mode != "upsert" for r in log):
        return spark.read.option("mergeSchema", True).parquet(*[r.path for r in log])
    parts = [spark.read.parquet(r.path).withColumn("_order", F.lit(i)) for i, r in enumerate(log)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_order")]
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    return both.groupBy(key).agg(*[newest(c) for c in columns])


def compact(spark, root, name, key=None):
    """Replace a table by its merged state, under one log entry."""
    state = read(spark, root, name, key)
    return commit(spark, root, f"compact {name} {uuid.uuid4().hex}", {name: state}, mode="replace")
