"""Session defaults and the shared folder used for checkpoints and exchange files."""

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows are short texts that take much work each, so keep small partitions
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app="cermetry", master=None, **conf):
    """A session with the defaults above; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark, name):
    """A fresh path below the cluster's shared checkpoint folder.

    A cluster names the folder in ``spark.checkpoint.dir``.  Only a session in
    one process, as in local tests, may do without: it gets a temporary folder.
    Anywhere else the executors could not see such a folder, and this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark, "_cermetry_dir", None)
        if not root:
            root = spark._cermetry_dir = tempfile.mkdtemp(prefix="cermetry-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name="stage"):
    """Write ``df`` to the shared folder and read it back, so that a lost
    executor costs a re-read rather than a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    spark._cermetry_stages = [*getattr(spark, "_cermetry_stages", []), path]
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark):
    """Delete the intermediate results that ``cut_lineage`` has written in this session, and
    return their number.  For when the results that read them are written themselves."""
    stages, spark._cermetry_stages = getattr(spark, "_cermetry_stages", []), []
    for path in stages:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(stages)


def broadcast_bytes(df):
    """Estimated memory of ``df`` as a broadcast hash table, as a column to aggregate.

    A row stands there twice, as key and as value, each with eight bytes per column
    and the bytes of its texts; pointers and the table's spare room come on top.
    """
    variable = F.lit(0).cast("long")
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("string", "binary"):
            variable = variable + F.coalesce(F.octet_length(c), F.lit(0)) + 7
        elif field.dataType.typeName() in ("array", "map", "struct"):
            variable = variable + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.coalesce(F.sum(2 * (8 + 8 * len(df.columns) + variable) + 64), F.lit(0)).cast("long")


def checked_broadcast(df, max_bytes=64 << 20):
    """``df`` with a broadcast hint if it is proven to be small.

    The frame is written to the shared folder first, so that measuring it computes
    nothing twice.  Beyond ``max_bytes`` of memory, as measured over its rows, the join is
    left to a shuffle with adaptive skew splitting; the rows are the same either way.
    """
    stored = cut_lineage(df, "side")
    return F.broadcast(stored) if stored.agg(broadcast_bytes(stored)).first()[0] <= max_bytes else stored
