"""Written tables, size-checked broadcasts and input reading shared by the operators."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cermetry.session import broadcast_bytes, cut_lineage


#: rows of an Arrow batch; whole texts may be long, and a batch lies in memory on both sides
ARROW_ROWS = 2000


def table(spark, sf_dir, name):
    """A given table; only Spark reads the path, so any store it knows will do.

    Sessions that send larger Arrow batches to Python are set to ``ARROW_ROWS``.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df, name):
    """``df`` written to the shared folder and read back (survives lost executors)."""
    return cut_lineage(df, name)


def bounded(df, name, max_rows=2_000_000, max_bytes=64 << 20):
    """A written copy of ``df``, hinted for broadcast only when it has few rows and its
    memory as a hash table, measured over its rows, stays below ``max_bytes``; otherwise
    the join is a shuffle."""
    copy = stored(df, name)
    rows, size = copy.agg(F.count(F.lit(1)), broadcast_bytes(copy)).first()
    return F.broadcast(copy) if rows <= max_rows and size <= max_bytes else copy


def arrow_schema(ddl):
    """A ``pyarrow`` schema from ``name type`` pairs of the small type set used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in ddl.split(","))])


def with_id(source, ddl):
    """Output schema: the column ``id`` of ``source`` and the columns of ``ddl``."""
    return StructType([StructField("id", source.schema["id"].dataType), *StructType.fromDDL(ddl).fields])


def pieces(batch, column, limit=2 << 20):
    """Slices of an Arrow batch whose ``column`` holds about ``limit`` bytes each
    (one row at least), so that working arrays stay bounded however long the texts are."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
