"""Token counts through a digest cache.

The cache is a Parquet table (``content``, ``tokenizer``, ``n_tokens``) keyed by
the SHA-256 of the normalised content and a digest of the tokenizer version.
Contents found there are not encoded again; every other distinct content is
encoded once, by one representative row, and its count appended.

Normalised content is the text itself, null as empty: anything further could
change counts.  Repeated rows give one count each; no column but the id and
the text is read.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cermetry.llm import bpe
from cermetry.llm.store import arrow_schema, bounded, pieces, stored

CACHE = "content binary, tokenizer string, n_tokens long"
#: raised when the counting code changes its results
VERSION = "1"


def tokenizer_digest(path, pattern):
    """Names the tokenizer version: its file's bytes, the word pattern and ``VERSION``."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + pattern.encode() + b"\0" + VERSION.encode()).hexdigest()


def read_cache(spark, path):
    """The stored counts; an absent cache is an empty one."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


#: contents that a task remembers as encoded
SEEN = 500_000


def cache_path(root, path, pattern):
    """Where the counts of one tokenizer version lie below a shared folder, for all runs alike."""
    return f"{root.rstrip('/')}/token-counts-{tokenizer_digest(path, pattern)[:16]}"


def compact(spark, cache, files=1):
    """Rewrite the counts that many runs have appended into a new folder of ``files`` files; returns its path.
    The old folder stays for runs that read it."""
    new = f"{cache}-{uuid.uuid4().hex}"
    read_cache(spark, cache).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).repartition(files, "content").write.parquet(new)
    return new


def encode_counts(rows, path, pattern):
    """(content, text) -> (content, n_tokens).  A task encodes rows of one content once."""

    def run(batches):
        coder, seen = bpe.load(path, pattern), set()
        for whole in batches:
            new = []
            for content in whole.column(0).to_pylist():
                new.append(content not in seen)
                seen.add(content)
            if len(seen) > SEEN:
                seen.clear()
            for batch in pieces(whole.filter(pa.array(new, type=pa.bool_())), 1):
                count = coder.encode(batch.column(1))[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.astype(np.int64))], schema=arrow_schema("content binary, n_tokens long"))

    return rows.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def count_tokens(docs, cache_path, path, pattern, id_col="doc_id", text_col="text", limit=512):
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row.

    Texts are joined to the list of misses in whole rows; the list is broadcast
    when its counted size is small, otherwise both sides are shuffled on keys
    that no two different rows share.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path, pattern)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    misses = rows.groupBy("content").agg(F.min("id").alias("first")).join(known, "content", "left_anti")
    misses = bounded(misses.withColumnRenamed("content", "missing"), "misses")
    chosen = texts.join(misses, (F.col("content") == F.col("missing")) & F.col("id").eqNullSafe(F.col("first")))
    # rows that repeat id and content, or a content without ids, are encoded once per task; the cache keeps one count
    counts = encode_counts(chosen, path, pattern).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(known, "content", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
