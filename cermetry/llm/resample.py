"""Importance resampling towards a target text collection (hashed n-gram features).

A 256-byte table lower-cases A-Z and blanks every other ASCII byte that is no
letter or digit; ``bytes.split`` then yields the words.  A feature's bucket is
the CRC-32 of its bytes; the checksum of a longer run is extended from that of
the shorter one by passing it on as the seed, so no n-gram is ever built as a
string.  Counters reduce the features of a task before Spark sums the buckets.

Null and empty texts have no features: weight 0, never drawn.  Rows that repeat
an id get the same noise; ties of score and id have ranks in any order.  Only
the id and text columns are read.  An empty target counts zero in every bucket.
"""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cermetry.llm.store import arrow_schema, pieces, stored, with_id

#: every byte's stand-in: letters, digits and bytes of longer UTF-8 characters stay
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: words whose checksum a worker remembers
MEMORY = 200_000


def words(text):
    """The words of a text (str or None) as bytes."""
    return text.encode().translate(TABLE).split() if text else []


def bucket_runs(tokens, n, buckets):
    """Bucket numbers of all runs of 1 to ``n`` consecutive words, repeats included."""
    found = [crc32(w) for w in tokens]
    out = [x % buckets for x in found]
    for k in range(1, n):
        found = [crc32(tokens[i + k], crc32(b" ", x)) for i, x in enumerate(found[:len(tokens) - k])]
        out += [x % buckets for x in found]
    return out


def text_features(tokens, n, buckets, memory):
    """(bucket, times) of a text as a Counter; single words are looked up in ``memory``."""
    if n > 1:
        return Counter(bucket_runs(tokens, n, buckets))
    out = Counter()
    for w, times in Counter(tokens).items():
        at = memory.get(w)
        if at is None:
            if len(memory) >= MEMORY:
                memory.clear()
            at = memory[w] = crc32(w) % buckets
        out[at] += times
    return out


def bucket_counts(docs, text_col, n, buckets):
    """(bucket, n) over all texts; every task hands on one row per bucket."""

    def run(batches):
        total, memory = np.zeros(buckets, dtype=np.int64), {}
        for whole in batches:
            for batch in pieces(whole, 0):
                for text in batch.column(0).to_pylist():
                    found = text_features(words(text), n, buckets, memory)
                    if found:
                        total[list(found)] += np.fromiter(found.values(), dtype=np.int64, count=len(found))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=arrow_schema("bucket long, n long"))

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw, target, buckets):
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) per bucket, from two arrays of counts."""
    S, T = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))
                     for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def weights(docs, gain, id_col, text_col, n, buckets):
    """id, ``n_features``, ``n_words`` and ``weight`` of every row."""
    schema = "n_features long, n_words long, weight long"

    def run(batches):
        memory = {}
        for whole in batches:
            for batch in pieces(whole, 1):
                rows = []
                for text in batch.column(1).to_pylist():
                    tokens = words(text)
                    found = text_features(tokens, n, buckets, memory)
                    total = sum(found.values())
                    at = np.fromiter(found, dtype=np.int64, count=len(found))
                    times = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                    rows.append((total, len(tokens), int((gain[at] * times).sum()) // total if total else 0))
                cols = [pa.array(v, type=pa.int64()) for v in zip(*rows)] if rows else [pa.array([], type=pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_features", "n_words", "weight"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, with_id(source, schema))


def counted(frame, buckets):
    """The bucket table as one array of ``buckets`` numbers."""
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in frame.collect():
        out[bucket] = n
    return out


def resample(docs, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024, id_col="doc_id", text_col="text", target_col="text"):
    """Draw ``percent`` of the documents with at least ``min_words`` words, without
    replacement and with chances in proportion to exp(weight / 1000).

    Returns every row: id, ``n_features``, ``n_words``, ``weight``, ``score``
    (weight plus Gumbel noise, in thousandths) and ``rank`` (1, 2, ... by falling
    score, ties to smaller ids; null where undrawn).

    Scores are whole numbers in a range fixed by ``buckets`` and the noise, so
    the counts per score are a small table whatever the input.  It gives each
    score's first rank; rows are ordered only among those of one score.
    """
    gain = gains(counted(bucket_counts(docs, text_col, n, buckets), buckets),
                 counted(bucket_counts(target, target_col, n, buckets), buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights(docs, gain, id_col, text_col, n, buckets).withColumn("score", F.col("weight") + noise)
    scored = stored(scored, "scores")
    able = F.col("n_words") >= min_words
    histogram = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("rows")).collect()
    draws, starts, before = sum(r.rows for r in histogram) * percent // 100, [], 0
    for score, rows in sorted(((r.score, r.rows) for r in histogram), reverse=True):
        if before >= draws:
            break
        starts.append((score, before))
        before += rows
    low = starts[-1][0] if starts else None
    drawn = scored.where(able & (F.col("score") >= F.lit(low)))
    first = F.broadcast(docs.sparkSession.createDataFrame(starts, "score long, start long"))  # one row per score: bounded
    place = F.row_number().over(W.partitionBy("score").orderBy("id")).cast("long")
    rank = F.col("start") + F.col("place")
    drawn = drawn.withColumn("place", place).join(first, "score").withColumn("rank", F.when(rank <= draws, rank))
    names = [F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", "rank"]
    rest = scored.where(~(able & F.coalesce(F.col("score") >= F.lit(low), F.lit(False)))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*names).unionByName(rest.select(*names))
