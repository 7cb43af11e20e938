"""Words of whole texts as Arrow arrays, and bounded lists of the most frequent keys of a count table."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: bytes that end a word: blank and 0x09-0x0D
SEPARATES = np.zeros(256, dtype=bool)
SEPARATES[[32, 9, 10, 11, 12, 13]] = True
#: A-Z become a-z, all other bytes stay
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]


def words_of(texts):
    """All words of a string array, one after the other, with A-Z lower-cased, and
    their number per text.  Null and empty texts have none."""
    texts = pc.fill_null(texts, "")
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    if begin[-1] == begin[0]:
        return pa.array([], type=pa.string()), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin[0]:begin[-1]]
    begin = begin - begin[0]
    inside = ~SEPARATES[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begin] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    kept = np.append(0, np.cumsum(inside))
    ends = np.append(kept[start], kept[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]]))
    return words, np.diff(np.searchsorted(start, begin))


def add_counts(total, keys, counts):
    """A table of (key, n) with further counts added; ``total`` may be None."""
    more = pa.table({"key": keys, "n": pa.array(counts, type=pa.int64())})
    both = more if total is None else pa.concat_tables([total, more])
    return both.group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])


def frequent_from(counts, n, limit):
    """The smallest count such that at most ``limit`` rows of ``counts`` have it or more.

    Counts are compared by their first ten binary digits, so one row per digit
    string, at most some 30,000 in all, reaches the driver.
    """
    shift = F.greatest(F.floor(F.log2(F.col(n).cast("double"))) - 9, F.lit(0))
    lower = F.floor(F.col(n) / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)
    rows = sorted(counts.groupBy(lower.cast("long").alias("low")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    at, total = None, 0
    for low, count in rows:
        total += count
        if total > limit:
            break
        at = low
    # none fits: beyond the largest count
    return at if at is not None else (rows[0][0] * 2 + 1024 if rows else 1)
