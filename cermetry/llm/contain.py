"""Benchmark decontamination: short items found inside long documents.

A document's set of word shingles is far larger than an item's, so their
similarity says nothing; what counts is the share of the item's shingles that
the document contains.  Items are partitioned by the size of their sets.  In
each partition an item's MinHash signature is the shingles with the smallest
value under each of k hash functions; under each function that shingle lies in a
document with a probability equal to the item's containment there.  A
document is a candidate if it holds one of the signature's shingles, and k
is set per partition so that an item contained to ``threshold`` is missed with a probability
below ``MISS`` (items of k shingles or fewer are their own signature and
cannot be missed).  Candidates are verified by exact containment.

Everything is DataFrame expressions.  Words are runs of letters and digits,
lower-cased; items of fewer words than a shingle are searched as one shingle of their own length.
Null or wordless texts match nothing.  Repeated documents or items give
one row per pair of ids; rows with a null id count as one document or item.
"""

import math

from pyspark.sql import functions as F

from cermetry.llm.store import bounded, stored

WORDS = 5
MISS = 1e-9


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingles(column, n):
    """Hashes of all runs of ``n`` words of an array column (none if there are fewer)."""
    return F.expr(f"if(size({column}) >= {n}, transform(sequence(1, size({column}) - {n - 1}), i -> xxhash64(slice({column}, i, {n}))), array())")


def item_sets(items, id_col="item_id", text_col="text", n=WORDS):
    """(item, len, h): distinct shingles of every item; ``len`` is their number of words."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    per_length = F.coalesce(*(F.when(F.size("w") == k, shingles("w", k)) for k in range(1, n)), shingles("w", n))
    return rows.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), F.explode(per_length).alias("h")).distinct()


def signatures(sets, threshold):
    """(item, h): each item's signature, by size partition (sizes up to 2, 4, 8, ... shingles)."""
    k = max(1, math.ceil(math.log(MISS) / math.log(1 - threshold))) if threshold < 1 else 1
    sizes = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.ceil(F.log2("n")))
    # partitions whose largest size is within k keep all their shingles
    whole = sets.join(sizes.where(F.pow(F.lit(2), F.col("part")) <= k), "item").select("item", "len", "h")
    large = sets.join(sizes.where(F.pow(F.lit(2), F.col("part")) > k), "item")
    draws = [F.min_by("h", F.xxhash64("h", F.lit(j))).alias(f"h{j}") for j in range(k)]
    drawn = large.groupBy("item", "len").agg(*draws)
    drawn = drawn.select("item", "len", F.explode(F.array_distinct(F.array(*(f"h{j}" for j in range(k))))).alias("h"))
    return whole.union(drawn)


def document_shingles(docs, lengths, id_col, text_col):
    """(doc, len, h): shingles of all documents, of the lengths that items have."""
    rows = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col).cast("string")).alias("w"))
    parts = [rows.select("doc", F.lit(k).alias("len"), F.explode(F.array_distinct(shingles("w", k))).alias("h")) for k in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def find(docs, items, threshold=0.8, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", n=WORDS):
    """(``id_col``, ``item_col``, n_shared, n_item, containment) of all pairs contained to ``threshold`` or more."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    names = [f"{c}_doc" if id_col == item_col else c for c in (id_col,)] + [item_col]
    # few files: the items are the small side, and every file costs the executors a process
    sets = stored(item_sets(items, item_col, item_text_col, n).coalesce(8), "items")
    lengths = sorted(r[0] for r in sets.select("len").distinct().collect())  # at most n numbers
    if not lengths:
        empty = docs.select(F.col(id_col).alias("doc")).where(F.lit(False)).crossJoin(sets.select("item").limit(0))
        return empty.select(F.col("doc").alias(names[0]), F.col("item").alias(names[1]), F.lit(0).cast("long").alias("n_shared"),
                            F.lit(0).cast("long").alias("n_item"), F.lit(0.0).alias("containment"))
    probe = bounded(signatures(sets, threshold), "signatures")
    hits = document_shingles(docs, lengths, id_col, text_col).join(probe, ["len", "h"]).select("doc", "item").distinct()
    hits = stored(hits, "candidates")
    some = bounded(hits.select(F.col("doc").alias("hit")).distinct(), "contaminated")
    few = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(some, F.col("doc").eqNullSafe(F.col("hit")), "left_semi")
    size = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    full = bounded(sets.join(size, "item"), "sets")
    shared = document_shingles(few, lengths, "doc", "text").join(full, ["len", "h"])
    exact = shared.groupBy("doc", "item", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    hits = hits.select(F.col("doc").alias("d"), F.col("item").alias("i"))
    exact = exact.join(hits, F.col("doc").eqNullSafe(F.col("d")) & F.col("item").eqNullSafe(F.col("i")), "left_semi")
    exact = exact.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)
    return exact.select(F.col("doc").alias(names[0]), F.col("item").alias(names[1]), "n_shared", "n_item", "containment")
