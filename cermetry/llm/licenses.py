"""License scans: license texts and notices found inside documents.

Documents and templates are read in overlapping windows of ``WINDOW`` word
shingles (as many as it has for a shorter template), one at each shingle.  Every window
gets ``BANDS`` one-row MinHash bands.  A document whose window shares a band
with a template's window retrieves the templates.  A window copied unchanged
collides with certainty, one with a changed shingle in ``WINDOW`` with
a probability above 0.97, and a template contained to 0.8 has many windows.

Retrieved documents are verified exactly: ``containment`` is the share of a template's
shingles that one stretch of the document holds.  Stretches belong to the
template's size class: up to W shingles are looked for in W plus a block of W / 4 (W
alone up to 6), moved on by a block.

Everything is DataFrame expressions.  Words are runs of letters, and of digits
with dots inside, lower-cased; a template shorter than a shingle is one shingle
of its own length.  Null or wordless texts match nothing; repeated rows of an id
count once.  Templates are a parameter: up to ``MAX_BANDS`` bands become literals
of the scan; more are joined as a table with the bands of the documents.
"""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cermetry.llm.contain import shingles
from cermetry.llm.store import bounded, stored

WORDS, WINDOW, BANDS, MAX_BANDS = 3, 4, 4, 100_000
#: odd factors of the bands' hash functions (any fixed random odd numbers do)
FACTORS = (0x1E3779B97F4A7C15, -0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, -0x61C8864680B583EB)


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{N}+(?:\.\p{N}+)*|\p{L}+)"), F.lit(1))


def band(size, i):
    """Band ``i`` of the windows of ``size`` shingles at every place of the array ``hs`` (shorter ones at its end).

    Each band has a hash function of its own, so that a changed shingle changes the
    bands of a window independently.
    """
    own = f"transform(hs, x -> xxhash64(x ^ {FACTORS[i]}L))"
    if size == 1:
        return own
    cells = ", ".join(f"get(ys, i + {k})" for k in range(1, size))
    return f"transform(array({own}), ys -> transform(ys, (y, i) -> least(y, {cells})))[0]"


def template_arrays(templates, n=WORDS):
    """(license_id, len, hs, width): shingles of templates (license_id, text) in order and the size class."""
    rows = templates.select("license_id", words(F.col("text").cast("string")).alias("w")).where("license_id is not null and size(w) > 0")
    own = F.coalesce(*(F.when(F.size("w") == k, shingles("w", k)) for k in range(1, n)), shingles("w", n))
    rows = rows.select("license_id", F.least(F.size("w"), F.lit(n)).alias("len"), own.alias("hs"))
    # size classes: 1, 2, 3, 4, 6, 8, 12, 16, 24, ... shingles
    width = F.expr("array_min(filter(transform(sequence(0, 50), e -> cast(if(e % 2 = 0, 2, 3) * power(2, floor(e / 2) - 1) as bigint)), x -> x >= size(hs)))")
    return rows.withColumn("width", width.cast("int"))


def joined(own, table, length, kinds):
    """Shingles (doc, len, pos, h) of documents (doc, hs) that share a band of ``kinds`` (size, i) with the stored ``table``."""
    own = own.withColumn("key", F.xxhash64("hs"))
    bands = F.concat(*(F.expr(f"transform(array_distinct({band(s, i)}), v -> struct({s} as size, {i} as i, v as v))") for s, i in kinds))
    hits = own.select("key", F.explode(bands).alias("b")).select("key", "b.*").where("v is not null")
    small = bounded(table.where(F.col("len") == length).drop("len"), "bands")
    hits = hits.join(small, ["size", "i", "v"], "left_semi").select("key").distinct()
    return own.join(hits, "key", "left_semi").select("doc", F.lit(length).alias("len"), F.posexplode("hs").alias("pos", "h"))


def find(docs, templates, threshold=0.8, id_col="doc_id", text_col="text"):
    """(``id_col``, license_id, n_shared, n_template, containment) of all templates of which
    a stretch of the document holds the share ``threshold`` or more (the best stretch counts)."""
    arrays = stored(template_arrays(templates), "templates")
    size = F.least(F.size("hs"), F.lit(WINDOW))
    bands = (F.expr(f"slice({band(WINDOW, i)}, 1, size(hs) - size + 1)").alias(f"b{i}") for i in range(BANDS))
    signature = arrays.withColumn("size", size).select("len", "size", *bands)
    table = reduce(lambda a, b: a.union(b), (signature.select("len", "size", F.lit(i).alias("i"), F.explode(f"b{i}").alias("v")) for i in range(BANDS)))
    table = stored(table.distinct(), "bands")
    literal = table.count() <= MAX_BANDS
    known = {}
    for r in (table if literal else table.groupBy("len", "size", "i").agg(F.lit(None).alias("v"))).collect():
        known.setdefault((r["len"], r["size"], r["i"]), set()).add(r["v"])
    # explode of one element keeps each expensive array in a column of its own, computed once
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(F.array(words(F.col(text_col).cast("string")))).alias("w"))
    found = rows.select("doc", F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).where(F.lit(False))
    for length in sorted({k[0] for k in known}):
        own = rows.select("doc", F.explode(F.array(shingles("w", length))).alias("hs"))
        if not literal:
            found = found.union(joined(own, table, length, sorted({(s, i) for k, s, i in known if k == length})))
            continue
        hits = [f"arrays_overlap({band(s, i)}, array({', '.join(f'{v}L' for v in sorted(values))}))"
                for (k, s, i), values in sorted(known.items()) if k == length]
        hits = own.where(F.expr(" or ".join(hits)))
        found = found.union(hits.select("doc", F.lit(length).alias("len"), F.posexplode("hs").alias("pos", "h")))
    sets = arrays.select("license_id", "len", "width", F.size(F.array_distinct("hs")).cast("long").alias("n_template"), F.explode(F.array_distinct("hs")).alias("h"))
    step = F.greatest(F.expr("width div 4"), F.lit(1))
    span = F.when(step == 1, F.col("width")).otherwise(F.ceil(F.col("width") / step) + 1).cast("int")
    sets = bounded(sets.withColumns({"step": step.cast("int"), "span": span}), "sets")
    shared = found.join(sets, ["len", "h"]).withColumn("block", F.expr("pos div step").cast("int"))
    shared = shared.withColumn("stretch", F.explode(F.expr("sequence(greatest(block - span + 1, 0), block)")))
    shared = shared.groupBy("doc", "license_id", "n_template", "stretch").agg(F.count_distinct("h").alias("n_shared"))
    best = shared.groupBy("doc", "license_id", "n_template").agg(F.max("n_shared").alias("n_shared"))
    best = best.withColumn("containment", F.col("n_shared") / F.col("n_template")).where(F.col("containment") >= threshold)
    return best.select(F.col("doc").alias(id_col), "license_id", "n_shared", "n_template", "containment")


def named(found, id_col="doc_id"):
    """``found`` with ``named``: whether the template names the document's license.  Of related
    texts (one license is another with a clause more) the one contained most does, then the
    longest, then the first by name.  A document has no more rows than there are templates."""
    order = W.partitionBy(id_col).orderBy(F.desc("containment"), F.desc("n_template"), "license_id")
    return found.withColumn("named", F.row_number().over(order) == 1)
