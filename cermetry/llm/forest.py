"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is its set of word shingles; two documents are linked when
100 * |intersection| >= similarity * |union|, confirmed on the full sets of
shingle hashes.  Links come from ``TREES`` sorted orders of the signatures: in
each order a document's candidates are its neighbours by longest common prefix.

* Depth adapts to the region: documents that share ``DEPTH`` leading values form
  a region; a region of at most ``SMALL`` documents yields all its pairs, a larger one is
  cut at the next value, and so on down to single labels, whose documents are
  chained.
* A crowded region moreover has a centre: the member whose own neighbourhoods
  are the largest over all orders (in a group of edited copies, the original).
  Every member is compared with it, so a group of any size costs a number of
  candidates proportional to its size.
* What a crowded region's centre leaves over is handled exactly: members not
  linked with the centre are compared with all others of the region, block by
  block, without producing the pairs as rows.

A pair at similarity 0.8 shares a region in one order or more with probability
1 - (1 - 0.8^2)^12 > 0.99999.

Documents with equal sets are one node.  A null or wordless text has an empty
set, is linked with nothing and forms its own class.  Rows that repeat an id
are kept as rows; the class id is the smallest non-null id reachable.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cermetry.llm.bpe import gather
from cermetry.llm.graph import components
from cermetry.llm.shingles import mix, shingle_sets
from cermetry.llm.store import arrow_schema, bounded, pieces, stored, with_id

TREES, LEVELS, DEPTH, SMALL = 12, 10, 2, 8
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, size=TREES * LEVELS, dtype=np.uint64)
BLOCK = 128


def signature(values):
    """``TREES * LEVELS`` 32-bit MinHash values of a non-empty set, big-endian so that bytes sort as numbers."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        part = values[at:at + 1024, None] ^ _SEEDS
        part *= np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def sketches(texts, words):
    """(id, text) -> id, n_shingles, key (16-byte digest of the set, null if empty), sig, read (hash of the text)."""

    def run(batches):
        schema = arrow_schema("n_shingles long, key binary, sig binary")
        for whole in batches:
            for b in pieces(whole, 1):
                sets = shingle_sets(b.column(1), words)
                cols = [[len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        [signature(s) if len(s) else None for s in sets]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, type=f.type) for c, f in zip(cols, schema))],
                                                 names=["id", "read", *schema.names])

    return texts.select("id", "text", "read").mapInArrow(run, with_id(texts, "read long, n_shingles long, key binary, sig binary"))


def full_sets(texts, words):
    """(text) -> key, full set as array<long>."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, 0, 1 << 20):
                sets = shingle_sets(b.column(0), words)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64))
                keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], type=pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "items"])

    return texts.select("text").mapInArrow(run, "key binary, items array<bigint>")


def neighbours(labels):
    """Sorted (tree, label, key) rows -> candidate pairs and memberships of crowded regions."""

    def run(batches):
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        tree, keys = rows.column(0).to_numpy(), rows.column(2).to_pylist()
        label = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype=">u4").reshape(len(keys), LEVELS)
        common = np.zeros(len(keys), dtype=np.int64)  # values shared with the row before
        if len(keys) > 1:
            same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            common[1:] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        a, b, region, weight = [], [], [], []

        def size(depth):
            run_no = np.cumsum(common < depth)
            return np.bincount(run_no)[run_no]

        crowd = size(DEPTH)
        near = crowd + size(DEPTH + 2) + size(DEPTH + 4)
        todo = [(DEPTH, 0, len(keys))]
        while todo:
            depth, lo, hi = todo.pop()
            cuts = np.concatenate(([lo], lo + 1 + np.flatnonzero(common[lo + 1:hi] < depth), [hi]))
            several = np.flatnonzero(np.diff(cuts) > 1)
            for s, e in zip(cuts[several].tolist(), cuts[several + 1].tolist()):
                if e - s <= SMALL:
                    i, j = np.triu_indices(e - s, 1)
                elif depth < LEVELS:
                    todo.append((depth + 1, s, e))
                    continue
                else:
                    i, j = np.arange(e - s - 1), np.arange(1, e - s)
                a += (s + i).tolist()
                b += (s + j).tolist()
        big = np.flatnonzero(crowd > SMALL)
        prefix = label[:, :DEPTH].astype(np.uint64)
        name = mix(prefix[:, 0] << np.uint64(32) | prefix[:, 1]) ^ tree.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([
            pa.array([keys[i] for i in a] + [keys[i] for i in big], type=pa.binary()), pa.array([keys[i] for i in b] + [None] * len(big), type=pa.binary()),
            pa.array([None] * len(a) + name[big].view(np.int64).tolist(), type=pa.int64()), pa.array([0] * len(a) + near[big].tolist(), type=pa.int64()),
        ], names=["a", "b", "region", "weight"])

    return labels.mapInArrow(run, "a binary, b binary, region bigint, weight bigint")


def similar(x, y, similarity):
    """Whether two array columns of distinct values are at least ``similarity`` percent alike."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= similarity * (F.size(x) + F.size(y) - both)


def leftovers(members, sets, similarity):
    """Links of members that their region's centre does not explain.

    ``members``: (region, key, linked with the centre).  They become blocks of
    about ``BLOCK`` sets; each pair of blocks with a member that is not linked
    is compared within one task.  Members linked with the centre are in one
    class already, so one link to any of them per block is enough.
    """
    load = members.groupBy("region").agg((F.count(F.lit(1)) / BLOCK + 1).cast("int").alias("blocks"))
    placed = members.join(load, "region").withColumn("block", F.pmod(F.xxhash64("key", "region"), F.col("blocks")))
    packed = placed.join(sets, "key").groupBy("region", "block", "blocks").agg(F.collect_list(F.struct("key", "items", "linked")).alias("rows"))
    packed = stored(packed.withColumn("groups", F.ceil(F.sqrt("blocks")).cast("int")), "blocks")
    # a region's blocks are compared in about the square root of their number of tasks
    wanted = packed.select("region", F.expr("block % groups").cast("int").alias("group"), F.expr("filter(rows, r -> not r.linked)").alias("mine")).where("size(mine) > 0")
    others = packed.select("region", "rows", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    pairs = wanted.join(others, ["region", "group"]).select("mine", "rows")

    def opened(cell):
        part = cell.values
        items = part.field("items")
        return part.field("key").to_pylist(), items.value_lengths().to_numpy(), items.flatten().to_numpy(), part.field("linked").to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own_keys, own_sizes, own_items, _ = opened(batch.column(0)[i])
                keys, sizes, items, linked = opened(batch.column(1)[i])
                owner = np.repeat(np.arange(len(keys)), sizes)
                order = np.argsort(items, kind="stable")
                items, owner = items[order], owner[order]
                a, b = [], []
                for key, own in zip(own_keys, np.split(own_items, np.cumsum(own_sizes)[:-1])):
                    lo = np.searchsorted(items, own, "left")
                    n = np.searchsorted(items, own, "right") - lo
                    both = np.bincount(gather(owner, lo, n), minlength=len(keys))
                    hit = 100 * both >= similarity * (len(own) + sizes - both)
                    for j in [*np.flatnonzero(hit & ~linked), *np.flatnonzero(hit & linked)[:1]]:
                        if keys[j] != key:
                            a.append(key)
                            b.append(keys[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary())], names=["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs, words=5, similarity=80, id_col="doc_id", text_col="text"):
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    ``kept`` marks the row whose id is the class id; rows without words are kept.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("read", F.xxhash64("text"))
    rows = stored(sketches(texts, words), "sketches")
    nodes = stored(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.min("read").alias("read")), "nodes")
    trees = nodes.select("key", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    step = 4 * LEVELS
    labels = trees.select("tree", F.expr(f"substring(sig, tree * {step} + 1, {step})").alias("label"), "key")
    labels = labels.repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    found = stored(neighbours(labels), "neighbours")
    crowded = found.where("b is null").select("region", F.col("a").alias("key"), "weight")
    central = crowded.groupBy("key").agg(F.sum("weight").alias("weight"))
    centre = crowded.select("region", "key").join(central, "key").groupBy("region").agg(F.max(F.struct("weight", "key")).alias("top"))
    centre = centre.select("region", F.col("top.key").alias("centre"))
    member = stored(crowded.select("region", "key").join(centre, "region").select("centre", "key").distinct(), "members")
    pairs = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.union(member.where("centre != key").select(F.least("key", "centre"), F.greatest("key", "centre"))).distinct()
    pairs = stored(pairs, "candidates")
    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    reads = nodes.join(wanted, nodes["key"] == wanted["a"], "left_semi").select(F.col("read").alias("need")).distinct()
    chosen = texts.join(bounded(reads, "reads"), F.col("read") == F.col("need"), "left_semi")
    sets = stored(full_sets(chosen, words).where("key is not null").groupBy("key").agg(F.first("items").alias("items")), "sets")
    x, y = sets.select(F.col("key").alias("a"), F.col("items").alias("x")), sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    links = pairs.join(x, "a").join(y, "b").where(similar(F.col("x"), F.col("y"), similarity)).select("a", "b")
    links = stored(links, "confirmed")
    linked = links.select("a", "b").union(links.select("b", "a")).select(F.col("a").alias("centre"), F.col("b").alias("key"), F.lit(True).alias("linked"))
    member = member.join(linked, ["centre", "key"], "left").select(
        F.col("centre").alias("region"), "key", (F.coalesce("linked", F.lit(False)) | (F.col("centre") == F.col("key"))).alias("linked"))
    member = stored(member, "explained")
    rest = leftovers(member, sets, similarity)
    reach = components(links.union(rest))
    named = nodes.select("key", "id").join(reach, nodes["key"] == reach["node"], "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    low = named.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = named.join(low, "root").select("key", "component_id")
    out = rows.select("id", "n_shingles", "key").join(classes, "key", "left")
    whole = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", whole.alias("component_id"), (F.col("key").isNull() | whole.eqNullSafe(F.col("id"))).alias("kept"))
