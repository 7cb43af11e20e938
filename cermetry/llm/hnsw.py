"""Near-duplicate embeddings by navigable small-world graphs.

Vectors are compared only under one label (and length).  Each label's distinct
vectors are dealt to shards of at most about ``SHARD``; every shard gets a
hierarchical navigable small-world graph, and every vector of the label
queries every shard.  A shard's beam starts at ``BEAM`` and doubles until an
audit against brute force finds ``AUDIT`` of the links of ``AUDITED`` of its vectors.
The beam is no cap on partners: a vector whose worst result in a full beam is
still linked may have more, and is compared with the whole shard.
Pairs found are verified by cosine in double precision and united to
components (every task passes on one link per vector and group at most).  Links
lie within components, so the number of links of each vector is then counted
exactly, block against block of its component.

Equal vectors are one node with a multiplicity.  Vectors that are null, zero,
or hold null or non-finite components, and those without a label, are linked
with nothing.  Rows that repeat an id are kept as rows; the class id is the
smallest non-null id reachable.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cermetry.llm.graph import components
from cermetry.llm.store import stored

SHARD, BATCH, LINKS, BUILD = 16_384, 256, 12, 48
BEAM, AUDITED, AUDIT = 24, 256, 0.99
BLOCK = 1024
ENTRIES = 8
#: numbers in a working array
CELLS = 2_000_000


def unit(vectors):
    """Rows scaled to length one in double precision (by their largest component first, so that nothing overflows)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, vectors):
        self.v = vectors
        n = len(vectors)
        rng = np.random.Generator(np.random.PCG64(n))
        level = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")  # upper layers first, so that every layer grows from its own nodes
        self.level = level
        self.layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = self.order[:ENTRIES]
        done = min(n, 2 * LINKS)
        self.connect(self.order[:done], [np.arange(0)] * len(self.layers))
        while done < n:
            new = self.order[done:done + min(BATCH, done)]
            self.insert(new)
            done += len(new)

    def insert(self, new):
        """Search the neighbours of a batch layer by layer, then link it in."""
        start = np.repeat(self.entry[None], len(new), axis=0)
        found = []
        for k in range(len(self.layers) - 1, -1, -1):
            ids, _ = self.search_layer(k, self.v[new], start, BUILD)
            start = np.where(ids[:, :ENTRIES] >= 0, ids[:, :ENTRIES], start[:, :1])
            found.append(ids)
        self.connect(new, found[::-1])

    def connect(self, new, found):
        among = self.v[new] @ self.v[new].T
        np.fill_diagonal(among, -2)
        for k in range(len(self.layers)):
            here = np.flatnonzero(self.level[new] >= k)
            if not len(here):
                break
            width = self.layers[k].shape[1]
            mates = among[np.ix_(here, here)]
            top = np.argsort(-mates, axis=1)[:, :min(LINKS, len(here) - 1)]
            ids = new[here][top].reshape(len(here), -1)
            if len(found[k]):
                ids = np.concatenate((ids, found[k][here]), axis=1)
            chosen = self.diverse(new[here], ids, LINKS)
            self.layers[k][new[here], :chosen.shape[1]] = chosen
            back, to = np.repeat(new[here], chosen.shape[1]), chosen.ravel()
            back, to = back[to >= 0], to[to >= 0]
            touched, count = np.unique(to, return_counts=True)
            if not len(touched):
                continue
            lists = np.full((len(touched), count.max()), -1, dtype=np.int32)
            sort = np.argsort(to, kind="stable")
            column = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
            lists[np.repeat(np.arange(len(touched)), count), column] = back[sort]
            both = np.concatenate((self.layers[k][touched], lists), axis=1)
            self.layers[k][touched] = -1
            kept = self.diverse(touched, both, width)
            self.layers[k][touched, :kept.shape[1]] = kept

    def diverse(self, nodes, ids, most):
        """Up to ``most`` of each node's candidates, nearest first; one that is nearer to a chosen
        one than to the node waits until the diverse ones are in."""
        step = max(1, CELLS // max(1, ids.shape[1] * self.v.shape[1]))
        if len(nodes) > step:
            return np.concatenate([self.diverse(nodes[i:i + step], ids[i:i + step], most) for i in range(0, len(nodes), step)])
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.v[ids], self.v[nodes]), -3)
        sims[ids == nodes[:, None]] = -3
        sort = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, sort, 1), np.take_along_axis(sims, sort, 1)
        repeated = np.zeros(ids.shape, dtype=bool)
        repeated[:, 1:] = (sims[:, 1:] == sims[:, :-1]) & (ids[:, 1:] == ids[:, :-1])
        valid = (sims > -3) & ~repeated
        closest = np.full(ids.shape, -3.0)  # similarity to the chosen ones so far
        chosen = np.zeros(ids.shape, dtype=bool)
        for j in range(min(ids.shape[1], 4 * most)):
            take = valid[:, j] & (closest[:, j] < sims[:, j]) & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            some = np.flatnonzero(take)
            if len(some):
                near = np.einsum("nkd,nd->nk", self.v[ids[some]], self.v[ids[some, j]])
                closest[some] = np.maximum(closest[some], near)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        sort = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(valid, sort, 1), np.take_along_axis(ids, sort, 1), -1)

    def search_layer(self, k, queries, start, beam):
        """The ``beam`` nearest nodes found from the given starts: ids (-1 where fewer) and similarities."""
        q = len(queries)
        seen = np.zeros((q, len(self.v)), dtype=bool)
        rows = np.arange(q)[:, None]
        fresh = np.ones(start.shape, dtype=bool)
        for j in range(1, start.shape[1]):
            fresh[:, j] = (start[:, :j] != start[:, j:j + 1]).all(axis=1)
        ids = np.where(fresh, start, -1)
        seen[rows, start] = True
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.v[ids], queries), -3)
        open_ = ids >= 0
        active = np.arange(q)
        while len(active):
            order = np.where(open_[active], sims[active], -4)
            pick = np.argsort(-order, axis=1)[:, :3]
            good = np.take_along_axis(order, pick, 1) > -3
            alive = good.any(axis=1)
            active, pick, good = active[alive], pick[alive], good[alive]
            if not len(active):
                break
            node = np.where(good, ids[active[:, None], pick], -1)
            open_[active[:, None], pick] = False
            near = np.where(node[:, :, None] >= 0, self.layers[k][node], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where((near >= 0) & ~seen[active[:, None], near], near, -1)
            at, column = np.nonzero(near >= 0)
            seen[active[at], near[at, column]] = True
            value = np.full(near.shape, -3.0)
            value[at, column] = np.einsum("nd,nd->n", self.v[near[at, column]], queries[active[at]])
            all_ids = np.concatenate((ids[active], near), axis=1)
            all_sims = np.concatenate((sims[active], value), axis=1)
            all_open = np.concatenate((open_[active], near >= 0), axis=1)
            width = min(beam, all_ids.shape[1])
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            if ids.shape[1] < width:
                grow = width - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-3.0)
                open_ = np.pad(open_, ((0, 0), (0, grow)))
            ids[active, :width] = np.take_along_axis(all_ids, best, 1)
            sims[active, :width] = np.take_along_axis(all_sims, best, 1)
            open_[active, :width] = np.take_along_axis(all_open, best, 1)
        sort = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, sort, 1), np.take_along_axis(sims, sort, 1)

    def search(self, queries, beam):
        start = np.repeat(self.entry[None], len(queries), axis=0)
        for k in range(len(self.layers) - 1, 0, -1):
            ids, _ = self.search_layer(k, queries, start, ENTRIES)
            start = np.where(ids >= 0, ids, start[:, :1])[:, :ENTRIES]
        return self.search_layer(0, queries, start, beam)

    def linked(self, queries, beam, cosine):
        """(row, node) arrays of the links found, whatever their number, in parts of bounded size."""
        ids, sims = self.search(queries, beam)
        full = np.zeros(len(queries), dtype=bool)
        if ids.shape[1] >= beam:
            full = (ids[:, beam - 1] >= 0) & (sims[:, beam - 1] >= cosine)
        row, column = np.nonzero((ids >= 0) & ~full[:, None])
        node = ids[row, column]
        good = np.einsum("nd,nd->n", queries[row], self.v[node]) >= cosine
        yield row[good], node[good]
        rest, step = np.flatnonzero(full), max(1, CELLS // len(self.v))
        for at in range(0, len(rest), step):
            row, node = np.nonzero(queries[rest[at:at + step]] @ self.v.T >= cosine)
            yield rest[at + row], node

    def audited_beam(self, cosine):
        """The beam with which ``linked`` finds ``AUDIT`` of all links of the audited vectors."""
        n = len(self.v)
        probe = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(int))
        links = (self.v[probe] @ self.v.T >= cosine).sum()
        beam = BEAM
        while beam < n and sum(len(row) for row, _ in self.linked(self.v[probe], beam, cosine)) < AUDIT * links:
            beam *= 2
        return beam

    def pack(self):
        head = np.array([len(self.v), self.v.shape[1], len(self.layers), len(self.entry)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.entry.astype(np.int64), self.v, *self.layers))

    @classmethod
    def unpack(cls, raw):
        g = cls.__new__(cls)
        n, d, layers, entries = np.frombuffer(raw, dtype=np.int64, count=4)
        at = 32
        g.entry = np.frombuffer(raw, dtype=np.int64, count=entries, offset=at)
        at += 8 * int(entries)
        g.v = np.frombuffer(raw, dtype=np.float64, count=n * d, offset=at).reshape(n, d)
        at += 8 * int(n * d)
        g.layers = []
        for k in range(layers):
            width = LINKS * (2 if k == 0 else 1)
            g.layers.append(np.frombuffer(raw, dtype=np.int32, count=n * width, offset=at).reshape(n, width))
            at += 4 * int(n) * width
        return g


def matrix(column):
    """A list cell of equally long float lists as a two-dimensional array."""
    flat = column.values.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column.values), -1)


def build(nodes, cosine):
    """(label, dim, shard, keys, vectors) rows -> the same shard's packed graph and audited beam."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                graph = Graph(unit(matrix(batch.column(4)[i])))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:4]), pa.array([graph.pack()], type=pa.large_binary()).cast(pa.binary()), pa.array([graph.audited_beam(cosine)])],
                                                 names=["label", "dim", "shard", "keys", "graph", "beam"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.mapInArrow(run, f"label {kind}, dim int, shard bigint, keys array<string>, graph binary, beam bigint")


def query_all(shards, cosine):
    """Links that join what is linked when every shard of a label is queried with the vectors of every shard of that label."""
    left = shards.select("label", "dim", F.col("keys").alias("from_keys"), F.col("graph").alias("from_graph"))
    pairs = left.join(shards, ["label", "dim"]).select("from_keys", "from_graph", "keys", "graph", "beam")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries = Graph.unpack(batch.column(1)[i].as_py()).v
                names = np.array(batch.column(0)[i].as_py() + batch.column(2)[i].as_py(), dtype=object)
                kinds, node = np.unique(names, return_inverse=True)
                graph, beam = Graph.unpack(batch.column(3)[i].as_py()), batch.column(4)[i].as_py()
                step = max(8, min(BATCH, BATCH * BEAM // beam))
                group = np.arange(len(kinds))
                for at in range(0, len(queries), step):
                    for row, to in graph.linked(queries[at:at + step], beam, cosine):
                        group = united(group, node[at + row], node[len(queries) + to])
                more = group != np.arange(len(group))
                yield pa.RecordBatch.from_arrays([pa.array(kinds[group[more]], type=pa.string()), pa.array(kinds[more], type=pa.string())], names=["a", "b"])

    return pairs.mapInArrow(run, "a string, b string")


def united(group, a, b):
    """The lowest node of each node's group after links between nodes ``a`` and ``b``."""
    while True:
        one, other = group[a], group[b]
        apart = one != other
        if not apart.any():
            return group
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        group = group.copy()
        np.minimum.at(group, np.maximum(one, other), np.minimum(one, other))
        while (group[group] != group).any():
            group = group[group]


def exact_links(members, cosine):
    """(key, linked): vectors linked with each node, counted with multiplicity.

    ``members``: (root, key, vector, times).  Components become blocks of about
    ``BLOCK`` nodes; each pair of blocks of a component is one matrix product.
    """
    size = members.groupBy("root").agg((F.count(F.lit(1)) / BLOCK + 1).cast("int").alias("blocks"))
    placed = members.join(size, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    packed = placed.groupBy("root", "block").agg(F.collect_list(F.struct("key", "vector", "times")).alias("rows"))
    packed = stored(packed, "blocks")
    pairs = packed.select("root", F.col("rows").alias("mine")).join(packed.select("root", "rows"), "root").select("mine", "rows")

    def run(batches):
        for batch in batches:
            keys, linked = [], []
            for i in range(batch.num_rows):
                (own, mine, _), (other, rows, times) = (
                    (c.values.field("key").to_pylist(), unit(flat(c.values.field("vector"))), c.values.field("times").to_numpy()) for c in (batch.column(0)[i], batch.column(1)[i]))
                hit = mine @ rows.T >= cosine
                same = {k: j for j, k in enumerate(other)}
                for j, k in enumerate(own):
                    if k in same:
                        hit[j, same[k]] = False
                keys += own
                linked += (hit @ times).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array(linked, type=pa.int64())], names=["key", "linked"])

    def flat(lists):
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

    return pairs.mapInArrow(run, "key string, linked bigint").groupBy("key").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors, cosine=0.98, id_col="vec_id", vector_col="embedding", label_col="label", shard=SHARD):
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    key = F.when(F.coalesce(valid, F.lit(False)), F.concat_ws("-", F.hex(F.xxhash64("label", "vector")), F.hex(F.xxhash64(F.lit(1), "vector", "label"))))
    rows = stored(rows.withColumn("key", key), "rows")
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    nodes = stored(nodes.withColumn("dim", F.size("vector")), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))
    packed = dealt.groupBy("label", "dim", "shard").agg(F.sort_array(F.collect_list(F.struct("key", "vector"))).alias("m"))
    packed = packed.select("label", "dim", "shard", F.col("m.key").alias("keys"), F.col("m.vector").alias("vectors"))
    index = stored(build(packed, cosine), "graphs")
    links = stored(query_all(index, cosine).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found")
    reach = stored(components(links), "components")
    members = nodes.join(reach, F.col("key") == F.col("node")).select("root", "key", "vector", "times")
    counts = exact_links(members, cosine)
    named = nodes.select("key", "id", "times").join(reach, F.col("key") == F.col("node"), "left").select("key", "id", "times", F.coalesce("root", "key").alias("root"))
    low = named.groupBy("root").agg(F.min("id").alias("component_id"))
    result = named.join(low, "root").join(counts, "key", "left").select("key", "component_id", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.select("id", "key").join(result, "key", "left")
    whole = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), whole.alias("component_id"),
                      (F.col("key").isNull() | whole.eqNullSafe(F.col("id"))).alias("kept"))
