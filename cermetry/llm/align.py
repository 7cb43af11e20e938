"""Alignment of two tokenizers' tokens of one text, by byte ranges.

Both tokenizers encode the whole text.  A place where a token of A and a token
of B both end, and both next tokens begin with a space, is an anchor; it is
taken from the tokens' own byte ends, never assumed.  Anchors cut a document
into windows of token ids.  A window's inner alignment depends on its ids only,
so it is computed once per distinct (A ids, B ids) and remembered.

A text whose joined token bytes of either side differ from a blank and the text
has no tokens, and so have null and empty texts: all numbers are zero.  Rows
are told apart by a number given when the first result is written, so null or
repeated ids do no harm; only the id and text columns are read.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import functions as F

from cermetry.llm.bpe import ByteBPE, gather
from cermetry.llm.store import arrow_schema, pieces, stored, with_id
from cermetry.llm.words import frequent_from

#: distinct windows that a worker remembers
WINDOWS = 300_000
#: pairs of ids whose counts every task holds; rarer ones are joined
HEAD = 500_000
SIDES = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
TYPES = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
_LOADED = {}


class Side:
    """One tokenizer: flat ids of whole texts, and the bytes of each id."""

    def keep(self, tokens):
        """The token bytes as one pool."""
        self.size = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.width = self.lengths.tolist()
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])


class ByteLevel(Side):
    """A byte-level tokenizer file; the text is encoded behind a blank, special strings as plain text."""

    def __init__(self, path, pattern):
        self.coder = ByteBPE(path, pattern)
        self.coder.special, self.coder.split = {}, None
        self.coder.forget()
        every = np.arange(self.coder.size)
        self.keep([self.coder.decode_bytes(every[i:i + 1]).tobytes() for i in every])

    def encode(self, texts):
        ids, count = self.coder.encode([" " + t for t in texts])
        return ids.astype(np.int64), count


class Pieces(Side):
    """A sentence-piece model, which puts a space in front by itself."""

    def __init__(self, path, _pattern=None):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode())
        self.keep(tokens)

    def encode(self, texts):
        rows = self.coder.encode(texts, num_threads=1)
        count = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(count.sum())), count


def load(kind, path, pattern=None):
    """One tokenizer per worker process and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path, pattern)
    return _LOADED[kind, path]


def cuts_of(counts):
    """List offsets of runs with these lengths."""
    return np.append(0, np.cumsum(counts)).astype(np.int32)


class Aligner:
    """Windows of two sides, remembered by their ids.

    All windows that a batch meets for the first time are solved together: laid one
    after the other they cover the same bytes on both sides, so overlaps and shared
    ends follow from the running byte ends.
    """

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.digits = pa.array([str(i) for i in range(max(left.size, right.size))], type=pa.string())
        self.forget()

    def forget(self):
        self.known = {}
        self.groups, self.width = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.start, self.pool = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.texts = pa.array([], type=pa.string())

    def solve(self, a, b, n_a, n_b):
        """Groups and links of windows with ``n_a`` and ``n_b`` ids each: number of groups, number
        of links, all links as id pairs, and the groups as text."""
        a_ends, b_ends = np.cumsum(self.left.lengths[a]), np.cumsum(self.right.lengths[b])
        a_start = a_ends - self.left.lengths[a]
        first, last = np.searchsorted(b_ends, a_start, side="right"), np.searchsorted(b_ends, a_ends, side="left")
        count = last - first + 1
        owner = np.repeat(np.arange(len(n_a)), n_a)
        pairs = np.repeat(a, count) * self.right.size + gather(b, first, count)
        links = np.bincount(owner, weights=count, minlength=len(n_a)).astype(np.int64)
        shared = np.flatnonzero(b_ends[last] == a_ends)
        groups = np.bincount(owner[shared], minlength=len(n_a))
        sides = [pc.binary_join(pa.ListArray.from_arrays(cuts_of(np.diff(np.append(-1, ends))), self.digits.take(pa.array(ids))), ",")
                 for ends, ids in ((shared, a), (last[shared], b))]
        text = pc.binary_join(pa.ListArray.from_arrays(cuts_of(groups), pc.binary_join_element_wise(*sides, "|")), ";")
        return groups, links, pairs, text

    def slots(self, keys):
        """Places of distinct windows (length of side A and the ids of both, as 32-bit integers) in the memory."""
        if len(self.known) > WINDOWS:
            self.forget()
        new = [k for k in keys if k not in self.known]
        if new:
            size = np.array([len(k) for k in new], dtype=np.int64) // 4
            flat = np.frombuffer(b"".join(new), dtype=np.int32).astype(np.int64)
            head = np.cumsum(size) - size
            n_a = flat[head]
            n_b = size - 1 - n_a
            groups, width, pairs, text = self.solve(gather(flat, head + 1, n_a), gather(flat, head + 1 + n_a, n_b), n_a, n_b)
            self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(width) - width))
            self.groups, self.width = np.concatenate((self.groups, groups)), np.concatenate((self.width, width))
            self.pool = np.concatenate((self.pool, pairs))
            self.texts = pa.concat_arrays([self.texts, text])
        return np.array([self.known[k] for k in keys], dtype=np.int64)

    def align(self, texts):
        """For texts (list of str): n_a, n_b, n_groups, n_links, groups, pairs and times, one list each."""
        a, n_a = self.left.encode(texts)
        b, n_b = self.right.encode(texts)
        want = [(" " + t).encode() if t else b"" for t in texts]
        good = self.same(self.left, a, n_a, want) & self.same(self.right, b, n_b, want)
        if not good.all():
            a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, n_a, 0), np.where(good, n_b, 0)
        if not len(a):
            none = [0] * len(texts)
            return none, none, none, none, [""] * len(texts), [[]] * len(texts), [[]] * len(texts)
        a_ends, b_ends = np.cumsum(self.left.lengths[a]), np.cumsum(self.right.lengths[b])
        # anchors: shared ends before tokens that begin with a space on both sides, and ends of texts
        at_b = np.searchsorted(b_ends, a_ends)
        at_a = np.flatnonzero(b_ends[at_b] == a_ends)
        at_b = at_b[at_a]
        final = np.zeros(len(a), dtype=bool)
        final[np.cumsum(n_a[n_a > 0]) - 1] = True
        next_a, next_b = a[np.minimum(at_a + 1, len(a) - 1)], b[np.minimum(at_b + 1, len(b) - 1)]
        anchor = final[at_a] | (self.left.spaced[next_a] & self.right.spaced[next_b])
        at_a, at_b = at_a[anchor] + 1, at_b[anchor] + 1
        from_a, from_b = np.append(0, at_a[:-1]), np.append(0, at_b[:-1])
        owner = np.searchsorted(np.cumsum(n_a), at_a)  # a text without tokens owns none
        # one key per window: its length on side A, then the ids of both
        w = np.stack((at_a - from_a, at_b - from_b), axis=1)
        total = w.sum(axis=1) + 1
        flat = np.empty(int(total.sum()), dtype=np.int32)
        head = np.cumsum(total) - total
        flat[head] = w[:, 0]
        inner = np.ones(len(flat), dtype=bool)
        inner[head] = False
        start = np.stack((from_a, from_b + len(a)), axis=1).ravel()
        flat[inner] = gather(np.concatenate((a, b)), start, w.ravel())
        keys = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(cuts_of(total) * 4), pa.py_buffer(flat)]).dictionary_encode()
        slot = self.slots(keys.dictionary.to_pylist())[keys.indices.to_numpy()]
        width = self.width[slot]
        sums = lambda x: np.bincount(owner, weights=x, minlength=len(texts)).astype(np.int64)
        lists = pa.ListArray.from_arrays(cuts_of(np.bincount(owner, minlength=len(texts))), self.texts.take(pa.array(slot)))
        # distinct pairs of each text, with their number
        span = self.left.size * self.right.size
        pairs = np.sort(gather(self.pool, self.start[slot], width) + np.repeat(owner * span, width))
        new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        times = np.diff(np.append(new, len(pairs))).astype(np.int32)
        text, pairs = np.divmod(pairs[new], span)
        cuts = cuts_of(np.bincount(text, minlength=len(texts)))
        return n_a, n_b, sums(self.groups[slot]), sums(width), pc.binary_join(lists, ";"), pa.ListArray.from_arrays(cuts, pairs), pa.ListArray.from_arrays(cuts, times)

    @staticmethod
    def same(side, ids, count, want):
        """Whether the joined token bytes of each text are the wanted ones."""
        raw = gather(side.pool, side.offsets[ids], side.lengths[ids]).tobytes() if len(ids) else b""
        ends = np.append(0, np.cumsum(side.lengths[ids]))[np.append(0, np.cumsum(count))]
        return np.array([raw[x:y] == t and t != b"" for x, y, t in zip(ends[:-1], ends[1:], want)], dtype=bool)


def tokens(docs, a_path, a_pattern, b_path, id_col="doc_id", text_col="text", digests=False):
    """Rows (``row``, ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``pairs``,
    ``times``), written to the shared folder.  ``groups`` are the aligned ids as text or, with
    ``digests``, their lowercase hex SHA-256; ``pairs`` are the distinct links
    (A id times B's vocabulary size, plus B id) and ``times`` their number."""

    def run(batches):
        aligner = Aligner(load(ByteLevel, a_path, a_pattern), load(Pieces, b_path))
        for whole in batches:
            for batch in pieces(whole, 1):
                cols = list(aligner.align([t or "" for t in batch.column(1).to_pylist()]))
                if digests:
                    cols[4] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in pa.array(cols[4], type=pa.string()).to_pylist()]
                cols = [c if isinstance(c, pa.Array) and c.type == t else pa.array(c, type=t) for c, t in zip(cols, TYPES)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *(x.split()[0] for x in SIDES.split(", "))])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(source.mapInArrow(run, with_id(source, SIDES)).withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned):
    """(pair, n): how many rows hold each pair; summed in tasks before the shuffle."""

    def run(batches):
        total = None
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            more = pa.table({"pair": found.field(0), "n": found.field(1)})
            total = more if total is None else pa.concat_tables([total, more]).group_by("pair").aggregate([("n", "sum")]).rename_columns(["pair", "n"])
            if len(total) > 1_000_000:
                yield from total.to_batches()
                total = None
        if total is not None:
            yield from total.to_batches()

    return stored(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def alignments(docs, a_path, a_pattern, b_path, id_col="doc_id", text_col="text", digests=False, head=HEAD):
    """The columns of ``tokens`` but pairs and times, and for every row ``n_best`` (links whose
    count is the highest of their A id) and ``count_sum`` (counts summed over links), where a
    pair's count is the number of rows of ``docs`` that link it.

    The best count per A id is one number per vocabulary entry.  The ``head`` most frequent
    pairs go to every task as sorted arrays; rarer pairs are exploded and joined.
    """
    aligned = tokens(docs, a_path, a_pattern, b_path, id_col, text_col, digests)
    size = load(Pieces, b_path).size
    counts = pair_counts(aligned)
    best = counts.groupBy(F.floor(F.col("pair") / size).alias("a")).agg(F.max("n").alias("top"))
    ranked = counts.join(F.broadcast(best), F.floor(F.col("pair") / size) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    low = frequent_from(counts, "n", head)
    known = ranked.where(F.col("n") >= low).orderBy("pair").toPandas()  # at most ``head`` rows
    key, number, top = known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)

    def run(batches):
        for batch in batches:
            pairs, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            width = pc.list_value_length(batch.column(1)).to_numpy()
            text = np.repeat(np.arange(len(width)), width)
            at = np.minimum(np.searchsorted(key, pairs), max(len(key) - 1, 0))
            here = key[at] == pairs if len(key) else np.zeros(len(pairs), dtype=bool)
            n = np.where(here, number[at], 0) * times if len(key) else np.zeros(len(pairs), dtype=np.int64)
            hit = np.where(here & top[at], times, 0) if len(key) else n
            sums = np.zeros((2, len(width)), dtype=np.int64)
            np.add.at(sums[0], text, hit)
            np.add.at(sums[1], text, n)
            cuts = np.append(0, np.cumsum(np.bincount(text[~here], minlength=len(width)))).astype(np.int32)
            rare = [pa.ListArray.from_arrays(cuts, pa.array(x[~here])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *rare], names=["row", "n_best", "count_sum", "rare", "often"])

    scored = aligned.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, rare array<long>, often array<long>")
    scored = stored(scored, "scored")
    left = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "often")).alias("x"))
    left = left.select("row", F.col("x.rare").alias("pair"), F.col("x.often").alias("times"))
    found = left.join(ranked.where(F.col("n") < low), "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    sums = scored.select("row", "n_best", "count_sum").unionByName(found).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
