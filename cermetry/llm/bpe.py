"""Byte-pair encoding and decoding in batched numpy merge rounds.

The distinct words of a batch of texts become one flat array of symbols.  In
each round the ranks of all adjacent pairs are found by binary search over the
sorted pair keys, and every occurrence of each word's lowest-ranked pair is
merged.  Words without a mergeable pair leave the array.  Encoding is exact:
ids equal those of the tokenizer whose file is given.

Null and empty texts have no tokens.  Texts of any length are encoded whole;
a word of n symbols needs at most as many rounds as it uses distinct merges.
Only the named id and text columns are read, so further columns cannot clash.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from cermetry.llm.store import arrow_schema, pieces, with_id

OUT = "n_tokens long, ids binary, decoded string"
#: bytes that stand for themselves in a byte-level vocabulary; the others map to 256, 257, ... in byte order (fixed by the format)
VISIBLE = ((33, 126), (161, 172), (174, 255))


def byte_characters():
    """The character that stands for each byte in a byte-level vocabulary file."""
    own = {b for lo, hi in VISIBLE for b in range(lo, hi + 1)}
    chars, spare = {}, 256
    for b in range(256):
        if b in own:
            chars[b] = chr(b)
        else:
            chars[b], spare = chr(spare), spare + 1
    return chars


#: white space and separators beyond the six ASCII characters
RARE_SPACES = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class ByteBPE:
    """Encoder and decoder for one byte-level tokenizer file (JSON)."""

    #: ids and distinct chunks remembered between batches
    POOL, CHUNKS = 2_000_000, 150_000

    def __init__(self, path, pattern):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = byte_characters()
        back = {c: b for b, c in chars.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), *special.values(), 0) + 1 if special else max(vocab.values()) + 1
        text = [b""] * size
        for token, i in vocab.items():
            text[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            text[i] = token.encode()
        self.size = size
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.into = key[order], order.astype(np.int32), into
        self.lengths = np.array([len(t) for t in text], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.words = regex.compile(pattern)
        self.special = special
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.forget()

    def pair_ranks(self, symbols, owner, at):
        """Merge ranks of the pairs that begin at positions ``at``; pairs that
        have no merge, or reach into the next word, get the highest number."""
        ranks = np.full(len(at), len(self.keys), dtype=np.int32)
        inside = np.flatnonzero(at + 1 < len(symbols))
        left = at[inside]
        same = owner[left] == owner[left + 1]
        inside, left = inside[same], left[same]
        key = symbols[left].astype(np.int64) * self.size + symbols[left + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ranks[inside] = np.where(self.keys[found] == key, self.ranks[found], len(self.keys))
        return ranks

    def merge(self, words):
        """Ids of each word (bytes), as one flat array and the number per word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = np.int32(len(self.keys))
        rank = self.pair_ranks(symbols, owner, np.arange(len(symbols)))
        done_symbols, done_owner = [], []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(symbols))))
            active = best < none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, rank, best = symbols[active], owner[active], rank[active], best[active]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            # of overlapping hits (one symbol repeated) every second one counts, from the left
            run = np.append(True, np.diff(at) != 1)
            if not run.all():
                starts = np.flatnonzero(run)
                place = np.arange(len(at)) - starts[np.cumsum(run) - 1]
                at = at[place % 2 == 0]
            symbols[at] = self.into[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            around = np.concatenate((moved, moved[moved > 0] - 1))
            rank[around] = self.pair_ranks(symbols, owner, around)
        if done_symbols:
            symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        return symbols, np.bincount(owner, minlength=len(words))

    def lookup(self, chunks):
        """Where the ids of distinct chunks lie in the pool: starts and lengths.
        Chunks seen before are remembered, in bounded space."""
        if self.pool_used > self.POOL or len(self.known) > self.CHUNKS:
            self.forget()
        new = [c for c in chunks if c not in self.known]
        if new:
            words, marks = [], np.zeros(len(new), dtype=np.int64)
            for i, c in enumerate(new):
                found = self.words.findall(c)
                marks[i] = len(found)
                words += found
            coded = pa.array(words, type=pa.string()).dictionary_encode()
            flat, count = self.merge([w.encode() for w in coded.dictionary.to_pylist()])
            flat, count = expand(flat, np.cumsum(count) - count, count, coded.indices.to_numpy(), marks)
            self.known.update(zip(new, range(len(self.starts), len(self.starts) + len(new))))
            self.starts = np.concatenate((self.starts, self.pool_used + np.cumsum(count) - count))
            self.counts = np.concatenate((self.counts, count))
            self.pool = np.concatenate((self.pool[:self.pool_used], flat))
            self.pool_used += len(flat)
        slot = np.array([self.known[c] for c in chunks], dtype=np.int64)
        return self.starts[slot], self.counts[slot]

    def forget(self):
        """Start the memory anew, with the special strings, which stand for one id each."""
        self.known = {w: i for i, w in enumerate(self.special)}
        self.pool = np.array(list(self.special.values()), dtype=np.int32)
        self.pool_used = len(self.pool)
        self.starts, self.counts = np.arange(len(self.pool)), np.ones(len(self.pool), dtype=np.int64)

    def encode(self, texts):
        """Flat ids of all texts and the number of ids of each; None counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string())
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, RARE_SPACES)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        flat, counts = [], []
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(odd)) + 1):
            if not len(part):
                continue
            own = texts.slice(part[0], len(part))
            chunks, marks = self.odd_chunks(own) if odd[part[0]] else space_chunks(own)
            if len(chunks):
                coded = chunks.dictionary_encode()
                start, length = self.lookup(coded.dictionary.to_pylist())
                ids, count = expand(self.pool, start, length, coded.indices.to_numpy(), marks)
                flat.append(ids)
                counts.append(count)
            else:
                counts.append(marks)
        return np.concatenate([np.empty(0, dtype=np.int32), *flat]), np.concatenate([np.empty(0, dtype=np.int64), *counts])

    def odd_chunks(self, texts):
        """Words and special strings of texts in which white space is not plain or special strings occur."""
        words, marks = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts.to_pylist()):
            n = len(words)
            for part in self.split.split(text) if self.split is not None else [text]:
                words += [part] if part in self.special else self.words.findall(part)
            marks[i] = len(words) - n
        return pa.array(words, type=pa.string()), marks

    def decode_bytes(self, ids):
        """The bytes that a flat array of ids stands for."""
        return gather(self.bytes, self.offsets[ids], self.lengths[ids])


def gather(values, start, length):
    """The runs ``values[start:start+length]`` one after the other."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)))[:-1], length)
    return values[np.arange(total) + shift]


def expand(pool, start, length, code, marks):
    """The pool's runs for a sequence of codes, and how many values fall on each
    owner when the owners have ``marks`` codes each."""
    length = length[code]
    ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum(marks)]
    return gather(pool, start[code], length), np.diff(np.concatenate(([0], ends)))


def space_chunks(texts):
    """Texts cut where a word pattern of this kind always cuts: in front of the last
    white-space character of a run that a word follows, in front of each run, and
    after white space other than a blank.  Returns the chunks, as views into the
    texts' own bytes, and their number per text."""
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    if begin[-1] == begin[0]:
        return pa.array([], type=pa.string()), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin[0]:begin[-1]]
    begin = begin - begin[0]
    space = ((data >= 9) & (data <= 13)) | (data == 32)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begin] = True
    after = np.append(space[1:], True) | edge[1:]
    start = edge[:-1] | (space & ~after)
    before = np.append(True, space[:-1])
    start |= space & ~before
    start |= ~space & before & (np.append(np.uint8(0), data[:-1]) != 32)
    start = np.flatnonzero(start)
    cuts = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
    chunks = pa.StringArray.from_buffers(len(start), cuts, pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, np.diff(np.searchsorted(start, begin))


_LOADED = {}


def load(path, pattern):
    """One encoder per worker process and file."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def transcode(docs, path, pattern, id_col="doc_id", text_col="text", digests=False):
    """Encode and decode every text: ``id_col``, ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit integers) and ``decoded`` text; with ``digests`` the lowercase
    hex SHA-256 of both (``ids_sha256``, ``decoded_sha256``) in place of the values.

    One row per input row; null and empty texts give zero ids and empty text.
    ``path`` and ``pattern`` name the tokenizer file and its word pattern.
    """
    own = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else OUT
    schema = arrow_schema(own)

    def run(batches):
        bpe = load(path, pattern)
        for whole in batches:
            for batch in pieces(whole, 1):
                ids, count = bpe.encode(batch.column(1))
                raw = bpe.decode_bytes(ids)
                ends = np.cumsum(count)
                cuts = np.concatenate(([0], np.cumsum(bpe.lengths[ids])))[np.concatenate(([0], ends))]
                ids, raw = ids.astype("<u4"), raw.tobytes()
                coded = [ids[e - n:e].tobytes() for e, n in zip(ends, count)]
                decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
                if digests:
                    coded = [hashlib.sha256(x).hexdigest() for x in coded]
                    decoded = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                cols = [pa.array(v, type=f.type) for v, f in zip((count, coded, decoded), schema)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *schema.names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, with_id(source, own)).withColumnRenamed("id", id_col)


def decode(encoded, path, pattern, id_col="doc_id", ids_col="ids"):
    """Text of every row of stored ids (as ``transcode`` writes them); null gives empty text."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            text = [bpe.decode_bytes(np.frombuffer(x or b"", dtype="<u4").astype(np.int64)).tobytes().decode("utf-8", "replace")
                    for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, type=pa.string())], names=["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, with_id(source, "text string")).withColumnRenamed("id", id_col)
