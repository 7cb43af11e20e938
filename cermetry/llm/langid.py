"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by a
forward pass; a text's is the product over all its words.  The probabilities
are fitted by expectation-maximisation, which counts each piece by its share in
all segmentations.

Words are maximal runs of letters and marks, lower-cased.  A character that is no
piece counts as its UTF-8 bytes at the smoothing probability.  A null text, or
one without letters, is ``und`` with score 0, and so is every text if nothing
was there to learn from.  Equal scores go to the language first in order.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cermetry.llm.bpe import space_chunks
from cermetry.llm.store import pieces, stored, with_id
from cermetry.operators.ordering import quantiles

START = "▁"
SMOOTHING = 0.1
BASE = np.uint64(1_000_003)
#: characters of words worked on at once, and words remembered by a worker
CELLS, WORDS = 60_000, 80_000
UNKNOWN = "und"


def vocabulary(model_file):
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def code_points(words):
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class Lattice:
    """Finds the vocabulary's pieces at all places of many words."""

    def __init__(self, vocab):
        self.size = len(vocab)
        by_length = {}
        for i, piece in enumerate(vocab):
            by_length.setdefault(len(piece), []).append(i)
        self.tables = {}
        for n, ids in sorted(by_length.items()):
            points = code_points([vocab[i] for i in ids]).reshape(len(ids), n)
            key = np.zeros(len(ids), dtype=np.uint64)
            for k in range(n):
                key = key * BASE + points[:, k]
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], np.array(ids, dtype=np.int64)[order]

    def hits(self, words):
        """(word, start, end, piece) of all pieces in words of one length, ordered by end, then word.
        Pieces ``size + b - 1`` stand for a character of b bytes that is no piece itself."""
        n = len(words[0]) + 1
        points = code_points([START + w for w in words]).reshape(len(words), n)
        found = []
        key = np.zeros_like(points)
        for length in range(1, min(n, max(self.tables, default=1)) + 1):
            places = n - length + 1
            key = key[:, :places] * BASE + points[:, length - 1:]
            row = at = piece = np.empty(0, dtype=np.int64)
            if length in self.tables:
                keys, ids = self.tables[length]
                flat = key.ravel()
                spot = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                hit = np.flatnonzero(keys[spot] == flat)
                row, at, piece = hit // places, hit % places, ids[spot[hit]]
            if length == 1:
                bare = np.ones((len(words), n), dtype=bool)
                bare[row, at] = False
                extra = np.nonzero(bare)
                size = np.searchsorted(np.array([0x80, 0x800, 0x10000]), points[extra], side="right")
                row, at, piece = np.concatenate((row, extra[0])), np.concatenate((at, extra[1])), np.concatenate((piece, self.size + size))
            found.append((row, at, at + length, piece))
        row, start, end, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((row, end))
        return row[order], start[order], end[order], piece[order], n

    def blocks(self, words):
        """Index arrays of words of one length, of at most ``CELLS`` characters (one word at least)."""
        length = np.array([len(w) for w in words])
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            step = max(1, CELLS // (int(length[part[0]]) + 1))
            for i in range(0, len(part), step):
                yield part[i:i + step]


def grouped_logsum(values, group):
    """Log of the summed exponentials of rows that lie together by ``group``."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    top = np.maximum.reduceat(values, first, axis=0)
    total = np.add.reduceat(np.exp(values - np.repeat(top, np.diff(np.append(first, len(group))), axis=0)), first, axis=0)
    return group[first], top + np.log(total)


def forward(lattice, words, logp, hits=None):
    """Log probability of each word of one length under each column of ``logp``."""
    row, start, end, piece, n = hits or lattice.hits(words)
    alpha = np.full((n + 1, len(words), logp.shape[1]), -np.inf)
    alpha[0] = 0
    cuts = np.searchsorted(end, np.arange(1, n + 2))
    for j in range(1, n + 1):
        s = slice(cuts[j - 1], cuts[j])
        if s.stop > s.start:
            to, value = grouped_logsum(alpha[start[s], row[s]] + logp[piece[s]], row[s])
            alpha[j, to] = value
    return alpha


def expected(lattice, words, weight, logp):
    """Expected number of uses of each piece (one language), words weighted."""
    total = np.zeros(lattice.size + 4)
    for block in lattice.blocks(words):
        own = [words[i] for i in block]
        hits = row, start, end, piece, n = lattice.hits(own)
        alpha = forward(lattice, own, logp, hits)[:, :, 0]
        beta = np.full((n + 1, len(own)), -np.inf)
        beta[n] = 0
        order = np.lexsort((row, start))
        cuts = np.searchsorted(start[order], np.arange(n + 1))
        for i in range(n - 1, -1, -1):
            o = order[cuts[i]:cuts[i + 1]]
            if len(o):
                to, value = grouped_logsum((beta[end[o], row[o]] + logp[piece[o], 0])[:, None], row[o])
                beta[i, to] = value[:, 0]
        share = np.exp(alpha[start, row] + logp[piece, 0] + beta[end, row] - alpha[n, row])
        total += np.bincount(piece, share * weight[block][row], minlength=len(total))
    return total


def word_arrays(texts):
    """Dictionary-coded words of a string array: distinct words, code of each word, words per text."""
    texts = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+", " ")
    chunks, marks = space_chunks(texts)
    coded = chunks.dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, " ")
    return words.to_pylist(), coded.indices.to_numpy(), marks


def probabilities(counts):
    """Smoothed log probabilities of one language's piece counts."""
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))


def sampled(rows, per_language, lang_col, text_col, key):
    """About ``per_language`` rows (lang, text) of each language, chosen by a hash (None: all rows), and the languages in order."""
    own = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), (key if key is not None else F.col(text_col)).alias("pick"))
    own = own.where("lang is not null and text is not null")
    share = {r["lang"]: (per_language or 0) / r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(share)
    if not langs or per_language is None:
        return own.select("lang", "text"), langs
    chance = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, share[k])))])[F.col("lang")]
    return own.where(F.pmod(F.xxhash64("pick"), F.lit(1 << 30)) < chance * F.lit(1 << 30)).select("lang", "text"), langs


def usual_rates(found, lang_col="lang"):
    """Exact median ``rate`` of each language over all rows of ``identify`` that are recognised as labelled."""
    right = found.where(F.col(lang_col).cast("string") == F.col("lang_pred")).select(F.col("lang_pred").alias("lang"), "rate")
    return {r["lang"]: r["quantile"] for r in quantiles(right, ["lang"], [0.5], "rate").collect()}


def fit(rows, model_file, rounds=3, per_language=1500, lang_col="lang", text_col="text", key=None):
    """Piece log probabilities per language: (languages in order, matrix).

    About ``per_language`` rows of each language (None: all) are used, chosen by a hash of
    ``key`` (default: the text; give one that differs between rows where texts
    may repeat very often); their whole texts count.  The model is the size
    of the vocabulary times the languages, whatever the input's size.
    """
    spark = rows.sparkSession
    sample, langs = sampled(rows, per_language, lang_col, text_col, key)
    vocab = vocabulary(model_file)
    if not langs:
        return [], np.zeros((len(vocab) + 4, 0))

    def count(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                words, code, marks = word_arrays(batch.column(1))
                lang = np.repeat(np.array([langs.index(x) for x in batch.column(0).to_pylist()]), marks)
                pair, n = np.unique(lang.astype(np.int64) * max(1, len(words)) + code, return_counts=True)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array([langs[p // len(words)] for p in pair]), pa.array([words[p % len(words)] for p in pair]), pa.array(n)],
                                                     names=["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n bigint").where("word != ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    logp = np.full((len(vocab) + 4, len(langs)), -np.log(len(vocab) + 4))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp)

        def uses(batches):
            lattice = lattice_of(model_file)
            total = np.zeros((len(langs), lattice.size + 4))
            for batch in batches:
                lang = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
                word, n = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for k in np.unique(lang):
                    own = np.flatnonzero(lang == k)
                    total[k] += expected(lattice, [word[i] for i in own], n[own], shared.value[:, k:k + 1])
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["lang", "piece", "uses"])

        found = words.mapInArrow(uses, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        counts = np.zeros_like(logp)
        counts[found["piece"], found["lang"]] = found["uses"]
        logp = np.stack([probabilities(counts[:, k]) for k in range(len(langs))], axis=1)
        shared.unpersist()
    return langs, logp


_LATTICES = {}


def lattice_of(model_file):
    if model_file not in _LATTICES:
        _LATTICES[model_file] = Lattice(vocabulary(model_file))
    return _LATTICES[model_file]


class Scorer:
    """Log probabilities of words, remembered in bounded space."""

    def __init__(self, model_file, logp):
        self.lattice, self.logp = lattice_of(model_file), logp
        self.known, self.table = {}, np.empty((0, logp.shape[1]))

    def words(self, words):
        if len(self.known) > WORDS:
            self.known, self.table = {}, self.table[:0]
        new = [w for w in words if w not in self.known]
        if new:
            value = np.zeros((len(new), self.logp.shape[1]))
            for block in self.lattice.blocks(new):
                if new[block[0]]:
                    value[block] = forward(self.lattice, [new[i] for i in block], self.logp)[-1]
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate((self.table, value))
        return self.table[[self.known[w] for w in words]] if words else self.table[:0]

    def texts(self, texts):
        """Log probability of each text under each language, and the length of its words (each with
        its start); a text without a letter, of combining marks only, has length 0."""
        words, code, marks = word_arrays(texts)
        value = self.words(words)
        real = np.array([len(w) + 1 if w else 0 for w in words], dtype=np.int64)
        total = np.concatenate((np.zeros((1, self.logp.shape[1])), np.cumsum(value[code], axis=0))) if len(code) else np.zeros((1, self.logp.shape[1]))
        number = np.concatenate(([0], np.cumsum(real[code]))) if len(code) else np.zeros(1, dtype=np.int64)
        spelled = pc.match_substring_regex(pa.array(words, type=pa.string()), r"\pL").to_numpy(zero_copy_only=False)
        spelled = np.concatenate(([0], np.cumsum(spelled[code]))) if len(code) else np.zeros(1, dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(marks)))
        length = np.where(spelled[ends[1:]] > spelled[ends[:-1]], number[ends[1:]] - number[ends[:-1]], 0)
        return total[ends[1:]] - total[ends[:-1]], length


def identify(docs, model, model_file, id_col="doc_id", text_col="text"):
    """``id_col``, ``lang_pred``, ``score`` (probability of that language given the whole text, all languages
    alike beforehand) and ``rate`` (log probability of the text in that language per character of its words)."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches):
        scorer = Scorer(model_file, shared.value)
        for whole in batches:
            for batch in pieces(whole, 1):
                total, length = scorer.texts(batch.column(1))
                any_word = length > 0
                rate = np.zeros(len(total))
                if langs:
                    rate = np.where(any_word, total.max(axis=1) / np.maximum(length, 1), 0.0)
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [langs[k] if w else UNKNOWN for k, w in zip(best, any_word)]
                    score = np.where(any_word, score, 0.0)
                else:
                    names, score = [UNKNOWN] * len(total), np.zeros(len(total))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string()), pa.array(score), pa.array(rate)], names=["id", "lang_pred", "score", "rate"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, with_id(source, "lang_pred string, score double, rate double")).withColumnRenamed("id", id_col)
