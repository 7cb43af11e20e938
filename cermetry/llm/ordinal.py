"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds turn a
text's score s into P(grade <= k) = 1 / (1 + exp(s - threshold_k)).  The expected
grade and the tail probabilities P(grade >= k) serve for selection.

Features of a text, over its blank-separated tokens: presence of each word
(lower-cased, outer punctuation removed), and the share of each shape (letters
as a or A, digits as 0, runs as one sign, other signs as they are) and of
tokens that repeat the one before.  Weights are pulled to zero, so that rare
words do not add noise to long texts.

A null or blank text is not scored by the model: it has expected grade 0 and tail
probabilities 0.  Texts are read whole; repeated rows get the same result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from cermetry.llm.bpe import space_chunks
from cermetry.llm.store import bounded, pieces, stored, with_id

BITS = 16
SHAPE_WEIGHT = 8.0


def hashed(strings, salt):
    return np.array([xxhash.xxh32_intdigest(s, seed=salt) & ((1 << BITS) - 1) for s in strings], dtype=np.int64)


def features(texts):
    """Hashed features of a string array: row, bucket and value arrays, and the tokens per row."""
    chunks, marks = space_chunks(pc.fill_null(texts, ""))
    coded = chunks.dictionary_encode()
    token = pc.utf8_trim_whitespace(coded.dictionary)
    blank = pc.equal(token, "").to_numpy(zero_copy_only=False)
    shape = token
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    word = pc.replace_substring_regex(pc.utf8_lower(token), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    shapes = shape.dictionary_encode()
    shape_bucket = hashed(shapes.dictionary.to_pylist(), 1)[shapes.indices.to_numpy()]
    word_bucket = hashed(word.to_pylist(), 2)
    no_word = pc.equal(word, "").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), marks)
    solid = ~blank[code] if len(code) else np.empty(0, dtype=bool)
    code, row = code[solid], row[solid]
    tokens = np.bincount(row, minlength=len(texts))
    again = np.append(False, (code[1:] == code[:-1]) & (row[1:] == row[:-1])) if len(code) else np.empty(0, dtype=bool)
    share = SHAPE_WEIGHT / np.maximum(tokens, 1)
    pair, n = np.unique(row * (1 << BITS) + shape_bucket[code], return_counts=True)
    echo, times = np.unique(row[again], return_counts=True)
    named = ~no_word[code]
    seen = np.unique(row[named] * (1 << BITS) + word_bucket[code[named]])
    rows = np.concatenate((pair >> BITS, echo, seen >> BITS))
    buckets = np.concatenate((pair & ((1 << BITS) - 1), np.full(len(echo), hashed(["repeat"], 3)[0]), seen & ((1 << BITS) - 1)))
    values = np.concatenate((n * share[pair >> BITS], times * share[echo], np.ones(len(seen))))
    return rows.astype(np.int64), buckets.astype(np.int64), values, tokens


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def thresholds(free):
    """Ordered thresholds from unconstrained numbers."""
    return np.cumsum(np.append(free[:1], np.exp(free[1:])))


def loss_gradient(score, grade, free):
    """Negative log likelihood, its derivative by each score and by the free threshold numbers."""
    cut = thresholds(free)
    upper = np.append(cut, np.inf)[grade]
    lower = np.append(-np.inf, cut)[grade]
    hi, lo = np.where(np.isinf(upper), 1.0, sigmoid(upper - score)), np.where(np.isinf(lower), 0.0, sigmoid(lower - score))
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
    by_cut = np.zeros(len(cut))
    np.add.at(by_cut, grade[grade < len(cut)], -(d_hi / p)[grade < len(cut)])
    np.add.at(by_cut, grade[grade > 0] - 1, (d_lo / p)[grade > 0])
    by_free = np.array([by_cut.sum(), *(np.exp(free[k]) * by_cut[k:].sum() for k in range(1, len(free)))])
    return -np.log(p).sum(), (d_hi - d_lo) / p, by_free


def fit(docs, ratings, grades, bound=12_000, rounds=60, rate=0.5, sparsity=4e-4, id_col="doc_id", text_col="text"):
    """(weights, thresholds) from ``ratings`` (id, grade 0 .. ``grades`` - 1).

    About ``bound`` rated documents are used, chosen by a hash of the id; ids
    rated several times take their lowest grade.  Every round sums the
    gradient over the sample in Spark tasks; one vector per task reaches the
    driver, whatever the number of documents.  Without ratings all weights are zero.
    """
    spark = docs.sparkSession
    rated = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    rated = stored(rated, "ratings")
    n = rated.count()
    chosen = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, bound / max(n, 1)) * (1 << 30)).withColumnRenamed("id", "rated")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(bounded(chosen, "sample"), F.col("id") == F.col("rated")).select("grade", "text")

    def extract(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                row, bucket, value, tokens = features(batch.column(1))
                order = np.argsort(row, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(tokens))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket[order].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(value[order]))], names=["grade", "bucket", "value"])

    held = stored(sample.mapInArrow(extract, "grade int, bucket array<int>, value array<double>"), "features").coalesce(8)
    weight, free = np.zeros(1 << BITS), np.array([-1.0] + [0.0] * (grades - 2))
    scale, free_scale = np.full(1 << BITS, 1e-8), np.full(grades - 1, 1e-8)
    for _ in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast((weight, free))

        def gradient(batches):
            w, f = shared.value
            total, by_free, loss, rows = np.zeros(len(w)), np.zeros(len(f)), 0.0, 0
            for batch in batches:
                bucket, value = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
                score = np.bincount(row, w[bucket] * value, minlength=batch.num_rows)
                part, by_score, own = loss_gradient(score, batch.column(0).to_numpy(), f)
                total += np.bincount(bucket, by_score[row] * value, minlength=len(w))
                by_free, loss, rows = by_free + own, loss + part, rows + batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((total, by_free, [loss, rows])).tobytes()], type=pa.binary())], names=["sums"])

        sums = sum(np.frombuffer(r["sums"]) for r in held.mapInArrow(gradient, "sums binary").collect())
        shared.unpersist()
        rows = max(sums[-1], 1)
        step, free_step = sums[:1 << BITS] / rows, sums[1 << BITS:-2] / rows
        scale, free_scale = scale + step**2, free_scale + free_step**2
        pace = rate / np.sqrt(scale)
        weight = weight - pace * step
        weight = np.sign(weight) * np.maximum(np.abs(weight) - pace * sparsity, 0)
        free = free - rate * free_step / np.sqrt(free_scale)
    return weight, thresholds(free)


def grade(docs, model, id_col="doc_id", text_col="text"):
    """``id_col``, ``expected_grade`` and ``tails`` (P(grade >= 1), P(grade >= 2), ...) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = len(model[1])

    def run(batches):
        weight, cut = shared.value
        for whole in batches:
            for batch in pieces(whole, 1):
                row, bucket, value, tokens = features(batch.column(1))
                score = np.bincount(row, weight[bucket] * value, minlength=len(tokens))
                tails = sigmoid(score[:, None] - cut) * (tokens > 0)[:, None]
                ends = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(ends, pa.array(tails.ravel()))],
                                                 names=["id", "expected_grade", "tails"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, with_id(source, "expected_grade double, tails array<double>")).withColumnRenamed("id", id_col)
