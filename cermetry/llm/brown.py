"""Class-based bigram language model: words exchanged between classes, then scored.

P(w | v) = P(class of w | class of v) P(w | class of w).  Classes are found by
exchange: a word moves to the class that raises the likelihood of all training
bigrams most.  The ``core`` most frequent words are exchanged over several
rounds with their counts over the whole training text; every other word is
exchanged once, with its own counts over the whole training text, against the
core's classes.  All words have a class, however rare.

Where the work is: word counts are one aggregate.  The ``head`` most frequent
words (a bounded list) are known to every task, so their tokens never move;
the others' tokens are shuffled by word once, which counts them, finds their
class and hands both back to the documents.  Core bigrams are bounded by the
core's size squared and lie as one row per part of the core.

Tokens are words (runs without blanks and 0x09-0x0D, A-Z lower-cased) and one
end per document, which has a class of its own and also stands before the first
word.  Null and empty texts have the end only.  Words that training never saw
share one class; its chance after each class is that of words seen once
(leaving one out).  Without training documents every probability is one.
Rows are told apart by a number given when the coded texts are written, so null
or repeated ids do no harm; only the id and text columns are read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cermetry.llm.store import arrow_schema, pieces, stored, with_id
from cermetry.llm.words import add_counts, frequent_from, words_of

#: classes, words exchanged in rounds, words known to every task, rounds, parts of the core
CLASSES, CORE, HEAD, ROUNDS, PARTS = 64, 8_192, 200_000, 8, 32
#: longer words (bytes) are not in the head, whatever their number, so its size is bounded
LONGEST = 64
#: rare words' tokens whose classes are found at once
SOLVED = 20_000
#: pseudo counts of the transition matrix
ALPHA = 5.0
#: marks of a token: class of unknown words, and words seen once
UNKNOWN, ONCE = 127, 128


def h(x):
    """x log x."""
    return x * np.log(np.maximum(x, 1e-300))


# ---------------------------------------------------------------- counts and codes
def word_counts(texts):
    """(word, n) of a one-column frame of texts, summed in tasks first."""

    def run(batches):
        total = None
        for whole in batches:
            for batch in pieces(whole, 0):
                found = pc.value_counts(words_of(batch.column(0))[0])
                total = add_counts(total, found.field(0), found.field(1))
                if len(total) > 300_000:
                    yield from total.to_batches()
                    total = None
        if total is not None:
            yield from total.to_batches()

    return stored(texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def coded_texts(docs, head):
    """(id, held, codes, rare): 32-bit codes of all tokens of a text, 1, 2, ... for the
    head's words, 0 for the end and -1 for other words, which follow in ``rare``."""

    def run(batches):
        known = pa.array(head, type=pa.string())
        for whole in batches:
            for batch in pieces(whole, 2):
                words, count = words_of(batch.column(2))
                coded = words.dictionary_encode()
                at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -2).to_numpy().astype(np.int32) + 1
                code = at[coded.indices.to_numpy()] if len(words) else np.empty(0, dtype=np.int32)
                ends = np.cumsum(count)
                flat = np.insert(code, ends, 0).astype("<i4")
                cuts = np.append(0, ends + np.arange(1, len(count) + 1))
                owner = np.repeat(np.arange(len(count)), count)
                rare = code < 0
                listed = np.append(0, np.cumsum(np.bincount(owner[rare], minlength=len(count)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1),
                    pa.array([flat[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], type=pa.binary()),
                    pa.ListArray.from_arrays(listed, words.filter(pa.array(rare)))], names=["id", "held", "codes", "rare"])

    source = docs.select("id", "held", "text")
    coded = source.mapInArrow(run, with_id(source, "held boolean, codes binary, rare array<string>"))
    return stored(coded.withColumn("row", F.monotonically_increasing_id()), "coded")


def flat_codes(column, dtype="<i4"):
    """All codes of a binary column, and the number per row."""
    rows = column.to_pylist()
    count = np.array([len(r) for r in rows], dtype=np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(rows), dtype=dtype), count


# ---------------------------------------------------------------- neighbours of the head's words
def neighbours(coded, low, high, slot, width, parts):
    """(part, data): one row per part of the words with codes ``low`` to ``high`` (exclusive).

    ``slot`` gives each code's slot as a neighbour (below 0: none).  A word's slots are
    those of its left neighbours, then (from ``width`` on) those of its right ones.  Data
    are sorted 64-bit keys (word times 2 ``width``, plus slot) and their counts.
    """

    def run(batches):
        keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def packed():
            part = (keys // (2 * width)) % parts
            order = np.argsort(part, kind="stable")
            bound = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, keys[order[a:b]].tobytes() + counts[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(bound[:-1], bound[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.binary())], names=["part", "data"])

        for batch in batches:
            flat, _ = flat_codes(batch.column(0))
            left, right = np.append(0, flat[:-1]), flat  # every text ends with 0, which also opens the next
            found = []
            for word, near, side in ((right, left, 0), (left, right, 1)):
                s = slot[near]
                ok = (word >= low) & (word < high) & (s >= 0)
                found.append(word[ok].astype(np.int64) * (2 * width) + side * width + s[ok])
            new, n = np.unique(np.concatenate(found), return_counts=True)
            keys, counts = merged(np.concatenate((keys, new)), np.concatenate((counts, n)))
            if len(keys) > 2_000_000:
                yield packed()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield packed()

    packs = coded.where("not held").select("codes").mapInArrow(run, "part long, data binary")

    def join(pdf):
        pairs = [np.frombuffer(d, dtype=np.int64).reshape(2, -1) for d in pdf["data"]]
        keys, counts = merged(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "data": [keys.tobytes() + counts.tobytes()]})

    return stored(packs.groupBy("part").applyInPandas(join, "part long, data binary"), "neighbours")


def merged(keys, counts):
    """Sorted distinct keys with summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# ---------------------------------------------------------------- exchange
def class_bigrams(data, classes, width, k):
    """Class bigrams of the right neighbours of one part's words; the end's row comes
    from the words that follow it."""
    keys, counts = np.frombuffer(data, dtype=np.int64).reshape(2, -1)
    word, slot = keys // (2 * width), keys % (2 * width)
    right = slot >= width
    out = np.zeros((k, k))
    np.add.at(out, (classes[word[right]], classes[slot[right] - width]), counts[right])
    first = ~right & (slot == 0)
    np.add.at(out, (np.zeros(first.sum(), dtype=np.int64), classes[word[first]]), counts[first])
    return out


def exchange(data, classes, table, width, k, turn, parts):
    """Move a part's words one by one to the class of the largest likelihood gain.
    ``table`` are the class bigrams at the start.  Words of the other turn stay."""
    keys, counts = np.frombuffer(data, dtype=np.int64).reshape(2, -1)
    word, slot = keys // (2 * width), keys % (2 * width)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    classes, table = classes.copy(), table.copy()
    moved = []
    for a, b in zip(starts, np.append(starts[1:], len(word))):
        w = int(word[a])
        if (w // parts + turn) % 2:
            continue
        side, n = slot[a:b] >= width, counts[a:b].astype(float)
        near = slot[a:b] % width
        itself = n[(near == w) & side].sum()
        keep = near != w
        into = np.bincount(classes[near[keep & ~side]], weights=n[keep & ~side], minlength=k)
        out = np.bincount(classes[near[keep & side]], weights=n[keep & side], minlength=k)
        own = classes[w]
        table[:, own] -= into
        table[own, :] -= out
        table[own, own] -= itself
        old = h(table)
        gain = (h(table + into[:, None]) - old).sum(axis=0) + (h(table + out[None, :]) - old).sum(axis=1)
        d = np.arange(k)
        gain += h(table[d, d] + into + out + itself) - old[d, d] - (h(table[d, d] + into) - old[d, d]) - (h(table[d, d] + out) - old[d, d])
        # the neighbours' own sums do not depend on the class taken
        col, row = table.sum(axis=0) + out, table.sum(axis=1) + into
        gain -= h(col + into.sum() + itself) - h(col) + h(row + out.sum() + itself) - h(row)
        gain[0] = -np.inf  # the end's class takes no words
        new = int(np.argmax(gain)) if gain.max() > gain[own] + 1e-9 else own
        table[:, new] += into
        table[new, :] += out
        table[new, new] += itself
        classes[w] = new
        if new != own:
            moved.append((w, new))
    return moved


def objective(table):
    return float(h(table).sum() - h(table.sum(axis=0)).sum() - h(table.sum(axis=1)).sum())


def core_classes(coded, n_core, n_head, k, rounds, parts):
    """(classes of the codes 0 .. n_core, class bigrams) after the best round."""
    width = n_core + 1
    slot = np.full(n_head + 2, -1, dtype=np.int64)  # the last entry is that of code -1
    slot[:width] = np.arange(width)
    near = neighbours(coded, 1, width, slot, width, parts)
    classes = np.append(0, 1 + np.arange(n_core) % (k - 1))
    best = None

    def table_of(classes):
        def run(batches):
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([class_bigrams(data, classes, width, k).tobytes()], type=pa.binary())], names=["t"])

        rows = near.mapInArrow(run, "t binary").collect()  # one small matrix per part
        return sum((np.frombuffer(r.t).reshape(k, k) for r in rows), np.zeros((k, k)))

    for turn in range(rounds + 1):
        table = table_of(classes)
        score = objective(table)
        if best is None or score > best[0]:
            best = (score, classes.copy(), table)
        if turn == rounds:
            break
        now = classes

        def run(batches):
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    moves = exchange(data, now, table, width, k, turn, parts)
                    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moves], type=pa.int64()) for i in (0, 1)], names=["w", "c"])

        moves = near.mapInArrow(run, "w long, c long").collect()  # at most one row per core word
        classes = classes.copy()
        for w, c in moves:
            classes[w] = c
    return best[1], best[2]


def best_classes(group, slot, n, groups, table):
    """The class of the largest gain for each of ``groups`` words, from entries (group,
    slot, count), groups in order; slots are left classes, then right ones."""
    k = len(table)
    kinds, which = np.unique(np.stack((slot, n), axis=1), axis=0, return_inverse=True) if len(slot) else (np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64))
    base = np.concatenate((table, table.T))  # rows: the neighbour's class, columns: the word's
    rows = base[kinds[:, 0]]
    value = h(rows + kinds[:, 1:]) - h(rows)
    gain = np.zeros((groups, k))
    for lo in range(0, len(group), 200_000):  # bounded working arrays
        g = group[lo:lo + 200_000]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        gain[g[first]] += np.add.reduceat(value[which.ravel()[lo:lo + 200_000]], first)
    cells = np.bincount(group * (2 * k) + slot, weights=n, minlength=groups * 2 * k).reshape(groups, 2, k)
    left, right, d = cells[:, 0], cells[:, 1], np.diag(table)
    # neighbours of one class on both sides meet in one cell
    gain += h(d + left + right) - h(d + left) - h(d + right) + h(d)
    # the neighbours' own sums do not depend on the class taken
    for margin, new in ((table.sum(axis=0) + right, left), (table.sum(axis=1) + left, right)):
        gain -= h(margin + new.sum(axis=1, keepdims=True)) - h(margin)
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def head_classes(coded, classes, table, n_head, parts):
    """Classes of all codes 0 .. n_head: the core's, and one exchange for each other word."""
    k, n_core = len(table), len(classes) - 1
    out = np.zeros(n_head + 1, dtype=np.int64)
    out[:n_core + 1] = classes
    if n_head == n_core:
        return out
    slot = np.full(n_head + 2, -1, dtype=np.int64)
    slot[:n_core + 1] = classes
    near = neighbours(coded, n_core + 1, n_head + 1, slot, k, parts)

    def run(batches):
        for batch in batches:
            for data in batch.column(1).to_pylist():
                keys, counts = np.frombuffer(data, dtype=np.int64).reshape(2, -1)
                word, group = np.unique(keys // (2 * k), return_inverse=True)
                found = best_classes(group, keys % (2 * k), counts, len(word), table)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(found)], names=["w", "c"])

    out[n_core + 1:] = 1
    for w, c in near.mapInArrow(run, "w long, c long").collect():  # at most one row per word of the head
        out[w] = c
    return out


# ---------------------------------------------------------------- rare words
def rare_tokens(coded, classes, n_core):
    """(row, place, word, left, right, held) of all tokens outside the head; left and
    right are the neighbours' classes where those are core words, else -1."""
    schema = "row long, place int, word string, left int, right int, held boolean"
    of = np.full(len(classes) + 1, -1, dtype=np.int32)  # the last entry is that of code -1
    of[:n_core + 1] = classes[:n_core + 1]

    def run(batches):
        for batch in batches:
            flat, count = flat_codes(batch.column(2))
            owner = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            at = np.flatnonzero(flat < 0)
            near = of[flat]
            left = np.where(at > 0, near[at - 1], 0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner[at])), pa.array(place[at].astype(np.int32)), batch.column(3).flatten(),
                pa.array(left.astype(np.int32)), pa.array(near[at + 1].astype(np.int32)), batch.column(1).take(pa.array(owner[at]))],
                names=["row", "place", "word", "left", "right", "held"])

    return coded.select("row", "held", "codes", "rare").mapInArrow(run, schema)


def rare_classes(tokens, table):
    """(row, place, class, n) of the given tokens: n is the word's count in training.

    Rows come sorted by word, so that a word's tokens lie together; the last word
    of a block waits for the next one.
    """
    k = len(table)

    def solve(rows):
        words = rows.column("word").combine_chunks()
        ends = pc.run_end_encode(words).run_ends.to_numpy() if len(words) else np.empty(0, dtype=np.int64)
        group = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
        learned = ~rows.column("held").to_numpy()
        n = np.bincount(group[learned], minlength=len(ends))
        keys = []
        for name, shift in (("left", 0), ("right", k)):
            c = rows.column(name).to_numpy()
            ok = learned & (c >= 0)
            keys.append(group[ok].astype(np.int64) * (2 * k) + c[ok] + shift)
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        found = best_classes(key // (2 * k), key % (2 * k), times, len(ends), table)
        found = np.where(n == 0, UNKNOWN, np.where(n == 1, found + ONCE, found))
        return pa.RecordBatch.from_arrays([
            rows.column("row").combine_chunks(), rows.column("place").combine_chunks(),
            pa.array(found[group].astype(np.int32)), pa.array(n[group])], names=["row", "place", "class", "n"])

    def run(batches):
        held, size, limit = [], 0, SOLVED
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                rows = pa.Table.from_batches(held)
                ends = pc.run_end_encode(rows.column("word").combine_chunks()).run_ends
                cut = ends[len(ends) - 2].as_py() if len(ends) > 1 else 0
                if cut:
                    yield solve(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), len(rows) - cut
                limit = max(SOLVED, 2 * size)
        if size:
            yield solve(pa.Table.from_batches(held))

    return tokens.repartition("word").sortWithinPartitions("word").mapInArrow(run, "row long, place int, class int, n long")


# ---------------------------------------------------------------- documents
def classed_texts(coded, found, classes, counts, total, types):
    """(id, held, classes, n_known, base, words): one byte per token, its class with the mark
    of words seen once; base is the add-one unigram score, ``words`` the sum of the
    logarithms of the counts of known words."""
    listed = found.groupBy("row").agg(F.collect_list(F.struct("place", "class", "n")).alias("found"))
    mark = np.where(counts == 1, classes + ONCE, classes).astype(np.uint8)
    fall = np.log10(total + types + 1.0)
    schema = "held boolean, classes binary, n_known long, base double, words double"

    def run(batches):
        for batch in batches:
            flat, count = flat_codes(batch.column(2))
            start = np.cumsum(count) - count
            cls = mark[flat]
            n = counts[flat]  # code -1 reads the last entry, which is replaced below
            lists = batch.column(3)
            owner = np.repeat(np.arange(len(count)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            rare = lists.flatten()
            at = start[owner] + rare.field("place").to_numpy()
            cls[at] = rare.field("class").to_numpy().astype(np.uint8)
            n[at] = rare.field("n").to_numpy()
            base = np.add.reduceat(np.log10(n + 1.0) - fall, start) if len(start) else np.empty(0)
            words = np.add.reduceat(np.log10(np.maximum(n, 1)), start) if len(start) else np.empty(0)
            known = np.add.reduceat((n > 0).astype(np.int64), start) if len(start) else np.empty(0, dtype=np.int64)
            raw = cls.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([raw[s:s + c] for s, c in zip(start, count)], type=pa.binary()),
                pa.array(known), pa.array(base), pa.array(words)], names=["id", "held", "classes", "n_known", "base", "words"])

    joined = coded.select("row", "id", "held", "codes").join(listed, "row", "left").select("id", "held", "codes", "found")
    return stored(joined.mapInArrow(run, with_id(joined, schema)), "classed")


def transitions(classed, k):
    """Counts of (class before, class) over the training texts; the last row and column
    are those of words seen once, which stand for unknown ones.  Such words count in
    their own class too."""
    size = k + 1

    def run(batches):
        total = np.zeros((size, size), dtype=np.int64)
        for batch in batches:
            flat, _ = flat_codes(batch.column(0), "u1")
            once = flat >= ONCE
            now = np.where(once, flat - ONCE, flat).astype(np.int64)
            before, before_once = np.append(0, now[:-1]), np.append(False, once[:-1])
            for rows, cols in ((before, now), (np.where(before_once, k, -1), now), (before, np.where(once, k, -1)),
                               (np.where(before_once, k, -1), np.where(once, k, -1))):
                ok = (rows >= 0) & (cols >= 0)
                total += np.bincount(rows[ok] * size + cols[ok], minlength=size * size).reshape(size, size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], schema=arrow_schema("cell long, n long"))

    rows = classed.where("not held").select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
    out = np.zeros(size * size)
    for cell, n in rows:
        out[cell] = n
    return out.reshape(size, size)


def probabilities(counts):
    """Transition probabilities with the unknown class last, and each class's size.

    ``counts`` as from ``transitions``.  A known class c after b has
    (1 - u) (N(b, c) + ALPHA q(c)) / (N(b) + ALPHA), with q the classes' shares; u, the
    chance of an unknown word, is (N(b, once) + ALPHA r) / (N(b) + ALPHA), r its overall
    chance.  Rows sum to one.
    """
    k = len(counts) - 1
    size = counts[:k, :k].sum(axis=0)
    total = size.sum()
    if not total:
        return np.ones((k + 1, k + 1)), size
    before = counts[:, :k].sum(axis=1)
    r = (counts[:k, k].sum() + 1) / (total + 2)
    unknown = (counts[:, k] + ALPHA * r) / (before + ALPHA)
    known = (counts[:, :k] + ALPHA * size / total) / (before + ALPHA)[:, None]
    return np.concatenate(((1 - unknown)[:, None] * known, unknown[:, None]), axis=1), size


def score_texts(classed, counts):
    """id, held, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10) of every row."""
    chance, size = probabilities(counts)
    k = len(size)
    step = np.log10(np.maximum(chance, 1e-300))
    step[:, :k] -= np.log10(np.maximum(size, 1))  # a word's share of its class; the words' own counts are summed already
    schema = "held boolean, n_tokens long, n_known long, base_score double, score double"

    def run(batches):
        for batch in batches:
            flat, count = flat_codes(batch.column(2), "u1")
            start = np.cumsum(count) - count
            now = np.where(flat == UNKNOWN, k, np.where(flat >= ONCE, flat - ONCE, flat)).astype(np.int64)
            before = np.append(0, now[:-1])
            sums = np.add.reduceat(step[before, now], start) if len(start) else np.empty(0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(count), batch.column(3), batch.column(4),
                pa.array(sums + batch.column(5).to_numpy())], names=["id", "held", "n_tokens", "n_known", "base_score", "score"])

    source = classed.select("id", "held", "classes", "n_known", "base", "words")
    return source.mapInArrow(run, with_id(source, schema))


def scores(docs, held, id_col="doc_id", text_col="text", classes=CLASSES, core=CORE, head=HEAD, rounds=ROUNDS, parts=PARTS):
    """Fit on the rows for which ``held`` (a boolean column) is not true, score all rows.

    Returns id, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training has),
    ``train_tokens``, ``base_score`` (add-one unigrams), ``score`` (this model), both
    log10 probabilities of the whole text, and ``perplexity`` per token.
    """
    k = classes + 1  # with the end's
    assert k < UNKNOWN
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    learned = source.where("not held")
    words = word_counts(learned.select("text"))
    ends = learned.count()
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = total + ends, types + (ends > 0)
    low = frequent_from(words, "n", head)
    top = words.where((F.col("n") >= low) & (F.octet_length("word") <= LONGEST)).collect()  # at most ``head`` short words
    top = sorted(top, key=lambda r: (-r.n, r.word))
    counts = np.array([ends, *(r.n for r in top), 0], dtype=np.int64)  # the last entry is that of code -1
    coded = coded_texts(source, [r.word for r in top])
    n_core = min(core, len(top))
    own, table = core_classes(coded, n_core, len(top), k, rounds, parts)
    every = head_classes(coded, own, table, len(top), parts)
    found = rare_classes(rare_tokens(coded, every, n_core), table)
    classed = classed_texts(coded, found, np.append(every, 0), counts, total, types)
    out = score_texts(classed, transitions(classed, k))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      "base_score", "score", perplexity.alias("perplexity"))
