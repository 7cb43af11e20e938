"""Class n-grams, resampling and tokenizer alignment against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cermetry.llm import align, brown, queries, resample, words
from cermetry.llm.bpe import byte_characters
from cermetry.llm.store import table

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- words
def test_words_of_odd_texts():
    texts = [None, "", " ", "A b\tC", "É\x1cX\x0b\x0cy \r\n", "z" * 3000, " a b"]
    got, count = words.words_of(pa.array(["skip", *texts]).slice(1))
    want = [re.findall("[^\x20\x09-\x0d]+", lower(t)) for t in texts]
    assert got.to_pylist() == [w for ws in want for w in ws] and count.tolist() == [len(w) for w in want]


def test_frequent_from_bounds_the_list(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [7] * 9 + [5000, 5001, 123456]], "n long")
    assert [words.frequent_from(counts, "n", k) for k in (100, 12, 11, 3)] == [1, 7, 5000, 5000]
    assert words.frequent_from(counts, "n", 0) > 123456
    assert words.frequent_from(counts.limit(0), "n", 5) == 1


# ---------------------------------------------------------------- class n-grams
def token_lists(rows):
    return [re.findall("[^\x20\x09-\x0d]+", lower(t)) + [None] for t in rows]  # None is the end


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(5)
    n, k = 12, 4
    pairs = rng.integers(0, 6, size=(n, n))
    keys, counts = [], []
    for w in range(1, n):
        for v in range(n):
            for side, c in ((0, pairs[v, w]), (1, pairs[w, v])):
                if c:
                    keys.append(w * 2 * n + side * n + v)
                    counts.append(c)
    keys, counts = brown.merged(np.array(keys), np.array(counts))
    data = keys.tobytes() + counts.tobytes()
    classes = np.append(0, 1 + np.arange(n - 1) % (k - 1))

    def table_of(classes):
        out = np.zeros((k, k))
        for v in range(n):
            for w in range(n):
                if v or w:
                    out[classes[v], classes[w]] += pairs[v, w]
        return out

    assert np.array_equal(brown.class_bigrams(data, classes, n, k), table_of(classes))
    for turn in range(6):
        before = table_of(classes)
        moves = dict(brown.exchange(data, classes, before, n, k, turn, 1))
        # word by word, each move is the best of all classes for the exact likelihood
        now = classes.copy()
        for w in range(1, n):
            if (w + turn) % 2:
                continue
            tried = {}
            for c in range(1, k):
                other = now.copy()
                other[w] = c
                tried[c] = brown.objective(table_of(other))
            assert tried[moves.get(w, now[w])] >= max(tried.values()) - 1e-6
            now[w] = moves.get(w, now[w])
        assert brown.objective(table_of(now)) >= brown.objective(before) - 1e-9
        classes = now


def test_one_exchange_of_other_words():
    rng = np.random.default_rng(2)
    t = rng.integers(0, 30, size=(5, 5)).astype(float)
    group, slot, n = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 7, 0, 9]), np.array([2, 1, 3, 1, 1])
    got = brown.best_classes(group, slot, n, 3, t)
    for g in (0, 2):
        gains = []
        for c in range(1, 5):
            x = t.copy()
            for s, m in zip(slot[group == g], n[group == g]):
                if s < 5:
                    x[s, c] += m
                else:
                    x[c, s - 5] += m
            gains.append(brown.objective(x))
        assert got[g] == 1 + int(np.argmax(gains))
    assert got[1] == 1  # without neighbours nothing tells the classes apart


@pytest.fixture(scope="module")
def small_corpus(spark):
    rng = random.Random(7)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = []
    for i in range(300):
        text = " ".join(w for _ in range(rng.randint(1, 12)) for w in ("The", rng.choice(nouns), rng.choice(verbs)))
        rows.append((i, text + (f" rare{i}" if i % 3 == 0 else "") + (" x y z" if i % 50 == 0 else "") + (" odd1 odd2" if i in (7, 8) else ""), 1))
    rows += [(301, None, 1), (302, "", 1), (303, "\n \t", 1), (5, rows[5][1], 1), (None, "the n1 v1", 1), (304, "a " * 4000, 1), (305, "Ünbekannt n1", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score int")


@pytest.mark.parametrize("core, head", [(1000, 1000), (20, 40), (20, 20), (3, 5)])
def test_scores_against_a_dense_model(spark, small_corpus, core, head):
    """Counts, base and score of every row; head and core only decide where work is done,
    and which words take part in all rounds."""
    rows, docs = small_corpus
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    outs = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = brown.scores(docs, held, classes=6, core=core, head=head, rounds=4, parts=3).collect()
    lists = token_lists([r[1] for r in rows])
    learned = Counter(w for r, ws in zip(rows, lists) if not outs(r[0]) for w in ws)
    total, types = sum(learned.values()), len(learned)

    # the model's own classes, by the same steps
    source = docs.select(F.col("doc_id").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), "text")
    count = Counter({w: n for w, n in learned.items() if w is not None})
    low = words.frequent_from(spark.createDataFrame([(n,) for n in count.values()], "n long"), "n", head)
    top = sorted((w for w, n in count.items() if n >= low), key=lambda w: (-count[w], w))
    assert len(top) <= head
    coded = brown.coded_texts(source, top)
    n_core = min(core, len(top))
    own, bigrams = brown.core_classes(coded, n_core, len(top), 7, 4, 3)
    every = brown.head_classes(coded, own, bigrams, len(top), 3)
    rare = brown.rare_tokens(coded, every, n_core)
    assert rare.count() == sum(w is not None and w not in set(top) for ws in lists for w in ws)
    named = rare.select("row", "place", "word").join(brown.rare_classes(rare, bigrams), ["row", "place"]).select("word", "class", "n").distinct().collect()
    assert len(named) == len({r.word for r in named}) and all(r.n == count[r.word] for r in named)
    of = {None: 0, **{w: int(every[i + 1]) for i, w in enumerate(top)}, **{r.word: r["class"] % brown.ONCE for r in named if r.n}}
    assert len(of) == types

    # transition counts over whole training texts; a word seen once also counts as unknown
    k = 7
    N = np.zeros((k + 1, k + 1))
    for r, ws in zip(rows, lists):
        if outs(r[0]):
            continue
        before = [0]
        for w in ws:
            now = [of[w], *([k] if learned[w] == 1 else [])]
            for b in before:
                for c in now:
                    N[b, c] += 1
            before = now
    chance, size = brown.probabilities(N)
    assert np.allclose(chance.sum(axis=1), 1)
    for b in range(k + 1):  # over all known words and the unknown one
        assert chance[b, k] + sum(chance[b, of[w]] * learned[w] / size[of[w]] for w in of) == pytest.approx(1)

    want = []
    for r, ws in zip(rows, lists):
        base = sum(math.log10((learned[w] + 1) / (total + types + 1)) for w in ws)
        score, before = 0.0, 0
        for w in ws:
            now = of.get(w, k) if learned[w] else k
            score += math.log10(chance[before, now] * (learned[w] / size[now] if learned[w] else 1))
            before = now
        want.append((-1 if r[0] is None else r[0], outs(r[0]), len(ws), sum(learned[w] > 0 for w in ws), total, base, score))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [h[:5] for h in have] == [w[:5] for w in sorted(want)]
    assert np.allclose([h[5:] for h in have], [w[5:] for w in sorted(want)])


def test_classes_help_on_held_out_texts(spark, small_corpus):
    got = brown.scores(small_corpus[1], F.crc32(F.col("doc_id").cast("string")) % 7 == 2, classes=6).where("held_out").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)
    r = got[0]
    assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_empty_and_unlearned_corpora(spark, small_corpus):
    docs = small_corpus[1]
    assert brown.scores(docs.limit(0), F.lit(False)).count() == 0
    for r in brown.scores(docs, F.lit(True)).collect():  # nothing to learn from
        assert (r.n_known, r.train_tokens, r.base_score, r.score, r.perplexity) == (0, 0, 0.0, 0.0, 1.0)


def test_registered_class_ngrams(spark):
    got = queries.QUERIES["op11_class_ngrams"](spark, SF).collect()
    docs = table(spark, SF, "documents").collect()
    lists = {r.doc_id: ws for r, ws in zip(docs, token_lists([r.text for r in docs]))}
    outs = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in lists}
    learned = Counter(w for i, ws in lists.items() if not outs[i] for w in ws)
    total, types = sum(learned.values()), len(learned)
    assert len(got) == len(docs)
    for r in got:
        ws = lists[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (outs[r.doc_id], len(ws), sum(learned[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((learned[w] + 1) / (total + types + 1)) for w in ws))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# ---------------------------------------------------------------- resampling
def brute_features(text, n):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return ws, [" ".join(ws[i:i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize("n, buckets", [(1, 10_000), (3, 64)])
def test_resampling_against_brute_force(spark, n, buckets):
    rng = random.Random(4)
    vocabulary = ["Ab", "c1", "é", "dé-x", "日本", "_", "z", "Q", "\x7f", "word\x00s", "a b"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "  ", "word " * 30_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "some words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    target = spark.createDataFrame([("c1 z z",), ("日本 ab",), (None,)], "text string")
    raw, goal = [Counter(zlib.crc32(f.encode()) % buckets for t in ts for f in brute_features(t, n)[1]) for ts in ([r[1] for r in rows], ["c1 z z", "日本 ab"])]
    S, T = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets))))
    want, able = [], []
    for i, t, _ in rows:
        ws, features = brute_features(t, n)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in features) // len(features) if features else 0
        x = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))
        want.append((-1 if i is None else i, len(features), len(ws), weight, score))
        if len(ws) >= 20:
            able.append((-score, -1 if i is None else i))
    ranks = defaultdict(list)
    for place, (_, i) in enumerate(sorted(able)[:len(able) // 10]):
        ranks[i].append(place + 1)
    got = resample.resample(docs, target, n=n, buckets=buckets).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.n_words, r.weight, r.score) for r in got) == sorted(want)
    have = defaultdict(list)
    for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"]):
        have[r.doc_id].append(r["rank"])
    assert have == ranks


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs).count() == 0
    one = resample.resample(docs, docs.limit(0), percent=100).first()
    assert (one.n_features, one["rank"]) == (25, 1)


# ---------------------------------------------------------------- alignment
def brute_alignment(text, a_coder, b_coder, a_bytes, b_bytes):
    """(A ids, B ids, groups, links as id pairs); all empty without tokens."""
    want = (" " + text).encode() if text else b""
    a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
    b = b_coder.encode(text) if text else []
    x, y = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
    if not text or b"".join(x) != want or b"".join(y) != want:
        return [], [], "", []
    ends = lambda parts: [sum(map(len, parts[:i + 1])) for i in range(len(parts))]
    p, q = ends(x), ends(y)
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(p[i] - len(x[i]), q[j] - len(y[j])) < min(p[i], q[j])]
    groups, i, j = [], 0, 0
    for cut in sorted(set(p) & set(q)):
        m, n = p.index(cut) + 1, q.index(cut) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    return a, b, ";".join(groups), links


@pytest.mark.parametrize("head", [500_000, 40, 0])
def test_alignment_against_brute_force(spark, head):
    a_coder = Tokenizer.from_file(queries.TOKENIZER)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    back = {c: b for b, c in byte_characters().items()}
    a_bytes = lambda i: bytes(back[c] for c in a_coder.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()
    rng = random.Random(1)
    signs = list(" \n\t \r\x0b\x1f\x85 　'aZ9é日😀.!,_-½") + ["'s", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "the ", " Hello world", "ﬁ", " unbelievable"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", " ", "word " * 3000, "x" * 2000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "the world", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int")
    solved = [brute_alignment(t, a_coder, b_coder, a_bytes, b_bytes) for _, t, _ in rows]
    count = Counter(p for s in solved for p in set(s[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = sorted((-1 if i is None else i, len(a), len(b), g.count(";") + bool(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), g)
                  for (i, _, _), (a, b, g, links) in zip(rows, solved))
    got = align.alignments(docs, queries.TOKENIZER, queries.PATTERN, queries.PIECES, head=head)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got.collect()) == want
    assert sum(w[1] == 0 for w in want) > 3 and sum(w[1] > 0 for w in want) > 200
    if head:
        return
    digest = {r.doc_id: r.groups for r in align.alignments(docs, queries.TOKENIZER, queries.PATTERN, queries.PIECES, digests=True).collect()}
    assert all(digest[w[0]] == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want if w[0] >= 0)
    assert align.alignments(docs.limit(0), queries.TOKENIZER, queries.PATTERN, queries.PIECES).count() == 0


def test_windows_are_solved_by_ids_only():
    """Groups and links of two windows from lengths: tokens of 2, 1, 3 bytes against 1, 2, 3, then 1 against 1."""
    left, right = align.Side(), align.Side()
    left.keep([b"ab", b"c", b" de", b"x"])
    right.keep([b"a", b"bc", b" de", b"x"])
    found = align.Aligner(left, right).solve(np.array([0, 1, 2, 3]), np.array([0, 1, 2, 3]), np.array([3, 1]), np.array([3, 1]))
    assert found[0].tolist() == [2, 1] and found[1].tolist() == [4, 1] and found[3].to_pylist() == ["0,1|0,1;2|2", "3|3"]
    assert [divmod(p, 4) for p in found[2].tolist()] == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3)]


def test_windows_are_remembered():
    aligner = align.Aligner(align.load(align.ByteLevel, queries.TOKENIZER, queries.PATTERN), align.load(align.Pieces, queries.PIECES))
    first = aligner.align(["the cat sat", "the cat sat on the cat"])
    size = len(aligner.known)
    again = aligner.align(["on the cat the cat"])
    assert len(aligner.known) == size and again[2].tolist() == [5]
    aligner.forget()
    assert aligner.align(["the cat sat", "the cat sat on the cat"])[4].to_pylist() == first[4].to_pylist()


def test_registered_alignment(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_alignment"](spark, SF).collect()}
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for r in docs[:50]:
        assert got[r.doc_id].n_a == len(coder.encode(" " + r.text, add_special_tokens=False).ids)
        assert got[r.doc_id].n_groups <= min(got[r.doc_id].n_a, got[r.doc_id].n_b) <= got[r.doc_id].n_links
