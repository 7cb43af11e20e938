"""Near duplicates, containment, licenses, URLs, embeddings and components against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from cermetry.llm import contain, forest, graph, hnsw, licenses, queries, shingles, urls
from check import close, normal, ordered

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(4)
    links = {"path": [(i, i + 1) for i in range(70)], "star": [(500, i) for i in range(60)] + [(1, 1)], "empty": [],
             "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]}[kind]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    proper = [(a, b) for a, b in links if a != b]
    assert got == roots({x for p in proper for x in p}, proper)


def word_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def documents():
    """Edited copies of one text, exact copies, chains, a hot group, short and odd texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)] * 30
    for i in range(120):  # from nearly equal to clearly different
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(90)]
    for _ in range(12):  # each like the one before
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [None, "", "  \n", "One", "one", "ONE two", "one\ttwo", "É x", "é x", " ".join(base).upper(), "  ".join(base), "long " * 30000]
    return list(enumerate(texts))


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, n):
    rows = documents()
    df = spark.createDataFrame([(i, t, "x", False) for i, t in rows], "doc_id long, text string, key string, kept boolean").repartition(5)
    sets = {i: word_set(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r.doc_id: r for r in forest.near_duplicates(df, words=n).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (None, ""), (9, None)]
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == sorted([(-1, 7, False), (7, 7, True), (7, 7, True), (9, 9, True), (-1, -1, True), (9, 9, True)])
    assert forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_hashes_separate_sets():
    import pyarrow as pa
    rows = documents()
    hashed = shingles.shingle_sets(pa.array([t for _, t in rows], type=pa.string()), 4)
    plain = [word_set(t, 4) for _, t in rows]
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(0, len(rows), 7):
        for j in range(0, len(rows), 5):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def items_and_documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(30)] + [(30, None), (31, "..."), (5, None)]
    docs = []
    for i in range(80):
        words = [word() for _ in range(rng.choice([0, 5, 300]))]
        if i % 2 and items[i % 30][1]:
            inside = items[i % 30][1].split()
            if i % 3 == 0 and len(inside) > 20:
                inside[len(inside) // 2] = word()
            words[len(words) // 2:len(words) // 2] = [w.upper() + "," for w in inside]
        docs.append((i, " ".join(words)))
    return items, docs + [(80, None), (81, ""), (1, docs[1][1]), (None, docs[3][1])]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_containment(spark, threshold):
    items, docs = items_and_documents()
    own = lambda t, n: (lambda w: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)})(re.findall(r"[^\W_]+", (t or "").lower()))
    want = {}
    for i, t in items:
        n = min(5, len(re.findall(r"[^\W_]+", (t or ""))))
        for d, x in docs:
            if n and len(own(t, n) & own(x, n)) >= threshold * len(own(t, n)):
                want[d, i] = (len(own(t, n) & own(x, n)), len(own(t, n)))
    df = spark.createDataFrame([(d, x, 0) for d, x in docs], "doc_id long, text string, h int")
    got = contain.find(df, spark.createDataFrame(items, "item_id long, text string"), threshold).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got} == want and len(got) == len(want) > 20
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contain.find(df, nothing).count() == 0 and contain.find(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def template_shares(words, terms):
    """Containment of every template in the best stretch of a word list, by brute force."""
    out = {}
    cut = lambda ws: [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    own = cut(words)
    for name, text in terms.items():
        want = cut(plain_words(text))
        width = next(x for x in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256) if x >= len(want))
        step = max(width // 4, 1)
        span = width if step == 1 else (-(-width // step) + 1)
        best = max((len(set(own[b * step:(b + span) * step]) & set(want)) for b in range(len(own) // step + 1)), default=0)
        out[name] = best / len(set(want))
    return out


def plain_words(text):
    return re.findall(r"[0-9]+(?:\.[0-9]+)*|[a-z]+", text.lower())


def test_licenses(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))
    terms = dict(queries.LICENSES)
    docs = [(i, f"{noise(40)}\n{text}\n{noise(30)}") for i, text in enumerate(terms.values())]
    broken = terms["MIT-terms"].split()
    broken[20] = broken[50] = "changed"
    docs += [(30, " ".join(broken)), (31, terms["MIT-terms"].upper()), (32, None), (33, ""), (34, noise(500)), (0, docs[0][1]), (35, "Released under " + noise(300) + " the MIT License"), (36, noise(4) + " MIT"),
             (37, noise(20_000) + terms["ISC"])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, w int")
    got = licenses.named(licenses.find(frame, spark.createDataFrame([*queries.LICENSES, ("short", "klm MIT"), (None, "x"), ("none", None)], "license_id string, text string"))).collect()
    found = {(r.doc_id, r.license_id): r.containment for r in got}
    want = {(d, k): x for d, t in docs if t for k, x in template_shares(plain_words(t), terms).items() if x >= 0.8}
    assert len(got) == len(found) and found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)
    assert {k for d, k in found if d == 30} == {"MIT-terms"} and found[30, "MIT-terms"] < 1 == found[31, "MIT-terms"]
    # related licenses are told apart: each text names itself
    names = {r.doc_id: r.license_id for r in got if r.named}
    assert all(names[i] == k for i, k in enumerate(terms)) and names[37] == "ISC"
    assert (list(terms).index("BSD-2-Clause"), "BSD-3-Clause") in found
    assert licenses.find(spark.createDataFrame(docs[:2], "doc_id long, text string").limit(0), spark.createDataFrame(list(queries.LICENSES), "license_id string, text string")).count() == 0


def test_windows_with_one_change_share_a_band(spark):
    """Of windows that share three of four shingles 97 % or more meet in a band."""
    n = 20_000
    from pyspark.sql import functions as F
    cell = lambda k: F.xxhash64(F.col("id"), F.lit(k))
    windows = spark.range(n).select(F.array(*(cell(k) for k in range(4))).alias("a"), F.array(*(cell(k) for k in (0, 1, 2, 9))).alias("b"))
    for side in ("a", "b"):
        windows = windows.withColumn("hs", F.col(side)).withColumns({f"{side}{i}": F.expr(licenses.band(4, i))[0] for i in range(licenses.BANDS)}).drop("hs")
    same = F.lit(False)
    for i in range(licenses.BANDS):
        same |= F.col(f"a{i}") == F.col(f"b{i}")
    assert windows.where(same).count() >= 0.97 * n


def test_licenses_beyond_the_literal_bound(spark, monkeypatch):
    """The joined band table finds what the literals find."""
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))
    docs = [(i, f"{noise(20)} {text} {noise(20)}") for i, (_, text) in enumerate(queries.LICENSES)] + [(20, noise(90)), (21, None), (22, "two words"), (0, queries.LICENSES[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    templates = spark.createDataFrame([*queries.LICENSES, ("pair", "two words"), ("none", None)], "license_id string, text string")
    want = sorted(map(tuple, licenses.find(df, templates).collect()))
    monkeypatch.setattr(licenses, "MAX_BANDS", 10)
    assert sorted(map(tuple, licenses.find(df, templates).collect())) == want and len(want) >= 8


URLS = ["http://WWW.Example.com/en/x?q=/fr/#a", "https://a.example.com/en/", "http://example.com/EN/", "http://x.net/es/1", "http://net/fr/", "http://x.net/esp", "http://xnet/es/",
        "http://notexample.com/en/", "ftp://example.org/en/", "example.com/en/", None, "", "http://example.com", "http://example.com?x=/en/", "http://com/", "://net/fr/a://b", "http://a.www.example.com/en/z#/"]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, u, "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "y"), (None, URLS[1], "y")], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, verdict string")
    got = urls.judge(df, rules).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(URLS[r.page_id if r.page_id is not None else 1])
    host, path = urls.host_and_path(df.url)
    rows = df.select(df.page_id.alias("id"), host.alias("host"), path.alias("path"))
    joined = urls.joined(rows, rules.selectExpr("concat(host, path) as rule", "verdict"), "allow").collect()
    plain = lambda rs, c: sorted((getattr(r, c) if getattr(r, c) is not None else -1, r.host, r.path, r.rule or "", r.verdict) for r in rs)
    assert plain(joined, "id") == plain(got, "page_id")
    assert {r.verdict for r in urls.judge(df, rules.limit(0), default="block").collect()} == {"block"} and urls.judge(df.limit(0), rules).count() == 0


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    path = str(tmp_path / "rules.bin")
    rules = [(f"h{i}.org/" + "x" * (i % 3), ("allow", "block")[i % 2]) for i in range(40)]
    urls.DigestArray.write(path, rules)
    index = urls.DigestArray(path)
    found = index.find([r for r, _ in rules] + ["h1.org/none", ""])
    assert [(index.string(i), urls.VERDICTS[index.verdicts[i]]) for i in found[:40]] == rules and found[40:].tolist() == [-1, -1]


def brute_links(rows, cosine=0.98):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[n] = (np.array(v, dtype=np.float32).astype(float), label)
    return [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
            and ok[a][0] @ ok[b][0] / np.sqrt((ok[a][0] @ ok[a][0]) * (ok[b][0] @ ok[b][0])) >= cosine]


def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for k in range([3, 90][c == 0]):
            rows.append((centre + rng.normal(size=24) * 0.12 * (k > 0)).tolist())
    rows += [rows[0]] * 6 + [(3 * np.array(rows[1])).tolist()] + rng.normal(size=(300, 24)).tolist()
    rows = [(i, v, int(i % 7 == 0)) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, rows[0][1][:10]]
    return rows + [(900 + i, v, 0) for i, v in enumerate(odd)] + [(950, rows[0][1], None)]


@pytest.mark.parametrize("shard", [hnsw.SHARD, 100])
def test_embedding_duplicates(spark, shard):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    links = [(rows[a][0], rows[b][0]) for a, b in brute_links(rows)]
    want, degree = roots([r[0] for r in rows], links), {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard=shard).collect()}
    assert len(got) == len(rows)
    assert {i: (r.component_id, r.n_links, r.kept) for i, r in got.items()} == {i: (want[i], degree[i], want[i] == i) for i in want}
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_dense_groups_that_adjoin(spark):
    """Every vector has more partners than a beam in its own group, and the links to the other group are weaker."""
    rng = np.random.default_rng(12)
    base, off = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    rows = [(i, (base * np.cos(t) + off * np.sin(t) + rng.normal(size=64) * 0.007).tolist(), 0) for i, t in enumerate([0.0] * 40 + [0.12] * 40)]
    links = brute_links(rows)
    assert sum(a < 40 <= b for a, b in links) == 1600
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for shard in (hnsw.SHARD, 50):
        got = {r.vec_id: (r.component_id, r.n_links, r.kept) for r in hnsw.near_duplicates(df, shard=shard).collect()}
        assert got == {i: (0, 79, i == 0) for i in range(80)}
    g = hnsw.Graph(hnsw.unit(np.array([v for _, v, _ in rows])))
    assert sum(len(row) for row, _ in g.linked(g.v, hnsw.BEAM, 0.98)) == 6400


def test_graph_recall():
    """Recall of the nearest ten against brute force, on clustered and on uniform vectors."""
    rng = np.random.default_rng(10)
    for v in (rng.normal(size=(3000, 32)), rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] + 0.2 * rng.normal(size=(3000, 32))):
        g = hnsw.Graph(hnsw.unit(v))
        ids, sims = hnsw.Graph.unpack(g.pack()).search(g.v[:200], 64)
        best = np.argsort(-(g.v[:200] @ g.v.T), axis=1)[:, :10]
        assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, best)]) >= 0.9
        assert (np.diff(sims, axis=1) <= 0).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    got = ordered([tuple(normal(r[c]) for c in order) for r in df.collect()])
    want = ordered([tuple(normal(r[cols.index(c)]) for c in order) for r in res.fetchall()])
    assert len(got) == len(want) > 0
    assert all(close(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
