"""BPE, token counts, language, quality and HTML against libraries, enumeration and held-out rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cermetry.llm import bpe, html, langid, ordinal, queries, tokencount

SF = "/root/testdata/sf0.001"
PATH, PATTERN = queries.TOKENIZER, queries.PATTERN
ODD = [None, "", " ", "\n\n \t", "aaaaaaaaaaaaaaaaaa", "a<|endoftext|>b <|endoftext|>", "it's we'LL  x\u00a0y\u2003z", "日本語 😀😀 é", "x" * 5000, "word " * 3000, "\x1c a\x85b", "123 4,5.6!?"]


def same(text):
    return text or ""


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library_on_random_texts(library):
    rng = random.Random(3)
    signs = list(" \n\t  \r\x0b\x1f\x85\u00a0\u3000'aZ9é日😀.!,_-½") + ["'s", "'ll", "<|endoftext|>", "don't", "the "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(5000)] + [same(t) for t in ODD]
    flat, count = bpe.ByteBPE(PATH, PATTERN).encode(texts)
    ends = np.cumsum(count)
    for text, end, n, want in zip(texts, ends, count, library.encode_batch(texts, add_special_tokens=False)):
        assert flat[end - n:end].tolist() == want.ids, repr(text)


def test_transcode_and_decode_rows(spark, library):
    """Nulls, empty, long and repeated rows, clashing columns: one result per row."""
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.transcode(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() == len(rows)
    for r in got.where("doc_id is not null").collect():
        want = library.encode(same(ODD[r.doc_id]), add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False) == same(ODD[r.doc_id])
    back = {r.doc_id: r.text for r in bpe.decode(got, PATH, PATTERN).collect()}
    assert all(back[i] == same(t) for i, t in enumerate(ODD))
    digest = {r.doc_id: r for r in bpe.transcode(docs, PATH, PATTERN, digests=True).collect()}
    assert digest[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.transcode(docs.limit(0), PATH, PATTERN).count() == 0


def test_counts_come_from_the_cache(spark, library, tmp_path):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(99, ODD[4], 7), (4, ODD[4], 7), (None, "no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    want = sorted((i if i is not None else -1, len(same(t).encode()), len(library.encode(same(t), add_special_tokens=False).ids)) for i, t, _ in rows)
    for _ in range(2):
        got = tokencount.count_tokens(docs, cache, PATH, PATTERN).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({same(t) for _, t, _ in rows})
    # a stored count is believed: contents found in the cache are not encoded again
    version = tokencount.tokenizer_digest(PATH, PATTERN)
    other = str(tmp_path / "other")
    spark.createDataFrame([(bytearray(hashlib.sha256(b"known").digest()), version, 41)], tokencount.CACHE).write.parquet(other)
    few = spark.createDataFrame([(1, "known"), (2, "new")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(few, other, PATH, PATTERN).collect()} == {1: 41, 2: 1}
    assert tokencount.count_tokens(docs.limit(0), cache, PATH, PATTERN).count() == 0


def test_a_second_run_of_the_registered_counts_encodes_nothing(spark, library, monkeypatch):
    first = sorted(map(tuple, queries.QUERIES["op7_token_counts"](spark, SF).collect()))
    seen = []
    real = tokencount.encode_counts

    def counted(rows, path, pattern):
        seen.append(rows.count())
        return real(rows, path, pattern)

    monkeypatch.setattr(tokencount, "encode_counts", counted)
    assert sorted(map(tuple, queries.QUERIES["op7_token_counts"](spark, SF).collect())) == first and seen == [0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert first == sorted((r.doc_id, len(r.text.encode()), n := len(library.encode(r.text, add_special_tokens=False).ids), n > 512) for r in docs)


def test_compacted_counts_are_the_same(spark, tmp_path):
    rows = [(1, "a b"), (2, "c")]
    for r in rows:
        tokencount.count_tokens(spark.createDataFrame([r], "doc_id long, text string"), str(tmp_path / "c"), PATH, PATTERN).count()
    new = tokencount.compact(spark, str(tmp_path / "c"))
    same = lambda p: sorted(map(tuple, spark.read.parquet(p).select("n_tokens", "tokenizer").collect()))
    assert same(new) == same(str(tmp_path / "c")) and len(same(new)) == 2


def test_texts_of_marks_only_have_no_language(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "el gato negro", "es"), (3, "\u0301\u0302", None), (4, "1 \u0301", None), (5, "e\u0301t", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, queries.PIECES, per_language=10)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, queries.PIECES).collect()}
    assert got[3] == got[4] == ("und", 0.0) and got[5][0] != "und" and got[1][0] == "en"


def test_forward_sums_all_segmentations():
    vocab = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "c"]
    lattice = langid.Lattice(vocab)
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(vocab) + 4), size=2).T)

    def brute(word, k):
        def from_(i):
            if i == len(word):
                return 1.0
            total = 0.0
            for j in range(i + 1, len(word) + 1):
                piece = word[i:j]
                if piece in vocab:
                    total += np.exp(logp[vocab.index(piece), k]) * from_(j)
                elif j == i + 1:
                    total += np.exp(logp[len(vocab) + len(piece.encode()) - 1, k]) * from_(j)
            return total
        return np.log(from_(0))

    for word in ("a", "abab", "cab", "aéb", "日ab", "bbbbaaa"):
        got = langid.forward(lattice, [word], logp)[-1][0]
        assert np.allclose(got, [brute("▁" + word, k) for k in range(2)])
    # every place of every word is covered by exactly one piece of a segmentation
    for word in ("abab", "aéb"):
        uses = langid.expected(lattice, [word], np.array([2.0]), logp[:, :1])
        length = np.array([len(p) for p in vocab] + [1] * 4)
        assert (uses * length).sum() == pytest.approx(2 * (len(word) + 1))


def test_language_of_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_language"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(held) > 20
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([("en", "the house of the water"), ("fr", "la maison de le eau"), (None, "x"), ("en", None)], "lang string, text string")
    model = langid.fit(train, queries.PIECES)
    assert model[0] == ["en", "fr"]
    docs = spark.createDataFrame([(1, "the water", "fr"), (2, None, "fr"), (3, "12 ... 7", "fr"), (4, "la maison " * 5000, "en"), (None, "the", None), (1, "the water", "fr"), (6, "日" * 9000, "")],
                                 "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model, queries.PIECES).collect()]
    assert got[:6] == [(1, "en"), (2, "und"), (3, "und"), (4, "fr"), (None, "en"), (1, "en")] and got[6][1] in model[0]
    nothing = langid.fit(train.where("false"), queries.PIECES)
    assert {r.lang_pred for r in langid.identify(docs, nothing, queries.PIECES).collect()} == {"und"}


def test_likelihood_gradient():
    rng = np.random.default_rng(2)
    score, grade, free = rng.normal(size=40), rng.integers(0, 3, 40), np.array([-0.5, 0.3])
    _, by_score, by_free = ordinal.loss_gradient(score, grade, free)
    for i in range(2):
        step = np.eye(2)[i] * 1e-6
        diff = (ordinal.loss_gradient(score, grade, free + step)[0] - ordinal.loss_gradient(score, grade, free - step)[0]) / 2e-6
        assert diff == pytest.approx(by_free[i], rel=1e-4)
    step = np.eye(40)[7] * 1e-6
    diff = (ordinal.loss_gradient(score + step, grade, free)[0] - ordinal.loss_gradient(score - step, grade, free)[0]) / 2e-6
    assert diff == pytest.approx(by_score[7], rel=1e-4)


def test_quality_grades(spark):
    """Held-out grades, ordered tails, and rows that cannot be judged."""
    good, poor = "The water of the old house was cold, and we left.", "BUY!! NOW!! CHEAP!! WIN!!"
    toxic = "The water of the idiot house was cold, and we left."
    texts = [(i, [poor, toxic, good][i % 3] + f" w{i}") for i in range(240)]
    docs = spark.createDataFrame(texts + [(900, None), (901, "  \n"), (902, "z" * 200000), (None, good), (0, texts[0][1])], "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 3) for i in range(0, 240, 2)] + [(1, None), (None, 2)], "id long, grade int")
    model = ordinal.fit(docs, rated, 3, rounds=40, sparsity=1e-3)
    rows = ordinal.grade(docs.withColumn("tails", docs.text), model).collect()
    assert len(rows) == 245 and all(list(r.tails) == sorted(r.tails, reverse=True) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 2]
    assert np.mean([round(r.expected_grade) == r.doc_id % 3 for r in held]) > 0.95
    assert all(r.expected_grade == 0 for r in rows if r.doc_id in (900, 901))
    blank = ordinal.fit(docs, rated.where("false"), 3)
    assert not blank[0].any() and ordinal.grade(docs.limit(0), blank).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/x>Menu</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div><article><h1>A &amp; B</h1>
<p><b>One&nbsp; two<br>three<p>Four &#233; <i>five</i>.</p><!-- <p>no</p> --><div class="comments"><p>First!</p></div><form><p>Sign</p></form><aside>Side</aside></article>
<footer>&copy; x</footer></body></html>"""


def plain_blocks(source):
    return html.text_blocks(source, frozenset(), 0)


def page_texts(spark, pages):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_main_text_of_a_page():
    assert plain_blocks(PAGE) == ["A & B", "One two three", "Four é five."]
    assert plain_blocks("") == [] and plain_blocks("plain &lt; text") == ["plain < text"]
    assert plain_blocks("<p>a<div>b</p>c</div></section><li>d") == ["a", "b", "c", "d"]
    assert plain_blocks("<div>x<!-- open") == ["x"] and plain_blocks("a < b <") == ["a < b <"]


def test_lone_blocks_and_lists_of_articles_stay(spark):
    """Headings and a closing sentence that recur, and equal lists within articles, are text; notices still go."""
    notice = "<div class=x1><p>This site moves</p></div>"
    pages = [(i, f"http://a.org/{i}", f"<body>{notice}<div><h2>Introduction</h2><p>Story {i} of many words</p><h2>Conclusion</h2><p>That is all for now.</p></div></body>") for i in range(5)]
    recipe = "<article><h1>Dish {0}</h1><ul><li>Salt</li><li>Water</li></ul><table><tr><td>Serves 4</td></tr></table><p>Cook dish {0} slowly</p></article>"
    pages += [(100 + i, f"http://b.org/{i}", recipe.format(i)) for i in range(5)]
    text = page_texts(spark, pages)
    for i in range(5):
        assert text[i] == f"Introduction\n\nStory {i} of many words\n\nConclusion\n\nThat is all for now."
        assert text[100 + i] == f"Dish {i}\n\nSalt\n\nWater\n\nServes 4\n\nCook dish {i} slowly"


def test_posts_shown_on_listing_pages_stay(spark):
    posts = [f"<div class=entry><h2>Post {i}</h2><div><p>What post {i} says at length</p></div></div>" for i in range(7)]
    pages = [(i, f"http://a.org/{i}", f"<body><div><h1>Blog</h1>{p}</div></body>") for i, p in enumerate(posts)]
    pages += [(100 + i, f"http://a.org/page/{i}", f"<body><div><h1>Blog</h1>{''.join(posts[i:i + 4])}</div></body>") for i in range(4)]
    text = page_texts(spark, pages)
    said = lambda i: f"Post {i}\n\nWhat post {i} says at length"
    assert all(text[i].endswith(said(i)) for i in range(7))
    assert all(text[100 + i].endswith("\n\n".join(said(j) for j in range(i, i + 4))) for i in range(4))


@pytest.mark.parametrize("source, want", [
    ('<div id="page" class="site has-sidebar"><h1>T</h1><p>Long text here</p></div>', ["T", "Long text here"]),
    ('<article class="search-result"><p>Found it</p></article>', ["Found it"]),
    ('<article class="post related-content"><p>Body</p></article>', ["Body"]),
    ('<article><h1>Markets</h1><p class="share-price">The price of a share rose</p><section id="search-algorithms"><p>On search</p></section></article>', ["Markets", "The price of a share rose", "On search"]),
    ('<div class="search"><article><p>Only article</p></article></div>', ["Only article"]),
    ('<div class="widget"><p>Most of the text stands in here</p></div><p>Few</p>', ["Most of the text stands in here", "Few"]),
    # what the same words mark elsewhere
    ('<article><p>Text</p><div class="share-buttons">Share</div><div class="adBox">Buy</div><p class="notice">Old</p></article><div class="cookie-banner">Accept</div>', ["Text"]),
    ('<article><p>Short</p></article><section class="comments"><article class="comment"><p>A far longer remark of a reader</p></article></section>', ["Short"]),
    ('<p>A story without any article element</p><div class="reader-comments"><p>First</p></div>', ["A story without any article element"]),
    ('<div class="sidebar-left"><p>Links and more links than text</p></div><article><p>Brief</p></article>', ["Brief"]),
])
def test_names_drop_whole_names_only(source, want):
    assert plain_blocks(source) == want


@pytest.mark.parametrize("unit", ["</div>", "</i>", "<a ", "<div>", "<b>", "<script ", "<!", "<a \"", "<li><ul>", "<p><b>", "<td>", "</p>"])
def test_long_pages_of_broken_tags_take_seconds(unit):
    """A megabyte of stray, endless or deep tags is read in time that grows with its length."""
    import time

    start = time.time()
    got = plain_blocks("<p>Start</p>" + unit * (1_000_000 // len(unit)) + "<p>End of it</p>")
    assert time.time() - start < 30
    assert "".join(got).startswith("Start")


def test_site_templates_are_removed(spark):
    """Blocks that recur on a host's pages go, other hosts keep theirs; copies of one page count once."""
    frame = "<body><div><p>Welcome to our site</p></div><div><p>{}</p></div><div><p>Call us today</p></div></body>"
    pages = [(i, f"http://a.org/{i}", frame.format(f"Story number {i} about things")) for i in range(8)]
    pages += [(100 + i, f"http://b.org/{i}", frame.format("the same story")) for i in range(8)]
    pages += [(200, None, frame.format("x")), (201, "http://a.org/n", None), (202, "http://a.org/e", ""), (0, "http://a.org/0", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html.main_text(df.withColumn("marks", df.url).withColumn("host", df.url)).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"Story number {i} about things" for i in range(8))
    assert all(text[100 + i] == "Welcome to our site\n\nthe same story\n\nCall us today" for i in range(8))
    assert text[200].startswith("Welcome") and text[201] == text[202] == ""
    assert html.main_text(df.limit(0)).count() == 0


def test_templates_longer_than_the_stories(spark):
    """Two legal texts longer than every story go; eight copies of one page stay whole."""
    frame = "<body><div>" + "We value your privacy. " * 20 + "</div><p>{}</p><div>" + "All rights reserved. " * 30 + "</div></body>"
    pages = [(i, f"http://a.org/{i}", frame.format(f"Post {i}")) for i in range(8)] + [(100 + i, f"http://b.org/{i}", frame.format("Post")) for i in range(8)]
    text = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(text[i] == f"Post {i}" for i in range(8)) and all("privacy" in text[100 + i] and "rights" in text[100 + i] for i in range(8))


@pytest.mark.parametrize("marks", [html.MARKS, 0])
def test_templates_on_few_of_many_pages(spark, monkeypatch, marks):
    """The same six copies of a notice go from a host of 12 and of 60 pages; a block on three pages stays, as do other hosts' blocks."""
    monkeypatch.setattr(html, "MARKS", marks)
    notice, rare = "<div><p>Our shop moves in May</p></div>", "<div><p>Said thrice</p></div>"
    pages = [(100 * n + i, f"http://h{n}.org/{i}", f"<p>Story {i}</p>{notice if i < 6 else rare if i < 9 else ''}") for n in (12, 60) for i in range(n)]
    pages += [(i, "http://c.org/", f"<p>Story {i}</p>{notice}") for i in range(3)]
    text = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(text) == len(pages)
    for i, t in text.items():
        assert t == f"Story {i % 100}" + ("\n\nOur shop moves in May" if i < 100 else "\n\nSaid thrice" if 6 <= i % 100 < 9 else "")


def test_templates_within_articles(spark):
    """Promotions in main or article go; copies of one article, listed articles and lone paragraphs that recur stay."""
    promo = "<div class=x7><h3>Join us</h3><p>Ten letters a year</p></div>"
    pages = [(i, f"http://a.org/{i}", f"<main><h1>Title {i}</h1><div class=b><p>Story {i}</p><p>By the desk</p></div>{promo}</main>") for i in range(6)]
    pages += [(100 + i, f"http://b.org/{i}", f"<article><div><p>One story</p></div>{promo}</article>") for i in range(6)]
    listed = [f"<div class=post><h2>T{i}</h2><div><p>Post {i}</p></div></div>" for i in range(6)]
    pages += [(200 + i, f"http://c.org/{i}", f"<main>{listed[i]}</main>") for i in range(6)]
    pages += [(300 + i, f"http://c.org/l/{i}", f"<main>{''.join(listed[:i + 2])}</main>") for i in range(5)]
    pages += [(400 + i, f"http://d.org/{i}", f"<main><p>Lead {i}</p><article><p>Kept</p></article></main>") for i in range(6)]
    text = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert text[i] == f"Title {i}\n\nStory {i}\n\nBy the desk"
        assert text[100 + i] == "One story\n\nJoin us\n\nTen letters a year"
        assert text[200 + i] == f"T{i}\n\nPost {i}" and text[400 + i] == f"Lead {i}\n\nKept"


def test_main_text_of_given_pages(spark):
    """Against the articles cut out by patterns: these pages have one article of h1 and p each."""
    import re
    from html import unescape
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op2_main_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text.replace(" ", "") == "\n\n".join(b for b in blocks if b).replace(" ", "") and r.n_chars == len(r.text)
