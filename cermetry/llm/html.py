"""Main text of web pages, with site templates removed by recurrence.

Every page is read into a tree of elements; each block element gets a hash of its
whole subtree.  Spark counts, per host, the number of different pages around each
hash.  A subtree recurring on ``MIN_PAGES`` different pages of a host or more,
whatever the host's size, is that site's template and is deleted; copies of one
page count once.  What structure and naming give away (menus, footers, forms,
adverts, comments, ...) is left out too.

Article text is kept: what is the larger part of the text of one to three pages of a
host is no template there (a text that is the larger part of ``MIN_PAGES`` different
pages is).  Within ``article``, ``main`` or, on pages without them, the
innermost element that holds most of the text, only ``INNER`` containers are judged
by recurrence, never paragraphs, headings, lists, tables or quotations; and if
that left nothing but headings, the part stays whole.

Naming drops an element by whole class or id names: all pieces of a name must
be boilerplate or neutral words.  It drops nothing that holds an ``article``,
``main`` or most of the text around it; only reader comments go whatever they hold,
as long as there is an article besides.

The text is that of the ``article`` or ``main`` elements, or else the rest of the body.
A null, empty or markup-free page yields its own text (or none); markup errors
close elements as needed, and a tag without end is text.  Work grows with a
page's length, also for stray tags and deep nesting.  Repeated rows give
repeated results; only the id, url and html columns are read.
"""

import html
import re
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from cermetry.llm.store import pieces, stored
from cermetry.llm.urls import host_and_path

MIN_PAGES = 4
#: templates of all hosts that every worker holds as one sorted array; of more, each page gets its own by a join
MARKS = 2_000_000
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: elements that are judged by recurrence within the part that holds the article
INNER = frozenset("address center details div fieldset header hgroup section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: elements that never belong to the main text
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form frame frameset head iframe input map menu meter nav noembed noframes noscript "
                    "object optgroup option output progress script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: pieces of class and id names that mark the same parts
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer "
                  "form header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended "
                  "related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: pieces that mark what readers wrote
COMMENTS = frozenset("comment comments commentlist discussion disqus respond".split())
#: pieces that may stand beside those in one name
NEUTRAL = frozenset("a area articles bar block body bottom box button buttons by container content div element email for group here i icon icons id in inner item items js label left "
                    "line link links list lists list main media message messages meta mini module news no number outer page panel post posts primary reader readers reply right row secondary section site "
                    "slot small sticky stories strip sub template text thread title top unit up user users view wrap wrapper zone".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article main section div body html".split())
#: a tag ends at its ``>``; at a ``<`` outside quotes it is given up
INSIDE = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)\b{INSIDE}>.*?(?:</\1\s*>|\Z)"
                   rf"|<(/?)([a-z][^\s/<>]*)({INSIDE})>|<[!?/][^<>]*>", re.I | re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def digest(text):
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def boilerplate(names, words):
    """Whether one of the names is made of ``words`` and neutral words."""
    for name in names:
        pieces = [p for p in re.split(r"[^a-z]+", name) if p]
        if any(p in words for p in pieces) and all(p in words or p in NEUTRAL for p in pieces):
            return True
    return False


#: why an element may be left out
KEPT, STRUCTURE, NAMED, COMMENT = range(4)


def reason(tag, attributes, in_article):
    """What structure and naming tell about an element."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return STRUCTURE
    if not attributes.strip(" /"):
        return KEPT
    given = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", given.get("style", "").lower()):
        return STRUCTURE
    if tag in ("body", "html", "main"):
        return KEPT
    names = [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower() for n in f"{given.get('class', '')} {given.get('id', '')}".split()]
    if boilerplate(names, COMMENTS):
        return COMMENT
    return NAMED if boilerplate(names, NAMES - {"header"} if in_article else NAMES) else KEPT


class Page:
    """A page as a tree: per node its tag, parent, reason to leave it out and content
    (texts, None for a break between blocks, and the numbers of child nodes)."""

    def __init__(self, source):
        self.tags, self.parents, self.reasons, self.items = [""], [-1], [KEPT], [[]]
        self.articles = [0]  # article elements around a node, itself included
        self.stack, self.open_tags = [0], Counter()
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.items[self.stack[-1]].append(source[at:m.start()])
            at = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                self.close(tag)
            else:
                self.open(tag, m[4])
        if at < len(source):
            self.items[self.stack[-1]].append(source[at:])
        # texts with white space as single blanks, and how many other characters a node has of its own
        self.clean = [[" ".join(t.split()) if isinstance(t, str) else t for t in items] for items in self.items]
        self.own = [sum([len(t) - t.count(" ") for t in items if isinstance(t, str)]) for items in self.clean]

    def open(self, tag, attributes):
        if tag == "br":
            return self.items[self.stack[-1]].append(" ")
        if tag in BLOCKS:
            if tag not in ("option", "optgroup") and any(self.tags[n] == "p" for n in self.stack[-12:]):
                self.close("p")
            for other in CLOSES.get(tag, ()):
                self.close(other, SCOPES)
        parent = self.stack[-1]
        if tag in VOID:
            if tag in BLOCKS:
                self.items[parent].append(None)
            return
        node = len(self.tags)
        gone = self.reasons[parent] == STRUCTURE
        why = STRUCTURE if gone else reason(tag, attributes, self.articles[parent] > 0)
        self.tags.append(tag)
        self.parents.append(parent)
        self.reasons.append(why)
        self.items.append([])
        self.articles.append(self.articles[parent] + (why != STRUCTURE and tag in ("article", "main")))
        self.items[parent].append(node)
        self.stack.append(node)
        self.open_tags[tag] += 1

    def close(self, tag, scopes=frozenset(("table", "article", "main", "body", "html"))):
        """Close the nearest open element of this name; others opened since go with it."""
        if not self.open_tags[tag]:
            if tag in BLOCKS:
                self.items[self.stack[-1]].append(None)
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.tags[self.stack[i]]
            if name == tag:
                for n in self.stack[i:]:
                    self.open_tags[self.tags[n]] -= 1
                del self.stack[i:]
                return
            if name in scopes and tag not in ("article", "main", "body", "html"):
                return

    def sizes(self, gone):
        """Characters other than white space per node, without the nodes in ``gone`` and below."""
        out = list(self.own)
        for n in range(len(self.tags) - 1, -1, -1):
            if n in gone or self.reasons[n] == STRUCTURE:
                out[n] = 0
            elif n:
                out[self.parents[n]] += out[n]
        return out

    def around(self, test):
        """Per node whether it or a node above it passes."""
        out = []
        for n, parent in enumerate(self.parents):
            out.append(test(n) or (parent >= 0 and out[parent]))
        return out

    def named_out(self):
        """Nodes that naming leaves out."""
        marked = [n for n, why in enumerate(self.reasons) if why in (NAMED, COMMENT)]
        if not marked:
            return set()
        inside = self.around(lambda n: self.reasons[n] in (NAMED, COMMENT))
        size, rest = self.sizes(set()), self.sizes(set(marked))
        own = lambda n: self.tags[n] in ("article", "main") and self.reasons[n] != STRUCTURE
        free = any(own(n) and not inside[n] and rest[n] for n in range(len(self.tags)))
        holds = [False] * len(self.tags)
        for n in range(len(self.tags) - 1, 0, -1):
            holds[n] = holds[n] or own(n)
            holds[self.parents[n]] = holds[self.parents[n]] or holds[n]
        near = [-1] * len(self.tags)  # the nearest article above
        for n in range(1, len(self.tags)):
            near[n] = self.parents[n] if own(self.parents[n]) else near[self.parents[n]]
        out = set()
        for n in marked:
            most = 2 * size[n] > size[near[n]] if near[n] >= 0 else not free and 2 * size[n] > size[0]
            if self.reasons[n] == COMMENT and free or not holds[n] and not most:
                out.add(n)
        return out

    def settle(self):
        """Find what naming leaves out, and the part that holds the main text."""
        self.gone = self.named_out()
        self.size = self.sizes(self.gone)
        lost = self.around(lambda n: n in self.gone or self.reasons[n] == STRUCTURE)
        self.lost = lost
        mains = [n for n in range(len(self.tags)) if self.tags[n] in ("article", "main") and not lost[n]]
        self.whole = [n for n in mains if self.articles[n] == 1 and self.size[n]]
        if not self.whole:  # the innermost element that holds most of the text
            part = 0
            while True:
                larger = [c for c in self.items[part] if isinstance(c, int) and 2 * self.size[c] > self.size[0]]
                if not larger:
                    break
                part = larger[0]
            self.parts = [part]
        else:
            self.parts = self.whole
        self.total = sum(self.size[n] for n in self.whole) if self.whole else self.size[0]
        inner = set(self.parts)
        self.inner = self.around(lambda n: n in inner)
        return self

    def marks(self, salt):
        """{node: hash} of all elements that recurrence judges, and those that are most of the text."""
        self.settle()
        found, parts = {}, [None] * len(self.tags)
        parts_of = set(self.parts)
        for n in range(len(self.tags) - 1, 0, -1):
            body, whole = [], self.tags[n] not in ("article", "main") or self.reasons[n] == STRUCTURE
            for t in self.clean[n]:
                if isinstance(t, str):
                    body.append(t)
                elif t is not None:
                    whole = whole and parts[t] is not None
                    body.append(parts[t] or "")
            if not whole:  # is or holds an article
                continue
            text = "".join(body)
            mark = digest(f"{self.tags[n]}>{text}") ^ salt
            parts[n] = f"<{mark}>"
            kinds = INNER if self.inner[n] and n not in parts_of else BLOCKS
            if self.tags[n] in kinds and self.tags[n] not in ("body", "html") and self.size[n] and not self.lost[n]:
                found[n] = mark
        return found

    def large(self, n):
        """Whether a node is the larger part of the page's main text."""
        return 2 * self.size[n] > self.total

    def blocks(self, gone):
        """(text, within an article, heading) of all blocks without the nodes in ``gone``."""
        out, buffer = [], []
        frames = [(0, iter(self.items[0]), False)]

        def flush(node, heading):
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    out.append((text, self.articles[node] > 0, heading))

        while frames:
            node, items, heading = frames[-1]
            for t in items:
                if isinstance(t, str):
                    buffer.append(t)
                elif t is None:
                    flush(node, heading)
                else:
                    block = self.tags[t] in BLOCKS
                    if block:
                        flush(node, heading)
                    if t in gone or self.reasons[t] == STRUCTURE:
                        continue
                    frames.append((t, iter(self.items[t]), heading or self.tags[t] in HEADINGS))
                    break
            else:
                if self.tags[node] in BLOCKS or not node:
                    flush(node, heading)
                frames.pop()
        return out

    def main(self, gone=()):
        """Blocks of the main text without the nodes in ``gone``."""
        found = self.blocks(self.gone | set(gone))
        own = [x for x in found if x[1]] if self.whole else []
        return own or found

    def core(self):
        """Names what the page says: the texts of its main part, so that copies of one page count once."""
        kept = [n for n in range(len(self.tags)) if not self.lost[n] and (self.inner[n] or not self.whole)]
        return digest("\n".join(t for n in kept for t in self.clean[n] if isinstance(t, str)))


def text_blocks(source, templates, salt):
    """Blocks of a page without its templates; a part of which only headings would be left stays whole."""
    page = Page(source)
    if not len(templates):
        return [t for t, _, _ in page.settle().main()]
    hits = [n for n, mark in page.marks(salt).items() if mark in templates]
    if not hits:
        return [t for t, _, _ in page.main()]
    hit = set(hits)
    inside = [n for n in hits if page.inner[n] and n not in page.parts]
    found = page.main(hit)
    if inside and all(heading for _, _, heading in found):
        found = page.main(hit - set(inside))
    return [t for t, _, _ in found]


class Sorted:
    """Membership in a sorted array of 64-bit integers."""

    def __init__(self, raw):
        self.values = array("q", raw)

    def __len__(self):
        return len(self.values)

    def __contains__(self, mark):
        i = bisect_left(self.values, mark)
        return i < len(self.values) and self.values[i] == mark


def subtrees(pages):
    """(key, mark, core, large) of all subtrees of pages (key, host, html); marks differ between hosts."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 2):
                found = set()
                for key, host, source in zip(*(c.to_pylist() for c in batch.columns)):
                    page = Page(source)
                    marks = page.marks(digest(host))
                    core = page.core() if marks else 0
                    found.update((key, mark, core, page.large(n)) for n, mark in marks.items())
                cols = list(zip(*found)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=["key", "mark", "core", "large"])

    return pages.where("host != ''").mapInArrow(run, "key bigint, mark bigint, core bigint, large boolean")


def templates(pages, min_pages=MIN_PAGES):
    """(mark): subtree hashes that recur on their host, and are most of no page or of so many too.  ``pages``: (host, html)."""
    seen = subtrees(pages.select(F.lit(0).cast("long").alias("key"), "host", "html")).groupBy("mark", "core").agg(F.max("large").alias("large"))
    seen = seen.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count_if("large").alias("large"))
    return seen.where((F.col("n") >= min_pages) & ((F.col("large") == 0) | (F.col("large") >= min_pages))).select("mark")


def main_text(pages, id_col="page_id", url_col="url", html_col="html", min_pages=MIN_PAGES):
    """``id_col``, ``url_col`` and ``text`` of every page: its blocks in page order, joined by two line breaks."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_and_path(F.col("url").cast("string"))[0], F.lit("")))
    marks = stored(templates(rows.select("host", "html"), min_pages), "templates")
    few = marks.count() <= MARKS
    shared = pages.sparkSession.sparkContext.broadcast(np.sort(marks.toPandas()["mark"].to_numpy(dtype=np.int64)).tobytes() if few else b"")
    if few:
        rows = rows.withColumn("marks", F.lit(None).cast("array<bigint>"))
    else:  # pages of one content share their marks
        rows = rows.withColumn("key", F.xxhash64("host", "html"))
        own = subtrees(rows.select("key", "host", "html")).select("key", "mark").distinct().join(marks, "mark")
        rows = rows.join(own.groupBy("key").agg(F.collect_list("mark").alias("marks")), "key", "left")
    rows = rows.select("id", "url", "html", "host", "marks")

    def run(batches):
        known = Sorted(shared.value)
        for whole in batches:
            for batch in pieces(whole, 2):
                text = []
                for source, host, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                    text.append("\n\n".join(text_blocks(source, known if few else frozenset(own or ()), digest(host))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, type=pa.string())], names=["id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
