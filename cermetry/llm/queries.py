"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from cermetry.llm import align, bpe, brown, contain, forest, hnsw, html, langid, licenses, ordinal, resample, tokencount, urls
from cermetry.llm.store import table
from cermetry.session import shared_dir

QUERIES, ORACLES = {}, {}

#: the tokenizer of the queries; its place is a parameter of every operator
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# ---- fixed values: license texts and notices that the license query looks for
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
             "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
             "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution. ")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission. ")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
             "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
             "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
             "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
             "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
             "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_TERMS = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
              "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
              "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
              "the following conditions")
_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
LICENSES = (
    ("AGPL-3.0", _GNU.format(what="program", name="Affero General Public License")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
                   "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                   "the specific language governing permissions and limitations under the License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("BSD-line", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", _GNU.format(what="program", name="General Public License")),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
            "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
            "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser General Public License")),
    ("MIT", _MIT_TERMS + ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
            "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT-line", "Released under the MIT License."),
    ("MIT-terms", _MIT_TERMS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
                "obtain one at http://mozilla.org/MPL/2.0/."),
)
# ---- end of fixed values
LANGUAGE_ROWS, RATED_ROWS = 1500, 12_000
#: documents whose probability of the top grade is lower are rejected
GOOD = 0.5
#: rules of the URL query: (host, path, verdict)
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_bpe")
def op1(spark, sf_dir):
    return bpe.transcode(table(spark, sf_dir, "documents"), TOKENIZER, PATTERN, digests=True)


def ratings(labels):
    """Graded ratings of the label table: 0 poor, 1 well written but toxic, 2 good."""
    return labels.select(F.col("doc_id").alias("id"), (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))


@query("op2_main_text")
def op2(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: links over all pairs that share a shingle, then the smallest id over them
CLASSES = """
, links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT id, id AS top FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.top = links.a),
low AS (SELECT id, min(top) AS component_id FROM reach GROUP BY id)
"""


@query("op3_near_duplicates", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id AS id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), nodes AS (SELECT id FROM sets),
items AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.id AS a, y.id AS b FROM items x JOIN items y ON x.g = y.g AND x.id < y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
)""" + CLASSES + """
SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM sets JOIN low USING (id)
""")
def op3(spark, sf_dir):
    return forest.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op4_decontamination", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM benchmark),
di AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d),
bi AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bi GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM di JOIN bi USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
""")
def op4(spark, sf_dir):
    return contain.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out), PIECES, per_language=LANGUAGE_ROWS, key=F.xxhash64("doc_id", "text"))
    return langid.identify(docs, model, PIECES).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def license_sql():
    """Exact containment of every template in the windows of its size class."""
    rows = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in LICENSES)
    return f"""
WITH t(license_id, text) AS (VALUES {rows}),
tw AS (SELECT license_id, regexp_extract_all(lower(text), '(\\pN+(?:\\.\\pN+)*|\\pL+)') AS w FROM t),
tc AS (SELECT *, (SELECT min(x) FROM (SELECT CAST(unnest([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128]) AS BIGINT) AS x) WHERE x >= len(w) - 2) AS width FROM tw),
ts AS (SELECT DISTINCT license_id, width, greatest(width // 4, 1) AS step, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM tc),
tl AS (SELECT license_id, count(*) AS n_template FROM ts GROUP BY license_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '(\\pN+(?:\\.\\pN+)*|\\pL+)') AS w FROM documents),
ds AS (SELECT doc_id, unnest(range(0, greatest(len(w) - 2, 0))) AS p, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM dw),
hits AS (SELECT doc_id, license_id, ds.g, p // step AS block, CASE WHEN step = 1 THEN width ELSE (width + step - 1) // step + 1 END AS blocks FROM ds JOIN ts ON ds.g = ts.g),
wins AS (SELECT doc_id, license_id, g, unnest(range(greatest(block - blocks + 1, 0), block + 1)) AS win FROM hits),
counts AS (SELECT doc_id, license_id, win, count(DISTINCT g) AS n FROM wins GROUP BY ALL),
best AS (SELECT doc_id, license_id, max(n) AS n_shared FROM counts GROUP BY ALL)
SELECT doc_id, license_id, n_shared, n_template, n_shared / n_template AS containment,
       row_number() OVER (PARTITION BY doc_id ORDER BY n_shared / n_template DESC, n_template DESC, license_id) = 1 AS named
FROM best JOIN tl USING (license_id) WHERE n_shared / n_template >= 0.8
"""


@query("op6_licenses", license_sql())
def op6(spark, sf_dir):
    templates = spark.createDataFrame(list(LICENSES), "license_id string, text string")
    return licenses.named(licenses.find(table(spark, sf_dir, "documents"), templates))


@query("op7_token_counts")
def op7(spark, sf_dir):
    # one lasting folder per tokenizer version: a second run encodes what is new only
    cache = tokencount.cache_path(shared_dir(spark, "x").rsplit("/", 1)[0], TOKENIZER, PATTERN)
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), cache, TOKENIZER, PATTERN)


@query("op8_quality")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ratings(table(spark, sf_dir, "labels")), 3, bound=RATED_ROWS)
    tails = F.col("tails")
    return ordinal.grade(docs, model).select("doc_id", "expected_grade", tails[0].alias("p_readable"), tails[1].alias("p_good"), (tails[1] >= GOOD).alias("keep"))


@query("op9_url_filter", f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES {", ".join(str(r) for r in URL_RULES)}
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (page_id)
""")
def op9(spark, sf_dir):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op10_embedding_duplicates", """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), nodes AS (SELECT id FROM v),
pairs AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id < y.id
  AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98)""" + CLASSES + """
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = low.id) AS n_links, component_id, id = component_id AS kept FROM low
""")
def op10(spark, sf_dir):
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_class_ngrams")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return brown.scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query("op12_resampling", """
WITH RECURSIVE
-- the 256 remainders of a byte under the reflected polynomial of CRC-32
t AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
      FROM (SELECT unnest(range(256)) AS b))),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, unnest(w) AS f FROM dw),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
v AS (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b)),
bytes AS (SELECT f, list_transform(range(1, strlen(f) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)) AS x FROM v),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, t),
s AS (SELECT bucket, count(*) AS n FROM d JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (f) GROUP BY bucket),
u AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS big_s, (SELECT coalesce(sum(n), 0) FROM g) AS big_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(g.n, 0) + 1) * (big_s + 10000) AS DOUBLE) / CAST((s.n + 1) * (big_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
         FROM s LEFT JOIN g USING (bucket), u),
sums AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM d JOIN k USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(n_features, 0) AS n_features,
             CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
             CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM dw LEFT JOIN sums USING (doc_id)),
sc AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
""")
def op12(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@query("op13_alignment")
def op13(spark, sf_dir):
    found = align.alignments(table(spark, sf_dir, "documents"), TOKENIZER, PATTERN, PIECES, digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")
