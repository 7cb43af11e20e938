"""The corpus pipeline: quality, language, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept, and but for the last returns the columns of documents.  ``run`` writes
each stage to the shared folder and reads it again for the next.

Rows are told apart by id and text, so that null or repeated ids do no harm.
Empty tables pass through; null and empty texts are rejected by the first stage.
"""

from pyspark.sql import functions as F

from cermetry.llm import bpe, contain, forest, langid, ordinal, queries
from cermetry.llm.store import bounded, stored, table

#: languages are accepted at this probability
SURE = 0.5
#: and only up to so many times the usual cost (negative log probability) of a character in that language
FAR = 1.9


def whole_rows(docs):
    """The whole row as one column beside its text: no name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))


def quality(spark, docs, sf_dir):
    """Keeps documents whose probability of the top grade is ``queries.GOOD`` or more.  Without ratings all stay."""
    rated = queries.ratings(table(spark, sf_dir, "labels"))
    model = ordinal.fit(docs, rated, 3, bound=queries.RATED_ROWS)
    if not model[0].any():
        return docs
    return ordinal.grade(whole_rows(docs), model, id_col="row").where(F.col("tails")[1] >= queries.GOOD).select("row.*")


def language(spark, docs, sf_dir):
    """Keeps documents in which one of the known languages is recognised.

    The score compares the known languages with each other only; other languages
    and noise cost far more per character than a language's labelled texts.
    """
    model = langid.fit(docs, queries.PIECES, per_language=None)
    if not model[0]:
        return docs
    # judged once: the bounds come from all labelled rows, and all rows are held against them
    found = stored(langid.identify(whole_rows(docs), model, queries.PIECES, id_col="row"), "languages")
    usual = langid.usual_rates(found.withColumn("lang", F.col("row.lang")))
    bound = F.create_map(*[x for k in model[0] for x in (F.lit(k), F.lit(FAR * usual.get(k, float("-inf"))))])[F.col("lang_pred")]
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE) & (F.col("rate") >= bound)).select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group (five-word shingles, similarity 0.8); rows without an id come last."""
    content = F.xxhash64("text")
    parts = ("bare", "doc", "content")

    def name(doc_id):
        return F.struct(doc_id.isNull().alias("bare"), F.coalesce(doc_id, content).alias("doc"), content.alias("content"))

    found = stored(forest.near_duplicates(docs.select(name(F.col("doc_id")).alias("name"), "text"), id_col="name").select("name", "kept"), "kept")
    gone = bounded(found.where("not kept").select("name.*").distinct(), "gone")
    rows = whole_rows(docs).withColumn("name", name(F.col("row.doc_id"))).select("row", "name.*")
    rows = rows.join(gone, list(parts), "left_anti")
    # rows that repeat id and text: one of them stays, and only they are shuffled
    again = found.where("kept").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = bounded(again.select("name.*"), "again")
    single = rows.join(again, list(parts), "left_anti")
    several = rows.join(again, list(parts), "left_semi").groupBy(*parts).agg(F.first("row").alias("row"))
    return single.select("row.*").union(several.select("row.*"))


def decontamination(spark, docs, sf_dir):
    """Drops documents that contain a benchmark item (share 0.8 or more of its shingles)."""
    content = F.xxhash64("text")
    hits = contain.find(docs.select(content.alias("content"), "text"), table(spark, sf_dir, "benchmark"), id_col="content")
    hits = bounded(hits.select(F.col("content").alias("hit")).distinct(), "contaminated")
    rows = whole_rows(docs)
    return rows.join(hits, content == F.col("hit"), "left_anti").select("row.*")


def encode(spark, docs, sf_dir):
    """Token ids of every document (little-endian unsigned 32-bit integers) and the digests of ids and decoded text."""
    coded = bpe.transcode(docs, queries.TOKENIZER, queries.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("bpe", encode),
]

#: two stages are trained models, which SQL cannot express; see tests/llm
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
