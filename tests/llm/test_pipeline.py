"""The corpus pipeline against what each stage must do to planted rows."""

import re

import corpus_pipeline as cp
from cermetry.llm import queries


def rows_of(spark, extra=()):
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return good, list(extra)


def write(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tmp_path):
    """Poor and toxic texts, wordless texts, copies and benchmark passages go; clean documents stay; rows without ids or repeated rows do no harm."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    clean = base.join(labels.where("quality = 1 and coalesce(toxic, 0) = 0"), "doc_id").where("n_chars between 600 and 2500").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    item = bench.orderBy("item_id").first().text
    one = next(r for r in clean if not any(b.text in r.text for b in bench.collect()))
    planted = [(10**6, one.text), (10**6 + 1, one.text + " Thend."), (10**6 + 2, one.text[:500] + " " + item + " " + one.text[500:][::-1]), (10**6 + 3, None), (10**6 + 4, ""),
               (10**6 + 5, "123 456 ..."), (None, one.text), (one.doc_id, one.text)]
    more = spark.createDataFrame([(i, t, "en", "new", len(t or "")) for i, t in planted], base.schema)
    folder = write(spark, str(tmp_path), base.union(more), labels, bench)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = cp.stored(out, name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    known = {r.doc_id: r for r in labels.collect()}
    poor = [i for i, r in known.items() if r.quality == 0]
    fine = [i for i, r in known.items() if r.quality == 1 and not r.toxic]
    first = set(kept["quality"])
    assert sum(i in first for i in poor) <= 0.05 * len(poor) and sum(i in first for i in fine) >= 0.97 * len(fine)
    assert not {10**6 + 3, 10**6 + 4} & first and 10**6 + 5 not in kept["language"]
    assert len([i for i in kept["language"] if i in fine]) >= 0.97 * len(fine)
    group = [i for i in kept["near_duplicates"] if i in (one.doc_id, 10**6, 10**6 + 1, None)]
    assert len(group) == 1 and (group[0] == one.doc_id)
    assert 10**6 + 2 not in kept["decontamination"]
    text = {r.doc_id: r.text for r in base.collect()}
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [words(b.text) for b in bench.collect() if len(b.text.split()) >= 5]
    assert not any(i in words(text[d]) for d in kept["decontamination"] if d in text for i in items)
    gone = set(kept["near_duplicates"]) - set(kept["decontamination"])
    assert all(d == 10**6 + 2 or any(i in words(text[d]) for i in items) for d in gone)
    assert sorted(kept["bpe"]) == sorted(kept["decontamination"]) and docs.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_unlearned_languages_and_noise(spark):
    """Texts in languages without labelled rows and letter noise go; the given documents stay."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = ["La casa era fredda e la notte scendeva sulla valle mentre gli uomini tornavano dal lavoro con le mani stanche. " * 3,
               "Dom był zimny i noc zapadała nad doliną, gdy mężczyźni wracali z pracy ze zmęczonymi rękami. " * 3,
               "Talo oli kylmä ja yö laskeutui laakson ylle kun miehet palasivat töistä väsynein käsin.",
               "xqzv kfjw pwmn bdrt qqlz hgfk wvxz ptkm jjqx zrwk " * 5, "Дом был холодный и ночь опускалась на долину."]
    more = spark.createDataFrame([(10**6 + i, t, None, "new", len(t)) for i, t in enumerate(planted)], base.schema)
    kept = {r.doc_id for r in cp.language(spark, base.union(more), None).select("doc_id").collect()}
    assert max(kept) < 10**6
    worded = [r.doc_id for r in base.where("text rlike '[a-z]' and lang is not null").select("doc_id").collect()]
    assert len(worded) > 500 and sum(i in kept for i in worded) >= 0.99 * len(worded)


def test_empty_tables(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    folder = write(spark, str(tmp_path), *(spark.read.parquet(f"{src}/{t}.parquet").limit(0) for t in ("documents", "labels", "benchmark")))
    assert cp.run(spark, folder).count() == 0


def test_extra_columns_stay(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet").limit(60).selectExpr("*", "1 as row", "'x' as tails", "2 as id", "'y' as content")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, src).columns == docs.columns


def test_languages_are_learned_and_bounded_by_all_labelled_rows(spark, monkeypatch):
    from cermetry.llm import langid

    docs = spark.createDataFrame(
        [(i, f"the water was cold {i % 7} and dark" if i % 2 else f"das wasser war kalt {i % 5} und dunkel", "en" if i % 2 else "de") for i in range(40)] + [(40, "qqq zzz", "en"), (41, None, None)],
        "doc_id long, text string, lang string")
    asked, judged = [], []
    fit, usual = langid.fit, langid.usual_rates
    monkeypatch.setattr(langid, "fit", lambda rows, *a, **k: asked.append(k["per_language"]) or fit(rows, *a, **k))
    monkeypatch.setattr(langid, "usual_rates", lambda found, *a, **k: judged.append(found.count()) or usual(found, *a, **k))
    kept = {r.doc_id for r in cp.language(spark, docs, None).collect()}
    assert asked == [None] and judged == [42] and kept >= set(range(40)) and 41 not in kept
    found = spark.createDataFrame([("a", "a", -1.0), ("a", "a", -2.0), ("a", "a", -5.0), ("a", "b", -9.0), ("b", "b", -3.0), ("b", "b", -4.0), (None, "b", -8.0)], "lang string, lang_pred string, rate double")
    assert langid.usual_rates(found) == {"a": -2.0, "b": -3.5}
