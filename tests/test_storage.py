"""Versioned tables, stored intake, the bucketed star, pages and sorted codes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cermetry.operators import features as G
from cermetry.operators import relational as R
from cermetry.plans import bridge as B
from cermetry.plans import relational as plans
from cermetry.sources import versions

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_commit_appends_and_replays_nothing(spark, tmp_path):
    root = str(tmp_path)
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert versions.entries(spark, root) == []
    assert versions.commit(spark, root, "first", {"t": one, "u": two})
    assert versions.commit(spark, root, "second", {"t": two})
    assert not versions.commit(spark, root, "first", {"t": two})
    assert rows_of(versions.read(spark, root, "t")) == [(1, "a"), (2, "b")]
    assert rows_of(versions.read(spark, root, "t", version=1)) == [(1, "a")]
    assert rows_of(versions.read(spark, root, "u")) == [(2, "b")]
    with pytest.raises(ValueError, match="no stored table"):
        versions.read(spark, root, "w")


def test_a_stopped_commit_leaves_the_old_state(spark, tmp_path):
    """The run fails while the third table is written: nothing of the batch is readable."""
    root = str(tmp_path)
    good = spark.createDataFrame([(1,)], "k int")
    names = ("experiments", "compositions", "properties", "features")
    assert versions.commit(spark, root, "first", {n: good for n in names})
    before = {n: rows_of(versions.read(spark, root, n)) for n in names}
    broken = good.select(F.raise_error(F.lit("stopped")).cast("int").alias("k"))
    with pytest.raises(PySparkException):
        versions.commit(spark, root, "second", {"experiments": good, "compositions": good, "properties": broken, "features": good})
    assert {n: rows_of(versions.read(spark, root, n)) for n in names} == before
    assert not versions.committed(spark, root, "second")
    assert versions.commit(spark, root, "second", {n: good for n in names})
    assert all(rows_of(versions.read(spark, root, n)) == [(1,), (1,)] for n in names)


def test_raced_batches_count_once(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1,)], "k int")
    versions.commit(spark, root, "a", {"t": one})
    one.write.parquet(f"{root}/data/t/raced")
    for row in [(1, "a", "t", f"{root}/data/t/raced", "append"), (2, "a", "t", f"{root}/data/t/raced", "append")]:
        spark.createDataFrame([row], versions.LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    assert rows_of(versions.read(spark, root, "t")) == [(1,)]


def test_upserts_merge_and_compact(spark, tmp_path):
    root = str(tmp_path)
    base = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, a double, b string")
    versions.commit(spark, root, "base", {"t": base})
    versions.commit(spark, root, "new", {"t": spark.createDataFrame([(2, 5.0), (3, None)], "k int, a double")}, mode="upsert")
    versions.commit(spark, root, "fix", {"t": spark.createDataFrame([(1, None, "z")], "k int, a double, b string")}, mode="upsert")
    want = {1: (1.0, "z"), 2: (5.0, "y"), 3: (None, None)}
    got = lambda: {r.k: (r.a, r.b) for r in versions.read(spark, root, "t", "k").collect()}
    assert got() == want
    assert versions.compact(spark, root, "t", "k")
    assert got() == want and versions.entries(spark, root)[-1].mode == "replace"
    # the plain join gives the same as the first upsert
    joined = R.upsert(base, spark.createDataFrame([(2, 5.0), (3, None)], "k int, a double"), "k")
    assert rows_of(joined.where("k > 1").select("k", "b")) == [(2, "y"), (3, None)]


def test_stored_intake_replays_and_grades(spark, tmp_path):
    root = str(tmp_path)
    raw, props, proxies = (B.view(spark, SF, n) for n in ("experiments", "properties", "proxies"))
    assert R.store_intake(spark, root, "b1", raw, props, proxies)
    names = ("experiments", "compositions", "properties", "features", "rejected")
    first = {n: rows_of(versions.read(spark, root, n).select("exp_id")) for n in names}
    assert not R.store_intake(spark, root, "b1", raw, props, proxies)
    assert {n: rows_of(versions.read(spark, root, n).select("exp_id")) for n in names} == first
    assert len(first["experiments"]) + len(first["rejected"]) == raw.count()
    p = versions.read(spark, root, "properties")
    assert {r.hardness_grade for r in p.select("hardness_grade").distinct().collect()} <= {"Unknown", "Low", "Medium", "High", "Very High"}
    c = versions.read(spark, root, "compositions").where("abs(binder_vol_pct + ceramic_vol_pct - 100) > 1e-9")
    assert c.count() == 0


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_star_joins_need_no_exchange(spark):
    s = plans.stored_star(spark, SF)
    moduli = s.pop("moduli")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan_of(R.full_export(s, moduli))
        # one key reads one bucket of each table
        key = s["experiments"].agg(F.min("exp_id")).first()[0]
        assert plan_of(R.record(s, key)).count("SelectedBucketsCount: 1 out of 16") == 4
        assert R.record(s, key).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_star_is_stored_without_second_exchanges(spark, tmp_path, monkeypatch):
    """Compositions and binder features come from one stored pass, and features meet only
    the surrogates through an exchange; the values are those of the unstored star."""
    rows = spark.range(1, 3001).selectExpr(
        "id AS o_orderkey", "id % 90 AS o_custkey", "'O' AS o_orderstatus", "CASE WHEN id % 13 = 0 THEN NULL ELSE id * 1.5D END AS o_totalprice",
        "timestamp'1995-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    rows.unionByName(rows.where("o_orderkey % 50 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    writes, store = {}, R.store_star

    def stored(star, *args):
        writes.update({n: plan_of(df) for n, df in star.items()})
        return store(star, *args)

    monkeypatch.setattr(R, "store_star", stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        s = plans.stored_star(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert writes["features"].count("Exchange hashpartitioning") <= 1 and "transform" not in writes["features"]
    want = plans.star(spark, str(tmp_path))
    assert set(s) == {*want, "moduli"}
    for name, df in want.items():
        assert s[name].columns == df.columns
        assert sorted(map(str, s[name].collect())) == sorted(map(str, df.collect())), name


@pytest.mark.parametrize("keys", [list(range(0, 90_000, 3)), [7] * 5000 + [9] * 5000, [-2**62, 5, 6, 2**62], []])
def test_key_ranges_hold_the_page(spark, keys):
    frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    keys = sorted(keys)
    for offset, size in ((0, 10), (len(keys) // 2, 50), (max(len(keys) - 3, 0), 10), (len(keys), 5)):
        found = R.key_range(frame, "k", offset, size, cells=16, enough=100)
        if offset >= len(keys):
            assert found is None
            continue
        low, high, before = found
        assert before == sum(k < low for k in keys)
        held = [k for k in keys if low <= k <= high]
        assert held[offset - before:offset - before + size] == keys[offset:offset + size]
        assert len(held) <= 5000 or len(set(held)) <= 2


def test_late_pages_equal_a_plain_offset(spark):
    s = plans.stored_star(spark, SF)
    s.pop("moduli")
    ids = [r.exp_id for r in R.page_filter(s).select("exp_id").orderBy("exp_id").collect()]
    for number in (1, 2, len(ids) // 40 + 1, len(ids)):
        rows, total = R.page(s, number, 40)
        assert [r.id for r in rows.collect()] == ids[(number - 1) * 40:number * 40]
        assert total.first() == (len(ids), -(-len(ids) // 40))


def test_sorted_codes_of_a_million_labels(spark):
    """Places equal the global order; no window holds all labels."""
    n = 1_000_000
    labels = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 20).alias("label"))
    codes = G.sorted_codes(labels, "label", "code", part_rows=100_000)
    plan = plan_of(codes)
    assert "SinglePartition" not in plan
    ends = codes.agg(F.count("code"), F.min("code"), F.max("code"), F.count_distinct("code")).first()
    assert tuple(ends) == (n, 0, n - 1, n)
    # order is kept: each code's successor has the next larger label
    step = codes.join(codes.select((F.col("code") - 1).alias("code"), F.col("label").alias("next")), "code")
    assert step.where("label >= next").count() == 0 and step.count() == n - 1


def test_codes_and_group_folds_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "ä"), (6, "B")], "id int, c string")
    assert {r.id: r.code for r in G.label_encode(df, "c", "code").collect()} == {1: 2, 2: 1, 3: None, 4: 2, 5: 3, 6: 0}
    assert {r.id: r.fold for r in G.group_folds(df, "c").collect()} == {1: 3, 2: 2, 3: 0, 4: 3, 5: 4, 6: 1}
    assert {r.id: r.fold for r in G.group_folds(df.where("c is not null"), "c").collect()} == {1: 2, 2: 1, 4: 2, 5: 3, 6: 0}
    assert G.label_encode(df.limit(0), "c", "code").count() == 0


def test_stages_are_dropped_on_demand(spark):
    """In a session object of its own, so that other tests keep their stages."""
    import os

    from cermetry.session import cut_lineage, drop_stages

    own = spark.newSession()
    one, two = cut_lineage(own.range(3), "one"), cut_lineage(own.range(4), "two")
    folders = [p.removeprefix("file:") for p in own._cermetry_stages]
    assert one.count() + two.count() == 7 and len(folders) == 2 and all(map(os.path.isdir, folders))
    assert drop_stages(own) == 2 and not any(map(os.path.exists, folders)) and drop_stages(own) == 0
