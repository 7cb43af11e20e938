import pytest
from pyspark.sql import functions as F

from cermetry.operators import columns as B
from cermetry.operators import documents as D
from cermetry.operators import physics as O
from cermetry.operators import relational as R
from cermetry.operators import screening as S
from cermetry.session import shared_dir
from cermetry.sources import files
from cermetry.streaming import intake


def test_uniform_is_uniform_and_repeatable(spark):
    df = spark.range(20000).select(*[S.uniform("id", s).alias(f"u{s}") for s in range(3)])
    m = df.agg(*[F.avg(c).alias(c) for c in df.columns], F.corr("u0", "u1").alias("r"), F.min("u0").alias("lo"), F.max("u0").alias("hi")).first()
    assert all(m[f"u{s}"] == pytest.approx(0.5, abs=0.01) for s in range(3))
    assert abs(m.r) < 0.03 and 0 < m.lo and m.hi < 1
    a = spark.range(100).repartition(7).select("id", S.uniform("id", 1).alias("u")).orderBy("id").collect()
    assert a == spark.range(100).select("id", S.uniform("id", 1).alias("u")).orderBy("id").collect()


def test_candidates_are_compositions(spark):
    c = S.dirichlet_candidates(spark.range(500), "id")
    ok = F.abs(F.aggregate(F.map_values("composition"), F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9
    assert c.where(ok & F.col("sinter_temp_c").between(1300, 1600)).count() == 500
    s = S.subset_candidates(spark.range(500), "id", ("Co", "Cr", "Fe", "Ni", "Mo", "Ti", "Al"))
    assert {r[0] for r in s.select(F.size("composition")).distinct().collect()} == {4, 5, 6}
    b = S.bounded_candidates(spark.range(3), "id").select("recipe_id").orderBy("recipe_id").collect()
    assert [r[0] for r in b] == ["VR_000000", "VR_000001", "VR_000002"]


def test_interface_falls_back(spark):
    df = spark.createDataFrame([(1, 0.05), (2, 0.2)], "id int, lattice_mismatch double")
    assert S.interface_only(df, 0.1).count() == 1
    assert S.interface_only(df, 0.01).count() == 2


def test_design_tasks_match_nested_loop(spark):
    tasks = [("a", 1000.0, 1049.9, 5.0, 9.0), ("b", 990.0, 1210.0, 8.0, 8.0), ("c", 5000.0, 6000.0, 1.0, 2.0)]
    sols = [(i, 950.0 + 7.3 * i, 5.0 + (i % 9) * 0.5) for i in range(60)]
    t = spark.createDataFrame(tasks, "task string, hv_min double, hv_max double, kic_min double, kic_max double")
    s = spark.createDataFrame(sols, "id int, hv double, kic double")
    got = {r.task: (r.num_solutions, r.best_hv, r.status) for r in S.design_tasks(t, s, "id").collect()}
    for name, lo, hi, klo, khi in tasks:
        hits = [h for _, h, k in sols if lo <= h <= hi and klo <= k <= khi]
        assert got[name] == (len(hits), max(hits) if hits else None, "OK" if hits else "No solutions found")


def test_penalty(spark):
    df = spark.createDataFrame([({"Co": 0.3, "Ni": 0.7}, 1500.0, 9.0), ({"Co": 0.2, "Ni": 0.3, "Fe": 0.3, "Cr": 0.2}, 1300.0, 9.0)], "m map<string,double>, hv double, kic double")
    r = S.penalised(df, "m", "hv", "kic", (1400, 1700), (8, 12)).collect()
    assert r[0].obj_hv == pytest.approx(-10000 - 3500) and r[1].obj_hv == pytest.approx(1300 - 5000)


def test_upsert_and_pages(spark):
    old = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "id int, v double, s string")
    new = spark.createDataFrame([(2, None), (3, 3.0)], "id int, v double")
    got = {r.id: (r.v, r.s) for r in R.upsert(old, new, "id").collect()}
    assert got == {1: (1.0, "x"), 2: (2.0, "y"), 3: (3.0, None)}


def test_alias_tables():
    cols = B.find_column(["Sinter Temp", "HV, kgf/mm2"], ["hv"])
    assert cols == "HV, kgf/mm2"


def test_standard_names_keep_duplicates(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Temperature` int, `T_sinter` int, other int")
    assert B.standardize_columns(df).columns == ["sinter_temp", "sinter_temp_2", "other"]


def test_property_mentions_in_other_units(spark):
    df = spark.createDataFrame([(1, "Its density is 15600 kg/m3; melting point 2870 °C.")], "id int, text string")
    got = {r.property: r.value for r in D.property_mentions(df, "id", "text").collect()}
    assert got == pytest.approx({"density": 15.6, "melting_point": 3143.15})


def test_csv_with_byte_order_mark(spark):
    path = files.write_csv_report(spark.range(3).withColumnRenamed("id", "key"), shared_dir(spark, "bom"))
    assert files.read_csv(spark, path).columns == ["key"]


def test_stream_intake(spark):
    src, out, chk = (shared_dir(spark, n) for n in ("src", "out", "chk"))
    rows = [(1, "S1", "WC-10Co"), (2, "S1", "nothing"), (3, "S2", "80TiC-20Mo")]
    spark.createDataFrame(rows, intake.RAW).write.option("header", True).csv(src)
    query = intake.start_intake(intake.raw_stream(spark, src), out, chk)
    assert query.awaitTermination(120)
    assert {r.exp_id for r in spark.read.parquet(f"{out}/compositions").collect()} == {1, 3}
    assert {r.exp_id for r in spark.read.parquet(f"{out}/rejected").collect()} == {2}


def test_archive_search_never_gets_worse(spark):
    """Against brute force: each round's archive is the front of all candidates so far, per task."""
    ids = spark.range(300).withColumnRenamed("id", "cid")
    tasks = spark.createDataFrame([("a", 0.0, 900.0, 0.0, 30.0), ("b", 400.0, 700.0, 5.0, 9.0)], "task string, hv_min double, hv_max double, kic_min double, kic_max double")
    seen = []

    def evaluate(c):
        share = lambda e: F.col("composition")[e]
        c = c.withColumns({"hv": 400 + 900 * share("Cr") - 300 * share("Ni") + F.col("binder_wt_pct"), "kic": 4 + 12 * share("Ni") + F.col("grain_size_um") - 3 * share("Cr")})
        seen.append(c)
        return c

    archives = [a.collect() for a in S.archive_search(ids, tasks, evaluate, rounds=4)]
    limits = {r.task: r for r in tasks.collect()}
    everything = []
    for turn, (frame, archive) in enumerate(zip(seen, archives)):
        rows = frame.collect()
        assert len(rows) == 300 and {r.task for r in rows} == {"a", "b"}
        for r in rows:
            m, t = r.composition, limits[r.task]
            assert sum(m.values()) == pytest.approx(1) and 5 <= r.binder_wt_pct <= 30 and 1300 <= r.sinter_temp_c <= 1600 and 0.5 <= r.grain_size_um <= 3
            bad = sum(max(0, 0.05 - v, v - 0.35) * 10000 for v in m.values())
            penalty = bad + max(0, t.hv_min - r.hv, r.hv - t.hv_max) * 50 + max(0, t.kic_min - r.kic, r.kic - t.kic_max) * 2000
            x, y = (-10000 - bad, -10000 - bad) if bad > 0.1 else (r.hv - penalty, r.kic - penalty)
            everything.append((r.task, turn, r.cid, x, y))
        for task in "ab":
            own = [e for e in everything if e[0] == task]
            front = {(e[1], e[2]) for e in own if not any(f[3] >= e[3] and f[4] >= e[4] and (f[3] > e[3] or f[4] > e[4]) for f in own)}
            assert {(r.found, r.cid) for r in archive if r.task == task} == front
    for old, new in zip(archives, archives[1:]):
        for r in old:
            assert any(s.task == r.task and s.obj_hv >= r.obj_hv and s.obj_kic >= r.obj_kic for s in new)
    # later rounds look near the archive: their candidates are better than the first draws
    mean = lambda turn: sum(e[3] for e in everything if e[1] == turn) / 300
    assert mean(3) > mean(1) > mean(0)


def test_injection_in_place_equals_injection_once_per_text(spark):
    from cermetry.operators import physics as O
    from cermetry.plans import bridge

    a = bridge.view(spark, "/root/testdata/sf0.001", "alloys")
    rows = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    assert rows(O.inject_features(a)) == rows(O.inject_features(a, repeated=False))


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_as_columns_equal_the_expression(spark):
    from cermetry.functions.common import uniform, uniforms

    df = spark.createDataFrame([(k,) for k in (None, 0, 1, -1, -2**40, 2147483647, 2**62, 10**15 + 7)], "cid long")
    got = uniforms(df, "cid", {"u0": 0, "u7": 7}, 5).select("u0", "u7", uniform("cid", 0, 5).alias("w0"), uniform("cid", 7, 5).alias("w7")).collect()
    assert len(got) == 8 and all(r.u0 == r.w0 and r.u7 == r.w7 for r in got) and sum(r.u0 is None for r in got) == 1


def test_candidates_are_drawn_once_a_row(spark):
    """A filter for the exploded map, or a second reader of the shares, repeats nothing."""
    from cermetry.operators import features as G

    ids = spark.range(10).withColumnRenamed("id", "cid")
    subset = S.subset_candidates(ids, "cid", ("Co", "Cr", "Fe", "Ni", "Mo", "Ti")).select("cid", F.explode("composition").alias("el", "share"))
    assert _optimized(subset).count("sort_array(") == 1
    dirichlet = S.dirichlet_candidates(ids, "cid").select(F.map_keys("composition"), F.map_values("composition"), "composition").where("size(composition) > 0")
    assert _optimized(dirichlet).lower().count("ln(") == 5
    maps = ids.select("cid", *[F.create_map(F.lit("a"), F.rand(1)).alias(c) for c in ("c", "b")], F.lit(40.0).alias("f"))
    assert _optimized(G.two_phase_maps(maps, "c", "b", "f", "f", "f")).count("array_intersect(") == 1


def test_sessions_leave_no_method_to_the_interpreter(spark):
    from cermetry.plans import bridge

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 65535)
    bridge.table(spark, "/root/testdata/sf0.001", "region")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_rows_left_by_each_task_hold_the_whole_front(spark, monkeypatch):
    """Few rows are left, equal points all stay, and the front is that of all rows."""
    from cermetry.operators import ordering

    rows = spark.range(6000).selectExpr(
        "id", "CASE WHEN id % 50 = 0 THEN NULL ELSE concat('g', id % 3) END AS g",
        "CASE WHEN id % 41 = 0 THEN NULL WHEN id % 43 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(pmod(hash(id, 1), 80) AS DOUBLE) END AS x", "CAST(pmod(hash(id, 2), 90) AS DOUBLE) AS y").repartition(3)
    rows = rows.unionByName(rows.where("id < 200"))
    key = lambda df: sorted((r.id, r.g, r.x, r.y) for r in df.collect())
    for by in (["g"], []):
        want = key(ordering.skyline(rows, "x", "y", by))
        assert len(want) > len(by) * 3
        for held in (7, 100_000):
            monkeypatch.setattr(ordering, "HELD_ROWS", held)
            left = ordering.thinned(rows, "x", "y", by)
            assert key(ordering.skyline(left, "x", "y", by)) == want and left.columns == rows.columns
        assert left.count() < 300


def test_features_of_known_elements_equal_those_of_maps(spark):
    from cermetry.operators import ml
    from cermetry.functions import physics as P
    from cermetry.plans.screening import EL5, KIC_VECTOR, VECTOR

    c = S.dirichlet_candidates(spark.range(40).selectExpr("CASE WHEN id > 0 THEN id * 7919 END AS cid"), "cid", EL5)
    c = c.withColumn("composition", F.when(F.col("cid") != 7919, F.col("composition")))
    maps = c.withColumn("pred_lattice_param", P.vegard_lattice(F.col("composition")))
    flat = O.element_lattice(c, "composition", EL5)
    args = {"binder_vol": "binder_wt_pct", "composition": "composition"}
    for f, names in ((O.hardness_vector, VECTOR), (O.toughness_vector, KIC_VECTOR)):
        want = f(maps, **args).select("cid", "pred_lattice_param", *names)
        got = f(flat, elements=EL5, **args)
        assert set(got.columns) == set(f(maps, **args).columns) and "transform" not in got._jdf.queryExecution().optimizedPlan().toString()
        a, b = ({r.cid: tuple(r)[1:] for r in df.collect()} for df in (want, got.select("cid", "pred_lattice_param", *names)))
        assert len(a) == 40 and a.keys() == b.keys() and all(b[k] == pytest.approx(v, rel=1e-12, nan_ok=True) if None not in v else b[k] == v for k, v in a.items())
    x = O.hardness_vector(flat, elements=EL5, **args).withColumn("hv", 900 + 40 * F.col("norm2") + F.col("grain_um"))
    model = ml.pipeline("regression", "ridge", VECTOR, "hv").fit(x.where("cid > 7919"))
    both = model.transform(x).select("prediction", ml.linear_prediction(model, VECTOR, "own")).collect()
    assert len(both) == 40 and all(r.own == pytest.approx(r.prediction, rel=1e-9) for r in both)


def test_a_search_stores_few_candidates(spark, monkeypatch):
    """A round keeps what may be on a front, not every candidate as a whole row."""
    stored = {}
    cut = S.cut_lineage

    def counted(df, name="stage"):
        out = cut(df, name)
        stored[name] = max(stored.get(name, 0), out.count())
        return out

    monkeypatch.setattr(S, "cut_lineage", counted)
    tasks = spark.createDataFrame([("a", 1000.0, 1e6, 0.0, 1e6), ("b", 1000.0, 1e6, 0.0, 1e6)], "task string, hv_min double, hv_max double, kic_min double, kic_max double")
    evaluate = lambda c: c.withColumn("hv", 2000 * F.col("composition")["Mo"] + 1000).withColumn("kic", 20 - F.col("hv") / 100 + 5 * F.col("composition")["Co"])
    S.archive_search(spark.range(3000).withColumnRenamed("id", "cid"), tasks, evaluate, rounds=2)
    assert stored["ids"] == 3000 and 0 < stored["scored"] < 1000


def test_a_funnel_stores_the_best_rows_only(spark, monkeypatch):
    """With the rows of a filter with fallback over all stable rows."""
    from cermetry.plans import screening as plans

    stored = []
    cut = S.cut_lineage

    def counted(df, name="stage"):
        out = cut(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(S, "cut_lineage", counted)
    monkeypatch.setattr(plans, "cut_lineage", counted)
    rows = spark.range(400).selectExpr("id", "CAST(pmod(hash(id, 1), 100) AS DOUBLE) / 100 - 0.8 AS pred_formation_energy", "CASE WHEN id % 7 > 0 THEN CAST(pmod(hash(id, 2), 60) AS DOUBLE) / 100 - 0.3 END AS lattice_mismatch",
                                       "CASE WHEN id % 5 > 0 THEN 1.5 + pmod(hash(id, 3), 5) / 10 END AS pugh", "1.0 + id % 3 AS pred_magnetic_moment")
    for limit in (0.1, 0.005, 0.0):
        stable = S.stable_only(rows, 0.0)
        none = stable.where(F.abs("lattice_mismatch") < limit).count() == 0
        kept = stable.where((F.abs("lattice_mismatch") < limit) | F.lit(none))
        want = S.top(kept.withColumn("score", O.screening_score("pred_formation_energy", "lattice_mismatch", "pugh", "pred_magnetic_moment")), "score", "id", 20).collect()
        got = S.screening_funnel(rows, "id", mismatch_limit=limit).collect()
        assert len(got) == (20 if limit != 0.005 else kept.count()) and got == want and none == (limit == 0)
    assert stored == [20, 20, 20]
    assert plans.i11b(spark, "/root/testdata/sf0.001").count() == 20 and stored[3:] == [20]
