"""Candidate generation, scoring, filter funnels and Pareto fronts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cermetry.functions import composition as C
from cermetry.functions import constants as K
from cermetry.functions.common import col, pinned, scalars, uniform, uniforms
from cermetry.operators.ordering import skyline, thinned
from cermetry.operators.physics import screening_score
from cermetry.session import checked_broadcast, cut_lineage

def between(key, stream, lo, hi, seed=42):
    return lo + (hi - lo) * uniform(key, stream, seed)


def drawn_shares(df, draws, scale=None):
    """``df`` with ``composition`` and the pinned columns ``_share0``, ``_share1``, ...: shares of one
    drawn value per element, times ``scale``; NULL when the draws are NULL or their total is not positive."""
    df = df.withColumns({f"_value{i}": pinned(v) for i, v in enumerate(draws.values())})
    whole = F.lit(0.0)
    for i in range(len(draws)):
        whole = whole + F.coalesce(F.col(f"_value{i}"), F.lit(0.0))
    df = df.withColumn("_whole", pinned(whole))
    share = lambda i: F.when(F.col("_whole") > 0, F.col(f"_value{i}") / F.col("_whole"))
    df = df.withColumns({f"_share{i}": pinned(share(i) if scale is None else share(i) * scale) for i in range(len(draws))})
    pairs = F.create_map(*[x for i, e in enumerate(draws) for x in (F.lit(e), F.col(f"_share{i}"))])
    return df.withColumn("composition", pinned(F.when(F.col("_whole") > 0, pairs))).drop("_whole", *[f"_value{i}" for i in range(len(draws))])


def spanned(name, lo, hi):
    """A drawn column stretched to a range, as ``between``."""
    return lo + (hi - lo) * F.col(name)


def dirichlet_candidates(df, key, elements=("Co", "Cr", "Fe", "Ni", "Mo"), ceramic="WC", ranges=None, seed=42):
    """Uniform process parameters and Dirichlet(1) shares for every row id."""
    r = {"sinter_temp": (1300, 1600), "grain_size": (0.5, 3.0), "binder_wt_pct": (5, 30), **(ranges or {})}
    draws = {f"_u{i}": i for i in (0, 1, 2, *range(10, 10 + len(elements)))}
    df = uniforms(df, key, draws, seed)
    wt = spanned("_u2", *r["binder_wt_pct"])
    df = df.withColumns({
        "ceramic": F.lit(ceramic), "ceramic_wt_pct": pinned(100 - wt), "binder_wt_pct": pinned(wt),
        "sinter_temp_c": pinned(spanned("_u0", *r["sinter_temp"])), "grain_size_um": pinned(spanned("_u1", *r["grain_size"]))})
    df = drawn_shares(df, {e: -F.ln(F.col(f"_u{10 + i}")) for i, e in enumerate(elements)})
    return df.drop(*draws, *[f"_share{i}" for i in range(len(elements))])


def one_decimal(tenths):
    """Text of a number of tenths."""
    return F.concat(((tenths - tenths % 10) / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def bounded_candidates(df, key, space=K.ELEMENT_SPACE, seed=42):
    """Shares within element bounds, scaled to 100; traces left out of the text."""
    draws = {f"_u{i}": i for i in (0, 1, 2, *range(10, 10 + len(space)))}
    df = uniforms(df, key, draws, seed)
    df = drawn_shares(df, {e: spanned(f"_u{10 + i}", lo, hi) for i, (e, (lo, hi)) in enumerate(space.items())}, 100)
    shares = {e: f"_share{i}" for i, e in enumerate(space)}
    df = df.withColumns({f"{s}_text": pinned(F.when(F.col(s) > 0.1, F.rint(F.col(s) * 10).cast("bigint"))) for s in shares.values()})
    df = df.withColumns({f"{s}_text": pinned(F.concat(F.lit(e), one_decimal(F.col(f"{s}_text")))) for e, s in shares.items()})
    text = F.when(F.col("composition").isNotNull(), F.concat_ws("", *[F.col(f"{s}_text") for s in shares.values()]))
    return df.withColumns({
        "recipe_id": F.format_string("VR_%06d", col(key)), "formula": pinned(text),
        "wc_content": pinned(spanned("_u0", 85, 95)), "sinter_temp_c": pinned(spanned("_u1", 1350, 1450)),
        "grain_size_um": pinned(spanned("_u2", 0.5, 2.0)),
    }).drop(*draws, *shares.values(), *[f"{s}_text" for s in shares.values()])


def subset_candidates(df, key, elements, low=4, high=6, seed=42):
    """A random subset of ``low`` to ``high`` elements with normalised shares."""
    draws = {"_u0": 0, **{f"_{c}{i}": base + i for i in range(len(elements)) for c, base in (("t", 20), ("v", 60))}}
    df = uniforms(df, key, draws, seed)
    k = (F.floor(F.col("_u0") * (high - low + 1)) + low).cast("int")
    tickets = F.sort_array(F.array(*[
        F.struct(F.col(f"_t{i}").alias("t"), F.lit(e).alias("e"), F.col(f"_v{i}").alias("v")) for i, e in enumerate(elements)]))
    # pinned, so that each is worked out once a row however often it is read
    df = df.withColumn("_tickets", pinned(F.slice(tickets, 1, k)))
    entries = F.transform("_tickets", lambda x: F.struct(x["e"], x["v"]))
    return df.withColumn("composition", pinned(C.share_map(F.map_from_entries(entries)))).drop(*draws, "_tickets")


# ---------------------------------------------------------------- filters
def stable_only(df, limit, energy="pred_formation_energy"):
    return df.where(F.col(energy) < limit)


def interface_only(df, limit, mismatch="lattice_mismatch"):
    """Rows within the mismatch limit; all rows if none is.

    The count is a scalar subquery, so the decision stays inside the query.
    """
    fits = F.abs(F.col(mismatch)) < limit
    none = scalars(df.agg(F.count_if(fits).alias("n")))["n"] == 0
    return df.where(fits | none)


def top(df, score, key, n):
    """Best ``n`` by descending score, id ascending; NULL scores last."""
    return df.orderBy(F.desc_nulls_last(score), key).limit(n)


def ranked(df, score, key, n):
    """Top rows with a rank; the numbering sees only the ``n`` kept rows."""
    best = top(df, score, key, n)
    return best.withColumn("rank", F.expr(f"row_number() OVER (ORDER BY {score} DESC NULLS LAST, {key})"))


def combined_score(hv, kic):
    return col(hv) / 2000 + col(kic) / 15


def screening_summary(df, c, key, n):
    """Moments and the uplift of the top rows' minimum over the mean, percent."""
    base = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    cut = scalars(top(df.where(F.col(c).isNotNull()), c, key, n).agg(F.min(c).alias("cut")))["cut"]
    return base.withColumn("uplift_pct", (cut - F.col("mean")) / F.col("mean") * 100)


def run_screening(candidates, featurize, model, expected, key, n, prediction="prediction"):
    """Candidates to features to predictions to the best ``n``, one plan.

    ``featurize`` adds the model's inputs; ``model`` is a fitted transformer.
    """
    from cermetry.operators.features import align

    x = align(featurize(candidates), expected, keep=[key, "composition"])
    best = ranked(model.transform(x).select(key, "composition", prediction), prediction, key, n)
    return best.withColumn("formula", C.standard_text(F.col("composition"), 4)).drop("composition")


def screening_funnel(df, key, energy_limit=0.0, mismatch_limit=0.1, n=20):
    """Stability filter, interface filter with fallback, score, best ``n``.

    Expects pred_formation_energy, lattice_mismatch, pugh and
    pred_magnetic_moment columns.  Rows within the mismatch limit are ranked before
    all others, so that one pass that stores nothing finds the best ``n`` whether or not
    there are any; ``interface_only`` then decides among these.
    """
    fits = F.coalesce(F.abs(F.col("lattice_mismatch")) < mismatch_limit, F.lit(False))
    stable = stable_only(df, energy_limit)
    scored = stable.withColumn("score", screening_score("pred_formation_energy", "lattice_mismatch", "pugh", "pred_magnetic_moment"))
    best = cut_lineage(scored.orderBy(fits.desc(), F.desc_nulls_last("score"), key).limit(n), "best")
    return top(interface_only(best, mismatch_limit), "score", key, n)


# ---------------------------------------------------------------- inverse design
def share_violation(m):
    """Total excess below 5 % and above 35 %, times 10,000."""
    return F.aggregate(
        F.map_values(col(m)), F.lit(0.0),
        lambda a, v: a + F.greatest(F.lit(0.0), 0.05 - v, v - 0.35) * 10000)


def range_penalty(c, lo, hi, weight):
    v = col(c)
    return F.greatest(F.lit(0.0), lo - v, v - hi) * weight


def penalised(df, m, hv, kic, hv_range, kic_range):
    """Objective columns ``obj_hv`` and ``obj_kic`` under the design targets; a
    composition out of bounds is rejected outright."""
    df = df.withColumn("violation", pinned(share_violation(m)))
    bad = F.col("violation")
    penalty = bad + range_penalty(hv, *hv_range, 50) + range_penalty(kic, *kic_range, 2000)
    return df.withColumns({
        "obj_hv": F.when(bad > 0.1, -10000 - bad).otherwise(col(hv) - penalty),
        "obj_kic": F.when(bad > 0.1, -10000 - bad).otherwise(col(kic) - penalty),
    })


def pareto(df, x="hv", y="kic"):
    return skyline(df, x, y)


def accepted(df, m, x="hv", y="kic"):
    """Non-negative objectives and every share at least 4.5 %."""
    return df.where((F.col(x) >= 0) & (F.col(y) >= 0) & F.forall(F.map_values(m), lambda v: v >= 0.045))


def inverse_design(df, m, hv, kic, hv_range, kic_range):
    """Penalised objectives, their Pareto front, acceptance.

    The front reads its input several times, so the scored rows are stored once.
    """
    scored = cut_lineage(penalised(df, m, hv, kic, hv_range, kic_range), "scored")
    return accepted(pareto(scored, "obj_hv", "obj_kic"), m, "obj_hv", "obj_kic")


PROCESS = ("binder_wt_pct", "sinter_temp_c", "grain_size_um")


def around_members(df, key, members, elements, ranges, width, seed):
    """Rows drawn from boxes around the archive's members of each row's task.

    A row picks one member of its task by its draw; shares are multiplied by up to
    exp(+-width) and scaled to one, process parameters move by up to half of
    ``width`` of their range and stay inside it.  Rows of tasks without members
    keep what they have.  ``members``: (task, place, of, composition, parameters).
    """
    picked = members.select("task", F.col("place").alias("_place"), F.col("composition").alias("_m"), *[F.col(c).alias(f"_{c}") for c in PROCESS])
    sizes = members.groupBy("task").agg(F.count(F.lit(1)).alias("_of"))
    df = df.join(F.broadcast(sizes), "task", "left")  # one row per task
    df = df.withColumn("_place", F.floor(uniform(key, 90, seed) * F.col("_of")).cast("long"))
    df = df.join(checked_broadcast(picked), ["task", "_place"], "left")
    draws = {**{f"_w{i}": 100 + i for i in range(len(elements))}, **{f"_s{i}": 140 + i for i in range(len(PROCESS))}}
    df = uniforms(df, key, draws, seed)
    # pinned steps, so that no share is worked out more than once a row
    df = df.withColumns({f"_n{i}": pinned(F.coalesce(F.try_element_at("_m", F.lit(e)), F.lit(0.0)) * F.exp(width * (2 * F.col(f"_w{i}") - 1))) for i, e in enumerate(elements)})
    whole = F.lit(0.0)
    for i in range(len(elements)):
        whole = whole + F.col(f"_n{i}")
    df = df.withColumn("_whole", pinned(whole))
    moved = F.create_map(*[x for i, e in enumerate(elements) for x in (F.lit(e), F.col(f"_n{i}") / F.col("_whole"))])
    near = {"composition": pinned(F.when(F.col("_m").isNull(), F.col("composition")).when(F.col("_whole") > 0, moved))}
    for i, c in enumerate(PROCESS):
        lo, hi = ranges[c]
        step = width * (hi - lo) * (F.col(f"_s{i}") - 0.5)
        near[c] = pinned(F.coalesce(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(f"_{c}") + step)), F.col(c)))
    df = df.withColumns(near).withColumn("ceramic_wt_pct", 100 - F.col("binder_wt_pct"))
    return df.drop("_place", "_of", "_m", "_whole", *draws, *[f"_n{i}" for i in range(len(elements))], *[f"_{c}" for c in PROCESS])


def archive_search(ids, tasks, evaluate, key="cid", elements=("Co", "Cr", "Fe", "Ni", "Mo"), ceramic="WC", rounds=4, width=1.0, seed=42):
    """Search for designs of every task; returns the stored archive after each round.

    ``tasks``: (task, hv_min, hv_max, kic_min, kic_max), one row per request, few.
    ``evaluate`` adds ``hv`` and ``kic`` to rows with composition, ceramic and process
    parameters.  In each round every id is one new candidate of one task: in the
    first a Dirichlet draw, later a draw from a box around a member of its task's
    archive, half as wide each round.  Candidates are scored under their task's
    targets and merged with the archive, of which the Pareto front per task stays;
    so a front never gets worse.  Every task of a round drops what
    its own candidates dominate, so that few rows are stored.  Rows: task, ``found`` (round), key, composition,
    parameters, hv, kic, violation, obj_hv, obj_kic.
    """
    ranges = {"binder_wt_pct": (5, 30), "sinter_temp_c": (1300, 1600), "grain_size_um": (0.5, 3.0)}
    names = [r.task for r in tasks.select("task").distinct().orderBy("task").collect()]
    tasks = checked_broadcast(tasks)
    ids = cut_lineage(ids.select(key), "ids")  # read in every round
    archives, archive = [], None
    for turn in range(rounds):
        drawn = dirichlet_candidates(ids, key, elements, ceramic, {"sinter_temp": ranges["sinter_temp_c"], "grain_size": ranges["grain_size_um"], "binder_wt_pct": ranges["binder_wt_pct"]}, seed + turn)
        pick = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(names))).cast("int")
        drawn = drawn.withColumn("task", F.element_at(F.array(*[F.lit(n) for n in names]), pick + 1))
        if archive is not None:
            place = F.row_number().over(W.partitionBy("task").orderBy("obj_hv", "obj_kic", "found", key)) - 1
            drawn = around_members(drawn, key, archive.withColumn("place", place.cast("long")), elements, ranges, width * 0.5 ** (turn - 1), seed + turn)
        scored = evaluate(drawn).join(tasks, "task").withColumn("found", F.lit(turn))
        scored = penalised(scored, "composition", "hv", "kic", (F.col("hv_min"), F.col("hv_max")), (F.col("kic_min"), F.col("kic_max")))
        scored = scored.select("task", "found", key, "composition", *PROCESS, "hv", "kic", "violation", "obj_hv", "obj_kic")
        scored = cut_lineage(thinned(scored, "obj_hv", "obj_kic", ["task"]), "scored")
        merged = scored if archive is None else archive.unionByName(scored)
        archive = cut_lineage(skyline(merged, "obj_hv", "obj_kic", by=["task"]), "archive")
        archives.append(archive)
    return archives


def design_tasks(tasks, solutions, key, width=50.0):
    """Per task: best solution inside its ranges, their number, a status.

    A range join by buckets: a task is repeated for the hardness buckets it
    touches, a solution has one bucket, and the exact ranges are checked after
    the equi-join.  The task side is broadcast when counted to be small.
    """
    bucket = lambda c: F.floor(col(c) / width).cast("bigint")
    spread = tasks.withColumn("_b", F.explode(F.sequence(bucket("hv_min"), bucket("hv_max"))))
    s = solutions.select(F.col(key).alias("_id"), "hv", "kic", bucket("hv").alias("_b"))
    hits = s.join(checked_broadcast(spread), "_b").where(
        "hv BETWEEN hv_min AND hv_max AND kic BETWEEN kic_min AND kic_max")
    best = hits.groupBy("task").agg(
        F.count(F.lit(1)).alias("num_solutions"),
        F.max(F.struct("hv", "kic", (-F.col("_id")).alias("neg"))).alias("_best"))
    out = tasks.join(best, "task", "left")
    return out.select(
        "task", F.col("_best.hv").alias("best_hv"), F.col("_best.kic").alias("best_kic"),
        F.coalesce("num_solutions", F.lit(0)).alias("num_solutions"),
        F.when(F.col("num_solutions") > 0, "OK").otherwise("No solutions found").alias("status"))


def export_solutions(df, key, m, elements):
    """Fixed-format text columns, one per element."""
    fixed = lambda c, d: F.format_string(f"%.{d}f", col(c))
    return df.select(
        F.col(key).alias("solution_id"), fixed("hv", 2).alias("hv"), fixed("kic", 2).alias("kic"),
        *[fixed(F.coalesce(F.try_element_at(m, F.lit(e)), F.lit(0.0)), 4).alias(e) for e in elements])


def mean_composition(df, m, elements):
    return df.agg(*[F.avg(F.coalesce(F.try_element_at(m, F.lit(e)), F.lit(0.0))).alias(e) for e in elements])
