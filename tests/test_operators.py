"""Operators on small inputs against brute force in plain Python."""

import random

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from trialspark.functions.draws import uniform, unit_code
from trialspark.operators import adjust, assign, hypothesis, multiplicity, panels, replay, sequential, trend
from trialspark.operators.groupstats import exact_quantile
from trialspark.sources import ingest


def quantile(values, q):
    v = sorted(values)
    pos = (len(v) - 1) * q
    lo = int(pos)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(3)
    groups = {
        "heavy": [rng.lognormvariate(6, 2) for _ in range(3000)],
        "zeros": [0.0] * 2950 + [rng.uniform(1, 9) for _ in range(50)],
        "signed": [rng.gauss(0, 5) for _ in range(999)],
        "ties": [float(rng.randint(-3, 3)) for _ in range(1200)],
        "single": [4.25], "tiny": [1e-300, -1e-300, 0.0, 1e300],
    }
    rows = [(g, x) for g, v in groups.items() for x in v] + [("heavy", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, y double")
    got = {r.g: r.quantile for r in exact_quantile(df, "y", q, ["g"]).collect()}
    for g, v in groups.items():
        assert got[g] == pytest.approx(quantile(v, q), rel=1e-12), g
    assert "empty" not in got
    plain = exact_quantile(df.where("g = 'heavy'"), "y", q).first()
    assert plain.quantile == pytest.approx(quantile(groups["heavy"], q))


def test_winsorize_caps_both_arms_at_one_value(spark):
    df = spark.range(1000).selectExpr("IF(id % 2 = 0, 'control', 'treatment') AS arm", "CAST(id AS DOUBLE) AS y")
    out = hypothesis.winsorize_pooled(df, "y", 0.99)
    assert out.agg(F.max("y_w")).first()[0] == pytest.approx(989.01)
    assert out.where("y < cap AND y_w <> y").count() == 0 and out.count() == 1000
    keyed = df.selectExpr("*", "IF(y < 500, 'low', 'null') AS g").withColumn("y", F.expr("IF(g = 'low', y, NULL)"))
    kept = hypothesis.winsorize_pooled(keyed, "y", 0.5, ["g"])
    assert kept.count() == 1000 and kept.where("g = 'null' AND y_w IS NOT NULL").count() == 0


def test_dense_id_is_a_permutation(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(7)
    ids = sorted(r.row_id for r in ingest.add_unit_id(df, "k", dense=True, buckets=16).collect())
    assert ids == list(range(1, 5001))
    sparse = ingest.add_unit_id(df)
    assert sparse.select("row_id").distinct().count() == 5000


def test_draws_are_uniform_and_independent(spark):
    df = spark.range(20000).withColumn("code", unit_code(F.col("id")))
    a, b, c = uniform("arm", 1), uniform("arm", 2), uniform("lift", 1)
    r = df.select(a.alias("a"), b.alias("b"), c.alias("c")).agg(
        F.avg("a").alias("m"), F.var_samp("a").alias("v"), F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac")).first()
    assert abs(r.m - 0.5) < 0.01 and abs(r.v - 1 / 12) < 0.002 and abs(r.ab) < 0.03 and abs(r.ac) < 0.03


def holm_brute(ps, alpha):
    out, alive = {}, True
    for i, k in enumerate(sorted(range(len(ps)), key=lambda j: ps[j])):
        alive = alive and ps[k] <= alpha / (len(ps) - i)
        out[k] = alive
    return out


def bh_brute(ps, alpha):
    order = sorted(range(len(ps)), key=lambda j: ps[j])
    k = max([i + 1 for i, j in enumerate(order) if ps[j] <= alpha * (i + 1) / len(ps)], default=0)
    return {j: i < k for i, j in enumerate(order)}


def test_holm_and_bh(spark):
    rng = random.Random(1)
    fams = {f: [round(rng.random() ** 3, 3) for _ in range(rng.randint(1, 15))] for f in range(40)}
    fams[99] = [0.04] + [0.3] * 19
    df = spark.createDataFrame([(f, i, p) for f, v in fams.items() for i, p in enumerate(v)], "f int, i int, p_value double")
    for r in multiplicity.benjamini_hochberg(multiplicity.holm(df, ["f"]), ["f"]).collect():
        assert r.holm_reject == holm_brute(fams[r.f], 0.05)[r.i]
        assert r.bh_reject == bh_brute(fams[r.f], 0.05)[r.i]
        assert not r.holm_reject or r.p_value <= 0.05


def test_ancova_matches_least_squares(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(5)
    n = 800
    t = rng.random(n) < 0.4
    x = rng.normal(1000, 3, (n, 3)) + t[:, None] * 0.5
    y = 2 * t + x @ np.array([0.5, -1.0, 0.2]) + rng.normal(0, 1 + t, n)
    rows = [("e", "treatment" if a else "control", *map(float, v), float(w)) for a, v, w in zip(t, x, y)]
    df = spark.createDataFrame(rows, "e string, arm string, a double, b double, c double, y double")
    z = np.column_stack([np.ones(n), t, x - x.mean(0)])
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    e = y - z @ beta
    cov = inv @ (z.T * e**2) @ z @ inv * n / (n - 5)
    r = adjust.ancova_hc1(df, "y", ["a", "b", "c"], ["e"]).first()
    assert r.effect == pytest.approx(beta[1], rel=1e-8) and r.se == pytest.approx(np.sqrt(cov[1, 1]), rel=1e-8)
    assert r.residual_variance_share == pytest.approx((e**2).mean() / y.var(), rel=1e-8)
    plain = adjust.ancova_hc1(df, "y", ["a", "b", "c"]).first()
    assert plain.effect == pytest.approx(r.effect)


def test_cuped_test_equals_welch_on_adjusted_rows(spark):
    df = spark.range(3000).selectExpr("IF(hash(id) % 2 = 0, 'control', 'treatment') AS arm",
                                      "CAST(hash(id, 7) % 100 AS DOUBLE) AS x").selectExpr(
        "*", "0.7 * x + CAST(hash(x, arm) % 50 AS DOUBLE) AS y")
    fast = adjust.cuped_test(df, "y", "x").first()
    slow = hypothesis.welch_ttest(adjust.cuped_adjust(df, "y", "x"), "adjusted").first()
    assert fast.effect == pytest.approx(slow.effect) and fast.se == pytest.approx(slow.se) and fast.p_value == pytest.approx(slow.p_value)


@pytest.mark.parametrize("rho", [0.3, 0.6, 0.9])
def test_variance_reduction_follows_rho_squared(spark, rho):
    df = spark.range(50000).withColumn("code", unit_code(F.col("id"))).select(
        uniform("arm", 1).alias("x"), uniform("arm", 2).alias("e")).select("x", (rho * F.col("x") + (1 - rho**2) ** 0.5 * F.col("e")).alias("y"))
    assert adjust.variance_reduction(df, "y", "x").first()[0] == pytest.approx(rho**2, abs=0.01)


def test_trend_is_null_when_a_day_lacks_an_arm(spark):
    rows = [(d, a, c) for d in range(8) for a in ("control", "treatment") for c in (0, 1, 1)]
    whole = trend.novelty_trend(panels.daily_panel(spark.createDataFrame(rows, "day int, arm string, converted int"))).first()
    assert whole.days == 8 and whole.slope == pytest.approx(0) and whole.half_gap == pytest.approx(0)
    part = [r for r in rows if not (r[0] == 3 and r[1] == "control")]
    gone = trend.novelty_trend(panels.daily_panel(spark.createDataFrame(part, "day int, arm string, converted int"))).first()
    assert gone.days == 8 and gone.slope is None and gone.trend_z is None and gone.half_gap is None
    single = trend.novelty_trend(panels.daily_panel(spark.createDataFrame(rows[:6], "day int, arm string, converted int"))).first()
    assert single.days == 1 and single.slope is None


def looks_of(spark, n=30, days=10):
    rows = spark.range(n * days).selectExpr(
        f"CAST(id % {n} AS INT) AS e", f"CAST(id DIV {n} AS INT) AS day", "80 + abs(hash(id)) % 40 AS conv_c",
        "2000L AS n_c", "100 + abs(hash(id, 1)) % 40 AS conv_t", "2000L AS n_t")
    return sequential.look_zscores(sequential.cumulative_looks(rows, ["e"]))


def test_msprt_is_monotone_and_boundaries_fall(spark):
    rows = sequential.with_msprt(looks_of(spark), 0.005, ["e"]).orderBy("e", "look").collect()
    by = {}
    for r in rows:
        assert 0 <= r.msprt_p <= 1 and r.msprt_p <= by.get(r.e, 1.0) + 1e-12
        by[r.e] = r.msprt_p
    b = [r.b for r in spark.range(1, 6).selectExpr(f"{sequential.obf_boundary(2.04, 'id', 5)} AS b").collect()]
    assert b == sorted(b, reverse=True) and b[-1] == pytest.approx(2.04)


def test_stopping_rules_report_first_crossing(spark):
    rows = [(1, d, 100, 2000, 101 if d < 3 else 220, 2000) for d in range(5)]
    panel = spark.createDataFrame(rows, "e int, day int, conv_c long, n_c long, conv_t long, n_t long")
    looks = sequential.look_zscores(sequential.cumulative_looks(panel, ["e"]))
    r = sequential.stopping_rules(looks, ["e"], 5, 2.04, 0.005).first()
    assert r.naive_peeking == 4 and r.fixed_horizon == 5 and r.obrien_fleming >= 4
    s = {x.rule: x for x in sequential.summarise_rules(sequential.stopping_rules(looks, ["e"], 5, 99.0, 0.005), 5).collect()}
    assert s["obrien_fleming"].reject_rate == 0 and s["obrien_fleming"].avg_looks_used == 5


def test_stratified_effect_skips_days_without_an_arm(spark):
    rows = [(0, "control", 0), (0, "control", 1), (0, "treatment", 1), (1, "control", 1)]
    panel = panels.daily_panel(spark.createDataFrame(rows, "day int, arm string, converted int"))
    assert adjust.stratified_effect(panel).first()[0] == pytest.approx(0.5)


def test_best_segment_and_variants(spark):
    rows = [("a", 10, 100, 12, 100), ("b", 10, 100, 30, 100), ("c", 10, 100, 1, 100), ("d", 0, 0, 5, 50)]
    panel = spark.createDataFrame(rows, "segment string, conv_c long, n_c long, conv_t long, n_t long")
    scan = multiplicity.segment_scan(panel)
    assert multiplicity.best_segment(scan).first().segment == "b"
    assert {r.segment: r.z for r in scan.collect()}["d"] is None
    units = spark.range(900).selectExpr("element_at(array('none', 'x', 'y'), CAST(id % 3 AS INT) + 1) AS label",
                                        "IF(id % 3 = 1 AND id % 2 = 0, 1, 0) AS converted")
    got = {r.label: r for r in multiplicity.multi_variant_vs_control(units, "label", "none").collect()}
    assert got["x"].holm_reject and not got["y"].holm_reject and got["y"].p_value == 1


def test_validation_and_missing_columns(spark):
    df = spark.createDataFrame([("control", 1), ("other", 2), (None, 0)], "arm string, converted int")
    r = ingest.validate_units(df).first()
    assert (r.n_rows, r.missing, r.bad_arm, r.bad_converted) == (3, "", 2, 1)
    with pytest.raises(ValueError, match="converted"):
        ingest.require_columns(df.drop("converted"))


def base_units(spark, n=20000, rate=0.1):
    return spark.range(n).withColumn("code", unit_code(F.col("id"))).selectExpr(
        "id AS unit_id", "code", "CAST(id % 14 AS INT) AS day", f"IF(abs(hash(id, 5)) % 1000 < {int(rate * 1000)}, 1, 0) AS converted",
        "100D AS amount", "CAST(id % 2 AS INT) AS engaged")


def arm_rate(rows, arm):
    return rows.where(F.col("arm") == arm).agg(F.avg("converted")).first()[0]


@pytest.mark.parametrize("lift", [0.3, -0.3])
def test_injected_lift_is_recovered(spark, lift):
    rows = assign.inject(replay.over_scenarios(base_units(spark), [{"lift": lift}], 20), {"lift"})
    base = base_units(spark).agg(F.avg("converted")).first()[0]
    assert arm_rate(rows, "treatment") / base - 1 == pytest.approx(lift, abs=0.02)
    assert arm_rate(rows, "control") == pytest.approx(base, rel=0.02)


def test_injected_defects(spark):
    u = base_units(spark)
    drop = assign.inject(replay.over_scenarios(u, [{"srm_drop_rate": 0.1}], 5), {"drop"})
    n = {r.arm: r["count"] for r in drop.groupBy("arm").count().collect()}
    assert n["treatment"] / n["control"] == pytest.approx(0.9, abs=0.02)
    assert drop.where("arm = 'treatment' AND engaged = 0").count() < drop.where("arm = 'treatment' AND engaged = 1").count()
    ramp = assign.inject(replay.over_scenarios(u, [{"ramp_days": 2, "ramp_treat_share": 0.1}], 5), {"ramp"})
    early = ramp.where("day < 2").agg(F.avg((F.col("arm") == "treatment").cast("int"))).first()[0]
    assert early == pytest.approx(0.1, abs=0.01)
    sale = assign.inject(replay.over_scenarios(u, [{"daily_base": [0.3] * 3 + [0.05] * 11}], 5), {"base"})
    by = {r.day: r.c for r in sale.groupBy("day").agg(F.avg("converted").alias("c")).collect()}
    assert by[0] == pytest.approx(0.3, abs=0.03) and by[9] == pytest.approx(0.05, abs=0.02)
    whale = assign.inject(replay.over_scenarios(u, [{"whale_rate": 0.2, "whale_multiplier": 50.0}], 5), {"whale"})
    big = whale.where("converted = 1").agg(F.avg((F.col("revenue") > 100).cast("int"))).first()[0]
    assert big == pytest.approx(0.2, abs=0.03)


def test_null_rates_stay_near_five_percent(spark):
    r = replay.aa_replay(base_units(spark, 6000), 400, ["converted"]).first()
    assert 0.025 < r.false_positive_rate < 0.08 and r.runs == 400
    looks = {x.looks: x.false_positive_rate for x in replay.peeking_by_looks(
        base_units(spark, 6000).withColumn("slot", F.expr("CAST(unit_id % 56 AS INT)")), 400, looks=(1, 14)).collect()}
    assert looks[1] < 0.09 and looks[14] > 0.12


def test_bootstrap_brackets_the_difference(spark):
    u = base_units(spark, 4000).selectExpr("code", "IF(unit_id % 2 = 0, 'control', 'treatment') AS arm",
                                           "CAST(abs(hash(unit_id, 3)) % 100 AS DOUBLE) + IF(unit_id % 2 = 0, 0, 5) AS y")
    r = hypothesis.bootstrap_diff_ci(u, "y", n_boot=300).first()
    assert r.ci_low < 5 < r.ci_high and r.replicates == 300
    w = hypothesis.welch_ttest(u, "y").first()
    assert (r.ci_high - r.ci_low) == pytest.approx(w.ci_high - w.ci_low, rel=0.2)


def test_wide_ancova_with_sixty_covariates(spark):
    rng = np.random.default_rng(12)
    n, k = 4000, 60
    x = rng.normal(size=(n, k)) * rng.uniform(0.1, 1000, k) + rng.uniform(-1e4, 1e4, k)
    t = rng.integers(0, 2, n)
    y = np.column_stack([0.3 * t + x @ rng.normal(size=k) / 500 + rng.normal(size=n) * (1 + t), rng.normal(size=n)])
    cols = [f"c {i}" for i in range(k)]
    pdf = pd.DataFrame(x, columns=cols).assign(arm=np.where(t == 1, "treatment", "control"), y=y[:, 0], order=y[:, 1], g=np.where(rng.random(n) < 0.9, "big", None))
    pdf.loc[7, "c 3"] = None
    got = {(r.g, r.metric): r for r in adjust.ancova_wide(spark.createDataFrame(pdf).repartition(7), ["y", "order"], cols, ["g"]).collect()}
    whole = {r.metric: r for r in adjust.ancova_wide(spark.createDataFrame(pdf), ["y", "order"], cols).collect()}
    for rows, r in ((pdf["g"].eq("big"), lambda m: got["big", m]), (pdf["c 3"].notna(), lambda m: whole[m])):
        rows = (rows & pdf["c 3"].notna()).to_numpy()
        z = np.column_stack([np.ones(rows.sum()), t[rows], x[rows] - x[rows].mean(axis=0)])
        inv = np.linalg.inv(z.T @ z)
        for j, m in enumerate(("y", "order")):
            b = inv @ (z.T @ y[rows, j])
            e = y[rows, j] - z @ b
            v = inv @ (z.T * (e * e)) @ z @ inv * len(z) / (len(z) - k - 2)
            assert r(m).users == len(z) and np.isclose(r(m).effect, b[1], rtol=1e-6) and np.isclose(r(m).se, v[1, 1] ** 0.5, rtol=1e-6)


def test_wide_ancova_leaves_its_sums_to_batches(spark):
    """No filter repeats the columns' expressions, and both passes read Arrow batches; incomplete rows and null keys stay as they were."""
    rng = np.random.default_rng(5)
    rows = [("treatment" if a < 0.5 else "control", float(y), None if i % 9 == 0 else float(x), "g" if i % 4 else None) for i, (a, y, x) in enumerate(rng.random((200, 3)))]
    df = spark.createDataFrame(rows, "arm string, y double, x double, k string").repartition(3)
    out = adjust.ancova_wide(df.withColumn("z", F.expr("pmod(xxhash64(x), 7)")), ["y"], ["x", "z"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "atleastnnonnulls" not in plan.lower()
    assert out.first().users == sum(x is not None for _, _, x, _ in rows)
    keyed = {r.k: r for r in adjust.ancova_wide(df, ["y"], ["x"], ["k"]).collect()}
    assert keyed["g"].users == sum(x is not None and k == "g" for _, _, x, k in rows) and keyed["g"].se > 0
    assert keyed[None].users is None and keyed[None].effect is None
    none = adjust.ancova_wide(df.where("x > 5"), ["y"], ["x"]).collect()
    assert [(r.metric, r.users, r.se) for r in none] == [("y", None, None)]
