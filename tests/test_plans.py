"""Health check verdicts and portfolio scores on built cases."""

import pytest
from pyspark.sql import functions as F

from trialspark.plans import audit, health


def experiment(spark, *, days=10, per_day=2000, rate_c=0.10, rate_t=0.13, share_t=0.5, x_shift=0.0, whale=False):
    n = days * per_day
    return spark.range(n).selectExpr(
        f"CAST(id % {days} AS INT) AS day", f"IF(abs(hash(id, 1)) % 10000 < {int(share_t * 10000)}, 'treatment', 'control') AS arm",
        "abs(hash(id, 2)) % 10000 / 10000D AS u", "CAST(abs(hash(id, 3)) % 1000 AS DOUBLE) AS pre_x").selectExpr(
        "day", "arm", f"pre_x + IF(arm = 'treatment', {x_shift}, 0) AS pre_x",
        f"IF(u < IF(arm = 'treatment', {rate_t}, {rate_c}), 1, 0) AS converted",
        f"IF(u < 0.1, 100D, 0D) + IF({whale} AND arm = 'control' AND u < 0.001, 100000D, 0D) AS revenue")


def verdict(df, **kw):
    return health.health_report(df, **kw).first()


def status(row, name):
    return next(c.status for c in row.checks if c.check == name)


def test_clean_win_ships_and_null_does_not(spark):
    r = verdict(experiment(spark), planned_mde_rel=0.2)
    assert r.verdict == health.SHIP and r.ship and [c.check for c in r.checks] == list(health.CHECKS)
    assert verdict(experiment(spark, rate_t=0.10), planned_mde_rel=0.2).verdict == health.NO_WIN
    loss = verdict(experiment(spark, rate_t=0.06), planned_mde_rel=0.2)
    assert loss.significant and loss.verdict == health.NO_WIN


def test_red_beats_yellow(spark):
    r = verdict(experiment(spark, share_t=0.4), planned_mde_rel=0.01)
    assert status(r, "Sample ratio") == "red" and status(r, "Power") == "yellow" and r.verdict == health.DONT_TRUST
    assert verdict(experiment(spark, share_t=0.4), planned_mde_rel=0.2, expected_treat_share=0.4).verdict == health.SHIP


def test_early_stop_needs_a_sequential_method(spark):
    assert verdict(experiment(spark), stopped_early=True).verdict == health.DONT_TRUST
    assert status(verdict(experiment(spark), stopped_early=True, used_sequential=True), "Peeking") == "green"


def test_power_multiple_testing_balance_outliers(spark):
    assert verdict(experiment(spark), planned_mde_rel=0.05).verdict == health.INVESTIGATE
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.04] + [0.3] * 19)], "test_no int, p_value double")
    r = verdict(experiment(spark), pvalues=p)
    assert status(r, "Multiple testing") == "yellow" and "20 tests" in r.checks[3].detail
    assert status(verdict(experiment(spark), pvalues=p.limit(1)), "Multiple testing") == "green"
    assert status(verdict(experiment(spark), covariates=["pre_x"]), "Balance") == "green"
    assert status(verdict(experiment(spark, x_shift=40), covariates=["pre_x"]), "Balance") == "red"
    assert status(verdict(experiment(spark, rate_t=0.2, whale=True), revenue_col="revenue"), "Outliers") in ("green", "yellow")
    assert status(verdict(experiment(spark), revenue_col="absent"), "Outliers") == "green"


def test_novelty_needs_seven_days_and_a_falling_effect(spark):
    falling = experiment(spark, days=10, per_day=6000, rate_t=0.10).withColumn(
        "converted", F.expr("IF(arm = 'treatment' AND day < 3 AND abs(hash(pre_x, day)) % 100 < 8, 1, converted)"))
    assert status(verdict(falling), "Novelty") == "yellow"
    assert status(verdict(falling.where("day < 6")), "Novelty") == "green"
    assert verdict(falling.drop("day")).checks[4].detail.startswith("Days too few")


def test_many_experiments_in_one_job_and_empty_arm(spark):
    a = experiment(spark, per_day=500).withColumn("e", F.lit("a"))
    b = experiment(spark, per_day=500).where("arm = 'control'").withColumn("e", F.lit("b"))
    rep = {r.e: r for r in health.health_report(a.unionByName(b), ["e"], revenue_col="revenue", covariates=["pre_x"]).collect()}
    assert rep["b"].effect is None and rep["b"].verdict == health.DONT_TRUST and len(rep["a"].checks) == 7
    md = health.to_markdown(health.health_report(a, ["e"]), ["e"]).first().markdown
    assert md.startswith("**Verdict: ") and md.count("\n| ") == 8


def test_shares_sum_to_one(spark):
    cat = audit.scenario_catalog(spark)
    for target in (None, 0.15, 0.35):
        s = {r.scenario: r for r in audit.scenario_shares(cat, target).collect()}
        assert sum(r.share for r in s.values()) == pytest.approx(1)
        assert max(r.cum_hi for r in s.values()) == pytest.approx(1)
        if target:
            assert s["true_win"].share == pytest.approx(target)


LOG = "quarter int, exp int, scenario string, true_lift double, true_win boolean, naive_ship boolean, naive_lift double, naive_how string, rigorous_ship boolean, rigorous_lift double, rigorous_verdict string"


def test_scores_costs_and_break_even(spark):
    rows = [(0, 0, "true_win", 0.1, True, True, 0.2, "peek", False, 0.1, health.INVESTIGATE),
            (0, 1, "true_null", 0.0, False, True, 0.1, "segment", False, 0.0, health.NO_WIN),
            (0, 2, "true_win", 0.12, True, False, 0.0, "none", False, 0.1, health.NO_WIN),
            (1, 0, "true_null", 0.0, False, False, 0.0, "none", False, 0.0, health.NO_WIN)]
    log = spark.createDataFrame(rows, LOG)
    s = {(r.analyst, r.quarter): r for r in audit.quarter_score(log).collect()}
    margin = 2_000_000 * 12 * 0.05 * 1000 * 0.10
    n, g = s["naive", 0], s["rigorous", 0]
    assert (n.shipped, n.false_wins, n.fdr, n.true_wins_missed) == (2, 1, 0.5, 1)
    assert n.cost_false == 500_000 and n.cost_missed == pytest.approx(0.12 * margin)
    assert g.cost_missed == pytest.approx(0.1 * margin * 3 / 12 + 0.12 * margin) and g.fdr is None
    assert s["naive", 1].fdr is None and s["naive", 1].avg_reported_lift is None
    summary = {r.analyst: r for r in audit.audit_summary(audit.quarter_score(log)).collect()}
    assert summary["naive"].fdr_median == 0.5 and summary["rigorous"].fdr_median is None
    be = audit.break_even_cost(audit.quarter_score(log)).first()
    assert be.break_even_cost == pytest.approx((g.cost_missed - n.cost_missed) / 2 / 0.5)
    same = log.withColumns({"naive_ship": F.col("rigorous_ship")})
    assert audit.break_even_cost(audit.quarter_score(same)).first().break_even_cost is None
    worst = audit.worst_case_rerun(log).first()
    assert worst.rigorous_total_cost_median == pytest.approx((0.1 + 0.12) * margin / 2)


def test_truth_flags_follow_the_scenario(spark):
    drawn = audit.portfolio_draw(spark.createDataFrame([(q,) for q in range(40)], "quarter int")).collect()
    assert len(drawn) == 1600
    assert all(r.true_win == (r.scenario in audit.WINNING) for r in drawn)
    wins = [r.lift for r in drawn if r.scenario == "true_win"]
    assert 0.20 < len(wins) / 1600 < 0.30 and 0.08 <= min(wins) and max(wins) <= 0.16
