"""Hypothesis tests, adjustment, trend and multiplicity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import adjust, hypothesis, multiplicity, panels, planning, replay, trend
from trialspark.operators.assign import assign_arms
from trialspark.reports import tidy
from trialspark.reports.tables import LINE_COVARIATES
from trialspark.sources.units import (coded_orders, customer_units, event_units, line_units, order_units, salted_arm, table,
                                      three_arm_units, with_code)


def _treat(units: DataFrame) -> DataFrame:
    return units.withColumn("treat", F.when(F.col("arm") == "treatment", 1).otherwise(0))


def two_prop_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hypothesis.two_prop_ztest(order_units(spark, sf_dir, customers=True), ["segment"]))


def ztest_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hypothesis.ztest_sql(_treat(order_units(spark, sf_dir))), 9)


def welch_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, customers=True)
    return tidy(hypothesis.welch_ttest(units, "amount", ["segment"]), effect=2, se=2, ci_low=1, ci_high=1, dof=2)


def delta_method_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click rate per session: purchases per event by user, urgent orders by customer."""
    users = panels.ratio_rollup(event_units(spark, sf_dir)).withColumn("source", F.lit("events"))
    cust = customer_units(spark, sf_dir).withColumn("source", F.lit("orders"))
    both = users.select("source", "arm", "sessions", "clicks").unionByName(
        cust.select("source", "arm", "sessions", "clicks"))
    return tidy(hypothesis.delta_method_ratio(both, "clicks", "sessions", ["source"]))


def session_level_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = panels.ratio_rollup(event_units(spark, sf_dir))
    return tidy(hypothesis.session_level_ztest(users, "clicks", "sessions"))


def srm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even split against 50%, and an 85% split against 85% and 50%."""
    even = hypothesis.srm_test(order_units(spark, sf_dir), expected_share=0.5)
    uneven = order_units(spark, sf_dir, share=0.85, salt="fx5:")
    parts = [even.withColumn("design", F.lit("even")),
             hypothesis.srm_test(uneven, expected_share=0.85).withColumn("design", F.lit("uneven")),
             hypothesis.srm_test(uneven, expected_share=0.5).withColumn("design", F.lit("uneven_as_even"))]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def srm_check_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _treat(order_units(spark, sf_dir, share=0.85, salt="fx5:"))
    return tidy(hypothesis.srm_check_sql(units, share=0.85))


def bootstrap_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = coded_orders(spark, sf_dir)
    return tidy(hypothesis.bootstrap_diff_ci(units, "revenue", n_boot=200), 3)


def winsorize_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their value and its capped form."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    capped = hypothesis.winsorize_pooled(events, "value", 0.99)
    return tidy(capped.select("event_id", "value", "cap", "value_w"))


def outlier_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = hypothesis.outlier_sensitivity(order_units(spark, sf_dir).select("arm", F.col("revenue").alias("y")), "y")
    val = hypothesis.outlier_sensitivity(event_units(spark, sf_dir).select("arm", F.col("value").alias("y")), "y")
    both = rev.withColumn("source", F.lit("orders")).unionByName(val.withColumn("source", F.lit("events")))
    return tidy(both, raw_effect=3, win_effect=3)


def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hypothesis.top_share(table(spark, sf_dir, "events"), "value", 0.001))


def ks_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = replay.replay_pvalues(with_code(order_units(spark, sf_dir)), 200)
    return tidy(hypothesis.ks_uniform(p))


def ci_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = coded_orders(spark, sf_dir)
    return tidy(replay.known_effect_coverage(units, (0.0, 0.05, 0.10, 0.20), 40))


def cuped_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, customers=True)
    rows = adjust.cuped_adjust(units, "amount", "x_strong")
    return tidy(rows.select("unit_id", "arm", "adjusted", "theta"), adjusted=2)


def cuped_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, customers=True)
    return tidy(adjust.cuped_test(units, "amount", "x_strong", ["segment"]),
                effect=2, se=2, ci_low=1, ci_high=1, dof=2)


def cuped_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(adjust.cuped_by_arm(order_units(spark, sf_dir, customers=True), "amount", "x_strong"),
                mean_raw=2, mean_cuped=2, var_raw=-3, var_cuped=-3)


def variance_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, customers=True)
    strong = adjust.variance_reduction(units, "amount", "x_strong", ["segment"]).withColumn("covariate", F.lit("x_strong"))
    weak = adjust.variance_reduction(units, "amount", "pre_x", ["segment"]).withColumn("covariate", F.lit("pre_x"))
    return tidy(strong.unionByName(weak))


def ancova_hc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(adjust.ancova_hc1(line_units(spark, sf_dir), "converted", ["quantity", "discount"]), 8, p_value=6)


WIDE_COVARIATES = {
    "line": "l_linenumber", "discount": "l_discount", "tax": "l_tax", "price": "l_extendedprice / 1000", "year": "year(l_shipdate)",
    "month": "month(l_shipdate)", "day": "day(l_shipdate)", "weekday": "pmod(datediff(l_shipdate, DATE '1995-01-01'), 7)",
    "supplier": "l_suppkey % 10", "part": "l_partkey % 7", "order": "l_orderkey % 5", "open": "IF(l_linestatus = 'O', 1, 0)"}


def ancova_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve covariates and two outcomes of the order lines in one adjustment."""
    lines = table(spark, sf_dir, "lineitem").select(
        salted_arm("fx7:", F.col("l_orderkey")).alias("arm"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("converted"), F.col("l_quantity").alias("quantity"),
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in WIDE_COVARIATES.items()])
    return tidy(adjust.ancova_wide(lines, ["converted", "quantity"], list(WIDE_COVARIATES)), p_value=6)


def ancova_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, customers=True)
    return tidy(adjust.ancova_summary(units, "amount", ["x_strong"]),
                raw_effect=2, raw_se=2, ancova_effect=2, ancova_se=2)


def smd_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(adjust.smd_table(line_units(spark, sf_dir), LINE_COVARIATES))


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Randomized arms, and the same arms after a covariate shift in one."""
    from trialspark.operators.assign import perturb_covariate
    units = line_units(spark, sf_dir)
    ok = adjust.balance_check(units, LINE_COVARIATES).withColumn("design", F.lit("randomized"))
    bad = adjust.balance_check(perturb_covariate(units, "quantity", 1.15), LINE_COVARIATES)
    return tidy(ok.unionByName(bad.withColumn("design", F.lit("shifted"))))


def stratified_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By-day effect next to the pooled one, for a ramped assignment."""
    units = assign_arms(order_units(spark, sf_dir), "ramp:", 0.5, ramp_days=3, ramp_share=0.1)
    panel = panels.daily_panel(units)
    strat = adjust.stratified_effect(panel).withColumn("_one", F.lit(1))
    pooled = hypothesis.two_prop_ztest(units).select(F.col("effect").alias("pooled_effect"), F.lit(1).alias("_one"))
    return tidy(strat.join(F.broadcast(pooled), "_one").drop("_one"), 9)


def novelty_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panels.daily_panel(order_units(spark, sf_dir).withColumn("source", F.lit("orders")), ["source"])
    events = panels.daily_panel(event_units(spark, sf_dir).withColumn("source", F.lit("events")), ["source"])
    return tidy(trend.novelty_trend(orders.unionByName(events), ["source"]), slope=9)


def window_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(trend.window_estimates(panels.daily_panel(order_units(spark, sf_dir))))


METRICS = tuple(
    [(f"priority_{p[0]}", f"priority = '{p}'") for p in
     ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
    + [(f"status_{s}", f"order_status = '{s}'") for s in ("F", "O", "P")]
    + [(f"day_{d}", f"day = {d}") for d in (0, 1, 2, 3)]
    + [(f"over_{a}k", f"amount > {a * 1000}") for a in (50, 100, 150, 200, 250, 300, 350, 400)]
    + [(f"day_{d}", f"day = {d}") for d in range(4, 14)] + [(f"over_{a}k", f"amount > {a * 1000}") for a in range(20, 270, 10) if a % 50])


def metric_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order units with fifty 0/1 metrics."""
    return with_code(order_units(spark, sf_dir)).select("unit_id", "code", "arm",
                                   *[F.expr(c).cast("int").alias(n) for n, c in METRICS])


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_pvalues(metric_units(spark, sf_dir), 20, [n for n, _ in METRICS[:20]]).select("replay", "metric_no", "metric", "p_value")


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(multiplicity.holm(_family(spark, sf_dir), ["replay"]))


def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(multiplicity.benjamini_hochberg(_family(spark, sf_dir), ["replay"], alpha=0.2))


def large_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines by arm, one test per part: all parts are one family, which grows with the table."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), salted_arm("fx7:", F.col("l_orderkey")).alias("arm"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("converted"))
    tests = hypothesis.two_prop_ztest(lines, ["part"]).select("part", "p_value")
    judged = multiplicity.benjamini_hochberg(multiplicity.holm(tests, (), alpha=0.5), (), alpha=0.9)
    return tidy(judged)


def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.segment_panel(order_units(spark, sf_dir, customers=True), "nation")
    return tidy(multiplicity.segment_scan(panel, "nation"))


def best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.segment_panel(order_units(spark, sf_dir, customers=True), "nation", ["segment"])
    scan = multiplicity.segment_scan(panel, "nation", ["segment"])
    return tidy(multiplicity.best_segment(scan, "nation", ["segment"]))


def bonferroni_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.segment_panel(order_units(spark, sf_dir, customers=True), "nation")
    scan = multiplicity.segment_scan(panel, "nation")
    return tidy(multiplicity.bonferroni_segments(scan).select("nation", "z", "n_segments", "bonferroni"))


def multi_variant_vs_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(multiplicity.multi_variant_vs_control(three_arm_units(spark, sf_dir), "label", "none"))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline rate, spread, traffic and covariate gain per segment."""
    units = order_units(spark, sf_dir, customers=True)
    return units.groupBy("segment").agg(
        F.count(F.lit(1)).alias("users"), F.avg("converted").alias("base_rate"),
        F.stddev_samp("amount").alias("sd_amount"),
        (F.count(F.lit(1)) / F.count_distinct("day")).alias("users_per_day"),
        (F.corr("amount", "x_strong") * F.corr("amount", "x_strong")).alias("cuped_gain"))


def power_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days per segment and detectable effect, with and without CUPED."""
    base = _baseline(spark, sf_dir).select("segment", "base_rate", "users_per_day", "cuped_gain")
    df = base.selectExpr("*", "explode(array(0.05D, 0.10D, 0.20D)) AS mde_rel")
    df = df.withColumn("n_per_arm", F.expr(planning.size_sql("base_rate", "mde_rel")))
    df = df.withColumn("n_cuped", F.expr("ceil(n_per_arm * (1 - cuped_gain))"))
    return tidy(df.selectExpr("*", f"{planning.days_sql('n_per_arm', 'users_per_day')} AS days",
                              f"{planning.days_sql('n_cuped', 'users_per_day')} AS days_cuped"))


def mde_achieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = panels.arm_totals(order_units(spark, sf_dir, customers=True), ["segment"])
    rates = totals.selectExpr("segment", "conv_c / n_c AS base_rate", "least(n_c, n_t) AS n_per_arm")
    return tidy(rates.selectExpr("*", f"{planning.mde_sql('base_rate', 'n_per_arm')} AS mde_rel"))


def sample_size_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per arm to see a 2% change of the mean order value, raw and adjusted."""
    units = order_units(spark, sf_dir, customers=True)
    stats = units.groupBy("segment").agg(F.avg("amount").alias("m"), F.stddev_samp("amount").alias("sd"),
                                         F.corr("amount", "x_strong").alias("rho"))
    return tidy(stats.selectExpr(
        "segment", f"{planning.size_means_sql('sd', '0.02 * m')} AS n_raw",
        f"{planning.size_means_sql('(sd * sqrt(1 - rho * rho))', '0.02 * m')} AS n_cuped"))


def days_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days for 20,000 users per arm at the measured traffic, by treatment share."""
    base = _baseline(spark, sf_dir).select("segment", "users_per_day")
    return tidy(base.selectExpr("segment", "users_per_day", *[
        f"{planning.days_sql('20000', 'users_per_day', s)} AS days_{int(s * 100)}" for s in (0.5, 0.8)]))


QUERIES = {f.__name__: f for f in (
    two_prop_ztest, ztest_sql, welch_ttest, delta_method_ratio, session_level_ztest, srm_test, srm_check_sql,
    bootstrap_diff_ci, winsorize_pooled, outlier_sensitivity, top_share, ks_uniform, ci_coverage, cuped_adjust,
    cuped_test, cuped_by_arm, variance_reduction, ancova_hc1, ancova_wide, ancova_summary, smd_table, balance_check,
    stratified_effect, novelty_slope, window_estimates, holm, benjamini_hochberg, segment_scan, best_segment, large_family,
    bonferroni_segments, multi_variant_vs_control, power_plan, mde_achieved, sample_size_means, days_needed)}
