"""Replay studies: re-randomize a real unit table many times and measure how
often each procedure is wrong.

Rows are repeated over replays inside the scan stage and aggregated there, so
the shuffle carries one row per task and (replay, day), never the repeated
units.  Fair splits without an effect are not repeated at all: 64 of them are
counted from one hash of a row (``splits``).  Studies over sample sizes or loss rates use nested levels: a unit is
counted once at the first level it belongs to, and the levels are summed up on
the aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark import CONTROL, TREATMENT
from trialspark.functions.draws import uniform_sql
from trialspark.functions.stats import (norm_ppf, num, pooled_z, ratio, srm_p, two_sided_p, with_prop_test,
                                        with_welch, z_crit)
from trialspark.operators.adjust import raw_and_cuped, stratified_effect
from trialspark.operators.assign import base_rates, inject, scenario_rows
from trialspark.operators.groupstats import attach
from trialspark.operators.hypothesis import bootstrap_diff_ci, ci_coverage, with_delta_method
from trialspark.operators.momenthist import capped_moments
from trialspark.operators.multiplicity import (benjamini_hochberg, best_segment, holm, multi_variant_vs_control,
                                               segment_scan)
from trialspark.operators.panels import arm_moments, arm_totals, daily_panel
from trialspark.operators.planning import size_sql
from trialspark.operators.sequential import (COUNTS, cumulative_looks, look_zscores, obf_calibration, obf_constant, stopping_rules,
                                             summarise_rules, with_msprt)
from trialspark.operators.splits import split_totals
from trialspark.operators.trend import novelty_trend, window_estimates

FLOOR = 1e-12


def over_replays(units: DataFrame, n_replays: int, first: int = 1) -> DataFrame:
    return units.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + n_replays - 1))).alias("replay"))


def over_scenarios(units: DataFrame, scenarios: Sequence[dict], n_replays: int, rates: bool = True,
                   first: int = 1) -> DataFrame:
    """Units x scenarios x replays, with the measured base rates attached."""
    if rates and "base_rate" not in units.columns:
        units = attach(units, base_rates(units), ())
    return over_replays(units.selectExpr("*", f"inline({scenario_rows(scenarios)})"), n_replays, first)


def _rate(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("int"))


def _counts_z(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.expr(pooled_z(floor=FLOOR)))


def metric_totals(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Arm totals of many 0/1 metrics in one pass, unpivoted after aggregation."""
    of = {"c": f"arm = '{CONTROL}'", "t": f"arm = '{TREATMENT}'"}
    wide = rows.groupBy(*keys).agg(
        *[F.expr(f"count_if({cond}) AS n_{s}") for s, cond in of.items()],
        *[F.expr(f"sum(CASE WHEN {cond} THEN {m} END) AS {m}_{s}") for m in metrics for s, cond in of.items()])
    cells = ", ".join(f"named_struct('metric_no', {i}, 'metric', '{m}', 'conv_c', {m}_c, 'conv_t', {m}_t)"
                      for i, m in enumerate(metrics, start=1))
    return wide.selectExpr(*keys, "n_c", "n_t", f"inline(array({cells}))")


def replay_pvalues(units: DataFrame, n_replays: int, metrics: Sequence[str] = ("converted",)) -> DataFrame:
    """One z test per replay and metric under the null."""
    return with_prop_test(split_totals(units, n_replays, metrics))


def aa_replay(units: DataFrame, n_replays: int, metrics: Sequence[str]) -> DataFrame:
    tests = replay_pvalues(units, n_replays, metrics)
    return tests.groupBy("metric").agg(
        F.count(F.lit(1)).alias("runs"), F.max(F.col("n_c") + F.col("n_t")).alias("control_rows"),
        _rate(F.col("significant")).alias("false_positive_rate"))


def known_effect_coverage(units: DataFrame, lifts: Sequence[float], n_replays: int) -> DataFrame:
    rows = inject(over_scenarios(units, [{"lift": x} for x in lifts], n_replays), {"lift"})
    tests = with_prop_test(arm_totals(rows, ["lift", "base_rate", "replay"]))
    tests = tests.withColumn("truth", F.col("base_rate") * F.col("lift"))
    return ci_coverage(tests, "truth", ["lift"])


def replay_looks(units: DataFrame, n_replays: int, scenarios: Sequence[dict], day: str = "day",
                 first: int = 1) -> DataFrame:
    """Cumulative looks with z per (lift, replay)."""
    lifted = any(s.get("lift") for s in scenarios)
    rows = inject(over_scenarios(units, scenarios, n_replays, rates=lifted, first=first), {"lift"} if lifted else ())
    panel = arm_totals(rows, ["lift", "replay", day])
    return look_zscores(cumulative_looks(panel, ["lift", "replay"], day))


def peeking_by_looks(units: DataFrame, n_replays: int, looks: Sequence[int] = (1, 2, 3, 5, 7, 14, 28, 56),
                     slot: str = "slot", slots: int = 56) -> DataFrame:
    """False positives when stopping at the first significant one of k looks at
    equally spaced times of the same total sample."""
    totals = split_totals(units, n_replays, ["converted"], [slot]).drop("metric_no", "metric")
    cumulative = look_zscores(cumulative_looks(totals, ["replay"], slot))
    ends: dict[int, list[int]] = {}
    for k in looks:
        for j in range(1, k + 1):
            ends.setdefault(slots * j // k - 1, []).append(k)
    plan = F.create_map(*[x for s, ks in sorted(ends.items())
                          for x in (F.lit(s), F.array(*[F.lit(k) for k in ks]))])
    seen = cumulative.select("replay", "z", F.explode(F.try_element_at(plan, F.col(slot))).alias("looks"))
    per_run = seen.groupBy("looks", "replay").agg(F.max(F.abs("z")).alias("_z"))
    return per_run.groupBy("looks").agg(F.count(F.lit(1)).alias("runs"),
                                        _rate(F.col("_z") > z_crit()).alias("false_positive_rate"))


def compare_stopping_rules(units: DataFrame, n_replays: int, n_looks: int, rel_lift: float = 0.10,
                           c_obf: float | None = None, tau: float = 0.0025, calibration: int = 0) -> DataFrame:
    """Rejection rate and looks used by rule, without and with an effect, and the
    boundary's constant: given, calibrated on so many further null replays, or
    that of ``n_looks`` equally spaced looks."""
    if c_obf is None and not calibration:
        c_obf = obf_constant(n_looks)
    looks = replay_looks(units, n_replays, [{"lift": 0.0}, {"lift": rel_lift}])
    if c_obf is None:
        null = replay_looks(units, calibration, [{"lift": 0.0}], first=n_replays + 1)
        looks = attach(looks, obf_calibration(null, ["replay"], n_looks).select("c_obf"), ())
    else:
        looks = looks.withColumn("c_obf", F.lit(c_obf))
    stops = stopping_rules(looks, ["lift", "replay", "c_obf"], n_looks, "c_obf", tau)
    return summarise_rules(stops, n_looks, ["lift", "c_obf"])


def msprt_tau_grid(units: DataFrame, n_replays: int, taus: Sequence[float] = (0.0005, 0.001, 0.0025, 0.005, 0.01),
                   rel_lift: float = 0.10) -> DataFrame:
    looks = replay_looks(units, n_replays, [{"lift": 0.0}, {"lift": rel_lift}])
    grid = looks.select("*", F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
    runs = with_msprt(grid, "tau", ["tau", "lift", "replay"]).groupBy("tau", "lift", "replay").agg(
        F.min("msprt_p").alias("_p"))
    hit = F.col("_p") < 0.05
    return runs.groupBy("tau").agg(F.avg(F.when(F.col("lift") == 0, hit.cast("int"))).alias("fpr"),
                                   F.avg(F.when(F.col("lift") > 0, hit.cast("int"))).alias("power"))


def nested_level(u: str, cuts: Sequence[str | float]) -> str:
    """Number of rising cuts that u has reached; u < cuts[i] exactly if i >= level."""
    return "(" + " + ".join(f"CAST({u} >= {c if isinstance(c, str) else num(c)} AS INT)" for c in cuts) + ")"


def with_level(rows: DataFrame, u: str, cuts: Sequence[str | float]) -> DataFrame:
    """Draw u once, then compare it with all cuts."""
    return rows.withColumn("_u", F.expr(u)).withColumn("level", F.expr(nested_level("_u", cuts))).drop("_u")


def msprt_sample_cost(units: DataFrame, n_replays: int, tau: float = 0.005, rel_lift: float = 0.10,
                      multipliers: Sequence[float] = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Power of the always-valid test as the sample grows.  The largest multiplier
    uses the whole table; smaller samples are nested in it."""
    top = max(multipliers)
    rows = inject(over_scenarios(units, [{"lift": rel_lift}], n_replays), {"lift"})
    panel = arm_totals(with_level(rows, uniform_sql("sample", "replay"), [m / top for m in multipliers]), ["replay", "level", "day"])
    last = len(multipliers) - 1
    panel = panel.where(F.col("level") <= last).withColumn(
        "i", F.explode(F.sequence(F.col("level"), F.lit(last)))).groupBy("replay", "i", "day").agg(
        *[F.sum(c).alias(c) for c in COUNTS])
    looks = cumulative_looks(panel, ["i", "replay"])
    runs = with_msprt(looks, tau, ["i", "replay"]).groupBy("i", "replay").agg(F.min("msprt_p").alias("_p"))
    size = F.array(*[F.lit(float(m)) for m in multipliers])[F.col("i")]
    return runs.groupBy(size.alias("sample_multiplier")).agg(
        F.count(F.lit(1)).alias("runs"), _rate(F.col("_p") < 0.05).alias("msprt_power"))


def winners_curse(units: DataFrame, n_replays: int, true_rel_lift: float,
                  target_powers: Sequence[float] = (0.10, 0.20, 0.30, 0.50, 0.70, 0.80, 0.90)) -> DataFrame:
    """Exaggeration of significant estimates for tests sized to a target power.
    Sizes come from the measured base rate; samples are nested.  A table with
    fewer units than a size is flagged; its mean users per arm tell what was drawn."""
    rates = base_rates(units)
    needed = ", ".join(size_sql("base_rate", num(true_rel_lift), power=q) for q in target_powers)
    plan = rates.withColumn("need", F.expr(f"array({needed})"))
    rows = over_replays(attach(units.withColumn("lift", F.lit(true_rel_lift)), plan, ()), n_replays)
    rows = inject(rows, {"lift"})
    cuts = [f"2 * need[{i}]" for i in range(len(target_powers))]
    sized = with_level(rows, f"{uniform_sql('sample', 'replay')} * all_units", cuts)
    panel = arm_totals(sized, ["replay", "level", "need"])
    last = len(target_powers) - 1
    panel = panel.where(F.col("level") <= last).withColumn(
        "i", F.explode(F.sequence(F.col("level"), F.lit(last)))).groupBy("replay", "i", "need").agg(
        *[F.sum(c).alias(c) for c in COUNTS])
    p_c, p_t = ratio(F.col("conv_c"), F.col("n_c")), ratio(F.col("conv_t"), F.col("n_t"))
    runs = _counts_z(panel).withColumns({"_est": ratio(p_t - p_c, p_c), "_sig": F.abs("z") > 1.96})
    est = F.when(F.col("_sig"), F.col("_est"))
    power = F.array(*[F.lit(q) for q in target_powers])[F.col("i")]
    return runs.groupBy(power.alias("target_power"), F.col("need")[F.col("i")].alias("n_per_arm")).agg(
        F.count(F.lit(1)).alias("runs"), F.avg((F.col("n_c") + F.col("n_t")) / 2).alias("avg_users_per_arm"),
        (F.avg(F.col("n_c") + F.col("n_t")) < 1.9 * F.first(F.col("need")[F.col("i")])).alias("table_too_small"),
        _rate(F.col("_sig")).alias("power"), (F.avg(F.abs(est)) / true_rel_lift).alias("exaggeration_ratio"),
        F.avg((est < 0).cast("int")).alias("wrong_sign_share"))


def srm_damage(units: DataFrame, n_replays: int,
               drop_rates: Sequence[float] = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)) -> DataFrame:
    """Fake lift, false positives and detection as a growing share of the
    treatment arm is lost (no true effect)."""
    rows = inject(over_replays(attach(units, base_rates(units), ()), n_replays), ())
    n = len(drop_rates)
    rows = with_level(rows, f"{uniform_sql('drop', 'replay')} * low_share", list(drop_rates))
    level = f"CASE WHEN arm = '{TREATMENT}' AND engaged = 0 THEN level ELSE {n} END"
    panel = arm_totals(rows.withColumn("level", F.expr(level)), ["replay", "level"])
    kept = panel.where(F.col("level") > 0).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("level") - 1))).groupBy("replay", "i").agg(
        *[F.sum(c).alias(c) for c in COUNTS])
    runs = with_prop_test(kept).withColumn("_srm", F.expr(srm_p()) < 0.001)
    rate = F.array(*[F.lit(float(d)) for d in drop_rates])[F.col("i")]
    return runs.groupBy(rate.alias("drop_rate")).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("rel_lift").alias("avg_fake_rel_lift"),
        _rate(F.col("significant")).alias("false_positive_rate"), _rate(F.col("_srm")).alias("srm_detected"))


def srm_detection(units: DataFrame, n_replays: int, drop_rate: float = 0.02,
                  traffic: Sequence[float] = (0.0625, 0.125, 0.25, 0.5, 1.0)) -> DataFrame:
    """Detection of one loss rate by share of the traffic."""
    rows = inject(over_scenarios(units, [{"srm_drop_rate": drop_rate}], n_replays), {"drop"})
    panel = arm_totals(with_level(rows, uniform_sql("sample", "replay"), list(traffic)), ["replay", "level"])
    last = len(traffic) - 1
    sized = panel.where(F.col("level") <= last).withColumn(
        "i", F.explode(F.sequence(F.col("level"), F.lit(last)))).groupBy("replay", "i").agg(
        *[F.sum(c).alias(c) for c in COUNTS])
    share = F.array(*[F.lit(float(t)) for t in traffic])[F.col("i")]
    return sized.groupBy(share.alias("traffic_share")).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("n_c") + F.col("n_t")).alias("avg_units"),
        _rate(F.expr(srm_p()) < 0.001).alias("srm_detected"))


# The four combinations of long-run lift and decaying boost.
NOVELTY_SCENARIOS = (
    {"scenario": "no novelty, no effect", "lift": 0.0, "novelty_boost": 0.0},
    {"scenario": "novelty only", "lift": 0.0, "novelty_boost": 0.20},
    {"scenario": "novelty + real lift", "lift": 0.05, "novelty_boost": 0.20},
    {"scenario": "real lift only", "lift": 0.05, "novelty_boost": 0.0},
)


def novelty_scenarios(units: DataFrame, n_replays: int, halflife: float = 3.0,
                      scenarios: Sequence[dict] = NOVELTY_SCENARIOS) -> DataFrame:
    """Early, full and second-week estimates and the trend flag (one-sided 5%)."""
    full = [{**s, "novelty_halflife": halflife} for s in scenarios]
    rows = inject(over_scenarios(units, full, n_replays), {"lift", "novelty"})
    keys = ["scenario", "lift", "replay"]
    panel = daily_panel(rows, keys)
    wins = window_estimates(panel, keys)
    at = lambda w, c: F.avg(F.when(F.col("window") == w, c))
    sig = F.col("significant").cast("int")
    by_window = wins.groupBy("scenario", "lift").agg(
        at("first_3d", F.col("rel_lift")).alias("est_3d"), at("first_3d", sig).alias("reject_3d"),
        at("first_14d", F.col("rel_lift")).alias("est_14d"),
        at("second_week", F.col("rel_lift")).alias("est_week2"), at("second_week", sig).alias("reject_week2"))
    flags = novelty_trend(panel, keys).groupBy("scenario").agg(
        _rate(F.col("trend_z") < norm_ppf(0.05)).alias("novelty_flagged"))
    return by_window.join(flags, "scenario").withColumnRenamed("lift", "true_long_run_lift")


def any_false_positive(units: DataFrame, metrics: Sequence[str], n_replays: int,
                       metric_grid: Sequence[int] = (1, 2, 3, 5, 10, 20, 50)) -> DataFrame:
    """Chance of at least one false win among the first m metrics."""
    tests = replay_pvalues(units, n_replays, metrics).select("replay", "metric_no", "p_value")
    fam = tests.select("*", F.explode(F.array(*[F.lit(m) for m in metric_grid])).alias("n_metrics"))
    fam = fam.where(F.col("metric_no") <= F.col("n_metrics"))
    key = ["n_metrics", "replay"]
    judged = benjamini_hochberg(holm(fam, key), key)
    runs = judged.groupBy(*key).agg(F.bool_or(F.col("p_value") < 0.05).alias("raw"),
                                    F.bool_or("holm_reject").alias("holm"), F.bool_or("bh_reject").alias("bh"))
    return runs.groupBy("n_metrics").agg(F.count(F.lit(1)).alias("runs"), _rate(F.col("raw")).alias("uncorrected"),
                                         _rate(F.col("holm")).alias("holm"), _rate(F.col("bh")).alias("bh"))


def variant_false_positive(units: DataFrame, n_replays: int, variants: Sequence[int] = (2, 3, 5, 8)) -> DataFrame:
    """Chance of at least one false win when k variants share one control.  The
    ``n_variants`` groups include the control, which is group 0."""
    grid = ", ".join(str(v) for v in variants)
    rows = over_replays(units, n_replays).selectExpr("replay", "converted", "code", f"explode(array({grid})) AS n_variants")
    rows = rows.withColumn("label", F.expr(f"CAST(floor({uniform_sql('label', 'replay')} * n_variants) AS INT)"))
    key = ["n_variants", "replay"]
    tested = multi_variant_vs_control(rows, "label", 0, key)
    runs = tested.groupBy(*key).agg(F.expr("bool_or(p_value < 0.05) AS raw"), F.bool_or("holm_reject").alias("holm"))
    return runs.groupBy("n_variants").agg(F.count(F.lit(1)).alias("runs"), _rate(F.col("raw")).alias("uncorrected"),
                                          _rate(F.col("holm")).alias("holm"))


def segment_hacking(units: DataFrame, segments: dict[str, str], n_replays: int) -> DataFrame:
    """Best of many segments under the null, and its confirmation on fresh arms.
    ``segments`` maps a name to a column; cells are counted once at the finest
    grain and rolled up."""
    cols = list(segments.values())

    def cells(first: int) -> DataFrame:
        fine = arm_totals(inject(over_replays(units, n_replays, first), ()), ["replay", *cols])
        fine = fine.withColumn("replay", F.col("replay") - (first - 1))
        views = F.array(*[F.struct(F.lit(n).alias("slicing"), F.col(c).cast("string").alias("segment"))
                          for n, c in segments.items()])
        return fine.select("replay", *COUNTS, F.inline(views)).groupBy("slicing", "replay", "segment").agg(
            *[F.sum(c).alias(c) for c in COUNTS])

    key = ["slicing", "replay"]
    scan = segment_scan(cells(1), "segment", key)
    per_run = scan.groupBy(*key).agg(F.count(F.lit(1)).alias("n_segments"), F.max(F.abs("z")).alias("_max"))
    best = best_segment(scan, "segment", key).select(*key, "segment", F.abs("rel_lift").alias("_lift"))
    fresh = segment_scan(cells(n_replays + 1), "segment", key).select(*key, "segment", F.col("z").alias("_z2"))
    runs = per_run.join(best, key).join(fresh, [*key, "segment"], "left")
    hit = F.col("_max") > 1.96
    bonf = two_sided_p("_max") < F.lit(0.05) / F.col("n_segments")
    return runs.groupBy("slicing").agg(
        F.max("n_segments").alias("n_segments"), F.count(F.lit(1)).alias("runs"),
        _rate(hit).alias("any_segment_significant"),
        F.avg(F.when(hit, F.col("_lift"))).alias("avg_reported_abs_lift"),
        _rate(bonf).alias("bonferroni_any_significant"),
        F.avg(F.when(hit, (F.abs("_z2") > 1.96).cast("int"))).alias("followup_confirms"))


def heavy_tail_methods(units: DataFrame, n_replays: int, whale_rates: Sequence[float], lifts: Sequence[float],
                       covariate: str, n_boot: int = 50) -> DataFrame:
    """Rejection rate by method on revenue with a share of very large orders."""
    grid = [{"whale_rate": w, "lift": x} for w in whale_rates for x in lifts]
    full = [{**g, "whale_multiplier": 50.0} for g in grid]
    rows = inject(over_scenarios(units, full, n_replays), {"lift", "whale"})
    key = ["whale_rate", "lift", "replay"]
    slim = rows.select(*key, "arm", "code", "revenue", covariate)
    adjusted = raw_and_cuped(slim, "revenue", covariate, key).select(
        *key, F.col("raw_significant").alias("welch"), F.col("cuped_significant").alias("cuped"))
    wins = with_welch(capped_moments(slim, "revenue", 0.99, key), "win").select(
        *key, F.col("significant").alias("winsorized_p99"))
    boot = bootstrap_diff_ci(slim, "revenue", key, n_boot=n_boot)
    boot = boot.select(*key, (~F.lit(0.0).between(F.col("ci_low"), F.col("ci_high"))).alias("bootstrap"))
    runs = adjusted.join(wins, key).join(boot, key, "left")
    methods = ("welch", "winsorized_p99", "cuped", "bootstrap")
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("int").alias("_hit")) for m in methods])
    long = runs.select("whale_rate", "lift", F.inline(cells))
    return long.groupBy("whale_rate", F.col("lift").alias("true_conv_lift"), "method").agg(
        F.count("_hit").alias("runs"), F.avg("_hit").alias("reject_rate"))


def unit_of_analysis(clusters: DataFrame, n_replays: int, keys: Sequence[str] = ("source",)) -> DataFrame:
    """False positives of the session-level test and of the delta method when
    clusters are randomized.  ``clusters`` has one row per cluster with
    ``sessions`` and ``clicks``, already rolled up before the replays."""
    rows = inject(over_replays(clusters, n_replays), ())
    by = [*keys, "replay"]
    m = arm_moments(rows, ["clicks", "sessions"], by, pairs=[("clicks", "sessions")])
    m = with_delta_method(m, "clicks", "sessions")
    m = m.withColumns({
        "conv_c": F.col("clicks_mean_c") * F.col("clicks_n_c"), "n_c": F.col("sessions_mean_c") * F.col("sessions_n_c"),
        "conv_t": F.col("clicks_mean_t") * F.col("clicks_n_t"), "n_t": F.col("sessions_mean_t") * F.col("sessions_n_t")})
    m = m.withColumn("_naive", F.expr(pooled_z()))
    return m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(F.col("clicks_n_c") + F.col("clicks_n_t")).alias("clusters"),
        _rate(F.abs("_naive") > z_crit()).alias("naive_fpr"), _rate(F.col("significant")).alias("delta_fpr"))


def simpson_ramp(units: DataFrame, n_replays: int, days: int = 14, ramp_days: int = 3, ramp_share: float = 0.10,
                 sale_rate: float = 0.08, normal_rate: float = 0.04) -> DataFrame:
    """Pooled against day-stratified effect when a low treatment share meets a
    high-conversion sale (no true effect)."""
    daily = [sale_rate] * ramp_days + [normal_rate] * (days - ramp_days)
    scenario = {"daily_base": daily, "ramp_days": ramp_days, "ramp_treat_share": ramp_share}
    rows = inject(over_scenarios(units, [scenario], n_replays), {"ramp", "base"})
    panel = daily_panel(rows, ["replay"])
    pooled = with_prop_test(panel.groupBy("replay").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    both = pooled.join(stratified_effect(panel, ["replay"]), "replay")
    return both.agg(F.count(F.lit(1)).alias("runs"), F.avg("effect").alias("pooled_avg_effect"),
                    F.avg("stratified_effect").alias("stratified_avg_effect"),
                    _rate(F.col("significant")).alias("pooled_false_positive_rate"))


def cuped_replay(units: DataFrame, n_replays: int, metric: str, covariate: str,
                 lifts: Sequence[float] = (0.0, 0.10)) -> DataFrame:
    """Null rate and power with and without the covariate.  The lift scales the
    metric of treated rows, a known shift of a continuous outcome."""
    rows = inject(over_replays(units.drop("amount").withColumn("_m", F.col(metric)) if metric != "amount"
                               else units.withColumn("_m", F.col("amount")).drop("amount"), n_replays), ())
    rows = rows.select("replay", "arm", "_m", covariate,
                       F.explode(F.array(*[F.lit(float(x)) for x in lifts])).alias("lift"))
    rows = rows.withColumn("_m", F.when(F.col("arm") == TREATMENT, F.col("_m") * (1 + F.col("lift")))
                           .otherwise(F.col("_m")))
    tests = raw_and_cuped(rows, "_m", covariate, ["lift", "replay"])
    return tests.groupBy("lift").agg(F.count(F.lit(1)).alias("runs"),
                                     _rate(F.col("raw_significant")).alias("reject_raw"),
                                     _rate(F.col("cuped_significant")).alias("reject_cuped"))


def cuped_rho_grid(units: DataFrame, metric: str, noise: str,
                   rhos: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 0.9)) -> DataFrame:
    """Measured variance reduction for covariates mixed to a target correlation.
    Two passes whatever the number of targets."""
    scale = units.agg(F.avg(metric).alias("_my"), F.stddev_samp(metric).alias("_sy"),
                      F.avg(noise).alias("_mx"), F.stddev_samp(noise).alias("_sx"))
    z = attach(units.select(metric, noise), scale, ()).select(
        ratio(F.col(metric) - F.col("_my"), F.col("_sy")).alias("_y"),
        ratio(F.col(noise) - F.col("_mx"), F.col("_sx")).alias("_e"))
    mixed = [F.corr(F.col("_y"), F.lit(r) * F.col("_y") + F.lit((1 - r * r) ** 0.5) * F.col("_e")).alias(f"r{i}")
             for i, r in enumerate(rhos)]
    cells = F.array(*[F.struct(F.lit(float(r)).alias("rho"), (F.col(f"r{i}") * F.col(f"r{i}")).alias("measured_reduction"),
                               F.lit(float(r * r)).alias("theory_rho2")) for i, r in enumerate(rhos)])
    return z.agg(*mixed).select(F.inline(cells))
