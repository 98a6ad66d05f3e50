"""Audit of shipping decisions over a portfolio of experiments.

A unit belongs to the quarter it arrived in and takes part in every experiment
of that quarter.  Which scenario an experiment has is a pure function of
(portfolio, quarter, experiment), computed on the row: no join carries it.  One
pass at (experiment, day, segment) grain feeds both analysts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialspark.functions.draws import uniform_sql, unit_code
from trialspark.functions.stats import div, p_norm, pooled_z, ratio, with_welch, z_crit
from trialspark.operators.assign import SCENARIO_DEFAULTS, base_rates, inject, scenario_rows
from trialspark.operators.groupstats import attach
from trialspark.operators.panels import with_rates
from trialspark.operators.replay import nested_level
from trialspark.operators.sequential import COUNTS, cumulative_looks, look_zscores
from trialspark.operators.trend import novelty_trend
from trialspark.sources.ingest import materialize
from trialspark.plans.health import NO_WIN, assemble, day_moments, roll_up

# Scenario mix (share, lift range, switches) and economics.
# traffic_share is the scenario's users per day over the default 6,000.
SCENARIOS = {
    "true_win": {"share": 0.25, "lift_lo": 0.08, "lift_hi": 0.16},
    "true_null": {"share": 0.40},
    "small_win_underpowered": {"share": 0.10, "lift_lo": 0.04, "lift_hi": 0.04, "traffic_share": 0.25},
    "novelty_only": {"share": 0.10, "novelty_boost": 0.30, "novelty_halflife": 3.0},
    "srm_bug": {"share": 0.10, "srm_drop_rate": 0.04},
    "noisy_revenue": {"share": 0.05, "whale_rate": 0.005},
}
N_EXPERIMENTS = 40
PLANNED_MDE_REL = 0.10
ECONOMICS = {
    "monthly_active_users": 2_000_000, "baseline_conversion": 0.05, "avg_order_value": 1000,
    "contribution_margin": 0.10, "cost_per_false_win": 500_000, "rerun_delay_months": 3,
    "months_lost_if_abandoned": 12,
}
WINNING = ("true_win", "small_win_underpowered")
CATALOG_DEFAULTS = {"lift_lo": 0.0, "lift_hi": 0.0, "traffic_share": 1.0,
                    **{k: SCENARIO_DEFAULTS[k] for k in ("novelty_boost", "novelty_halflife", "srm_drop_rate",
                                                         "whale_rate", "whale_multiplier")}}


def scenario_catalog(spark: SparkSession, scenarios: Mapping[str, Mapping] = SCENARIOS) -> DataFrame:
    """Catalog rows: overrides of a scenario, defaults elsewhere."""
    fields = list(CATALOG_DEFAULTS)
    rows = [(i, name, float(s["share"]), *[s.get(f) for f in fields])
            for i, (name, s) in enumerate(scenarios.items())]
    schema = "scenario_no int, scenario string, share double, " + ", ".join(f"{f} double" for f in fields)
    raw = spark.createDataFrame(rows, schema)
    return raw.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in CATALOG_DEFAULTS.items()})


def scenario_shares(catalog: DataFrame, true_win_share: float | None = None) -> DataFrame:
    """Shares and their cumulative bounds; optionally fix the share of true wins
    and scale the others to the rest.  The window spans the catalog's few rows."""
    everything = Window.partitionBy()
    share = F.col("share")
    if true_win_share is not None:
        others = F.sum(F.when(F.col("scenario") != "true_win", share)).over(everything)
        share = F.when(F.col("scenario") == "true_win", F.lit(true_win_share)).otherwise(
            share * (1 - true_win_share) / others)
    out = catalog.withColumn("share", share)
    upto = Window.orderBy("scenario_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_hi", F.sum("share").over(upto)).withColumn("cum_lo", F.col("cum_hi") - F.col("share"))


def _cut_points(scenarios: Mapping[str, Mapping], true_win_share: float | None) -> list[float]:
    shares = {n: s["share"] for n, s in scenarios.items()}
    if true_win_share is not None:
        rest = sum(v for n, v in shares.items() if n != "true_win")
        shares = {n: true_win_share if n == "true_win" else v * (1 - true_win_share) / rest
                  for n, v in shares.items()}
    cuts, acc = [], 0.0
    for v in list(shares.values())[:-1]:
        acc += v
        cuts.append(acc)
    return cuts


def portfolio_draw(rows: DataFrame, scenarios: Mapping[str, Mapping] = SCENARIOS, *,
                   n_experiments: int = N_EXPERIMENTS, true_win_share: float | None = None, seed: int = 1,
                   true_win_shares: Sequence[float] = ()) -> DataFrame:
    """Repeat rows over the experiments of their quarter and draw a scenario and
    a true lift for each (quarter, experiment).  With ``true_win_shares`` an
    experiment stands once for each scenario that it has under any of them."""
    df = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_experiments - 1))).alias("exp"))
    df = df.withColumn("_code", unit_code(F.col("quarter").cast("bigint") * n_experiments + F.col("exp")))
    fields = [{"scenario": n, **{f: s.get(f, v) for f, v in CATALOG_DEFAULTS.items()}} for n, s in scenarios.items()]
    df = df.selectExpr("*", f"{uniform_sql('label', seed, '_code')} AS _us", f"{uniform_sql('lift', seed, '_code')} AS _ul")
    pick = nested_level("_us", _cut_points(scenarios, true_win_share))
    if true_win_shares:
        picks = ", ".join(nested_level("_us", _cut_points(scenarios, x)) for x in true_win_shares)
        df, pick = df.selectExpr("*", f"explode(array_distinct(array({picks}))) AS _pick"), "_pick"
    df = df.withColumn("_s", F.expr(f"element_at({scenario_rows(fields)}, {pick} + 1)"))
    plain = [f for f in CATALOG_DEFAULTS if f not in ("lift_lo", "lift_hi")]
    df = df.selectExpr(*rows.columns, "exp", "_s.lift_lo + (_s.lift_hi - _s.lift_lo) * _ul AS lift", "_s.scenario AS scenario",
                       *[f"_s.{f} AS {f}" for f in plain])
    winning = ", ".join(f"'{w}'" for w in WINNING)
    return df.withColumn("true_win", F.expr(f"lift > 0 AND scenario IN ({winning})"))


def experiment_rows(units: DataFrame, *, seed: int = 1, n_experiments: int = N_EXPERIMENTS, **draw) -> DataFrame:
    """Randomized, injected unit rows of the whole portfolio.  ``units`` needs
    ``quarter, code, day, segment, converted, engaged, amount``."""
    rows = portfolio_draw(attach(units, base_rates(units), ()), seed=seed, n_experiments=n_experiments, **draw)
    rows = rows.withColumn("replay", F.col("quarter") * n_experiments + F.col("exp") + seed * 100_003)
    rows = rows.where(f"{uniform_sql('sample', 'replay')} < traffic_share")
    return inject(rows, {"lift", "novelty", "drop", "whale"})


EXP = ("quarter", "exp")
TRUTH = ("scenario", "lift", "true_win")


def experiment_cells(rows: DataFrame, keys: Sequence[str] = EXP) -> DataFrame:
    """The one aggregation: counts and revenue moments per experiment, day, segment."""
    return day_moments(rows, [*keys, *(c for c in TRUTH if c not in keys), "segment"], ["revenue"])


def _sum_counts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def naive_decisions(cells: DataFrame, keys: Sequence[str] = EXP) -> DataFrame:
    """Analyst who looks daily, then at revenue, then at segments, and ships the
    first win found; reports the lift of what was looked at."""
    keys = list(keys)
    looks = look_zscores(cumulative_looks(_sum_counts(cells, [*keys, "day"]), keys))
    seen = f"struct(look, {div('(p_t - p_c)', 'p_c')} AS lift)"
    peek = looks.groupBy(*keys).agg(F.expr(f"min({seen}) FILTER (WHERE z > {z_crit()}D) AS _peek"),
                                    F.expr(f"max({seen}) AS _last"))
    revenue = with_welch(roll_up(cells, keys, ["revenue"]), "revenue").selectExpr(
        *keys, "coalesce(significant AND effect > 0, false) AS _rev")
    p_c, p_t = div("conv_c", "n_c"), div("conv_t", "n_t")
    seg = _sum_counts(cells, [*keys, "segment"]).selectExpr(
        *keys, "segment", f"{pooled_z()} AS z", f"{div(f'({p_t} - {p_c})', p_c)} AS lift")
    seg = seg.groupBy(*keys).agg(F.expr(f"min(struct(segment, lift)) FILTER (WHERE z > 0 AND {p_norm('z')} < 0.05) AS _seg"))
    df = peek.join(revenue, keys).join(seg, keys).withColumn("naive_how", F.expr(
        "CASE WHEN _peek IS NOT NULL THEN 'peek' WHEN _rev THEN 'revenue' WHEN _seg IS NOT NULL THEN 'segment' ELSE 'none' END"))
    return df.selectExpr(*keys, "naive_how <> 'none' AS naive_ship",
                         "CASE naive_how WHEN 'peek' THEN _peek.lift WHEN 'segment' THEN _seg.lift ELSE _last.lift END AS naive_lift",
                         "naive_how")


def rigorous_decisions(cells: DataFrame, keys: Sequence[str] = EXP, planned_mde_rel: float = PLANNED_MDE_REL) -> DataFrame:
    """Analyst with one metric and a fixed horizon who ships on a SHIP verdict."""
    keys = list(keys)
    daily = _sum_counts(cells, [*keys, "day"])
    trend = novelty_trend(with_rates(daily), keys).select(*keys, "days", "trend_z", "half_gap")
    report = assemble(_sum_counts(daily, keys), keys, trend=trend, planned_mde_rel=planned_mde_rel)
    return report.select(*keys, F.col("ship").alias("rigorous_ship"), F.col("rel_lift").alias("rigorous_lift"),
                         F.col("verdict").alias("rigorous_verdict"))


def decision_log(units: DataFrame, *, keys: Sequence[str] = EXP, planned_mde_rel: float = PLANNED_MDE_REL,
                 **draw) -> DataFrame:
    """Decisions of both analysts next to the truth, one row per experiment."""
    keys = list(keys)
    cells = materialize(experiment_cells(experiment_rows(units, **draw), keys), "audit-cells")
    truth = cells.groupBy(*keys).agg(*[F.first(c).alias(c) for c in TRUTH if c not in keys])
    return (truth.join(naive_decisions(cells, keys), keys)
            .join(rigorous_decisions(cells, keys, planned_mde_rel), keys)
            .withColumnRenamed("lift", "true_lift"))


def annual_margin(e: Mapping[str, float]) -> float:
    return (e["monthly_active_users"] * 12 * e["baseline_conversion"] * e["avg_order_value"]
            * e["contribution_margin"])


def quarter_score(log: DataFrame, keys: Sequence[str] = (), *, cost_per_false_win: float | Column | None = None,
                  economics: Mapping[str, float] = ECONOMICS) -> DataFrame:
    """Score of each analyst per quarter: wins, false wins and their costs."""
    e = economics
    cost = e["cost_per_false_win"] if cost_per_false_win is None else cost_per_false_win
    cost = cost if isinstance(cost, Column) else F.lit(float(cost))
    delayed = ~F.col("rigorous_verdict").startswith(NO_WIN.split(" - ")[0])
    sides = F.array(
        F.struct(F.lit("naive").alias("analyst"), F.col("naive_ship").alias("ship"),
                 F.col("naive_lift").alias("reported"), F.lit(float(e["months_lost_if_abandoned"])).alias("months")),
        F.struct(F.lit("rigorous").alias("analyst"), F.col("rigorous_ship").alias("ship"),
                 F.col("rigorous_lift").alias("reported"),
                 F.when(delayed, float(e["rerun_delay_months"])).otherwise(float(e["months_lost_if_abandoned"]))
                 .alias("months")))
    long = log.select(*keys, "quarter", "true_win", "true_lift", cost.alias("_cost"), F.inline(sides))
    ship, win = F.col("ship"), F.col("true_win")
    lost = F.when(win & ~ship, F.col("true_lift") * F.lit(annual_margin(e)) * F.col("months") / 12)
    out = long.groupBy(*keys, "analyst", "quarter").agg(
        F.count_if(ship).alias("shipped"), F.count_if(ship & ~win).alias("false_wins"),
        F.count_if(win & ship).alias("true_wins_shipped"), F.count_if(win & ~ship).alias("true_wins_missed"),
        F.avg(F.when(ship, F.col("reported"))).alias("avg_reported_lift"),
        F.avg(F.when(ship, F.col("true_lift"))).alias("avg_true_lift"),
        F.coalesce(F.sum(F.when(ship & ~win, F.col("_cost"))), F.lit(0.0)).alias("cost_false"),
        F.coalesce(F.sum(lost), F.lit(0.0)).alias("cost_missed"))
    return out.withColumns({"fdr": ratio(F.col("false_wins"), F.col("shipped")),
                            "total_cost": F.col("cost_false") + F.col("cost_missed")})


MEDIANS = ("shipped", "false_wins", "fdr", "true_wins_shipped", "true_wins_missed",
           "cost_false", "cost_missed", "total_cost")


def audit_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Medians over quarters (and mean lifts).  A median gathers one value per
    quarter, so it stays small whatever the number of units."""
    return scores.groupBy(*keys, "analyst").agg(
        *[F.median(c).alias(f"{c}_median") for c in MEDIANS],
        F.avg("avg_reported_lift").alias("avg_reported_lift"), F.avg("avg_true_lift").alias("avg_true_lift"))


def ship_rate_by_scenario(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return log.groupBy(*keys, "scenario").agg(
        F.count(F.lit(1)).alias("experiments"), F.avg(F.col("naive_ship").cast("int")).alias("naive_ship_rate"),
        F.avg(F.col("rigorous_ship").cast("int")).alias("rigorous_ship_rate"))


def break_even_cost(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cost of a false win at which both analysts cost the same; NULL unless the
    naive one has more false wins."""
    of = lambda who, c: F.avg(F.when(F.col("analyst") == who, F.col(c)))
    g = scores.groupBy(*keys).agg(
        (of("naive", "false_wins") - of("rigorous", "false_wins")).alias("extra_false_wins"),
        (of("rigorous", "cost_missed") - of("naive", "cost_missed")).alias("extra_missed_cost"))
    return g.withColumn("break_even_cost", F.when(
        F.col("extra_false_wins") > 0, ratio(F.col("extra_missed_cost"), F.col("extra_false_wins"))))


def _total_cost_medians(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    of = lambda who: F.median(F.when(F.col("analyst") == who, F.col("total_cost")))
    return scores.groupBy(*keys).agg(of("naive").alias("naive_total_cost_median"),
                                     of("rigorous").alias("rigorous_total_cost_median"))


def cost_sensitivity(log: DataFrame, costs: Sequence[float] = (0, 500_000, 2_000_000, 5_000_000)) -> DataFrame:
    """Median total cost per analyst over a grid of false-win costs."""
    grid = log.select("*", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("false_win_cost"))
    scored = quarter_score(grid, ["false_win_cost"], cost_per_false_win=F.col("false_win_cost"))
    return _total_cost_medians(scored, ["false_win_cost"])


def worst_case_rerun(log: DataFrame, economics: Mapping[str, float] = ECONOMICS) -> DataFrame:
    """Median total costs if a rerun were as late as an abandoned idea."""
    worst = {**economics, "rerun_delay_months": economics["months_lost_if_abandoned"]}
    return _total_cost_medians(quarter_score(log, economics=worst), [])


def share_sensitivity(units: DataFrame, shares: Sequence[float] = (0.15, 0.35), **draw) -> DataFrame:
    """Audit medians for other shares of true wins.

    The shares only change which scenario an experiment draws, so each drawn
    scenario is randomized and counted once and serves every share that has it.
    """
    seed, n = draw.get("seed", 1), draw.get("n_experiments", N_EXPERIMENTS)
    scenarios = draw.get("scenarios", SCENARIOS)
    log = decision_log(units, keys=(*EXP, "scenario"), true_win_shares=tuple(shares), **draw)
    log = log.withColumn("_code", unit_code(F.col("quarter").cast("bigint") * n + F.col("exp"))).withColumn("_us", F.expr(uniform_sql("label", seed, "_code")))
    names = ", ".join(f"'{x}'" for x in scenarios)
    drawn = ", ".join(f"named_struct('true_win_share', {float(x)!r}D, '_drawn', element_at(array({names}), {nested_level('_us', _cut_points(scenarios, x))} + 1))" for x in shares)
    logs = log.selectExpr("*", f"inline(array({drawn}))").where("_drawn = scenario").drop("_code", "_us", "_drawn")
    summary = audit_summary(quarter_score(logs, ["true_win_share"]), ["true_win_share"])
    of = lambda who, c: F.max(F.when(F.col("analyst") == who, F.col(f"{c}_median")))
    return summary.groupBy("true_win_share").agg(*[
        of(who, c).alias(f"{who}_{c}_median") for c in ("fdr", "false_wins", "total_cost")
        for who in ("naive", "rigorous")])
