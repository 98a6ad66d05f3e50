"""Health checks of many experiments, and the portfolio audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.draws import uniform_sql
from trialspark.operators import assign, replay
from trialspark.operators.groupstats import attach
from trialspark.plans import audit, health
from trialspark.reports import tidy
from trialspark.sources.ingest import materialize
from trialspark.sources.units import coded_orders, unit_table

N_EXPERIMENTS = 40
CHECKED = ("converted", "visit", "engaged")
# One scenario per experiment, in turn.
DESIGNS = (
    {"lift": 0.0}, {"lift": 0.5}, {"srm_drop_rate": 0.08}, {"novelty_boost": 1.5, "novelty_halflife": 2.0},
    {"whale_rate": 0.02}, {"lift": 0.3, "treat_share": 0.3},
)
EXPERIMENT = ("experiment_id",)


PREPARED = ("unit_id", "code", "day", "converted", "visit", "engaged", "amount", "pre_x", "x_strong")


def prepared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded units of the laid-out table with their base rates."""
    units = coded_orders(spark, sf_dir, customers=True).select(*PREPARED)
    return attach(units, assign.base_rates(units), ())


def many_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders randomized into forty concurrent experiments, each with a design."""
    grid = [{"experiment_id": e, "treat_share": 0.5, **{k: 0.0 for k in ("lift", "novelty_boost", "srm_drop_rate",
             "whale_rate")}, "novelty_halflife": 3.0, "whale_multiplier": 50.0, **DESIGNS[e % len(DESIGNS)]}
            for e in range(N_EXPERIMENTS)]
    rows = prepared_units(spark, sf_dir).selectExpr("*", f"inline({assign.scenario_rows(grid)})")
    return assign.inject(rows, {"lift", "novelty", "drop", "whale"}, replay="experiment_id")


def _settings(spark: SparkSession) -> DataFrame:
    """Plans of the forty experiments: 6 and 7 stopped early, 7 with a
    sequential method; every fourth planned for a 10% effect."""
    rows = [(e, 0.3 if e % len(DESIGNS) == 5 else 0.5, 0.10 if e % 4 == 0 else 0.30, e in (6, 7), e == 7)
            for e in range(N_EXPERIMENTS)]
    return spark.createDataFrame(rows, "experiment_id int, expected_treat_share double, planned_mde_rel double, "
                                       "stopped_early boolean, used_sequential boolean")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = many_experiments(spark, sf_dir)
    tests = replay.with_prop_test(replay.metric_totals(rows, CHECKED, EXPERIMENT))
    pvalues = tests.select("experiment_id", F.col("metric_no").alias("test_no"), "p_value")
    return health.health_report(rows, EXPERIMENT, pvalues=pvalues, revenue_col="revenue", covariates=["pre_x"],
                                settings=_settings(spark))


def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(health.check_rows(_report(spark, sf_dir), EXPERIMENT))


def health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_report(spark, sf_dir).drop("checks"))


def health_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(health.to_markdown(_report(spark, sf_dir), EXPERIMENT))


CARD_CASES = (
    {"scenario": "clean_null"}, {"scenario": "clean_win", "lift": 0.5}, {"scenario": "srm_bug", "srm_drop_rate": 0.10},
    {"scenario": "novelty_only", "novelty_boost": 1.5}, {"scenario": "underpowered", "lift": 0.04, "traffic_share": 0.25},
    {"scenario": "whale_revenue", "lift": 0.10, "whale_rate": 0.05}, {"scenario": "imbalanced_arms", "imbalance": 1.15},
)
CARD_NEUTRAL = {"lift": 0.0, "novelty_boost": 0.0, "novelty_halflife": 3.0, "srm_drop_rate": 0.0, "whale_rate": 0.0,
                "whale_multiplier": 50.0, "traffic_share": 1.0, "imbalance": 1.0}
CARD_REPLAYS = 8


def checker_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(health.detection_rates(_card(spark, sf_dir)))


def clean_ship_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(health.clean_ship_rates(_card(spark, sf_dir)))


def checker_report_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_card(spark, sf_dir))


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each check fires on clean and on broken experiments.  Only the
    whale scenario hands its revenue to the checker."""
    units = prepared_units(spark, sf_dir)
    cases = [{"scenario": c["scenario"], **CARD_NEUTRAL, **c} for c in CARD_CASES]
    rows = replay.over_scenarios(units, cases, CARD_REPLAYS)
    rows = rows.where(f"{uniform_sql('sample', 'replay')} < traffic_share")
    rows = assign.inject(rows, {"lift", "novelty", "drop", "whale"})
    rows = rows.withColumns({
        "revenue": F.when(F.col("scenario") == "whale_revenue", F.col("revenue")),
        "pre_x": F.when(F.col("arm") == "treatment", F.col("pre_x") * F.col("imbalance")).otherwise(F.col("pre_x"))})
    report = health.health_report(rows, ["scenario", "replay"], revenue_col="revenue", covariates=["pre_x"],
                                  planned_mde_rel=0.20)
    return health.report_card(report)


PERIOD_DAYS = 365
AUDIT_MDE = 0.20


def audit_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by period of arrival; a finished order is a conversion and a
    pending one has low engagement."""
    return unit_table(spark, sf_dir).where("known").select(
        "unit_id", "code", F.floor(F.col("day_no") / PERIOD_DAYS).cast("int").alias("quarter"), "day", "segment", "amount",
        F.when(F.col("order_status") == "F", 1).otherwise(0).alias("converted"), F.when(F.col("order_status") == "P", 0).otherwise(1).alias("engaged"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decision_log(audit_units(spark, sf_dir), planned_mde_rel=AUDIT_MDE)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.quarter_score(_log(spark, sf_dir))


def scenario_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned shares for three targets, and the share of the table's
    experiments that drew each scenario."""
    catalog = audit.scenario_catalog(spark)
    quarters = audit_units(spark, sf_dir).groupBy("quarter").agg(F.count(F.lit(1)).alias("units"))
    out = None
    for target in (None, 0.15, 0.35):
        plan = audit.scenario_shares(catalog, target).select("scenario", "share", "cum_lo", "cum_hi")
        drawn = audit.portfolio_draw(quarters, true_win_share=target).groupBy("scenario").agg(
            F.count(F.lit(1)).alias("experiments"), F.sum("units").alias("units"))
        part = plan.join(drawn, "scenario", "left").withColumn("target", F.lit(target).cast("double"))
        out = part if out is None else out.unionByName(part)
    return tidy(out.fillna(0, ["experiments", "units"]))


def portfolio_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = audit_units(spark, sf_dir).groupBy("quarter").agg(F.count(F.lit(1)).alias("units"))
    return tidy(audit.portfolio_draw(quarters))


def naive_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = materialize(audit.experiment_cells(audit.experiment_rows(audit_units(spark, sf_dir))), "audit-cells")
    return tidy(audit.naive_decisions(cells))


def rigorous_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = audit.experiment_cells(audit.experiment_rows(audit_units(spark, sf_dir)))
    daily = materialize(audit._sum_counts(cells, [*audit.EXP, "day"]), "audit-days")
    return tidy(audit.rigorous_decisions(daily, planned_mde_rel=AUDIT_MDE))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_log(spark, sf_dir))


def quarter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_scores(spark, sf_dir), cost_missed=1, total_cost=1)


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.audit_summary(_scores(spark, sf_dir)), cost_missed_median=1, total_cost_median=1)


def ship_rate_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.ship_rate_by_scenario(_log(spark, sf_dir)))


def break_even_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.break_even_cost(_scores(spark, sf_dir)), extra_missed_cost=1, break_even_cost=1)


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.cost_sensitivity(_log(spark, sf_dir)), 1)


def worst_case_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.worst_case_rerun(_log(spark, sf_dir)), 1)


def share_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.share_sensitivity(audit_units(spark, sf_dir), planned_mde_rel=AUDIT_MDE)
    return tidy(out, naive_total_cost_median=1, rigorous_total_cost_median=1)


QUERIES = {f.__name__: f for f in (
    health_checks, health_verdict, health_markdown, checker_report_card, checker_detection, clean_ship_rates, scenario_shares, portfolio_draw,
    naive_decisions, rigorous_decisions, decision_log, quarter_score, audit_summary, ship_rate_by_scenario,
    break_even_cost, cost_sensitivity, worst_case_rerun, share_sensitivity)}
