"""Replay studies on the order, event and line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import assign, panels, replay
from trialspark.operators.assign import subset_units
from trialspark.reports import tidy
from trialspark.reports.decisions import prepared_units
from trialspark.reports.tests import METRICS, metric_units
from trialspark.sources.units import coded_orders, customer_units, event_units, line_units, order_units, with_code


def _orders(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return coded_orders(spark, sf_dir, **kw)


def aa_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real A/A on the control arm for two metrics."""
    control = subset_units(with_code(order_units(spark, sf_dir)), arm="control").drop("arm")
    return tidy(replay.aa_replay(control, 200, ["converted", "visit"]))


INJECTED = (
    {"scenario": "lift", "lift": 0.2}, {"scenario": "harm", "lift": -0.2},
    {"scenario": "novelty", "novelty_boost": 0.6, "novelty_halflife": 3.0, "lift": 0.0},
    {"scenario": "drop", "srm_drop_rate": 0.1}, {"scenario": "whale", "whale_rate": 0.05, "whale_multiplier": 50.0},
    {"scenario": "ramp", "ramp_days": 3, "ramp_treat_share": 0.1},
    {"scenario": "sale", "daily_base": [0.12] * 3 + [0.04] * 11},
)


def inject_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every effect built into the orders, summed by scenario, day and arm."""
    grid = [{"lift": 0.0, **{k: v for k, v in assign.SCENARIO_DEFAULTS.items() if k != "treat_share"}, "daily_base": None, **s} for s in INJECTED]
    rows = assign.inject(replay.over_scenarios(_orders(spark, sf_dir), grid, 1), {"lift", "novelty", "drop", "whale", "ramp", "base"})
    return tidy(rows.groupBy("scenario", "day", "arm").agg(
        F.count(F.lit(1)).alias("users"), F.sum("converted").alias("conversions"), F.sum("revenue").alias("revenue")), revenue=2)


def peeking_by_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.peeking_by_looks(with_code(order_units(spark, sf_dir)), 100))


def compare_stopping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.compare_stopping_rules(_orders(spark, sf_dir), 60, 14, rel_lift=0.10))


def msprt_sample_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.msprt_sample_cost(_orders(spark, sf_dir), 40, tau=0.005, rel_lift=0.3))


def winners_curse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.winners_curse(_orders(spark, sf_dir), 100, 0.4))


def srm_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.srm_damage(_orders(spark, sf_dir), 60))


def srm_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.srm_detection(_orders(spark, sf_dir), 60, drop_rate=0.05))


def novelty_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.novelty_scenarios(_orders(spark, sf_dir), 30))


def any_false_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.any_false_positive(metric_units(spark, sf_dir), [n for n, _ in METRICS], 100))


def variant_false_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.variant_false_positive(_orders(spark, sf_dir), 100))


def segment_hacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _orders(spark, sf_dir, customers=True)
    return tidy(replay.segment_hacking(units, {"market": "segment", "nation": "nation"}, 50))


def heavy_tail_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = prepared_units(spark, sf_dir)
    return tidy(replay.heavy_tail_methods(units, 6, (0.0, 0.005), (0.0, 0.10), "x_strong", n_boot=40))


def unit_of_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions clustered in users, customers and orders."""
    events = panels.ratio_rollup(event_units(spark, sf_dir)).withColumn("source", F.lit("events"))
    cust = customer_units(spark, sf_dir).withColumn("source", F.lit("orders"))
    lines = panels.ratio_rollup(line_units(spark, sf_dir).withColumnRenamed("cluster_id", "unit_id"))
    lines = lines.withColumn("source", F.lit("lines"))
    cols = ("source", "unit_id", "sessions", "clicks")
    clusters = events.select(*cols).unionByName(cust.select(*cols)).unionByName(lines.select(*cols))
    return tidy(replay.unit_of_analysis(with_code(clusters), 60))


def simpson_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.simpson_ramp(_orders(spark, sf_dir), 60))


def cuped_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _orders(spark, sf_dir, customers=True)
    return tidy(replay.cuped_replay(units, 60, "amount", "x_strong", (0.0, 0.02)))


def cuped_rho_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.cuped_rho_grid(order_units(spark, sf_dir, customers=True), "amount", "pre_x"))


QUERIES = {f.__name__: f for f in (
    aa_replay, inject_scenario, peeking_by_looks, compare_stopping_rules, msprt_sample_cost, winners_curse,
    srm_damage, srm_detection, novelty_scenarios, any_false_positive, variant_false_positive, segment_hacking, heavy_tail_methods,
    unit_of_analysis, simpson_ramp, cuped_replay, cuped_rho_grid)}
