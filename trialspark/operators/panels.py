"""Aggregations by arm, day, segment and unit.

All of them are conditional aggregates grouped by the caller's keys only, so
partial aggregation leaves one small row per task and key before the shuffle;
a key that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark import CONTROL, TREATMENT
from trialspark.functions.stats import div, exprs


def arm_flags(arm_col: str = "arm", control: str = CONTROL, treatment: str = TREATMENT
              ) -> tuple[Column, Column]:
    return F.col(arm_col) == control, F.col(arm_col) == treatment


def arm_totals(units: DataFrame, keys: Sequence[str] = (), metric: str = "converted",
               arm_col: str = "arm", control: str = CONTROL, treatment: str = TREATMENT) -> DataFrame:
    """Conversions and users per arm, side by side.  NULL outcomes do not count."""
    aggs = []
    for s, label in (("c", control), ("t", treatment)):
        y = f"CASE WHEN {arm_col} = '{label}' THEN {metric} END"
        aggs += [F.expr(f"CAST(coalesce(sum({y}), 0) AS BIGINT) AS conv_{s}"), F.expr(f"count({y}) AS n_{s}")]
    return units.groupBy(*keys).agg(*aggs)


def metrics_by_arm(units: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (),
                   arm_col: str = "arm") -> DataFrame:
    """Users, mean and sample variance of each metric, one row per arm."""
    aggs = [F.count(F.lit(1)).alias("users")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.var_samp(m).alias(f"{m}_var")]
    return units.groupBy(*keys, F.col(arm_col).alias("arm")).agg(*aggs)


def arm_moments(units: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (),
                pairs: Sequence[tuple[str, str]] = (), arm_col: str = "arm",
                control: str = CONTROL, treatment: str = TREATMENT) -> DataFrame:
    """Count, mean, sample variance (and covariances) per arm, one row per key."""
    aggs = []
    for s, label in (("c", control), ("t", treatment)):
        for m in metrics:
            y = f"CASE WHEN {arm_col} = '{label}' THEN {m} END"
            aggs += [F.expr(f"count({y}) AS {m}_n_{s}"), F.expr(f"avg({y}) AS {m}_mean_{s}"),
                     F.expr(f"var_samp({y}) AS {m}_var_{s}")]
        for a, b in pairs:
            when = f"CASE WHEN {arm_col} = '{label}' THEN"
            aggs.append(F.expr(f"covar_samp({when} {a} END, {when} {b} END) AS {a}_{b}_cov_{s}"))
    return units.groupBy(*keys).agg(*aggs)


def daily_panel(units: DataFrame, keys: Sequence[str] = (), metric: str = "converted",
                day_col: str = "day") -> DataFrame:
    """Conversions, users and rates per day with the arms as columns."""
    panel = arm_totals(units, [*keys, day_col], metric)
    return with_rates(panel)


def with_rates(panel: DataFrame) -> DataFrame:
    return panel.withColumns(exprs(p_c=div("conv_c", "n_c"), p_t=div("conv_t", "n_t")))


def segment_panel(units: DataFrame, segment: str = "segment", keys: Sequence[str] = (),
                  metric: str = "converted") -> DataFrame:
    return arm_totals(units, [*keys, segment], metric)


def covariate_moments(units: DataFrame, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample variance of every covariate by arm in long form.

    One wide aggregate over the rows; only the aggregated row is unpivoted, so
    the unit table is never repeated per covariate.
    """
    wide = arm_moments(units, covariates, keys)
    parts = ("n_c", "n_t", "mean_c", "mean_t", "var_c", "var_t")
    entries = F.array(*[
        F.struct(F.lit(c).alias("covariate"), *[F.col(f"{c}_{p}").alias(p) for p in parts])
        for c in covariates
    ])
    return wide.select(*keys, F.inline(entries))


def pooled_association(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = ()) -> DataFrame:
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("users"),
        F.covar_samp(metric, covariate).alias("covariance"),
        F.corr(metric, covariate).alias("correlation"),
    )


def lognormal_calibration(units: DataFrame, spend: str, conversion: Column, visit: Column,
                          keys: Sequence[str] = ()) -> DataFrame:
    """Location and scale of ln(spend) among converters, and control base rates."""
    is_c, _ = arm_flags()
    log_spend = F.when(F.col(spend) > 0, F.ln(F.col(spend)))
    return units.groupBy(*keys).agg(
        F.avg(F.when(is_c, conversion)).alias("control_conversion"),
        F.avg(F.when(is_c, visit)).alias("control_visit"),
        F.avg(log_spend).alias("log_mu"),
        F.stddev_samp(log_spend).alias("log_sigma"),
    )


def ratio_rollup(events: DataFrame, unit: str = "unit_id", click: str = "converted",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Sessions and clicks per randomized unit."""
    return events.groupBy(*keys, "arm", unit).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(click).cast("bigint").alias("clicks"))


def value_counts(units: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return units.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("users"))
