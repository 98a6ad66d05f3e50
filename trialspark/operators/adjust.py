"""Variance reduction, regression adjustment, balance and stratification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.stats import norm_ppf, ratio, two_sided_p, with_welch
from trialspark.operators.gram import gram, matrix
from trialspark.operators.groupstats import attach
from trialspark.operators.panels import arm_flags, arm_moments, covariate_moments
from trialspark.operators.hypothesis import RESULT


def cuped_theta(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and covariate mean over both arms together."""
    return units.groupBy(*keys).agg(
        ratio(F.covar_samp(metric, covariate), F.var_samp(covariate)).alias("theta"),
        F.avg(covariate).alias("x_bar"))


def cuped_adjust(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = (),
                 name: str = "adjusted") -> DataFrame:
    rows = attach(units, cuped_theta(units, metric, covariate, keys), keys)
    return rows.withColumn(name, F.col(metric) - F.col("theta") * (F.col(covariate) - F.col("x_bar")))


def _cuped_moments(units: DataFrame, metric: str, covariate: str, keys: Sequence[str]) -> DataFrame:
    """Arm moments and pooled slope in a single aggregate: the adjusted mean and
    variance follow from them, so no second pass over the rows is needed."""
    is_c, is_t = arm_flags()
    y, x = F.col(metric), F.col(covariate)
    aggs = [ratio(F.covar_samp(y, x), F.var_samp(x)).alias("theta"), F.avg(x).alias("x_bar"),
            F.var_samp(y).alias("var_y"), F.var_samp(x).alias("var_x"), F.covar_samp(y, x).alias("cov_yx")]
    for s, cond in (("c", is_c), ("t", is_t)):
        ya, xa = F.when(cond, y), F.when(cond, x)
        aggs += [F.count(ya).alias(f"n_{s}"), F.avg(ya).alias(f"my_{s}"), F.var_samp(ya).alias(f"vy_{s}"),
                 F.avg(xa).alias(f"mx_{s}"), F.var_samp(xa).alias(f"vx_{s}"),
                 F.covar_samp(ya, xa).alias(f"cxy_{s}")]
    df = units.groupBy(*keys).agg(*aggs)
    theta = F.col("theta")
    for s in ("c", "t"):
        df = df.withColumns({
            f"adj_n_{s}": F.col(f"n_{s}"),
            f"adj_mean_{s}": F.col(f"my_{s}") - theta * (F.col(f"mx_{s}") - F.col("x_bar")),
            f"adj_var_{s}": F.col(f"vy_{s}") - 2 * theta * F.col(f"cxy_{s}") + theta * theta * F.col(f"vx_{s}"),
        })
    return df


def cuped_test(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = ()) -> DataFrame:
    return with_welch(_cuped_moments(units, metric, covariate, keys), "adj").select(
        *keys, "theta", "t", "dof", *RESULT)


def raw_and_cuped(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unadjusted and adjusted Welch tests from the same single pass."""
    df = _cuped_moments(units, metric, covariate, keys)
    for s in ("c", "t"):
        df = df.withColumns({f"raw_n_{s}": F.col(f"n_{s}"), f"raw_mean_{s}": F.col(f"my_{s}"),
                             f"raw_var_{s}": F.col(f"vy_{s}")})
    return with_welch(with_welch(df, "raw", prefix="raw_"), "adj", prefix="cuped_")


def cuped_by_arm(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = ()) -> DataFrame:
    """Raw and adjusted mean and variance per arm, with the per-arm reduction."""
    wide = _cuped_moments(units, metric, covariate, keys)
    arms = F.array(*[
        F.struct(F.lit(label).alias("arm"), F.col(f"n_{s}").alias("users"),
                 F.col(f"my_{s}").alias("mean_raw"), F.col(f"vy_{s}").alias("var_raw"),
                 F.col(f"adj_mean_{s}").alias("mean_cuped"), F.col(f"adj_var_{s}").alias("var_cuped"),
                 (1 - ratio(F.col(f"adj_var_{s}"), F.col(f"vy_{s}"))).alias("variance_reduction"))
        for s, label in (("c", "control"), ("t", "treatment"))])
    return wide.select(*keys, F.inline(arms))


def variance_reduction(units: DataFrame, metric: str, covariate: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled share of variance removed; equals the squared correlation."""
    df = units.groupBy(*keys).agg(F.var_samp(metric).alias("_vy"), F.var_samp(covariate).alias("_vx"),
                                  F.covar_samp(metric, covariate).alias("_c"))
    left = F.col("_vy") - ratio(F.col("_c") * F.col("_c"), F.col("_vx"))
    return df.select(*keys, (1 - ratio(left, F.col("_vy"))).alias("variance_reduction"))


def ancova_wide(units: DataFrame, metrics: Sequence[str], covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Treatment coefficient of each metric ~ 1 + treat + covariates with HC1
    error, one row per group and metric, for any number of covariates.

    Pass 1 gathers centred cross products of all columns in blocks (``gram``).
    The small solve runs inside tasks, on one row per group.  With ``a`` the
    treatment row of the inverse normal matrix, the robust variance is the sum
    of (residual * a'z)^2, so pass 2 needs one more sum per metric, not a k x k
    matrix.  Pass 2 multiplies Arrow batches too: as generated code, the sums over
    all covariates are too long to be compiled.  Rows that miss a metric or a
    covariate do not count.
    """
    _, is_t = arm_flags()
    names = ["_treat", *(f"_z{i}" for i in range(len(covariates)))]
    outcomes = [f"_y{i}" for i in range(len(metrics))]
    k, m = len(names), len(outcomes)
    rows = units.select(
        *[F.col(f"`{c}`") for c in keys], F.when(is_t, 1.0).otherwise(0.0).alias("_treat"),
        *[F.col(f"`{c}`").cast("double").alias(f"_z{i}") for i, c in enumerate(covariates)],
        *[F.col(f"`{c}`").cast("double").alias(f"_y{i}") for i, c in enumerate(metrics)])
    first = gram(rows, [*names, *outcomes], keys)
    vec = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[first.schema[key] for key in keys], T.StructField("_n", T.LongType()), T.StructField("_fit", vec)])
    upper = np.triu_indices(k + m)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = []
            for n, mean, flat in zip(pdf["_n"], pdf["_mean"], pdf["_cross"]):
                full = np.zeros((k + m, k + m))
                full[upper] = flat
                full = (full + np.triu(full, 1).T) / n
                inv = np.linalg.pinv(full[:k, :k], hermitian=True)
                fits.append(np.concatenate([mean, inv[0] / n, np.diag(full)[k:], (full[k:, :k] @ inv).ravel()]).tolist())
            yield pdf.assign(_fit=fits)[[f.name for f in schema.fields]]

    fitted = attach(rows, first.mapInPandas(solve, schema), keys)
    cells = [(f"_effect{j}", f"_vy{j}", f"_meat{j}", f"_sse{j}") for j in range(m)]
    sums = T.StructType([*[fitted.schema[key] for key in keys], T.StructField("_n", T.LongType()), T.StructField("_rows", T.LongType()),
                         *[T.StructField(c, T.DoubleType()) for cell in cells for c in cell]])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of squares of a batch without keys, of a row with keys."""
        for batch in batches:
            x = matrix(batch, [*names, *outcomes])
            whole = ~np.isnan(x).any(axis=1)
            if not whole.any():
                continue
            x, batch = x[whole], batch.filter(pa.array(whole))
            at = np.arange(len(x)) if keys else np.zeros(1, np.int64)
            lost = batch.column("_fit").is_null().to_numpy(zero_copy_only=False)  # a null key meets no fit
            fit = np.full((len(x), 2 * (k + m) + k * m), np.nan)
            fit[~lost] = batch.column("_fit").flatten().to_numpy().reshape(-1, fit.shape[1])
            mean, lev, vy, beta = np.split(fit, np.cumsum([k + m, k, m]), axis=1)
            x = x - mean
            lever = (x[:, :k] * lev).sum(axis=1)
            cols = [batch.column("_n").take(pa.array(at)), pa.array(np.diff(np.append(at, len(x))))]
            for j in range(m):
                own = beta[:, j * k: (j + 1) * k]
                e = x[:, k + j] - (x[:, :k] * own).sum(axis=1)
                parts = own[at, 0], vy[at, j], np.add.reduceat((e * lever) ** 2, at), np.add.reduceat(e * e, at)
                cols += [pa.array(v, mask=lost[at]) for v in parts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *cols], names=sums.names)

    summed = fitted.mapInArrow(squares, sums).groupBy(*[F.col(f"`{c}`") for c in keys]).agg(
        F.max("_n").alias("users"), F.sum("_rows").alias("_rows"), *[f(c).alias(c) for cell in cells for f, c in zip((F.max, F.max, F.sum, F.sum), cell, strict=True)])
    lines = [F.struct(F.lit(metrics[j]).alias("metric"), F.col(effect).alias("effect"), F.col(vy).alias("_vy"), F.col(meat).alias("_meat"),
                      ratio(F.col(sse), F.col("_rows")).alias("_mse")) for j, (effect, vy, meat, sse) in enumerate(cells)]
    out = summed.select(*keys, "users", F.inline(F.array(*lines)))
    out = out.withColumn("se", F.sqrt(F.col("_meat") * ratio(F.col("users"), F.col("users") - (k + 1))))
    out = out.withColumn("z", ratio(F.col("effect"), F.col("se")))
    return out.select(*keys, "metric", "users", "effect", "se", two_sided_p("z").alias("p_value"),
                      ratio(F.col("_mse"), F.col("_vy")).alias("residual_variance_share"))


def ancova_hc1(units: DataFrame, metric: str, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``ancova_wide`` for one metric."""
    return ancova_wide(units, [metric], covariates, keys).drop("metric")


def ancova_summary(units: DataFrame, metric: str, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted against unadjusted effect: shift, error reduction, sample ratio."""
    raw = with_welch(arm_moments(units, [metric], keys), metric, prefix="raw_").select(
        *keys, "raw_effect", "raw_se")
    adj = ancova_hc1(units, metric, covariates, keys)
    both = attach(adj, raw, keys)
    rel = ratio(F.col("se"), F.col("raw_se"))
    return both.select(
        *keys, "raw_effect", "raw_se", F.col("effect").alias("ancova_effect"), F.col("se").alias("ancova_se"),
        ratio(F.col("effect") - F.col("raw_effect"), F.col("se")).alias("shift_in_se"),
        (1 - rel).alias("se_reduction"), (rel * rel).alias("sample_needed_ratio"), "residual_variance_share")


def smd_table(units: DataFrame, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Standardized mean difference of every covariate (sample variances)."""
    return with_smd(covariate_moments(units, covariates, keys))


def with_smd(moments: DataFrame) -> DataFrame:
    """Without any spread, equal means differ by 0 and others without bound."""
    spread, gap = F.sqrt((F.col("var_c") + F.col("var_t")) / 2), F.col("mean_t") - F.col("mean_c")
    flat = F.when(gap == 0, 0.0).otherwise(F.signum(gap) * F.lit(float("inf")))
    return moments.withColumn("smd", F.when(spread == 0, flat).otherwise(ratio(gap, spread)))


def balance_from_smd(smd: DataFrame, n_covariates: int, keys: Sequence[str] = (), alpha: float = 0.001) -> DataFrame:
    """Largest |SMD| per group, its z and the Bonferroni critical value."""
    worst = smd.groupBy(*keys).agg(F.max(F.abs("smd")).alias("max_smd"),
                                   F.max("n_c").alias("_nc"), F.max("n_t").alias("_nt"))
    scale = F.sqrt(ratio(F.lit(1), F.col("_nc")) + ratio(F.lit(1), F.col("_nt")))
    crit = norm_ppf(1 - alpha / (2 * n_covariates))
    out = worst.withColumns({"max_z": ratio(F.col("max_smd"), scale), "critical_z": F.lit(crit)})
    return out.withColumn("imbalanced", F.col("max_z") > F.col("critical_z")).drop("_nc", "_nt")


def balance_check(units: DataFrame, covariates: Sequence[str], keys: Sequence[str] = (),
                  alpha: float = 0.001) -> DataFrame:
    return balance_from_smd(smd_table(units, covariates, keys), len(covariates), keys, alpha)


def stratified_effect(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of daily differences weighted by the users of the day; days without
    one of the arms carry no difference and no weight."""
    w = F.when((F.col("n_c") > 0) & (F.col("n_t") > 0), F.col("n_c") + F.col("n_t"))
    return panel.groupBy(*keys).agg(
        ratio(F.sum(w * (F.col("p_t") - F.col("p_c"))), F.sum(w)).alias("stratified_effect"))
