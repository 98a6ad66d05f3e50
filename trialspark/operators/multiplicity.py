"""Several tests at once: step-down and step-up corrections, segments, variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialspark.functions.stats import div, norm_ppf, pooled_z, two_sided_p, with_prop_test
from trialspark.operators.groupstats import attach, settled
from trialspark.operators.ranks import bh_large, holm_large

VARIANCE_FLOOR = 1e-12


def _ranked(pvalues: DataFrame, family: Window, p: str) -> DataFrame:
    """Rank ``_i`` by p with missing ones last, and the number ``_m`` of p values."""
    known = F.when(~F.isnan(F.col(p).cast("double")), F.col(p))
    return pvalues.withColumns({"_i": F.row_number().over(family.orderBy(known.asc_nulls_last())), "_m": F.count(known).over(family)})


def holm(pvalues: DataFrame, family: Sequence[str], p: str = "p_value", alpha: float = 0.05,
         name: str = "holm_reject", large: bool | None = None) -> DataFrame:
    """Step-down: reject in rising order of p up to the first failure.  A missing
    p counts in no family and is never rejected.

    A family with keys is a list of metrics and is ranked by one task.  Without
    keys, or with ``large``, families may have any size (``ranks``)."""
    if large if large is not None else not family:
        return holm_large(pvalues, family, p, alpha, name)
    w = Window.partitionBy(*family)
    ranked = _ranked(pvalues, w, p)
    ok = (F.col(p) <= F.try_divide(F.lit(alpha), F.col("_m") - F.col("_i") + 1)).cast("int")
    ranked = ranked.withColumn("_ok", F.coalesce(ok, F.lit(0)))
    run = w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.min("_ok").over(run) == 1).drop("_i", "_m", "_ok")


def benjamini_hochberg(pvalues: DataFrame, family: Sequence[str], p: str = "p_value", alpha: float = 0.05,
                       name: str = "bh_reject", large: bool | None = None) -> DataFrame:
    """Step-up: reject every rank up to the largest one that passes; families as in ``holm``."""
    if large if large is not None else not family:
        return bh_large(pvalues, family, p, alpha, name)
    w = Window.partitionBy(*family)
    ranked = _ranked(pvalues, w, p)
    passing = F.when(F.col(p) <= F.try_divide(F.lit(alpha) * F.col("_i"), F.col("_m")), F.col("_i"))
    within = F.col("_i") <= F.coalesce(F.max(passing).over(w), F.lit(0))
    return ranked.withColumn(name, within & (F.col("_i") <= F.col("_m"))).drop("_i", "_m")


def segment_scan(panel: DataFrame, segment: str = "segment", keys: Sequence[str] = ()) -> DataFrame:
    """z and relative lift of every segment; the input is a segment panel."""
    p_c, p_t = div("conv_c", "n_c"), div("conv_t", "n_t")
    return panel.selectExpr(*keys, segment, "conv_c", "n_c", "conv_t", "n_t", f"{pooled_z(floor=VARIANCE_FLOOR)} AS z",
                            f"({p_t} - {p_c}) / greatest({p_c}, 1e-9D) AS rel_lift")


def best_segment(scan: DataFrame, segment: str = "segment", keys: Sequence[str] = ()) -> DataFrame:
    """The segment with the largest |z| in each group, ties to the smaller name."""
    size = F.coalesce(F.abs("z"), F.lit(-1.0))
    row = F.struct((-size).alias("_size"), F.col(segment).alias("_name"), F.struct(*[c for c in scan.columns if c not in keys]).alias("_row"))
    return scan.groupBy(*keys).agg(F.min(row).alias("_best")).select(*keys, "_best._row.*").select(*scan.columns)


def bonferroni_segments(scan: DataFrame, n_segments: int | None = None, keys: Sequence[str] = (),
                        alpha: float = 0.05) -> DataFrame:
    """Flag segments beyond the critical value for m looks.  With ``n_segments``
    the value is a constant; otherwise p is compared with alpha / m per group,
    m being the number of segments that the group has."""
    if n_segments is not None:
        crit = norm_ppf(1 - alpha / (2 * n_segments))
        return scan.withColumns({"critical_z": F.lit(crit), "bonferroni": F.abs("z") > crit})
    m = scan.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"))
    return attach(scan, m, keys).withColumn("bonferroni", two_sided_p("z") < F.lit(alpha) / F.col("n_segments"))


def multi_variant_vs_control(units: DataFrame, label: str, control: str | int, keys: Sequence[str] = (),
                             metric: str = "converted") -> DataFrame:
    """Every variant against the one control, with Holm over the variants."""
    totals = units.groupBy(*keys, label).agg(F.sum(metric).cast("bigint").alias("conv_t"),
                                             F.count(metric).alias("n_t"))
    base = totals.where(F.col(label) == control).select(
        *keys, F.col("conv_t").alias("conv_c"), F.col("n_t").alias("n_c"), F.lit(1).alias("_one"))
    variants = totals.where(F.col(label) != control).withColumn("_one", F.lit(1))
    tested = with_prop_test(variants.join(settled(base) if keys else F.broadcast(base), ["_one", *keys]))
    return holm(tested, keys, large=False).select(*keys, label, "conv_c", "n_c", "conv_t", "n_t", "effect", "rel_lift",
                                     "z", "p_value", "significant", "holm_reject")
