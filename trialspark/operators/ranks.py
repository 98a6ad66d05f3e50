"""Ranks in families of any size, without a window over a family.

Values are counted, and counts are summed up in three steps: over powers of two,
over fixed steps within a power, and over the values within a step.  The first
two have a bounded number of rows per family, the third runs in as many tasks as
there are steps.  Decisions on sorted p values need no rank per row: equal
values are decided together, from the ranks at which they begin and end, and a
family's decision is a threshold that its rows are compared with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.groupstats import COARSE, order_bucket
from trialspark.sources.ingest import materialize


def known(p: str) -> Column:
    """The value, NULL if it is missing or NaN."""
    return F.when(~F.isnan(F.col(p).cast("double")), F.col(p).cast("double"))


def rank_bounds(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _v, _n, _before, _total): for each distinct value its rows, those
    below it, and all rows of its family.  Missing values do not count."""
    names = [f"_k{i}" for i in range(len(keys))]
    slim = rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], known(value).alias("_v")).where("_v IS NOT NULL")
    counted = slim.groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_b", F.expr(order_bucket("_v", COARSE))).withColumn("_e", F.expr(f"floor(_b / {COARSE})"))
    counted = materialize(counted, "ranked-values")
    steps = materialize(counted.groupBy(*names, "_e", "_b").agg(F.sum("_n").alias("_s")), "rank-steps")
    powers = materialize(steps.groupBy(*names, "_e").agg(F.sum("_s").alias("_p")).withColumn("_one", F.lit(1)), "rank-powers")

    def same(x: str, y: str, *columns: str) -> Column:
        out = F.col(f"{x}._one") == F.col(f"{y}._one")
        for c in columns:
            out = out & F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}"))
        return out

    # at most 2,200 powers a family; each looks at the others of its family
    below = powers.alias("x").join(powers.alias("y"), same("x", "y", *names)).groupBy(*[F.col(f"x.{c}").alias(c) for c in (*names, "_e")]).agg(
        F.sum("y._p").alias("_total"), F.coalesce(F.sum(F.when(F.col("y._e") < F.col("x._e"), F.col("y._p"))), F.lit(0)).alias("_low"))
    below = materialize(below.withColumn("_one", F.lit(1)), "rank-starts")

    def up_to(part: Sequence[str], order: str, what: str) -> Column:
        return F.expr(f"sum({what}) OVER (PARTITION BY {', '.join(part)} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {what}")

    placed = steps.withColumn("_in", up_to([*names, "_e"], "_b", "_s")).withColumn("_one", F.lit(1)).alias("x").join(
        below.alias("y"), same("x", "y", *names, "_e")).select(*[F.col(f"x.{c}").alias(c) for c in (*names, "_b")], (F.col("_low") + F.col("_in")).alias("_start"), "_total", F.lit(1).alias("_one"))
    placed = materialize(placed, "rank-places")
    inside = counted.withColumn("_in", up_to([*names, "_b"], "_v", "_n")).withColumn("_one", F.lit(1))
    return inside.alias("x").join(placed.alias("y"), same("x", "y", *names, "_b")).select(
        *[F.col(f"x.{n}").alias(k) for k, n in zip(keys, names, strict=True)], "_v", "_n", (F.col("_start") + F.col("x._in")).alias("_before"), "_total")


def rejected(rows: DataFrame, p: str, keys: Sequence[str], threshold: Column, name: str, strict: bool) -> DataFrame:
    """``rows`` with a flag: p is below (or at) its family's threshold, an aggregate
    over ``rank_bounds``; no threshold means none or, if ``strict``, all."""
    bounds = rank_bounds(rows, p, keys)
    stats = materialize(bounds.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(threshold.alias("_limit")), "family-limits")
    if keys:
        met = F.lit(True)
        for i, k in enumerate(keys):
            met = met & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
        joined = rows.join(stats, met, "left")
    else:
        joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    below = (known(p) < F.col("_limit")) | F.col("_limit").isNull() if strict else known(p) <= F.col("_limit")
    return joined.withColumn(name, F.coalesce(below & known(p).isNotNull(), F.lit(False))).drop("_limit", *[f"_k{i}" for i in range(len(keys))])


def holm_large(rows: DataFrame, family: Sequence[str], p: str, alpha: float, name: str) -> DataFrame:
    """Step-down in one family of any size: everything below the first failing p."""
    fails = F.col("_v") > F.try_divide(F.lit(alpha), F.col("_total") - F.col("_before"))
    return rejected(rows, p, family, F.min(F.when(fails, F.col("_v"))), name, True)


def bh_large(rows: DataFrame, family: Sequence[str], p: str, alpha: float, name: str) -> DataFrame:
    """Step-up in one family of any size: everything up to the largest passing p."""
    passes = F.col("_v") <= F.lit(alpha) * (F.col("_before") + F.col("_n")) / F.col("_total")
    return rejected(rows, p, family, F.max(F.when(passes, F.col("_v"))), name, False)
