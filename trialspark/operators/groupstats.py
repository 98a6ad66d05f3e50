"""Attaching per-group results to rows, and exact quantiles at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.sources.ingest import materialize



def settled(stats: DataFrame) -> DataFrame:
    """One-row-per-group statistics, written once: their known size lets Spark's
    own threshold decide between a broadcast and a shuffle, so rows are not
    shuffled on a group key that holds a third of them while groups are few."""
    return materialize(stats, "groups")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one-row-per-group statistics onto rows, keeping every row.  Without
    keys there is a single statistics row, which is always broadcast."""
    if keys:
        return rows.join(settled(stats), list(keys), "left")
    return (rows.withColumn("_one", F.lit(1))
            .join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one").drop("_one"))


COARSE = 4096            # steps per power of two in pass 1
FINE = COARSE << 16      # steps per power of two inside the wanted coarse steps


def order_bucket(y: str, steps: int) -> str:
    """Integer that never decreases with y: ``steps`` per power of two.  The number
    of buckets depends on the range of y, not on the rows.  It is never NULL, so
    that no null filter is pushed down to repeat the expression."""
    size = f"CAST(floor(log2(abs({y})) * {steps}) AS BIGINT) + {1100 * steps}L"
    far = 2200 * steps  # beyond all finite values; NaN is the largest value
    return (f"coalesce(CASE WHEN isnan({y}) THEN {far + 1}L WHEN abs({y}) = double('infinity') THEN if({y} > 0, {far}L, -{far}L)"
            f" WHEN {y} > 0 THEN {size} WHEN {y} < 0 THEN -({size}) END, 0L)")


def _holding_ranks(counts: DataFrame, bucket: str, within: Sequence[str]) -> DataFrame:
    """Of counted buckets (``_n``, rows before the set in ``_start``), those that
    hold rank ``_pos``, with ``_start`` moved to the bucket."""
    part = f"PARTITION BY {', '.join(within)} " if within else ""
    run = counts.withColumn("_cum", F.expr(
        f"_start + sum(_n) OVER ({part}ORDER BY {bucket} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    held = run.where("_cum - _n <= ceil(_pos) AND _cum > floor(_pos)")
    return held.withColumn("_start", F.expr("_cum - _n")).drop("_cum", "_n")


def exact_quantile(rows: DataFrame, value: str, q: float, keys: Sequence[str] = (),
                   name: str = "quantile") -> DataFrame:
    """Exact linearly interpolated quantile per group without gathering a group.

    Pass 1 counts rows per order-preserving bucket; partial aggregation does the
    work before the shuffle.  Pass 2 reads only rows of the one or two buckets
    that hold the wanted ranks, counts them by value, and narrows those counts
    to steps 65,536 times finer before values are put in order.  Every ordered
    window therefore spans bucket numbers of one group, or the few values that
    share one fine step.  A group without any value has no row in the result.
    """
    keys = list(keys)
    small = settled if keys else F.broadcast  # without keys at most two buckets hold the ranks
    slim = rows.selectExpr(*keys, value, f"{order_bucket(value, COARSE)} AS _b")
    hist = slim.groupBy(*keys, "_b").agg(F.count(value).alias("_n"))
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    hist = hist.selectExpr("*", "0L AS _start", f"sum(_n) OVER ({part}) AS _total").where("_total > 0").selectExpr(
        *keys, "_b", "_n", "_start", f"(_total - 1) * {float(q)!r}D AS _pos")
    wanted = _holding_ranks(hist, "_b", keys)
    near = (slim.join(small(wanted), [*keys, "_b"])
            .groupBy(*keys, "_b", "_start", "_pos", value).agg(F.count(value).alias("_n")))
    return ranked_ends(near, value, keys, name)


def ranked_ends(near: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """The interpolated quantile per group from counted values of the buckets that
    hold its ranks: (keys, _b, _start, _pos, value, _n)."""
    keys = list(keys)
    small = settled if keys else F.broadcast
    near = near.withColumn("_f", F.expr(order_bucket(value, FINE)))
    steps = near.groupBy(*keys, "_b", "_start", "_pos", "_f").agg(F.sum("_n").alias("_n"))
    exact = _holding_ranks(steps, "_f", [*keys, "_b"]).drop("_pos")
    last = near.drop("_start").join(small(exact), [*keys, "_b", "_f"])
    part = ", ".join([*keys, "_b", "_f"])
    ranked = last.withColumn("_cum", F.expr(
        f"_start + sum(_n) OVER (PARTITION BY {part} ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    ends = ranked.groupBy(*keys).agg(
        F.expr(f"min({value}) FILTER (WHERE _cum > floor(_pos)) AS _lo"),
        F.expr(f"min({value}) FILTER (WHERE _cum > ceil(_pos)) AS _hi"), F.max("_pos").alias("_pos"))
    return ends.selectExpr(*keys, f"CASE WHEN _lo = _hi THEN _lo ELSE _lo + (_hi - _lo) * (_pos - floor(_pos)) END AS {name}")
