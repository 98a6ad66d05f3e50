"""Moments of a metric with its upper tail capped, from mergeable buckets.

The first read counts rows by order-preserving bucket and keeps, per arm, their
number, mean and variance: a moment histogram, whose size depends on the range
of the metric and not on the rows.  The bucket that holds the wanted rank is
the only one read again, by value.  Below it a bucket's moments are those of
the capped metric as well, above it all rows stand at the cap, so the capped
test needs no third read.  Means and variances are merged around the common
mean, as partial aggregates of a variance are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark import CONTROL, TREATMENT
from trialspark.functions.stats import div
from trialspark.operators.groupstats import _holding_ranks, order_bucket, ranked_ends, settled
from trialspark.sources.ingest import materialize

STEPS = 512  # buckets per power of two
ARMS = (("c", CONTROL), ("t", TREATMENT))


def _bucketed(units: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    slim = units.selectExpr(*[f"`{k}`" for k in keys], "arm", f"CAST(`{metric}` AS DOUBLE) AS _y")
    return slim.withColumn("_b", F.expr(order_bucket("_y", STEPS)))


def moment_histogram(units: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _b, _n, n_c, mean_c, var_c, n_t, mean_t, var_t): counted rows with a
    value, and population moments per arm, of each bucket."""
    aggs = [F.count("_y").alias("_n")]
    for s, label in ARMS:
        y = F.when(F.col("arm") == label, F.col("_y"))
        aggs += [F.count(y).alias(f"n_{s}"), F.avg(y).alias(f"mean_{s}"), F.var_pop(y).alias(f"var_{s}")]
    return _bucketed(units, metric, keys).groupBy(*keys, "_b").agg(*aggs).where("_n > 0")


def merged_moments(parts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number, mean and sample variance per arm of disjoint parts, as ``{name}_{n,mean,var}_{c,t}``."""
    over = "OVER (" + (f"PARTITION BY {', '.join(f'`{k}`' for k in keys)}" if keys else "") + ")"
    around = parts.selectExpr("*", *[f"sum(n_{s} * mean_{s}) {over} / nullif(sum(n_{s}) {over}, 0) AS _m_{s}" for s, _ in ARMS])
    aggs = []
    for s, _ in ARMS:
        squares = f"sum(n_{s} * (var_{s} + (mean_{s} - _m_{s}) * (mean_{s} - _m_{s})))"
        aggs += [f"coalesce(sum(n_{s}), 0L) AS {name}_n_{s}", f"max(_m_{s}) AS {name}_mean_{s}",
                 f"{div(squares, f'(sum(n_{s}) - 1)')} AS {name}_var_{s}"]
    return around.groupBy(*keys).agg(*[F.expr(a) for a in aggs])


def capped_moments(units: DataFrame, metric: str, q: float = 0.99, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cap, raw_{n,mean,var}_{c,t}, win_{n,mean,var}_{c,t}): moments of a
    metric as it is and capped at its pooled quantile, one row per group.

    Two reads of ``units``, the second of one bucket only.  A group without any
    value has no row.
    """
    keys = list(keys)
    small = settled if keys else F.broadcast  # without keys at most two buckets hold the ranks
    quoted = [f"`{k}`" for k in keys]
    part = f"PARTITION BY {', '.join(quoted)}" if keys else ""
    hist = materialize(moment_histogram(units, metric, keys), "moment-histogram")
    ranked = hist.selectExpr(*quoted, "_b", "_n", "0L AS _start", f"(sum(_n) OVER ({part}) - 1) * {float(q)!r}D AS _pos")
    wanted = materialize(_holding_ranks(ranked, "_b", quoted), "boundary-buckets")
    near = _bucketed(units, metric, keys).where("_y IS NOT NULL").join(small(wanted), [*keys, "_b"])
    near = materialize(near.groupBy(*keys, "_b", "_start", "_pos", "_y").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("arm") == label).alias(f"n_{s}") for s, label in ARMS]), "boundary-values")
    caps = materialize(ranked_ends(near, "_y", keys, "cap"), "caps")

    # what lies below, inside and above the buckets that hold the ranks
    edges = wanted.groupBy(*keys).agg(F.min("_b").alias("_low"), F.max("_b").alias("_high"))
    edges = edges.join(caps, keys) if keys else edges.crossJoin(F.broadcast(caps))
    outside = (hist.join(small(edges), keys) if keys else hist.crossJoin(F.broadcast(edges))).where("_b < _low OR _b > _high")
    outside = outside.selectExpr(*quoted, *[x for s, _ in ARMS for x in (
        f"n_{s}", f"CASE WHEN n_{s} = 0 THEN NULL WHEN _b > _high THEN cap ELSE mean_{s} END AS mean_{s}", f"CASE WHEN _b > _high THEN 0D ELSE var_{s} END AS var_{s}")])
    inside = near.join(small(caps), keys) if keys else near.crossJoin(F.broadcast(caps))
    inside = inside.selectExpr(*quoted, *[x for s, _ in ARMS for x in (f"n_{s}", f"CASE WHEN n_{s} > 0 THEN least(_y, cap) END AS mean_{s}", f"0D AS var_{s}")])
    raw, win = merged_moments(hist, keys, "raw"), merged_moments(outside.unionByName(inside), keys, "win")
    if keys:
        return raw.join(win, keys).join(caps, keys)
    return raw.crossJoin(F.broadcast(win)).crossJoin(F.broadcast(caps))
