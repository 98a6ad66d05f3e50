"""Sequential monitoring: cumulative looks, boundaries and always-valid p values.

Looks are rows, not arrays: a group has one row per look, so running sums are
short ordered windows per experiment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.stats import div, exprs, num, pooled_z, z_crit
from trialspark.sources.ingest import materialize

COUNTS = ("conv_c", "n_c", "conv_t", "n_t")
VARIANCE_FLOOR = 1e-12


def window_sql(keys: Sequence[str], order: str) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"({part}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def cumulative_looks(panel: DataFrame, keys: Sequence[str] = (), order: str = "day", start: int | None = None,
                     n_looks: int | None = None) -> DataFrame:
    """Running counts per arm; ``look`` numbers the periods from 1.

    ``order`` counts periods.  A period without rows is a look with the counts
    so far, so look k is always the k-th period from ``start`` (the group's
    first period if not given); with ``n_looks`` the looks go on to the planned end.
    """
    run, part = window_sql(keys, order), f"PARTITION BY {', '.join(keys)}" if keys else ""
    first = str(start) if start is not None else f"min({order}) OVER ({part})"
    kind = panel.schema[order].dataType.simpleString()
    upto = f"coalesce(lead({order}) OVER ({part} ORDER BY {order}) - {first}, {n_looks if n_looks is not None else 'NULL'}, 0)"
    seen = panel.selectExpr(*keys, order, f"CAST({order} - {first} + 1 AS INT) AS _at", f"CAST({upto} AS INT) AS _upto",
                            *[f"sum({c}) OVER {run} AS {c}" for c in COUNTS])
    return seen.selectExpr("*", "explode(sequence(_at, greatest(_at, _upto))) AS look").selectExpr(
        *keys, f"CAST({order} + look - _at AS {kind}) AS {order}", "look", *COUNTS)


def look_zscores(looks: DataFrame) -> DataFrame:
    """z at each look for arms of unequal size, NULL while an arm is empty."""
    return looks.withColumns(exprs(z=pooled_z(floor=VARIANCE_FLOOR), p_c=div("conv_c", "n_c"), p_t=div("conv_t", "n_t")))


@lru_cache
def obf_constant(n_looks: int, alpha: float = 0.05, points: int = 200) -> float:
    """Constant of the O'Brien-Fleming boundary for equally spaced looks.

    A walk of ``n_looks`` steps with variance 1 / n_looks leaves (-c, c) with
    probability alpha; the density of walks still inside is carried from look to
    look at Gauss-Legendre nodes, and c is found by bisection.
    """
    nodes, share = np.polynomial.legendre.leggauss(points)

    def left(c: float) -> float:
        x, weight = c * nodes, c * share
        step = lambda d: np.exp(-d * d * n_looks / 2) * math.sqrt(n_looks / (2 * math.pi))
        inside, kernel = step(x), step(x[:, None] - x[None, :])
        for _ in range(n_looks - 1):
            inside = kernel @ (weight * inside)
        return 1 - float(weight @ inside)

    low, high = 1.0, 6.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if left(mid) > alpha else (low, mid)
    return high


def obf_boundary(c: float | str, look: str = "look", n_looks: int | str = "n_looks") -> str:
    """O'Brien-Fleming boundary c * sqrt(K / k)."""
    return f"({c if isinstance(c, str) else num(c)} * sqrt(CAST({n_looks} AS DOUBLE) / {look}))"


def with_obf_constant(looks: DataFrame, n_looks: str = "n_looks", name: str = "c_obf", alpha: float = 0.05) -> DataFrame:
    """The boundary's constant for each row's own number of looks.  The few
    distinct numbers are solved in tasks and joined back."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [obf_constant(int(k), alpha) for k in pdf["_looks"]]})

    planned = looks.select(F.col(n_looks).cast("int").alias("_looks")).where("_looks > 0").distinct()
    table = materialize(planned.mapInPandas(solve, f"_looks int, {name} double"), "obf-constants")
    return looks.join(table, looks[n_looks] == table["_looks"], "left").drop("_looks")


def spending_boundaries(fractions: Sequence[float], alpha: float = 0.05, points: int = 160) -> list[float]:
    """Two-sided boundaries of z at the given information fractions (rising, up to
    1) that spend ``alpha`` as an O'Brien-Fleming boundary does: on each side
    2 - 2 Phi(z / sqrt(t)), z being the 1 - alpha / 4 quantile.

    The score B = z sqrt(t) has independent increments of variance t_k - t_(k-1).
    The density of scores that have not crossed is carried from look to look at
    Gauss-Legendre nodes, and each boundary is found by bisection.
    """
    normal = NormalDist()
    crit = normal.inv_cdf(1 - alpha / 4)
    spent = lambda t: 4 - 4 * normal.cdf(crit / math.sqrt(t))
    nodes, share = np.polynomial.legendre.leggauss(points)
    tail = lambda x: 0.5 * np.vectorize(math.erfc)(x / math.sqrt(2))
    out, at, weight, before, done = [], np.zeros(1), np.ones(1), 0.0, 0.0
    for t in fractions:
        step = t - before
        if step <= 0:  # nothing new since the last look
            out.append(out[-1] if out else math.inf)
            continue
        target, sd = spent(min(t, 1.0)) - done, math.sqrt(step)
        leave = lambda c: float((weight * (tail((c - at) / sd) + tail((c + at) / sd))).sum())  # noqa: B023, E731
        low, high = 0.0, 12.0 * math.sqrt(t)
        for _ in range(70):
            mid = (low + high) / 2
            low, high = (mid, high) if leave(mid) > target else (low, mid)
        out.append(high / math.sqrt(t))
        x = high * nodes
        density = np.exp(-((x[:, None] - at[None, :]) ** 2) / (2 * step)) @ weight / (sd * math.sqrt(2 * math.pi))
        at, weight, before, done = x, density * high * share, t, done + leave(high)
    return out


def with_spending_boundary(looks: DataFrame, keys: Sequence[str], alpha: float = 0.05, planned: str | None = None) -> DataFrame:
    """Looks with ``fraction``, the share of the planned information, and
    ``boundary``, which spends ``alpha`` over the fractions the group really has.

    Information is n_c n_t / (n_c + n_t); the plan is the column ``planned``, or
    the group's last look.  A group's looks are few rows and are solved in one
    task; looks before both arms have users carry no information and no boundary.
    """
    info = F.expr(f"CASE WHEN n_c > 0 AND n_t > 0 THEN CAST(n_c AS DOUBLE) * n_t / (n_c + n_t) END")
    rows = looks.withColumn("_info", info).withColumn("_plan", F.col(planned).cast("double") if planned else F.lit(None).cast("double"))
    rows = rows.withColumns({"fraction": F.lit(None).cast("double"), "boundary": F.lit(None).cast("double")})
    known: dict[tuple[float, ...], list[float]] = {}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("look")
        info, plan = pdf["_info"].to_numpy(float), pdf["_plan"].to_numpy(float)
        whole = plan[0] if plan[0] > 0 else np.nanmax(info, initial=0.0)
        if whole > 0:
            t = np.minimum(info / whole, 1.0)
            some = np.isfinite(t)
            at = tuple(np.round(t[some], 9).tolist())
            if at not in known:
                known[at] = spending_boundaries(at, alpha)
            pdf.loc[some, "fraction"] = t[some]
            pdf.loc[some, "boundary"] = known[at]
        return pdf

    return rows.groupBy(*keys).applyInPandas(solve, rows.schema).drop("_info", "_plan")


def with_msprt(looks: DataFrame, tau: float | str, keys: Sequence[str] = (), order: str = "look",
               name: str = "msprt_p") -> DataFrame:
    """Always-valid p value of a normal-mixture sequential ratio test: running
    minimum of 1 / likelihood ratio.  ``tau`` may name a column."""
    t = tau if isinstance(tau, str) else num(tau)
    p_c, p_t = div("conv_c", "n_c"), div("conv_t", "n_t")
    v = (f"CASE WHEN n_c > 0 AND n_t > 0 THEN greatest({div(f'{p_c} * (1D - {p_c})', 'n_c')}"
         f" + {div(f'{p_t} * (1D - {p_t})', 'n_t')}, {num(VARIANCE_FLOOR)}) END")
    looks = looks.withColumns(exprs(_v=v, _d=f"{p_t} - {p_c}", _t2=f"{t} * {t}"))
    inverse = "least(1D, sqrt((_v + _t2) / _v) * exp(-_t2 * _d * _d / (2D * _v * (_v + _t2))))"
    looks = looks.withColumn("_inv", F.expr(inverse))
    return looks.withColumn(name, F.expr(f"min(_inv) OVER {window_sql(keys, order)}")).drop("_v", "_d", "_t2", "_inv")


def stopping_rules(looks: DataFrame, keys: Sequence[str], n_looks: int, c_obf: float | str, tau: float) -> DataFrame:
    """First crossing of four rules per group: NULL look if the rule never stops.
    ``looks`` are cumulative counts with z; ``c_obf`` may name a column."""
    crit = num(z_crit())
    rules = {"fixed_horizon": f"look = {n_looks} AND abs(z) > {crit}", "naive_peeking": f"abs(z) > {crit}",
             "obrien_fleming": f"abs(z) > {obf_boundary(c_obf, 'look', n_looks)}", "msprt": "msprt_p < 0.05"}
    return with_msprt(looks, tau, keys).groupBy(*keys).agg(
        *[F.expr(f"min(look) FILTER (WHERE {cond}) AS {r}") for r, cond in rules.items()])


RULES = ("fixed_horizon", "naive_peeking", "obrien_fleming", "msprt")


def summarise_rules(stops: DataFrame, n_looks: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rejection rate and mean looks used per rule (all looks when it never stops;
    the fixed horizon always uses all)."""
    aggs = []
    for r in RULES:
        used = F.lit(n_looks) if r == "fixed_horizon" else F.coalesce(F.col(r), F.lit(n_looks))
        aggs += [F.avg(F.col(r).isNotNull().cast("int")).alias(f"{r}_rate"), F.avg(used).alias(f"{r}_looks")]
    wide = stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *aggs)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_rate").alias("reject_rate"),
                              F.col(f"{r}_looks").alias("avg_looks_used")) for r in RULES])
    return wide.select(*keys, "runs", F.inline(rows))


def obf_calibration(looks: DataFrame, keys: Sequence[str], n_looks: int, alpha: float = 0.05) -> DataFrame:
    """Constant c whose boundary is crossed by alpha of the null groups: quantile
    of max |z_k| / sqrt(K / k).  One value per replay enters the quantile."""
    per_run = looks.groupBy(*keys).agg(F.expr(f"max(abs(z) / {obf_boundary(1.0, 'look', n_looks)}) AS _s"))
    return per_run.agg(F.count("_s").alias("runs"), F.percentile("_s", F.lit(1 - alpha)).alias("c_obf"))
