"""Effects over the life of an experiment, from the daily panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.stats import div, exprs, num, p_norm, pooled_z

VARIANCE_FLOOR = 1e-12


def novelty_trend(panel: DataFrame, keys: Sequence[str] = (), day_col: str = "day") -> DataFrame:
    """Slope of the daily effect on the day, weighted by inverse variance.

    ``trend_z`` is slope over its error; ``half_gap`` is the mean effect of the
    first half of the days minus that of the rest.  If any day lacks an arm the
    whole trend is NULL.  The input has one row per group and day.
    """
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    var = f"{div('p_c * (1D - p_c)', 'n_c')} + {div('p_t * (1D - p_t)', 'n_t')}"
    daily = panel.selectExpr(
        *keys, f"CAST({day_col} AS DOUBLE) AS _x", "p_t - p_c AS _e",
        f"1D / CASE WHEN p_c IS NOT NULL AND p_t IS NOT NULL THEN greatest({var}, {num(VARIANCE_FLOOR)}) END AS _w",
        f"row_number() OVER ({part} ORDER BY {day_col}) AS _i", f"count(1) OVER ({part}) AS _days")
    s = daily.groupBy(*keys).agg(*[F.expr(e) for e in (
        "max(_days) AS days", "count(_e) = max(_days) AND max(_days) > 1 AS _whole", "sum(_w) AS _sw",
        "sum(_w * _x) AS _swx", "sum(_w * _e) AS _swe", "sum(_w * _x * _x) AS _swxx", "sum(_w * _x * _e) AS _swxe",
        "avg(_e) FILTER (WHERE _i <= floor(_days / 2)) AS _first", "avg(_e) FILTER (WHERE _i > floor(_days / 2)) AS _rest")])
    s = s.withColumns(exprs(
        _sxx=f"CASE WHEN _whole THEN greatest(_swxx - {div('_swx * _swx', '_sw')}, 0D) END",
        _sxe=f"CASE WHEN _whole THEN _swxe - {div('_swx * _swe', '_sw')} END"))
    slope = div("_sxe", "_sxx")
    return s.selectExpr(*keys, "days", f"{slope} AS slope", f"{slope} * sqrt(_sxx) AS trend_z",
                        "CASE WHEN _whole THEN _first - _rest END AS half_gap")


WINDOWS = (("first_3d", 0, 3), ("first_7d", 0, 7), ("first_14d", 0, 14), ("second_week", 7, 14))


def window_estimates(panel: DataFrame, keys: Sequence[str] = (), day_col: str = "day",
                     windows: Sequence[tuple[str, int, int]] = WINDOWS) -> DataFrame:
    """Effect in each day window, from conditional sums over the daily panel."""
    cells = ", ".join(f"named_struct('window', '{n}', '_lo', {lo}, '_hi', {hi})" for n, lo, hi in windows)
    long = panel.selectExpr("*", f"inline(array({cells}))").where(f"{day_col} >= _lo AND {day_col} < _hi")
    sums = long.groupBy(*keys, "window").agg(*[F.sum(c).alias(c) for c in ("conv_c", "n_c", "conv_t", "n_t")])
    p_c, p_t = div("conv_c", "n_c"), div("conv_t", "n_t")
    out = sums.withColumns(exprs(effect=f"{p_t} - {p_c}", rel_lift=div(f"({p_t} - {p_c})", p_c),
                                 z=pooled_z(floor=VARIANCE_FLOOR)))
    return out.withColumns(exprs(p_value=p_norm("z"), significant="abs(z) > 1.96"))
