"""Reference SQL of the sequential monitoring reports."""

from oracles.parts import EVENTS, Z975, arm_counts, injected, orders, p_norm, r, replays, z_expr
from oracles.tables import CODED

O = orders()

# Constant of the O'Brien-Fleming boundary at 5% for 14 and 30 looks.
CALIBRATED = "2.1065468806e0"
BY_LOOKS = f"(CASE n WHEN 14 THEN {CALIBRATED} WHEN 30 THEN 2.1446651237e0 END)"


def looks(source: str, by: str, order: str = "day") -> str:
    """Running counts per ``by``, with z and the look number."""
    run = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    sums = ", ".join(f"sum({c}) {run} AS {c}" for c in ("xc", "nc", "xt", "nt"))
    return f"""(SELECT *, {z_expr(True)} AS z, xc / nullif(nc, 0) AS pc, xt / nullif(nt, 0) AS pt FROM (SELECT {by}, {order},
      row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS look, {sums} FROM {source}))"""


def with_msprt(source: str, by: str, tau2: str) -> str:
    """Running minimum of min(1, 1 / likelihood ratio)."""
    return f"""(SELECT *, min(least(1, 1 / (sqrt(v / (v + {tau2})) * exp({tau2} * pow(pt - pc, 2) / (2 * v * (v + {tau2}))))))
      OVER (PARTITION BY {by} ORDER BY look ROWS UNBOUNDED PRECEDING) AS mp FROM
      (SELECT *, greatest(pc * (1 - pc) / nc + pt * (1 - pt) / nt, 1e-12) AS v FROM {source}))"""


TWO = f"""(SELECT * FROM {arm_counts(O, 'segment, day')} UNION ALL
  SELECT * FROM {arm_counts(f"(SELECT *, 'events' AS segment FROM {EVENTS})", 'segment, day')})"""
LOOKS = looks(TWO, "segment")
FIVE = looks(f"{arm_counts(f'(SELECT *, (unit_id % 5)::VARCHAR AS segment FROM {EVENTS})', 'segment, day')}", "segment")
TAU2 = "pow(0.0025e0, 2)"


def lifted_looks(n: int, lifts: tuple[str, ...]) -> str:
    scen = f"(SELECT unnest([{', '.join(lifts)}]) AS lift)"
    rows = injected(CODED, replays(n, streams=("arm", "lift")), {"lift"}, scen)
    return looks(arm_counts(rows, "lift, replay, day"), "lift, replay")


def stops(source: str, by: str) -> str:
    return f"""(SELECT {by}, min(look) FILTER (look = 14 AND abs(z) > {Z975}) AS fixed_horizon,
      min(look) FILTER (abs(z) > {Z975}) AS naive_peeking,
      min(look) FILTER (abs(z) > {CALIBRATED} * sqrt(14.0 / look)) AS obrien_fleming,
      min(look) FILTER (mp < 0.05) AS msprt FROM {with_msprt(source, by, TAU2)} GROUP BY {by})"""


SQL = {
    "cumulative_looks": f"""SELECT segment, day::BIGINT AS day, look, xc::BIGINT AS conv_c, nc::BIGINT AS n_c, xt::BIGINT AS conv_t,
        nt::BIGINT AS n_t FROM {LOOKS}""",
    "look_zscores": f"SELECT segment, look, {r('pc')} AS p_c, {r('pt')} AS p_t, {r('z')} AS z FROM {LOOKS}",
    "obf_boundaries": f"""SELECT segment, look, n AS n_looks, {r(f'{BY_LOOKS} * sqrt(n / look)')} AS boundary,
        abs(z) > {BY_LOOKS} * sqrt(n / look) AS crossed FROM (SELECT *, count(*) OVER (PARTITION BY segment) AS n FROM {LOOKS})""",
    "msprt": f"SELECT segment, look, {r('mp')} AS msprt_p FROM {with_msprt(LOOKS, 'segment', TAU2)}",
    "spent_error": f"""SELECT segment, look, {r('t')} AS fraction, {r('2 * ' + p_norm('(2.241402727604947 / sqrt(t))'))} AS spent FROM (
        SELECT segment, look, info / max(info) OVER (PARTITION BY segment) AS t FROM (
        SELECT segment, look, CASE WHEN nc > 0 AND nt > 0 THEN nc * nt / (nc + nt) END AS info FROM {LOOKS}))""",
    "msprt_stream": f"SELECT segment, look, {r('mp')} AS msprt_p FROM {with_msprt(FIVE, 'segment', TAU2)}",
    "stopping_rules": f"SELECT * EXCLUDE (lift) FROM {stops(lifted_looks(40, ('0.3e0',)), 'lift, replay')}",
    "obf_calibration": f"""SELECT count(*) AS runs, {r('quantile_cont(s, 0.95)')} AS c_obf FROM
        (SELECT replay, max(abs(z) / sqrt(14.0 / look)) AS s FROM {lifted_looks(100, ('0e0',))} GROUP BY replay)""",
    "msprt_tau_grid": f"""WITH g AS (SELECT l.*, tau FROM {lifted_looks(40, ('0e0', '0.3e0'))} l,
        (SELECT unnest([0.0005e0, 0.001e0, 0.0025e0, 0.005e0, 0.01e0]) AS tau)),
        p AS (SELECT tau, lift, replay, min(mp) AS p FROM {with_msprt('g', 'tau, lift, replay', 'tau * tau')} GROUP BY tau, lift, replay)
        SELECT tau, {r('avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) FILTER (lift = 0)')} AS fpr,
        {r('avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) FILTER (lift > 0)')} AS power FROM p GROUP BY tau""",
}
