"""Reference SQL of the replay studies.  Every sample size, loss rate and
scenario is built from its own full set of rows, without nesting."""

from oracles.monitoring import CALIBRATED, looks, lifted_looks, stops, with_msprt
from oracles.parts import (salt, CUSTOMERS, EVENT_USERS, LINES, Z975, arm_counts, coded, draw, injected, moments, orders, p_norm, p_t,
                           prop_cols, r, replays, split_rows, u, welch_cols, z_expr)
from oracles.tables import CODED
from oracles.tests import CDF, judged, family, trend

O = orders()
CONTROL = f"(SELECT * FROM {CODED} WHERE arm = 'control')"


def _hit(cond: str) -> str:
    return r(f"avg(CASE WHEN {cond} THEN 1 ELSE 0 END)")


def _aa(metric: str) -> str:
    rows = split_rows(CONTROL, 200)
    return f"""SELECT '{metric}' AS metric, count(*) AS runs, max(nc + nt)::BIGINT AS control_rows, {_hit(p_norm('z') + ' < 0.05')} AS false_positive_rate
      FROM (SELECT *, {z_expr()} AS z FROM {arm_counts(rows, 'replay', metric)})"""


def _scene(name: str, cols: str, effects: set[str], streams: tuple[str, ...]) -> str:
    rows = injected(CODED, replays(1, streams=("arm", *streams)), effects, f"(SELECT {cols})")
    return f"""SELECT '{name}' AS scenario, day::BIGINT AS day, arm, count(*) AS users, sum(converted)::BIGINT AS conversions,
      {r('sum(revenue)', 2)} AS revenue FROM {rows} GROUP BY day, arm"""


INJECT = " UNION ALL ".join([
    _scene("lift", "0.2e0 AS lift", {"lift"}, ("lift",)), _scene("harm", "-0.2e0 AS lift", {"lift"}, ("lift",)),
    _scene("novelty", "0e0 AS lift, 0.6e0 AS novelty_boost, 3e0 AS novelty_halflife", {"lift", "novelty"}, ("lift",)),
    _scene("drop", "0.1e0 AS srm_drop_rate", {"drop"}, ("drop",)),
    _scene("whale", "0.05e0 AS whale_rate, 50e0 AS whale_multiplier", {"whale"}, ("whale",)),
    _scene("ramp", "3 AS ramp_days, 0.1e0 AS ramp_treat_share", {"ramp"}, ()),
    _scene("sale", "list_concat([0.12e0, 0.12e0, 0.12e0], list_transform(range(11), lambda i: 0.04e0)) AS daily_base", {"base"}, ("base",)),
])

PEEK = f"""WITH c AS (SELECT * FROM {looks(arm_counts(split_rows(CODED, 100), 'replay, slot'), 'replay', 'slot')}),
  k AS (SELECT DISTINCT looks, (56 * j // looks) - 1 AS slot FROM (SELECT unnest([1, 2, 3, 5, 7, 14, 28, 56]) AS looks), range(1, 57) t(j) WHERE j <= looks),
  m AS (SELECT looks, replay, max(abs(z)) AS z FROM c JOIN k USING (slot) GROUP BY looks, replay)
  SELECT looks::BIGINT AS looks, count(*) AS runs, {_hit(f'z > {Z975}')} AS false_positive_rate FROM m GROUP BY looks"""


def _rule(name: str) -> str:
    used = "14" if name == "fixed_horizon" else f"coalesce({name}, 14)"
    return f"SELECT lift, {r(CALIBRATED)} AS c_obf, count(*) AS runs, '{name}' AS rule, {_hit(f'{name} IS NOT NULL')} AS reject_rate, {r(f'avg({used})')} AS avg_looks_used FROM s GROUP BY lift"


RULES = f"""WITH s AS MATERIALIZED (SELECT * FROM {stops(lifted_looks(60, ('0e0', '0.10e0')), 'lift, replay')}) """ + " UNION ALL ".join(
    _rule(n) for n in ("fixed_horizon", "naive_peeking", "obrien_fleming", "msprt"))

_cost_rows = injected(CODED, replays(40, streams=("arm", "lift", "sample")), {"lift"},
                      "(SELECT 0.3e0 AS lift, unnest([1.0e0, 1.25e0, 1.5e0, 2.0e0, 2.5e0, 3.0e0]) AS mult)",
                      where=f"{u('k_sample')} < mult / 3.0e0")
COST = f"""SELECT mult AS sample_multiplier, count(*) AS runs, {_hit('p < 0.05')} AS msprt_power FROM (SELECT mult, replay, min(mp) AS p
  FROM {with_msprt(looks(arm_counts(_cost_rows, 'mult, replay, day'), 'mult, replay'), 'mult, replay', 'pow(0.005e0, 2)')} GROUP BY mult, replay) GROUP BY mult"""

_ZB = {0.10: -1.2815515655446004, 0.20: -0.8416212335729142, 0.30: -0.5244005127080409, 0.50: 0.0,
       0.70: 0.5244005127080407, 0.80: 0.8416212335729143, 0.90: 1.2815515655446004}
_powers = "(SELECT 0.4e0 AS lift, pw, zb FROM (VALUES " + ", ".join(f"({p}e0, {z}e0)" for p, z in _ZB.items()) + ") v(pw, zb))"
_need = f"ceil(pow({Z975} + zb, 2) * (base_rate * (1 - base_rate) + base_rate * 1.4e0 * (1 - base_rate * 1.4e0)) / pow(base_rate * 1.4e0 - base_rate, 2))"
_curse = injected(CODED, replays(100, streams=("arm", "lift", "sample")), {"lift"}, _powers, where=f"{u('k_sample')} * all_units < 2 * {_need}")
CURSE = f"""WITH t AS (SELECT *, {z_expr(True)} AS z, (xt / nt - xc / nc) / nullif(xc / nc, 0) AS est FROM {arm_counts(
    f"(SELECT *, {_need} AS need FROM {_curse})", 'pw, need, replay')})
  SELECT pw AS target_power, need::BIGINT AS n_per_arm, count(*) AS runs, {r('avg((nc + nt) / 2)')} AS avg_users_per_arm,
    avg(nc + nt) < 1.9 * need AS table_too_small, {_hit('abs(z) > 1.96')} AS power,
    {r('avg(abs(est)) FILTER (abs(z) > 1.96) / 0.4e0')} AS exaggeration_ratio,
    {r('avg(CASE WHEN est < 0 THEN 1 ELSE 0 END) FILTER (abs(z) > 1.96)')} AS wrong_sign_share FROM t GROUP BY pw, need"""

_SRM = "pow(nt - (nc + nt) * 0.5e0, 2) / ((nc + nt) * 0.25e0)"
_damage = injected(CODED, replays(60, streams=("arm", "drop")), {"drop"}, "(SELECT unnest([0e0, 0.005e0, 0.01e0, 0.02e0, 0.03e0, 0.05e0]) AS srm_drop_rate)")
DAMAGE = f"""SELECT srm_drop_rate AS drop_rate, count(*) AS runs, {r('avg(effect / base)')} AS avg_fake_rel_lift,
  {_hit(p_norm('z') + ' < 0.05')} AS false_positive_rate, {_hit(p_norm(f'sqrt({_SRM})') + ' < 0.001')} AS srm_detected
  FROM {prop_cols(arm_counts(_damage, 'srm_drop_rate, replay'))} GROUP BY srm_drop_rate"""
_traffic = injected(CODED, replays(60, streams=("arm", "drop", "sample")), {"drop"},
                    "(SELECT 0.05e0 AS srm_drop_rate, unnest([0.0625e0, 0.125e0, 0.25e0, 0.5e0, 1.0e0]) AS ts)", where=f"{u('k_sample')} < ts")
DETECT = f"""SELECT ts AS traffic_share, count(*) AS runs, {r('avg(nc + nt)')} AS avg_units, {_hit(p_norm(f'sqrt({_SRM})') + ' < 0.001')} AS srm_detected
  FROM {arm_counts(_traffic, 'ts, replay')} GROUP BY ts"""

_nov = injected(CODED, replays(30, streams=("arm", "lift")), {"lift", "novelty"}, """(SELECT *, 3e0 AS novelty_halflife FROM (VALUES
  ('no novelty, no effect', 0e0, 0e0), ('novelty only', 0e0, 0.20e0), ('novelty + real lift', 0.05e0, 0.20e0), ('real lift only', 0.05e0, 0e0))
  v(scenario, lift, novelty_boost))""")


def _window(lo: int, hi: int) -> str:
    return f"(SELECT scenario, lift, replay, {z_expr(True)} AS z, (xt / nt - xc / nc) / (xc / nc) AS e FROM {arm_counts(f'(SELECT * FROM n WHERE day BETWEEN {lo} AND {hi})', 'scenario, lift, replay')})"


NOVEL = f"""WITH n AS MATERIALIZED (SELECT scenario, lift, replay, day, arm, converted FROM {_nov}),
  a AS (SELECT scenario, lift, avg(e) AS e, avg(CASE WHEN abs(z) > 1.96 THEN 1 ELSE 0 END) AS x FROM {_window(0, 2)} GROUP BY scenario, lift),
  b AS (SELECT scenario, avg(e) AS e FROM {_window(0, 13)} GROUP BY scenario),
  c AS (SELECT scenario, avg(e) AS e, avg(CASE WHEN abs(z) > 1.96 THEN 1 ELSE 0 END) AS x FROM {_window(7, 13)} GROUP BY scenario),
  t AS (SELECT scenario, avg(CASE WHEN slope * sqrt(sxx) < -1.6448536269514722 THEN 1 ELSE 0 END) AS f FROM {trend('n', 'scenario, replay')} GROUP BY scenario)
  SELECT scenario, lift AS true_long_run_lift, {r('a.e')} AS est_3d, {r('a.x')} AS reject_3d, {r('b.e')} AS est_14d, {r('c.e')} AS est_week2,
    {r('c.x')} AS reject_week2, {r('f')} AS novelty_flagged FROM a JOIN b USING (scenario) JOIN c USING (scenario) JOIN t USING (scenario)"""

ANYFP = f"""WITH f AS (SELECT f.*, n_metrics FROM {family(100, 50)} f, (SELECT unnest([1, 2, 3, 5, 10, 20, 50]) AS n_metrics) WHERE metric_no <= n_metrics),
  j AS (SELECT n_metrics, replay, bool_or(p < 0.05) AS raw, bool_or(holm_reject) AS h, bool_or(bh_reject) AS b FROM {judged('f', 'n_metrics, replay')} GROUP BY n_metrics, replay)
  SELECT n_metrics::BIGINT AS n_metrics, count(*) AS runs, {_hit('raw')} AS uncorrected, {_hit('h')} AS holm, {_hit('b')} AS bh FROM j GROUP BY n_metrics"""


VARIANT = f"""WITH a AS (SELECT n_variants, replay, floor({u('k_label')} * n_variants)::INT AS label, sum(converted)::DOUBLE AS x, count(*)::DOUBLE AS n
    FROM {CODED}, {replays(100, streams=('label',))}, (SELECT unnest([2, 3, 5, 8]) AS n_variants) GROUP BY ALL),
  j AS (SELECT t.n_variants, t.replay, c.x AS xc, c.n AS nc, t.x AS xt, t.n AS nt FROM a t JOIN a c ON c.n_variants = t.n_variants AND c.replay = t.replay
    AND c.label = 0 AND t.label > 0),
  p AS (SELECT n_variants, replay, {p_norm('z')} AS p FROM (SELECT *, {z_expr()} AS z FROM j)),
  g AS (SELECT n_variants, replay, bool_or(p < 0.05) AS raw, bool_or(holm_reject) AS h FROM {judged('p', 'n_variants, replay')} GROUP BY n_variants, replay)
  SELECT n_variants::BIGINT AS n_variants, count(*) AS runs, {_hit('raw')} AS uncorrected, {_hit('h')} AS holm FROM g GROUP BY n_variants"""


def _seg(first: int, col: str, name: str) -> str:
    rows = injected(CODED, replays(50, first), set())
    return f"""SELECT '{name}' AS slicing, replay - {first - 1} AS replay, {col}::VARCHAR AS segment, {z_expr(True)} AS z,
      abs((xt / nt - xc / nc) / greatest(xc / nc, 1e-9)) AS lift FROM {arm_counts(rows, f'replay, {col}')}"""


HACK = f"""WITH a AS MATERIALIZED ({_seg(1, 'segment', 'market')} UNION ALL {_seg(1, 'nation', 'nation')}),
  f AS MATERIALIZED ({_seg(51, 'segment', 'market')} UNION ALL {_seg(51, 'nation', 'nation')}),
  n AS (SELECT slicing, replay, count(*) AS m, max(abs(z)) AS mz FROM a GROUP BY slicing, replay),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY slicing, replay ORDER BY abs(z) DESC, segment) = 1),
  j AS (SELECT n.*, b.lift, f.z AS z2, {p_norm('mz')} AS p FROM n JOIN b USING (slicing, replay) LEFT JOIN f USING (slicing, replay, segment))
  SELECT slicing, max(m) AS n_segments, count(*) AS runs, {_hit('mz > 1.96')} AS any_segment_significant,
    {r('avg(lift) FILTER (mz > 1.96)')} AS avg_reported_abs_lift, {_hit('p < 0.05 / m')} AS bonferroni_any_significant,
    {r('avg(CASE WHEN abs(z2) > 1.96 THEN 1 ELSE 0 END) FILTER (mz > 1.96)')} AS followup_confirms FROM j GROUP BY slicing"""

_G = "whale_rate, lift, replay"
_tail_rows = injected(
    CODED, replays(6, streams=("arm", "lift", "whale")), {"lift", "whale"},
    "(SELECT 50e0 AS whale_multiplier, w AS whale_rate, l AS lift FROM (SELECT unnest([0e0, 0.005e0]) AS w), (SELECT unnest([0e0, 0.10e0]) AS l))")
_w = " ".join(f"WHEN d < {int(c * 4294967296)} THEN {k}" for k, c in enumerate(CDF))


def _sig(y: str, name: str) -> str:
    return f"""SELECT whale_rate, lift, replay, '{name}' AS method, ({p_t('t', 'dof')} < 0.05) AS hit
      FROM {welch_cols(f"(SELECT {_G}, {moments(y)} FROM x GROUP BY {_G})")}"""


TAILS = f"""WITH b AS MATERIALIZED (SELECT {_G}, arm, hs, revenue, x_strong FROM {_tail_rows}),
  g AS (SELECT {_G}, quantile_cont(revenue, 0.99) AS cap, covar_samp(revenue, x_strong) / var_samp(x_strong) AS theta, avg(x_strong) AS xb FROM b GROUP BY {_G}),
  x AS MATERIALIZED (SELECT b.*, least(revenue, cap) AS wins, revenue - theta * (x_strong - xb) AS adj FROM b JOIN g USING ({_G})),
  o AS (SELECT {_G}, g, sum(w * revenue) FILTER (arm = 'treatment') / sum(w) FILTER (arm = 'treatment')
    - sum(w * revenue) FILTER (arm = 'control') / sum(w) FILTER (arm = 'control') AS d FROM
    (SELECT {_G}, g, arm, revenue, CASE {_w} ELSE 8 END AS w FROM (SELECT {_G}, g, arm, revenue, {draw(salt('boot', '(replay * 1000 + g)'))} AS d
      FROM b, (SELECT unnest(generate_series(1, 40)) AS g))) GROUP BY {_G}, g),
  m AS ({_sig('revenue', 'welch')} UNION ALL {_sig('wins', 'winsorized_p99')} UNION ALL {_sig('adj', 'cuped')} UNION ALL
    SELECT {_G}, 'bootstrap', NOT (0 BETWEEN quantile_cont(d, 0.025) AND quantile_cont(d, 0.975)) FROM o GROUP BY {_G})
  SELECT whale_rate, lift AS true_conv_lift, method, count(*) AS runs, {_hit('hit')} AS reject_rate FROM m GROUP BY whale_rate, lift, method"""

_clusters = f"""(SELECT 'events' AS source, unit_id, sessions, clicks FROM {EVENT_USERS}
  UNION ALL SELECT 'orders', unit_id, sessions, clicks FROM {CUSTOMERS}
  UNION ALL SELECT 'lines', cluster_id, count(*), sum(converted)::BIGINT FROM {LINES} GROUP BY cluster_id)"""


def _rv(s: str) -> str:
    return f"(vn{s} / pow(md{s}, 2) - 2 * mn{s} * cv{s} / pow(md{s}, 3) + pow(mn{s}, 2) * vd{s} / pow(md{s}, 4)) / n{s}"


_cells = ", ".join(
    f"count(*) FILTER (arm = '{n}')::DOUBLE AS n{s}, avg(clicks) FILTER (arm = '{n}') AS mn{s}, avg(sessions) FILTER (arm = '{n}') AS md{s}, "
    f"var_samp(clicks) FILTER (arm = '{n}') AS vn{s}, var_samp(sessions) FILTER (arm = '{n}') AS vd{s}, covar_samp(clicks, sessions) FILTER (arm = '{n}') AS cv{s}, "
    f"sum(clicks) FILTER (arm = '{n}')::DOUBLE AS x{s}, sum(sessions) FILTER (arm = '{n}')::DOUBLE AS e{s}"
    for s, n in (("c", "control"), ("t", "treatment")))
UNIT = f"""WITH a AS (SELECT c.*, replay, CASE WHEN {u('k_arm')} < 0.5e0 THEN 'treatment' ELSE 'control' END AS arm
    FROM {coded(_clusters, 'unit_id')} c, {replays(60)}),
  m AS (SELECT source, replay, {_cells} FROM a GROUP BY source, replay),
  t AS (SELECT *, (mnt / mdt - mnc / mdc) / sqrt({_rv('c')} + {_rv('t')}) AS zd, {z_expr(False, 'xc', 'ec', 'xt', 'et')} AS zn FROM m)
  SELECT source, count(*) AS runs, max(nc + nt)::BIGINT AS clusters, {_hit(f'abs(zn) > {Z975}')} AS naive_fpr, {_hit(p_norm('zd') + ' < 0.05')} AS delta_fpr
  FROM t GROUP BY source"""

_simp = injected(CODED, replays(60, streams=("arm", "base")), {"ramp", "base"},
                 "(SELECT 3 AS ramp_days, 0.10e0 AS ramp_treat_share, list_concat([0.08e0, 0.08e0, 0.08e0], list_transform(range(11), lambda i: 0.04e0)) AS daily_base)")
SIMPSON = f"""WITH n AS MATERIALIZED (SELECT replay, day, arm, converted FROM {_simp}),
  d AS (SELECT replay, sum((nc + nt) * (xt / nt - xc / nc)) / sum(nc + nt) AS s FROM {arm_counts('n', 'replay, day')} WHERE nc > 0 AND nt > 0 GROUP BY replay),
  p AS (SELECT * FROM {prop_cols(arm_counts('n', 'replay'))})
  SELECT count(*) AS runs, {r('avg(effect)')} AS pooled_avg_effect, {r('avg(s)')} AS stratified_avg_effect,
    {_hit(p_norm('z') + ' < 0.05')} AS pooled_false_positive_rate FROM p JOIN d USING (replay)"""

CUPED = f"""WITH a AS (SELECT lift, replay, arm, x_strong, CASE WHEN arm = 'treatment' THEN amount * (1 + lift) ELSE amount END AS y FROM
    (SELECT c.* EXCLUDE (arm), replay, lift, CASE WHEN {u('k_arm')} < 0.5e0 THEN 'treatment' ELSE 'control' END AS arm
      FROM {CODED} c, {replays(60)}, (SELECT unnest([0e0, 0.02e0]) AS lift))),
  g AS (SELECT lift, replay, covar_samp(y, x_strong) / var_samp(x_strong) AS theta, avg(x_strong) AS xb FROM a GROUP BY lift, replay),
  x AS (SELECT a.*, y - theta * (x_strong - xb) AS adj FROM a JOIN g USING (lift, replay)),
  w AS (SELECT lift, replay, {p_t('t', 'dof')} AS p FROM {welch_cols(f"(SELECT lift, replay, {moments('y')} FROM x GROUP BY lift, replay)")}),
  v AS (SELECT lift, replay, {p_t('t', 'dof')} AS q FROM {welch_cols(f"(SELECT lift, replay, {moments('adj')} FROM x GROUP BY lift, replay)")})
  SELECT lift, count(*) AS runs, {_hit('p < 0.05')} AS reject_raw, {_hit('q < 0.05')} AS reject_cuped FROM w JOIN v USING (lift, replay) GROUP BY lift"""

RHO = f"""WITH z AS (SELECT (amount - my) / sy AS y, (pre_x - mx) / sx AS e FROM {O}, (SELECT avg(amount) AS my, stddev_samp(amount) AS sy, avg(pre_x) AS mx, stddev_samp(pre_x) AS sx FROM {O})),
  x AS (SELECT rho, y, rho * y + sqrt(1 - rho * rho) * e AS x FROM z, (SELECT unnest([0e0, 0.2e0, 0.4e0, 0.6e0, 0.8e0, 0.9e0]) AS rho))
  SELECT rho, {r('1 - (var_samp(y) - pow(covar_samp(y, x), 2) / var_samp(x)) / var_samp(y)')} AS measured_reduction, {r('rho * rho')} AS theory_rho2 FROM x GROUP BY rho"""

SQL = {
    "aa_replay": _aa("converted") + " UNION ALL " + _aa("visit"), "inject_scenario": INJECT, "peeking_by_looks": PEEK,
    "compare_stopping_rules": RULES, "msprt_sample_cost": COST, "winners_curse": CURSE, "srm_damage": DAMAGE, "srm_detection": DETECT,
    "novelty_scenarios": NOVEL, "any_false_positive": ANYFP, "variant_false_positive": VARIANT, "segment_hacking": HACK, "heavy_tail_methods": TAILS,
    "unit_of_analysis": UNIT, "simpson_ramp": SIMPSON, "cuped_replay": CUPED, "cuped_rho_grid": RHO,
}
