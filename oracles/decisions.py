"""Reference SQL of the health checks and the portfolio audit."""

from oracles.monitoring import looks
from oracles.parts import (RESULT, Z975, arm_counts, coded, injected, moments, orders, p_norm, p_t, prop_cols, r, replays,
                           salt, u, welch_cols, z_expr)
from oracles.tables import CATALOG, CODED
from oracles.tests import COUNTS, judged, trend

Z01 = "-2.3263478740408408"
KPOW = "2.801585218112969"            # z_.975 + z_.8
SRM = "pow(nt - (nc + nt) * share, 2) / ((nc + nt) * share * (1 - share))"

DONT, INV, SHIP, NO = ("DON''T TRUST - fix and rerun", "INVESTIGATE before shipping", "SHIP", "NO WIN - don''t ship")

# --- health ------------------------------------------------------------------
_designs = """(SELECT e AS eid, CASE WHEN e % 6 = 5 THEN 0.3e0 ELSE 0.5e0 END AS treat_share,
  CASE e % 6 WHEN 1 THEN 0.5e0 WHEN 5 THEN 0.3e0 ELSE 0e0 END AS lift, CASE WHEN e % 6 = 3 THEN 1.5e0 ELSE 0e0 END AS novelty_boost,
  CASE WHEN e % 6 = 3 THEN 2e0 ELSE 3e0 END AS novelty_halflife, CASE WHEN e % 6 = 2 THEN 0.08e0 ELSE 0e0 END AS srm_drop_rate,
  CASE WHEN e % 6 = 4 THEN 0.02e0 ELSE 0e0 END AS whale_rate, 50e0 AS whale_multiplier FROM range(40) t(e))"""
_many = injected(CODED, replays(40, 0, ("arm", "lift", "drop", "whale"), "experiment_id"), {"lift", "novelty", "drop", "whale"},
                 _designs, share="treat_share", where="eid = experiment_id")
_plans = """(SELECT e AS experiment_id, CASE WHEN e % 6 = 5 THEN 0.3e0 ELSE 0.5e0 END AS share, CASE WHEN e % 4 = 0 THEN 0.10e0 ELSE 0.30e0 END AS planned,
  e IN (6, 7) AS stopped, e = 7 AS sequential FROM range(40) t(e))"""


def outlier_p(source: str, by: str) -> str:
    """Raw and winsorized Welch p values of revenue."""
    m = ", ".join(f"count({c}) FILTER (arm = '{n}')::DOUBLE AS n{s}{p}, avg({c}) FILTER (arm = '{n}') AS m{s}{p}, var_samp({c}) FILTER (arm = '{n}') AS v{s}{p}"
                  for p, c in (("r", "revenue"), ("w", "wins")) for s, n in (("c", "control"), ("t", "treatment")))
    base = f"""(SELECT {by}, {m} FROM (SELECT s.*, CASE WHEN revenue IS NOT NULL THEN least(revenue, cap) END AS wins FROM {source} s
      JOIN (SELECT {by}, quantile_cont(revenue, 0.99) AS cap FROM {source} GROUP BY {by}) q USING ({by})) GROUP BY {by})"""
    w = welch_cols(welch_cols(base, "mcr", "vcr", "ncr", "mtr", "vtr", "ntr", "raw_"), "mcw", "vcw", "ncw", "mtw", "vtw", "ntw", "win_")
    return f"(SELECT {by}, {p_t('raw_t', 'raw_dof')} AS raw_p, {p_t('win_t', 'win_dof')} AS win_p FROM {w})"


def balance(source: str, by: str, x: str = "pre_x") -> str:
    c, t = (f"FILTER (arm = '{n}')" for n in ("control", "treatment"))
    return f"""(SELECT {by}, abs(avg({x}) {t} - avg({x}) {c}) / sqrt((var_samp({x}) {c} + var_samp({x}) {t}) / 2) AS smd,
      sqrt(1 / count(*) {c} + 1 / count(*) {t}) AS unit FROM {source} GROUP BY {by})"""


CRIT1 = "3.290526731491691"           # normal quantile at 1 - 0.001 / 2


def ptext(p: str) -> str:
    return f"CASE WHEN {p} < 0.0001 THEN '<0.0001' ELSE printf('%.4f', {p}) END"


def _p_family() -> str:
    parts = [f"SELECT experiment_id, {i} AS k, {p_norm('z')} AS p FROM (SELECT *, {z_expr()} AS z FROM {arm_counts('x', 'experiment_id', m)})"
             for i, m in enumerate(("converted", "visit", "engaged"))]
    return "(" + " UNION ALL ".join(parts) + ")"


HEALTH = f"""WITH x AS MATERIALIZED (SELECT experiment_id, day, arm, converted, visit, engaged, revenue, pre_x FROM {_many}),
  a AS (SELECT * FROM {prop_cols(arm_counts('x', 'experiment_id'))}),
  n AS (SELECT experiment_id, days, slope * sqrt(sxx) AS tz, gap FROM {trend('x', 'experiment_id')}),
  f AS (SELECT experiment_id, count(*) AS tests, bool_or(k = 0 AND p < 0.05 AND NOT holm_reject) AS bad FROM {judged(_p_family(), 'experiment_id')} GROUP BY experiment_id),
  o AS (SELECT * FROM {outlier_p('x', 'experiment_id')}), b AS (SELECT * FROM {balance('x', 'experiment_id')}),
  j AS MATERIALIZED (SELECT a.*, s.* EXCLUDE (experiment_id), n.* EXCLUDE (experiment_id), f.* EXCLUDE (experiment_id), o.* EXCLUDE (experiment_id), b.* EXCLUDE (experiment_id),
    {p_norm('z')} AS p, {p_norm(f'sqrt({SRM})')} AS srm_p, {KPOW} * sqrt(2 * base * (1 - base) / least(nc, nt)) / base AS mde
    FROM a JOIN {_plans} s USING (experiment_id) JOIN n USING (experiment_id) JOIN f USING (experiment_id) JOIN o USING (experiment_id) JOIN b USING (experiment_id)),
  c AS MATERIALIZED (
    SELECT experiment_id, 1 AS check_no, 'Sample ratio' AS "check", CASE WHEN srm_p < 0.001 THEN 'red' ELSE 'green' END AS status,
      printf('Treatment got %.1f%% of the units, planned %.0f%%; p ', 100 * nt / (nc + nt), 100 * share) || {ptext('srm_p')} AS detail FROM j
    UNION ALL SELECT experiment_id, 2, 'Peeking', CASE WHEN stopped AND NOT sequential THEN 'red' ELSE 'green' END,
      CASE WHEN stopped AND NOT sequential THEN 'Ended before the planned look without a sequential rule' ELSE 'Read at the planned look, or by a sequential rule' END FROM j
    UNION ALL SELECT experiment_id, 3, 'Power', CASE WHEN mde > planned THEN 'yellow' ELSE 'green' END, printf('Smallest detectable change %.1f%%', 100 * mde)
      || CASE WHEN mde > planned THEN printf(', planned for %.0f%%: a win would be exaggerated', 100 * planned) ELSE '' END FROM j
    UNION ALL SELECT experiment_id, 4, 'Multiple testing', CASE WHEN bad THEN 'yellow' ELSE 'green' END,
      tests || ' tests; the first one ' || CASE WHEN bad THEN 'passes alone but not among all (Holm)' ELSE 'keeps its result among all (Holm)' END FROM j
    UNION ALL SELECT experiment_id, 5, 'Novelty', CASE WHEN days >= 7 AND tz < {Z01} AND gap > 0 THEN 'yellow' ELSE 'green' END,
      printf('Daily effects: trend z %+.2f, early less late half %+.4f', tz, gap) FROM j
    UNION ALL SELECT experiment_id, 6, 'Outliers', CASE WHEN (raw_p < 0.05) <> (win_p < 0.05) THEN 'yellow' ELSE 'green' END,
      'Revenue: p ' || {ptext('raw_p')} || ' as it is, ' || {ptext('win_p')} || ' with the top 1% capped' FROM j
    UNION ALL SELECT experiment_id, 7, 'Balance', CASE WHEN smd / unit > {CRIT1} THEN 'red' ELSE 'green' END,
      printf('Largest standardized gap %.4f, z %.1f (limit %.1f)', smd, smd / unit, {CRIT1}) || CASE WHEN smd / unit > {CRIT1} THEN '; the arms were unlike from the start' ELSE '' END FROM j),
  v AS (SELECT experiment_id, max(CASE status WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END) AS worst FROM c GROUP BY experiment_id),
  w AS (SELECT j.*, CASE WHEN worst = 2 THEN '{DONT}' WHEN worst = 1 THEN '{INV}' WHEN p < 0.05 AND effect > 0 THEN '{SHIP}' ELSE '{NO}' END AS verdict
    FROM j JOIN v USING (experiment_id))
"""

# --- report card ------------------------------------------------------------------
_cases = """(SELECT *, 3e0 AS novelty_halflife, 50e0 AS whale_multiplier FROM (VALUES
  ('clean_null', 0e0, 0e0, 0e0, 0e0, 1e0, 1e0), ('clean_win', 0.5e0, 0e0, 0e0, 0e0, 1e0, 1e0), ('srm_bug', 0e0, 0e0, 0.10e0, 0e0, 1e0, 1e0),
  ('novelty_only', 0e0, 1.5e0, 0e0, 0e0, 1e0, 1e0), ('underpowered', 0.04e0, 0e0, 0e0, 0e0, 0.25e0, 1e0),
  ('whale_revenue', 0.10e0, 0e0, 0e0, 0.05e0, 1e0, 1e0), ('imbalanced_arms', 0e0, 0e0, 0e0, 0e0, 1e0, 1.15e0))
  v(scenario, lift, novelty_boost, srm_drop_rate, whale_rate, traffic_share, imbalance))"""
_card = injected(CODED, replays(8, 1, ("arm", "lift", "drop", "whale", "sample")), {"lift", "novelty", "drop", "whale"}, _cases,
                 where=f"{u('k_sample')} < traffic_share")
_SR = "scenario, replay"
CARD = f"""WITH x AS MATERIALIZED (SELECT scenario, replay, day, arm, converted, CASE WHEN scenario = 'whale_revenue' THEN revenue END AS revenue,
    CASE WHEN arm = 'treatment' THEN pre_x * imbalance ELSE pre_x END AS pre_x FROM {_card}),
  a AS (SELECT *, 0.5e0 AS share FROM {prop_cols(arm_counts('x', _SR))}),
  n AS (SELECT scenario, replay, slope * sqrt(sxx) AS tz, gap FROM {trend('x', _SR)}),
  o AS (SELECT * FROM {outlier_p("(SELECT * FROM x WHERE scenario = 'whale_revenue')", _SR)}),
  b AS (SELECT * FROM {balance('x', _SR)}),
  s AS (SELECT scenario, {p_norm(f'sqrt({SRM})')} < 0.001 AS f1, tz < {Z01} AND gap > 0 AS f5,
    {KPOW} * sqrt(2 * base * (1 - base) / least(nc, nt)) / base > 0.20 AS f3, coalesce((raw_p < 0.05) <> (win_p < 0.05), false) AS f6,
    smd / unit > {CRIT1} AS f7, {p_norm('z')} < 0.05 AND effect > 0 AS win FROM a JOIN n USING ({_SR}) LEFT JOIN o USING ({_SR}) JOIN b USING ({_SR})),
  q AS (SELECT *, f1 OR f7 AS red, f3 OR f5 OR f6 AS yellow FROM s)
  SELECT scenario, count(*) AS runs, {', '.join(f"{r(f'avg(CASE WHEN {c} THEN 1 ELSE 0 END)')} AS {n}" for c, n in (
      ('f1', 'fires_sample_ratio'), ('f5', 'fires_novelty'), ('f3', 'fires_power'), ('f6', 'fires_outliers'), ('f7', 'fires_balance'),
      ('NOT red AND NOT yellow AND win', 'verdict_ship'), ('NOT red AND NOT yellow AND NOT win', 'verdict_no_win'),
      ('NOT red AND yellow', 'verdict_investigate'), ('red', 'verdict_dont_trust')))} FROM q GROUP BY scenario"""

# --- audit ----------------------------------------------------------------------
_au = coded("""(SELECT o_orderkey AS unit_id, floor(datediff('day', DATE '1995-01-01', o_orderdate::DATE) / 365)::BIGINT AS quarter,
  (datediff('day', DATE '1995-01-01', o_orderdate::DATE) % 14)::INT AS day, c_mktsegment AS segment, o_totalprice AS amount, 'control' AS arm, 0e0 AS revenue,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS converted, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS engaged
  FROM orders JOIN customer ON c_custkey = o_custkey)""", "unit_id")


def shares(target: str | None) -> str:
    """Catalog with rescaled shares and cumulative bounds."""
    share = "share" if target is None else (
        f"CASE WHEN scenario = 'true_win' THEN {target} ELSE share * (1 - {target}) / sum(share) FILTER (scenario <> 'true_win') OVER () END")
    return f"""(SELECT *, cum_hi - share AS cum_lo FROM (SELECT *, sum(share) OVER (ORDER BY scenario_no ROWS UNBOUNDED PRECEDING) AS cum_hi
      FROM (SELECT * REPLACE ({share} AS share) FROM {CATALOG})))"""


def draws(target: str | None) -> str:
    """Scenario and lift of every (quarter, experiment)."""
    grid = coded(f"(SELECT quarter AS q, units, e::BIGINT AS exp FROM (SELECT quarter, count(*) AS units FROM {_au} GROUP BY quarter), range(40) t(e))", "q * 40 + exp")
    picked = f"(SELECT *, {u('k_label')} AS us, {u('k_lift0')} AS ul0 FROM (SELECT *, {salt('label', '1')} AS k_label, {salt('lift', '1')} AS k_lift0 FROM {grid}))"
    return f"""(SELECT q, units, exp, c.* EXCLUDE (scenario_no, share, lift_lo, lift_hi, cum_lo, cum_hi), lift_lo + (lift_hi - lift_lo) * ul0 AS lift,
      lift_lo + (lift_hi - lift_lo) * ul0 > 0 AND scenario IN ('true_win', 'small_win_underpowered') AS true_win, q * 40 + exp + 100003 AS rep
      FROM {picked} p JOIN {shares(target)} c ON (us >= cum_lo OR scenario_no = 0) AND (us < cum_hi OR scenario_no = 5))"""


def log_ctes(target: str | None = None, p: str = "") -> str:
    """CTEs that end in ``{p}log``."""
    streams = ("arm", "lift", "drop", "whale", "sample")
    scen = f"(SELECT * FROM {p}dr)"
    rows = injected(f"{p}au", "(SELECT 0 AS dummy)", {"lift", "novelty", "drop", "whale"}, scen,
                    where=f"quarter = q AND {u('k_sample')} < traffic_share")
    ks = ", ".join(f"{salt(s, 'rep')} AS k_{s}" for s in streams)
    e = "quarter, exp"
    return f"""{p}au AS MATERIALIZED (SELECT * FROM {_au}), {p}dr AS MATERIALIZED (SELECT *, {ks} FROM {draws(target)}),
  {p}x AS MATERIALIZED (SELECT quarter, exp, day, segment, arm, converted, revenue FROM {rows}),
  {p}l AS (SELECT *, (pt - pc) / nullif(pc, 0) AS lift FROM {looks(arm_counts(f'{p}x', e + ', day'), e)}),
  {p}pk AS (SELECT {e}, arg_min_null(lift, look) FILTER (z > {Z975}) AS pl, min(look) FILTER (z > {Z975}) AS pk, arg_max_null(lift, look) AS fin FROM {p}l GROUP BY {e}),
  {p}rv AS (SELECT {e}, effect > 0 AND {p_t('t', 'dof')} < 0.05 AS rev FROM {welch_cols(f"(SELECT {e}, {moments('revenue')} FROM {p}x GROUP BY {e})")}),
  {p}sg AS (SELECT {e}, arg_min_null((xt / nt - xc / nc) / nullif(xc / nc, 0), segment) AS sl FROM (SELECT *, {z_expr()} AS z FROM {arm_counts(f'{p}x', e + ', segment')})
    WHERE z > 0 AND {p_norm('z')} < 0.05 GROUP BY {e}),
  {p}rg AS (SELECT a.*, 0.5e0 AS share, tz, gap, days FROM {prop_cols(arm_counts(f'{p}x', e))} a
    JOIN (SELECT {e}, days, slope * sqrt(sxx) AS tz, gap FROM {trend(f'{p}x', e)}) USING ({e})),
  {p}vd AS (SELECT {e}, effect / nullif(base, 0) AS rl, CASE WHEN {p_norm(f'sqrt({SRM})')} < 0.001 THEN '{DONT}'
    WHEN {KPOW} * sqrt(2 * base * (1 - base) / least(nc, nt)) / base > 0.20 OR (days >= 7 AND tz < {Z01} AND gap > 0) THEN '{INV}'
    WHEN {p_norm('z')} < 0.05 AND effect > 0 THEN '{SHIP}' ELSE '{NO}' END AS verdict FROM {p}rg),
  {p}log AS MATERIALIZED (SELECT k.quarter, k.exp, d.scenario, d.lift AS true_lift, d.true_win,
    CASE WHEN pk IS NOT NULL THEN 'peek' WHEN rev THEN 'revenue' WHEN g.exp IS NOT NULL THEN 'segment' ELSE 'none' END AS naive_how,
    CASE WHEN pk IS NOT NULL THEN pl WHEN rev THEN fin WHEN g.exp IS NOT NULL THEN sl ELSE fin END AS naive_lift,
    (pk IS NOT NULL OR coalesce(rev, false) OR g.exp IS NOT NULL) AS naive_ship,
    verdict = '{SHIP}' AS rigorous_ship, rl AS rigorous_lift, verdict AS rigorous_verdict
    FROM {p}pk k JOIN {p}dr d ON d.q = k.quarter AND d.exp = k.exp JOIN {p}rv v ON v.quarter = k.quarter AND v.exp = k.exp
    LEFT JOIN {p}sg g ON g.quarter = k.quarter AND g.exp = k.exp JOIN {p}vd w ON w.quarter = k.quarter AND w.exp = k.exp)"""


MARGIN = "(2000000e0 * 12 * 0.05e0 * 1000 * 0.10e0)"


def score(log: str, cost: str = "500000e0", delay: str = "3e0", extra: str = "") -> str:
    """Both analysts' scores per quarter."""
    def side(who: str, months: str) -> str:
        return f"""SELECT {extra}'{who}' AS analyst, quarter, count(*) FILTER ({who}_ship) AS shipped, count(*) FILTER ({who}_ship AND NOT true_win) AS false_wins,
          count(*) FILTER ({who}_ship AND true_win) AS true_wins_shipped, count(*) FILTER (true_win AND NOT {who}_ship) AS true_wins_missed,
          avg({who}_lift) FILTER ({who}_ship) AS avg_reported_lift, avg(true_lift) FILTER ({who}_ship) AS avg_true_lift,
          count(*) FILTER ({who}_ship AND NOT true_win) * {cost} AS cost_false,
          coalesce(sum(true_lift * {MARGIN} * {months} / 12) FILTER (true_win AND NOT {who}_ship), 0) AS cost_missed FROM {log} GROUP BY ALL"""
    months = f"(CASE WHEN starts_with(rigorous_verdict, 'NO WIN') THEN 12e0 ELSE {delay} END)"
    return f"""(SELECT *, false_wins / nullif(shipped, 0) AS fdr, cost_false + cost_missed AS total_cost
      FROM ({side('naive', '12e0')} UNION ALL {side('rigorous', months)}))"""


LOG = "WITH " + log_ctes()
_medians = {"shipped": 6, "false_wins": 6, "fdr": 6, "true_wins_shipped": 6, "true_wins_missed": 6, "cost_false": 6, "cost_missed": 1, "total_cost": 1}


def both(col: str, digits: int = 1) -> str:
    return ", ".join(f"{r(f'median({col}) FILTER (analyst = {chr(39)}{w}{chr(39)})', digits)} AS {w}_{col}_median" for w in ("naive", "rigorous"))


def _share_rows(target: str | None, label: str) -> str:
    return f"""SELECT c.scenario, {r('share')} AS share, {r('cum_lo')} AS cum_lo, {r('cum_hi')} AS cum_hi, coalesce(n, 0) AS experiments,
      coalesce(t, 0)::BIGINT AS units, {label} AS target FROM {shares(target)} c
      LEFT JOIN (SELECT scenario, count(*) AS n, sum(units) AS t FROM {draws(target)} GROUP BY scenario) USING (scenario)"""


def _sens(p: str, target: str) -> str:
    return f"SELECT {target} AS true_win_share, {both('fdr', 6)}, {both('false_wins', 6)}, {both('total_cost')} FROM {score(f'{p}log')}"


SQL = {
    "health_checks": HEALTH + 'SELECT experiment_id, check_no::BIGINT AS check_no, "check", status, detail FROM c',
    "health_verdict": HEALTH + f"SELECT experiment_id, {COUNTS}, {RESULT}, verdict, verdict = 'SHIP' AS ship FROM w",
    "health_markdown": HEALTH + f""", t AS (SELECT experiment_id, string_agg('| ' || "check" || ' | ' || CASE status WHEN 'red' THEN '🔴' WHEN 'yellow' THEN '🟡'
        ELSE '🟢' END || ' | ' || detail || ' |', chr(10) ORDER BY check_no) AS lines FROM c GROUP BY experiment_id)
        SELECT experiment_id, verdict, '**Verdict: ' || verdict || '**' || chr(10) || chr(10) || printf('Effect on conversion: %+.4f (%+.1f%% relative), 95%% CI [%+.4f, %+.4f], p = ',
        effect, 100 * effect / base, effect - {Z975} * se, effect + {Z975} * se) || {ptext('p')} || chr(10) || chr(10) || '| Check | Status | Detail |' || chr(10)
        || '|---|---|---|' || chr(10) || lines AS markdown FROM w JOIN t USING (experiment_id)""",
    "checker_report_card": CARD,
    "checker_detection": f"WITH k AS MATERIALIZED ({CARD}) " + " UNION ALL ".join(
        f"""SELECT '{n}' AS "check", {r(f"max(fires_{c}) FILTER (scenario = '{s}')")} AS detection_rate,
        {r(f"avg(fires_{c}) FILTER (scenario IN ('clean_null', 'clean_win'))")} AS false_alarm_rate FROM k"""
        for n, c, s in (("Sample ratio", "sample_ratio", "srm_bug"), ("Novelty", "novelty", "novelty_only"), ("Power", "power", "underpowered"),
                        ("Outliers", "outliers", "whale_revenue"), ("Balance", "balance", "imbalanced_arms"))),
    "clean_ship_rates": f"SELECT scenario, {r('verdict_ship')} AS ship_rate FROM ({CARD}) WHERE scenario IN ('clean_null', 'clean_win')",
    "scenario_shares": " UNION ALL ".join([_share_rows(None, "CAST(NULL AS DOUBLE)"), _share_rows("0.15e0", "0.15e0"), _share_rows("0.35e0", "0.35e0")]),
    "portfolio_draw": f"SELECT * EXCLUDE (q, rep) REPLACE ({r('lift')} AS lift), q AS quarter FROM {draws(None)}",
    "naive_decisions": LOG + f" SELECT quarter, exp, naive_ship, {r('naive_lift')} AS naive_lift, naive_how FROM log",
    "rigorous_decisions": LOG + f" SELECT quarter, exp, rigorous_ship, {r('rigorous_lift')} AS rigorous_lift, rigorous_verdict FROM log",
    "decision_log": LOG + f" SELECT * REPLACE ({r('true_lift')} AS true_lift, {r('naive_lift')} AS naive_lift, {r('rigorous_lift')} AS rigorous_lift) FROM log",
    "quarter_score": LOG + f""" SELECT * REPLACE ({r('avg_reported_lift')} AS avg_reported_lift, {r('avg_true_lift')} AS avg_true_lift, {r('fdr')} AS fdr,
        {r('cost_missed', 1)} AS cost_missed, {r('total_cost', 1)} AS total_cost) FROM {score('log')}""",
    "audit_summary": LOG + f""" SELECT analyst, {', '.join(f"{r(f'median({c})', d)} AS {c}_median" for c, d in _medians.items())},
        {r('avg(avg_reported_lift)')} AS avg_reported_lift, {r('avg(avg_true_lift)')} AS avg_true_lift FROM {score('log')} GROUP BY analyst""",
    "ship_rate_by_scenario": LOG + f""" SELECT scenario, count(*) AS experiments, {r('avg(naive_ship::INT)')} AS naive_ship_rate,
        {r('avg(rigorous_ship::INT)')} AS rigorous_ship_rate FROM log GROUP BY scenario""",
    "break_even_cost": LOG + f""", g AS (SELECT avg(false_wins) FILTER (analyst = 'naive') - avg(false_wins) FILTER (analyst = 'rigorous') AS f,
        avg(cost_missed) FILTER (analyst = 'rigorous') - avg(cost_missed) FILTER (analyst = 'naive') AS m FROM {score('log')})
        SELECT {r('f')} AS extra_false_wins, {r('m', 1)} AS extra_missed_cost, {r('CASE WHEN f > 0 THEN m / f END', 1)} AS break_even_cost FROM g""",
    "cost_sensitivity": LOG + f""", c AS (SELECT log.*, false_win_cost FROM log, (SELECT unnest([0e0, 500000e0, 2000000e0, 5000000e0]) AS false_win_cost))
        SELECT false_win_cost, {both('total_cost')} FROM {score('c', 'max(false_win_cost)', extra='false_win_cost, ')} GROUP BY false_win_cost""",
    "worst_case_rerun": LOG + f" SELECT {both('total_cost')} FROM {score('log', delay='12e0')}",
    "share_sensitivity": f"WITH {log_ctes('0.15e0', 'a')}, {log_ctes('0.35e0', 'b')} {_sens('a', '0.15e0')} UNION ALL {_sens('b', '0.35e0')}",
}
