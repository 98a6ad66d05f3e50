"""Reference SQL of the input, output, assignment and panel reports."""

from oracles.parts import (EVENT_USERS, EVENTS, LINES, THREE, coded, draw, md5_bucket, orders, r, salt, u)

O = orders()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
CODED = coded(O, "unit_id")

CATALOG = """(SELECT * FROM (VALUES
  (0, 'true_win', 0.25e0, 0.08e0, 0.16e0, 1e0, 0e0, 3e0, 0e0, 0e0, 50e0),
  (1, 'true_null', 0.40e0, 0e0, 0e0, 1e0, 0e0, 3e0, 0e0, 0e0, 50e0),
  (2, 'small_win_underpowered', 0.10e0, 0.04e0, 0.04e0, 0.25e0, 0e0, 3e0, 0e0, 0e0, 50e0),
  (3, 'novelty_only', 0.10e0, 0e0, 0e0, 1e0, 0.30e0, 3e0, 0e0, 0e0, 50e0),
  (4, 'srm_bug', 0.10e0, 0e0, 0e0, 1e0, 0e0, 3e0, 0.04e0, 0e0, 50e0),
  (5, 'noisy_revenue', 0.05e0, 0e0, 0e0, 1e0, 0e0, 3e0, 0e0, 0.005e0, 50e0))
  c(scenario_no, scenario, share, lift_lo, lift_hi, traffic_share, novelty_boost, novelty_halflife, srm_drop_rate,
    whale_rate, whale_multiplier))"""

RAMP = f"""(SELECT * REPLACE (CASE WHEN {md5_bucket("'ramp:' || unit_id")} % 10000 < (CASE WHEN day < 3 THEN 1000 ELSE 5000 END)
  THEN 'treatment' ELSE 'control' END AS arm) FROM {O})"""

_metrics = f"""SELECT arm, count(*) AS users, {r('avg(converted)', 8)} AS converted_mean,
  {r('var_samp(converted)', 8)} AS converted_var FROM {O} GROUP BY arm"""


def _moment_rows() -> str:
    parts = []
    for c in ("quantity", "discount", "tax"):
        cells = ", ".join(
            f"count({c}) FILTER (arm = '{n}') AS n_{s}, {r(f'avg({c}) FILTER (arm = {chr(39)}{n}{chr(39)})')} AS mean_{s}, "
            f"{r(f'var_samp({c}) FILTER (arm = {chr(39)}{n}{chr(39)})')} AS var_{s}"
            for s, n in (("c", "control"), ("t", "treatment")))
        parts.append(f"SELECT '{c}' AS covariate, {cells} FROM {LINES}")
    return " UNION ALL ".join(parts)


def _totals(source: str, by: str) -> str:
    head = f"{by}, " if by else ""
    return f"""SELECT {head}sum(CASE WHEN arm = 'control' THEN converted ELSE 0 END)::BIGINT AS conv_c,
      count(*) FILTER (arm = 'control') AS n_c,
      sum(CASE WHEN arm = 'treatment' THEN converted ELSE 0 END)::BIGINT AS conv_t,
      count(*) FILTER (arm = 'treatment') AS n_t FROM {source} {'GROUP BY ' + by if by else ''}"""


SQL = {
    "read_units_csv": f"""SELECT arm, day::BIGINT AS day, count(*) AS users, sum(converted)::BIGINT AS conversions,
        {r('sum(amount)', 2)} AS amount FROM {O} GROUP BY arm, day""",
    "quarantine_units_csv": f"""WITH s AS (SELECT *, CASE WHEN unit_id % 50 IN (7, 9) THEN 'does not parse' WHEN unit_id % 50 = 8 THEN 'day does not fit 8 bits' END AS reason FROM {O})
        SELECT p.*, a.* FROM (SELECT arm AS part, count(*) AS n, sum(converted)::BIGINT AS conversions, max(day) AS last_day FROM s WHERE reason IS NULL GROUP BY arm
          UNION ALL SELECT reason, count(*), NULL, NULL FROM s WHERE reason IS NOT NULL GROUP BY reason) p, (SELECT count(*) AS lines, count(reason) AS bad_lines FROM s) a""",
    "validate_on_write": f"""SELECT 'orders' AS source, count(*) AS n_rows, '' AS missing, 0::BIGINT AS bad_arm, 0::BIGINT AS bad_converted, count(*) AS rows_read FROM {O}
        UNION ALL SELECT 'three_arms', count(*), '', count(*) FILTER (label NOT IN ('control', 'treatment')), 0, count(*) FROM {THREE}
        UNION ALL SELECT 'raw_orders', count(*), 'arm,converted', NULL, NULL, count(*) FROM orders""",
    "read_units_csv_inferred": f"""SELECT arm, count(*) AS users, sum(converted)::BIGINT AS conversions,
        max(day)::BIGINT AS last_day, {r('avg(amount)', 4)} AS avg_amount FROM {O} GROUP BY arm""",
    "add_unit_id": f"""SELECT o_orderkey, row_number() OVER (ORDER BY {draw(salt('order'))} % 4096, o_orderkey) AS row_id
        FROM {coded('orders', 'o_orderkey')}""",
    "table_row_counts": " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES]
        + ["SELECT 'not_loaded', CAST(NULL AS BIGINT)"]),
    "write_read_roundtrip": f"SELECT m.*, f.format FROM ({_metrics}) m, (VALUES ('parquet'), ('csv'), ('json')) f(format)",
    "validate_units": f"""
        SELECT count(*) AS n_rows, '' AS missing, 'pre_x' AS covariates,
          count(*) FILTER (arm NOT IN ('control', 'treatment')) AS bad_arm,
          count(*) FILTER (converted NOT IN (0, 1)) AS bad_converted, 'orders' AS source FROM {O}
        UNION ALL SELECT count(*), '', '', count(*) FILTER (label NOT IN ('control', 'treatment')),
          count(*) FILTER (converted NOT IN (0, 1)), 'three_arms' FROM {THREE}
        UNION ALL SELECT count(*), 'arm,converted', '', NULL, NULL, 'raw_orders' FROM orders""",
    "scenario_catalog": f"""SELECT c.* EXCLUDE (scenario_no), {r('b.p')} AS base_rate, {r('b.low')} AS low_share,
          b.n AS all_units, {r('lift_hi * p / (1 - p)')} AS flip_probability
        FROM {CATALOG} c, (SELECT avg(converted) AS p, avg(1 - engaged) AS low, count(*) AS n FROM {O}) b""",
    "label_arms": f"""SELECT unit_id, label, CASE label WHEN 'none' THEN 'control' ELSE 'treatment' END AS arm
        FROM {THREE} WHERE label IN ('none', 'variant_a')""",
    "conditional_arm_sums": _totals(O, "segment"),
    "perturb_covariate": f"""SELECT unit_id, arm, {r("CASE WHEN arm = 'treatment' THEN pre_x * 1.08e0 ELSE pre_x END", 4)} AS pre_x FROM {O}""",
    "assign_arms": f"""SELECT unit_id, CASE WHEN {md5_bucket("'assign:' || unit_id")} % 10000 < 5000 THEN 'treatment'
        ELSE 'control' END AS arm FROM {O}""",
    "assign_arms_ramp": f"SELECT day::BIGINT AS day, arm, count(*) AS users FROM {RAMP} GROUP BY day, arm",
    "subset_units": f"""SELECT unit_id, day::BIGINT AS day, {r('revenue', 2)} AS revenue FROM {O}
        WHERE revenue > 0 AND arm = 'control' AND day BETWEEN 0 AND 6""",
    "hash_sample": f"""WITH c AS (SELECT * FROM {CODED})
        SELECT count(*) AS users, {r("avg(CASE WHEN arm = 'treatment' THEN 1 ELSE 0 END)")} AS treat_share, 'full' AS sample FROM c
        UNION ALL SELECT count(*), {r("avg(CASE WHEN arm = 'treatment' THEN 1 ELSE 0 END)")}, 'hash_20pct' FROM c
        WHERE {u(salt('sample'))} < 0.2e0""",
    "metrics_by_arm": f"""SELECT arm, count(*) AS users, {r('avg(visit)', 8)} AS visit_mean, {r('var_samp(visit)', 8)} AS visit_var,
        {r('avg(converted)', 8)} AS converted_mean, {r('var_samp(converted)', 8)} AS converted_var,
        {r('avg(revenue)', 3)} AS revenue_mean, {r('var_samp(revenue)', -2)} AS revenue_var FROM {O} GROUP BY arm ORDER BY arm""",
    "arm_totals": _totals(EVENTS, ""),
    "daily_arm_panel": f"""SELECT day::BIGINT AS day, conv_c, n_c, conv_t, n_t, {r('conv_c::DOUBLE / nullif(n_c, 0)', 8)} AS p_c,
        {r('conv_t::DOUBLE / nullif(n_t, 0)', 8)} AS p_t FROM ({_totals(O, 'day')})""",
    "segment_panel": f"SELECT * REPLACE (nation::BIGINT AS nation) FROM ({_totals(O, 'nation')})",
    "covariate_moments": _moment_rows(),
    "metric_covariate_corr": f"""SELECT segment, count(*) AS users, {r('covar_samp(amount, x_strong)', -3)} AS covariance,
        {r('corr(amount, x_strong)')} AS correlation FROM {O} GROUP BY segment""",
    "lognormal_calibration": f"""SELECT {r("avg(converted) FILTER (arm = 'control')")} AS control_conversion,
        {r("avg(visit) FILTER (arm = 'control')")} AS control_visit, {r('avg(ln(revenue)) FILTER (revenue > 0)')} AS log_mu,
        {r('stddev_samp(ln(nullif(revenue, 0)))')} AS log_sigma FROM {O}""",
    "ratio_rollup": f"SELECT arm, unit_id, sessions, clicks FROM {EVENT_USERS}",
    "value_counts": f"SELECT label, count(*) AS users FROM {THREE} GROUP BY label",
}
