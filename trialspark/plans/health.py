"""Health check of one or many experiments and its verdict.

The rows are read once at (experiment, day) grain; arm totals, covariate
moments and the trend all come from that panel.  Only the winsorized revenue
test goes back to the rows, and only when a revenue column is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialspark import CONTROL, TREATMENT
from trialspark.functions.stats import div, exprs, norm_ppf, srm_p, with_prop_test
from trialspark.operators.adjust import balance_from_smd, with_smd
from trialspark.operators.groupstats import attach
from trialspark.operators.hypothesis import outlier_sensitivity
from trialspark.operators.multiplicity import holm
from trialspark.operators.panels import with_rates
from trialspark.operators.planning import mde_sql
from trialspark.operators.trend import novelty_trend
from trialspark.sources.ingest import materialize

# Check names in report order, statuses, verdicts and icons.
CHECKS = ("Sample ratio", "Peeking", "Power", "Multiple testing", "Novelty", "Outliers", "Balance")
GREEN, YELLOW, RED = "green", "yellow", "red"
DONT_TRUST = "DON'T TRUST - fix and rerun"
INVESTIGATE = "INVESTIGATE before shipping"
SHIP = "SHIP"
NO_WIN = "NO WIN - don't ship"
ICONS = {GREEN: "🟢", YELLOW: "🟡", RED: "🔴"}

NOVELTY_Z = norm_ppf(0.01)
MIN_TREND_DAYS = 7
COUNTS = ("conv_c", "n_c", "conv_t", "n_t")


def day_moments(units: DataFrame, keys: Sequence[str], metrics: Sequence[str] = (), metric: str = "converted",
                day: str | None = "day") -> DataFrame:
    """Arm counts and moments per group and day: the one pass over the rows."""
    by = [*keys, *([day] if day else [])]
    aggs = []
    for s, label in (("c", CONTROL), ("t", TREATMENT)):
        when = f"CASE WHEN arm = '{label}' THEN"
        aggs += [f"CAST(coalesce(sum({when} `{metric}` END), 0) AS BIGINT) AS conv_{s}", f"count({when} `{metric}` END) AS n_{s}"]
        for m in metrics:
            v = f"{when} `{m}` END"
            aggs += [f"count({v}) AS `{m}_n_{s}`", f"avg({v}) AS `{m}_mean_{s}`", f"var_pop({v}) AS `{m}_var_{s}`"]
    return units.groupBy(*by).agg(*[F.expr(a) for a in aggs])


def roll_up(panel: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ()) -> DataFrame:
    """Merge day moments into group moments (sample variances).

    Squares are taken around the mean of the day means, so that a large mean
    does not cancel the variance.
    """
    around = Window.partitionBy(*keys)
    panel = panel.withColumns({f"_{m}_{s}": F.avg(f"`{m}_mean_{s}`").over(around) for m in metrics for s in ("c", "t")})
    aggs, merged = [f"sum({c}) AS {c}" for c in COUNTS], list(COUNTS)
    for m in metrics:
        for s in ("c", "t"):
            n, mean, var = (f"`{m}_{p}_{s}`" for p in ("n", "mean", "var"))
            mid = f"`_{m}_{s}`"
            off = f"({mean} - {mid})"
            aggs += [f"sum({n}) AS {n}", f"sum({n} * {off}) AS {mean}", f"sum({n} * ({var} + {off} * {off})) AS {var}", f"max({mid}) AS {mid}"]
            merged += [n, f"{mid} + {div(mean, n)} AS {mean}",
                       f"greatest({div(f'({var} - {div(f"{mean} * {mean}", n)})', f'({n} - 1)')}, 0D) AS {var}"]
    return panel.groupBy(*keys).agg(*[F.expr(a) for a in aggs]).selectExpr(*[f"`{k}`" for k in keys], *merged)


def multiple_testing_flag(pvalues: DataFrame, keys: Sequence[str], test: str = "test_no") -> DataFrame:
    """Tests looked at, and whether the primary (first) one fails only after Holm."""
    judged = holm(pvalues, keys, large=False)
    primary = F.struct(F.col(test), (F.col("p_value") < 0.05).alias("raw"), F.col("holm_reject").alias("holm"))
    return judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("tests"), F.min(primary).alias("_p")).select(
        *keys, "tests", (F.coalesce(F.col("_p.raw"), F.lit(False)) & ~F.col("_p.holm")).alias("multi_bad"))


def p_text(p: str) -> str:
    return f"CASE WHEN {p} < 0.0001 THEN '<0.0001' ELSE format_string('%.4f', {p}) END"


ABSENT = {"days": "0", "trend_z": "CAST(NULL AS DOUBLE)", "half_gap": "CAST(NULL AS DOUBLE)", "tests": "0",
          "multi_bad": "false", "flips": "false", "raw_p_value": "CAST(NULL AS DOUBLE)",
          "win_p_value": "CAST(NULL AS DOUBLE)", "max_smd": "CAST(NULL AS DOUBLE)", "max_z": "CAST(NULL AS DOUBLE)",
          "critical_z": "CAST(NULL AS DOUBLE)", "imbalanced": "false", "covariates": "0"}

# Condition and detail text of each check, in report order.
RULES = (
    ("srm_p < 0.001", RED,
     "concat(format_string('Treatment got %.1f%% of the units, planned %.0f%%; p ', 100 * treat_share, 100 * expected_treat_share), "
     + p_text("srm_p") + ")"),
    ("stopped_early AND NOT used_sequential", RED,
     "CASE WHEN {bad} THEN 'Ended before the planned look without a sequential rule' ELSE 'Read at the planned look, or by a sequential rule' END"),
    ("mde > planned_mde_rel", YELLOW,
     "concat(format_string('Smallest detectable change %.1f%%', 100 * mde), CASE WHEN {bad} THEN"
     " format_string(\", planned for %.0f%%: a win would be exaggerated\", 100 * planned_mde_rel) ELSE '' END)"),
    ("tests > 1 AND multi_bad", YELLOW,
     "CASE WHEN coalesce(tests, 0) <= 1 THEN 'One metric only' ELSE concat(tests, ' tests; the first one ',"
     " CASE WHEN {bad} THEN 'passes alone but not among all (Holm)' ELSE 'keeps its result among all (Holm)' END) END"),
    (f"days >= {MIN_TREND_DAYS} AND trend_z < {NOVELTY_Z}D AND half_gap > 0", YELLOW,
     f"CASE WHEN days >= {MIN_TREND_DAYS} THEN format_string("
     "'Daily effects: trend z %+.2f, early less late half %+.4f', trend_z, half_gap)"
     " ELSE 'Days too few for a trend' END"),
    ("flips", YELLOW,
     "CASE WHEN raw_p_value IS NULL AND win_p_value IS NULL THEN 'Without revenue' ELSE concat('Revenue: p ', "
     + p_text("raw_p_value") + ", ' as it is, ', " + p_text("win_p_value") + ", ' with the top 1% capped') END"),
    ("imbalanced", RED,
     "CASE WHEN covariates = 0 THEN 'Nothing measured before the start' WHEN max_z IS NULL THEN 'An arm has no covariate values' ELSE concat(format_string("
     "'Largest standardized gap %.4f, z %.1f (limit %.1f)', max_smd, max_z, critical_z),"
     " CASE WHEN {bad} THEN '; the arms were unlike from the start' ELSE '' END) END"),
)


def assemble(totals: DataFrame, keys: Sequence[str], *, trend: DataFrame | None = None,
             multi: DataFrame | None = None, outliers: DataFrame | None = None, balance: DataFrame | None = None,
             settings: DataFrame | None = None, expected_treat_share: float = 0.5,
             planned_mde_rel: float | None = None, stopped_early: bool = False,
             used_sequential: bool = False) -> DataFrame:
    """One row per experiment: the conversion result and its seven checks.

    Every input has one row per experiment.  ``settings`` overrides the scalar
    defaults per experiment; inputs that are absent give a green check.
    """
    keys = list(keys)
    df = totals
    for part in (trend, multi, outliers, balance, settings):
        if part is not None:
            df = (df.join(part, keys, "left") if keys else attach(df, part, ()))
    have = set(df.columns)
    defaults = {"expected_treat_share": f"{float(expected_treat_share)}D",
                "planned_mde_rel": "CAST(NULL AS DOUBLE)" if planned_mde_rel is None else f"{float(planned_mde_rel)}D",
                "stopped_early": str(stopped_early).lower(), "used_sequential": str(used_sequential).lower()}
    filled = {c: f"coalesce({c}, {d})" if c in have else d for c, d in defaults.items()}
    filled |= {c: d for c, d in ABSENT.items() if c not in have}
    df = with_prop_test(df.withColumns(exprs(**filled)))
    df = df.withColumns(exprs(srm_p=srm_p(share="expected_treat_share"), treat_share=div("n_t", "(n_c + n_t)"),
                              mde=mde_sql("base", "least(n_c, n_t)")))
    df = df.withColumns(exprs(**{f"_bad{i}": f"coalesce({cond}, false)" for i, (cond, _, _) in enumerate(RULES, 1)}))
    checks = ", ".join(
        f"named_struct('check_no', {i}, 'check', '{name}', 'status', CASE WHEN _bad{i} THEN '{level}' ELSE '{GREEN}' END,"
        f" 'detail', {detail.replace('{bad}', f'_bad{i}')})"
        for i, (name, (_, level, detail)) in enumerate(zip(CHECKS, RULES), 1))
    some = {lv: " OR ".join(f"_bad{i}" for i, (_, level, _) in enumerate(RULES, 1) if level == lv) for lv in (RED, YELLOW)}
    verdict = (f'CASE WHEN {some[RED]} THEN "{DONT_TRUST}" WHEN {some[YELLOW]} THEN "{INVESTIGATE}"'
               f' WHEN significant AND effect > 0 THEN "{SHIP}" ELSE "{NO_WIN}" END')
    return df.selectExpr(*[f"`{k}`" for k in keys], *COUNTS, "effect", "se", "p_value", "ci_low", "ci_high", "rel_lift", "significant",
                         f"array({checks}) AS checks", f"{verdict} AS verdict").withColumn("ship", F.col("verdict") == SHIP)


def health_report(units: DataFrame, keys: Sequence[str] = (), *, pvalues: DataFrame | None = None,
                  revenue_col: str | None = None, covariates: Sequence[str] = (), day_col: str | None = "day",
                  **options) -> DataFrame:
    """Run all checks on unit rows; ``options`` are those of ``assemble``."""
    keys = list(keys)
    day = day_col if day_col in units.columns else None
    if revenue_col not in units.columns:
        revenue_col = None
    panel = day_moments(units, keys, list(covariates), day=day)
    if day:
        panel = materialize(panel, "health-panel")
    totals = roll_up(panel, keys, list(covariates))
    balance = None
    if covariates:
        parts = ("n_c", "n_t", "mean_c", "mean_t", "var_c", "var_t")
        long = totals.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(c).alias("covariate"), *[F.col(f"`{c}_{p}`").alias(p) for p in parts])
            for c in covariates])))
        balance = balance_from_smd(with_smd(long), len(covariates), keys).withColumn("covariates", F.lit(len(covariates)))
    trend = None
    if day:
        trend = novelty_trend(with_rates(panel), keys, day).select(*keys, "days", "trend_z", "half_gap")
    outliers = None
    if revenue_col:
        outliers = outlier_sensitivity(units, revenue_col, keys).select(
            *keys, "raw_p_value", "win_p_value", "flips")
    multi = multiple_testing_flag(pvalues, keys) if pvalues is not None else None
    return assemble(totals.select(*keys, *COUNTS), keys, trend=trend, multi=multi, outliers=outliers,
                    balance=balance, **options)


def check_rows(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: one row per experiment and check."""
    return report.select(*keys, F.inline_outer("checks"))


def to_markdown(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One markdown document per experiment."""
    icon = f"CASE c.status WHEN '{RED}' THEN '{ICONS[RED]}' WHEN '{YELLOW}' THEN '{ICONS[YELLOW]}' ELSE '{ICONS[GREEN]}' END"
    lines = f"array_join(transform(checks, c -> concat('| ', c.check, ' | ', {icon}, ' | ', c.detail, ' |')), '\\n')"
    head = ("format_string('**Verdict: %s**\\n\\nEffect on conversion: %+.4f (%+.1f%% relative), 95%% CI [%+.4f, %+.4f], "
            "p = %s\\n\\n| Check | Status | Detail |\\n|---|---|---|\\n', verdict, effect, 100 * rel_lift, ci_low, ci_high, "
            + p_text("p_value") + ")")
    return report.selectExpr(*[f"`{k}`" for k in keys], "verdict", f"concat({head}, {lines}) AS markdown")


# The check each broken scenario should fire, and the clean ones.
TARGETS = (("Sample ratio", "sample_ratio", "srm_bug"), ("Novelty", "novelty", "novelty_only"),
           ("Power", "power", "underpowered"), ("Outliers", "outliers", "whale_revenue"),
           ("Balance", "balance", "imbalanced_arms"))
CLEAN = ("clean_null", "clean_win")


def detection_rates(card: DataFrame) -> DataFrame:
    """Detection on the scenario a check is meant for, and false alarms on clean
    ones, from a report card (one row per scenario)."""
    clean = ", ".join(f"'{c}'" for c in CLEAN)
    aggs = [F.expr(f"max(fires_{c}) FILTER (WHERE scenario = '{s}') AS d_{c}") for _, c, s in TARGETS]
    aggs += [F.expr(f"avg(fires_{c}) FILTER (WHERE scenario IN ({clean})) AS a_{c}") for _, c, _ in TARGETS]
    cells = ", ".join(f"named_struct('check', '{n}', 'detection_rate', d_{c}, 'false_alarm_rate', a_{c})" for n, c, _ in TARGETS)
    return card.agg(*aggs).selectExpr(f"inline(array({cells}))")


def clean_ship_rates(card: DataFrame) -> DataFrame:
    """How often clean wins and clean nulls are shipped, from a report card."""
    return card.where(F.col("scenario").isin(*CLEAN)).select("scenario", F.col("verdict_ship").alias("ship_rate"))


def report_card(report: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Firing rate per check and share of verdicts per scenario."""
    fires = {1: "sample_ratio", 5: "novelty", 3: "power", 6: "outliers", 7: "balance"}
    share = lambda c: F.avg(c.cast("int"))
    aggs = [share(F.col("checks")[i - 1]["status"] != GREEN).alias(f"fires_{n}") for i, n in fires.items()]
    aggs += [share(F.col("verdict") == v).alias(f"verdict_{n}") for v, n in
             ((SHIP, "ship"), (NO_WIN, "no_win"), (INVESTIGATE, "investigate"), (DONT_TRUST, "dont_trust"))]
    return report.groupBy(scenario).agg(F.count(F.lit(1)).alias("runs"), *aggs)
