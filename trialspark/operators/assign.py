"""Arms, samples, subsets and injected effects: row-level transformations."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark import CONTROL, TREATMENT
from trialspark.functions.draws import salted_bucket, uniform, uniform_sql

# Switches of a scenario and their neutral values.
SCENARIO_DEFAULTS = {
    "lift": 0.0, "novelty_boost": 0.0, "novelty_halflife": 3.0, "srm_drop_rate": 0.0,
    "whale_rate": 0.0, "whale_multiplier": 50.0, "ramp_days": 0, "ramp_treat_share": 0.1,
    "treat_share": 0.5,
}


def label_arms(units: DataFrame, label: str, control: str, treatment: str) -> DataFrame:
    """Keep two labels of a multi-arm column and name them as arms."""
    return units.where(F.col(label).isin(control, treatment)).withColumn(
        "arm", F.when(F.col(label) == control, CONTROL).otherwise(TREATMENT))


def perturb_covariate(units: DataFrame, covariate: str, factor: float, arm: str = TREATMENT) -> DataFrame:
    """Scale a covariate in one arm, to make an imbalance on purpose."""
    return units.withColumn(covariate, F.when(F.col("arm") == arm, F.col(covariate) * factor)
                            .otherwise(F.col(covariate)))


def assign_arms(units: DataFrame, salt: str, share: float = 0.5, key: str = "unit_id",
                ramp_days: int = 0, ramp_share: float = 0.1, day_col: str = "day") -> DataFrame:
    """Salted assignment; the share may be lower during the first days."""
    cut = F.lit(int(round(share * 10000)))
    if ramp_days:
        cut = F.when(F.col(day_col) < ramp_days, int(round(ramp_share * 10000))).otherwise(cut)
    hit = salted_bucket(salt, F.col(key)) % 10000 < cut
    return units.withColumn("arm", F.when(hit, TREATMENT).otherwise(CONTROL))


def subset_units(units: DataFrame, *, converters: bool = False, arm: str | None = None,
                 days: tuple[int, int] | None = None, spend: str = "revenue") -> DataFrame:
    """Converters, one arm, or a half-open day window."""
    if converters:
        units = units.where(F.col(spend) > 0)
    if arm is not None:
        units = units.where(F.col("arm") == arm)
    if days is not None:
        units = units.where((F.col("day") >= days[0]) & (F.col("day") < days[1]))
    return units


def hash_sample(units: DataFrame, rate: float, replay: int = 0) -> DataFrame:
    """Sample units by their code.  Valid on tables sorted by arm, where a prefix
    or block of the file would hold one arm only."""
    return units.where(uniform("sample", replay) < rate)


def _literal(field: str, value) -> str:
    if value is None:
        return f"CAST(NULL AS {'array<double>' if field == 'daily_base' else 'double'})"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(f"{float(v)!r}D" for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return str(int(value)) if field in INTEGER_FIELDS else f"{float(value)!r}D"


INTEGER_FIELDS = ("ramp_days", "experiment_id")


def scenario_rows(scenarios: Sequence[Mapping]) -> str:
    """A literal array of scenario structs for ``inline``: rows are combined with
    scenarios where they are read, without a join."""
    fields = list(dict.fromkeys(k for s in scenarios for k in s))
    structs = ("named_struct(" + ", ".join(f"'{f}', {_literal(f, s.get(f, SCENARIO_DEFAULTS.get(f)))}" for f in fields) + ")"
               for s in scenarios)
    return "array(" + ", ".join(structs) + ")"


def base_rates(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Conversion rate and share of low-engagement units, measured on the table."""
    return units.groupBy(*keys).agg(F.avg("converted").alias("base_rate"),
                                    F.avg(1 - F.col("engaged")).alias("low_share"),
                                    F.count(F.lit(1)).alias("all_units"))


def inject(rows: DataFrame, effects: Collection[str], replay: str = "replay") -> DataFrame:
    """Randomize rows and build the named effects into real outcomes.

    ``rows`` carries ``code``, ``converted``, ``amount``, the scenario columns
    its effects need, and ``base_rate`` / ``low_share``.  Effects:
    ``ramp`` lower treatment share in the first days; ``drop`` low-engagement
    treatment units are lost so that the given share of the arm is missing;
    ``base`` outcomes are flipped to a baseline per day (none, if it is NULL); ``lift`` and
    ``novelty`` turn non-converters of the treatment arm into converters
    (negative lifts undo conversions); ``whale`` multiplies some order values.
    """
    def u(stream: str) -> str:
        return uniform_sql(stream, replay)

    share = "treat_share" if "treat_share" in rows.columns else "0.5D"
    if "ramp" in effects:
        share = f"CASE WHEN day < ramp_days THEN ramp_treat_share ELSE {share} END"
    treated = f"arm = '{TREATMENT}'"
    rows = rows.withColumn("arm", F.expr(f"CASE WHEN {u('arm')} < {share} THEN '{TREATMENT}' ELSE '{CONTROL}' END"))
    if "drop" in effects:
        rows = rows.where(f"NOT ({treated} AND engaged = 0 AND {u('drop')} * low_share < srm_drop_rate)")
    if "base" in effects:
        target = "element_at(daily_base, day + 1)"
        raised = f"converted = 1 OR {u('base')} * (1D - base_rate) < {target} - base_rate"
        lowered = f"converted = 1 AND {u('base')} * base_rate < {target}"
        rows = rows.withColumns({
            "converted": F.expr(f"CASE WHEN {target} IS NULL THEN converted WHEN {target} >= base_rate THEN CAST({raised} AS INT) ELSE CAST({lowered} AS INT) END"),
            "base_rate": F.expr(f"coalesce({target}, base_rate)")})
    if "lift" in effects or "novelty" in effects:
        lift = "lift"
        if "novelty" in effects:
            lift = "(lift + novelty_boost * power(0.5D, day / novelty_halflife))"
        flipped = (f"CASE WHEN NOT {treated} THEN converted"
                   f" WHEN converted = 0 AND {u('lift')} * (1D - base_rate) < {lift} * base_rate THEN 1"
                   f" WHEN converted = 1 AND {u('lift')} < -{lift} THEN 0 ELSE converted END")
        rows = rows.withColumn("converted", F.expr(flipped))
    if "amount" in rows.columns:
        value = "amount"
        if "whale" in effects:
            value = f"CASE WHEN {u('whale')} < whale_rate THEN amount * whale_multiplier ELSE amount END"
        rows = rows.withColumn("revenue", F.expr(f"CASE WHEN converted = 1 THEN {value} ELSE 0D END"))
    return rows
