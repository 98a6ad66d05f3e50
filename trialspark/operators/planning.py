"""Sample size, detectable effect and duration as Spark SQL expressions."""

from __future__ import annotations

from trialspark.functions.stats import div, norm_ppf, num, z_crit


def _quantile_sum(alpha: float, power: float) -> float:
    return z_crit(alpha) + norm_ppf(power)


def size_sql(base: str, mde_rel: str, alpha: float = 0.05, power: float = 0.8) -> str:
    """Users per arm that detect a relative lift of a conversion rate."""
    p2 = f"({base} * (1D + {mde_rel}))"
    spread = f"({base} * (1D - {base}) + {p2} * (1D - {p2}))"
    return f"ceil({div(f'{num(_quantile_sum(alpha, power) ** 2)} * {spread}', f'(({p2} - {base}) * ({p2} - {base}))')})"


def mde_sql(base: str, n_per_arm: str, alpha: float = 0.05, power: float = 0.8) -> str:
    """Smallest relative lift that ``n_per_arm`` users per arm detect."""
    noise = f"sqrt({div(f'2D * {base} * (1D - {base})', n_per_arm)})"
    return div(f"{num(_quantile_sum(alpha, power))} * {noise}", base)


def size_means_sql(sd: str, mde_abs: str, alpha: float = 0.05, power: float = 0.8) -> str:
    """Users per arm that detect an absolute difference of means."""
    k = num(2 * _quantile_sum(alpha, power) ** 2)
    return f"ceil({div(f'{k} * {sd} * {sd}', f'(({mde_abs}) * ({mde_abs}))')})"


def days_sql(n_per_arm: str, users_per_day: str, treat_share: float = 0.5) -> str:
    """Days until the smaller arm has ``n_per_arm`` users."""
    return f"ceil({div(n_per_arm, f'({users_per_day} * {num(min(treat_share, 1 - treat_share))})')})"
