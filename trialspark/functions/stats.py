"""Tail probabilities, quantiles and test formulas as Spark SQL expressions.

Spark has no normal or Student-t functions.  The formulas below are SQL text
over column names: they stay inside code generation, and a formula of a hundred
operators reaches the driver's JVM in one call instead of hundreds.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, algorithm
# 5666, as printed by West 2005), highest power first.
_HART_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_HART_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631


def norm_ppf(p: float) -> float:
    """Normal quantile of a constant; evaluated once on the driver."""
    return NormalDist().inv_cdf(p)


def z_crit(alpha: float = 0.05) -> float:
    """Two-sided critical value."""
    return norm_ppf(1 - alpha / 2)


def num(x: float) -> str:
    """Double literal."""
    return f"{float(x)!r}D"


def div(a: str, b: str) -> str:
    """a / b in double, NULL where b is 0 (ANSI mode would raise)."""
    return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


def ratio(a: Column | str, b: Column | str) -> Column:
    """``div`` for columns."""
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(div(a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def _horner(coefs: tuple[float, ...], x: str) -> str:
    acc = num(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {num(c)})"
    return acc


def p_norm(z: str) -> str:
    """Two-sided normal p value of the column ``z``."""
    a = f"abs({z})"
    gauss = f"exp(-{a} * {a} / 2)"
    frac = f"({a} + 0.65D)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k}D / {frac})"
    return (f"2D * CASE WHEN {a} < {num(_HART_SWITCH)} THEN {gauss} * {_horner(_HART_NUM, a)} / {_horner(_HART_DEN, a)}"
            f" ELSE {gauss} / {frac} / {num(_SQRT_2PI)} END")


def two_sided_p(z: str) -> Column:
    return F.expr(p_norm(z))


def p_chi2(chi2: str) -> str:
    """Upper tail of a chi-square with one degree of freedom."""
    return p_norm(f"sqrt(greatest({chi2}, 0D))")


def student_z(t: str, dof: str) -> str:
    """Normal deviate with the tail of Student's t (Hill 1970, algorithm 395)."""
    a = f"({dof} - 0.5D)"
    b = f"(48D * {a} * {a})"
    y = f"({a} * log1p({t} * {t} / {dof}))"
    poly = f"(((-0.4D * {y} - 3.3D) * {y} - 24D) * {y} - 85.5D)"
    return f"(({poly} / (0.8D * {y} * {y} + 100D + {b}) + {y} + 3D) / {b} + 1D) * sqrt({y})"


def student_ppf(p: float, dof: str) -> str:
    """t quantile as a Cornish-Fisher series in 1/dof (below 1e-5 from dof 10 on)."""
    z = norm_ppf(p)
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    acc = "0D"
    for g in reversed(terms):
        acc = f"({acc} + {num(g)}) * {div('1D', dof)}"
    return f"({num(z)} + {acc})"


def pooled_z(conv_c: str = "conv_c", n_c: str = "n_c", conv_t: str = "conv_t", n_t: str = "n_t",
             floor: float | None = None) -> str:
    """Two-proportion z with the pooled variance.

    Without ``floor`` a zero variance gives z = 0; with it the variance is held
    at ``floor`` (the form used for looks and segments).  NULL if an arm is empty.
    """
    diff = f"({div(conv_t, n_t)} - {div(conv_c, n_c)})"
    pool = div(f"({conv_c} + {conv_t})", f"({n_c} + {n_t})")
    var = f"({pool} * (1D - {pool}) * ({div('1D', n_c)} + {div('1D', n_t)}))"
    if floor is not None:
        return f"{diff} / sqrt(greatest({var}, {num(floor)}))"
    return f"CASE WHEN {var} <= 0 THEN 0D ELSE {div(diff, f'sqrt(greatest({var}, 0D))')} END"


def exprs(**columns: str) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in columns.items()}


def with_normal_inference(df: DataFrame, alpha: float = 0.05, prefix: str = "") -> DataFrame:
    """Add p value, interval, relative lift and the 5% flag from ``effect``,
    ``se``, ``z`` and ``base`` (all with ``prefix``)."""
    p, half = prefix, f"{num(z_crit(alpha))} * {prefix}se"
    return df.withColumns(exprs(**{
        f"{p}p_value": p_norm(f"{p}z"), f"{p}ci_low": f"{p}effect - {half}", f"{p}ci_high": f"{p}effect + {half}",
        f"{p}rel_lift": div(f"{p}effect", f"{p}base")})).withColumn(f"{p}significant", F.expr(f"{p}p_value < 0.05"))


def with_prop_test(df: DataFrame, alpha: float = 0.05, prefix: str = "") -> DataFrame:
    """Two-proportion test on ``conv_c, n_c, conv_t, n_t``: pooled error for the
    p value, unpooled error for ``se`` and the interval."""
    p_c, p_t = div("conv_c", "n_c"), div("conv_t", "n_t")
    var = f"{div(f'{p_c} * (1D - {p_c})', 'n_c')} + {div(f'{p_t} * (1D - {p_t})', 'n_t')}"
    staged = df.withColumns(exprs(**{
        prefix + "base": p_c, prefix + "effect": f"{p_t} - {p_c}",
        prefix + "se": f"sqrt(greatest({var}, 0D))", prefix + "z": pooled_z()}))
    return with_normal_inference(staged, alpha, prefix)


def with_welch(df: DataFrame, metric: str, alpha: float = 0.05, prefix: str = "") -> DataFrame:
    """Welch test from ``{metric}_{n,mean,var}_{c,t}``.  A constant metric or an
    arm with fewer than two values gives NULL, never NaN."""
    m, p = metric, prefix
    usable = f"{m}_n_c > 1 AND {m}_n_t > 1"
    v = {s: f"CASE WHEN {usable} THEN {div(f'{m}_var_{s}', f'{m}_n_{s}')} END" for s in ("c", "t")}
    df = df.withColumns(exprs(**{f"{p}vc": v["c"], f"{p}vt": v["t"], f"{p}effect": f"{m}_mean_t - {m}_mean_c"}))
    parts = [div(f"{p}v{s} * {p}v{s}", f"({m}_n_{s} - 1)") for s in ("c", "t")]
    df = df.withColumns(exprs(**{
        f"{p}se": f"sqrt({p}vc + {p}vt)", f"{p}t": div(f"{p}effect", f"sqrt({p}vc + {p}vt)"),
        f"{p}dof": div(f"({p}vc + {p}vt) * ({p}vc + {p}vt)", f"({parts[0]} + {parts[1]})")}))
    df = df.withColumns(exprs(**{f"{p}z": student_z(f"{p}t", f"{p}dof"),
                                 f"{p}half": f"{student_ppf(1 - alpha / 2, f'{p}dof')} * {p}se"}))
    return df.withColumns(exprs(**{
        f"{p}p_value": p_norm(f"{p}z"), f"{p}ci_low": f"{p}effect - {p}half", f"{p}ci_high": f"{p}effect + {p}half",
        f"{p}rel_lift": div(f"{p}effect", f"{m}_mean_c"),
    })).withColumn(f"{p}significant", F.expr(f"{p}p_value < 0.05")).drop(f"{p}vc", f"{p}vt", f"{p}half", f"{p}z")


def srm_chi2(n_c: str = "n_c", n_t: str = "n_t", share: str | float = 0.5) -> str:
    """Sample-ratio chi-square against an expected treatment share.  With two
    cells both deviations are equal, so it is d^2 / (n e (1 - e))."""
    e = share if isinstance(share, str) else num(share)
    d = f"({n_t} - ({n_c} + {n_t}) * {e})"
    return div(f"{d} * {d}", f"(({n_c} + {n_t}) * {e} * (1D - {e}))")


def srm_p(n_c: str = "n_c", n_t: str = "n_t", share: str | float = 0.5) -> str:
    """Sample-ratio p value."""
    return p_chi2(srm_chi2(n_c, n_t, share))
