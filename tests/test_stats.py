"""Tail expressions and closed-form tests against the standard library."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from trialspark.functions import stats
from trialspark.operators import hypothesis, planning


def one(spark, **exprs):
    return spark.range(1).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()]).first()


def t_two_sided(t, dof, panels=20_000):
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    theta = math.atan(abs(t) / math.sqrt(dof))
    h = theta / panels
    s = sum((1 if i in (0, panels) else 4 if i % 2 else 2) * math.cos(h * i) ** (dof - 1) for i in range(panels + 1))
    return 1 - 2 * c * s * h / 3


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.96, 3.5, 6.9, 7.2, 12.0, -2.5])
def test_normal_tail(spark, z):
    got = one(spark, p=stats.p_norm(f"CAST({z} AS DOUBLE)")).p
    want = math.erfc(abs(z) / math.sqrt(2))
    assert got == pytest.approx(want, rel=1e-7, abs=1e-15)


@pytest.mark.parametrize("t,dof,tol", [(2.1, 10, 2e-9), (0.7, 33.5, 1e-10), (3.0, 500, 1e-10), (0.0, 12, 1e-12)])
def test_student_tail(spark, t, dof, tol):
    z = stats.student_z(f"CAST({t} AS DOUBLE)", f"CAST({dof} AS DOUBLE)")
    got = spark.range(1).selectExpr(f"{z} AS z").selectExpr(f"{stats.p_norm('z')} AS p").first().p
    assert got == pytest.approx(t_two_sided(t, dof), abs=tol)


@pytest.mark.parametrize("dof", [10, 30, 400])
def test_student_quantile(spark, dof):
    q = one(spark, q=stats.student_ppf(0.975, f"{dof}D")).q
    assert t_two_sided(q, dof) == pytest.approx(0.05, abs=2e-6)


def counts(spark, *rows):
    return spark.createDataFrame(rows, "conv_c long, n_c long, conv_t long, n_t long")


def test_two_proportion_golden(spark):
    r = stats.with_prop_test(counts(spark, (500, 10000, 560, 10000))).first()
    pool = 1060 / 20000
    z = 0.006 / math.sqrt(pool * (1 - pool) * 2 / 10000)
    se = math.sqrt(0.05 * 0.95 / 1e4 + 0.056 * 0.944 / 1e4)
    assert r.z == pytest.approx(z) and r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert r.se == pytest.approx(se) and r.ci_low == pytest.approx(0.006 - NormalDist().inv_cdf(0.975) * se)
    assert r.rel_lift == pytest.approx(0.12) and r.ci_low < r.effect < r.ci_high


def test_published_z_of_the_largest_table(spark):
    n_c, n_t = 2_096_937, 11_882_655
    conv = (round(0.0019375880152813366 * n_c), round(0.0030894610674129645 * n_t))
    r = stats.with_prop_test(counts(spark, (conv[0], n_c, conv[1], n_t))).first()
    assert r.z == pytest.approx(28.516529408977203, abs=1e-9) and r.significant


def test_degenerate_counts_give_null_or_no_effect(spark):
    rows = stats.with_prop_test(counts(spark, (0, 100, 0, 100), (5, 100, 0, 0), (0, 100, 5, 100))).collect()
    assert rows[0].z == 0 and rows[0].p_value == 1 and rows[0].rel_lift is None
    assert rows[1].effect is None and rows[1].p_value is None
    assert rows[2].rel_lift is None and rows[2].effect == pytest.approx(0.05)


@pytest.mark.parametrize("n_c,n_t,share,low", [(50000, 50000, 0.5, False), (50000, 48500, 0.5, True),
                                               (15000, 85000, 0.85, False), (2_096_937, 11_882_655, 0.85, False)])
def test_sample_ratio(spark, n_c, n_t, share, low):
    p = one(spark, p=stats.srm_p(f"{n_c}L", f"{n_t}L", share)).p
    assert (p < 0.001) is low


def test_sample_ratio_published_chi2(spark):
    got = one(spark, x=stats.srm_chi2("2096937L", "11882655L", 0.85)).x
    assert got == pytest.approx(1.8178e-06, rel=1e-3)


@pytest.mark.parametrize("power,n", [(.1, 1832), (.2, 4977), (.3, 8201), (.5, 15286), (.7, 24559), (.8, 31231), (.9, 41810)])
def test_sample_size(spark, power, n):
    assert one(spark, n=planning.size_sql("0.05D", "0.10D", power=power)).n == n


def test_planning_inverse_and_days(spark):
    r = one(spark, m=planning.mde_sql("0.05D", "31231"), d=planning.days_sql("20000", "4000"),
            s=planning.size_means_sql("1D", "0.05D"))
    assert abs(r.m - 0.10) < 0.005 and r.d == 10 and r.s == math.ceil(2 * (1.959964 + 0.841621) ** 2 / 0.0025)


def test_welch_matches_hand_computation(spark):
    a, b = [1.0, 2.0, 4.0, 7.0, 7.5], [2.0, 5.0, 9.0, 11.0, 12.0, 3.0]
    df = spark.createDataFrame([("control", x) for x in a] + [("treatment", x) for x in b], "arm string, y double")
    r = hypothesis.welch_ttest(df, "y").first()

    def mv(v):
        m = sum(v) / len(v)
        return m, sum((x - m) ** 2 for x in v) / (len(v) - 1) / len(v)
    (ma, va), (mb, vb) = mv(a), mv(b)
    dof = (va + vb) ** 2 / (va**2 / 4 + vb**2 / 5)
    assert r.t == pytest.approx((mb - ma) / math.sqrt(va + vb)) and r.dof == pytest.approx(dof)
    assert r.p_value == pytest.approx(t_two_sided(r.t, dof), abs=1e-6)


def test_welch_degenerate(spark):
    rows = [("one", "control", 1.0), ("one", "treatment", 2.0), ("one", "treatment", 3.0),
            ("flat", "control", 1.0), ("flat", "control", 1.0), ("flat", "treatment", 1.0), ("flat", "treatment", 1.0),
            ("null", "control", None), ("null", "control", 1.0), ("null", "control", 2.0), ("null", "treatment", 1.0),
            ("null", "treatment", 4.0)]
    df = spark.createDataFrame(rows, "k string, arm string, y double")
    got = {r.k: r for r in hypothesis.welch_ttest(df, "y", ["k"]).collect()}
    assert got["one"].p_value is None and got["flat"].p_value is None
    assert got["null"].effect == pytest.approx(1.0) and got["null"].p_value is not None


def test_delta_method_is_welch_when_denominator_is_one(spark):
    df = spark.range(4000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm", "CAST(hash(id) % 1000 AS DOUBLE) AS y", "1D AS one")
    d = hypothesis.delta_method_ratio(df, "y", "one").first()
    w = hypothesis.welch_ttest(df, "y").first()
    assert d.se == pytest.approx(w.se) and d.effect == pytest.approx(w.effect)


def test_ks_distance_of_a_grid(spark):
    p = spark.range(1, 101).select((F.col("id") / 100 - 0.005).alias("p_value"))
    r = hypothesis.ks_uniform(p).first()
    assert r.ks_d == pytest.approx(0.005) and r.ks_p == pytest.approx(1.0)
