"""Ranks of large families and moment histograms against plain versions."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import hypothesis, momenthist, multiplicity
from trialspark.operators.ranks import rank_bounds


def holm_plain(p, alpha):
    known = sorted(x for x in p if x is not None and not math.isnan(x))
    m, limit = len(known), None
    for i, x in enumerate(known):
        if x > alpha / (m - i):
            limit = x
            break
    return [x is not None and not math.isnan(x) and (limit is None or x < limit) for x in p]


def bh_plain(p, alpha):
    known = sorted(x for x in p if x is not None and not math.isnan(x))
    m = len(known)
    limit = max((x for i, x in enumerate(known, 1) if x <= alpha * i / m), default=-1.0)
    return [x is not None and not math.isnan(x) and x <= limit for x in p]


def families(seed):
    rng = np.random.default_rng(seed)
    return {
        "uniform": rng.uniform(size=400).tolist(),
        "ties": rng.choice([0.0, 1e-300, 0.0004, 0.01, 0.2, 1.0], 300).tolist(),
        "missing": [None, float("nan"), *(rng.uniform(size=50) ** 6).tolist(), None],
        "none": [None, float("nan")],
        None: [0.001, 0.9, 0.001],
    }


@pytest.mark.parametrize("large", [True, False])
def test_decisions_equal_plain_ones(spark, large):
    fam = families(1)
    rows = [(k, i, x) for k, v in fam.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "`order` string, i int, p double").repartition(4)
    for fn, plain, alpha in ((multiplicity.holm, holm_plain, 0.2), (multiplicity.benjamini_hochberg, bh_plain, 0.3)):
        out = fn(df, ["order"], "p", alpha, "hit", large=large)
        assert out.columns == ["order", "i", "p", "hit"]
        got = {(r["order"], r.i): r.hit for r in out.collect()}
        assert got == {(k, i): h for k, v in fam.items() for i, h in enumerate(plain(v, alpha))}


def test_one_family_without_keys(spark):
    p = [x for v in families(2).values() for x in v]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double").repartition(4)
    assert [r.h for r in multiplicity.holm(df, (), "p", 0.2, "h").orderBy("i").collect()] == holm_plain(p, 0.2)
    assert [r.h for r in multiplicity.benjamini_hochberg(df, (), "p", 0.2, "h").orderBy("i").collect()] == bh_plain(p, 0.2)
    assert multiplicity.holm(df.limit(0), (), "p").count() == 0
    none = df.where("p IS NULL")
    assert not any(r.h for r in multiplicity.holm(none, (), "p", 0.2, "h").collect())


def test_large_family_and_its_plan(spark):
    n = 300_000
    df = spark.range(n).select(F.expr("(id * 7919 % 300007 + 0.5D) / 300007").alias("p_value"))
    r = hypothesis.ks_uniform(df).first()
    x = np.sort((np.arange(n) * 7919 % 300007 + 0.5) / 300007)
    i = np.arange(1, n + 1)
    assert r.tests == n and abs(r.ks_d - np.maximum(i / n - x, x - (i - 1) / n).max()) < 1e-12
    judged = multiplicity.benjamini_hochberg(df, ())
    assert "SinglePartition" not in judged._jdf.queryExecution().executedPlan().toString()
    bounds = rank_bounds(df, "p_value")
    assert bounds.agg(F.max(F.col("_before") + F.col("_n"))).first()[0] == n
    assert "SinglePartition" not in bounds._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["order"]])
def test_capped_moments_equal_plain_ones(spark, keys):
    rng = np.random.default_rng(3)
    n = 2000
    y = np.where(rng.random(n) < 0.3, 0.0, rng.lognormal(3, 2, n)) - 5 * (rng.random(n) < 0.1)
    y[rng.integers(0, n, 300)] = 77.0  # ties
    rows = [(None if i % 97 == 0 else float(y[i]), "control" if a < 0.5 else "treatment" if a < 0.95 else "other", "ab"[i % 2]) for i, a in enumerate(rng.random(n))]
    df = spark.createDataFrame(rows, "`select` double, arm string, `order` string").repartition(5)
    got = {tuple(r[k] for k in keys): r for r in momenthist.capped_moments(df, "select", 0.95, keys).collect()}
    for key, r in got.items():
        own = [(v, a) for v, a, o in rows if v is not None and (not keys or o == key[0])]
        cap = float(np.quantile([v for v, _ in own], 0.95))
        assert math.isclose(r.cap, cap, rel_tol=1e-12)
        for s, arm in momenthist.ARMS:
            for name, f in (("raw", lambda v: v), ("win", lambda v: min(v, cap))):  # noqa: B023
                x = [f(v) for v, a in own if a == arm]
                assert r[f"{name}_n_{s}"] == len(x)
                assert math.isclose(r[f"{name}_mean_{s}"], statistics.fmean(x), rel_tol=1e-9)
                assert math.isclose(r[f"{name}_var_{s}"], statistics.variance(x), rel_tol=1e-9)
    assert len(got) == (2 if keys else 1)


def test_capped_moments_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "control", "a"), (1.0, "control", "b"), (1.0, "treatment", "c"), (1e9 + 1, "control", "d"), (1e9 + 2, "control", "d")], "y double, arm string, k string")
    got = {r.k: r for r in momenthist.capped_moments(df, "y", 0.99, ["k"]).collect()}
    assert set(got) == {"b", "c", "d"} and got["b"].raw_var_c is None and got["b"].win_n_t == 0
    assert math.isclose(got["d"].raw_var_c, 0.5) and got["d"].cap <= 1e9 + 2
    assert momenthist.capped_moments(df.limit(0), "y", 0.99, ["k"]).count() == 0
    assert hypothesis.outlier_sensitivity(df, "y").count() == 1


def test_outlier_test_reads_rows_twice(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr(
        "o_totalprice AS y", "IF(o_orderkey % 2 = 0, 'control', 'treatment') AS arm")
    reads = []
    make = momenthist._bucketed
    momenthist._bucketed = lambda *a: reads.append(1) or make(*a)
    try:
        hypothesis.outlier_sensitivity(df, "y").collect()
    finally:
        momenthist._bucketed = make
    assert len(reads) == 2
