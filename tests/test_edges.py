"""Rows that clean tables do not hold: missing p values, flat or far-off covariates, non-finite values, days without rows."""

import math
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trialspark.operators import multiplicity, sequential
from trialspark.operators.groupstats import exact_quantile
from trialspark.operators.hypothesis import winsorize_pooled
from trialspark.plans import health
from trialspark.reports import decisions
from trialspark.sources import ingest

INF, NAN = float("inf"), float("nan")


def rejected(spark, fn, ps, **options):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "f int, i int, p_value double")
    return [r.out for r in fn(df, ["f"], name="out", **options).orderBy("i").collect()]


@pytest.mark.parametrize("missing", [None, NAN])
def test_missing_p_values_count_nowhere(spark, missing):
    assert rejected(spark, multiplicity.holm, [0.001, missing, 0.03, 0.9]) == [True, False, False, False]
    assert rejected(spark, multiplicity.holm, [0.02, missing, 0.03]) == [True, False, True]
    assert rejected(spark, multiplicity.benjamini_hochberg, [0.001, missing, 0.03, 0.9]) == [True, False, True, False]
    assert rejected(spark, multiplicity.benjamini_hochberg, [missing, 0.03, 0.9]) == [False, False, False]
    assert rejected(spark, multiplicity.benjamini_hochberg, [missing, missing]) == [False, False]


def test_best_segment_and_bonferroni_without_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -3.5), ("c", 3.5), ("d", None)], "segment string, z double")
    assert [r.segment for r in multiplicity.best_segment(df).collect()] == ["b"]
    got = {r.segment: (r.n_segments, r.bonferroni) for r in multiplicity.bonferroni_segments(df).collect()}
    assert got["b"] == (4, True) and got["a"] == (4, False)


@pytest.mark.parametrize("values", [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, NAN], [INF, 1, 2, 3], [-INF, -1, 2, 3, INF], [NAN, NAN, 1], [INF, INF, INF], [1e308, -1e308, 0, 5e-324]])
@pytest.mark.parametrize("q", [0.0, 0.5, 1.0])
def test_quantile_of_odd_values(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "y double")
    got = exact_quantile(df, "y", q).first()[0]
    ordered = sorted((float(v) for v in values), key=lambda v: (math.isnan(v), v))
    at = (len(ordered) - 1) * q
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    want = low if low == high or (math.isnan(low) and math.isnan(high)) else low + (high - low) * (at - math.floor(at))
    assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want, rel=1e-12, abs=0)


def test_quantile_by_key_with_one_hot_value(spark):
    rows = spark.range(6000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 10 < 8, 1.0).otherwise(F.col("id").cast("double")).alias("y"))
    want = {r.k: r.q for r in rows.groupBy("k").agg(F.percentile("y", F.lit(0.95)).alias("q")).collect()}
    assert {r.k: r.q for r in exact_quantile(rows, "y", 0.95, ["k"], name="q").collect()} == pytest.approx(want)
    assert winsorize_pooled(rows, "y", 0.95, ["k"]).count() == 6000


def units(spark, covariate):
    rows = spark.range(8000).select(
        F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("arm"), ((F.col("id") / 2).cast("long") % 10).cast("int").alias("day"),
        (F.col("id") % 7 == 0).cast("int").alias("converted"), F.expr(covariate).cast("double").alias("x"))
    return rows


@pytest.mark.parametrize(("covariate", "status"), [
    ("id % 2", "red"), ("5", "green"), ("1.7e12 + 200 * (id % 2) + 200 * sin(id)", "red"), ("1.7e12 + 200 * sin(id)", "green"), ("NULL", "green")])
def test_balance_of_flat_and_far_off_covariates(spark, covariate, status):
    check = health.health_report(units(spark, covariate), covariates=["x"]).first().checks[6]
    assert check.status == status and "Nothing measured" not in check.detail


def test_merged_variances_equal_direct_ones(spark):
    df = units(spark, "1.7e12 + 100 * sin(id) + day")
    got = health.roll_up(health.day_moments(df, [], ["x"]), [], ["x"]).first()
    want = df.groupBy("arm").agg(F.var_samp("x").alias("v"), F.avg("x").alias("m"), F.count("x").alias("n")).collect()
    for r in want:
        s = r.arm[0]
        assert (got[f"x_n_{s}"], got[f"x_var_{s}"]) == (r.n, pytest.approx(r.v, rel=1e-3)) and got[f"x_mean_{s}"] == pytest.approx(r.m)


def test_a_day_without_rows_is_a_look(spark):
    panel = spark.createDataFrame([("e", d, 30, 100, 90, 100) for d in range(14) if d not in (4, 5, 13)], "e string, day int, conv_c long, n_c long, conv_t long, n_t long")
    looks = sequential.look_zscores(sequential.cumulative_looks(panel, ["e"], start=0, n_looks=14))
    rows = looks.orderBy("look").collect()
    assert [(r.look, r.day) for r in rows] == [(d + 1, d) for d in range(14)] and rows[5].n_c == rows[3].n_c == 400 and rows[13].n_c == 1100
    assert sequential.stopping_rules(looks, ["e"], 14, sequential.obf_constant(14), 0.005).first().fixed_horizon == 14


def test_boundary_constants():
    assert sequential.obf_constant(1) == pytest.approx(1.959964, abs=1e-6)
    assert sequential.obf_constant(5) == pytest.approx(2.040, abs=1e-3)  # published table
    assert sequential.obf_constant(5) < sequential.obf_constant(14) < sequential.obf_constant(30)


def test_bad_csv_rows_end_the_scan(spark, tmp_path):
    (tmp_path / "u.csv").write_text("arm,converted\ncontrol,1\ntreatment,zz\n")
    df = ingest.read_units_csv(spark, str(tmp_path / "u.csv"), ingest.T.StructType.fromDDL("arm string, converted int"))
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        df.collect()


def test_scratch_tables_can_be_removed(spark):
    decisions.health_verdict(spark, "/root/testdata/sf0.001").collect()
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    assert ingest.discard_scratch(spark) > 0 and ingest.discard_scratch(spark) == 0
    left = [p.name for p in Path(root.removeprefix("file:")).glob("*-*") if re.match(r"(units|groups|health-panel)-[0-9a-f]{32}$", p.name)]
    assert left == []


def test_create_or_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 3):
        ingest.create_or_replace_table(spark.range(n).toDF("id"), path)
        assert ingest.table_row_counts(spark, {"t": path}).first().row_count == n
