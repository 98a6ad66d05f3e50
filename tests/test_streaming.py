"""The stream of looks against the batch, with several batches, late rows and a restart."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import panels, sequential
from trialspark.reports import monitoring
from trialspark.streaming import looks

SCHEMA = "experiment string, ts timestamp, day int, arm string, converted int"
ORIGIN = 1704067200000
START = datetime(2024, 1, 1)


def rows_of(days, seed=0, n=60):
    rng = np.random.default_rng(seed)
    return [(f"e{int(rng.integers(0, 2))}", START + timedelta(days=int(d), hours=int(rng.integers(0, 24))), int(d), ("control", "treatment", "other")[int(rng.choice(3, p=[0.5, 0.45, 0.05]))],
             None if rng.random() < 0.02 else int(rng.random() < 0.3)) for d in days for _ in range(n)]


def batch_of(spark, rows, tau):
    panel = panels.arm_totals(spark.createDataFrame(rows, SCHEMA), ["experiment", "day"])
    out = sequential.with_msprt(sequential.cumulative_looks(panel, ["experiment"]), tau, ["experiment"])
    return {(r.experiment, r.look): (r.conv_c, r.n_c, r.conv_t, r.n_t, r.msprt_p) for r in out.collect()}


def run(spark, tmp_path, parts, delay, tau=0.05):
    source = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        looks.write_looks(looks.stream_looks(stream, tau, ORIGIN, delay), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return {(r.experiment, r.look): (r.conv_c, r.n_c, r.conv_t, r.n_t, r.msprt_p) for r in looks.current_looks(spark, str(tmp_path / "out")).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4] and got[k][4] == pytest.approx(w[4], abs=1e-12)


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    """Three runs over one checkpoint; a day without rows is a look."""
    parts = [rows_of([0, 1, 2], 1), rows_of([2, 4, 5], 2), rows_of([7, 8, 9], 3)]
    same(run(spark, tmp_path, parts, "1 day"), batch_of(spark, [r for p in parts for r in p], 0.05))


def test_rows_of_closed_days_come_too_late(spark, tmp_path):
    early, later, late = rows_of([0, 1], 4), rows_of([9, 10], 5), rows_of([0], 6)
    open_again = rows_of([10], 7)
    got = run(spark, tmp_path, [early, later, rows_of([11], 8), late + open_again], "1 day")
    same(got, batch_of(spark, [*early, *later, *rows_of([11], 8), *open_again], 0.05))


def test_odd_rows(spark, tmp_path):
    odd = [(None, START, 0, "control", 1), ("e0", None, 0, "control", 1), ("e0", START, None, "control", 1), ("e0", START, 0, None, 1), ("e0", START, 0, "control", None)]
    got = run(spark, tmp_path, [odd], "1 day")
    assert got == {("e0", 1): (0, 0, 0, 0, 1.0)}


def test_spending_boundaries():
    """Published values for five equal looks, and no more than the total error however looks fall."""
    got = sequential.spending_boundaries([0.2, 0.4, 0.6, 0.8, 1.0])
    assert got == pytest.approx([4.8769, 3.3569, 2.6803, 2.2898, 2.0310], abs=2e-3)
    assert sequential.spending_boundaries([1.0]) == pytest.approx([1.959964], abs=1e-4)
    rng = np.random.default_rng(3)
    ramp = np.cumsum([0.02, 0.03, 0.05, 0.1, 0.1, 0.2, 0.25, 0.25])
    bounds = np.array(sequential.spending_boundaries(ramp.tolist()))
    walk = np.cumsum(rng.normal(size=(40_000, 8)) * np.sqrt(np.diff(np.append(0, ramp))), axis=1) / np.sqrt(ramp)
    assert abs((np.abs(walk) > bounds).any(axis=1).mean() - 0.05) < 0.005
    same_look = sequential.spending_boundaries([0.5, 0.5, 1.0])
    assert same_look[0] == same_look[1]


def test_boundaries_on_looks(spark):
    rows = [("a", 1, 0, 100, 0, 0), ("a", 2, 10, 200, 5, 100), ("a", 3, 20, 400, 20, 400), ("b", 1, 1, 10, 1, 10)]
    df = spark.createDataFrame(rows, "g string, look int, conv_c long, n_c long, conv_t long, n_t long")
    got = {(r.g, r.look): r for r in sequential.with_spending_boundary(df, ["g"]).collect()}
    assert got["a", 1].boundary is None and got["a", 2].fraction == pytest.approx(1 / 3) and got["a", 3].fraction == 1.0
    want = sequential.spending_boundaries([round(1 / 3, 9), 1.0])
    assert [got["a", k].boundary for k in (2, 3)] == pytest.approx(want) and got["b", 1].boundary == pytest.approx(1.959964, abs=1e-4)
    planned = sequential.with_spending_boundary(df.withColumn("p", F.lit(400.0)), ["g"], planned="p")
    assert {r.fraction for r in planned.where("g = 'a' AND look = 3").collect()} == {0.5}


def test_constants_are_solved_in_tasks(spark):
    df = spark.createDataFrame([(5, 1), (14, 2), (14, 3), (None, 4)], "n_looks int, i int")
    got = {r.i: r.c_obf for r in sequential.with_obf_constant(df).collect()}
    assert got[4] is None and got[1] == pytest.approx(sequential.obf_constant(5)) and got[2] == got[3] == pytest.approx(sequential.obf_constant(14))


def test_stream_report_equals_the_batch(spark):
    got = {(r.segment, r.look): r.msprt_p for r in monitoring.msprt_stream(spark, "/root/testdata/sf0.001").collect()}
    assert len({s for s, _ in got}) == 5
