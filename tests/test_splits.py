"""Splits counted from bits against the same bits spelled out, and draws of random 64-bit ids."""

import numpy as np
from pyspark.sql import functions as F

from trialspark.functions.draws import STREAM_STEP, STREAMS, draw, unit_code
from trialspark.operators import replay, splits


def units_of(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(a), None if b == 0 else int(b), str(k)) for i, a, b, k in zip(
        rng.integers(-2**63, 2**63, n), rng.integers(0, 2, n), rng.integers(0, 5, n), rng.integers(0, 3, n))]
    return spark.createDataFrame(rows, "unit_id long, converted int, clicks int, `order` string").withColumn("code", unit_code(F.col("unit_id"))).repartition(5)


def test_counts_equal_spelled_out_bits(spark):
    units = units_of(spark)
    got = {(r["order"], r.replay, r.metric): (r.n_c, r.n_t, r.conv_c, r.conv_t) for r in splits.split_totals(units, 100, ["converted", "clicks"], ["order"]).collect()}
    words = units.select("order", "converted", "clicks", *[F.expr(f"xxhash64(code, {STREAMS['split'] * STREAM_STEP + w})").alias(f"w{w}") for w in (0, 1)]).collect()
    want = {}
    for key in "012":
        own = [r for r in words if r["order"] == key]
        for g in range(100):
            arm = [(r[f"w{g // 64}"] >> (g % 64)) & 1 for r in own]
            for m in ("converted", "clicks"):
                y = [r[m] or 0 for r in own]
                t = sum(v for v, a in zip(y, arm) if a)
                want[key, g + 1, m] = (len(own) - sum(arm), sum(arm), sum(y) - t, t)
    assert got == want


def test_lanes_hold_large_counters(spark):
    """One unit whose metric fills most of a lane: the other lane stays right."""
    units = spark.createDataFrame([(1, 2**31 - 1)], "unit_id long, y long").withColumn("code", unit_code(F.col("unit_id")))
    h = units.selectExpr(f"xxhash64(code, {STREAMS['split'] * STREAM_STEP})").first()[0]
    got = {r.replay: (r.n_t, r.conv_t) for r in splits.split_totals(units, 64, ["y"]).collect()}
    assert got == {g + 1: ((h >> g) & 1, ((h >> g) & 1) * (2**31 - 1)) for g in range(64)}


def test_metrics_without_any_success_and_empty_tables(spark):
    units = units_of(spark, 200).withColumn("never", F.lit(0))
    rows = splits.split_totals(units, 3, ["never"]).collect()
    assert len(rows) == 3 and all((r.conv_c, r.conv_t) == (0, 0) and r.n_c + r.n_t == 200 for r in rows)
    assert splits.split_totals(units.limit(0), 3, ["never"]).count() == 0


def test_replays_reject_at_the_nominal_rate(spark):
    units = units_of(spark, 20_000, 3)
    r = replay.aa_replay(units, 640, ["converted"]).first()
    assert r.runs == 640 and 0.025 < r.false_positive_rate < 0.075


def test_random_ids_do_not_share_draws(spark):
    """With 32-bit codes, 200,000 units share about five of them; states of 64 bits share none."""
    ids = spark.range(200_000).select(F.xxhash64("id", F.lit(5)).alias("unit_id")).withColumn("code", unit_code(F.col("unit_id")))
    assert ids.select("code").distinct().count() == 200_000
    two = ids.select(draw("arm", 1).alias("a"), draw("lift", 1).alias("b"))
    assert two.distinct().count() == 200_000
    r = two.agg(F.avg("a"), F.corr("a", "b"), F.min("a"), F.max("a")).first()
    assert abs(r[0] / 2**32 - 0.5) < 0.003 and abs(r[1]) < 0.01 and 0 <= r[2] < 2**17 and 2**32 - 2**17 < r[3] < 2**32
