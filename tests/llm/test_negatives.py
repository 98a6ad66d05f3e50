"""Hard negatives against all scores, and the tree's bounds."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import negatives, queries


def plain(rows, anchors, positives=5, k=10):
    """rows: (id, label, whole vector)."""
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        scored = [(-int(np.dot(va, v)), i, lab) for i, lab, v in rows if i != a]
        same = sorted((s, i) for s, i, lab in scored if lab == la)[:positives]
        for ps, p in same:
            near = sorted((s, i) for s, i, lab in scored if lab != la and 30 * -ps <= 100 * -s <= 90 * -ps)[:k]
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def clusters(n, rng, dims=8):
    centre = rng.normal(size=(6, dims))
    v = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.05
    v[n // 2:] *= rng.uniform(0.1, 3, (n - n // 2, 1))
    v[: n // 3] = v[0]  # one vector holds a third of the rows
    return v


@pytest.mark.parametrize(("block", "anchor_block"), [(8192, 512), (37, 5)])
def test_equals_all_scores(spark, block, anchor_block):
    rng = np.random.default_rng(block)
    v = clusters(300, rng)
    labels = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, int(labels[i]), v[i].tolist(), "x", 1) for i in range(300)], "vec_id long, label int, embedding array<double>, v string, b int").repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 7 == 0, block=block, anchor_block=anchor_block).collect()
    rows = [(i, int(labels[i]), np.floor(256 * v[i]).astype(int)) for i in range(300)]
    assert sorted(tuple(r) for r in got) == plain(rows, set(range(0, 300, 7)))


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(1)
    x = np.floor(256 * clusters(2000, rng))
    a = x[::25]
    scored = 0

    def wanted(i, low, high):
        true = x @ a[i]
        assert (low <= true).all() and (true <= high).all()
        return high >= negatives._kth(low, 20)

    for i, ask, score in negatives.walk(a, x, wanted):
        scored += len(ask)
        assert np.array_equal(score, x[ask] @ a[i])
        true = x @ a[i]
        assert set(np.flatnonzero(true >= negatives._kth(true, 20))) <= set(ask.tolist())
    assert scored < 0.8 * len(a) * len(x)
    parent, edge, order = negatives.spanning_tree(a)
    place = {i: n for n, i in enumerate(order)}
    assert sorted(order) == list(range(len(a))) and all(p < 0 or place[p] < place[i] for i, p in enumerate(parent.tolist()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(100, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 1, [0.9, 0.1]), (2, 1, [0.9, 0.1]), (3, 2, [0.5, 0.5]), (4, 2, [0.5, 0.1]), (5, 2, [-1.0, 0.0]), (6, 2, [0.0, 0.0]),
            (None, 2, [0.5, 0.0]), (7, None, [0.5, 0.0]), (8, 2, None), (9, 2, [nan, 0.0]), (10, 2, [0.5, inf]), (11, 2, [0.5, None]), (12, 2, []), (13, 2, [0.5, 0.5, 0.5]),
            (200, 3, [0.3, 0.3]), (300, 1, [-1.0, 0.2])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    rows = [(i, lab, np.floor(256 * np.array(v)).astype(int)) for i, lab, v in dict.fromkeys((i, lab, tuple(v)) for i, lab, v in data[:8] + data[16:])]
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    assert got == plain(rows, {100, 200, 300}) and len(got) > 0
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df.where("vec_id < 100"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.execute(queries.SQL["op11_hard_negatives"]).fetchall()
    got = queries.QUERIES["op11_hard_negatives"](spark, f"/root/testdata/{sf}")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100
