"""Nearest neighbours in tiny tables and with varied norms, with production parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import ann

DIR = "/root/testdata/sf0.001"


def vectors(spark) -> np.ndarray:
    return np.array([r.embedding for r in spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()], np.float64)


def recall(x: np.ndarray, k: int = 21) -> tuple[float, int]:
    """Recall of a block's search, and the queries that got fewer than they could."""
    q, k = x[::5], min(k, len(x))
    best = np.sort(q @ x.T, axis=1)[:, -k]
    got = [(i, len(near), score) for i, near, score in ann.search_block(ann.Hashes(x.shape[1] + 1), x, q, k)]
    return sum((s >= best[i] - 1e-9).sum() for i, _, s in got) / (k * len(q)), sum(n < k for _, n, _ in got)


def test_tiny_tables_return_all_candidates(spark):
    x = vectors(spark)[:15]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0).collect()
    assert len(got) == 15 * 14
    for q in range(15):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted((i for i in range(15) if i != q), key=lambda i: (-float(x[i] @ x[q]), i))


@pytest.mark.parametrize("spread", [0.5, 1.5])
def test_recall_with_varied_norms(spark, spread):
    x = vectors(spark)
    share, short = recall(x * np.exp(np.random.default_rng(0).normal(0, spread, (len(x), 1))))
    assert share >= 0.9 and short == 0


def test_recall_beside_one_long_vector(spark):
    x = vectors(spark)
    share, short = recall(np.vstack([x, x[:1] * 10]))
    assert share >= 0.9 and short == 0


def test_blocks_merge_into_one_answer(spark):
    """Many small blocks of vectors and queries give what one block of all vectors gives, ids and ranks included."""
    x = vectors(spark)[:400]
    x[50:90] = x[3]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).checkpoint()
    whole = x @ x.T
    for more in ({"block": 50, "query_block": 7}, {"block": 399, "query_block": 1000}):
        got = ann.nearest(df, F.col("vec_id") % 10 == 0, 20, **more).collect()
        hit = 0
        for q in range(0, 400, 10):
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20 and all(r.vec_id != q for r in mine)
            assert all(abs(r.score - whole[q, r.vec_id]) < 1e-12 for r in mine)
            assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
            best = sorted((i for i in range(400) if i != q), key=lambda i: (-whole[q, i], i))[:20]
            hit += len(set(best) & {r.vec_id for r in mine})
        assert hit >= 0.9 * 40 * 20


def test_probes_follow_the_estimate():
    """A neighbour at the measured distance is found about as often as estimated; a higher target visits more."""
    rng = np.random.default_rng(2)
    h = ann.Hashes(33)
    x = rng.normal(size=(300, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.normal(size=x.shape)
    y = x + 0.6 * step / np.linalg.norm(step, axis=1, keepdims=True)
    for need in (0.3, 0.6):
        hit = told = 0.0
        for t in range(h.tables):
            want, chance = h.probes(x, t, 0.6)
            asked = np.cumsum(chance, axis=1) - chance < need
            hit += ((want == h.keys(y)[:, t][:, None]) & asked).any(axis=1).mean() / h.tables
            told += (chance * asked).sum(axis=1).mean() / h.tables
        assert abs(hit - told) < 0.06 and told >= need
