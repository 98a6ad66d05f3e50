"""Nearest neighbours, SimHash groups, substring dedup against plain versions, with odd rows."""

import hashlib

import brute
import numpy as np
import pytest

from trialspark.llm import ann, common, simhash, substrings

DIR = "/root/testdata/sf0.001"


def prose(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


def odd_texts() -> list[tuple]:
    base = prose(120, 1)
    words = base.split()
    changed = " ".join([*words[:60], "other", *words[61:]])
    return [
        (1, base), (2, base), (3, changed), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One"), (9, "a b"),
        (None, base), (2, base), (10, prose(40, 2) + " " + " ".join(words[:50])), (11, " ".join(words[70:110])), (12, "é x y é x y " * 40),
        (13, "x " * 100), (14, prose(30_000, 3)), (15, "à " + prose(34, 4)), (16, prose(34, 4) + " "),
    ]


SCHEMA = "doc_id long, text string, kept string, score double, _uid string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", 1.0, "y") for d, t in rows], SCHEMA).repartition(parts, "doc_id").checkpoint()


def key(rows):
    return sorted(rows, key=repr)


def test_simhash_groups_match_all_pairs(spark):
    rows = odd_texts()
    got = simhash.groups(table(spark, rows)).collect()
    assert key((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got) == key(brute.simhash_components(rows))
    kept = [r for r in got if r.keeper]
    assert len(kept) == len({r.component_id for r in got}) and all(r.doc_id == r.component_id for r in kept)


def test_simhash_query_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = simhash.groups(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert key((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got) == key(brute.simhash_components(rows))


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_do_not_depend_on_the_bucket_limit(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    fps = []
    for c in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        fps += [c] + [c ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (12, 2))]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    roots = {r.node: r.root for r in common.components(edges).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(u)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 2]
    want = brute.roots(len(u), near)
    same = {}
    for x, r in zip(fps, want, strict=True):
        same.setdefault(r, set()).add(roots.get(x, x))
    assert all(len(s) == 1 for s in same.values()) and len(set().union(*same.values())) == len(same)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(none).count() == 0
    assert substrings.drop_repeats(none).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), common.F.col("vec_id") >= 0).count() == 0


@pytest.mark.parametrize("length", [3, 6, 35])
def test_substrings_match_all_windows(spark, length):
    rows = odd_texts()
    got = substrings.drop_repeats(table(spark, rows), length).collect()
    assert key((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == key(brute.substring(rows, length))


def test_covers_are_difference_covers():
    for period, cover in substrings.COVERS.items():
        for d in range(period):
            assert any((a - b) % period == d for a in cover for b in cover)


def test_repeats_across_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = odd_texts()
        got = substrings.drop_repeats(table(spark, rows, 4), 35).collect()
        assert key((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == key(brute.substring(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def nearest_rows(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    return ann.nearest(df, common.F.col("vec_id") % 20 == 0, **more).collect()


def test_nearest_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    x = {i: np.array(v, np.float64) for i, v in rows}
    found = {}
    for r in nearest_rows(spark, rows):
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        s = {i: float(v @ x[q]) for i, v in x.items() if i != q}
        best = sorted(s.values(), reverse=True)[:20]
        mine = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits += sum(r.score >= best[-1] - 1e-12 for r in mine)
        total += 20
    assert hits / total >= 0.9


def test_nearest_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [3.0, 0.1]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [1.0]), (None, [1.0, 1.0]), (11, [-1.0, 0.0]), (12, [None, 1.0]), (13, []), (3, [1.0, 0.0])]
    got = nearest_rows(spark, rows, k=3, probes=5000)
    assert [(r.query_id, r.vec_id) for r in sorted(got)] == [(0, 4), (0, 3), (0, 20), (20, 4), (20, 0), (20, 3)]


def test_templates_come_in_the_order_of_expected_cost():
    sets = ann.templates(4, 40)
    assert len({tuple(s) for s in sets.tolist()}) == 40
    assert sets[0].tolist() == [8] * sets.shape[1] and sets[1][0] == 0
    assert all(7 - i not in s for s in sets.tolist() for i in s if i < 8)
