"""Near copies by shingle similarity against all pairs."""

import brute
import corpus_pipeline
import numpy as np
import pytest

from trialspark.llm import simhash


def prose(n: int, rng) -> list[str]:
    return [f"w{x}" for x in rng.integers(0, 3000, n)]


def shingles(text: str | None, k: int = 5) -> set:
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a: set, b: set) -> bool:
    return len(a & b) >= 0.8 * len(a | b)


def edited_copies() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        base = prose(int(rng.integers(60, 400)), rng)
        rows.append((10 * i, " ".join(base)))
        for j, share in enumerate((0.01, 0.02, 0.03, 0.05), 1):
            w = list(base)
            for p in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
                w[p] = f"new{rng.integers(10**6)}"
            rows.append((10 * i + j, " ".join(w)))
    return rows


def all_pairs(rows: list[tuple]) -> tuple[list[tuple], dict]:
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    root, low = brute.roots(len(rows), near), {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return near, {(d, low.get(r)) for (d, _), r in zip(rows, root, strict=True)}


def test_edited_copies_are_found(spark):
    rows = edited_copies()
    near, _ = all_pairs(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()).collect()}
    assert len(near) > 80 and sum(got[rows[i][0]] == got[rows[j][0]] for i, j in near) >= 0.97 * len(near)
    sets = {d: shingles(t) for d, t in rows}
    for d, c in got.items():  # every member has a link inside its component
        assert d == c or any(similar(sets[d], sets[e]) for e in sets if e != d and got[e] == c)


def test_stage_removes_edited_copies_and_keeps_repetitive_texts(spark):
    rng = np.random.default_rng(1)
    base = prose(200, rng)
    edited = [*base[:99], "other", *base[100:]]
    chant = ["la"] * 300
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join([*chant, *prose(40, rng)])), (4, " ".join([*chant, *prose(40, rng)])),
            (5, "One two"), (6, "one TWO"), (7, "one three"), (8, None), (9, " "), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4, 5, 7, 8]


@pytest.mark.parametrize("bucket", [4, 32])
def test_crowds_of_near_copies_are_one_group(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "CROWD", bucket)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = np.random.default_rng(3)
        base = prose(300, rng)
        rows = [(i, " ".join([*base[: i % 300], f"x{i}", *base[i % 300 + 1:]])) for i in range(250)] + [(1000 + i, " ".join(prose(80, rng))) for i in range(50)]
        got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").checkpoint()).collect()}
        assert {got[i] for i in range(250)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_table_matches_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, want = all_pairs([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()} == want
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_copies_in_a_crowd_with_common_boilerplate_are_found(spark):
    """6,000 texts share two thirds of their shingles; 200 of them have a near copy."""
    rng = np.random.default_rng(7)
    common = prose(160, rng)
    rows, near = [], []
    for i in range(6000):
        w = [*common, *(f"u{i}x{j}" for j in range(38))]
        rows.append((i, " ".join(w)))
        if i % 30 == 0:
            w[165 + i % 25] = "edited"
            w[50] = f"also{i}"
            rows.append((10_000 + i, " ".join(w)))
            near.append((i, 10_000 + i))
    sets = {d: shingles(t) for d, t in rows}
    assert 0.6 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.7 and all(similar(sets[a], sets[b]) for a, b in near)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    assert len(set(got.values())) == 6000 + len(near) - sum(got[a] == got[b] for a, b in near)


@pytest.mark.parametrize("n", [500, 2000])
def test_pairs_a_member_do_not_grow_with_the_group(spark, monkeypatch, n):
    rng = np.random.default_rng(4)
    base = prose(300, rng)
    rows = [(i, " ".join([*base[: i % 300], f"x{i}", *base[i % 300 + 1:]])) for i in range(n)]
    made = []
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()).collect()
    assert {r.component_id for r in got} == {0} and sum(made) <= 12 * n


def test_long_sets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 100)
    rows = edited_copies()
    near, _ = all_pairs(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").checkpoint()).collect()}
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in near) >= 0.97 * len(near)


def test_crowds_meet_block_by_block(spark, monkeypatch):
    """Links of a crowd are all found, whatever the blocks, and components that fill blocks do not meet themselves."""
    rng = np.random.default_rng(3)
    sets = {}
    for i in range(60):
        base = rng.choice(4000, int(rng.integers(20, 60)), replace=False)
        for j in range(3):
            sets[3 * i + j + 1] = sorted({*base[j:].tolist(), *range(9000, 9100), 10_000 + 3 * i + j})
    root = {n: 1 if n <= 30 else n for n in sets}
    near = [(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and similar(set(sets[a]), set(sets[b]))]
    assert len(near) > 100
    want = brute.roots(max(sets) + 1, [*near, *((1, n) for n in range(2, 31))])
    members = spark.createDataFrame([(n, len(s), root[n]) for n, s in sets.items()], "node long, size long, root long")
    shingles = spark.createDataFrame(list(sets.items()), "node long, s array<long>").checkpoint()
    for block, listed in ((1 << 20, 16), (1 << 10, 0), (1 << 11, 1000)):
        for name, value in (("BLOCK", block), ("FEWEST", 50), ("LISTED", listed), ("COLUMNS", 7)):
            monkeypatch.setattr(simhash, name, value)
        links = {(r.a, r.b) for r in simhash._block_links(members, shingles, 0.8).collect()}
        assert links <= set(near)
        got = brute.roots(max(sets) + 1, [*links, *((1, n) for n in range(2, 31))])
        assert {(got[a], got[b]) for a, b in near} == {(x, x) for x in {got[a] for a, _ in near}} and len(set(got)) == len(set(want))
