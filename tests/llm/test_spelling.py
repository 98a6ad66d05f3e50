"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialspark.llm import queries, spelling


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def plain(rows, times=3):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= times}
    holes = defaultdict(set)
    for w in n:
        for x in [w, *(w[:i] + w[i + 1:] for i in range(len(w)))]:
            holes[x].add(w)
    found = {w: [x for x in set().union(*(holes[h] for h in [w, *(w[:i] + w[i + 1:] for i in range(len(w)))])) if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(found[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(found[w]), n[form[w]] if form[w] else -1) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(docs)
    assert rows_of(got) == want and sum(r[1] != "" for r in want) > 100


@pytest.mark.parametrize("crowd", [3, 40, 10**6])
def test_dense_vocabularies_and_cut_blocks(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "TOGETHER", 37)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rng = np.random.default_rng(crowd)
        words = ["".join(rng.choice(list("abÿ"), rng.integers(5, 9))) for _ in range(600)] + ["aaaaa"] * 40 + ["aaaaaa"] * 9 + ["baaaa"] * 4
        rows = [(i, " ".join(rng.choice(words, 300))) for i in range(12)]
        got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
        assert rows_of(got) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_words(spark):
    base = "abcdefgh" * 500
    text = " ".join([base] * 9 + [base[:2000] + base[2001:]] * 4 + [base + "x"] * 3 + ["z" + base] * 3 + [base[:-2] + "zz"] * 3)
    rows = [(1, text)]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_odd_rows(spark):
    rows = [("c", None, "n1", "Ünïcode ÀÉÎÕ× ÷÷÷÷÷ ünïcode"), ("c", 1, "n2", None), ("d", 2, "x", ""), ("e", 3, "y", "WORDS words Words wordss wordss wordss")] + [("f", 4, "z", "aaaaa aaaab")] * 3
    docs = spark.createDataFrame(rows, "n string, doc_id long, word string, text string")
    assert rows_of(spelling.variants(docs)) == plain([(r[1], r[3]) for r in rows])
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("doc_id = 2")).count() == 0


def test_chains_of_forms(spark):
    chain = spark.range(40).select(F.format_string("w%03d", F.col("id")).alias("word"), F.format_string("w%03d", F.col("id") + 1).alias("form"))
    assert {r.root for r in spelling.roots(chain).collect()} == {"w040"}


def test_words_that_look_at_once_are_bounded_by_their_blocks(monkeypatch):
    """One block of many words is searched in shares of bounded work, not of so many words."""
    words = sorted({f"aa{i % 26 + 97:c}{i // 26 % 26 + 97:c}{i // 676 + 97:c}" for i in range(900)})
    n = len(words)
    batch = pa.RecordBatch.from_pydict({"word": words, "n": list(range(1, n + 1)), "m": pa.array([5] * n, pa.int32()), "lo": pa.array([2] * n, pa.int32()), "hi": pa.array([6] * n, pa.int32()), "h": [1] * n})
    found, work, near_pairs = [], [], spelling.near_pairs

    def watched(flat, off, begin, end, lo, ask, *more):
        work.append(int((end - begin)[ask].sum()))
        return near_pairs(flat, off, begin, end, lo, ask, *more)

    for most in (5000, 1 << 20):
        monkeypatch.setattr(spelling, "TOGETHER", most)
        monkeypatch.setattr(spelling, "near_pairs", watched)
        work.clear()
        found.append(sorted(r for b in spelling._scan_blocks(iter([batch])) for r in zip(*b.to_pydict().values(), strict=True)))
        assert max(work) <= most
    assert found[0] == found[1] and {w: k for w, k, *_ in found[0]} == {w: c for w in words if (c := sum(near(w, v) for v in words))}
