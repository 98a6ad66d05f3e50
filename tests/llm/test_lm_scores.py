"""Language-model scores: words by Arrow, and normalisers from products of exponentials."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trialspark.llm import lm

SYMBOLS, GROUPS, WIDTH = 60, 12, 6


def tables(scale: float) -> lm.Tables:
    """A model whose scores are of the size of ``scale`` squared."""
    rng = np.random.default_rng(3)
    starts = np.arange(0, SYMBOLS + 1, SYMBOLS // GROUPS)
    draw = lambda n: (scale * rng.normal(0, 1, (n, WIDTH))).astype(np.float32)
    bias = lambda n: rng.normal(0, 1, n).astype(np.float32)
    head = [(lm.END, 10), *((f"w{i}".encode(), 9) for i in range(20))]
    packed = b"".join(len(w).to_bytes(4, "little") + w for w, _ in head)
    return lm.Tables(lm.Model(packed, np.array([n for _, n in head], float), np.arange(1, 22), starts, draw(SYMBOLS), np.ones((2, WIDTH), np.float32),
                              (draw(GROUPS), bias(GROUPS)), (draw(SYMBOLS), bias(SYMBOLS)), np.zeros(GROUPS), 1000, 21))


def plain(t: lm.Tables, w: int, h1: int, h2: int) -> float:
    m = t.model
    q = m.places[0].astype(float) * m.contexts[h1] + m.places[1].astype(float) * m.contexts[h2]
    g = int(np.searchsorted(m.starts, w, side="right")) - 1
    out = 0.0
    for s, own in ((m.groups[0].astype(float) @ q + m.groups[1], g), ((m.members[0].astype(float) @ q + m.members[1])[m.starts[g]: m.starts[g + 1]], w - m.starts[g])):
        out += s[own] - s.max() - math.log(np.exp(s - s.max()).sum())
    return out / math.log(10)


@pytest.mark.parametrize("scale", [0.5, 8.0])
def test_products_of_exponentials_equal_plain_softmaxes(scale, monkeypatch):
    """The larger scores differ by more than 32-bit exponentials hold."""
    monkeypatch.setattr(lm, "TOGETHER", 700)
    monkeypatch.setattr(lm, "ROWS", 64)
    t = tables(scale)
    w, h1, h2 = np.random.default_rng(4).integers(0, SYMBOLS, (3, 1500))
    got = t.log_probabilities(w, h1, h2)
    want = np.array([plain(t, *x) for x in zip(w.tolist(), h1.tolist(), h2.tolist(), strict=True)])
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-5, atol=1e-4)
    assert (want.min() < -150) == (scale > 1)


def test_groups_take_exponentials_of_distinct_words_only(monkeypatch):
    """A token costs the members of its group; the groups cost the distinct words before."""
    t, n, taken, exp = tables(0.5), 4000, [], np.exp
    w, h1, h2 = np.random.default_rng(5).integers(0, SYMBOLS, (3, n))
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    t.log_probabilities(w, h1, h2)
    assert sum(taken) <= n * (SYMBOLS // GROUPS) + 2 * SYMBOLS * GROUPS


def test_words_by_arrow_are_the_words_of_the_rule():
    texts = ["", " ", None, "a", "A\x0bB\x0cC\x1cd\x85e", "Ä é ß  İK\n", "\t lead trail ", "\x00 x\r\ny z", "b" * 70 + " B"]
    for kind in (pa.string(), pa.large_string()):
        words, row = lm.word_array(pa.array(["cut away", *texts], kind).slice(1))
        got = [[] for _ in texts]
        for w, r in zip(words.cast(pa.binary()).to_pylist(), row.tolist(), strict=True):
            got[r].append(w)
        assert got == [lm.words_of(t) for t in texts]


def test_token_counts_pass_on_what_is_much(spark, monkeypatch):
    """Parts of the texts are cut and merged apart, and full counts are passed on."""
    monkeypatch.setattr(lm, "PIECE", 500)
    monkeypatch.setattr(lm, "FLUSH", 40)
    texts = [None, "", " \n", "b" * 600, *(f"A{i % 7} a{i % 7}\x0bw{i % 50} é{i}" for i in range(400))]
    want = Counter(w for t in texts for w in lm.words_of(t))
    got = lm.token_counts(spark.createDataFrame([(t,) for t in texts], "body string"), "body").collect()
    assert {bytes(r.token): r.n for r in got} == want and len(got) == len(want)
    assert lm.token_counts(spark.createDataFrame([], "text string")).count() == 0


def test_every_token_is_learned_from(spark, monkeypatch):
    """Parts hold each token once, and a pair of words that only one text has changes what is learned."""
    monkeypatch.setattr(lm, "STEPS", 1)
    monkeypatch.setattr(lm, "PART", 40)
    monkeypatch.setattr(lm, "PIECE", 20_000)
    rng = np.random.default_rng(6)
    texts = [None, "", *(" ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 5000) for _ in range(500))]
    n = sum(len(lm.words_of(t)) for t in texts)
    parts = round(math.sqrt(n) / 40)
    docs = lambda last: spark.createDataFrame([(t,) for t in [*texts, last]], "body string").repartition(7)
    one, other = (lm.fit(docs(t), "body")[0] for t in ("left w1", "w1 left"))
    assert parts > 8 and one.tokens == other.tokens == one.trained == other.trained == n + 3
    assert one.words == other.words and not np.array_equal(one.contexts, other.contexts)
    counts = lm.fit(docs("left w1"), "body")[1]
    assert sum(r.n for r in counts.collect()) == one.trained


def test_parts_hold_all_texts_in_their_order(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 300)
    texts = [None, "", "b" * 400, *(" ".join(f"w{(i * k) % 11}" for k in range(i % 9)) for i in range(200)), "x w1 unknownword"]
    words = [lm.END, *(f"w{i}".encode() for i in range(11))]
    symbols, starts, _ = lm.lay_out([(w, 5) for w in words], 12, 4)
    known = dict(zip(words, symbols.tolist(), strict=True))
    coded = lm.write_symbols(spark.createDataFrame([(t,) for t in texts], "text string"), words, symbols, starts, 5).collect()
    got = Counter()
    for r in coded:
        flat, size = np.frombuffer(r.symbols, lm.symbol_type(starts)), np.frombuffer(r.sizes, "<i4")
        assert 0 <= r.part < 5 and size.sum() == len(flat)
        got.update(tuple(x.tolist()) for x in np.split(flat, np.cumsum(size)[:-1]))
    assert got == Counter(tuple(known.get(w, int(starts[lm.group_of(w, 4)])) for w in lm.words_of(t)) for t in texts)
    assert len({r.part for r in coded}) == 5


def test_rounds_take_every_part_once():
    for parts in range(1, 70):
        rounds = lm.rounds_of(parts)
        assert [p for r in rounds for p in r] == list(range(parts)) and len(rounds) <= 2 + math.log2(parts)


def test_the_words_before_are_those_of_the_same_text():
    flat, size = np.array([3, 4, 9, 9, 5, 9, 9], np.int32), np.array([3, 1, 2, 1])
    h1, h2 = lm.before(flat, size, 9)
    assert h1.tolist() == [9, 3, 4, 9, 9, 5, 9] and h2.tolist() == [9, 9, 3, 9, 9, 9, 9]


def test_sums_of_rows_two_columns_at_once():
    rng = np.random.default_rng(7)
    at, x = rng.integers(0, 9, 200), rng.normal(0, 1, (200, 6)).astype(np.float32)
    keys, sums = lm._gather(at, x)
    assert keys.tolist() == sorted(set(at.tolist()))
    assert np.allclose(sums, [x[at == k].sum(axis=0) for k in keys], atol=1e-5)
