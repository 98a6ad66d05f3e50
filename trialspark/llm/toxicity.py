"""Toxicity of texts with a subsequence string kernel and a support vector machine.

Two strings are alike if they share letter triples in order, also with letters
between them; a triple over s letters weighs ``DECAY ** s``, up to ``REACH``.
So an insult is met with gaps, inserted letters and new endings.  Kernel values
against landmark strings give Nyström features for a linear machine.  As the
kernel is an inner product of triple weights, the trained machine folds into one
weight per triple: scoring a string is a sum over its own triples, divided by
its norm, and does not depend on the number of landmarks.

Labels are known for texts, while an insult stands in one place.  Training
treats the pieces (words, and runs of spelled-out letters) of the sentences of a
clean text as clean, and of each toxic text the strongest piece as toxic,
choosing it anew in each round; clean pieces that score high are added as
examples.  Toxic examples also come with inserted and doubled letters.  A
sentence scores as its strongest piece; a text's probability is a logistic
function of its three strongest pieces.

The machine is fitted on the driver from a bounded sample (``TOXIC`` and
``CLEAN`` labelled texts, about, by a hash of the id); all texts are scored
where they are read.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import chunks, map_arrow, text_buffers

TOXIC = 1500
CLEAN = 3000
LANDMARKS = 96
ROUNDS = 4
DECAY = 0.7
REACH = 5
#: Letters of a piece; longer words give overlapping pieces.
PIECE = 24
MEMORY = 400_000
#: Score of a text without letters, in units of the machine's margin.
FLOOR = -3.0

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_START, _END = 27, 28


def core(word: str) -> str:
    return _NOT_LETTERS.sub("", word).lower()


def spelled(cores: list[str]) -> list[str]:
    """Runs of three or more words of at most two letters, put together."""
    out, run = [], []
    for c in [*cores, "..."]:
        if 0 < len(c) <= 2:
            run.append(c)
        elif c:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def triples(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, triple, weight) of all pieces, one entry per distinct triple of a piece."""
    line = "".join(pieces)
    raw = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where((raw >= 97) & (raw <= 122), raw - 96, 29 + raw % 35)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.append(0, np.cumsum(size + 2))
    code = np.full(int(first[-1]), _END, np.int64)
    code[first[:-1]] = _START
    owner = np.repeat(np.arange(len(pieces)), size + 2)
    inner = np.ones(len(code), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    code[inner] = letter
    keys, weights = [], []
    for a in range(1, REACH - 1):
        for b in range(1, REACH - a):
            s = a + b
            if len(code) <= s:
                continue
            ok = owner[s:] == owner[: len(code) - s]
            k = (owner[s:] << 18) | (code[: len(code) - s] << 12) | (code[a: len(code) - s + a] << 6) | code[s:]
            keys.append(k[ok])
            weights.append(np.full(int(ok.sum()), DECAY ** (s + 1)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[head] >> 18, key[head] & 0x3FFFF, np.add.reduceat(weight, head)


def normed(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples with weights of unit length per piece."""
    piece, triple, weight = triples(pieces)
    norm = np.sqrt(np.bincount(piece, weight * weight, minlength=len(pieces)))
    return piece, triple, weight / norm[piece]


class Machine(NamedTuple):
    weights: np.ndarray  # of each triple
    bias: float
    logistic: np.ndarray  # of the probability over a text's largest decision values


def margins(weights: np.ndarray, bias: float, pieces: list[str]) -> np.ndarray:
    """Decision values of pieces."""
    out = np.empty(len(pieces))
    for lo in range(0, len(pieces), 20_000):
        part = pieces[lo: lo + 20_000]
        piece, triple, weight = normed(part)
        out[lo: lo + len(part)] = np.bincount(piece, weight * weights[triple], minlength=len(part)) + bias
    return out


def kernel(pieces: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, by the shared triples."""
    piece, triple, weight = normed(landmarks)
    used, at = np.unique(triple, return_inverse=True)
    table = np.zeros((len(used) + 1, len(landmarks)))
    table[at, piece] = weight
    out = np.zeros((len(pieces), len(landmarks)))
    for lo in range(0, len(pieces), 4000):
        part = pieces[lo: lo + 4000]
        p, t, w = normed(part)
        where = np.minimum(np.searchsorted(used, t), len(used) - 1)
        met = used[where] == t
        p, w, where = p[met], w[met], where[met]
        block = table[where] * w[:, None]
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
        if len(head):
            out[lo + p[head]] = np.add.reduceat(block, head, axis=0)
    return out


def solve(z: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine, by Newton steps on its active rows."""
    x = np.column_stack([z, np.ones(len(z))])
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        on = y * (x @ w) < 1
        xa = x[on] * c[on, None]
        new = np.linalg.solve(reg + xa.T @ x[on], xa.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def variants(piece: str, rng: np.random.Generator) -> list[str]:
    """The piece with a foreign letter put in, and with a letter doubled."""
    if len(piece) < 3:
        return []
    i, j = int(rng.integers(1, len(piece))), int(rng.integers(0, len(piece)))
    return [piece[:i] + chr(97 + int(rng.integers(26))) + piece[i:], piece[: j + 1] + piece[j:]]


def fit(texts: list[tuple[int, list[str]]], rounds: int = ROUNDS, landmarks: int = LANDMARKS, seed: int = 5) -> Machine:
    """Learn from (label, pieces) of labelled texts."""
    rng = np.random.default_rng(seed)
    bags = [sorted(set(p)) for y, p in texts if y == 1 and p]
    clean = Counter(itertools.chain.from_iterable(set(p) for y, p in texts if y == 0))
    if not bags or not clean:
        share = sum(y for y, _ in texts) / len(texts) if texts else 0.0
        return Machine(np.zeros(1 << 18, np.float32), 0.0, np.array([0.0, 0.0, 0.0, -6.0 if share == 0 else 6.0]))

    def grams(piece: str) -> set[str]:
        line = f"^{piece}$"
        return {line[i: i + 4] for i in range(len(line) - 3)}

    # first choice: the piece with the four letters that toxic texts hold most beyond clean ones
    in_toxic = Counter(itertools.chain.from_iterable(set().union(*map(grams, b)) for b in bags))
    in_clean: Counter = Counter()
    for p, n in clean.items():
        for g in grams(p):
            in_clean[g] += n
    n_clean = sum(1 for y, _ in texts if y == 0)
    odds = {g: np.log((k + 0.5) / (in_clean[g] + 0.5) * n_clean / len(bags)) for g, k in in_toxic.items() if k >= 3}
    ranges = np.append(0, np.cumsum([len(b) for b in bags]))
    flat = list(itertools.chain.from_iterable(bags))
    fresh = np.array([p not in clean for p in flat])

    def strongest(f: np.ndarray, one: float, more: float) -> list[str]:
        """The best piece of each text if beyond ``one``, and up to two beyond ``more``; pieces that clean texts hold come last."""
        f = np.where(fresh, f, f - 2.0)
        out = []
        for a, b in zip(ranges, ranges[1:], strict=False):
            top = a + np.argsort(-f[a:b], kind="stable")[:3]
            out += [flat[i] for n, i in enumerate(top) if f[i] > (more if n else one)]
        return out

    chosen = strongest(np.array([max((odds.get(g, -9.0) for g in grams(p)), default=-9.0) for p in flat]), 1.5, 3.0)

    if not chosen:
        chosen = [b[0] for b in bags]
    pool = sorted(clean, key=lambda p: (-clean[p], p))
    common = pool[:landmarks // 2]
    others = set(pool[: 2000]) | {pool[i] for i in rng.choice(len(pool), min(len(pool), 6000), replace=False)}
    weights, bias = np.zeros(1 << 18), 0.0
    hard: list[str] = []
    for _ in range(rounds):
        toxic = Counter(chosen)
        marks = list(dict.fromkeys([p for p, _ in toxic.most_common(landmarks)] + common + hard[: landmarks // 2]))
        inner = kernel(marks, marks)
        value, vector = np.linalg.eigh(inner)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        good = sorted(toxic)
        near = [v for p in good for v in variants(p, rng)]
        bad = sorted(others)
        z = kernel([*good, *near, *bad], marks) @ root
        y = np.append(np.ones(len(good) + len(near)), -np.ones(len(bad)))
        c_good, c_near, c_bad = (np.array(x, float) for x in ([toxic[p] for p in good], [0.3] * len(near), [clean[p] ** 0.5 for p in bad]))
        c = np.concatenate([c_good / c_good.sum(), c_near / max(c_good.sum(), 1), c_bad / c_bad.sum()])
        w, bias = solve(z, y, 5_000 * c)
        piece, triple, weight = normed(marks)
        weights = np.bincount(triple, weight * (root @ w)[piece], minlength=1 << 18)
        f = margins(weights, bias, flat)
        chosen = strongest(f, -0.5, 0.0) or chosen
        g = margins(weights, bias, pool)
        hard = [pool[i] for i in np.argsort(-g, kind="stable")[:1500]]
        others |= set(hard)
    of = dict(zip(pool, g.tolist(), strict=True)) | dict(zip(flat, f.tolist(), strict=True))
    tops = np.array([top_values([of[p] for p in set(ps)]) for _, ps in texts])
    return Machine(weights.astype(np.float32), bias, logistic(tops, np.array([y for y, _ in texts])))


def top_values(values: list[float]) -> list[float]:
    """The three largest decision values of a text, cut to the range in which they tell something."""
    top = heapq.nlargest(3, values)
    return [min(max(v, FLOOR), -FLOOR) for v in (*top, *[FLOOR] * (3 - len(top)))]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the probability over the values of ``top_values`` and a constant, with smoothed targets."""
    n, k = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n + 1) / (n + 2), 1 / (k + 2))
    m = np.column_stack([x, np.ones(len(x))])
    w = np.array([2.0, 0.0, 0.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p) + 1e-9)[:, None]).T @ m + 1e-2 * np.eye(4), m.T @ (t - p) - 1e-2 * w)
        w += np.clip(step, -1, 1)
    return w


def split_long(c: str) -> list[str]:
    return [c] if len(c) <= PIECE else [c[i: i + PIECE] for i in range(0, len(c) - PIECE // 2, PIECE // 2)]


def pieces_of(text: str | None) -> list[str]:
    cores = [core(w.decode()) for w in (text or "").encode().split()]
    return [p for c in (*cores, *spelled(cores)) if c for p in split_long(c)]


class Scorer:
    """A machine with the decision values of the words met."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, float] = {}
        self.short: dict[bytes, str] = {}
        self.cores: dict[str, float] = {}

    def _value(self, cores: list[str]) -> None:
        """Decision values of new words: that of their strongest piece."""
        new = [c for c in dict.fromkeys(cores) if c not in self.cores]
        parts = [split_long(c) for c in new]
        size = np.array([len(p) for p in parts], np.int64)
        if len(new):
            f = margins(self.machine.weights, self.machine.bias, list(itertools.chain.from_iterable(parts)))
            self.cores.update(zip(new, np.maximum.reduceat(f, np.append(0, np.cumsum(size))[:-1]).tolist(), strict=True))

    def of(self, texts: list[str | None]) -> list[list[float]]:
        """``top_values`` of each text, over its distinct words."""
        if len(self.words) > MEMORY:
            self.forget()
        split = [(t or "").encode().split() for t in texts]
        missing = list(set(itertools.chain.from_iterable(split)) - self.words.keys())
        cores = [core(w.decode()) for w in missing]
        self._value([c for c in cores if c])
        for w, c in zip(missing, cores, strict=True):
            self.words[w] = self.cores[c] if c else FLOOR
            if len(c) <= 2:
                self.short[w] = c
        get, short = self.words.__getitem__, self.short
        values = [list(map(get, set(words))) for words in split]
        runs: list[tuple[int, str]] = []
        for i, words in enumerate(split):
            flags = [w in short for w in words]
            if sum(flags) >= 3:
                runs += [(i, r) for r in spelled([short[w] if s else "..." for w, s in zip(words, flags, strict=True)])]
        self._value([r for _, r in runs])
        for i, r in runs:
            values[i].append(self.cores[r])
        return [top_values(v) for v in values]

    def probability(self, top: list[list[float]]) -> np.ndarray:
        m = np.column_stack([np.array(top, np.float64).reshape(len(top), 3), np.ones(len(top))])
        return 1 / (1 + np.exp(-np.clip(m @ self.machine.logistic, -30, 30)))


_scorers: dict[int, Scorer] = {}


def _scorer(sent: Broadcast) -> Scorer:
    if id(sent.value) not in _scorers:
        _scorers.clear()
        _scorers[id(sent.value)] = Scorer(sent.value)
    return _scorers[id(sent.value)]


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           most_toxic: int = TOXIC, most_clean: int = CLEAN) -> list[tuple[int, list[str]]]:
    """(label, pieces) of about so many labelled texts, one of an id.  An id with several labels is toxic if one of them is."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.join(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, most in ((1, most_toxic), (0, most_clean)):
        share = F.when(F.col("y") == y, min(1.0, most / max(n.get(y, 1), 1))).otherwise(share)
    # at most about most_toxic + most_clean rows of an id and a label, whatever the size of the tables
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * (most_toxic + most_clean))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines = ["\n".join(sorted(set(pieces_of(t.as_py())))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lines, pa.string())], names=["y", "line"])

    one = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")
    one = one.groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("y", F.col("m.text").alias("text"))
    rows = map_arrow(one.select("y", "text"), run, "y int, line string").distinct().collect()
    return [(r["y"], r["line"].split("\n") if r["line"] else []) for r in sorted(rows)]


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) added, replacing columns so named.

    A null text, or one without letters, has the score of the lowest margin.
    Repeated rows are scored each.
    """
    base = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    names = base.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        texts = batch.column(text)
        top: list[list[float]] = []
        for lo, hi in chunks(text_buffers(texts)[1], 2 << 20):
            top += scorer.of(texts.slice(lo, hi - lo).to_pylist())
        p = scorer.probability(top)
        cols = [*(batch.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "predicted"])

    return map_arrow(base, run, base.limit(0).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
