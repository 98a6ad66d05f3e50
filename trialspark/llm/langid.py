"""Language identification word by word with a linear-chain conditional random field.

Each word is labelled with a language.  Its features are affixes, letter
n-grams and membership in word lists learned per language; transitions are
learned too, so a foreign word alone does not switch the language but a passage
does.  Forward-backward gives each word's label probabilities; a text's score
for a language is their mean.

The model is fitted on the driver from about ``SAMPLE`` labelled texts, at least
``LEAST`` of each language (all, if fewer), chosen by a hash of id and text, and
``SEGMENTS`` segments of each.  Segments of
different languages are joined to sequences, so that switches are seen.  Its
size does not depend on the corpus; labelling runs where the texts are read.
"""

from __future__ import annotations

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

from trialspark.llm.common import chunks, map_arrow, mix, remembered, text_buffers

SAMPLE = 4000
#: Texts of each language that are sampled even if it is rarer than that.
LEAST = 150
SEGMENTS = 3
SEGMENT_WORDS = 24
#: Hashed features.
BUCKETS = 1 << 16
#: Words of each language's list.
LEXICON = 3000
#: Words that form one chain; longer texts are several chains.
CHAIN = 128
EPOCHS = 6
MEMORY = 400_000
NO_LETTER = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def core(word: bytes) -> str:
    """The letters of a word, lower-cased; '' if it has none."""
    return _NOT_LETTERS.sub("", word.decode()).lower()


class Features(NamedTuple):
    index: np.ndarray  # feature of each incidence
    word: np.ndarray  # word of each incidence


def features(cores: list[str]) -> Features:
    """Hashed affixes (1 to 4 letters) and n-grams (2 to 4 letters, with word ends) of each word."""
    line = "".join(f"\x02{c}\x03" for c in cores)
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(c) + 2 for c in cores), np.int64, len(cores))
    first = np.append(0, np.cumsum(size))[:-1]
    word = np.repeat(np.arange(len(cores)), size)
    index, of = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 6):
        # h[i]: hash of the n characters from i on
        h = mix((h[: len(code) - n + 1] if n > 1 else h) * np.uint64(0x100000001B3) + code[n - 1:] + np.uint64(n))
        inside = word[n - 1:] == word[: len(code) - n + 1]
        if 2 <= n <= 4:
            index.append(h[inside])
            of.append(word[: len(code) - n + 1][inside])
        if n >= 2:
            for salt, at in ((1, first), (2, first + size - n)):
                fit = size >= n + (n < 2)
                index.append(mix(h[at[fit]] + np.uint64(salt)))
                of.append(np.flatnonzero(fit))
    return Features((np.concatenate(index) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(of))


class Model(NamedTuple):
    langs: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, labels)
    moves: np.ndarray  # (labels, labels), log scores
    start: np.ndarray
    lexicon: dict[str, tuple[int, ...]]  # word -> languages whose lists hold it
    in_lexicon: np.ndarray  # (labels, labels): weight for label y of a word in the list of x


def emissions(model: Model, cores: list[str]) -> np.ndarray:
    """Log scores of each label for each word."""
    f = features(cores)
    w, n = model.weights, len(model.langs)
    out = np.column_stack([np.bincount(f.word, w[f.index, y], minlength=len(cores)) for y in range(n)])
    return out + members(model.lexicon, cores, n) @ model.in_lexicon


def members(lexicon: dict[str, tuple[int, ...]], words: list[str], n: int) -> np.ndarray:
    """(word, language): 1 where the language's list holds the word."""
    out = np.zeros((len(words), n))
    for i, w in enumerate(words):
        if held := lexicon.get(w):
            out[i, list(held)] = 1
    return out


def forward_backward(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains e (time, chain, label): label probabilities (time, chain, label),
    expected moves (label, label) over all chains, and log-likelihood normalisers."""
    t, b, n = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(moves)
    alpha, beta, norm = np.zeros_like(p), np.ones_like(p), np.ones((t, b))
    x = p[0] * np.exp(start)
    for i in range(t):
        if i:
            x = np.where(mask[i][:, None], (alpha[i - 1] @ a) * p[i], alpha[i - 1])
        norm[i] = x.sum(axis=1)
        alpha[i] = x / norm[i][:, None]
    pair = np.zeros((n, n))
    for i in range(t - 2, -1, -1):
        y = p[i + 1] * beta[i + 1] / norm[i + 1][:, None]
        live = mask[i + 1][:, None]
        pair += (alpha[i] * live).T @ y
        beta[i] = np.where(live, y @ a.T, beta[i + 1])
    gamma = alpha * beta
    return gamma / gamma.sum(axis=2, keepdims=True), pair * a, norm


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, chain) of word numbers and which of them are words."""
    t = max(map(len, rows))
    ids, mask = np.zeros((t, len(rows)), np.int64), np.zeros((t, len(rows)), bool)
    for j, r in enumerate(rows):
        ids[: len(r), j] = r
        mask[: len(r), j] = True
    return ids, mask


def fit(segments: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 3, batch: int = 192) -> Model:
    """Learn from (language, words) segments, by likelihood with adaptive steps."""
    rng = np.random.default_rng(seed)
    langs = tuple(sorted({y for y, _ in segments})) or (NO_LETTER,)
    number = {y: i for i, y in enumerate(langs)}
    n = len(langs)
    seen = [Counter(itertools.chain.from_iterable(set(w) for y, w in segments if y == lang)) for lang in langs]
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, c in enumerate(seen):
        for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if k > 1:
                lexicon[w] = (*lexicon.get(w, ()), i)
    words = sorted({w for _, ws in segments for w in ws})
    ids = {w: i for i, w in enumerate(words)}
    f = features(words)
    begin = np.searchsorted(f.word[np.argsort(f.word, kind="stable")], np.arange(len(words) + 1))
    by_word = f.index[np.argsort(f.word, kind="stable")]
    member = members(lexicon, words, n)
    theta = [np.zeros((BUCKETS, n)), np.eye(n) * 2.0, np.zeros(n), np.zeros((n, n))]
    square = [np.full_like(x, 1e-3) for x in theta]
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        chains, at = [], 0
        while at < len(order):
            k = int(rng.integers(1, 4))
            chains.append([segments[i] for i in order[at: at + k]])
            at += k
        for lo in range(0, len(chains), batch):
            part = [c for c in chains[lo: lo + batch] if any(w for _, w in c)]
            if not part:
                continue
            word, mask = pad([np.array([ids[w] for _, ws in c for w in ws]) for c in part])
            label, _ = pad([np.array([number[y] for y, ws in c for _ in ws]) for c in part])
            used, of = np.unique(word[mask], return_inverse=True)
            flat = np.concatenate([by_word[begin[u]: begin[u + 1]] for u in used])
            owner = np.repeat(np.arange(len(used)), begin[used + 1] - begin[used])
            e_used = np.column_stack([np.bincount(owner, theta[0][flat, y], minlength=len(used)) for y in range(n)]) + member[used] @ theta[3]
            e = np.zeros((*word.shape, n))
            e[mask] = e_used[of]
            gamma, pair, _ = forward_backward(e, mask, theta[1], theta[2])
            g = -gamma[mask]
            g[np.arange(len(g)), label[mask]] += 1
            g_used = np.column_stack([np.bincount(of, g[:, y], minlength=len(used)) for y in range(n)])
            true_pair = np.zeros((n, n))
            both = mask[1:] & mask[:-1]
            np.add.at(true_pair, (label[:-1][both], label[1:][both]), 1)
            first = -gamma[0].sum(axis=0) + np.bincount(label[0], minlength=n)
            touched, inv = np.unique(flat, return_inverse=True)
            g_w = np.column_stack([np.bincount(inv, g_used[owner, y], minlength=len(touched)) for y in range(n)])
            scale = 1 / mask.sum()
            for i, (where, grad) in enumerate(((touched, g_w), (slice(None), true_pair - pair), (slice(None), first), (slice(None), member[used].T @ g_used))):
                grad = grad * scale - 1e-6 * theta[i][where]
                square[i][where] += grad * grad
                theta[i][where] += (0.3 if i in (0, 3) else 0.1) * grad / np.sqrt(square[i][where])
    return Model(langs, theta[0].astype(np.float32), theta[1], theta[2], lexicon, theta[3])


class Labeller:
    """A model with the emissions of the words met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.cores: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)))

    def learn(self, missing: set[bytes]) -> None:
        new = []
        for w in missing:
            c = core(w)
            if not c:
                self.ids[w] = -1
                continue
            at = self.cores.get(c)
            if at is None:
                at = self.cores[c] = len(self.cores)
                new.append(c)
            self.ids[w] = at
        for lo in range(0, len(new), 20_000):
            self.table = np.concatenate([self.table, emissions(self.model, new[lo: lo + 20_000])])

    def posteriors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: the places of its words with letters among its words, and their label probabilities."""
        split = [(t or "").encode().split() for t in texts]
        if len(self.ids) > MEMORY:
            self.forget()
        missing = set(itertools.chain.from_iterable(split)) - self.ids.keys()
        if missing:
            self.learn(missing)
        get = self.ids.__getitem__
        rows = [np.array(list(map(get, words)), np.int64) for words in split]
        kept = [np.flatnonzero(r >= 0) for r in rows]
        pieces, owner = [], []
        for i, (r, k) in enumerate(zip(rows, kept, strict=True)):
            for lo in range(0, len(k), CHAIN):
                pieces.append(r[k[lo: lo + CHAIN]])
                owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        order = sorted(range(len(pieces)), key=lambda j: len(pieces[j]))
        found: list[np.ndarray] = [np.zeros(0)] * len(pieces)
        for lo in range(0, len(order), 2000):
            part = order[lo: lo + 2000]
            word, mask = pad([pieces[j] for j in part])
            e = self.table[word]
            gamma, _, _ = forward_backward(e, mask, self.model.moves, self.model.start)
            for c, j in enumerate(part):
                found[j] = gamma[: len(pieces[j]), c]
        for i, g in zip(owner, found, strict=True):
            out[i].append(g)
        none = np.zeros((0, len(self.model.langs)))
        return [(k, np.concatenate(g) if g else none) for k, g in zip(kept, out, strict=True)]


def _labeller(sent: Broadcast) -> Labeller:
    return remembered(("labeller", id(sent.value)), lambda: Labeller(sent.value))  # which holds the value


def sample_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> list[tuple[str, list[str]]]:
    """Segments of about ``most`` labelled texts, from the whole length of each.

    Each language has a quota: its share of ``most``, ``LEAST`` at least.  Rows
    are taken by a hash of id and text, and repeated rows once.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(doc_id, text).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    found = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    total = max(sum(r["n"] for r in found), 1)
    part = {r["lang"]: min(1.0, 1.05 * max(most * r["n"] / total, LEAST) / max(r["n"], 1)) for r in found}
    shares = docs.sparkSession.createDataFrame([(y, int(p * (1 << 20)) + (p == 1.0)) for y, p in part.items()], "lang string, parts long")
    picked = (labelled.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("parts"))
              .groupBy("lang", "h").agg(F.first("text").alias("text")).drop("h"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, lines = [], []
        for y, t in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            words = [c[:40] for c in map(core, t.as_py().encode().split()) if c]
            starts = sorted({int(s) for s in np.linspace(0, max(0, len(words) - SEGMENT_WORDS), SEGMENTS)})
            for s in starts:
                langs.append(y)
                lines.append(" ".join(words[s: s + SEGMENT_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(lines, pa.string())], names=["lang", "line"])

    rows = map_arrow(picked, run, "lang string, line string").where("line <> ''").collect()
    return [(r["lang"], r["line"].split(" ")) for r in sorted(rows)]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", with_words: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (replacing columns so named).

    A null text, or one without letters, is ``und`` with score 0.  With
    ``with_words`` there is also ``words``: runs of words with one label, as
    (first word, end, language).  Repeated rows are labelled each.
    """
    added = ["lang_pred", "score", *(["words"] if with_words else [])]
    base = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = base.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label = _labeller(sent)
        texts = batch.column(text)
        pred, score, runs = [], [], []
        for lo, hi in chunks(text_buffers(texts)[1], 2 << 20):
            for place, gamma in label.posteriors(texts.slice(lo, hi - lo).to_pylist()):
                mean = gamma.mean(axis=0) if len(gamma) else None
                pred.append(NO_LETTER if mean is None else label.model.langs[int(mean.argmax())])
                score.append(0.0 if mean is None else min(1.0, float(mean.max())))
                if with_words:
                    y = gamma.argmax(axis=1) if len(gamma) else np.zeros(0, np.int64)
                    cut = np.append(np.append(0, np.flatnonzero(y[1:] != y[:-1]) + 1), len(y)) if len(y) else np.zeros(1, np.int64)
                    runs.append([{"first": int(place[a]), "end": int(place[b - 1]) + 1, "lang": label.model.langs[int(y[a])]} for a, b in zip(cut, cut[1:], strict=False)])
        cols = [*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
        if with_words:
            cols.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
        yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    new = {"lang_pred": F.lit(""), "score": F.lit(0.0)} | ({"words": F.expr("cast(null as array<struct<first:bigint,end:bigint,lang:string>>)")} if with_words else {})
    return map_arrow(base, run, base.limit(0).withColumns(new).schema)
