"""Language-model scores: unigram base and a log-bilinear neural model.

Counts of all training tokens are made by Spark.  The neural model predicts the
next token from the two before it: a context is c_1 * r_h1 + c_2 * r_h2 (vectors
of the words before, weighted by place), and scores are inner products with it.
Its vocabulary holds the most frequent tokens and grows as the square root of the
training tokens.  The output is factored: tokens fall into groups by their last
letters, as many as the fourth root of the tokens; the model gives the group's
probability, then the token's within its group.  Each group has one member more,
which stands for all its rarer words, known or not; among these a word has its
add-one share.  So normalising costs two short softmaxes a token whatever the
vocabulary, and a rare word is predicted through its ending.

Every token of the training texts is a training event (two context tokens and the
next).  Texts are written once as symbols, in parts whose size grows as the
vocabulary does.  A task learns from the events of a part, both levels by
noise-contrastive estimation; rounds of 1, 1, 2, 4, ... parts begin with what the
rounds before have learned, and rows that the parts of a round have learned are
averaged, weighted by the gradients each part saw.

A task scores many texts at once.  The words before enter a group's score as a sum,
so its exponential is a product: one row of exponentials for each distinct word
before, and a token's normaliser over the groups is the inner product of two rows.
Members are scored by matrix products, tokens sorted by group.

Frequent tokens (at most ``HEAD``, of ``LONGEST`` bytes at most) are looked up in
a table sent to all tasks; occurrences of the others meet their counts in a join
on the token.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import chunks, enter_stage, keep, map_arrow, remembered, text_buffers
from trialspark.sources.ingest import scratch_path

#: The end token; no word contains white space.
END = b"\n"
HEAD = 1 << 18
#: Bytes of a token beyond which it is counted but not sent to tasks.
LONGEST = 64
WIDTH = 32
#: Tokens of the vocabulary for each square root of the training tokens, and groups for each fourth root.
WORDS, GROUPS = 2.0, 1.0
#: Training events of a part for each square root of the training tokens.
PART = 400
#: Events of a step at least, and for each group; steps at least, over a small corpus again; noise tokens.
BATCH, SHARE, STEPS, NOISE = 2048, 128, 800, 8
RATE = 0.15
#: Column of a row's bias, after its vector.
BIAS = -2
#: Events that are put in random order together, and rows of the parameters that are averaged together.
HELD, BLOCK = 1 << 21, 1024
#: Last bytes of a token that choose its group.
ENDING = 3
#: Tokens scored at once, and rows of them that stay in a core's cache.
TOGETHER, ROWS = 1 << 18, 256
#: Scores below this in size need no shift before their exponentials are added in 32 bits; a sum of products under ``WEAK`` is added again, shifted.
TAME, WEAK = 70.0, 1e-20
#: Bytes of text whose words are cut at once.
PIECE = 8 << 20
#: Distinct tokens a task counts before it passes them on.
FLUSH = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, then one end token."""
    return [*(text or "").encode().lower().split(), END]


def word_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts and, last, an end token for each; and the row of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, row = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    solid = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    words, row = words.filter(solid), row[solid.to_numpy(zero_copy_only=False)]
    return pa.concat_arrays([words, pa.array([END.decode()] * len(texts), words.type)]), np.append(row, np.arange(len(texts)))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for lo, hi in chunks(text_buffers(batch.column("text"))[1], PIECE):
                seen = word_array(batch.column("text").slice(lo, hi - lo))[0].value_counts()
                held.append(pa.table([seen.field(0).cast(pa.binary()), seen.field(1)], names=["token", "n"]))
                rows += len(seen)
                if rows > 2 * FLUSH:
                    held = [merged(held)]
                    rows = len(held[0])
                    if rows > FLUSH:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def group_of(token: bytes, groups: int) -> int:
    return zlib.crc32(token[-ENDING:]) % groups


class Model(NamedTuple):
    """What a task needs.  Symbols are numbered by group; the first of each group
    is its rest."""

    words: bytes  # head tokens, length-prefixed
    counts: np.ndarray  # of the head tokens
    symbols: np.ndarray  # of the head tokens
    starts: np.ndarray  # first symbol of each group, and their number
    contexts: np.ndarray  # (symbols, width)
    places: np.ndarray  # (2, width)
    groups: tuple[np.ndarray, np.ndarray]  # vectors and biases
    members: tuple[np.ndarray, np.ndarray]
    rest: np.ndarray  # log10 of what an add-one count is divided by, for the rest of each group
    tokens: int  # N
    kinds: int  # V
    trained: int = 0  # events that were learned from, each counted once


def head_of(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent tokens that are not too long: all above a count that leaves at most ``most``."""
    level = F.floor(F.log2("n") * 8)
    counts = counts.where(F.length("token") <= LONGEST)
    total, least = 0, math.inf
    for r in sorted(counts.groupBy(level.alias("v")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), reverse=True):
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= least).collect() if least < math.inf else []
    return sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def lay_out(head: list[tuple[bytes, int]], words: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the head tokens, the first symbol of each group, and the counts of modelled symbols (0 for a rest).

    The first ``words`` tokens and the end token are modelled, the others are rests.
    """
    of = np.array([group_of(w, groups) for w, _ in head], np.int64)
    own = np.array([i < words or w == END for i, (w, _) in enumerate(head)], bool)
    size = np.bincount(of[own], minlength=groups) + 1 if len(head) else np.ones(groups, np.int64)
    starts = np.append(0, np.cumsum(size))
    symbols = starts[of] if len(head) else np.zeros(0, np.int64)
    order = np.flatnonzero(own)[np.argsort(of[own], kind="stable")]
    symbols[order] = starts[of[order]] + 1 + np.arange(len(order)) - np.searchsorted(of[order], of[order])
    counts = np.zeros(starts[-1])
    counts[symbols[own]] = np.array([n for _, n in head])[own] if len(head) else 0
    return symbols, starts, counts


def rests(counts: DataFrame, head: list[tuple[bytes, int]], words: int, groups: int) -> np.ndarray:
    """(groups, 2): tokens and kinds of the words of each group that are not modelled."""
    ending = F.expr(f"substring(token, greatest(length(token) - {ENDING - 1}, 1), {ENDING})")
    out = np.zeros((groups, 2))
    for r in counts.groupBy(F.pmod(F.crc32(ending), F.lit(groups)).alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        out[r["g"]] = r["n"], r["k"]
    for i, (w, n) in enumerate(head):
        if i < words or w == END:
            out[group_of(w, groups)] -= n, 1
    return out


def look_up(words: pa.Array, known: pa.Array, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Number of each word among the known ones (beyond them if it is none) and its symbol; the words that are none, and the group of each kind of them."""
    x = pc.index_in(words, known.cast(words.type)).fill_null(len(known)).to_numpy().astype(np.int64)
    out, missing = np.append(symbols, 0)[x], x == len(known)
    tail = words.filter(pa.array(missing)).dictionary_encode()
    ends = pc.binary_slice(tail.dictionary.cast(pa.binary()), -ENDING).dictionary_encode()
    kinds = np.array([group_of(w, len(starts) - 1) for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
    out[missing] = starts[kinds[tail.indices.to_numpy()]]
    return x, out, tail, kinds


def in_order(symbols: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of ``word_array`` text after text, with end tokens at their places, and the tokens of each text."""
    size = np.bincount(row, minlength=n)
    out = np.empty_like(symbols)
    out[np.append(np.arange(len(row) - n) + row[: len(row) - n], np.cumsum(size) - 1)] = symbols
    return out, size


def before(flat: np.ndarray, size: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each, nearest first; a text begins after end tokens."""
    begin = np.cumsum(size) - size
    h1, h2 = np.append(first, flat[:-1]).astype(flat.dtype), np.append([first, first], flat[:-2])[: len(flat)].astype(flat.dtype)
    h1[begin], h2[begin] = first, first
    h2[begin[size > 1] + 1] = first
    return h1, h2


def write_symbols(docs: DataFrame, words: list[bytes], symbols: np.ndarray, starts: np.ndarray, parts: int, text: str = "text") -> DataFrame:
    """(symbols, sizes, part): all texts as numbers, dealt to parts at random, many in a row; and the tokens of each text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((words, symbols, starts))
    kind = symbol_type(starts)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, symbols, starts = sent.value
        known = remembered(("words", id(words)), lambda: pa.array(words, pa.binary()))
        for lo, hi in chunks(text_buffers(batch.column("text"))[1], PIECE):
            found, row = word_array(batch.column("text").slice(lo, hi - lo))
            flat, size = in_order(look_up(found, known, symbols, starts)[1].astype(kind), row, hi - lo)
            piece = zlib.crc32(flat.tobytes())
            to = np.random.default_rng(piece).integers(0, parts, len(size)).astype(np.int32)
            order, ends = np.argsort(to, kind="stable"), np.cumsum(size)
            own, cut = np.unique(to), np.append(0, np.cumsum(np.bincount(to)))
            rows = [order[cut[k]: cut[k + 1]] for k in own]
            out = [[np.concatenate([flat[ends[i] - size[i]: ends[i]] for i in r]).tobytes() for r in rows], [size[r].astype("<i4").tobytes() for r in rows]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in out), pa.array(own, pa.int32()), pa.array([piece] * len(own), pa.int64())],
                                             names=["symbols", "sizes", "part", "piece"])

    coded = map_arrow(docs.select(F.col(text).alias("text")), run, "symbols binary, sizes binary, part int, piece long")
    path = scratch_path(spark, "symbols")
    # in an order of their own, not that in which a shuffle brings them
    coded.repartition(parts, "part").sortWithinPartitions("part", "piece").drop("piece").write.partitionBy("part").parquet(path)
    return spark.read.schema(coded.drop("piece").schema).parquet(path)


def symbol_type(starts: np.ndarray) -> str:
    return "<u2" if starts[-1] <= 1 << 16 else "<u4"


def _gather(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradient rows by index."""
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], _sums(grad.take(order, axis=0), first)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``first`` to the next; two columns at once, as parts of a complex number."""
    return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)


def _logistic(x: np.ndarray) -> np.ndarray:
    """In the place of its argument."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Parameters(NamedTuple):
    """Rows of context vectors, of members, of groups and of the two place weights, each with a bias (0 where there is none)
    and a column of zeros, so that columns are even; and the gradients that each row has seen: mean square of the vector's,
    square of the bias's."""

    x: np.ndarray
    square: np.ndarray


def begin(starts: np.ndarray, weights: np.ndarray, width: int = WIDTH, seed: int = 1) -> Parameters:
    """Random vectors of even width; biases are logarithms of the smoothed counts ``weights``, within groups for members."""
    rng = np.random.default_rng(seed)
    n, groups = len(weights), len(starts) - 1
    heavy = np.add.reduceat(weights, starts[:-1])
    x = rng.normal(0, 0.1, (2 * n + groups + 2, width + 2))
    x[-2:] = 1
    x[:, BIAS:] = 0
    x[n: 2 * n, BIAS] = np.log(weights / np.repeat(heavy, np.diff(starts)))
    x[2 * n: -2, BIAS] = np.log(heavy / heavy.sum())
    return Parameters(x.astype(np.float32), np.full((len(x), 2), 1e-2, np.float32))


class Learner:
    """Parameters that learn from events by noise-contrastive estimation; noise is drawn in proportion to ``weights``."""

    def __init__(self, start: Parameters, starts: np.ndarray, weights: np.ndarray, noise: int = NOISE, seed: int = 1) -> None:
        self.rng, self.starts, self.groups, n = np.random.default_rng(seed), starts, len(starts) - 1, len(weights)
        self.x, self.square = start.x.copy(), start.square.copy()
        cut = (0, n, 2 * n, 2 * n + self.groups, len(self.x))
        self.contexts, self.members, self.tops, self.places = ((self.x[lo:hi], self.square[lo:hi]) for lo, hi in zip(cut, cut[1:], strict=False))
        self.of = np.repeat(np.arange(self.groups), np.diff(starts))
        self.heavy = np.add.reduceat(weights, starts[:-1])
        self.upto = np.cumsum(weights)
        self.p_group = self.heavy / self.heavy.sum()
        self.shared, self.own = min(4 * noise, self.groups), 2 * noise
        self.lift_group = np.log(self.shared * self.p_group).astype(np.float32)
        self.lift_member = np.log(self.own * weights / self.heavy[self.of]).astype(np.float32)
        self.batch = max(BATCH, SHARE * self.groups)

    def descend(self, table: tuple[np.ndarray, np.ndarray], at: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Steps of distinct rows, scaled by the gradients seen so far."""
        x, square = table
        seen = square[at]
        vector, bias = grad[:, :BIAS], grad[:, BIAS]
        seen[:, 0] += np.einsum("ij,ij->i", vector, vector) / vector.shape[1]
        seen[:, 1] += bias * bias
        square[at] = seen
        seen = rate / np.sqrt(seen)
        vector *= seen[:, :1]
        bias *= seen[:, 1]
        x[at] -= grad

    def learn(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, rate: Callable[[float], float], passes: int = 1) -> None:
        """All events in random order; ``rate`` of the share of them that is done."""
        for t in range(passes):
            order = self.rng.permutation(len(w))
            for lo in range(0, len(w), self.batch):
                k = order[lo: lo + self.batch]
                k = k[np.argsort(w[k])]
                self.step(w[k], h1[k], h2[k], rate((t + lo / len(w)) / passes))

    def step(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, rate: float) -> None:
        """Events are in the order of their symbols, so those of a group are neighbours; they share their noise."""
        g, places, tops, members = self.of[w], self.places[0], self.tops[0], self.members[0]
        q, second = self.contexts[0].take(h1, axis=0), self.contexts[0].take(h2, axis=0)
        q *= places[0]
        second *= places[1]
        q += second
        q[:, BIAS] = 1
        # groups: noise shared by the batch
        drawn = self.rng.choice(self.groups, self.shared, p=self.p_group)
        near = tops[drawn]
        bad = q @ near.T
        bad -= self.lift_group[drawn]
        _logistic(bad)
        dq = bad @ near
        d_tops = np.zeros_like(tops)
        np.add.at(d_tops, drawn, bad.T @ q)
        # members: noise of each group, shared by its events; their own group is one row more
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        present = g[first]
        heavy, lo, hi = self.heavy[present][:, None], self.starts[present][:, None], self.starts[present + 1][:, None]
        other = np.searchsorted(self.upto, self.upto[hi - 1] - heavy + self.rng.random((len(present), self.own)) * heavy, side="right")
        other = np.clip(other, lo, hi - 1)
        rows = np.concatenate([members[other], tops[present][:, None]], axis=1)
        lifted, d_rows = rows.copy(), np.empty_like(rows)
        lifted[:, :, BIAS] -= np.column_stack([self.lift_member[other], self.lift_group[present]])
        score, part = np.empty((len(w), self.own + 1), np.float32), second
        cut = [*first.tolist(), len(w)]
        for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
            np.matmul(q[lo:hi], lifted[i].T, out=score[lo:hi])
        _logistic(score)
        score[:, -1] -= 1
        for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
            np.matmul(score[lo:hi].T, q[lo:hi], out=d_rows[i])
            np.matmul(score[lo:hi], rows[i], out=part[lo:hi])
        dq += part
        d_tops[present] += d_rows[:, -1]
        right = members.take(w, axis=0)
        sure = np.einsum("ij,ij->i", q, right)
        sure -= self.lift_member[w]
        sure = (_logistic(sure) - 1)[:, None]
        right *= sure
        dq += right
        dq[:, BIAS] = 0
        q *= sure
        change = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        noise = _gather(other.ravel(), d_rows[:, :-1].reshape(-1, q.shape[1]))
        (at1, d1), (at2, d2) = _gather(h1, dq), _gather(h2, dq)
        d_places = np.stack([np.einsum("ij,ij->j", d, self.contexts[0][at]) for at, d in ((at1, d1), (at2, d2))])
        self.descend(self.contexts, at1, d1 * places[0], rate)
        self.descend(self.contexts, at2, d2 * places[1], rate)
        self.descend(self.members, *_gather(np.append(w[change], noise[0]), np.concatenate([_sums(q, change), noise[1]])), rate)
        self.descend(self.tops, np.arange(self.groups), d_tops, rate)
        self.descend(self.places, np.arange(2), d_places, rate / 10)


def parts_of(p: Parameters, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Context vectors, place weights, group and member (vectors, biases)."""
    n, x = int(starts[-1]), p.x
    return x[:n, :BIAS], x[-2:, :BIAS], (x[2 * n: -2, :BIAS], x[2 * n: -2, BIAS]), (x[n: 2 * n, :BIAS], x[n: 2 * n, BIAS])


def train(events: np.ndarray, starts: np.ndarray, weights: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = STEPS,
          seed: int = 1) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """What all events, held in one process, teach."""
    learner = Learner(begin(starts, weights, width, seed), starts, weights, noise, seed)
    if len(events):
        learner.learn(*events.T, lambda done: RATE * (1 - done), max(1, -(-steps * BATCH // len(events))))
    return parts_of(Parameters(learner.x, learner.square), starts)


def rounds_of(parts: int) -> list[range]:
    """1, 1, 2, 4, ... parts, together all of them."""
    cut = [0, *(1 << i for i in range(parts.bit_length()) if 1 << i < parts), parts]
    return [range(lo, hi) for lo, hi in zip(cut, cut[1:], strict=False)]


def train_parts(coded: DataFrame, starts: np.ndarray, weights: np.ndarray, first: int, tokens: int, parts: int, passes: int) -> tuple[Parameters, int]:
    """What all events of ``write_symbols`` teach, and their number; ``first`` is the symbol of the end token.

    Each part is read in one round only.
    """
    context, rounds, kind = coded.sparkSession.sparkContext, rounds_of(parts), symbol_type(starts)
    now, trained = begin(starts, weights), 0
    for r, chosen in enumerate(rounds):
        sent = context.broadcast((now, starts, weights))

        def rate(done: float, r: int = r) -> float:
            return RATE * max(1 - (r + done) / len(rounds), 0.02)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, rate: Callable[[float], float] = rate) -> Iterator[pa.RecordBatch]:
            enter_stage(TaskContext.get().stageId())
            start, starts, weights = sent.value
            part, learner, seen = TaskContext.get().partitionId(), None, 0
            for flat, size in held(batches):
                learner = learner or Learner(start, starts, weights, seed=part)
                share, done = len(flat) * parts / tokens, seen * parts / tokens
                learner.learn(flat, *before(flat, size, first), lambda x, share=share, done=done: rate(min(done + x * share, 1)), passes)
                seen += len(flat)
            if not learner:
                return
            gain = learner.square - start.square
            for i, lo in enumerate(range(0, len(gain), BLOCK)):
                d, x = gain[lo: lo + BLOCK], learner.x[lo: lo + BLOCK]
                if i == 0 or d.any():
                    data = np.column_stack([x[:, :BIAS] * d[:, :1], x[:, BIAS] * d[:, 1], d]).astype("<f4")
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((i, pa.int32()), (part, pa.int32()), (0 if i else seen, pa.int64()), (data.tobytes(), pa.binary()))],
                                                     names=["block", "part", "n", "data"])

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            have, rows = [], 0
            for batch in batches:
                for a, b in zip(*(batch.column(c) for c in ("symbols", "sizes")), strict=True):
                    have.append((np.frombuffer(a.as_buffer(), kind).astype(np.int32), np.frombuffer(b.as_buffer(), "<i4")))
                    rows += len(have[-1][0])
                    if rows >= HELD:
                        yield tuple(np.concatenate(x) for x in zip(*have, strict=True))
                        have, rows = [], 0
            if have:
                yield tuple(np.concatenate(x) for x in zip(*have, strict=True))

        def merged(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            total = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in table.column("data").combine_chunks())
            return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()), "data": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        chosen_rows = coded.where(F.col("part").between(chosen[0], chosen[-1])).select("symbols", "sizes").coalesce(len(chosen))
        learned = chosen_rows.mapInArrow(run, "block int, part int, n long, data binary").groupBy("block").applyInArrow(merged, "block int, n long, data binary").collect()
        x, square = now.x.copy(), now.square.copy()
        for row in learned:
            trained += row["n"]
            data = np.frombuffer(row["data"], "<f4").reshape(-1, x.shape[1] + 1)
            at, d = slice(row["block"] * BLOCK, row["block"] * BLOCK + len(data)), data[:, -2:]
            for columns, sums, gain in ((slice(BIAS), data[:, :-3], d[:, :1]), (slice(BIAS, -1), data[:, -3:-2], d[:, 1:])):
                np.divide(sums, gain, out=x[at, columns], where=gain > 0)
            square[at] += d
        now = Parameters(x, square)
        sent.destroy()
    return now, trained


def _log_sums(s: np.ndarray, tame: bool = False) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row, which overwrite the scores."""
    top = np.zeros(len(s), s.dtype) if tame else s.max(axis=1)
    if not tame:
        s -= top[:, None]
    np.exp(s, out=s)
    return top + np.log((s @ np.ones(s.shape[1], s.dtype)).astype(np.float64))


def _numbered(x: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``kinds``, and the number of each value among them."""
    seen = np.zeros(kinds, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


class Tables:
    """A model laid out for look-ups."""

    def __init__(self, model: Model) -> None:
        self.model = model  # held, so that its identity stays its own
        words, at = [], 0
        while at < len(model.words):
            n = int.from_bytes(model.words[at: at + 4], "little")
            words.append(model.words[at + 4: at + 4 + n])
            at += 4 + n
        self.words = pa.array(words, pa.binary())
        self.of = np.repeat(np.arange(len(model.starts) - 1), np.diff(model.starts))
        self.first = int(model.symbols[words.index(END)]) if END in words else int(model.starts[group_of(END, len(model.starts) - 1)])
        self.base = np.append(np.log10((model.counts + 1) / (model.tokens + model.kinds + 1)), 0.0)
        rest = np.isin(model.symbols, model.starts[:-1])
        self.within = np.append(np.where(rest, np.log10(model.counts + 1) - model.rest[self.of[model.symbols]], 0.0), 0.0)
        # one column more, so that products hold the bias
        self.before = [np.column_stack([p * model.contexts, np.full(len(model.contexts), 1 - i)]).astype(np.float32) for i, p in enumerate(model.places)]
        self.tops, self.rows = (np.column_stack(x).astype(np.float32) for x in (model.groups, model.members))
        reach = sum(float(np.linalg.norm(x[:, :-1], axis=1).max(initial=0)) for x in self.before)
        self.tame = np.maximum.reduceat(np.linalg.norm(self.rows[:, :-1], axis=1) * reach + np.abs(self.rows[:, -1]), model.starts[:-1]) < TAME

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def group_logs(self, g: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """log P(group | h1, h2)."""
        (u1, i1), (u2, i2) = (_numbered(h, len(self.of)) for h in (h1, h2))
        s1, s2 = self.before[0][u1] @ self.tops.T, self.before[1][u2] @ self.tops.T
        out = s1[i1, g].astype(np.float64) + s2[i2, g]
        top1, top2 = s1.max(axis=1), s2.max(axis=1)
        for s, top in ((s1, top1), (s2, top2)):
            s -= top[:, None]
            np.exp(s, out=s)
        for lo in range(0, len(g), ROWS):
            a, b = i1[lo: lo + ROWS], i2[lo: lo + ROWS]
            z = np.einsum("ij,ij->i", s1[a], s2[b]).astype(np.float64)
            weak = np.flatnonzero(z < WEAK)
            z[weak] = 1
            total = np.log(z) + top1[a] + top2[b]  # 64 bits: a context may come thousands of times
            total[weak] = _log_sums((self.before[0][h1[lo + weak]] + self.before[1][h2[lo + weak]]) @ self.tops.T)
            out[lo: lo + ROWS] -= total
        return out

    def log_probabilities(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """log10 P(w | h1, h2) of symbols: of the group, then of the member within it."""
        m, out = self.model, np.empty(len(w))
        for at in range(0, len(w), TOGETHER):
            part, a1, a2 = (x[at: at + TOGETHER] for x in (w, h1, h2))
            g = self.of[part]
            p = self.group_logs(g, a1, a2)
            order = np.argsort(g.astype(np.uint16), kind="stable")  # few bits: sorted by counting
            cut = np.append(0, np.cumsum(np.bincount(g, minlength=len(m.starts) - 1)))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                own = self.rows[m.starts[i]: m.starts[i + 1]].T
                for lo in range(cut[i], cut[i + 1], ROWS):
                    k = order[lo: min(lo + ROWS, cut[i + 1])]
                    s = (self.before[0][a1[k]] + self.before[1][a2[k]]) @ own
                    p[k] += s[np.arange(len(k)), part[k] - m.starts[i]]
                    p[k] -= _log_sums(s, self.tame[i])
            out[at: at + TOGETHER] = p / math.log(10)
        return out


_tables: dict[int, Tables] = {}


def _tables_of(sent: Broadcast) -> Tables:
    if id(sent.value) not in _tables:
        _tables.clear()
        _tables[id(sent.value)] = Tables(sent.value)
    return _tables[id(sent.value)]


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the table of token counts."""
    counts = keep(token_counts(docs, text), "token-counts")
    tokens, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens = int(tokens or 0)
    head = head_of(counts)
    words, groups = int(WORDS * math.sqrt(tokens)), max(4, round(GROUPS * tokens**0.25))
    symbols, starts, seen = lay_out(head, words, groups)
    rest = rests(counts, head, words, groups)
    seen[starts[:-1]] = rest[:, 0] + 1
    known = [w for w, _ in head]
    learned, trained = begin(starts, seen), 0
    if tokens:
        # a corpus of few events is one part, which is learned again and again
        passes = -(-STEPS * BATCH // tokens)
        parts = 1 if passes > 1 else max(1, round(math.sqrt(tokens) / PART))
        first = int(symbols[known.index(END)] if END in known else starts[group_of(END, groups)])
        learned, trained = train_parts(write_symbols(docs, known, symbols, starts, parts, text), starts, seen, first, tokens, parts, passes)
    packed = b"".join(len(w).to_bytes(4, "little") + w for w in known)
    return Model(packed, np.array([k for _, k in head], np.float64), symbols, starts, *parts_of(learned, starts),
                 np.log10(rest[:, 0] + rest[:, 1] + 1), tokens, kinds, trained), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text", flag: str = "held_out") -> DataFrame:
    """(doc_id, flag, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    A null or empty text is its end token.  Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(text_buffers(batch.column("text"))[1], PIECE):
            yield scored(batch.slice(lo, hi - lo))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = _tables_of(sent)
        uid, n = batch.column("_uid").to_numpy(), batch.num_rows
        words, row = word_array(batch.column("text"))
        x, symbols, tail, kinds = look_up(words, t.words, t.model.symbols, t.model.starts)
        # words that tasks do not know: one row for each of a text
        missing, code = x == len(t.words), tail.indices.to_numpy().astype(np.int64)
        pairs, tail_n = np.unique(row[missing] * max(len(kinds), 1) + code, return_counts=True)
        tail_row, tail_word = pairs // max(len(kinds), 1), pairs % max(len(kinds), 1)
        tail_uid, tail_rest = uid[tail_row], t.model.rest[kinds[tail_word]]
        # all texts of a batch are scored together, end tokens at their places
        flat, size = in_order(symbols, row, n)
        h1, h2 = before(flat, size, t.first)
        sums = [size, size - np.bincount(row[missing], minlength=n), np.bincount(row, t.base[x], n),
                np.bincount(row, t.within[x], n) + np.bincount(np.repeat(np.arange(n), size), t.log_probabilities(flat, h1, h2), n)]
        # the row of a text itself has a token that no word equals, so these rows spread over all tasks
        own = pa.array([b"\n" + u.to_bytes(8, "little") for u in uid.tolist()], pa.binary())
        none = lambda kind: pa.nulls(len(pairs), kind)
        cols = {
            "_uid": pa.array(np.append(uid, tail_uid)), "token": pa.concat_arrays([own, tail.dictionary.cast(pa.binary()).take(pa.array(tail_word))]),
            "n": pa.array(np.append(np.zeros(n, np.int64), tail_n)), "rest": pa.array(np.append(np.zeros(n), tail_rest)),
            "doc_id": pa.concat_arrays([batch.column("doc_id"), none(batch.column("doc_id").type)]),
            "flag": pa.concat_arrays([batch.column("flag"), none(pa.bool_())]),
        }
        for name, v, kind in zip(("n_tokens", "n_known", "base", "score"), sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True):
            cols[name] = pa.concat_arrays([pa.array(v, kind), none(kind)])
        return pa.RecordBatch.from_pydict(cols)

    slim = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), F.col(flag).alias("flag"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(slim, run, f"_uid long, token binary, n long, rest double, doc_id {id_type}, flag boolean, n_tokens long, n_known long, base double, score double")
    c = F.coalesce(F.col("c"), F.lit(0))
    met = rows.join(counts.withColumnRenamed("n", "c"), "token", "left").select(
        "_uid", "doc_id", "flag", "n_tokens", F.coalesce("n_known", F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.coalesce("base", F.col("n") * F.log10((c + 1) / F.lit(float(model.tokens + model.kinds + 1)))).alias("base"),
        F.coalesce("score", F.col("n") * (F.log10(c + 1) - F.col("rest"))).alias("score"))
    return met.groupBy("_uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("flag").alias(flag), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("_uid")


def score_documents(docs: DataFrame, held_out: F.Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the rows that are not held out and score all rows.  An empty table gives no rows."""
    marked = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model, counts = fit(marked.where("NOT held_out"), text)
    return score(marked, model, counts, doc_id, text)
