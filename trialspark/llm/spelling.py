"""Spelling variants: words one edit apart, grouped under their most frequent form.

Method: a sorted list of words is scanned with a banded edit matrix.  Words that
follow each other share a prefix, and so the rows of the matrix up to it: a row
is computed once for a range of words with a common prefix and handed to the
ranges of the next character, which begin where the longest common prefix of two
neighbours is short.  A range whose row exceeds one edit is skipped as a whole.

Distribution: two words one edit apart first differ at some place.  Places are
cut into intervals; the words of a block share all that lies before the interval
and behind it (counted from the end), so a pair meets in exactly one block.  A
block beyond ``CROWD`` words is cut at the middle of its interval, down to one
place, where a block holds no more words than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import keep, map_arrow
from trialspark.llm.pieces import ranges

#: Words of a block beyond which its interval is cut.
CROWD = 200_000
#: Pairs of a word and a word of its block that are held at once (or one word's); bounds the memory of a task.
TOGETHER = 1 << 20
#: Distinct words counted before they go on.
HELD = 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")
_SCHEMA = "word string, near long, best_n long, best string"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, every: int = 97) -> DataFrame:
    """(word, n): counted runs of Latin letters of whole texts, ASCII case folded, one row per word and batch.

    Where the CRC of ``<doc_id>:<run>`` is divisible by ``every``, the run loses
    the code point at CRC modulo its length.  A null id counts as empty text.
    """
    slim = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")

    def table(counts: Counter) -> pa.RecordBatch:
        words = [w for w in counts if len(w) >= least]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        crc = zlib.crc32
        for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            base = crc(f"{d.as_py()}:".encode())
            for w, n in Counter(_RUN.findall(t.as_py().encode().lower().decode())).items():
                h = crc(w.encode(), base)
                if h % every == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                counts[w] += n
            if len(counts) > HELD:
                yield table(counts)
                counts.clear()
        yield table(counts)

    return map_arrow(slim, run, "word string, n long")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur ``times`` times or more in all texts."""
    return (runs(docs, doc_id, text, least, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times))


def _char(flat: np.ndarray, off: np.ndarray, word: np.ndarray, at: np.ndarray, void: int) -> np.ndarray:
    """The code point at each place of a word, ``void`` outside; ``flat`` holds one code point more than the words."""
    inside = (at >= 0) & (at < off[word + 1] - off[word])
    return np.where(inside, flat[np.where(inside, off[word] + at, 0)], void)


def common_prefixes(flat: np.ndarray, off: np.ndarray, begin: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Code points that a word shares with the one before it in its block, beyond the block's own; -1 for the first."""
    n, padded = len(off) - 1, np.append(flat, 0)
    common = np.full(n, -1, np.int64)
    pair = np.flatnonzero(np.arange(n) > begin)
    depth = 0
    while len(pair):
        common[pair] = depth
        at = lo[pair] + depth
        pair = pair[_char(padded, off, pair, at, -1) == _char(padded, off, pair - 1, at, -2)]
        depth += 1
    return common


def near_pairs(flat: np.ndarray, off: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, ask: np.ndarray,
               common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): words j of the block of word i that are one edit from it, for each i in ``ask``.

    Words are code points ``flat[off[i]: off[i + 1]]``, sorted within their block
    [``begin``, ``end``); those of a block share their first ``lo`` code points.
    """
    length = np.diff(off)
    padded = np.append(flat, 0)
    if common is None:
        common = common_prefixes(flat, off, begin, lo)

    def char(word: np.ndarray, at: np.ndarray, void: int) -> np.ndarray:
        return _char(padded, off, word, at, void)

    q, a, b = ask, begin[ask], end[ask]
    d0 = lo[q]
    row = np.stack([np.where(d0 > 0, 1, 2), np.zeros(len(q), np.int64), np.where(d0 + 1 <= length[q], 1, 2)])
    out_q, out_x = [], []
    step = 0
    while len(q):
        depth = lo[q] + step
        k = length[q] - depth
        near = (length[a] == depth) & (np.abs(k) <= 1) & (row[np.clip(k, -1, 1) + 1, np.arange(len(q))] == 1)
        out_q.append(q[near])
        out_x.append(a[near])
        # ranges of the next character
        size = b - a
        spot = ranges(a, size)
        of = np.repeat(np.arange(len(q)), size)
        opens = (common[spot] <= step) | (spot == a[of])
        start, of = spot[opens], of[opens]
        stop = np.append(start[1:], 0)
        last = np.append(of[1:] != of[:-1], True)
        stop[last] = b[of[last]]
        live = length[start] > depth[of]
        start, stop, of = start[live], stop[live], of[live]
        who, depth, row = q[of], depth[of], row[:, of]
        c = padded[off[start] + depth]
        m0 = np.minimum(row[1] + 1, row[0] + (c != char(who, depth - 1, -1)))
        m0[depth > length[who]] = 2
        m1 = np.minimum(np.minimum(row[2], m0) + 1, row[1] + (c != char(who, depth, -1)))
        m1[depth + 1 > length[who]] = 2
        m2 = np.minimum(m1 + 1, row[2] + (c != char(who, depth + 1, -1)))
        m2[depth + 2 > length[who]] = 2
        row = np.minimum(np.stack([m0, m1, m2]), 2)
        on = row.min(axis=0) <= 1
        q, a, b, row = who[on], start[on], stop[on], row[:, on]
        step += 1
    return np.concatenate(out_q), np.concatenate(out_x)


def shares(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of at most ``most`` work together, or one larger item."""
    upto, lo = np.cumsum(work), 0
    while lo < len(work):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _first_difference(flat: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of the first difference of two words; words one edit apart only, -1 for others."""
    size = np.minimum(off[x + 1] - off[x], off[y + 1] - off[y])
    out = size.copy()
    of = np.repeat(np.arange(len(x)), size)
    at = ranges(np.zeros(len(x), np.int64), size)
    differ = flat[off[x][of] + at] != flat[off[y][of] + at]
    np.minimum.at(out, of[differ], at[differ])
    # behind the edit both words must agree
    lx, ly = off[x + 1] - off[x], off[y + 1] - off[y]
    tail = np.maximum(lx, ly) - out - 1
    of = np.repeat(np.arange(len(x)), tail)
    back = ranges(np.ones(len(x), np.int64), tail)
    wrong = np.zeros(len(x), bool)
    wrong[of[flat[off[x + 1][of] - back] != flat[off[y + 1][of] - back]]] = True
    return np.where(wrong, -1, out)


def _scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of the words of sorted blocks (m, lo, hi, h): one row per word that has some in its block."""
    held: pa.Table | None = None
    names = ("m", "lo", "hi", "h")

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m, lo, hi, h, n = (t.column(c).to_numpy() for c in (*names, "n"))
        opens = np.append(True, np.any([x[1:] != x[:-1] for x in (m, lo, hi, h)], axis=0))
        block = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        begin, end = first[block], np.append(first[1:], len(m))[block]
        words = t.column("word").to_pylist()
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        off = np.append(0, np.cumsum([len(w) for w in words]))
        length = np.diff(off)
        asking = np.flatnonzero(end - begin > 1)
        common = common_prefixes(flat, off, begin, lo)
        for i, j in shares((end - begin)[asking], TOGETHER):
            # words of the blocks asked alone, so that a share costs no more than its blocks
            a, b = int(begin[asking[i]]), int(end[asking[j - 1]])
            q, x = near_pairs(flat[off[a]: off[b]], off[a: b + 1] - off[a], begin[a:b] - a, end[a:b] - a, lo[a:b], asking[i:j] - a, common[a:b])
            q, x = q + a, x + a
            place = _first_difference(flat, off, q, x)
            mine = (np.minimum(length[q], length[x]) == m[q]) & (place >= lo[q]) & (place < hi[q])
            q, x = q[mine], x[mine]
            if len(q):
                order = np.lexsort((x, -n[x], q))  # words of a block are in order, so x stands for the word
                q, x = q[order], x[order]
                top = np.append(True, q[1:] != q[:-1])
                counts = np.diff(np.append(np.flatnonzero(top), len(q)))
                who, best = q[top].tolist(), x[top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([words[j] for j in who]), pa.array(counts), pa.array(n[best]), pa.array([words[j] for j in best])],
                                                 names=["word", "near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        differ = np.any([(x := t.column(c).to_numpy()) != x[-1] for c in names], axis=0)
        cut = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
        held = t.slice(cut).combine_chunks()
        if cut:
            yield from search(t.slice(0, cut).combine_chunks())
    if held is not None:
        yield from search(held)


def neighbours(words: DataFrame, least: int = 5, crowd: int = CROWD) -> DataFrame:
    """(word, near, best_n, best): how many words are one edit away, and the most frequent of them (ties: the smallest).

    ``words`` holds distinct words with ``n``; those without a neighbour have no row.
    """
    half = F.expr("CAST((m + 1) DIV 2 AS INT)")
    side = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    rows = (words.select("word", "n", F.explode(F.expr("array(length(word) - 1, length(word))")).alias("m")).where(F.col("m") >= least)
            .select("word", "n", "m", F.explode(side).alias("i")).select("word", "n", "m", "i.lo", "i.hi"))
    shared = F.xxhash64(F.expr("substring(word, 1, lo)"), F.expr("right(word, greatest(m - hi, 0))"))
    block = ["m", "lo", "hi", "h"]
    done: list[DataFrame] = []
    while True:
        rows = rows.withColumn("h", shared)
        crowds = keep(rows.where("hi - lo > 1").groupBy(*block).count().where(F.col("count") > crowd).drop("count"), "crowds")
        if crowds.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(crowds, block, "left_anti").select("word", "n", *block))
        middle = F.expr("CAST((lo + hi) DIV 2 AS INT)")
        cut = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        rows = keep(rows.join(crowds, block, "left_semi").select("word", "n", "m", F.explode(cut).alias("i")).select("word", "n", "m", "i.lo", "i.hi"), "cut-blocks")
    every = done[0].select("word", "n", *block)
    for other in done[1:]:
        every = every.unionByName(other.select("word", "n", *block))
    found = every.repartition(*block).sortWithinPartitions(*block, "word").mapInArrow(_scan_blocks, _SCHEMA)
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("near").alias("near"), top.alias("top"))
            .select("word", "near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from each word that has one.

    ``forms`` has (word, form).  Each round takes every word twice as far, so
    chains end after a logarithm of their length; rounds are written.
    """
    reached = keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, times: int = 3, every: int = 97, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of the vocabulary.

    A word's form is its most frequent neighbour (ties: the smallest in code-point
    order) if that occurs at least twice as often; the root is the last form.
    Null texts hold no words; repeated rows count each; other columns are not
    read.  A word without neighbours has no form and is its own root.
    """
    words = keep(vocabulary(docs, doc_id, text, least, times, every), "vocabulary")
    near = (words.join(neighbours(words, least, crowd), "word", "left")
            .withColumn("form", F.expr("CASE WHEN best_n >= 2 * n THEN best END")))
    near = keep(near, "neighbours")
    last = roots(near.where("form IS NOT NULL"))
    return near.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))
