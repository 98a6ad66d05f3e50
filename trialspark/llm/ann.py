"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Method: vectors get one more component that brings them to one norm, so that a larger inner product is a smaller Euclidean distance.
``TABLES`` tables of ``HASHES`` functions floor((a.x + b) / WIDTH), a Gaussian,
index every vector.  A query visits, in each table, its own bucket and
perturbed ones in the order of their estimated success: the template of
perturbation sets over the sorted distances to the bucket's sides is made once
from their expected squares.  It goes on until the buckets hold, for a vector at
the distance of the block's k-th neighbours, so much probability that all tables
together find it with probability ``TARGET``.  Vectors stand sorted by bucket, so
a hit is a slice.  Candidates of all tables are merged and reranked by the exact
inner product in double precision.

Vectors of a block are indexed in ranges of norm, each lifted to its own longest
vector, so that a long vector does not squeeze the others together.  A query that
finds fewer candidates of a range than a result holds scans the range.

Vectors are indexed in blocks of ``BLOCK``; query blocks meet vector blocks, and
only the best of each meeting go on.  Equal vectors are indexed once, with as
many of their smallest ids as a result can hold, so copies make no hot bucket.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialspark.llm.common import keep, parts
from trialspark.llm.pieces import ranges

TABLES = 8
HASHES = 8
WIDTH = 2.5
#: Buckets of a table that a query visits at most; reached only if the estimate stays low.
PROBES = 1024
TARGET = 0.96
#: Buckets whose probability is worked out first; four times as many where they do not reach the target.
FIRST = 48
#: Queries of a block whose k-th neighbours are measured.
MEASURED = 64
#: Queries reranked at once.
TOGETHER = 256
#: Largest ratio of norms within a range.
SPREAD = 1.25
BLOCK = 8192
QUERY_BLOCK = 4096


def templates(hashes: int, probes: int) -> np.ndarray:
    """Perturbation sets in the order of their expected score.

    Row r holds indexes into the 2 * hashes sorted side distances, filled up
    with 2 * hashes.  Index j and 2 * hashes - 1 - j are the two sides of one
    function, so no set holds both.
    """
    m = hashes
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    high = 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) * (2 * m + 2 - np.arange(m + 1, 2 * m + 1)) / (4 * (m + 1) * (m + 2))
    cost = np.append(low, high)
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if not any(2 * m - 1 - i in s for i in s):
            out.append(s)
        k = s[-1]
        if k + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[k] + cost[k + 1], (*s[:-1], k + 1)))
            heapq.heappush(heap, (score + cost[k + 1], (*s, k + 1)))
    wide = max(map(len, out), default=0) or 1
    return np.array([[*s, *[2 * m] * (wide - len(s))] for s in out], np.int64)


class Hashes:
    """The hash functions of all tables, the same in every task."""

    def __init__(self, dims: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.width = tables, hashes, width
        self.a = rng.normal(size=(dims, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.mix = rng.integers(1, 2**62, hashes, dtype=np.int64) * 2 + 1
        self.sets = templates(hashes, probes)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.m)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table, as one number."""
        return (np.floor(self.cells(x)).astype(np.int64) * self.mix).sum(axis=2)

    def probes(self, x: np.ndarray, table: int, near: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` buckets that each vector visits in a table, likeliest
        first, and the probability with which each holds a vector at distance ``near``."""
        sets = self.sets[:most]
        cell = self.cells(x)[:, table]
        floor = np.floor(cell)
        place = cell - floor
        side = np.concatenate([place, 1 - place], axis=1)
        order = np.argsort(side, axis=1, kind="stable")
        moves = np.zeros((len(x), 2 * self.m + 1), np.int64)
        moves[:, :-1] = np.concatenate([-self.mix, self.mix])[order]
        home = (floor.astype(np.int64) * self.mix).sum(axis=1)
        scale = self.width / max(near, 1e-9)
        stay = np.maximum(_below((1 - place) * scale) - _below(-place * scale), 1e-300)
        down = _below(-place * scale) - _below((-1 - place) * scale)
        up = _below((2 - place) * scale) - _below((1 - place) * scale)
        gain = np.zeros((len(x), 2 * self.m + 1))
        gain[:, :-1] = np.take_along_axis(np.log(np.maximum(np.concatenate([down / stay, up / stay], axis=1), 1e-300)), order, axis=1)
        chance = np.exp(np.log(stay).sum(axis=1)[:, None] + gain[:, sets].sum(axis=2))
        return home[:, None] + moves[:, sets].sum(axis=2), chance


_STEPS = np.linspace(-8, 8, 4097)
_NORMAL = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _STEPS])


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, interpolated; an estimate needs no more."""
    return np.interp(z, _STEPS, _NORMAL)


def norm_ranges(norms: np.ndarray) -> list[np.ndarray]:
    """Rows by norm, in ranges that begin at each range's longest vector and span a ratio of ``SPREAD``."""
    order, out, at = np.argsort(-norms, kind="stable"), [], 0
    while at < len(order):
        end = at + int(np.searchsorted(-norms[order[at:]], -norms[order[at]] / SPREAD, side="right"))
        out.append(order[at:end])
        at = end
    return out


def search_block(h: Hashes, x: np.ndarray, q: np.ndarray, k: int, target: float = TARGET) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its index, and the k best candidates of a block with their inner products."""
    norms = np.sqrt((x * x).sum(axis=1))
    ask = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
    need = 1 - (1 - target) ** (1 / h.tables)
    small: list[np.ndarray] = []
    # hits of a range and table: queries, and slices of the rows sorted by bucket
    found: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]] = []
    for rows in norm_ranges(norms):
        if len(rows) <= k:
            small.append(rows)
            continue
        unit = x[rows] / (norms[rows[0]] or 1.0)
        lifted = np.column_stack([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))])
        sample = ask[:: max(1, len(ask) // MEASURED)]
        kth = np.partition(sample @ lifted.T, len(rows) - k, axis=1)[:, len(rows) - k]
        near = math.sqrt(max(0.0, 2 - 2 * float(np.median(kth))))
        keys, tables = h.keys(lifted), []
        for t in range(h.tables):
            order = np.argsort(keys[:, t], kind="stable")
            buckets, begin = np.unique(keys[order, t], return_index=True)
            end = np.append(begin[1:], len(order))
            hits, most, left = [], FIRST, np.arange(len(ask))
            while len(left):
                want, chance = h.probes(ask[left], t, near, most)
                before = np.cumsum(chance, axis=1) - chance
                over = (before[:, -1] + chance[:, -1] >= need) | (most >= len(h.sets))
                want, before, those = want[over], before[over], left[over]
                at = np.minimum(np.searchsorted(buckets, want), len(buckets) - 1)
                who, probe = np.nonzero((buckets[at] == want) & (before < need))
                hits.append((those[who], at[who, probe]))
                left, most = left[~over], most * 4
            who, at = (np.concatenate(x) for x in zip(*hits, strict=True))
            turn = np.argsort(who, kind="stable")
            tables.append((who[turn], begin[at[turn]], end[at[turn]], rows[order]))
        found.append((rows, tables))
    rough, rough_q = (x / (norms.max() or 1.0)).astype(np.float32), ask[:, :-1].astype(np.float32)
    for lo in range(0, len(q), TOGETHER):
        n = min(TOGETHER, len(q) - lo)
        seen = np.zeros((n, len(x)), bool)
        for rows in small:
            seen[:, rows] = True
        for rows, tables in found:
            for who, begin, end, sorted_rows in tables:
                a, b = np.searchsorted(who, (lo, lo + n))
                size = end[a:b] - begin[a:b]
                seen[np.repeat(who[a:b] - lo, size), sorted_rows[ranges(begin[a:b], size)]] = True
            few = np.flatnonzero(seen[:, rows].sum(axis=1) < k)
            seen[np.ix_(few, rows)] = True
        s = np.where(seen, rough_q[lo: lo + n] @ rough.T, -np.inf)
        keep = min(k, len(x))
        least = np.partition(s, len(x) - keep, axis=1)[:, len(x) - keep]
        who, col = np.nonzero(seen & (s >= least[:, None] - 1e-4))
        exact = (x[col] * q[lo + who]).sum(axis=1)
        order = np.lexsort((col, -exact, who))
        who, col, exact = who[order], col[order], exact[order]
        cut = np.searchsorted(who, np.arange(n + 1))
        for i in range(n):
            yield lo + i, col[cut[i]: cut[i + 1]][:k], exact[cut[i]: cut[i + 1]][:k]


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK,
            query_block: int = QUERY_BLOCK, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``.  Rows with a null id, and vectors
    that are null, empty, zero, of another length than most, or hold null or
    non-finite components take no part.  An id given more than once counts
    once, with its smallest vector.  Other columns are not read.
    """
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = ("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
             " AND exists(v, x -> x <> 0)")
    rows = keep(raw.where(sound).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    dims = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims[0])
    h = Hashes(dims[0] + 1, tables, hashes, width, probes)

    # equal vectors: one entry with its smallest ids (one more than a result holds, as a query leaves out itself)
    few = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.withColumn("r", few).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).groupBy("v").agg(F.count(F.lit(1)).alias("asks"))
    entries = keep(ids.join(asked, "v", "left").select(F.col("ids")[0].alias("rep"), "ids", "v", "asks"), "distinct-vectors")
    n, n_asked = entries.agg(F.count(F.lit(1)), F.count("asks")).first()
    blocks, query_blocks = parts(n, block, 1), parts(n_asked, query_block, 1)

    def spread(df: DataFrame, mine: str, of: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64("rep"), F.lit(of)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    held = spread(entries.select("rep", "ids", "v"), "b", blocks, "qb", query_blocks)
    asks = spread(entries.where("asks > 0").select(F.col("rep"), F.col("v")), "qb", query_blocks, "b", blocks)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            held, asks = left.sort_by("rep"), right.sort_by("rep")
            x, q = (np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (held, asks))
            reps, lists, ask = held.column("rep").to_pylist(), held.column("ids").to_pylist(), asks.column("rep").to_pylist()
            for i, near, score in search_block(h, x, q, k + 1):
                for j, s in zip(near.tolist(), score.tolist(), strict=True):
                    for o, v in zip(out, (ask[i], reps[j], s, lists[j]), strict=True):
                        o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["asker", "rep", "score", "ids"])

    met = held.groupBy("b", "qb").cogroup(asks.groupBy("b", "qb")).applyInArrow(meet, "asker long, rep long, score double, ids array<long>")
    order = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "rep"))
    best = (met.withColumn("r", order).where(F.col("r") <= k + 1)
            .groupBy("asker").agg(F.collect_list(F.struct((-F.col("score")).alias("away"), "ids")).alias("found"))
            .select("asker", F.expr(f"slice(array_sort(flatten(transform(found, f -> transform(f.ids, i -> named_struct('away', f.away, 'vec_id', i))))), 1, {k + 1})").alias("found")))
    askers = rows.where(is_query).join(entries.where("asks > 0").select("v", F.col("rep").alias("asker")), "v").select(F.col("vec_id").alias("query_id"), "asker")
    return (askers.join(best, "asker")
            .select("query_id", F.posexplode(F.expr(f"slice(filter(found, f -> f.vec_id <> query_id), 1, {k})")).alias("pos", "f"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.away")).alias("score")))
