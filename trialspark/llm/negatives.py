"""Hard negatives: rows of another label whose score lies in a window below a positive's.

Method: the anchors of a block form a minimum spanning tree.  At the root all
candidates are scored.  Along an edge a score can change by at most the edge's
length times the candidate's norm, so the parent's scores, or bounds, give
bounds at the child; only candidates whose bounds overlap what the child still
looks for are scored again, and the others hand their wider bounds on.

Scores are whole numbers: components are scaled and rounded down first.  Blocks
of anchors meet blocks of rows, and only the best of each meeting go on, so that
no task holds more than two blocks.  Two passes: positives, then negatives in
the windows that the positives set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialspark.llm.common import keep, parts

BLOCK = 8192
ANCHOR_BLOCK = 512

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Parent of each vector (-1 for the root), length of the edge to it, and an order that begins at the root and ends each branch before the next."""
    n = len(a)
    parent, edge = np.full(n, -1), np.zeros(n)
    square = (a * a).sum(axis=1)
    root = int(np.argmin(((a - a.mean(axis=0)) ** 2).sum(axis=1)))
    away, nearest = np.full(n, np.inf), np.full(n, root)
    inside = np.zeros(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    at = root
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(square + square[at] - 2 * (a @ a[at]), 0)
        nearer = d < away
        away[nearer], nearest[nearer] = d[nearer], at
        away[inside] = np.inf
        at = int(np.argmin(away))
        parent[at] = nearest[at]
        children[nearest[at]].append(at)
        edge[at] = np.sqrt(((a[at] - a[parent[at]]) ** 2).sum())
    order, stack = [], [root]
    while stack:
        order.append(stack.pop())
        stack += children[order[-1]]
    return parent, edge, order


def walk(a: np.ndarray, x: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor: its index, the rows of ``x`` scored at it, and their scores.

    ``wanted(i, low, high)`` tells from bounds on all scores which are needed.
    """
    parent, edge, order = spanning_tree(a)
    left = np.bincount(parent[parent >= 0], minlength=len(a))
    norms = np.sqrt((x * x).sum(axis=1))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in order:
        p = int(parent[i])
        if p < 0:
            low = x @ a[i]
            high = low.copy()
            ask = np.flatnonzero(wanted(i, low, high))
        else:
            # one unit and a small part more than the bound, against rounding
            reach = edge[i] * norms * (1 + 1e-9) + 1
            low, high = bounds[p][0] - reach, bounds[p][1] + reach
            left[p] -= 1
            if not left[p]:
                del bounds[p]
            ask = np.flatnonzero(wanted(i, low, high))
            low[ask] = high[ask] = (x if len(ask) == len(x) else x[ask]) @ a[i]
        if left[i]:
            bounds[i] = (low, high)
        yield i, ask, low[ask]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.flatnonzero(score >= _kth(score, k))
    near = near[np.lexsort((ids[near], -score[near]))[:k]]
    return ids[near], score[near]


def _vectors(t: pa.Table) -> np.ndarray:
    """Whole components as doubles; scores of them are whole and exact."""
    v = np.array(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    if len(v) and float((v * v).sum(axis=1).max()) >= 2.0**53:
        raise ValueError("scores beyond 2^53 are not exact: use a smaller scale")
    return v


def mine(vectors: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``.  A score is the inner product of
    vectors whose components are floor(``scale`` * x).  An anchor's positives are
    the ``positives`` other rows of its label with the highest score; negatives
    of a positive are the first ``negatives`` rows of other labels whose score is
    from ``low`` to ``high`` hundredths of the positive's.  Higher scores come
    first, ties by smaller id.

    Rows with a null id, label or vector, an empty vector, one of another length
    than most, or a null or non-finite component take no part.  An id given more
    than once counts once, with its smallest label and vector.  Other columns
    are not read.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = ("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    rows = keep(raw.where(sound).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", F.col("m.v").alias("v")).withColumn("v", whole), "vectors")
    dims = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    if not dims:
        return spark.createDataFrame([], _RESULT)
    rows = rows.where(F.size("v") == dims[0])
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blocks, anchor_blocks = parts(n, block, 1), parts(n_anchors, anchor_block, 1)

    def spread(df: DataFrame, mine: str, of: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    held = spread(rows, "b", blocks, "ab", anchor_blocks)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def table(out: list[list], names: tuple[str, ...]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds, strict=False)], names=list(names))

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
            x, a = _vectors(left), _vectors(right)
            ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
            own, own_label = right.column("vec_id").to_numpy(), right.column("label").to_numpy()

            def wanted(i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                same = (labels == own_label[i]) & (ids != own[i])
                return same & (hi >= _kth(lo[same], positives))

            for i, ask, score in walk(a, x, wanted):
                near, score = _best(ids[ask], score, positives)
                out[0].append(np.full(len(near), own[i]))
                out[1].append(near)
                out[2].append(score.astype(np.int64))
        return table(out, ("anchor_id", "positive_id", "positive_score"))

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
            x, a = _vectors(left), _vectors(right)
            ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
            own, own_label = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
            found = right.column("found").to_pylist()
            # a window of whole scores for each positive; below zero there is none
            windows = [[(f["positive_id"], f["positive_score"], -(-low * f["positive_score"] // 100), high * f["positive_score"] // 100) for f in fs] for fs in found]

            def wanted(i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                other, ask = labels != own_label[i], np.zeros(len(lo), bool)
                for begin, end in {w[2:] for w in windows[i]}:
                    if begin <= end:
                        sure = other & (lo >= begin) & (hi <= end)
                        ask |= other & (lo <= end) & (hi >= max(begin, _kth(lo[sure], negatives)))
                return ask

            for i, ask, score in walk(a, x, wanted):
                for positive, at, begin, end in windows[i]:
                    inside = (score >= begin) & (score <= end)
                    near, s = _best(ids[ask[inside]], score[inside], negatives)
                    for o, v in zip(out, (np.full(len(near), own[i]), np.full(len(near), positive), np.full(len(near), at), near, s.astype(np.int64)), strict=True):
                        o.append(v)
        return table(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    anchors = rows.where(is_anchor)
    met = held.groupBy("b", "ab").cogroup(spread(anchors, "ab", anchor_blocks, "b", blocks).groupBy("b", "ab")).applyInArrow(
        positives_of, "anchor_id long, positive_id long, positive_score long")
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = (met.withColumn("r", order).where(F.col("r") <= positives)
              .groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found")))
    asking = keep(anchors.join(chosen, anchors["vec_id"] == chosen["anchor_id"]).select("vec_id", "label", "v", "found"), "anchors")
    met = held.groupBy("b", "ab").cogroup(spread(asking, "ab", anchor_blocks, "b", blocks).groupBy("b", "ab")).applyInArrow(
        negatives_of, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", order).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
