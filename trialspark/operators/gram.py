"""Centred cross products of many columns in one pass.

Generated aggregates for k columns are k (k + 1) / 2 expressions, which pass the
limit of generated code near k = 40.  Here a task multiplies each Arrow batch
with itself and keeps, per group, the row count, the means and the centred
cross products; such blocks merge pairwise, exactly as partial aggregates of a
covariance do, first within sixteen parts and then over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 16
#: Groups whose blocks a task holds before it passes them on.
HELD = 512

Block = tuple[int, np.ndarray, np.ndarray]


def merge(a: Block, b: Block) -> Block:
    """Count, means and centred cross products of two disjoint blocks."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def block_of(x: np.ndarray) -> Block:
    mean = x.mean(axis=0)
    x = x - mean
    return len(x), mean, x.T @ x


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns of doubles side by side; a missing value is NaN."""
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def gram(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _n, _mean, _cross): one row per group; ``_cross`` holds the upper
    triangle of the centred cross products row by row.

    A row with a missing value in ``columns`` does not count; tasks leave it out,
    so that the scan computes each column once.
    """
    k = len(columns)
    upper = np.triu_indices(k)
    names = [f"_k{i}" for i in range(len(keys))]
    slim = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)],
                       *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    key_fields = [T.StructField(n, slim.schema[n].dataType) for n in names]
    vec = T.ArrayType(T.DoubleType())
    schema = T.StructType([*key_fields, T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_mean", vec), T.StructField("_cross", vec)])

    def table(found: list[tuple[list[pa.Scalar], Block]], part: int, key_types: list[pa.DataType]) -> pa.RecordBatch:
        cols = [pa.array([key[i].as_py() for key, _ in found], t) for i, t in enumerate(key_types)]
        lists = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array([part] * len(found), pa.int32()), pa.array([b[0] for _, b in found], pa.int64()),
             pa.array([b[1] for _, b in found], lists), pa.array([b[2][upper] for _, b in found], lists)], names=[*names, "_part", "_n", "_mean", "_cross"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        held: dict[tuple, tuple[list[pa.Scalar], Block]] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            x = matrix(batch, [f"_x{i}" for i in range(k)])
            whole = ~np.isnan(x).any(axis=1)
            if not whole.any():
                continue
            if not whole.all():
                x, batch = x[whole], batch.filter(pa.array(whole))
            types = [batch.column(n).type for n in names]
            code = np.zeros(len(x), np.int64)
            for n in names:
                index = pc.dictionary_encode(batch.column(n), null_encoding="encode").indices.to_numpy()
                code = np.unique(code * (int(index.max()) + 1) + index, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                own = order[lo:hi]
                key = [batch.column(n)[int(own[0])] for n in names]
                at = tuple(s.as_py() for s in key)
                new = block_of(x[own])
                held[at] = (key, merge(held[at][1], new) if at in held else new)
            if len(held) > HELD:
                yield table(list(held.values()), part, types)
                held.clear()
        if held:
            yield table(list(held.values()), part, types)

    def together(t: pa.Table) -> pa.Table:
        out: Block = (0, np.zeros(k), np.zeros((k, k)))
        for n, mean, cross in zip(t.column("_n").to_pylist(), t.column("_mean"), t.column("_cross"), strict=True):
            full = np.zeros((k, k))
            full[upper] = cross.values.to_numpy()
            out = merge(out, (n, mean.values.to_numpy(), full + np.triu(full, 1).T))
        key = [t.column(n)[0] for n in names]
        return pa.Table.from_batches([table([(key, out)], t.column("_part")[0].as_py(), [t.schema.field(n).type for n in names])])

    blocks = slim.mapInArrow(run, schema)
    blocks = blocks.groupBy(*names, "_part").applyInArrow(together, schema).withColumn("_part", F.lit(0))
    whole = blocks.groupBy(*names, "_part").applyInArrow(together, schema).drop("_part")
    return whole.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "_n", "_mean", "_cross")
