"""Shared helpers: words and hashes over Arrow buffers, written tables, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.sources.ingest import scratch_path

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same bytes.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Bytes of text handled at once; bounds the memory of a task, not the length of a text.
STEP = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64."""
    if len(_tables.get("up", ())) <= n:
        size = 1 << max(int(n).bit_length(), 16)
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            run = np.full(size, step, np.uint64)
            run[0] = 1
            _tables[name] = np.cumprod(run, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any bits of them can choose a block."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row begins; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every word."""
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = off[1:-1]
    at = cut[cut < len(data)]
    first[at] = solid[at]
    at = cut[cut > 0] - 1
    last[at] = solid[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over the bytes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + STEP, side="right")))
        n = int(end[j - 1] - a)
        up, down = _powers(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[a: a + n]] * up[:n], out=run[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (run[e] - run[s]) * down[s]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k consecutive words that begin at each index of ``at``."""
    n = len(words)
    up, down = _powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=run[1:])
    return mix((run[at + k] - run[at]) * down[at])


def window_starts(row: np.ndarray, k: int) -> np.ndarray:
    """Indexes of words that begin k consecutive words of one row."""
    if len(row) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[k - 1:] == row[: len(row) - k + 1])


_stage: list[int] = []
_remembered: dict[Hashable, object] = {}


def enter_stage(stage: int) -> None:
    """Give back what a worker holds of an earlier stage: it serves tasks of many."""
    if _stage != [stage]:
        _stage[:] = [stage]
        _remembered.clear()
        _tables.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def remembered(key: Hashable, make: Callable[[], object]) -> object:
    """A value that the tasks of a stage share in a worker, made by the first of them."""
    if key not in _remembered:
        _remembered[key] = make()
    return _remembered[key]


def map_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that gives any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage(TaskContext.get().stageId())
        for batch in batches:
            yield from per_batch(batch)

    return df.mapInArrow(run, schema)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive
    lost executors without running what led to it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one aggregate."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts(total_bytes: int, each: int, least: int = 16) -> int:
    """Number of blocks of about ``each`` bytes; grows with the input."""
    return max(least, -(-total_bytes // each))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph given by its edges.

    Returns (node, root), root being the smallest node reachable, for each node
    that has an edge.  Large-star and small-star rounds alternate until all edges
    are stars; each round is written to the shared folder.  A node with very
    many edges only meets its minimum, by partial aggregation and a join whose
    wide side Spark can split.
    """
    e = keep(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = (both.join(low, "v").where("u > v")
                 .select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        e = keep(small.select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct(), "edges")
        # stars: no node has two edges down, and none that is pointed to has any
        forks = e.groupBy("v").count().where("count > 1").select("v")
        if forks.unionByName(e.select("v").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")).isEmpty():
            break
    return (e.select(F.col("v").alias("node"), F.col("u").alias("root"))
            .unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct())
