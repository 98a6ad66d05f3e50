"""Fair re-randomizations counted 64 at a time.

Bit b of a unit's 64-bit hash is its arm in split b, so one hash serves 64
splits and a row is never repeated over them.  The counters of all splits are
bit-sliced: bits b and b + 32 stand in the two 32-bit lanes of a long, and 32
sums of ``(hash >>> b) & lanes`` count all 64 splits in generated code.  Lanes
are summed within a task, where they cannot overflow (2^31 rows), unpacked, and
summed over tasks as longs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.draws import STREAM_STEP, STREAMS

BITS = 64
LANES = (1 << 32) | 1
LOW = (1 << 32) - 1


def _cells(metrics: Sequence[str]) -> str:
    """Values of a row that add to a counter; number 0 counts the row itself."""
    values = ["1L", *(f"CAST(coalesce(`{m}`, 0) AS BIGINT)" for m in metrics)]
    return "array(" + ", ".join(f"named_struct('_metric', {i}, '_y', {v})" for i, v in enumerate(values)) + ")"


def split_sums(units: DataFrame, n_splits: int, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, split, _metric, in_t, total): per split 1..n the sum of each metric
    over the treatment arm and over all rows; ``_metric`` 0 is the row count.

    ``units`` has ``code``; metrics are whole numbers from 0 (NULL adds nothing)
    whose sum within a task stays below 2^31.
    """
    words = -(-n_splits // BITS)
    keys = list(keys)
    quoted = [f"`{k}`" for k in keys]
    rows = units.selectExpr(*quoted, "code", "spark_partition_id() AS _task", f"inline({_cells(metrics)})").where("_y <> 0")
    rows = rows.selectExpr("*", f"explode(sequence(0, {words - 1})) AS _word")
    rows = rows.selectExpr(*quoted, "_task", "_metric", "_y", "_word", f"xxhash64(code, _word + {STREAMS['split'] * STREAM_STEP}) AS _h")
    lanes = ", ".join(f"_s{b}" for b in range(BITS // 2))
    packed = rows.groupBy(*keys, "_task", "_metric", "_word").agg(
        F.sum("_y").alias("_all"), *[F.expr(f"sum((shiftrightunsigned(_h, {b}) & {LANES}L) * _y) AS _s{b}") for b in range(BITS // 2)])
    unpacked = packed.selectExpr(*quoted, "_metric", "_word", "_all", (
        f"posexplode(concat(transform(array({lanes}), s -> s & {LOW}L), transform(array({lanes}), s -> shiftrightunsigned(s, 32)))) AS (_bit, _in)"))
    return (unpacked.groupBy(*keys, "_metric", F.expr(f"_word * {BITS} + _bit + 1").alias("split")).agg(F.sum("_in").alias("in_t"), F.sum("_all").alias("total"))
            .where(F.col("split") <= n_splits))


def split_totals(units: DataFrame, n_splits: int, metrics: Sequence[str], keys: Sequence[str] = (), name: str = "replay") -> DataFrame:
    """Arm totals of 0/1 metrics under ``n_splits`` fair splits, one row per key,
    split and metric: (keys, replay, metric_no, metric, n_c, n_t, conv_c, conv_t)."""
    sums = split_sums(units, n_splits, metrics, keys)

    def of(i: int, column: str) -> str:
        return f"coalesce(sum({column}) FILTER (WHERE _metric = {i}), 0L)"

    wide = sums.groupBy(*keys, F.col("split").cast("int").alias(name)).agg(
        F.expr(f"{of(0, 'total')} AS _n"), F.expr(f"{of(0, 'in_t')} AS n_t"),
        *[F.expr(f"{of(i, c)} AS _{c}_{i}") for i in range(1, len(metrics) + 1) for c in ("total", "in_t")])
    cells = ", ".join(f"named_struct('metric_no', {i}, 'metric', '{m}', 'conv_c', _total_{i} - _in_t_{i}, 'conv_t', _in_t_{i})"
                      for i, m in enumerate(metrics, start=1))
    return wide.selectExpr(*[f"`{k}`" for k in keys], name, "_n - n_t AS n_c", "n_t", f"inline(array({cells}))")
