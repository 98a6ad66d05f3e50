"""Sequential looks over a stream of units: cumulative counts and always-valid p values.

Rows are counted per experiment and day where they are read, so the state
operator gets one row per task, experiment and day.  The state of an experiment
holds the sums of its closed days (those before the watermark), the running
minimum of the p value up to them, and the counts of its open days.  Each batch
gives the looks of all open days anew; the sink keeps the last ones.  A row of a
closed day comes too late and is not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from trialspark import CONTROL, TREATMENT
from trialspark.operators.sequential import VARIANCE_FLOOR

COUNTS = ("conv_c", "n_c", "conv_t", "n_t")
OUT = "experiment string, look int, day int, conv_c long, n_c long, conv_t long, n_t long, msprt_p double"
STATE = "first int, closed int, least double, base array<long>, days array<int>, counts array<long>"
DAY_MS = 86_400_000


def day_counts(units: DataFrame) -> DataFrame:
    """(experiment, day, ts, conv_c, n_c, conv_t, n_t): partial counts per Arrow
    batch of rows with ``experiment``, ``ts`` (a timestamp), ``day`` (int), ``arm`` and ``converted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = pc.fill_null(batch.column("converted").cast(pa.int64()), 0)
            held = pc.cast(pc.is_valid(batch.column("converted")), pa.int64())
            cols = {"experiment": batch.column("experiment"), "day": batch.column("day"), "ts": batch.column("ts")}
            for s, label in (("c", CONTROL), ("t", TREATMENT)):
                mine = pc.cast(pc.fill_null(pc.equal(batch.column("arm"), label), False), pa.int64())
                cols[f"conv_{s}"], cols[f"n_{s}"] = pc.multiply(y, mine), pc.multiply(held, mine)
            t = pa.table(cols).group_by(["experiment", "day"]).aggregate([("ts", "max"), *((c, "sum") for c in COUNTS)])
            t = t.select(["experiment", "day", "ts_max", *(f"{c}_sum" for c in COUNTS)]).rename_columns(["experiment", "day", "ts", *COUNTS])
            yield from t.combine_chunks().to_batches()

    slim = units.select(F.col("experiment").cast("string").alias("experiment"), F.col("day").cast("int").alias("day"), "ts", "arm", F.col("converted").cast("int").alias("converted"))
    slim = slim.where("experiment IS NOT NULL AND day IS NOT NULL AND ts IS NOT NULL")
    kind = slim.schema["ts"].dataType.simpleString()
    return slim.mapInArrow(run, f"experiment string, day int, ts {kind}, conv_c long, n_c long, conv_t long, n_t long")


def inverse_ratio(c: list[int], tau: float) -> float:
    """min(1, 1 / likelihood ratio) of cumulative counts; 1 while an arm is empty."""
    conv_c, n_c, conv_t, n_t = c
    if not n_c or not n_t:
        return 1.0
    p_c, p_t = conv_c / n_c, conv_t / n_t
    v, t2 = max(p_c * (1 - p_c) / n_c + p_t * (1 - p_t) / n_t, VARIANCE_FLOOR), tau * tau
    return min(1.0, math.sqrt((v + t2) / v) * math.exp(-t2 * (p_t - p_c) ** 2 / (2 * v * (v + t2))))


def stream_looks(units: DataFrame, tau: float, origin_day_ms: int, delay: str = "2 days") -> DataFrame:
    """Looks of a stream of units with their running p value, in update mode.

    Day d begins at ``origin_day_ms + d`` days; it closes when the watermark
    (largest time seen less ``delay``) has passed its end.
    """

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, closed, least, base, days, counts = state.get if state.exists else (None, None, 1.0, [0, 0, 0, 0], [], [])
        held = {d: list(counts[4 * i: 4 * i + 4]) for i, d in enumerate(days)}
        for pdf in frames:
            for d, *c in pdf[["day", *COUNTS]].itertuples(index=False):
                if closed is None or d > closed:
                    own = held.setdefault(int(d), [0, 0, 0, 0])
                    for i in range(4):
                        own[i] += int(c[i])
        if not held:
            return
        if closed is None:
            first = min(held)
        rows, run, low, passed = [], list(base), least, closed
        mark = (state.getCurrentWatermarkMs() - origin_day_ms) // DAY_MS - 1  # the last day that has ended before the watermark
        begin = closed + 1 if closed is not None else first
        for d in range(begin, max(held) + 1):
            for i, x in enumerate(held.get(d, (0, 0, 0, 0))):
                run[i] += x
            low = min(low, inverse_ratio(run, tau))
            rows.append((key[0], d - first + 1, d, *run, low))
            if d <= mark:
                base, least, passed = list(run), low, d
        keep = sorted(d for d in held if passed is None or d > passed)
        state.update((first, passed, least, base, keep, [x for d in keep for x in held[d]]))
        yield pd.DataFrame(rows, columns=["experiment", "look", "day", *COUNTS, "msprt_p"])

    counted = day_counts(units).withWatermark("ts", delay)
    return counted.groupBy("experiment").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def write_looks(looks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop; looks go to ``out`` by batch.  A batch
    that is run again after a failure replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return looks.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_looks(spark: SparkSession, out: str) -> DataFrame:
    """The last version of each look; looks beyond an experiment's last day so far do not exist."""
    rows = spark.read.schema(f"{OUT}, batch int").parquet(out)
    last = Window.partitionBy("experiment", "look").orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "batch")
