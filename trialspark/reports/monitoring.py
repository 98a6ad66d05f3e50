"""Sequential monitoring reports."""

from __future__ import annotations

from datetime import UTC, datetime
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.stats import two_sided_p
from trialspark.operators import panels, replay, sequential
from trialspark.reports import tidy
from trialspark.sources import ingest
from trialspark.sources.ingest import materialize
from trialspark.sources.units import coded_orders, day_number, event_units, order_units, salted_arm, table
from trialspark.streaming import looks

TAU = 0.0025


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily looks at two experiments: orders by segment, and events."""
    orders = panels.arm_totals(order_units(spark, sf_dir, customers=True), ["segment", "day"])
    events = panels.arm_totals(event_units(spark, sf_dir).withColumn("segment", F.lit("events")), ["segment", "day"])
    return sequential.cumulative_looks(orders.unionByName(events), ["segment"])


def cumulative_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_looks(spark, sf_dir))


def look_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sequential.look_zscores(_looks(spark, sf_dir)).select("segment", "look", "p_c", "p_t", "z"))


def obf_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary at every look an experiment really has, and whether z is beyond it."""
    seen = materialize(sequential.look_zscores(_looks(spark, sf_dir)), "looks")
    total = seen.groupBy("segment").agg(F.max("look").alias("n_looks"))
    out = sequential.with_obf_constant(seen.join(total, "segment"))
    out = out.withColumn("boundary", F.expr(sequential.obf_boundary("c_obf")))
    return tidy(out.select("segment", "look", "n_looks", "boundary", (F.abs("z") > F.col("boundary")).alias("crossed")))


def spent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the planned information at each look an experiment really has, and the error that its boundary has spent by then."""
    out = sequential.with_spending_boundary(sequential.look_zscores(_looks(spark, sf_dir)), ["segment"])
    out = out.withColumn("_z", F.lit(NormalDist().inv_cdf(1 - 0.05 / 4)) / F.sqrt("fraction"))
    return tidy(out.select("segment", "look", "fraction", (2 * two_sided_p("_z")).alias("spent")))


def msprt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sequential.with_msprt(_looks(spark, sf_dir), TAU, ["segment"]).select("segment", "look", "msprt_p"))


def msprt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The always-valid p values of five experiments over the events, as a stream
    of files in the order of arrival, four files a batch."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    files, days = ingest.scratch_path(spark, "event-files"), day_number(F.col("ts"), "2024-01-01")
    events.withColumn("part", F.floor(days / 2)).repartitionByRange(8, "part").sortWithinPartitions("ts").drop("part").write.parquet(files)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).option("latestFirst", False).parquet(files)
    units = rows.select((F.col("user_id") % 5).cast("string").alias("experiment"), F.col("ts").cast("timestamp").alias("ts"), days.alias("day"),
                        salted_arm("fx3:", F.col("user_id")).alias("arm"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("converted"))
    out = ingest.scratch_path(spark, "stream-looks")
    origin = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp() * 1000)
    looks.write_looks(looks.stream_looks(units, TAU, origin, "60 days"), out, ingest.scratch_path(spark, "stream-state")).awaitTermination()
    return tidy(looks.current_looks(spark, out).select(F.col("experiment").alias("segment"), "look", "msprt_p"))


def stopping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First crossing per rule for re-randomized experiments with a +30% effect."""
    cumulative = replay.replay_looks(coded_orders(spark, sf_dir), 40, [{"lift": 0.3}])
    return tidy(sequential.stopping_rules(cumulative, ["replay"], 14, sequential.obf_constant(14), TAU))


def obf_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cumulative = replay.replay_looks(coded_orders(spark, sf_dir), 100, [{"lift": 0.0}])
    return tidy(sequential.obf_calibration(cumulative, ["replay"], 14))


def msprt_tau_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replay.msprt_tau_grid(coded_orders(spark, sf_dir), 40, rel_lift=0.3))


QUERIES = {f.__name__: f for f in (cumulative_looks, look_zscores, obf_boundaries, spent_error, msprt, msprt_stream, stopping_rules,
                                   obf_calibration, msprt_tau_grid)}
