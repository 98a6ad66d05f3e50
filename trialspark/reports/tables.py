"""Input, output, assignment and panel reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.operators import assign, panels
from trialspark.plans import audit
from trialspark.reports import tidy
from trialspark.sources import ingest
from trialspark.sources.units import (event_units, line_units, order_units, table,
                                      three_arm_units, with_code)

CSV_SCHEMA = T.StructType([
    T.StructField("unit_id", T.LongType()), T.StructField("arm", T.StringType()),
    T.StructField("day", T.IntegerType()), T.StructField("converted", T.IntegerType()),
    T.StructField("amount", T.DoubleType())])
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
LINE_COVARIATES = ("quantity", "discount", "tax")


def _csv(spark: SparkSession, sf_dir: str, compression: str) -> str:
    path = ingest.scratch_path(spark, "units-csv")
    rows = order_units(spark, sf_dir).select(*CSV_SCHEMA.fieldNames())
    rows.write.option("header", True).option("compression", compression).csv(path)
    return path


def read_units_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(spark, sf_dir, "gzip")
    units = ingest.read_units_csv(spark, path, CSV_SCHEMA, narrow=("day", "converted"), partitions=spark.sparkContext.defaultParallelism)
    return tidy(units.groupBy("arm", "day").agg(
        F.count(F.lit(1)).alias("users"), F.sum("converted").alias("conversions"),
        F.sum("amount").alias("amount")), amount=2)


def quarantine_units_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order units as gz lines of which some are spoilt: a word for a number,
    a day beyond 8 bits, columns cut off.  Good rows by arm, bad lines by reason."""
    names = CSV_SCHEMA.fieldNames()
    spoilt = {"amount": "IF(unit_id % 50 = 7, 'many', CAST(amount AS STRING))", "day": "IF(unit_id % 50 = 8, '300', CAST(day AS STRING))"}
    fields = ", ".join(spoilt.get(c, f"CAST({c} AS STRING)") for c in names)
    lines = order_units(spark, sf_dir).selectExpr(f"IF(unit_id % 50 = 9, CAST(unit_id AS STRING), concat_ws(',', {fields})) AS line")
    path = ingest.scratch_path(spark, "spoilt-csv")
    lines.write.option("compression", "gzip").text(path)
    got = ingest.quarantine_units_csv(spark, path, CSV_SCHEMA, ingest.scratch_path(spark, "quarantine"), narrow=("day", "converted"),
                                      partitions=spark.sparkContext.defaultParallelism, header=False)
    good = got.good.groupBy(F.col("arm").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("converted").alias("conversions"), F.max("day").cast("int").alias("last_day"))
    bad = got.bad.groupBy(F.col("reason").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("conversions"), F.lit(None).cast("int").alias("last_day"))
    told = {"lines": F.lit(got.counts["lines"]), "bad_lines": F.lit(got.counts["bad"])}
    return tidy(good.unionByName(bad).withColumns(told))


def validate_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the input check, observed while the tables are written, and the rows read back.
    Each table is then replaced from itself."""
    out = []
    for name, units in (("orders", order_units(spark, sf_dir)), ("three_arms", three_arm_units(spark, sf_dir).withColumnRenamed("label", "arm")), ("raw_orders", table(spark, sf_dir, "orders"))):
        path = ingest.scratch_path(spark, f"validated-{name}")
        seen = ingest.write_validated(units, path)
        ingest.create_or_replace_table(spark.read.parquet(path), path)
        out.append((name, seen["n_rows"], seen["missing"], seen["bad_arm"], seen["bad_converted"], spark.read.parquet(path).count()))
    return tidy(spark.createDataFrame(out, "source string, n_rows long, missing string, bad_arm long, bad_converted long, rows_read long"))


def read_units_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ingest.read_units_csv_inferred(spark, _csv(spark, sf_dir, "none"))
    return tidy(units.groupBy("arm").agg(
        F.count(F.lit(1)).alias("users"), F.sum("converted").alias("conversions"), F.max("day").alias("last_day"),
        F.avg("amount").alias("avg_amount")), digits=4)


def add_unit_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return tidy(ingest.add_unit_id(orders, "o_orderkey", dense=True))


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {t: f"{sf_dir}/{t}.parquet" for t in TABLES}
    return ingest.table_row_counts(spark, {**paths, "not_loaded": f"{sf_dir}/not_loaded.parquet"})


def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ingest.materialize(
        tidy(panels.metrics_by_arm(order_units(spark, sf_dir), ["converted"]), 8), "arm-metrics")
    out = None
    for fmt in ("parquet", "csv", "json"):
        back = ingest.write_and_read(result, ingest.scratch_path(spark, fmt), fmt).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


def validate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order units pass; three-arm labels break the arm rule; raw orders lack both columns."""
    good = ingest.validate_units(order_units(spark, sf_dir, customers=True))
    three = ingest.validate_units(three_arm_units(spark, sf_dir).withColumnRenamed("label", "arm"))
    bare = ingest.validate_units(table(spark, sf_dir, "orders"))
    return (good.withColumn("source", F.lit("orders"))
            .unionByName(three.withColumn("source", F.lit("three_arms")))
            .unionByName(bare.withColumn("source", F.lit("raw_orders"))))


def scenario_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rows with defaults filled in, and what they mean on this table:
    the base rate and the chance that a treated non-converter is flipped."""
    catalog = audit.scenario_catalog(spark).drop("scenario_no")
    rates = assign.base_rates(order_units(spark, sf_dir)).withColumn("_one", F.lit(1))
    p = F.col("base_rate")
    return tidy(catalog.withColumn("_one", F.lit(1)).join(F.broadcast(rates), "_one").drop("_one").withColumn(
        "flip_probability", F.col("lift_hi") * p / (1 - p)))


def label_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign.label_arms(three_arm_units(spark, sf_dir), "label", "none", "variant_a")
    return tidy(rows.select("unit_id", "label", "arm"))


def conditional_arm_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.arm_totals(order_units(spark, sf_dir, customers=True), ["segment"]))


def perturb_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign.perturb_covariate(order_units(spark, sf_dir, customers=True), "pre_x", 1.08)
    return tidy(rows.select("unit_id", "arm", "pre_x"), 4)


def assign_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign.assign_arms(order_units(spark, sf_dir), "assign:", 0.5)
    return tidy(rows.select("unit_id", "arm"))


def assign_arms_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign.assign_arms(order_units(spark, sf_dir), "ramp:", 0.5, ramp_days=3, ramp_share=0.1)
    return tidy(rows.groupBy("day", "arm").agg(F.count(F.lit(1)).alias("users")))


def subset_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign.subset_units(order_units(spark, sf_dir), converters=True, arm="control", days=(0, 7))
    return tidy(rows.select("unit_id", "day", "revenue"), 2)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment share of a 20% sample against the full table."""
    units = with_code(order_units(spark, sf_dir))
    in_arm = F.avg(F.when(F.col("arm") == "treatment", 1.0).otherwise(0.0)).alias("treat_share")
    size = F.count(F.lit(1)).alias("users")
    full = units.agg(size, in_arm).withColumn("sample", F.lit("full"))
    part = assign.hash_sample(units, 0.2).agg(size, in_arm).withColumn("sample", F.lit("hash_20pct"))
    return tidy(full.unionByName(part))


def metrics_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir)
    return tidy(panels.metrics_by_arm(units, ["visit", "converted", "revenue"]), 8, revenue_mean=3, revenue_var=-2)


def arm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.arm_totals(event_units(spark, sf_dir)))


def daily_arm_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.daily_panel(order_units(spark, sf_dir)), 8)


def segment_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.segment_panel(order_units(spark, sf_dir, customers=True), "nation"))


def covariate_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.covariate_moments(line_units(spark, sf_dir), LINE_COVARIATES))


def metric_covariate_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panels.pooled_association(order_units(spark, sf_dir, customers=True), "amount", "x_strong", ["segment"])
    return tidy(out, covariance=-3)


def lognormal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir)
    return tidy(panels.lognormal_calibration(units, "revenue", F.col("converted"), F.col("visit")))


def ratio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.ratio_rollup(event_units(spark, sf_dir)))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(panels.value_counts(three_arm_units(spark, sf_dir), "label"))


QUERIES = {f.__name__: f for f in (
    read_units_csv, quarantine_units_csv, validate_on_write, read_units_csv_inferred, add_unit_id, table_row_counts, write_read_roundtrip, validate_units,
    scenario_catalog, label_arms, conditional_arm_sums, perturb_covariate, assign_arms, assign_arms_ramp,
    subset_units, hash_sample, metrics_by_arm, arm_totals, daily_arm_panel, segment_panel, covariate_moments,
    metric_covariate_corr, lognormal_calibration, ratio_rollup, value_counts)}
