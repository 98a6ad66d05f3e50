"""Unit views over order, customer and event tables.

Each view is a lazy projection, so column pruning reaches the scan: a query that
needs only ``arm`` and ``converted`` reads two columns of ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark import CONTROL, TREATMENT
from trialspark.functions.draws import salted_bucket, unit_code
from trialspark.sources.ingest import bucketed_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_arm(salt: str, key: Column, share: float = 0.5) -> Column:
    """Arm of a unit: independent of every other unit and of the row order."""
    hit = salted_bucket(salt, key) % 10000 < int(round(share * 10000))
    return F.when(hit, F.lit(TREATMENT)).otherwise(F.lit(CONTROL))


def day_number(ts: Column, origin: str) -> Column:
    return F.datediff(ts.cast("date"), F.lit(origin).cast("date"))


def order_units(spark: SparkSession, sf_dir: str, *, share: float = 0.5, salt: str = "fx1:",
                customers: bool = False, day_no: bool = False) -> DataFrame:
    """One row per order.  ``customers`` adds the segment and the covariates, at
    the price of a join; leave it off when they are not needed.  ``day_no`` adds
    the days since the first one."""
    orders = table(spark, sf_dir, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    if customers:
        cust = table(spark, sf_dir, "customer").select(
            "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
        orders = orders.join(cust, orders.o_custkey == cust.c_custkey)
    day = day_number(F.col("o_orderdate"), "1995-01-01")
    cols = [
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_custkey").alias("cluster_id"),
        salted_arm(salt, F.col("o_orderkey"), share).alias("arm"),
        F.pmod(day, F.lit(14)).cast("int").alias("day"),
        F.pmod(day, F.lit(56)).cast("int").alias("slot"),
        *([day.alias("day_no")] if day_no else []),
        F.col("o_totalprice").alias("amount"),
        F.when(urgent, 1).otherwise(0).alias("converted"),
        F.when(urgent, F.col("o_totalprice")).otherwise(0.0).alias("revenue"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("engaged"),
        F.when(F.col("o_totalprice") > 250000.0, 1).otherwise(0).alias("visit"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("order_status"),
    ]
    if customers:
        cols += [
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("pre_x"),
            (0.5 * F.col("o_totalprice") + 10 * F.col("c_acctbal")).alias("x_strong"),
        ]
    return orders.select(*cols)


def customer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders before and after a cut-off date."""
    orders = table(spark, sf_dir, "orders")
    cut = F.to_timestamp_ntz(F.lit("1998-04-01 00:00:00"))
    # every order has exactly one customer, so the key in ``orders`` is enough
    return orders.groupBy(F.col("o_custkey").alias("unit_id")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("clicks"),
        F.sum(F.when(F.col("o_orderdate") < cut, F.col("o_totalprice")).otherwise(0.0)).alias("history"),
        F.sum(F.when(F.col("o_orderdate") >= cut, F.col("o_totalprice")).otherwise(0.0)).alias("spend"),
    ).withColumn("arm", salted_arm("fx2:", F.col("unit_id")))


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; ``unit_id`` is the randomized user."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("unit_id"),
        salted_arm("fx3:", F.col("user_id")).alias("arm"),
        day_number(F.col("ts"), "2024-01-01").cast("int").alias("day"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("converted"),
        F.col("value"),
    )


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line; the order is the randomized cluster."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("cluster_id"),
        salted_arm("fx7:", F.col("l_orderkey")).alias("arm"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("converted"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
    )


def three_arm_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one of three campaign labels."""
    units = order_units(spark, sf_dir)
    pick = salted_bucket("fx4:", F.col("unit_id")) % 3
    label = F.when(pick == 0, "none").when(pick == 1, "variant_a").otherwise("variant_b")
    return units.drop("arm").withColumn("label", label)


def with_code(units: DataFrame, key: str = "unit_id") -> DataFrame:
    """Attach the 64-bit unit code that all draws start from."""
    return units.withColumn("code", unit_code(F.col(key)))


def spread(units: DataFrame) -> DataFrame:
    """Deal coded units to as many tasks as shuffles have, before they are repeated
    over replays: one shuffle of narrow rows, whatever the splits of the source."""
    return units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "code")


def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded order units with all columns that studies use, laid out once per
    application by bucket of the code.  ``known`` marks units with a customer."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    units = order_units(spark, sf_dir, day_no=True).join(cust, F.col("cluster_id") == F.col("c_custkey"), "left")
    units = units.withColumnsRenamed({"c_mktsegment": "segment", "c_nationkey": "nation", "c_acctbal": "pre_x"}).withColumns(
        {"known": F.col("c_custkey").isNotNull(), "x_strong": 0.5 * F.col("amount") + 10 * F.col("pre_x")}).drop("c_custkey")
    return bucketed_table(with_code(units), "order-units", "code")


def coded_orders(spark: SparkSession, sf_dir: str, customers: bool = False, **options) -> DataFrame:
    """Order units ready for replays: the laid-out table, or, for another share
    or salt of the arms, units dealt to as many tasks as shuffles have."""
    if options:
        return spread(with_code(order_units(spark, sf_dir, customers=customers, **options)))
    units = unit_table(spark, sf_dir)
    more = ("segment", "nation", "pre_x", "x_strong")
    if customers:
        return units.where("known").drop("day_no", "known")
    return units.drop("day_no", "known", *more)
