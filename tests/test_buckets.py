"""Units laid out once and read in buckets."""

from pyspark.sql import functions as F

from trialspark.plans import audit
from trialspark.reports import decisions, replays
from trialspark.sources import ingest, units

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


def test_one_table_serves_all_studies(spark, tmp_path):
    ingest.discard_tables(spark)
    before = len(ingest._laid_out)
    a = units.unit_table(spark, DIR)
    b = units.coded_orders(spark, DIR, customers=True)
    decisions.audit_units(spark, DIR).count(), decisions.prepared_units(spark, DIR).count(), replays._orders(spark, DIR).count()
    assert len(ingest._laid_out) == before + 1
    plain = units.order_units(spark, DIR, customers=True)
    assert set(plain.columns) | {"code"} == set(b.columns)
    assert sorted(tuple(r[c] for c in plain.columns) for r in plain.collect()) == sorted(tuple(r[c] for c in plain.columns) for r in b.collect())
    assert a.count() == spark.read.parquet(f"{DIR}/orders.parquet").count()
    # another file is another table
    for t in ("orders", "customer"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(50).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert units.unit_table(spark, str(tmp_path)).count() == 50 and len(ingest._laid_out) == before + 2
    assert ingest.discard_tables(spark) == before + 2 and ingest.discard_tables(spark) == 0


def test_replays_read_without_a_shuffle_of_units(spark):
    by_code = units.unit_table(spark, DIR).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    assert exchanges(plan(by_code)) == []
    cells = audit.experiment_cells(audit.experiment_rows(decisions.audit_units(spark, DIR)))
    found = exchanges(plan(cells))
    assert len(found) <= 2 and not any("REPARTITION" in x for x in found)  # the cells, and the one row of base rates
    spread = exchanges(plan(units.spread(units.with_code(units.order_units(spark, DIR)))))
    assert any("REPARTITION" in x for x in spread)
