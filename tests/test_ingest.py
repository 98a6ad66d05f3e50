"""Quarantine of bad lines, replacement of tables, figures observed on writes."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.reports import tables
from trialspark.sources import ingest

SCHEMA = T.StructType([T.StructField("arm", T.StringType()), T.StructField("converted", T.IntegerType()), T.StructField("day", T.IntegerType())])
LINES = ["arm,converted,day", "control,1,3", "treatment,zz,4", "control,0,300", "treatment", "treatment,0,5", 'control,"1,2', ",,"]


def test_bad_lines_are_kept_with_their_reason(spark, tmp_path):
    with gzip.open(tmp_path / "u.csv.gz", "wt") as f:
        f.write("\n".join(LINES) + "\n")
    got = ingest.quarantine_units_csv(spark, str(tmp_path / "u.csv.gz"), SCHEMA, str(tmp_path / "out"), narrow=("converted", "day"), partitions=3)
    assert got.counts == {"lines": 7, "good": 3, "bad": 4}
    assert sorted((r.arm or "", r.converted, r.day) for r in got.good.collect()) == sorted([("control", 1, 3), ("treatment", 0, 5), ("", None, None)], key=lambda r: r[0])
    assert dict(got.good.dtypes) == {"arm": "string", "converted": "tinyint", "day": "tinyint"}
    bad = {r.line: r.reason for r in got.bad.collect()}
    assert bad["treatment,zz,4"] == bad["treatment"] == "does not parse" and bad["control,0,300"] == "day does not fit 8 bits" and len(bad) == 4
    assert len(list((tmp_path / "out").glob("_bad=*"))) == 2


def test_quarantine_of_clean_and_empty_files(spark, tmp_path):
    for name, lines, n in (("clean", LINES[:2], 1), ("empty", LINES[:1], 0)):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        got = ingest.quarantine_units_csv(spark, str(tmp_path / f"{name}.csv"), SCHEMA, str(tmp_path / name))
        assert got.counts == {"lines": n, "good": n, "bad": 0} and got.good.count() == n and got.bad.count() == 0


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.create_or_replace_table(spark.range(10), path)
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("half-way"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="half-way"):
        ingest.create_or_replace_table(broken, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))
    assert [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["t"]


def test_a_failed_rename_brings_the_old_rows_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    ingest.create_or_replace_table(spark.range(10), path)
    rename = ingest._rename

    def fails(s, old, new):
        if ".new-" in old:
            raise OSError("no")
        rename(s, old, new)

    monkeypatch.setattr(ingest, "_rename", fails)
    with pytest.raises(OSError, match="no"):
        ingest.create_or_replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 10


def test_a_replacement_that_was_cut_off_is_restored(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(7).write.parquet(f"{path}.old")  # the driver died between the renames
    assert ingest.restore_table(spark, path) and spark.read.parquet(path).count() == 7 and not ingest.restore_table(spark, path)
    spark.range(3).write.parquet(f"{path}.old")  # or after them
    assert not ingest.restore_table(spark, path) and spark.read.parquet(path).count() == 7


def test_a_table_is_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.create_or_replace_table(spark.range(10), path)
    seen = ingest.create_or_replace_table(spark.read.parquet(path).where("id % 2 = 0"), path, {"n": F.count(F.lit(1)), "top": F.max("id")})
    assert seen == {"n": 5, "top": 8} and spark.read.parquet(path).count() == 5


def test_figures_come_from_the_write(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("control", 1, 1.0), ("treatment", 2, 2.0), ("other", 0, None), (None, None, 3.0)], "arm string, converted int, pre_x double")
    seen = ingest.write_validated(df.mapInArrow(count, df.schema), str(tmp_path / "t"))
    assert reads.value == 4
    assert seen == ingest.validate_units(df).first().asDict() == {"n_rows": 4, "missing": "", "covariates": "pre_x", "bad_arm": 2, "bad_converted": 2}


def test_tables_are_replaced_by_many_tasks(spark, tmp_path, monkeypatch):
    """The validated tables are replaced file by file, not through the one task of a limit."""
    spark.range(4000).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
                                 "TIMESTAMP '1995-01-01 00:00:00' + make_dt_interval(CAST(id % 90 AS INT)) AS o_orderdate", "'1-URGENT' AS o_orderpriority").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    replace, seen = ingest.create_or_replace_table, []

    def watched(df, path, checks=None):
        seen.append((checks is None, df._jdf.queryExecution().executedPlan().toString()))
        return replace(df, path, checks)

    monkeypatch.setattr(ingest, "create_or_replace_table", watched)
    rows = {r.source: r.rows_read for r in tables.validate_on_write(spark, str(tmp_path)).collect()}
    assert rows["raw_orders"] == rows["orders"] == 4000
    again = [plan for bare, plan in seen if bare]
    assert len(again) == 3 and not any("Limit" in plan for plan in again)
