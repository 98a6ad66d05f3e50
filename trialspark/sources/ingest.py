"""CSV, parquet and JSON input/output, identifiers and input checks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trialspark import CONTROL, TREATMENT
from trialspark.functions.draws import draw, unit_code

REQUIRED = ("arm", "converted")


_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder named in ``spark.checkpoint.dir``, or
    below the warehouse, which executors share as well, where that is unset.
    The table stays until ``discard_scratch``.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(context.applicationId, []).append(path)
    return path


def discard_scratch(spark: SparkSession) -> int:
    """Remove all scratch tables that this application has written, once their
    results have been read; returns how many there were."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        _delete(spark, path)
    return len(made)


def _hadoop(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _hadoop(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


_laid_out: dict[tuple, str] = {}


def bucketed_table(df: DataFrame, label: str, by: str) -> DataFrame:
    """Rows laid out once by bucket of a column, in a table of the session.

    The same rows of the same unchanged files are written once per application
    and then read in buckets: as many tasks as shuffles have, whatever the
    splits of the source, and no exchange on the column.
    """
    spark = df.sparkSession
    files = sorted(df.inputFiles())
    fs_times = []
    for f in files:
        fs, where = _hadoop(spark, f)
        fs_times.append(fs.getFileStatus(where).getModificationTime())
    key = (spark.sparkContext.applicationId, label, tuple(files), tuple(fs_times), tuple(df.dtypes))
    name = _laid_out.get(key)
    if name is None or not spark.catalog.tableExists(name):
        name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        root = scratch_path(spark, f"table-{label}")
        _made[spark.sparkContext.applicationId].remove(root)  # stays until discard_tables
        df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", root).saveAsTable(name)
        _laid_out[key] = name
    return spark.table(name)


def discard_tables(spark: SparkSession) -> int:
    """Drop the bucketed tables of this application; returns how many there were."""
    mine = [k for k in _laid_out if k[0] == spark.sparkContext.applicationId]
    for k in mine:
        name = _laid_out.pop(k)
        if spark.catalog.tableExists(name):
            path = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
            spark.sql(f"DROP TABLE {name}")
            _delete(spark, path)
    return len(mine)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an aggregate that several branches read, and read it back.

    Column pruning would otherwise give every branch its own scan of the rows.
    The written table survives lost executors and has known statistics, so
    Spark's own size check decides which later joins are broadcast.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_units_csv(spark: SparkSession, path: str, schema: T.StructType,
                   narrow: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Typed CSV scan with a header; ``narrow`` columns become 8-bit integers.

    A row that does not fit the schema ends the scan (``FAILFAST``) instead of
    turning into NULLs.  A gz file is one split: pass ``partitions`` to spread its rows right after
    the scan, so later stages do not run in a single task.
    """
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if partitions:
        df = df.repartition(partitions)
    return df.withColumns({c: F.col(c).cast("tinyint") for c in narrow})


class Quarantine(NamedTuple):
    """Rows that fit a schema, lines that do not with the reason, and their numbers."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def quarantine_units_csv(spark: SparkSession, path: str, schema: T.StructType, out: str,
                         narrow: tuple[str, ...] = (), partitions: int | None = None, header: bool = True) -> Quarantine:
    """Typed CSV scan that keeps what does not fit, in one scan.

    The scan is written once below ``out``, good rows and bad lines in folders
    of their own; both tables read from there, and the counts are observed on
    the write.  A line is bad if it does not parse under ``schema`` or if a
    ``narrow`` column does not fit 8 bits.  Bad rows hold the line as it was
    read and the reason.  gz input is dealt to ``partitions`` after the scan.
    """
    line, reason = "_line", "_reason"
    whole = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema), T.StructField(line, T.StringType())])
    rows = (spark.read.schema(whole).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", line).csv(path))
    if partitions:
        rows = rows.repartition(partitions)
    why = F.when(F.col(line).isNotNull(), "does not parse")
    for c in narrow:
        why = why.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("tinyint").isNull(), f"{c} does not fit 8 bits")
    rows = rows.withColumn(reason, why)
    text = F.coalesce(F.col(line), F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema])))
    rows = rows.withColumns({line: F.when(F.col(reason).isNotNull(), text), "_bad": F.col(reason).isNotNull()})
    rows = rows.withColumns({c: F.col(f"`{c}`").try_cast("tinyint") for c in narrow})
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("_bad").alias("bad")).write.partitionBy("_bad").parquet(out)
    kept = spark.read.schema(rows.schema).parquet(out)
    counts = {"lines": seen.get["lines"], "bad": seen.get["bad"], "good": seen.get["lines"] - seen.get["bad"]}
    return Quarantine(kept.where("NOT _bad").drop(line, reason, "_bad"),
                      kept.where("_bad").select(F.col(line).alias("line"), F.col(reason).alias("reason")), counts)


def read_units_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan with inferred types: one extra pass over the file."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def add_unit_id(df: DataFrame, key: str | None = None, *, dense: bool = False,
                buckets: int = 4096, name: str = "row_id") -> DataFrame:
    """Surrogate id.

    The default is unique and free of shuffles.  ``dense`` numbers the rows
    1..n: rows are spread over hash buckets of the unique ``key``, numbered
    inside the bucket, and shifted by the rows of all earlier buckets.  No task
    sees more than one bucket, and only ``buckets`` counts are ever broadcast.
    """
    if not dense:
        return df.withColumn(name, F.monotonically_increasing_id() + 1)
    if key is None:
        raise ValueError("a dense id needs a unique integer key")
    rows = df.withColumn("_c", unit_code(F.col(key))).withColumn("_b", draw("order", code="_c") % buckets).drop("_c")
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return (rows.withColumn("_i", inside)
            .join(F.broadcast(starts), "_b")
            .withColumn(name, F.col("_start") + F.col("_i"))
            .drop("_b", "_i", "_start"))


def create_or_replace_table(df: DataFrame, path: str, checks: Mapping[str, Column] | None = None) -> dict[str, object]:
    """Write a table, in place of an older one, without a time at which neither is whole.

    The new rows are written beside the old ones and take their place by
    renaming; until then, and whenever the write fails, the old table stays as
    it is.  ``df`` may read the table it replaces.  Returns the aggregates in
    ``checks``, observed on the write itself instead of by another scan.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    restore_table(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    seen = Observation()
    try:
        (df.observe(seen, *[c.alias(n) for n, c in checks.items()]) if checks else df).write.parquet(new)
        if _exists(spark, path):
            _rename(spark, path, old)
        _rename(spark, new, path)
    except BaseException:
        _delete(spark, new)
        restore_table(spark, path)
        raise
    _delete(spark, old)
    spark.catalog.refreshByPath(path)
    return dict(seen.get) if checks else {}


def restore_table(spark: SparkSession, path: str) -> bool:
    """Finish or undo a replacement that was cut off between its renames: the old
    rows come back if no new ones have taken their place."""
    path = path.rstrip("/")
    old = f"{path}.old"
    if not _exists(spark, old):
        return False
    if _exists(spark, path):
        _delete(spark, old)
        return False
    _rename(spark, old, path)
    return True


def table_row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per table in one job; a missing table gives NULL, not an error."""
    parts = []
    for name, path in paths.items():
        try:
            counted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
        except AnalysisException:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_and_read(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write a result as parquet, csv or json and read it back with its schema."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    reader = df.sparkSession.read.schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError("Missing required column(s): " + ", ".join(missing))
    return df


def unit_rules(df: DataFrame, covariates: tuple[str, ...] = ("pre_x",)) -> dict[str, Column]:
    """Column and value rules of the input contract as aggregates: row count,
    missing and found columns, rows that break a rule."""
    missing = missing_columns(df)
    found = [c for c in covariates if c in df.columns]

    def violations(col: str, *allowed: object) -> Column:
        if col in missing:
            return F.max(F.lit(None).cast("bigint"))
        return F.count_if(~F.coalesce(F.col(col).isin(*allowed), F.lit(False)))

    return {"n_rows": F.count(F.lit(1)), "missing": F.max(F.lit(",".join(missing))), "covariates": F.max(F.lit(",".join(found))),
            "bad_arm": violations("arm", CONTROL, TREATMENT), "bad_converted": violations("converted", 0, 1)}


def validate_units(df: DataFrame, covariates: tuple[str, ...] = ("pre_x",)) -> DataFrame:
    """The rules of ``unit_rules``, as one row of counts."""
    texts = {"missing": ",".join(missing_columns(df)), "covariates": ",".join(c for c in covariates if c in df.columns)}
    return df.agg(*[(F.lit(texts[n]) if n in texts else c).alias(n) for n, c in unit_rules(df, covariates).items()])


def write_validated(df: DataFrame, path: str, covariates: tuple[str, ...] = ("pre_x",)) -> dict[str, object]:
    """Replace a table and return the figures of ``validate_units``, counted while it is written."""
    return create_or_replace_table(df, path, unit_rules(df, covariates))
