"""A corpus pipeline: language, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet in the shared folder and reads again as the next stage's
documents.  All stages but the last return the columns of ``docs``, also those
that a stage does not know, whatever their names.  Decisions meet texts in
merge joins at every size: their number grows with the documents.  Tables without rows pass
through; rows with null ids or texts are documented with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import decontam, langid, packing, secret_scan, simhash
from trialspark.llm.common import keep
from trialspark.sources.ingest import scratch_path

KNOWN = ("doc_id", "text", "lang", "n_chars")
#: Mean posterior from which a prediction overrules a label.
SURE = 0.99


def _plain(docs: DataFrame) -> DataFrame:
    """Unknown columns under names that no operator uses."""
    return docs.toDF(*(c if c in KNOWN else f"other_{i}" for i, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without any letter, and null texts, go.

    A null ``lang`` is filled with the prediction, and a label that the random
    field contradicts with a posterior of ``SURE`` or more is corrected.
    """
    rows = _plain(docs)
    model = langid.fit(langid.sample_segments(rows))
    seen = langid.identify(rows, model).where(F.col("lang_pred") != langid.NO_LETTER)
    sure = F.when(F.col("score") >= SURE, F.col("lang_pred"))
    return seen.withColumn("lang", F.coalesce(sure, "lang", "lang_pred")).select(rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies share at least 0.8 of their 5-word shingles (Jaccard).  Of repeated rows one stays; a null id stays only if its group has no other.
    """
    rows = _plain(docs)
    keepers = keep(simhash.near_groups(rows).where("keeper").select("_uid"), "keepers")
    return (rows.withColumn("_uid", F.monotonically_increasing_id()).join(keepers.hint("merge"), "_uid", "left_semi")
            .select(rows.columns).toDF(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = _plain(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    leaks = keep(decontam.contaminated(rows, items).select("_uid").distinct(), "leaks")
    return (rows.withColumn("_uid", F.monotonically_increasing_id()).join(leaks.hint("merge"), "_uid", "left_anti")
            .select(rows.columns).toDF(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` counted again where text was masked."""
    rows = _plain(docs)
    out = secret_scan.redact(rows.withColumn("_before", F.length("text")))
    changed = F.col("_before") != F.length("text")
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, one row per piece."""
    return packing.pack_documents(_plain(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Hashes, a trained model and a tokenizer cannot be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
