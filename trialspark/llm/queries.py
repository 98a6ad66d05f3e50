"""Registered queries of the corpus operators, with production parameters, and reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import ann, archives, decontam, langid, lm, negatives, packing, pieces, secret_scan, simhash, spelling, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words that occur elsewhere are cut out of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substrings.drop_repeats(docs, 35).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL["op3_substring_dedup"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (
    SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
    FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
gone AS (
    SELECT rid, list(DISTINCT p) AS spots
    FROM (SELECT rid, unnest(generate_series(i, i + 34)) AS p FROM s SEMI JOIN twice USING (h))
    GROUP BY rid),
k AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(spots), 0) AS n_removed,
           CASE WHEN spots IS NULL THEN w
                ELSE list_transform(list_filter(generate_series(1, len(w)), lambda p: NOT list_contains(spots, p)), lambda p: w[p]) END AS kept
    FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 2 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; weak parts only where their complement is near."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listing, count_of = secret_scan.listing, secret_scan.count_of
    return secret_scan.scan(docs).select(
        "doc_id", count_of("assign").alias("n_assign"), count_of("access").alias("n_access"), count_of("hex").alias("n_hex"),
        F.sha2(listing("base").cast("binary"), 256).alias("base_sha256"), listing("spans").alias("spans"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark, word for word or with other numbers, units and names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.contaminated(docs, items).drop("_uid")


def remainder(n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and log-bilinear scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm.score_documents(docs, remainder(7) == 2)


@query
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archives.archive_pages(pages).drop("url")


SQL["op6_arc_to_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
    SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
           list_transform(range(0, 160, 5), lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
               ((instr('0123456789abcdef', substr(h, CAST(b // 4 + 1 AS INT), 1)) - 1) * 16
                + instr('0123456789abcdef', substr(h || '0', CAST(b // 4 + 2 AS INT), 1)) - 1) >> CAST(3 - b % 4 AS INT)) & 31) AS INT), 1)) AS c
    FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(c, '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""


@query
def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to each vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = remainder(5) == 0
    model = langid.fit(langid.sample_segments(docs.where(~held_out)))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = remainder(5) == 0
    machine = toxicity.fit(toxicity.sample(docs.where(~held_out), labels))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), machine).drop("text")


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the texts that these ids give."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(docs, path).drop("text"), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their frequent neighbours at one edit."""
    return spelling.variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL["op11_hard_negatives"] = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
c AS (
    SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 10
"""
