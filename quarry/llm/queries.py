"""Registered queries of the training-data operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, files, langid, licenses, near_dedup, packing, rlz_dedup, spelling, suffix_dedup, token_files, tokens, topk, toxicity, warc, whitening
from quarry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by digests of its whole text, paragraphs and lines."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE["op1_licenses"] = licenses.scan_sql()


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 100-byte strings leaves of every document."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), result="digest")


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, with its number of links."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 by crc32 of the id is held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return langid.predict(docs, langid.train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a benchmark item in it, and where."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to compressed binary files and read back."""
    folder = files.new_folder(spark, "token-files")
    manifest = token_files.write(table(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json"), folder)
    return token_files.read(manifest, folder)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; fold 0 of 5 by crc32 of the id is held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return (toxicity.score(docs, model).withColumn("held_out", held)
            .select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), "spans"))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every 100th vector with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE["op9_topk"] = """WITH whole AS (SELECT vec_id, min(v) AS v FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))) GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 10"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC files and read back, equal payloads as revisits."""
    folder = files.new_folder(spark, "warc")
    return warc.read(warc.write(table(spark, sf_dir, "pages"), folder))


#: Base 32 of 160 bits: 20 bits (5 hexadecimal digits) make 4 letters.
ORACLE["op10_warc"] = """WITH bytes AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM bytes),
coded AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[5 * i + 1 : 5 * i + 5])::BIGINT >> (15 - 5 * j)::INT) & 31)]), 'string_agg', '')), 'string_agg', '')
    AS payload_digest FROM hashed),
firsts AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM coded GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM coded JOIN firsts USING (payload_digest, payload_bytes)"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of the documents, with their forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four principal components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated windows of 35 words leaves of every document."""
    return rlz_dedup.repeats(table(spark, sf_dir, "documents"), result="digest")
