"""Registered queries of the corpus operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremap.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).drop("_rid")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.html_extract import extract

    text = extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("_rid")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.language_id import LanguageId, held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = LanguageId.fit(docs.where(~held_out("doc_id")))
    return model.predict(docs.withColumn("held_out", held_out("doc_id")), ["doc_id", "held_out"])


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.bagminhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents")).drop("_rid")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.warc import archive_pages, read_archives

    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    damaged = F.raise_error(F.concat(F.lit("payload and digest differ in record "), "record_id")).cast("string")
    return read_archives(archive_pages(pages)).select(
        F.expr(f"try_cast(record_id as {kind})").alias("page_id"),
        "payload_bytes",
        F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(damaged).alias("payload_digest"),
        "record_type",
        F.expr(f"try_cast(refers_to as {kind})").alias("refers_to"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.suffix_dedup import suffix_dedup

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.common import materialize
    from scoremap.llm.media_chunks import read_back, store

    held = store(table(spark, sf_dir, "documents"), ["doc_id"])
    payload = F.substring("media", 45, 2**31 - 1)
    read = read_back(held).select(
        "payload_id",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring("media", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
    return held.index.join(materialize(read, "read"), "payload_id").select("doc_id", "n_bytes", *read.columns[1:])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scoremap.llm.bpe import Tokenizer, ids_text

    bpe = Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("_rid").withColumn("weight", F.round("weight", 9))


def _op10_sql() -> str:
    from scoremap.llm.mixing import mix_sql

    return mix_sql()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.merkle import proofs, tampered

    return proofs(table(spark, sf_dir, "documents"), tampered(F.col("text"), F.col("doc_id")))


def _op11_sql() -> str:
    from scoremap.llm.merkle import proofs_sql

    return proofs_sql()


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoremap.llm.licenses import scan, summary

    return summary(scan(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_html_extract": op2_html_extract,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_language_id": op4_language_id,
        "op5_bagminhash": op5_bagminhash,
        "op6_warc": op6_warc,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_media_chunks": op8_media_chunks,
        "op9_bpe": op9_bpe,
        "op10_mixing": op10_mixing,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_whitening": op12_whitening,
        "op13_license_scan": op13_license_scan,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op10_mixing": _op10_sql(), "op11_merkle_manifest": _op11_sql()}
