"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import embeddings, filter_audit, langid, licenses, lines, media, mixing, near_dedup, packing, pieces, quality, resampling, substrings
from sparkloom.llm.common import held_out, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.with_fold(langid.predict(docs, langid.fit(langid.teaching(docs))))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), length=4)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(table(spark, sf_dir, "documents")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), least_exact=lines.EXACT_CHARS)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", kept)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.text_media(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    teaching = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.fit(docs, teaching))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_langid": op1_langid,
        "op2_near_dedup": op2_near_dedup,
        "op3_substrings": op3_substrings,
        "op4_embeddings": op4_embeddings,
        "op5_packing": op5_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_licenses": op7_licenses,
        "op8_media": op8_media,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_resampling": op11_resampling,
        "op12_filter_audit": op12_filter_audit,
        "op13_pieces": op13_pieces,
    }


def oracles() -> dict[str, str]:
    return {
        "op2_near_dedup": near_dedup.ORACLE,
        "op3_substrings": substrings.ORACLE,
        "op4_embeddings": embeddings.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op11_resampling": resampling.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
    }
