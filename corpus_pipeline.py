"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Language identification, line dedup, near-dedup, mixing and packing. All stages but the last return the
columns of documents. A null id is never told to be a duplicate; documents without words pass the stages that
have nothing to say on them, except the first, which can't tell their language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, lines, mixing, near_dedup, packing
from sparkloom.llm.common import documents_only, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least one half and by enough of their words."""
    docs = documents_only(docs)
    teaching = langid.teaching(docs)
    return langid.keep_identified(docs, langid.fit_evidence(teaching, langid.fit(teaching)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one, long ones but for two edits; those that lose all go."""
    docs = documents_only(docs)
    found = lines.dedup_lines(docs, least_exact=lines.EXACT_CHARS)
    stay = (F.col("line_dedup.n_removed") < F.col("line_dedup.n_lines")) | (F.col("line_dedup.n_lines") == 0)
    return found.where(stay).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near-duplicates (five words, 0.8)."""
    docs = documents_only(docs)
    found = near_dedup.near_duplicates(docs)
    going = found.where("NOT kept").select(F.col("doc_id").alias("going_id")).distinct()
    return docs.join(going, docs["doc_id"] == going["going_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeats(documents_only(docs))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each document's pieces."""
    return packing.pack(documents_only(docs))


STAGES = [
    ("identify_language", identify_language),
    ("dedup_lines", dedup_lines),
    ("dedup_near", dedup_near),
    ("mix_sources", mix_sources),
    ("pack_bins", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Best-fit packing and edit joins over languages' models have no SQL form; a brute-force version tests them.
ORACLE_SQL = None
