"""From raw documents to packed windows: language id, exact and near deduplication, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.common import free_names, written
from hazardspark.llm.crossparse import identify, sample_texts
from hazardspark.llm.decontam import drop_contaminated
from hazardspark.llm.exact_dedup import drop_exact_copies
from hazardspark.llm.near_copies import drop_near_copies
from hazardspark.llm.queries import packed_digests


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and those without a letter go, and all of them where nothing is labelled. Rows that repeat stay."""
    pred, score = free_names(docs, "lang_pred", "lang_score")
    return identify(docs, sample_texts(docs), pred_col=pred, score_col=score).filter(F.col(pred) != "und").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null counts as empty) the row with the smallest id stays, a null id last; of repeated rows one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts linked by 0.8 of their five-word shingles: probes of wide fingerprints, then an exact check."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, repeated rows each for itself; null texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; a null text is the end id alone, rows that repeat an id are packed each for itself."""
    return packed_digests(docs)


STAGES = [("language", known_language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack_windows)]

#: Cross-parsing, fingerprints and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
