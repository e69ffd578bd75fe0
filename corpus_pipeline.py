"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing, each over all that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, line_dedup, minhash, packing
from weftline.llm.common import documents, stage

#: A document whose best language has a lower probability than this, or that has no letters, is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents that share so many percent of their shingles are near-duplicates.
NEAR_PERCENT = 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, each row by its own text: one without letters, or of no clear language, goes. Nothing is learned from rows
    with a null text or lang; without any labelled row all go. Equal rows share a fate; an empty table stays empty."""
    return language.accepted(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose later repeated runs of lines, n_chars follows; no row goes. Null and blank texts stay as they
    are, rows with a null doc_id come last in order, repeated doc_ids are told apart by their texts."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: the first document of each group stays, in the order of doc_id; documents without words stay, and so do
    rows that are equal to one that stays in doc_id and text."""
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination, each row by its own text: one that holds a benchmark item goes. Null and empty texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the digests of all pieces; a null text is an empty document, a null source a queue of its own."""
    return packing.digests(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL expresses neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
