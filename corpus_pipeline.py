"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; what it returns is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents, in their
order; other columns of docs, whatever their names, are carried along.  doc_id,
lang, source and n_chars may be null; repeated rows are rows of their own until
near-duplicates go; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm import dartminhash, langid, line_dedup, mixing, packing
from helixlake.llm.common import materialise

#: SQL has no language model, near-duplicate classes or tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified with enough confidence go.

    Null and empty texts, and texts without a letter, have no language and go;
    without labelled texts nothing can be identified and all go.
    """
    return langid.keep_identified(docs, langid.train(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; documents that lose their last word go.

    Null and empty texts stay as they are; of equal runs the one in the smallest
    doc_id stays (null first, then by text, then by row); n_chars follows the text.
    """
    return line_dedup.drop_repeats(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id (null last).

    Null, empty and wordless texts are like no other and stay; of rows that agree
    in doc_id and text one stays.
    """
    return dartminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, go or are repeated so that sources have their target weights.

    A null source is a source of its own, the last; documents without words have
    no weight and stay once; rows that agree in doc_id and text are taken together.
    """
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences of 1024 ids.

    Null and empty texts are one piece of one id; a text of any length is cut
    into as many pieces as it takes; ties of length are placed in the order of their rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
