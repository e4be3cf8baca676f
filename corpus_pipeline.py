"""A corpus from raw documents to token ids: five stages, each written as Parquet and reread by the next.

In all stages: every row is judged for itself, whatever its doc_id, null
included; columns other than doc_id and text are carried as they are, also
null ones and ones whose names an operator uses itself; an empty table gives
an empty one of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, language, near_join, pieces, pii
from tracewright.llm.queries import table, vocabulary
from tracewright.llm.windows import packed
from tracewright.session import staged, trim_executors

#: Least probability of the predicted language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null, empty and blank texts too), or without a language that is likelier than not, go.

    Of equally likely languages the first by name counts; repeated rows stay or go alike.
    """
    # texts pass Python once, beside the other columns
    found = language.identify(docs.select("doc_id", "text", packed(docs.drop("text"))), language.train(docs), keep=("text", "own"))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingles of five words link at 0.8 or more, the smallest doc_id stays; without any, one row of them.

    Repeated rows are copies of each other, and one stays; texts without words link with nothing and all stay.
    """
    return near_join.keep_one(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none; equal texts stay or go alike."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text become [kind]; n_chars follows, where it isn't null. Null texts stay null; no row goes."""
    found = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and CRC-32 of the ids, and whether they decode to the text; null and empty texts have no ids. A row each."""
    return pieces.round_trip(docs, vocabulary("piece_bpe_32k.model"))


def _trimmed(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, started with the heap of the stages before given back: it counts beside Python's memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _trimmed(stage)) for stage in (language_id, near_duplicates, benchmark_decontamination, personal_data, sentencepiece)]
#: Models and components are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
