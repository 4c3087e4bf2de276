"""The corpus pipeline: STAGES, each a call of one operator over what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and rereads them for the next.

Null and empty texts: scored and kept or dropped by the classifier like any text, one of them stays after exact
deduplication, and the mix takes none of them. Rows that repeat doc_id and text become one in exact deduplication. Rows
without doc_id share one decision: they stay if any of them does. Extra columns of ``documents`` pass through every
stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablero.llm.common import staged
from tablero.llm.op01_packing import pack
from tablero.llm.op03_ngram_join import ngram_join
from tablero.llm.op06_quality import quality_scores
from tablero.llm.op09_exact_dedup import exact_dedup
from tablero.llm.op10_mixing import mixed_documents


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (null-safe)."""
    return docs.join(ids.select(F.col("doc_id").alias("__kept_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _only(docs, quality_scores(docs, labels).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the kept row stays."""
    return _only(docs, exact_dedup(docs).where("kept")).dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity 0.8) the smallest doc_id stays."""
    return _only(docs, ngram_join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixing), ("packing", packing)]

#: The classifier, the order along the curve and the tokenizer are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
