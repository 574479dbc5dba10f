"""A training corpus from raw documents: quality, lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor,
and all but the last return the columns of documents, whatever their names.

Defined cases, for every stage: null texts count as empty ones, and texts of any
length are taken whole; an empty table gives an empty table; a doc_id may be null
or on several rows, which are judged each by its own text (but for lines, where
the rows of a doc_id count as one document, and rows without one are left as
they are). Without labels of both classes the classifier accepts everything;
without items nothing is contaminated. Of near-duplicates the smallest doc_id
stays, with all its rows in that group; rows without doc_id stay. Rows without
words are packed nowhere.

Python gets the documents in batches of about ``BATCH_BYTES``, since a task holds
several at once; the stages set the session so.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlattice.llm import decontaminate, lines, packing, quality, similar
from binlattice.llm.shared import Scratch


BATCH_BYTES = 8 << 20


def in_small_batches(stage):
    """The stage, with the session's batches for Python cut to about BATCH_BYTES where they are larger; results don't depend on it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        most = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
        if not 0 < most <= BATCH_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share go, but in the last that holds them; n_chars follows."""
    kept = lines.dedup(docs, keep_text=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


@in_small_batches
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash of five-word shingles, similarity 0.8 or more, verified and completed."""
    return similar.first_of_each(docs)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
