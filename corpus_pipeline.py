"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.

Defined cases: documents of null or empty text go in the first stage; a null
doc_id is a document of its own, which no other one is compared with, but for
its lines; repeated rows of one id are one document and stay or go together; an
empty table gives an empty result; other columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histlake.llm import decontaminate, lines, minhash, pieces, quality
from histlake.llm.common import bounded_batches, delete, settle, table, work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    bounded_batches(spark)
    return quality.keep(docs, quality.default_vocabularies(), work_dir(spark))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay only in the smallest doc_id; documents that this leaves with fewer words than the base rules ask for go."""
    return lines.drop_lines(docs, least_words=quality.MIN_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Line dedup leaves of a near copy what its first copy does not hold, so
    documents are first compared by the texts that they came with.  What stays
    is compared by the texts that it has now: those that differed in shared
    lines alone are near-duplicates only since these are gone.
    """
    bounded_batches(spark)
    folder = work_dir(spark)
    first = minhash.distinct_texts(minhash.keep_first_of(docs, table(spark, sf_dir, "documents"), folder))
    return minhash.keep_first(settle(first, folder, "first"), f"{folder}/now")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left."""
    bounded_batches(spark)
    return pieces.encode(docs, pieces.Vocabulary.load(pieces.default_model()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Tokenising and verified components have no SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = settle(stage(spark, docs, sf_dir), folder, f"stage-{k}")
        if k:
            delete(spark, f"{folder}/stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
