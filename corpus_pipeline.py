"""Five stages that turn raw documents into packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruleframe.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from ruleframe.llm.common import release, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Similarity of shingle sets from which documents are copies, in percent.
NEAR_PERCENT = 80
#: Lines in at least so many documents are dropped everywhere.
REPEATED_LINE_DOCUMENTS = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text that is left."""
    cleaned = line_dedup.drop_repeated_lines(docs, min_documents=REPEATED_LINE_DOCUMENTS)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # What the stage wrote on its way is of no further use.
        release(spark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
