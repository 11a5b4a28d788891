"""Documents for training: quality rules, line dedup, near-dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what
it returns is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents. Rows without doc_id can't be told apart: the
filtering stages keep them; rows that repeat a doc_id go or stay together. A document that line
dedup leaves without a word goes (its lines are all elsewhere); one that had none to begin with failed the
quality rules. Of equally good documents of a near-duplicate group the smallest doc_id stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolens.llm import common, line_dedup, minhash, packing, pii, quality


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = rejected.select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["__gone"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality.quality(docs).where("not kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(docs).where("not (__gone > 0 and text rlike '^[ \\\\t-\\\\r]*$')")
    n_chars = F.when(F.col("__gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select(*[n_chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, minhash.near_duplicates(docs).where("not kept"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(docs, count="__found")
    n_chars = F.when(F.col("__found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*[n_chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("pii", pseudonyms), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Pseudonyms and token ids can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None
