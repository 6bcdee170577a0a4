"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Language ID drops documents that it rejects; SimHash keeps a row of the smallest doc_id of each group; suffix-array dedup cuts
strings of 200 bytes that stand more than once; decontamination drops documents that overlap a benchmark item; mixing
says how often each document is taken. All stages but the last return the columns of documents. An empty table gives an
empty result at every stage, and other columns than those of documents are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir
from tessera.llm.decontamination import find_overlaps
from tessera.llm.langid import identify_documents
from tessera.llm.mixing import mix
from tessera.llm.simhash import representatives
from tessera.llm.suffix import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Accepted documents. Null and empty texts have no evidence of their own and go; rows that repeat are judged alike and stay rows of their own."""
    return identify_documents(docs.select(*COLUMNS)).where("accepted").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest doc_id, nulls last, then the smallest hash of the row.

    Rows are told apart by their contents, so a doc_id that is null or stands on several texts decides nothing for other groups.
    """
    # the hash skips nulls, so it is told which columns are null
    mark = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    keep = materialize(representatives(docs.select(*COLUMNS), mark), "kept")
    k = keep.select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    rows = docs.select(*COLUMNS, mark.alias("mark")).join(k, (F.col("mark") == F.col("kept_mark")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    twice = keep.where("n > 1").limit(1).count()
    return (rows.dropDuplicates(["doc_id", "mark"]) if twice else rows).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeated strings; n_chars is counted anew.

    Null texts become empty; rows that repeat are copies of each other and lose all that is long enough.
    """
    rows = remove_repeats(docs.select(*COLUMNS), as_text=True).withColumn("text", F.col("kept"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Null and empty texts and items overlap nothing; an empty benchmark keeps all."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_overlaps(docs.select(*COLUMNS), benchmark).where(F.size("overlaps") == 0).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes. Null texts have no words; a null source is one of its own; ties go by doc_id, then by a hash of the text."""
    return mix(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: Fingerprints, suffix orders and spaced seeds are beyond SQL: the pipeline is held against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
