"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import identify_documents, identify_pages
from tessera.llm.mixing import MIX_SQL, mix
from tessera.llm.decontamination import find_overlaps
from tessera.llm.extraction import extract_text
from tessera.llm.knn import KNN_SQL, voronoi_knn
from tessera.llm.ngram import held_out, score_texts
from tessera.llm.simhash import simhash_groups
from tessera.llm.suffix import remove_repeats
from tessera.llm.toxicity import score_toxicity
from tessera.llm.urls import URLS_SQL, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify_documents(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])
    return rows.select("doc_id", F.col("lang").alias("declared"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), keep=["page_id", "url"])
    return rows.select("page_id", "url", "language", F.round("posterior", 6).alias("posterior"), "text_language", "accepted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    longest = F.get("overlaps", F.lit(0))
    return rows.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.array_sort(F.array_distinct("overlaps.item_id")).alias("item_ids"), longest["words"].alias("words"), longest["agree"].alias("agree"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_voronoi_knn": op3_voronoi_knn,
        "op4_deleted_interpolation": op4_deleted_interpolation,
        "op5_language_id": op5_language_id,
        "op6_mixing": op6_mixing,
        "op7_decontamination": op7_decontamination,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_extraction": op10_extraction,
        "language_id_pages": language_id_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_voronoi_knn": KNN_SQL, "op6_mixing": MIX_SQL, "op9_url_filter": URLS_SQL}
