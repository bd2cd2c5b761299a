"""Queries of the text problems over documents, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.leaks import leaked_items
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.subjects import page_subjects


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """What each container holds and leaves unused."""
    packed = pack_documents(_table(spark, d, "documents"))
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("used"), (2048 - F.sum("n_tokens")).alias("unused"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_item"))


def p10_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return page_subjects(_table(spark, d, "documents"), _table(spark, d, "doc_label"), _table(spark, d, "subject_area"), _table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_posteriors(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each subject area in the corpus."""
    return p10_posteriors(spark, d).groupBy("subject").agg(F.count("*").alias("pages"), F.round(F.sum("posterior"), 0).alias("expected_pages"))


def queries() -> dict:
    return {f.__name__: f for f in (p8_pack, p8_containers, p9_found, p10_found, p10_posteriors, p10_composition)}


def oracle_sql() -> dict[str, str]:
    return {}
