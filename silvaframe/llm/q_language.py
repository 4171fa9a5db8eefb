"""Queries of problem 8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language as L


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    docs = docs.select("doc_id", "text", L.label_language(F.col("lang")).alias("label"))
    return L.labelled(docs, L.train(L.sample(docs)))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    t = _labelled(spark, sf)
    said, own = F.col("label").isNotNull(), F.col("lang_code")
    wrong = F.when(own == L.UND, said).otherwise(~said | (F.col("label") != own))
    return t.where(F.when(F.col("segment_no") == 0, wrong).otherwise(F.col("mixed"))).select("doc_id", "segment_no", "lang_code").distinct()


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every document (segment 0) and every paragraph of a mixed one, with language and confidence."""
    t = _labelled(spark, sf).where("segment_no = 0 or mixed")
    return t.select("doc_id", "segment_no", "lang_code", F.round("confidence", 4).alias("confidence"), "chars")


QUERIES = {"p8_found": p8_found, "p8_labels": p8_labels}
SQL: dict[str, str] = {}
