"""Queries of problem 6 over documents and pack_capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from .packing import pack
from .tokens import token_counts


def capacities(spark: SparkSession, sf: str) -> dict[str, int]:
    return {r["container"]: r["capacity_tokens"] for r in spark.read.parquet(f"{sf}/pack_capacities.parquet").collect()}


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """The bin of every text, or of every piece of a text above the capacity, per container size."""
    n = R.written(token_counts(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"), "tokens")
    return pack(n, capacities(spark, sf))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The fill of every bin."""
    cap = spark.read.parquet(f"{sf}/pack_capacities.parquet")
    t = p6_items(spark, sf).groupBy("container", "bin_no").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used_tokens"))
    t = t.join(cap, "container")
    return t.select("container", "bin_no", "capacity_tokens", "n_items", "used_tokens", F.round(F.col("used_tokens") / F.col("capacity_tokens"), 6).alias("fill"))


def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Bins, the least possible number of bins by volume, and the mean fill per container size."""
    t = p6_fill(spark, sf).groupBy("container", "capacity_tokens").agg(F.count(F.lit(1)).alias("bins"), F.sum("n_items").alias("n_items"), F.sum("used_tokens").alias("used_tokens"))
    least = F.ceil(F.col("used_tokens") / F.col("capacity_tokens"))
    return t.withColumns({"bins_by_volume": least, "fill": F.round(F.col("used_tokens") / (F.col("bins") * F.col("capacity_tokens")), 6)})


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold per container size whatever the tokens: all texts lie in it, no bin is too full, no text is cut that fits."""
    cap = spark.read.parquet(f"{sf}/pack_capacities.parquet").distinct()
    t = R.written(p6_items(spark, sf), "items").join(cap, "container")
    per = t.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece_no").alias("n"), F.sum("size").alias("tokens"), F.max("capacity_tokens").alias("cap"))
    docs = per.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("cap"))).alias("cut_though_it_fits"), F.count_if(F.col("pieces") != F.col("n")).alias("doubled"))
    full = t.groupBy("container", "bin_no").agg(F.sum("size").alias("used"), F.max("capacity_tokens").alias("cap")).groupBy("container").agg(F.count_if(F.col("used") > F.col("cap")).alias("too_full"))
    return docs.join(full, "container").select("container", "documents", "cut_though_it_fits", "doubled", "too_full")


QUERIES = {"p6_items": p6_items, "p6_fill": p6_fill, "p6_summary": p6_summary, "p6_check": p6_check}
SQL = {"p6_check": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS cut_though_it_fits, 0 AS doubled, 0 AS too_full FROM (SELECT DISTINCT container FROM pack_capacities)"}
