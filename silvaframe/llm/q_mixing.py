"""Queries of problem 7 over documents and source_weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from .mixing import Plan, mix
from .tokens import token_counts


def plain_source(c: Column) -> Column:
    """A source's name in one spelling: lower case, words joined by underscores."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit(""))


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Plan], list]:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("doc_id", "text", plain_source(F.col("source")).alias("source"))
    n = R.written(token_counts(docs, "doc_id", "text", extra=("source",)), "tokens")
    weights = spark.read.parquet(f"{sf}/source_weights.parquet").withColumn("source", plain_source(F.col("source")))
    weights = weights.where("source is not null").orderBy("source").collect()  # a fixed number of rows
    targets = [(w["source"], w["target_share_bp"] * w["total_tokens"] // 10000, w["max_repeats"]) for w in weights]
    out, plans = mix(n, targets)
    return out, plans, weights


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used."""
    return _mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual tokens and shares per source, from the selected rows."""
    out, _, weights = _mixture(spark, sf)
    want = spark.createDataFrame([(w["source"], w["target_share_bp"], w["max_repeats"], w["total_tokens"], w["target_share_bp"] * w["total_tokens"] // 10000) for w in weights], "source string, target_share_bp int, max_repeats int, total_tokens long, target_tokens long")
    got = out.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"))
    t = want.join(got, "source", "left").na.fill(0, ["documents", "most_uses", "actual_tokens"])
    total = got.agg(F.coalesce(F.sum("actual_tokens"), F.lit(0)).alias("mixture_tokens"))
    t = t.join(F.broadcast(total))  # one row
    return t.withColumns({"shortfall_tokens": F.col("target_tokens") - F.col("actual_tokens"), "share_of_total": F.round(F.col("actual_tokens") / F.col("total_tokens"), 6), "share_of_mixture": F.round(F.try_divide(F.col("actual_tokens"), F.col("mixture_tokens")), 6)})


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold per source whatever the tokens: the budget, and no document used too often, from elsewhere or beyond the budget."""
    out, _, weights = _mixture(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", plain_source(F.col("source")).alias("own")).where("own is not null").distinct()
    want = spark.createDataFrame([(w["source"], w["max_repeats"], w["target_share_bp"] * w["total_tokens"] // 10000) for w in weights], "source string, max_repeats int, target_tokens long")
    known = out.join(docs, (out["doc_id"] == docs["doc_id"]) & (F.col("source") == F.col("own")), "left_semi")
    got = out.groupBy("source").agg(F.max("uses").alias("most"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))
    t = want.join(got, "source", "left").join(known.groupBy("source").agg(F.count(F.lit(1)).alias("known")), "source", "left").na.fill(0, ["most", "tokens", "n", "ids", "known"])
    return t.select("source", "target_tokens", (F.col("most") > F.col("max_repeats")).alias("used_too_often"), (F.col("tokens") > F.col("target_tokens")).alias("over_budget"), (F.col("n") - F.col("ids")).alias("doubled"), (F.col("n") - F.col("known")).alias("foreign"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_check": p7_check}
SQL = {
    "p7_check": r"SELECT trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS source, CAST(target_share_bp AS BIGINT) * total_tokens // 10000 AS target_tokens, false AS used_too_often, false AS over_budget, 0 AS doubled, 0 AS foreign FROM source_weights",
}
