"""Queries of problem 1 over per_annotation_features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.species import absent, four_digits, id_number, name_prefix
from .pairs import PairTable, strong

#: Rows that came in later than this after the annotation form the second, incremental batch.
LATE = "INTERVAL 7 DAYS"


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Images as baskets of trait classes: rows in time, then late ones."""
    t = spark.read.parquet(f"{sf}/per_annotation_features.parquet")
    ok = F.col("category_id").between(1, 14)
    own = F.when(~absent(F.col("species_id")), four_digits(id_number(F.col("species_id"))))
    prefix = four_digits(name_prefix(F.col("image_name")))
    late = F.coalesce(F.expr(f"ingested_at > annotated_at + {LATE}"), F.lit(False))
    rows = lambda when: t.where(ok & when).select(F.col("image_id").alias("basket"), own.alias("grp"), prefix.alias("weak"), F.col("category_id").alias("item"))
    return rows(~late), rows(late)


def build(spark: SparkSession, sf: str) -> PairTable:
    """The pair table after both batches."""
    state = PairTable(spark, T.LongType(), T.IntegerType())
    for batch in _batches(spark, sf):
        state.apply(batch)
    return state


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    s = strong(build(spark, sf).scores())
    return s.select(F.col("grp").alias("species_id"), F.col("a").alias("category_a"), F.col("b").alias("category_b"))


def p1_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = build(spark, sf).scores()
    return s.select(F.col("grp").alias("species_id"), F.col("a").alias("category_a"), F.col("b").alias("category_b"), "nab", "na", "nb", "n", F.round("lift", 6).alias("lift"))


def p1_changed(spark: SparkSession, sf: str) -> DataFrame:
    """The scores that the second batch, late rows, has changed, from the state opened again: species with a changed image, and ``all``."""
    early, late = _batches(spark, sf)
    state = PairTable(spark, T.LongType(), T.IntegerType())
    state.apply(early).rescore()
    state = PairTable(spark, T.LongType(), T.IntegerType(), path=state.path).apply(late)
    s = state.scores(only_changed=True)
    return s.select(F.col("grp").alias("species_id"), F.col("a").alias("category_a"), F.col("b").alias("category_b"), "nab", "na", "nb", "n")


_BASE = r"""
WITH r AS (
  SELECT DISTINCT image_id, category_id, species_id, coalesce(ingested_at > annotated_at + INTERVAL 7 DAY, false) AS late,
    try_cast(nullif(regexp_extract(trim(regexp_extract(image_name, '([^/\\]*)$', 1)), '^(\d+)\s*[-_]', 1), '') AS BIGINT) AS pre,
    CASE WHEN species_id IS NULL OR lower(trim(species_id)) IN ('', 'nan') THEN NULL
         ELSE try_cast(nullif(regexp_extract(trim(species_id), '^0*(\d+?)(?:\.0*)?$', 1), '') AS BIGINT) END AS own
  FROM per_annotation_features WHERE category_id BETWEEN 1 AND 14 AND image_id IS NOT NULL),
nr AS (SELECT image_id, coalesce(min(own), min(pre)) AS sp FROM r GROUP BY 1),
img AS (SELECT image_id, CASE WHEN sp > 999 THEN CAST(sp AS VARCHAR) ELSE lpad(CAST(sp AS VARCHAR), 4, '0') END AS sp FROM nr),
c AS (SELECT DISTINCT r.image_id, img.sp, r.category_id AS cat FROM r JOIN img USING (image_id)),
g AS (SELECT image_id, sp AS grp, cat FROM c WHERE sp IS NOT NULL UNION ALL SELECT image_id, 'all', cat FROM c),
n AS (SELECT grp, count(DISTINCT image_id) AS n FROM g GROUP BY 1),
m AS (SELECT grp, cat, count(*) AS nx FROM g GROUP BY 1, 2),
p AS (SELECT x.grp, x.cat AS a, y.cat AS b, count(*) AS nab
      FROM g x JOIN g y ON x.grp = y.grp AND x.image_id = y.image_id AND x.cat < y.cat GROUP BY 1, 2, 3),
s AS (SELECT p.grp AS species_id, p.a AS category_a, p.b AS category_b, p.nab, ma.nx AS na, mb.nx AS nb, n.n
      FROM p JOIN n ON n.grp = p.grp JOIN m ma ON ma.grp = p.grp AND ma.cat = p.a JOIN m mb ON mb.grp = p.grp AND mb.cat = p.b)
"""

QUERIES = {"p1_found": p1_found, "p1_pair_scores": p1_pair_scores, "p1_changed": p1_changed}
SQL = {
    "p1_found": _BASE + "SELECT species_id, category_a, category_b FROM s WHERE nab >= 8 AND 2 * nab * n >= 3 * na * nb",
    "p1_pair_scores": _BASE + "SELECT species_id, category_a, category_b, nab, na, nb, n, round(CAST(nab AS DOUBLE) * n / (CAST(na AS DOUBLE) * nb), 6) AS lift FROM s",
    "p1_changed": _BASE
    + """, w AS (SELECT image_id, coalesce(min(own), min(pre)) AS sp, coalesce(min(own) FILTER (NOT late), min(pre) FILTER (NOT late)) AS old,
  count(DISTINCT category_id) <> count(DISTINCT category_id) FILTER (NOT late) OR coalesce(min(own), min(pre)) IS DISTINCT FROM coalesce(min(own) FILTER (NOT late), min(pre) FILTER (NOT late)) AS new FROM r GROUP BY 1),
ch AS (SELECT DISTINCT lpad(CAST(x AS VARCHAR), CAST(greatest(4, length(CAST(x AS VARCHAR))) AS INT), '0') AS g FROM (SELECT sp AS x FROM w WHERE new UNION ALL SELECT old FROM w WHERE new) WHERE x IS NOT NULL)
SELECT species_id, category_a, category_b, nab, na, nb, n FROM s WHERE species_id IN (SELECT g FROM ch) OR (species_id = 'all' AND EXISTS (SELECT 1 FROM w WHERE new))""",
}
