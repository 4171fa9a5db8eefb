"""Queries of problem 3 over relative_feature_vectors, sample_targets and split_coverage_report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.species import absent, four_digits, id_number, name_prefix
from .. import runtime as R
from . import sampling as S

CLASSES = ("5", "13", "22", "45", "61", "66", "72", "76", "77", "78", "93", "98", "vx", "rad")
LABELS = [f"feat_{c}" for c in CLASSES]


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """(key, grp, mask): each photograph once, with its species and its classes as bits."""
    t = spark.read.parquet(f"{sf}/relative_feature_vectors.parquet")
    mask = sum((F.when(F.col(f"count_feat_{c}") > 0, 1 << i).otherwise(0) for i, c in enumerate(CLASSES)), F.lit(0))
    t = t.where(F.col("image_path").isNotNull())
    name = F.coalesce(F.col("image_name"), F.col("image_path"))
    own = F.when(~absent(F.col("species_id")), id_number(F.col("species_id")))
    t = t.select(F.translate("image_path", "\\", "/").alias("key"), own.alias("own"), name_prefix(name).alias("prefix"), mask.cast("int").alias("mask"))
    species = four_digits(F.coalesce(F.min("own"), F.min("prefix")))
    return t.groupBy("key").agg(species.alias("grp"), F.bit_or("mask").alias("mask"))


def targets(spark: SparkSession, sf: str) -> list[S.Target]:
    """The two small target tables (a fixed number of rows)."""
    rows = spark.read.parquet(f"{sf}/sample_targets.parquet").distinct().collect()
    report = {r["split"]: r for r in spark.read.parquet(f"{sf}/split_coverage_report.parquet").collect()}
    out = []
    for split in sorted({r["split"] for r in rows}):
        own = [r for r in rows if r["split"] == split]
        size = own[0]["sample_size"]
        rep, labels = report.get(split), [0] * len(LABELS)
        if rep is not None and rep["images"]:
            for i, name in enumerate(LABELS):
                per = (rep["per_class"] or {}).get(name)
                labels[i] = -(-per["images_with_class"] * size // rep["images"]) if per else 0
        groups = {r["species_id"]: (r["target_share_bp"], r["min_images"] or 0) for r in sorted(own, key=lambda r: r["species_id"])}
        out.append(S.Target(split, size, groups, tuple(labels), fill=True))
    return out


def _state(spark: SparkSession, sf: str):
    t = targets(spark, sf)
    state = R.written(S.reservoirs(photos(spark, sf), t), "reservoirs")
    return t, state, S.cell_counts(state)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    t, _, cells = _state(spark, sf)
    rows = [r[:3] for r in S.exhausted(cells, LABELS, t)]
    return spark.createDataFrame(rows, "split string, category_kind string, category_key string")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn photographs of val and test."""
    t, state, cells = _state(spark, sf)
    return S.draw(state, S.plans(cells, t), t).select("split", F.col("key").alias("image_path"), F.col("grp").alias("species_id"), "mask")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted, available and drawn photographs per split and category, and why a target is not met.

    ``reason``: ``supply`` if all photographs together do not suffice, ``species`` if the species' numbers, which
    come first, leave no more than ``attainable`` of a class, ``other classes`` if these stand against it.
    """
    t, state, cells = _state(spark, sf)
    plan = S.plans(cells, t)
    s = R.written(S.draw(state, plan, t), "sample")
    have = s.groupBy("split", F.lit("species").alias("category_kind"), F.col("grp").alias("category_key")).agg(F.count(F.lit(1)).alias("drawn"))
    bits = F.explode(F.array(*[F.struct(F.lit(n).alias("category_key"), F.col("mask").bitwiseAND(1 << i).cast("boolean").alias("on")) for i, n in enumerate(LABELS)])).alias("b")
    per = s.select("split", bits).where("b.on").groupBy("split", F.lit("class").alias("category_kind"), "b.category_key").agg(F.count(F.lit(1)).alias("drawn"))
    want = spark.createDataFrame(S.report(cells, LABELS, t, plan), "split string, category_kind string, category_key string, wanted long, available long, attainable long")
    size = spark.createDataFrame([(x.split, x.size) for x in t], "split string, sample_size int")
    want = want.join(size, "split").join(s.groupBy("split").agg(F.count(F.lit(1)).alias("sample_drawn")), "split", "left")
    out = want.join(have.unionByName(per), ["split", "category_kind", "category_key"], "left").na.fill(0, ["drawn"])
    out = out.withColumns({"exhausted": F.col("available") < F.col("wanted"), "unmet": F.col("drawn") < F.col("wanted")})
    reason = F.when(~F.col("unmet"), None).when(F.col("exhausted"), "supply").when(F.col("attainable") < F.col("wanted"), "species").otherwise("other classes")
    return out.withColumns({"reason": reason, "target_share": F.round(F.col("wanted") / F.col("sample_size"), 6), "drawn_share": F.round(F.col("drawn") / F.col("sample_drawn"), 6)})


def p3_targets(spark: SparkSession, sf: str) -> DataFrame:
    """All targets with what there is of each and, for species, whether the sample meets them as far as there is enough."""
    t = p3_report(spark, sf)
    kept = (F.col("category_kind") == "class") | (F.col("drawn") >= F.least("wanted", "available"))
    return t.select("split", "category_kind", "category_key", "wanted", "available", "exhausted", kept.alias("species_kept"), (F.col("sample_drawn") == F.col("sample_size")).alias("whole_size"))


_OWN = r"CASE WHEN species_id IS NULL OR lower(trim(species_id)) IN ('', 'nan') THEN NULL ELSE try_cast(nullif(regexp_extract(trim(species_id), '^0*(\d+?)(?:\.0*)?$', 1), '') AS BIGINT) END"
_PRE = r"try_cast(nullif(regexp_extract(trim(regexp_extract(coalesce(image_name, image_path), '([^/\\]*)$', 1)), '^(\d+)\s*[-_]', 1), '') AS BIGINT)"
_BASE = rf"""
WITH r AS (SELECT replace(image_path, '\', '/') AS key, {_OWN} AS own, {_PRE} AS pre, {", ".join(f"count_feat_{c} AS c{i}" for i, c in enumerate(CLASSES))}
           FROM relative_feature_vectors WHERE image_path IS NOT NULL),
q AS (SELECT key, coalesce(min(own), min(pre)) AS sp, {", ".join(f"max(c{i}) AS c{i}" for i in range(14))} FROM r GROUP BY key),
p AS (SELECT * REPLACE (lpad(CAST(sp AS VARCHAR), CAST(greatest(4, length(CAST(sp AS VARCHAR))) AS INT), '0') AS sp) FROM q),
n AS (SELECT sp, count(*) AS n FROM p GROUP BY 1),
k AS ({" UNION ALL ".join(f"SELECT 'feat_{c}' AS cls, count(*) FILTER (c{i} > 0) AS n FROM p" for i, c in enumerate(CLASSES))}),
w AS (SELECT DISTINCT split, 'species' AS category_kind, species_id AS category_key,
        greatest(coalesce(min_images, 0), (CAST(target_share_bp AS BIGINT) * sample_size + 5000) // 10000) AS wanted FROM sample_targets
      UNION ALL SELECT split, 'class', cls, (CAST(r.per_class[cls].images_with_class AS BIGINT) * s.sample_size + r.images - 1) // r.images
      FROM (SELECT DISTINCT split, sample_size FROM sample_targets) s JOIN split_coverage_report r USING (split), (SELECT cls FROM k)),
a AS (SELECT w.*, coalesce(CASE WHEN category_kind = 'species' THEN (SELECT n FROM n WHERE n.sp = w.category_key) ELSE (SELECT n FROM k WHERE k.cls = w.category_key) END, 0) AS available FROM w)
"""
QUERIES = {"p3_found": p3_found, "p3_sample": p3_sample, "p3_report": p3_report, "p3_targets": p3_targets}
SQL = {
    "p3_targets": _BASE + "SELECT split, category_kind, category_key, wanted, available, available < wanted AS exhausted, true AS species_kept, true AS whole_size FROM a","p3_found": _BASE + "SELECT split, category_kind, category_key FROM a WHERE available < wanted"}
