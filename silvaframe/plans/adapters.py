"""The domain's frames from the test tables, for Spark and, as CTEs, for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import geometry as G
from ..functions import raster
from ..functions.species import species_of
from ..operators import nested as N

#: The trait classes by category id 1..14.
CLASSES = ("5", "13", "22", "45", "61", "66", "72", "76", "77", "78", "93", "98", "vx", "rad")
IDS = list(range(1, 15))
MEASURES = ("area_frac", "log_area", "sphericity", "log_aspect", "log_elong", "bbox_extent")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def images(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, species_id (four digits or null), img_area, file_name."""
    t = table(spark, sf, "features_por_imagen").where("image_id is not null")
    t = t.select("image_id", species_of(F.col("species_id"), F.col("file_name")).alias("species_id"), "img_area", "file_name")
    return t.groupBy("image_id").agg(F.min("species_id").alias("species_id"), F.max("img_area").alias("img_area"), F.min("file_name").alias("file_name"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """annotation_id, image_id, class_id and the shape measures (NaN as null), known classes only."""
    t = table(spark, sf, "per_annotation_features").where(F.col("category_id").between(1, 14) & F.col("image_id").isNotNull())
    clean = [F.when(~F.isnan(m), F.col(m)).alias(m) for m in MEASURES]
    # by image first: the removal of doubled rows and what follows per image share this one shuffle
    return t.select("annotation_id", "image_id", F.col("category_id").alias("class_id"), *clean).repartition("image_id").distinct()


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in zip(IDS, CLASSES, strict=True)], "class_id int, name string")


def polygons(spark: SparkSession, sf: str, masks: bool = False) -> DataFrame:
    """annotation_id, image_id, class_id, kind, parts, points (the largest part), width, height of the exports' annotations.

    ``masks`` adds ``outlines``: all valid parts, and those of the mask where an annotation is run-length encoded.
    """
    raw = table(spark, sf, "coco_raw")
    path = N.write_tables(N.flatten(raw, "export_id", "payload", spec=(N.COCO[1], N.Table("annotation", "annotations", parent_field="image_id"))))
    kind = raw.select(F.col("export_id").alias("doc_id"), "kind").distinct()
    a = N.read_table(spark, path, "annotation", "category_id int, segmentation string, score double").join(kind, "doc_id")
    seg = F.col("o.segmentation")
    many, flat = F.from_json(seg, "array<array<double>>"), F.from_json(seg, "array<double>")
    parts = F.when(seg.startswith("[["), many).when(seg.rlike(r"^\[\s*[-0-9]"), F.array(flat)).otherwise(F.array().cast("array<array<double>>"))
    a = a.select(F.expr("try_cast(pk as bigint)").alias("annotation_id"), F.expr("try_cast(parent as bigint)").alias("image_id"), F.col("o.category_id").alias("class_id"), "kind", parts.alias("parts"), F.when(seg.startswith("{"), seg).alias("rle"), F.col("o.score").alias("score")).where("annotation_id is not null").distinct()
    outlines = F.when(F.col("rle").isNotNull(), raster.rle_parts("rle")).otherwise(G.multipart(F.col("parts"), "split"))
    im = N.read_table(spark, path, "image", "width int, height int")
    im = im.groupBy(F.expr("try_cast(pk as bigint)").alias("image_id")).agg(F.max("o.width").alias("width"), F.max("o.height").alias("height"))
    # written once: filters on the points would else be pushed below and repeat the parsing
    a = a.withColumns({"points": G.largest(F.col("parts")), **({"outlines": outlines} if masks else {})}).drop("rle")
    return R.written(a.join(im, "image_id", "left"), "polygons")


_SP = r"CASE WHEN species_id IS NULL OR lower(trim(species_id)) IN ('', 'nan') THEN NULL ELSE try_cast(nullif(regexp_extract(trim(species_id), '^0*(\d+?)(?:\.0*)?$', 1), '') AS BIGINT) END"
_PRE = r"try_cast(nullif(regexp_extract(trim(regexp_extract({}, '([^/\\]*)$', 1)), '^(\d+)\s*[-_]', 1), '') AS BIGINT)"


def sql_species(name: str) -> str:
    s = f"CAST(coalesce({_SP}, {_PRE.format(name)}) AS VARCHAR)"
    return f"CASE WHEN length({s}) >= 4 THEN {s} ELSE lpad({s}, 4, '0') END"


IMG = f"""img AS (SELECT image_id, min(sp) AS species_id, max(img_area) AS img_area, min(file_name) AS file_name
  FROM (SELECT image_id, img_area, file_name, {sql_species("file_name")} AS sp FROM features_por_imagen WHERE image_id IS NOT NULL) GROUP BY 1)"""
ANN = "ann AS (SELECT DISTINCT annotation_id, image_id, category_id AS class_id, " + ", ".join(f"CASE WHEN isnan({m}) THEN NULL ELSE {m} END AS {m}" for m in MEASURES) + " FROM per_annotation_features WHERE category_id BETWEEN 1 AND 14 AND image_id IS NOT NULL)"
CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in zip(IDS, CLASSES, strict=True)) + ") t(class_id, name))"
BASE = f"WITH {IMG}, {ANN}, {CAT}"

#: Polygons of the exports: poly(annotation_id, image_id, class_id, kind, parts, points, width, height).
POLY = r"""
p0 AS (SELECT DISTINCT export_id, kind, CASE WHEN payload[1] = chr(65279) THEN payload[2:] ELSE payload END AS s FROM coco_raw),
v0 AS (SELECT export_id, kind, CAST(s AS JSON) AS j FROM p0 WHERE json_valid(s)),
d0 AS (SELECT export_id, kind, CASE WHEN json_exists(j, '$.images') OR json_exists(j, '$.annotations') OR json_exists(j, '$.categories') THEN j
        ELSE list_filter(json_extract(j, '$.*'), lambda x: json_exists(x, '$.images') OR json_exists(x, '$.annotations'))[1] END AS j FROM v0),
i0 AS (SELECT unnest(CASE WHEN json_type(j, '$.images') = 'ARRAY' THEN json_extract(j, '$.images[*]') END) AS o FROM d0),
a0 AS (SELECT kind, unnest(CASE WHEN json_type(j, '$.annotations') = 'ARRAY' THEN json_extract(j, '$.annotations[*]') END) AS o FROM d0),
im0 AS (SELECT try_cast(o->>'$.id' AS BIGINT) AS image_id, max(CAST(o->>'$.width' AS INT)) AS width, max(CAST(o->>'$.height' AS INT)) AS height FROM i0 GROUP BY 1),
a1 AS (SELECT DISTINCT try_cast(o->>'$.id' AS BIGINT) AS annotation_id, try_cast(o->>'$.image_id' AS BIGINT) AS image_id, CAST(o->>'$.category_id' AS INT) AS class_id, kind, CAST(o->>'$.score' AS DOUBLE) AS score,
   CASE WHEN json_type(o, '$.segmentation') <> 'ARRAY' THEN CAST([] AS DOUBLE[][])
        WHEN json_type(o, '$.segmentation[0]') = 'ARRAY' THEN CAST(json_extract(o, '$.segmentation') AS DOUBLE[][])
        WHEN json_array_length(o, '$.segmentation') > 0 THEN [CAST(json_extract(o, '$.segmentation') AS DOUBLE[])]
        ELSE CAST([] AS DOUBLE[][]) END AS parts FROM a0 WHERE try_cast(o->>'$.id' AS BIGINT) IS NOT NULL),
a2 AS (SELECT annotation_id, image_id, class_id, kind, score, coalesce(parts, []) AS parts FROM a1),
q0 AS (SELECT annotation_id, kind, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM a2),
q1 AS (SELECT annotation_id, kind, p, i, abs(0.5 * list_sum(list_transform(range(CAST(len(p) // 2 AS BIGINT)), lambda k: p[2*k+1] * p[2*((k+1) % (len(p) // 2))+2] - p[2*((k+1) % (len(p) // 2))+1] * p[2*k+2]))) AS ar
   FROM q0 WHERE len(p) >= 6 AND len(p) % 2 = 0),
q2 AS (SELECT annotation_id, kind, p, row_number() OVER (PARTITION BY annotation_id, kind ORDER BY ar DESC, i) AS rn FROM q1),
poly AS (SELECT a2.annotation_id, a2.image_id, a2.class_id, a2.kind, a2.score, a2.parts, q2.p AS points, im0.width, im0.height
   FROM a2 LEFT JOIN q2 ON q2.annotation_id = a2.annotation_id AND q2.kind = a2.kind AND q2.rn = 1 LEFT JOIN im0 ON im0.image_id = a2.image_id)"""


def edges(term: str) -> str:
    """SQL sum over a polygon's edges; the term has x, y and the next u, v."""
    n = "(len(points) // 2)"
    at = {"x": "points[2*k+1]", "y": "points[2*k+2]", "u": f"points[2*((k+1) % {n})+1]", "v": f"points[2*((k+1) % {n})+2]"}
    out = "".join(at.get(ch, ch) for ch in term)
    return f"list_sum(list_transform(range(CAST(len(points) // 2 AS BIGINT)), lambda k: {out}))"


XS = "list_filter(points, lambda e, i: i % 2 = 1)"
YS = "list_filter(points, lambda e, i: i % 2 = 0)"
AREA = "abs(0.5 * " + edges("x*v-u*y") + ")"
PERIMETER = edges("((u-x)**2+(v-y)**2)**0.5")
