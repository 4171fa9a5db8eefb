"""Queries of problems 4 and 5: nested exports and references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import raster
from ..functions.species import absent, composed_name, id_number
from ..operators import nested as N
from ..operators import references as X

_LINKS = tuple(t for t in N.COCO if t.tag in ("image", "annotation"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The links of the tables that ``_tables`` has written."""
    t = N.links(N.read_links(spark, _tables(spark, sf)))
    return t.select(F.col("doc_id").alias("export_id"), F.col("tag").alias("child_kind"), F.col("parent").alias("parent_id"), F.col("pk").alias("child_id"))


def _tables(spark: SparkSession, sf: str) -> str:
    raw = spark.read.parquet(f"{sf}/coco_raw.parquet")
    return N.write_tables(N.flatten(raw, "export_id", "payload"))


def p5_images(spark: SparkSession, sf: str) -> DataFrame:
    t = N.read_table(spark, _tables(spark, sf), "image", "file_name string, width int, height int, _species string, _split string")
    return t.select(F.col("doc_id").alias("export_id"), F.expr("try_cast(pk as bigint)").alias("image_id"), "o.file_name", "o.width", "o.height", F.col("o._species").alias("species"), F.col("o._split").alias("split")).distinct()


def p5_annotations(spark: SparkSession, sf: str) -> DataFrame:
    t = N.read_table(spark, _tables(spark, sf), "annotation", "category_id int, area double, iscrowd int, score double, bbox array<double>")
    box = [F.get("o.bbox", F.lit(i)).alias(c) for i, c in enumerate(("bbox_x", "bbox_y", "bbox_w", "bbox_h"))]
    return t.select(F.col("doc_id").alias("export_id"), F.expr("try_cast(parent as bigint)").alias("image_id"), F.expr("try_cast(pk as bigint)").alias("annotation_id"), "o.category_id", "o.area", "o.iscrowd", "o.score", *box).distinct()


def p5_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons with their points; run-length objects with the outlines of their mask."""
    t = N.read_table(spark, _tables(spark, sf), "segment")
    rle = F.col("payload").startswith("{")
    t = t.select("doc_id", "parent", "pk", F.when(rle, "rle").otherwise("polygon").alias("form"), F.when(~rle, F.from_json("payload", "array<double>")).alias("points"), F.when(rle, F.col("payload")).alias("rle")).distinct()
    outlines = F.when(F.col("rle").isNotNull(), raster.rle_parts("rle")).otherwise(F.array("points"))
    return t.select(F.col("doc_id").alias("export_id"), F.expr("try_cast(parent as bigint)").alias("annotation_id"), F.expr("try_cast(pk as bigint)").alias("position"), "form", outlines.alias("outlines"))


def p5_segment_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Form and number of coordinates of every segment given as a polygon."""
    t = p5_segments(spark, sf).where("form = 'polygon' and annotation_id is not null")
    return t.select("export_id", "annotation_id", "position", F.size(F.get("outlines", F.lit(0))).cast("long").alias("coordinates")).distinct()


def _references(spark: SparkSession, sf: str) -> tuple[list[X.Reference], list[X.Child]]:
    sp = spark.read.parquet(f"{sf}/especies.parquet")
    life = dict(created=F.col("created_at"), deleted=F.col("deleted_at"))
    by_id = R.pick(sp, value=F.when(~absent(F.col("species_id")), id_number(F.col("species_id"))), **life)
    by_name = R.pick(sp, value=composed_name(F.col("species_name")), **life)
    ft = spark.read.parquet(f"{sf}/features_por_imagen.parquet").select("image_id", "species_id", "species_name", "updated_at")
    key = dict(row_key=F.col("image_id"), time=F.col("updated_at"))
    # an id that is no number refers to nothing that exists: it gets a number that no species has
    number = F.when(absent(F.col("species_id")), F.lit(None)).otherwise(F.coalesce(id_number(F.col("species_id")), F.lit(-1)))
    refs = [
        X.Reference("features_por_imagen", "species_id", R.pick(ft, value=number, **key), by_id),
        X.Reference("features_por_imagen", "species_name", R.pick(ft, value=composed_name(F.col("species_name")), **key), by_name),
    ]
    raw = spark.read.parquet(f"{sf}/coco_raw.parquet")
    path = N.write_tables(N.flatten(raw, "export_id", "payload", spec=_LINKS, payload=False))
    at = raw.select(F.col("export_id").alias("doc_id"), "exported_at").distinct()
    images = N.read_table(spark, path, "image").where("pk is not null").select("doc_id", "pk").join(at, "doc_id")
    images = images.groupBy(F.col("pk").alias("value")).agg(F.min("exported_at").alias("created")).withColumn("deleted", F.lit(None).cast("timestamp_ntz"))
    notes = N.read_table(spark, path, "annotation").join(at, "doc_id")
    notes = notes.select(F.expr("try_cast(pk as bigint)").alias("row_key"), F.col("parent").alias("value"), F.col("exported_at").alias("time"))
    refs.append(X.Reference("coco_raw", "image_id", notes, images))
    below = notes.select("row_key", F.expr("try_cast(value as bigint)").alias("parent_key"), "time")
    parts = N.read_table(spark, path, "segment").join(at, "doc_id")
    # a segment's key is its annotation's with its position behind it
    of = F.expr("try_cast(parent as bigint)")
    segments = parts.select(of.alias("parent_key"), (of * 1000000 + F.expr("try_cast(pk as bigint)")).alias("row_key"), F.col("exported_at").alias("time"))
    return refs, [X.Child("coco_raw", "image_id", "features_por_imagen", below), X.Child("segments", "annotation_id", "coco_raw", segments)]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    t = X.cascade(*_references(spark, sf)).where("level = 0")
    return t.select("ref_table", "ref_field", "row_key", "state", F.date_format("time", "yyyy-MM").alias("period")).distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return X.by_period(X.cascade(*_references(spark, sf)))


_DOC = r"""
WITH p AS (SELECT DISTINCT export_id, exported_at, CASE WHEN payload[1] = chr(65279) THEN payload[2:] ELSE payload END AS s FROM coco_raw),
v AS (SELECT export_id, exported_at, CAST(s AS JSON) AS j FROM p WHERE json_valid(s)),
d AS (SELECT export_id, exported_at, CASE WHEN json_exists(j, '$.images') OR json_exists(j, '$.annotations') OR json_exists(j, '$.categories') THEN j
        ELSE list_filter(json_extract(j, '$.*'), lambda x: json_exists(x, '$.images') OR json_exists(x, '$.annotations'))[1] END AS j FROM v),
im AS (SELECT export_id, exported_at, unnest(CASE WHEN json_type(j, '$.images') = 'ARRAY' THEN json_extract(j, '$.images[*]') END) AS o FROM d),
ca AS (SELECT export_id, unnest(CASE WHEN json_type(j, '$.categories') = 'ARRAY' THEN json_extract(j, '$.categories[*]') END) AS o FROM d),
an AS (SELECT export_id, exported_at, unnest(CASE WHEN json_type(j, '$.annotations') = 'ARRAY' THEN json_extract(j, '$.annotations[*]') END) AS o FROM d)
"""
_ID = "try_cast(json_extract_string(o, '$.{}') AS BIGINT)"

_P5 = (
    _DOC
    + f""", sg AS (SELECT export_id, {_ID.format("id")} AS a, json_extract(o, '$.segmentation') AS s, json_type(o, '$.segmentation') AS t FROM an),
lk AS (
  SELECT export_id, 'category' AS child_kind, export_id AS parent_id, {_ID.format("id")} AS child_id FROM ca
  UNION ALL SELECT export_id, 'image', export_id, {_ID.format("id")} FROM im
  UNION ALL SELECT export_id, 'annotation', {_ID.format("image_id")}, {_ID.format("id")} FROM an
  UNION ALL SELECT export_id, 'segment', a, 0 FROM sg WHERE t = 'OBJECT' OR (t = 'ARRAY' AND json_type(s, '$[0]') NOT IN ('ARRAY', 'OBJECT'))
  UNION ALL SELECT export_id, 'segment', a, unnest(range(CAST(json_array_length(s) AS BIGINT))) FROM sg WHERE t = 'ARRAY' AND json_type(s, '$[0]') = 'ARRAY')
SELECT DISTINCT export_id, child_kind, parent_id, child_id FROM lk WHERE parent_id IS NOT NULL AND child_id IS NOT NULL"""
)

_NAME = "trim(regexp_replace(nfc_normalize({}), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_NUM = "try_cast(nullif(regexp_extract(trim({}), '^0*(\\d+?)(?:\\.0*)?$', 1), '') AS BIGINT)"
_ORPHANS = (
    _DOC
    + f""", sp AS (SELECT {_NUM.format("species_id")} AS id, {_NAME.format("species_name")} AS nm, created_at, deleted_at FROM especies),
f AS (SELECT DISTINCT image_id, species_id, {_NAME.format("species_name")} AS nm, updated_at FROM features_por_imagen),
fs AS (SELECT DISTINCT image_id AS k, coalesce({_NUM.format("species_id")}, -1) AS v, updated_at AS t FROM f WHERE species_id IS NOT NULL AND lower(trim(species_id)) NOT IN ('', 'nan')),
fn AS (SELECT DISTINCT image_id AS k, nm AS v, updated_at AS t FROM f WHERE nm IS NOT NULL AND lower(nm) NOT IN ('', 'nan')),
ai AS (SELECT {_ID.format("id")} AS i, min(exported_at) AS created FROM im GROUP BY 1),
ar AS (SELECT DISTINCT {_ID.format("id")} AS k, {_ID.format("image_id")} AS v, exported_at AS t FROM an WHERE json_extract_string(o, '$.image_id') IS NOT NULL),
dir AS (
  SELECT 'features_por_imagen' AS ref_table, 'species_id' AS ref_field, k AS row_key, t,
    CASE WHEN sp.id IS NULL THEN 'missing' WHEN deleted_at <= t THEN 'deleted' WHEN created_at > t THEN 'late' END AS state FROM fs LEFT JOIN sp ON sp.id = fs.v
  UNION ALL SELECT 'features_por_imagen', 'species_name', k, t,
    CASE WHEN sp.nm IS NULL THEN 'missing' WHEN deleted_at <= t THEN 'deleted' WHEN created_at > t THEN 'late' END FROM fn LEFT JOIN sp ON sp.nm = fn.v
  UNION ALL SELECT 'coco_raw', 'image_id', k, t, CASE WHEN ai.i IS NULL THEN 'missing' WHEN created > t THEN 'late' END FROM ar LEFT JOIN ai ON ai.i = ar.v)
"""
)

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_images": p5_images, "p5_annotations": p5_annotations, "p5_segments": p5_segments, "p5_segment_sizes": p5_segment_sizes}
SQL = {
    "p4_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_field, row_key, state, strftime(t, '%Y-%m') AS period FROM dir WHERE state IS NOT NULL",
    "p4_report": _ORPHANS
    + f""", o AS (SELECT DISTINCT * FROM dir WHERE state IS NOT NULL),
inh AS (SELECT DISTINCT ar.k, ar.t FROM ar WHERE v IN (SELECT row_key FROM o WHERE ref_table = 'features_por_imagen') AND k NOT IN (SELECT row_key FROM o WHERE ref_table = 'coco_raw')),
sg AS (SELECT {_ID.format("id")} AS a, exported_at AS t, json_extract(o, '$.segmentation') AS s, json_type(o, '$.segmentation') AS f FROM an),
sk AS (SELECT DISTINCT a, p, t FROM (SELECT a, t, 0 AS p FROM sg WHERE f = 'OBJECT' OR (f = 'ARRAY' AND json_type(s, '$[0]') NOT IN ('ARRAY', 'OBJECT'))
   UNION ALL SELECT a, t, unnest(range(CAST(json_array_length(s) AS BIGINT))) FROM sg WHERE f = 'ARRAY' AND json_type(s, '$[0]') = 'ARRAY') WHERE a IS NOT NULL),
si AS (SELECT DISTINCT a, p, t FROM sk WHERE a IN (SELECT row_key FROM o WHERE ref_table = 'coco_raw' UNION SELECT k FROM inh)),
u AS (SELECT ref_table, ref_field, state, t, 1 AS d FROM o UNION ALL SELECT 'coco_raw', 'image_id', 'inherited', t, 0 FROM inh UNION ALL SELECT 'segments', 'annotation_id', 'inherited', t, 0 FROM si)
SELECT ref_table, ref_field, state, strftime(t, '%Y-%m') AS period, CAST(sum(d) AS BIGINT) AS n_direct, CAST(sum(1 - d) AS BIGINT) AS n_inherited FROM u GROUP BY 1, 2, 3, 4""",
    "p5_found": _P5,
    "p5_segment_sizes": _DOC
    + f""", sg AS (SELECT export_id, {_ID.format("id")} AS a, json_extract(o, '$.segmentation') AS s, json_type(o, '$.segmentation') AS t FROM an)
SELECT DISTINCT export_id, a AS annotation_id, position, n AS coordinates FROM (
  SELECT export_id, a, 0 AS position, CAST(json_array_length(s) AS BIGINT) AS n FROM sg WHERE t = 'ARRAY' AND json_type(s, '$[0]') NOT IN ('ARRAY', 'OBJECT')
  UNION ALL SELECT export_id, a, i AS position, CAST(json_array_length(s, '$[' || i || ']') AS BIGINT) FROM (SELECT *, unnest(range(CAST(json_array_length(s) AS BIGINT))) AS i FROM sg WHERE t = 'ARRAY' AND json_type(s, '$[0]') = 'ARRAY')) WHERE a IS NOT NULL AND n > 0""",
    "p5_images": _DOC + f"SELECT DISTINCT export_id, {_ID.format('id')} AS image_id, o->>'$.file_name' AS file_name, CAST(o->>'$.width' AS INT) AS width, CAST(o->>'$.height' AS INT) AS height, o->>'$._species' AS species, o->>'$._split' AS split FROM im",
    "p5_annotations": _DOC
    + f"SELECT DISTINCT export_id, {_ID.format('image_id')} AS image_id, {_ID.format('id')} AS annotation_id, CAST(o->>'$.category_id' AS INT) AS category_id, CAST(o->>'$.area' AS DOUBLE) AS area, CAST(o->>'$.iscrowd' AS INT) AS iscrowd, CAST(o->>'$.score' AS DOUBLE) AS score, CAST(o->>'$.bbox[0]' AS DOUBLE) AS bbox_x, CAST(o->>'$.bbox[1]' AS DOUBLE) AS bbox_y, CAST(o->>'$.bbox[2]' AS DOUBLE) AS bbox_w, CAST(o->>'$.bbox[3]' AS DOUBLE) AS bbox_h FROM an",
}
