"""Queries of the string and geometry functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vectors as V
from . import adapters as A


def species_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    """FN-1 .. FN-4, FN-6 on the photographs' paths."""
    t = A.table(spark, sf, "train").select("image_path", "image_name").distinct()
    p, n = F.col("image_path"), F.col("image_name")
    return t.select("image_path", "image_name", X.species_token(p).alias("token"), X.species_token_loose(n).alias("loose"), X.species_token_strict(n).alias("strict"), X.leading_digits(n).alias("digits"), X.slashes(p).alias("path"))


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """FN-5 on species names."""
    return A.table(spark, sf, "especies").select("species_id", X.safe_name(F.col("species_name")).alias("column_name"))


def norm_names(spark: SparkSession, sf: str) -> DataFrame:
    """FN-7: names after Unicode composition and with plain blanks."""
    return A.table(spark, sf, "features_por_imagen").select("image_id", X.composed_name(F.col("species_name")).alias("name")).distinct()


def genus(spark: SparkSession, sf: str) -> DataFrame:
    """FN-8, FN-11: slug, genus and binomial of a name."""
    n = X.composed_name(F.col("species_name"))
    t = A.table(spark, sf, "especies").select("species_id", n.alias("n"))
    return t.select("species_id", X.slug(F.col("n")).alias("slug"), X.genus(F.col("n")).alias("genus"), X.binomial(F.col("n")).alias("binomial"))


def id_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """FN-9, FN-10: ids in four digits and without zeros, with the catalogue's name or a made-up one."""
    t = A.table(spark, sf, "features_por_imagen").select("image_id", X.canonical_id(F.col("species_id")).alias("id")).distinct()
    sp = A.table(spark, sf, "especies").select(F.col("species_id").alias("id"), X.composed_name(F.col("species_name")).alias("n"))
    return t.join(sp, "id", "left").select("image_id", F.col("id").alias("species_id"), X.short_id(F.col("id")).alias("short"), X.default_name(F.col("n"), F.col("id")).alias("name"))


def list_cell(spark: SparkSession, sf: str) -> DataFrame:
    """FN-12, FN-13: lists in a cell, on names with commas and on task names."""
    t = A.table(spark, sf, "especies").select("species_id", "species_name")
    cell = F.concat(F.lit("['"), F.translate("species_name", "'", ""), F.lit("'; "), F.col("species_id"), F.lit("]"))
    task = X.task_parts(F.concat_ws(" ", "species_id", "species_name"))
    return t.select("species_id", F.array_join(X.list_cell(cell), "/").alias("parts"), task["species_id"].alias("task_id"), task["rest"].alias("task_rest"))


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    """FN-37 .. FN-39 on counts per species."""
    n = A.images(spark, sf).where("species_id is not null").groupBy("species_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("species_id", "n", V.reliability(F.col("n")).alias("reliability"), V.seed_quota(F.col("n")).cast("int").alias("quota"), F.round(V.weight_schedule(F.col("n"), 0.5), 6).alias("weight"))


def _polys(spark: SparkSession, sf: str) -> DataFrame:
    return A.polygons(spark, sf).where("points is not null")


def poly_area(spark: SparkSession, sf: str) -> DataFrame:
    """FN-20, FN-21, FN-24: area, perimeter, centre and box of the largest part."""
    p = F.col("points")
    c, b = G.centroid(p), G.box(p)
    r = lambda x: F.round(x, 6)
    return _polys(spark, sf).select("annotation_id", r(G.area(p)).alias("area"), r(G.perimeter(p)).alias("perimeter"), r(c["x"]).alias("cx"), r(c["y"]).alias("cy"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))


def poly_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """FN-22, FN-23: shape descriptors."""
    t = G.with_descriptors(_polys(spark, sf).where("width > 0 and height > 0"))
    return t.select("annotation_id", *[(F.round(m, 11) + F.lit(0.0)).alias(m) for m in A.MEASURES])


def largest_part(spark: SparkSession, sf: str) -> DataFrame:
    """FN-25, FN-33: parts of a segmentation under the three policies, and the vertices of the largest."""
    p = F.col("parts")
    t = A.polygons(spark, sf)
    return t.select("annotation_id", F.size(p).alias("n_parts"), F.size(G.multipart(p, "split")).alias("n_split"), F.size(G.multipart(p, "skip")).alias("n_skip"), F.size(G.multipart(p, "concat")).alias("n_concat"), F.coalesce((F.size("points") / 2).cast("int"), F.lit(0)).alias("vertices"))


def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """FN-32: normalised label lines with 0-based classes."""
    t = _polys(spark, sf).where("width > 0 and height > 0 and class_id is not null")
    return t.select("annotation_id", G.label_line(F.col("class_id") - 1, F.col("points"), F.col("width"), F.col("height"), 12).alias("line"))


QUERIES = {f.__name__: f for f in (species_id_parse, safe_names, norm_names, genus, id_canonical, list_cell, schedules, poly_area, poly_descriptors, largest_part, label_lines)}

_NAME = "trim(regexp_replace(nfc_normalize({}), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_CANON = r"(SELECT CASE WHEN lower(s) IN ('', 'nan') THEN NULL WHEN regexp_full_match(s, '\d{1,4}') THEN lpad(s, 4, '0') ELSE s END FROM (SELECT regexp_replace(trim(species_id), '^(\d+)\.0*$', '\1') AS s))"
_P = f"WITH {A.POLY}"
_EL = f"""(SELECT CASE WHEN isnan(r) THEN 1 ELSE r END FROM (SELECT sqrt(greatest(m + h, 1e-12) / greatest(m - h, 1e-12)) AS r FROM (SELECT (sxx + syy) / 2 AS m, sqrt((sxx - syy) ** 2 / 4 + sxy * sxy) AS h FROM (SELECT
  list_sum(list_transform(xs, lambda x: (x - cx) ** 2)) / (len(xs) - 1) AS sxx, list_sum(list_transform(ys, lambda y: (y - cy) ** 2)) / (len(ys) - 1) AS syy,
  list_sum(list_transform(range(1, CAST(len(xs) + 1 AS BIGINT)), lambda i: (xs[i] - cx) * (ys[i] - cy))) / (len(xs) - 1) AS sxy))))"""
SQL = {
    "species_id_parse": r"""SELECT DISTINCT image_path, image_name, coalesce(nullif(trim(regexp_extract(regexp_replace(regexp_extract(image_path, '([^/\\]*)$', 1), '\.[^.]+$', ''), '^([^-_]*)', 1)), ''), 'unknown') AS token,
  regexp_extract(image_name, '^([^-]*)', 1) AS loose, nullif(regexp_extract(image_name, '^(\d{3,5})-', 1), '') AS strict, nullif(regexp_extract(image_name, '^(\d+)', 1), '') AS digits, coalesce(replace(image_path, '\', '/'), '') AS path FROM train""",
    "safe_names": "SELECT species_id, 'feat_' || coalesce(nullif(trim(regexp_replace(species_name, '[^0-9A-Za-z_]+', '_', 'g'), '_'), ''), 'unknown') AS column_name FROM especies",
    "norm_names": f"SELECT DISTINCT image_id, CASE WHEN lower(n) IN ('', 'nan') THEN NULL ELSE n END AS name FROM (SELECT image_id, {_NAME.format('species_name')} AS n FROM features_por_imagen)",
    "genus": f"SELECT species_id, regexp_replace(trim(regexp_replace(strip_accents(n), '[^A-Za-z0-9_\\s-]', '', 'g')), '\\s+', '_', 'g') AS slug, coalesce(nullif(regexp_extract(n, '^(\\S+)', 1), ''), '?') AS genus, coalesce(nullif(regexp_extract(n, '^(\\S+(\\s+\\S+)?)', 1), ''), '?') AS binomial FROM (SELECT species_id, {_NAME.format('species_name')} AS n FROM especies)",
    "id_canonical": f"WITH t AS (SELECT DISTINCT image_id, {_CANON} AS id FROM features_por_imagen), s AS (SELECT species_id AS id, {_NAME.format('species_name')} AS n FROM especies) SELECT image_id, t.id AS species_id, CASE WHEN ltrim(t.id, '0') = '' THEN '0' ELSE ltrim(t.id, '0') END AS short, coalesce(n, 'Especie_Desconocida_' || t.id) AS name FROM t LEFT JOIN s ON s.id = t.id",
    "list_cell": r"""SELECT species_id, array_to_string(list_filter(list_transform(string_split_regex('[''' || replace(species_name, '''', '') || '''; ' || species_id || ']', '[;,|]'), lambda x: trim(regexp_replace(x, '[\[\]"'']', '', 'g'))), lambda x: x <> ''), '/') AS parts,
  regexp_extract(species_id || ' ' || species_name, '^\s*(\d+)', 1) AS task_id, trim(regexp_extract(species_id || ' ' || species_name, '^\s*\d+[\s_-]+(.*)$', 1)) AS task_rest FROM especies""",
    "schedules": A.BASE + ", n AS (SELECT species_id, count(*) AS n FROM img WHERE species_id IS NOT NULL GROUP BY 1) SELECT species_id, n, least(1.0, n / 5.0) AS reliability, CAST(CASE WHEN n < 15 THEN greatest(0, least(least(3, greatest(1, ceil(n * 0.15))), n - 1)) ELSE 0 END AS INT) AS quota, round(CASE WHEN n < 30 THEN 0 WHEN n >= 80 THEN 0.5 ELSE 0.5 * (n - 30) / 50 END, 6) AS weight FROM n",
    "poly_area": f"{_P} SELECT annotation_id, round({A.AREA}, 6) AS area, round({A.PERIMETER}, 6) AS perimeter, round(list_sum({A.XS}) / len({A.XS}), 6) AS cx, round(list_sum({A.YS}) / len({A.YS}), 6) AS cy, list_min({A.XS}) AS x0, list_min({A.YS}) AS y0, list_max({A.XS}) AS x1, list_max({A.YS}) AS y1 FROM poly WHERE points IS NOT NULL",
    "poly_descriptors": f"""{_P}, g AS (SELECT annotation_id, {A.AREA} AS a, {A.PERIMETER} AS p, {A.XS} AS xs, {A.YS} AS ys, list_sum({A.XS}) / len({A.XS}) AS cx, list_sum({A.YS}) / len({A.YS}) AS cy, width, height FROM poly WHERE points IS NOT NULL AND width > 0 AND height > 0),
h AS (SELECT *, greatest(list_max(xs) - list_min(xs), 1e-6) AS bw, greatest(list_max(ys) - list_min(ys), 1e-6) AS bh, {_EL} AS el FROM g WHERE a > 0)
SELECT annotation_id, round(a / (width * height), 11) AS area_frac, round(ln(greatest(a / (width * height), 1e-12)), 11) AS log_area, round(least(1, greatest(0, 4 * pi() * a / nullif(p * p, 0))), 11) AS sphericity, round(ln(bw / bh), 11) + 0.0 AS log_aspect, round(ln(el), 11) AS log_elong, round(a / (bw * bh), 11) AS bbox_extent FROM h""",
    "largest_part": _P + ", s AS (SELECT *, list_filter(parts, lambda q: len(q) >= 6 AND len(q) % 2 = 0) AS v FROM poly) SELECT annotation_id, len(parts) AS n_parts, len(v) AS n_split, CASE WHEN len(v) = 1 THEN 1 ELSE 0 END AS n_skip, CASE WHEN len(v) > 0 THEN 1 ELSE 0 END AS n_concat, coalesce(len(points) // 2, 0) AS vertices FROM s",
    "label_lines": _P + ", e AS (SELECT annotation_id, class_id, list_transform(points, lambda v, i: printf('%.12f', least(1.0, greatest(0.0, v / CASE WHEN i % 2 = 1 THEN width ELSE height END)))) AS c FROM poly WHERE points IS NOT NULL AND width > 0 AND height > 0 AND class_id IS NOT NULL) SELECT annotation_id, (class_id - 1)::VARCHAR || ' ' || array_to_string(c, ' ') AS line FROM e",
}
