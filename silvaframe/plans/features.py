"""Queries of the feature operators over photographs and their annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import raster
from ..operators import features as O
from . import adapters as A

#: A catalogue of species for FL-1: the rows of especies that are not withdrawn.
SHAPES = O.SHAPES


def _r(df: DataFrame, *cols: str, digits: int = 10) -> DataFrame:
    """Rounded so far out that no mean of inputs with few decimals lies on a tie; -0.0 as 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def image_class_features(spark: SparkSession, sf: str) -> DataFrame:
    t = O.class_features(A.images(spark, sf), A.annotations(spark, sf), A.IDS)
    return _r(t, "area_sum", "area_mean", "area_std", digits=6).withColumn("density_pct", F.round("density_pct", 10))


def image_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_r(O.image_totals(A.images(spark, sf), A.annotations(spark, sf)), "density_pct"), "total_area", digits=6)


def features_pivot(spark: SparkSession, sf: str) -> DataFrame:
    t = O.class_features(A.images(spark, sf), A.annotations(spark, sf), A.IDS)
    t = _r(t, "density_pct")
    return O.wide(t, ["image_id"], {"n": "count", "density_pct": "density_pct"}, A.IDS, "clase_")


def dissimilarity_features(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.dissimilarity_features(A.images(spark, sf), A.annotations(spark, sf), A.IDS), "area", "n_share", "area_share")


def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.dataset_stats(A.images(spark, sf), A.annotations(spark, sf)), "area").withColumn("whole", F.col("whole").cast("int"))


def trait_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.trait_scores(A.images(spark, sf), A.annotations(spark, sf), A.IDS), "local", "species", "global", "score")


def empty_images(spark: SparkSession, sf: str) -> DataFrame:
    return O.without_annotations(A.images(spark, sf), A.annotations(spark, sf)).select("image_id", "species_id")


def orphan_annotations(spark: SparkSession, sf: str) -> DataFrame:
    im = A.images(spark, sf).where("img_area is not null")
    return O.orphans(A.annotations(spark, sf), im).select("annotation_id", "image_id")


def catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FL-1: images of catalogued species that are not withdrawn."""
    sp = A.table(spark, sf, "especies").where("deleted_at is null").select("species_id")
    return A.images(spark, sf).join(sp, "species_id", "left_semi").select("image_id", "species_id")


def min_images_filter(spark: SparkSession, sf: str) -> DataFrame:
    return O.min_images(A.images(spark, sf).where("species_id is not null"), 5).select("image_id", "species_id")


def small_area_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FL-5: annotations of at least 0.003 of the image."""
    return A.annotations(spark, sf).where("area_frac >= 0.003").select("annotation_id", "area_frac")


def flag_small_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """FL-6, AG-34: annotations below 2,000 square pixels, counted per class with the share they make up."""
    t = A.annotations(spark, sf).join(A.images(spark, sf), "image_id").withColumn("small", F.col("area_frac") * F.col("img_area") < 2000)
    return t.groupBy("class_id").agg(F.count_if("small").alias("flagged"), F.count(F.lit(1)).alias("n"), F.round(F.count_if("small") / F.count(F.lit(1)), 6).alias("share"))


def p10_gate(spark: SparkSession, sf: str) -> DataFrame:
    """FL-7: annotations below the 10th percentile of their class's areas."""
    t = A.annotations(spark, sf).where("area_frac is not null")
    p = O.percentiles(t, "class_id", "area_frac", 0.1)
    return t.join(p, "class_id").where("area_frac < p").select("annotation_id", "class_id")


def proximity_image_features(spark: SparkSession, sf: str) -> DataFrame:
    t = O.proximity_features(A.annotations(spark, sf), A.IDS)
    return _r(t, "area", *SHAPES, *[f"{k}_std" for k in SHAPES])


def species_b1(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.signature_b1(O.proximity_features(A.annotations(spark, sf), A.IDS), A.images(spark, sf)), "presence", "area_share")


def species_b2(spark: SparkSession, sf: str) -> DataFrame:
    t = O.signature_b2(O.proximity_features(A.annotations(spark, sf), A.IDS), A.images(spark, sf))
    return _r(t, *SHAPES, *[f"{k}_std" for k in SHAPES])


def species_b3_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.signature_b3(A.annotations(spark, sf), A.images(spark, sf)), "jaccard")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    t = A.polygons(spark, sf).where("points is not null and width > 0 and height > 0 and image_id is not null and class_id between 1 and 14")
    c = G.centroid(F.col("points"))
    return t.select("image_id", "annotation_id", "class_id", c["x"].alias("cx"), c["y"].alias("cy"), G.box(F.col("points")).alias("box"), "width", "height", F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")).alias("diagonal"))


def spatial_b4_image(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.spatial_b4(_boxes(spark, sf), 0.25, G.box_iou, G.box_containment), "reldist", "closefrac", "iou", "contain")


def spatial_b4_species(spark: SparkSession, sf: str) -> DataFrame:
    t = O.spatial_b4(_boxes(spark, sf), 0.25, G.box_iou, G.box_containment)
    return _r(O.species_b4(t, A.images(spark, sf)), "reldist", "closefrac", "iou", "contain")


def presence_priors(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.presence_priors(A.images(spark, sf), A.annotations(spark, sf), A.IDS), "presence", "area")


def diagnostic_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _r(O.diagnostic_weights(O.presence_priors(A.images(spark, sf), A.annotations(spark, sf), A.IDS)), "weight", digits=6)


GRID = 128


def _overlaps(spark: SparkSession, sf: str, outlines: str | Column = "outlines") -> DataFrame:
    """(image_id, a, b) of the classes whose filled outlines share a cell of the grid."""
    t = A.polygons(spark, sf, masks=isinstance(outlines, str)).where("width > 0 and height > 0 and image_id is not null and class_id between 1 and 14")
    t = t.select("image_id", "class_id", F.inline(raster.mask_words(outlines, "width", "height")))
    return O.image_overlaps(t)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.overlap_counts(_overlaps(spark, sf), A.images(spark, sf).where("species_id is not null"))


def overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


def overlap_largest(spark: SparkSession, sf: str) -> DataFrame:
    """AG-23 over the largest polygon of each annotation."""
    t = _overlaps(spark, sf, F.when(F.col("points").isNotNull(), F.array("points")))
    return O.overlap_counts(t, A.images(spark, sf).where("species_id is not null"))


def allowed_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return O.allowed_overlap(_counts(spark, sf), 3, A.IDS)


def seed_vs_learned(spark: SparkSession, sf: str) -> DataFrame:
    n = _counts(spark, sf)
    return O.seed_vs_learned(O.allowed_overlap(n, 3, A.IDS), O.allowed_overlap(n, 1, A.IDS))


QUERIES = {
    f.__name__: f
    for f in (
        image_class_features, image_totals, features_pivot, dissimilarity_features, dataset_stats, trait_scores, empty_images, orphan_annotations, catalog_filter, min_images_filter, small_area_filter, flag_small_by_class, p10_gate,
        proximity_image_features, species_b1, species_b2, species_b3_jaccard, spatial_b4_image, spatial_b4_species, presence_priors, diagnostic_weights, overlap_counts, overlap_largest, allowed_overlap, seed_vs_learned,
    )
}

B = A.BASE
_AGG1 = B + """, a AS (SELECT ann.image_id, class_id, area_frac * img_area AS area FROM ann JOIN img USING (image_id)),
g AS (SELECT image_id, class_id, count(*) AS n, sum(area) AS s, avg(area) AS m, coalesce(stddev_samp(area), 0) AS d FROM a GROUP BY 1, 2),
f AS (SELECT img.image_id, img.species_id, cat.class_id, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(m, 0) AS m, coalesce(d, 0) AS d,
   coalesce(CASE WHEN img_area <> 0 THEN coalesce(s, 0) * 100 / img_area END, 0) AS dens
   FROM img CROSS JOIN cat LEFT JOIN g ON g.image_id = img.image_id AND g.class_id = cat.class_id)
"""
_TRAIT = B + """, n AS (SELECT ann.image_id, species_id, class_id, count(*) AS n FROM ann JOIN img USING (image_id) GROUP BY 1, 2, 3),
r AS (SELECT species_id, least(1.0, count(*) / 5.0) AS rel FROM img GROUP BY 1),
w AS (SELECT n.*, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY image_id) AS l, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY species_id, class_id) AS s, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY class_id) AS g FROM n),
t AS (SELECT w.*, round(least(1.0, greatest(0.0, 0.5 * l + 0.2 * rel * s + (0.3 + 0.2 * (1 - rel)) * g)), 6) AS score FROM w JOIN r ON r.species_id IS NOT DISTINCT FROM w.species_id)
SELECT img.image_id, img.species_id, cat.class_id, coalesce(n, 0) AS n, coalesce(round(l, 10), 0) AS local, coalesce(round(s, 10), 0) AS species, coalesce(round(g, 10), 0) AS global, coalesce(score, 0) AS score
FROM img CROSS JOIN cat LEFT JOIN t ON t.image_id = img.image_id AND t.class_id = cat.class_id"""
_PROX = B + ", va AS (SELECT * FROM ann WHERE area_frac IS NOT NULL), pg AS (SELECT image_id, class_id, sum(area_frac) AS area, " + ", ".join(f"avg({k}) AS {k}, stddev_pop({k}) AS {k}_std" for k in SHAPES) + " FROM va GROUP BY 1, 2), prox AS (SELECT i.image_id, cat.class_id, CASE WHEN pg.image_id IS NULL THEN 0 ELSE 1 END AS presence, coalesce(area, 0) AS area, " + ", ".join(f"coalesce({k}, 0) AS {k}, coalesce({k}_std, 0) AS {k}_std" for k in SHAPES) + " FROM (SELECT DISTINCT image_id FROM va) i CROSS JOIN cat LEFT JOIN pg ON pg.image_id = i.image_id AND pg.class_id = cat.class_id)"
_ALLK = [k for s in SHAPES for k in (s, f"{s}_std")]
_PRIOR = B + """, x AS (SELECT species_id, ann.image_id, class_id, sum(area_frac) AS area FROM ann JOIN img USING (image_id) WHERE species_id IS NOT NULL GROUP BY 1, 2, 3),
y AS (SELECT species_id, class_id, count(*) AS p, sum(area) AS area FROM x GROUP BY 1, 2),
sn AS (SELECT species_id, count(*) AS n FROM img WHERE species_id IS NOT NULL GROUP BY 1),
pr AS (SELECT sn.species_id, cat.class_id, coalesce(p, 0) / n AS presence, coalesce(area, 0) / n AS area FROM sn CROSS JOIN cat LEFT JOIN y ON y.species_id = sn.species_id AND y.class_id = cat.class_id)"""
_BOX = f"{B}, {A.POLY}, bx AS (SELECT image_id, annotation_id, class_id, list_sum({A.XS}) / len({A.XS}) AS cx, list_sum({A.YS}) / len({A.YS}) AS cy, list_min({A.XS}) AS x0, list_max({A.XS}) AS x1, list_min({A.YS}) AS y0, list_max({A.YS}) AS y1, width, height, sqrt(CAST(width AS DOUBLE) * width + CAST(height AS DOUBLE) * height) AS diag FROM poly WHERE points IS NOT NULL AND width > 0 AND height > 0 AND image_id IS NOT NULL AND class_id BETWEEN 1 AND 14)"
_B4 = _BOX + """, pr AS (SELECT a.image_id, a.annotation_id AS ai, b.annotation_id AS bi, a.class_id AS a, b.class_id AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) / a.diag AS d,
   greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS ov, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb
   FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.annotation_id <> b.annotation_id),
rf AS (SELECT image_id, greatest(median(d), 1e-12) AS med, quantile_cont(d, 0.25) AS near FROM pr WHERE ai < bi GROUP BY 1),
b4 AS (SELECT pr.image_id, a, b, median(d) / max(med) AS reldist, avg(CASE WHEN round(d, 9) <= round(near, 9) THEN 1.0 ELSE 0.0 END) AS closefrac,
   avg(CASE WHEN sa + sb - ov > 0 THEN ov / (sa + sb - ov) ELSE 0 END) AS iou, avg(CASE WHEN sa > 0 THEN ov / sa ELSE 0 END) AS contain FROM pr JOIN rf USING (image_id) GROUP BY 1, 2, 3
   UNION ALL SELECT image_id, class_id, class_id, 0, 1, 1, 1 FROM (SELECT image_id, class_id FROM bx GROUP BY 1, 2 HAVING count(*) = 1) JOIN rf USING (image_id))"""
#: Filled polygons on the grid: vertices cut to cells, scan lines by the even-odd rule, and the cells of the outline.
_OVER = f"""{B}, {A.POLY}, gp AS (SELECT row_number() OVER () AS id, image_id, class_id, list_transform({A.XS}, lambda v: CAST(greatest(0, least(127, trunc(v / width * 128))) AS INT)) AS xs, list_transform({A.YS}, lambda v: CAST(greatest(0, least(127, trunc(v / height * 128))) AS INT)) AS ys
   FROM poly WHERE points IS NOT NULL AND width > 0 AND height > 0 AND image_id IS NOT NULL AND class_id BETWEEN 1 AND 14),
ed AS (SELECT id, image_id, class_id, xs[k] AS x, ys[k] AS y, xs[k % len(xs) + 1] AS u, ys[k % len(xs) + 1] AS v FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM gp)),
st AS (SELECT *, greatest(abs(u - x), abs(v - y), 1) AS n FROM ed),
ol AS (SELECT image_id, class_id, CAST(round_even(x + (u - x) * (CAST(s AS DOUBLE) / n), 0) AS INT) AS cx, CAST(round_even(y + (v - y) * (CAST(s AS DOUBLE) / n), 0) AS INT) AS cy FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS s FROM st)),
sc AS (SELECT id, image_id, class_id, x, y, u, v, unnest(range(least(y, v), greatest(y, v))) AS cy FROM ed WHERE y <> v),
cr AS (SELECT id, image_id, class_id, cy, x + (cy - y) * (CAST(u - x AS DOUBLE) / (v - y)) AS xx FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY id, cy ORDER BY xx) AS r FROM cr),
sp AS (SELECT image_id, class_id, cy, CAST(ceil(min(xx)) AS INT) AS lo, CAST(floor(max(xx)) AS INT) AS hi FROM rk GROUP BY id, image_id, class_id, cy, (r + 1) // 2),
ce AS (SELECT image_id, class_id, cx, cy FROM ol UNION SELECT image_id, class_id, unnest(range(greatest(lo, 0), least(hi, 127) + 1)) AS cx, cy FROM sp),
oc AS (SELECT species_id, a, b, count(*) AS n FROM (SELECT DISTINCT x.image_id, x.class_id AS a, y.class_id AS b FROM ce x JOIN ce y ON x.image_id = y.image_id AND x.cx = y.cx AND x.cy = y.cy AND x.class_id < y.class_id) JOIN img USING (image_id) WHERE species_id IS NOT NULL GROUP BY 1, 2, 3)"""

SQL = {
    "image_class_features": _AGG1 + "SELECT image_id, species_id, class_id, n, round(s, 6) AS area_sum, round(m, 6) AS area_mean, round(d, 6) AS area_std, round(dens, 10) AS density_pct FROM f",
    "image_totals": B + ", g AS (SELECT image_id, count(*) AS n, sum(area_frac) AS f FROM ann GROUP BY 1) SELECT img.image_id, species_id, coalesce(n, 0) AS total_annotations, round(coalesce(coalesce(f, 0) * img_area, 0), 6) AS total_area, round(coalesce(f, 0) * 100, 10) AS density_pct FROM img LEFT JOIN g USING (image_id)",
    "features_pivot": _AGG1 + "SELECT image_id, " + ", ".join(f"max(n) FILTER (class_id = {i}) AS clase_{i}_count, max(round(dens, 10)) FILTER (class_id = {i}) AS clase_{i}_density_pct" for i in A.IDS) + " FROM f GROUP BY 1",
    "dissimilarity_features": B + ", g AS (SELECT image_id, class_id, count(*) AS n, sum(area_frac) AS a FROM ann GROUP BY 1, 2), s AS (SELECT image_id, sum(n) AS sn, sum(a) AS sa FROM g GROUP BY 1) SELECT img.image_id, species_id, cat.class_id, coalesce(n, 0) AS n, round(coalesce(a, 0), 10) AS area, round(coalesce(n / sn, 0), 10) AS n_share, round(coalesce(a / sa, 0), 10) AS area_share FROM img CROSS JOIN cat LEFT JOIN g ON g.image_id = img.image_id AND g.class_id = cat.class_id LEFT JOIN s ON s.image_id = img.image_id",
    "dataset_stats": B + ", g AS (SELECT image_id, coalesce(species_id, 'unknown') AS species_id, class_id, count(*) AS n, sum(area_frac) AS area FROM ann JOIN img USING (image_id) GROUP BY 1, 2, 3) SELECT species_id, class_id, CAST(sum(n) AS BIGINT) AS instances, count(*) AS images, round(sum(area), 10) AS area, CAST(grouping(species_id) AS INT) AS whole FROM g GROUP BY GROUPING SETS ((species_id, class_id), (class_id))",
    "trait_scores": _TRAIT,
    "empty_images": B + " SELECT image_id, species_id FROM img WHERE image_id NOT IN (SELECT image_id FROM ann)",
    "orphan_annotations": B + " SELECT annotation_id, image_id FROM ann WHERE image_id NOT IN (SELECT image_id FROM img WHERE img_area IS NOT NULL)",
    "catalog_filter": B + " SELECT image_id, species_id FROM img WHERE species_id IN (SELECT species_id FROM especies WHERE deleted_at IS NULL)",
    "min_images_filter": B + " SELECT image_id, species_id FROM img WHERE species_id IN (SELECT species_id FROM img GROUP BY 1 HAVING count(*) >= 5)",
    "small_area_filter": B + " SELECT annotation_id, area_frac FROM ann WHERE area_frac >= 0.003",
    "flag_small_by_class": B + ", t AS (SELECT class_id, area_frac * img_area < 2000 AS small FROM ann JOIN img USING (image_id)) SELECT class_id, count(*) FILTER (small) AS flagged, count(*) AS n, round(count(*) FILTER (small) / count(*), 6) AS share FROM t GROUP BY 1",
    "p10_gate": B + ", p AS (SELECT class_id, quantile_cont(area_frac, 0.1) AS p10 FROM ann GROUP BY 1) SELECT annotation_id, class_id FROM ann JOIN p USING (class_id) WHERE area_frac < p10",
    "proximity_image_features": _PROX + " SELECT image_id, class_id, presence, " + ", ".join(f"round({k}, 10) + 0.0 AS {k}" for k in ["area", *_ALLK]) + " FROM prox",
    "species_b1": _PROX + ", m AS (SELECT species_id, class_id, avg(presence) AS presence, avg(area) AS area FROM prox JOIN img USING (image_id) WHERE species_id IS NOT NULL GROUP BY 1, 2) SELECT species_id, class_id, round(presence, 10) AS presence, round(coalesce(area / nullif(sum(abs(area)) OVER (PARTITION BY species_id), 0), 0), 10) AS area_share FROM m",
    "species_b2": _PROX + " SELECT species_id, class_id, " + ", ".join(f"round(coalesce(avg({k}) FILTER (presence = 1), 0), 10) + 0.0 AS {k}" for k in _ALLK) + " FROM prox JOIN img USING (image_id) WHERE species_id IS NOT NULL GROUP BY 1, 2",
    "species_b3_jaccard": B + ", p AS (SELECT DISTINCT species_id, image_id, class_id FROM ann JOIN img USING (image_id) WHERE species_id IS NOT NULL AND area_frac IS NOT NULL), c AS (SELECT species_id, class_id, count(*) AS n FROM p GROUP BY 1, 2), j AS (SELECT x.species_id, x.class_id AS a, y.class_id AS b, count(*) AS n_both FROM p x JOIN p y ON x.image_id = y.image_id AND x.class_id <= y.class_id GROUP BY 1, 2, 3) SELECT j.species_id, a, b, n_both, round(n_both / (ca.n + cb.n - n_both), 10) AS jaccard FROM j JOIN c ca ON ca.species_id = j.species_id AND ca.class_id = a JOIN c cb ON cb.species_id = j.species_id AND cb.class_id = b",
    "spatial_b4_image": _B4 + " SELECT image_id, a, b, round(reldist, 10) AS reldist, round(closefrac, 10) AS closefrac, round(iou, 10) AS iou, round(contain, 10) AS contain FROM b4",
    "spatial_b4_species": _B4 + ", nn AS (SELECT species_id, count(*) AS n FROM (SELECT DISTINCT image_id FROM b4) JOIN img USING (image_id) WHERE species_id IS NOT NULL GROUP BY 1) SELECT species_id, a, b, round(sum(reldist) / max(n), 10) AS reldist, round(sum(closefrac) / max(n), 10) AS closefrac, round(sum(iou) / max(n), 10) AS iou, round(sum(contain) / max(n), 10) AS contain FROM b4 JOIN img USING (image_id) JOIN nn USING (species_id) GROUP BY 1, 2, 3",
    "presence_priors": _PRIOR + " SELECT species_id, class_id, round(presence, 10) AS presence, round(area, 10) AS area FROM pr",
    "diagnostic_weights": _PRIOR + ", c AS (SELECT class_id, avg(area) AS m, stddev_pop(area) + 1e-8 AS s FROM pr WHERE presence >= 0.1 GROUP BY 1) SELECT species_id, pr.class_id, round(CASE WHEN presence >= 0.1 THEN 1 + 2 * least(abs(area - m) / s, 3) / 3 ELSE 1 END, 6) AS weight FROM pr LEFT JOIN c ON c.class_id = pr.class_id",
    "overlap_largest": _OVER + " SELECT species_id, a, b, n FROM oc",
}
