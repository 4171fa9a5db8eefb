"""Queries of evaluation, confidence, splits and proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import geometry as G
from ..functions import raster
from ..functions import vectors as V
from ..operators import confidence as C
from ..operators import distance as D
from ..operators import evaluation as E
from ..operators import features as O
from ..operators import proximity as P
from ..operators import splits as S
from ..sinks import writers
from ..sources import labels
from . import adapters as A
from . import distances as Q
from .features import _r

COUNTS = [f"count_feat_{c}" for c in A.CLASSES]


def _gt_pred(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Annotations as ground truth, and predictions made of them: outlines moved by a few pixels, some labels changed, some far off."""
    t = A.polygons(spark, sf).where("points is not null and image_id is not null and class_id between 1 and 14")
    i = F.col("annotation_id")
    far = F.when(i % 13 == 0, 5000).otherwise(0)
    dx, dy = (i % 11 - 5) * 3 + far, (i % 7 - 3) * 3
    label = F.when(i % 9 == 0, F.col("class_id") % 14 + 1).otherwise(F.col("class_id"))
    gt = t.select("image_id", i.alias("gt_id"), F.col("class_id").cast("string").alias("label"), "points", G.box(F.col("points")).alias("box"))
    p = F.transform("points", lambda v, k: v + F.when(k % 2 == 0, dx).otherwise(dy))
    pred = t.select("image_id", i.alias("pred_id"), label.cast("string").alias("label"), p.alias("points"))
    return gt, pred.withColumn("box", G.box(F.col("points")))


def iou_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """J-8 with FN-26."""
    gt, pred = _gt_pred(spark, sf)
    return _r(E.candidates(gt, pred, G.box_iou, 0.5, G.box_overlap), "iou", digits=8)


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    """J-8, J-9 with filled outlines (FN-30)."""
    gt, pred = _gt_pred(spark, sf)
    return E.greedy(E.candidates(gt, pred, raster.mask_iou, 0.5, G.box_overlap, shape="points"))


def _exports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The annotations of the ground-truth exports and those of the predicted ones."""
    t = A.polygons(spark, sf).where("points is not null and image_id is not null and class_id between 1 and 14")
    one = lambda kind, name: t.where(F.col("kind") == kind).select("image_id", F.col("annotation_id").alias(name), F.col("class_id").cast("string").alias("label"), "points", G.box(F.col("points")).alias("box"))
    return one("gt", "gt_id"), one("pred", "pred_id")


def export_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """J-9, AG-13 on the exports, by the filled outlines (FN-30)."""
    gt, pred = (R.written(t, "side") for t in _exports(spark, sf))
    m = R.written(E.greedy(E.candidates(gt, pred, raster.mask_iou, 0.5, G.box_overlap, shape="points")), "matches")
    return E.confusion(E.instance_pairs(gt, pred, m))


def export_support(spark: SparkSession, sf: str) -> DataFrame:
    """AG-15 on the exports: instances and predictions per class, which no matching may change."""
    return E.class_metrics(export_confusion(spark, sf)).select("label", "support", "predicted")


def detection_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """AG-13 over the greedy matches of filled outlines, with predictions made of the ground truth."""
    gt, pred = _gt_pred(spark, sf)
    gt, pred = R.written(gt, "gt"), R.written(pred, "pred")
    m = R.written(E.greedy(E.candidates(gt, pred, raster.mask_iou, 0.5, G.box_overlap, shape="points")), "matches")
    return E.confusion(E.instance_pairs(gt, pred, m))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """True and predicted class per annotation; the prediction is a rule on its shape."""
    t = A.annotations(spark, sf).join(A.images(spark, sf).select("image_id", "species_id"), "image_id").where("species_id is not null")
    c = F.col("class_id")
    pred = F.when(F.col("sphericity") < 0.5, (c % 14 + 1).cast("string")).when(F.col("area_frac") < 0.001, E.BACKGROUND).otherwise(c.cast("string"))
    return t.select("image_id", "species_id", c.cast("string").alias("gt_label"), pred.alias("pred_label"))


def confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(_pairs(spark, sf))


def confusion_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.rollup(_pairs(spark, sf))


_M = ("precision", "recall", "f1")


def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _r(E.class_metrics(E.confusion(_pairs(spark, sf))), *_M, digits=8)


def global_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = E.global_metrics(E.class_metrics(E.confusion(_pairs(spark, sf))))
    return _r(t, *[f"{a}_{m}" for a in ("micro", "macro") for m in _M], digits=8)


def species_trait_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """AG-17."""
    return _r(E.class_metrics(E.confusion(_pairs(spark, sf), ["species_id"]), ["species_id"]), *_M, digits=8)


def support_gate(spark: SparkSession, sf: str) -> DataFrame:
    return E.supported(species_trait_metrics(spark, sf), 3).select("species_id", "label", "support")


def trait_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return E.trait_ranking(E.supported(species_trait_metrics(spark, sf), 3), ["species_id"]).select("species_id", "rank", "label", "f1")


def trait_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """AG-18: a row per species, a column per trait."""
    t = species_trait_metrics(spark, sf).groupBy("species_id").pivot("label", [str(i) for i in A.IDS]).agg(F.first("f1"))
    return t.select("species_id", *[F.col(str(i)).alias(f"f1_{i}") for i in A.IDS])


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    """AG-33."""
    return _r(E.class_report(_pairs(spark, sf).where(F.col("pred_label") != E.BACKGROUND)), *_M, digits=8)


def nearest_instance(spark: SparkSession, sf: str) -> DataFrame:
    """WN-8."""
    gt, pred = _gt_pred(spark, sf)
    return _r(E.nearest_instance(E.candidates(gt, pred, G.box_iou, 0.1, G.box_overlap)), "iou", digits=8)


def prior_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """J-18: priors of all annotations against those of the exports' images."""
    im, an = A.images(spark, sf), A.annotations(spark, sf)
    p = R.written(O.presence_priors(im, an, A.IDS), "priors")
    some = an.where("area_frac >= 0.003")
    return _r(E.prior_divergence(p, O.presence_priors(im, some, A.IDS)), "presence_l1", "area_l1", digits=12)


# -- confidence on embeddings -------------------------------------------------------


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of minus ten times the distance to each label's centre."""
    p = Q.points(spark, sf)
    c = Q.centres(p).select(F.col("label").alias("species"), F.col("v").alias("c"))
    t = p.select(F.col("vec_id").alias("image_id"), "v").join(F.broadcast(c))  # a centre per label
    t = t.select("image_id", "species", F.exp(-10 * V.cosine_distance(F.col("v"), F.col("c"))).alias("e"))
    s = t.groupBy("image_id").agg(F.sum("e").alias("s"))
    return t.join(s, "image_id").select("image_id", "species", (F.col("e") / F.col("s")).alias("prob"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("true_species"))


def topk_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.topk(_scores(spark, sf), 5), "prob", digits=8)


def rank_true(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.true_ranks(C.topk(_scores(spark, sf), 5), _truth(spark, sf)), "prob_true", digits=8)


def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    t = C.hit_rates(C.true_ranks(C.topk(s, 5), _truth(spark, sf)), s.where("species <> 9"))
    return _r(t, "mean_prob_true", *[f"hit_{k}{x}" for k in (1, 3, 5) for x in ("", "_catalogue")], digits=8)


def spread_coherence(spark: SparkSession, sf: str) -> DataFrame:
    m = Q._matrix(spark, sf, V.cosine_distance)
    return _r(C.spread(C.topk(_scores(spark, sf), 5), m, (0.9, 0.1)), "spread", "z", "coherence", digits=7)


def expected_distance(spark: SparkSession, sf: str) -> DataFrame:
    t = C.expected_distance(C.topk(_scores(spark, sf), 5), _truth(spark, sf), Q._matrix(spark, sf, V.cosine_distance))
    return _r(t, "expected", "calibrated", digits=7)


def _severity(spark: SparkSession, sf: str) -> DataFrame:
    first = C.topk(_scores(spark, sf), 1).select("image_id", F.col("species").alias("predicted_species")).join(_truth(spark, sf), "image_id")
    return C.severity(first, Q._matrix(spark, sf, V.cosine_distance))


def severity(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_severity(spark, sf), "severity", digits=8)


def worst_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """ST-3: a top-k report."""
    return _r(C.worst(_severity(spark, sf), 20), "severity", digits=8).select("image_id", "true_species", "predicted_species", "severity")


def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """J-15: the first choices of the classifier on all dimensions and of one that knows the labels."""
    known = _truth(spark, sf).select("image_id", F.lit(1).alias("rank"), F.col("true_species").alias("species"))
    return C.agreement(C.topk(_scores(spark, sf), 5), known)


def severity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.severity_summary(_severity(spark, sf)), "accuracy", "mean_severity", digits=8)


def image_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """AG-28 over the exports' predictions."""
    t = A.polygons(spark, sf).where("image_id is not null")
    return _r(C.image_confidence(t, t.where("kind = 'pred'")), "mean_score", digits=8)


# -- splits ---------------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """SO-1: the three split tables as one, doubled rows once."""
    out = None
    for n in ("train", "val", "test"):
        t = S.presence_mask(A.table(spark, sf, n), [f"feat_{c}" for c in A.CLASSES])
        t = t.select("record_id", "image_path", "species_id", "split", "mask")
        out = t if out is None else out.unionByName(t)
    return out.distinct()


def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("records"))


def split_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-13, SRC-12: the splits written with their dataset.yaml and read through it: images per split."""
    path = writers.split_dataset(_records(spark, sf).where("trim(image_path) <> ''"), R.scratch(spark, "dataset"), list(A.CLASSES))
    return labels.split_lists(spark, path).groupBy("split").agg(F.countDistinct("image").alias("images"))


def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """WN-6: the first of equal paths, train before val before test."""
    pos = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    t = _records(spark, sf).where("image_path is not null")
    return S.first_wins(t, "image_path", [pos, F.col("record_id")]).select("image_path", "record_id", "split")


def species_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """SO-2."""
    t = _records(spark, sf).where("species_id is not null")
    one = lambda n: t.where(F.col("split") == n).select("species_id")
    return one("train").intersect(one("val")).intersect(one("test"))


def split_difference(spark: SparkSession, sf: str) -> DataFrame:
    """SO-3: paths of train that neither val nor test has."""
    t = _records(spark, sf).where("image_path is not null")
    rest = t.where("split <> 'train'").select("image_path")
    return t.where("split = 'train'").select("image_path").distinct().join(rest, "image_path", "left_anti")


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.coverage(_records(spark, sf), [f"feat_{c}" for c in A.CLASSES])


def species_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AG-29, AG-30."""
    t = _records(spark, sf).groupBy("split", "species_id").agg(F.count(F.lit(1)).alias("n"))
    return t.where("species_id is not null")


def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    """SP-1..SP-5 over the photographs of relative_feature_vectors."""
    t = A.table(spark, sf, "relative_feature_vectors").where("image_path is not null")
    t = S.presence_mask(t, [f"feat_{c}" for c in A.CLASSES]).groupBy(F.translate("image_path", "\\", "/").alias("photo")).agg(F.max("mask").alias("mask"))
    return S.assign(t, "photo", len(A.CLASSES))


def image_ids(spark: SparkSession, sf: str) -> DataFrame:
    """WN-7: sequential ids of the photographs in the order of their paths."""
    t = A.table(spark, sf, "relative_feature_vectors").where("image_path is not null").select(F.translate("image_path", "\\", "/").alias("photo")).distinct()
    return S.sequential_ids(t, ["photo"])


def most_imaged(spark: SparkSession, sf: str) -> DataFrame:
    """ST-6."""
    return S.most_imaged(A.images(spark, sf))


# -- proximity --------------------------------------------------------------------------


def _outlines(spark: SparkSession, sf: str) -> DataFrame:
    return A.polygons(spark, sf).where("points is not null and image_id is not null and class_id is not null").select("image_id", "annotation_id", "class_id", "points")


def proximity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _r(P.near_pairs(_outlines(spark, sf), 20.0).drop("pa", "pb"), "distance", digits=8)


def proximity_gated(spark: SparkSession, sf: str) -> DataFrame:
    """FL-7 on the near pairs: one of the two is among the smallest tenth of its class."""
    o = _outlines(spark, sf)
    limits = O.percentiles(o.withColumn("area", G.area(F.col("points"))), "class_id", "area", 0.1)
    return _r(P.small_pairs(P.near_pairs(o, 20.0), limits).drop("pa", "pb"), "distance", digits=8)


def proximity_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """FN-29 on the near pairs."""
    t = P.near_pairs(_outlines(spark, sf), 20.0)
    return t.select("image_id", "a", "b", raster.mask_overlap_pct("pa", "pb").alias("overlap_pct"))


def duplicate_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11 on the annotations and on copies of them moved by a pixel or more."""
    gt, pred = _gt_pred(spark, sf)
    one = gt.select("image_id", F.col("gt_id").alias("annotation_id"), F.col("label").cast("int").alias("class_id"), "points")
    two = pred.select("image_id", (F.col("pred_id") + 10**9).alias("annotation_id"), F.col("label").cast("int").alias("class_id"), "points")
    return P.duplicates(one.unionByName(two))


def overlap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """FN-31: the number of grid cells that each outline fills."""
    t = A.polygons(spark, sf).where("points is not null and width > 0 and height > 0")
    return t.select("annotation_id", F.size(raster.mask_cells("points", "width", "height")).alias("cells"))


QUERIES = {
    f.__name__: f
    for f in (
        export_confusion, export_support, worst_predictions, model_agreement, iou_candidates, greedy_match, detection_confusion, confusion_long, confusion_rollup, class_metrics, global_metrics, species_trait_metrics, support_gate, trait_ranking, trait_pivot, class_report, nearest_instance, prior_divergence, image_ids, most_imaged,
        topk_classes, rank_true, hit_rate, spread_coherence, expected_distance, severity, severity_summary, image_confidence, union_splits, split_roundtrip, dedupe_first, species_intersection, split_difference, coverage_report, species_distribution, split_assign,
        proximity_pairs, proximity_gated, proximity_overlap, duplicate_outlines, overlap_cells,
    )
}

_GP = f"""WITH {A.POLY}, gt AS (SELECT image_id, annotation_id AS id, list_min({A.XS}) AS x0, list_max({A.XS}) AS x1, list_min({A.YS}) AS y0, list_max({A.YS}) AS y1 FROM poly WHERE points IS NOT NULL AND image_id IS NOT NULL AND class_id BETWEEN 1 AND 14),
pd AS (SELECT image_id, id, x0 + dx AS x0, x1 + dx AS x1, y0 + dy AS y0, y1 + dy AS y1 FROM (SELECT *, (id % 11 - 5) * 3 + CASE WHEN id % 13 = 0 THEN 5000 ELSE 0 END AS dx, (id % 7 - 3) * 3 AS dy FROM gt)),
ov AS (SELECT g.image_id, g.id AS gt_id, p.id AS pred_id, greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0) AS ov, (g.x1 - g.x0) * (g.y1 - g.y0) AS sa, (p.x1 - p.x0) * (p.y1 - p.y0) AS sb FROM gt g JOIN pd p ON g.image_id = p.image_id)
SELECT image_id, gt_id, pred_id, round(ov / (sa + sb - ov), 8) AS iou FROM ov WHERE ov > 0 AND ov / (sa + sb - ov) >= 0.5"""
_EX = f"""WITH {A.POLY}, ex AS (SELECT kind, image_id, annotation_id AS id, CAST(class_id AS VARCHAR) AS label, list_min({A.XS}) AS x0, list_max({A.XS}) AS x1, list_min({A.YS}) AS y0, list_max({A.YS}) AS y1 FROM poly WHERE points IS NOT NULL AND image_id IS NOT NULL AND class_id BETWEEN 1 AND 14 AND kind IN ('gt', 'pred'))"""
_PA = A.BASE + ", pa AS (SELECT ann.image_id, species_id, CAST(class_id AS VARCHAR) AS g, CASE WHEN sphericity < 0.5 THEN CAST(class_id % 14 + 1 AS VARCHAR) WHEN area_frac < 0.001 THEN 'background' ELSE CAST(class_id AS VARCHAR) END AS p FROM ann JOIN img USING (image_id) WHERE species_id IS NOT NULL)"


def _metrics(keys: str, src: str = "pa") -> str:
    k = f"{keys}, " if keys else ""
    on = "g.l = p.l" + (f" AND g.{keys} = p.{keys}" if keys else "")
    key = f"coalesce(g.{keys}, p.{keys}) AS {keys}, " if keys else ""
    return f""", g AS (SELECT {k}g AS l, count(*) AS support, count(*) FILTER (g = p) AS tp FROM {src} GROUP BY ALL), p AS (SELECT {k}p AS l, count(*) AS predicted FROM {src} GROUP BY ALL),
cm0 AS (SELECT {key}coalesce(g.l, p.l) AS label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM g FULL JOIN p ON {on}),
cm1 AS (SELECT *, predicted - tp AS fp, support - tp AS fn, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM cm0 WHERE label <> 'background'),
cm AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM cm1)"""


_CM = "label, tp, fp, fn, support, predicted, round(pr, 8) AS precision, round(re, 8) AS recall, round(f, 8) AS f1 FROM cm"
_SC = Q._E + """, x AS (SELECT e.vec_id AS image_id, c.label AS species, exp(-10 * (1 - sum(e.x * c.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.x * c.x))))) AS w FROM e JOIN c ON e.i = c.i GROUP BY 1, 2),
pb AS (SELECT image_id, species, w / sum(w) OVER (PARTITION BY image_id) AS prob FROM x), tk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, species) AS INT) AS rank FROM pb) WHERE rank <= 5),
tr AS (SELECT vec_id AS image_id, label AS true_species FROM embeddings), rt AS (SELECT tr.image_id, true_species, rank AS rank_true, prob AS prob_true FROM tr LEFT JOIN tk ON tk.image_id = tr.image_id AND tk.species = tr.true_species), """ + Q._cos("c", "m") + ", y AS (SELECT a, b, d FROM m UNION ALL SELECT b, a, d FROM m)"
_RC = "WITH rc AS (" + " UNION ".join(f"SELECT record_id, image_path, species_id, split, {', '.join(f'count_feat_{c} <> 0 AS h{i}' for i, c in enumerate(A.CLASSES))} FROM {t}" for t in ("train", "val", "test")) + ")"
_SEV = _SC + ", sv AS (SELECT tk.image_id, true_species, species AS predicted_species, CAST(species = true_species AS INT) AS correct, CASE WHEN species = true_species THEN 0 ELSE d / (SELECT max(d) FROM m) END AS severity FROM tk JOIN tr USING (image_id) LEFT JOIN y ON y.a = true_species AND y.b = species WHERE rank = 1)"
_PRIOR2 = A.BASE + "".join(f""", x{n} AS (SELECT species_id, ann.image_id, class_id, sum(area_frac) AS area FROM ann JOIN img USING (image_id) WHERE species_id IS NOT NULL AND {w} GROUP BY 1, 2, 3),
y{n} AS (SELECT species_id, class_id, count(*) AS p, sum(area) AS area FROM x{n} GROUP BY 1, 2)""" for n, w in ((1, "TRUE"), (2, "area_frac >= 0.003"))) + """, sn AS (SELECT species_id, count(*) AS n FROM img WHERE species_id IS NOT NULL GROUP BY 1),
j AS (SELECT sn.species_id, n, coalesce(y1.p, 0) AS p1, coalesce(y1.area, 0) AS a1, coalesce(y2.p, 0) AS p2, coalesce(y2.area, 0) AS a2 FROM sn CROSS JOIN cat LEFT JOIN y1 ON y1.species_id = sn.species_id AND y1.class_id = cat.class_id LEFT JOIN y2 ON y2.species_id = sn.species_id AND y2.class_id = cat.class_id)
SELECT species_id, round(sum(abs(p1 / n - p2 / n)), 12) AS presence_l1, round(sum(abs(a1 / n - a2 / n)), 12) AS area_l1 FROM j GROUP BY 1"""
SQL = {
    "nearest_instance": _GP.split("\nSELECT image_id, gt_id")[0] + ", c AS (SELECT image_id, gt_id, pred_id, ov / (sa + sb - ov) AS iou FROM ov WHERE ov > 0 AND ov / (sa + sb - ov) >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) AS r FROM c) SELECT image_id, pred_id, gt_id, round(iou, 8) AS iou FROM r WHERE r = 1",
    "prior_divergence": _PRIOR2,
    "image_ids": "SELECT photo, row_number() OVER (ORDER BY photo) AS id FROM (SELECT DISTINCT replace(image_path, '\\', '/') AS photo FROM relative_feature_vectors WHERE image_path IS NOT NULL)",
    "most_imaged": A.BASE + " SELECT species_id, count(*) AS n FROM img WHERE species_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, species_id LIMIT 12",
    "iou_candidates": _GP,
    "confusion_long": _PA + " SELECT g AS gt_label, p AS pred_label, count(*) AS n FROM pa GROUP BY 1, 2",
    "confusion_rollup": _PA + " SELECT image_id, species_id, g AS gt_label, p AS pred_label, CASE WHEN grouping(image_id) = 0 THEN 'image' WHEN grouping(species_id) = 0 THEN 'species' ELSE 'whole' END AS level, count(*) AS n FROM pa GROUP BY GROUPING SETS ((image_id, g, p), (species_id, g, p), (g, p))",
    "class_metrics": _PA + _metrics("") + f" SELECT {_CM}",
    "global_metrics": _PA + _metrics("") + """, t AS (SELECT count(*) FILTER (support > 0) AS labels, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(pr) FILTER (support > 0) AS mp, avg(re) FILTER (support > 0) AS mr, avg(f) FILTER (support > 0) AS mf FROM cm)
SELECT labels, tp, fp, fn, round(tp / (tp + fp), 8) AS micro_precision, round(tp / (tp + fn), 8) AS micro_recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 8) AS micro_f1, round(mp, 8) AS macro_precision, round(mr, 8) AS macro_recall, round(mf, 8) AS macro_f1 FROM t""",
    "species_trait_metrics": _PA + _metrics("species_id") + f" SELECT species_id, {_CM}",
    "support_gate": _PA + _metrics("species_id") + " SELECT species_id, label, support FROM cm WHERE support >= 3",
    "trait_ranking": _PA + _metrics("species_id") + ", r AS (SELECT species_id, label, round(f, 8) AS f1, CAST(row_number() OVER (PARTITION BY species_id ORDER BY round(f, 8) DESC, round(re, 8) DESC, support DESC, label) AS INT) AS rank FROM cm WHERE support >= 3) SELECT species_id, rank, label, f1 FROM r WHERE rank <= 3",
    "trait_pivot": _PA + _metrics("species_id") + " SELECT species_id, " + ", ".join(f"max(round(f, 8)) FILTER (label = '{i}') AS f1_{i}" for i in A.IDS) + " FROM cm GROUP BY 1",
    "class_report": _PA + ", pb AS (SELECT * FROM pa WHERE p <> 'background')" + _metrics("", "pb") + """, u AS (SELECT label, pr, re, f, support FROM cm UNION ALL SELECT 'macro avg', avg(pr) FILTER (support > 0), avg(re) FILTER (support > 0), avg(f) FILTER (support > 0), sum(support) FROM cm
UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM cm UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM cm)
SELECT label, round(pr, 8) AS precision, round(re, 8) AS recall, round(f, 8) AS f1, CAST(support AS BIGINT) AS support FROM u""",
    "topk_classes": _SC + " SELECT image_id, rank, species, round(prob, 8) AS prob FROM tk",
    "rank_true": _SC + " SELECT image_id, true_species, rank_true, round(prob_true, 8) AS prob_true FROM rt",
    "hit_rate": _SC + " SELECT count(*) AS labelled, count(*) FILTER (true_species = 9) AS out_of_catalogue, round(avg(prob_true), 8) AS mean_prob_true, " + ", ".join(f"round(avg(CASE WHEN rank_true <= {k} THEN 1.0 ELSE 0.0 END), 8) AS hit_{k}, round(avg(CASE WHEN rank_true <= {k} THEN 1.0 ELSE 0.0 END) FILTER (true_species <> 9), 8) AS hit_{k}_catalogue" for k in (1, 3, 5)) + " FROM rt",
    "spread_coherence": _SC + ", s AS (SELECT p.image_id, sum(p.prob * q.prob * d) / sum(p.prob * q.prob) AS s FROM tk p JOIN tk q ON p.image_id = q.image_id AND p.rank < q.rank JOIN y ON y.a = p.species AND y.b = q.species GROUP BY 1) SELECT image_id, round(s, 7) AS spread, round((0.9 - s) / 0.1, 7) AS z, round(1 - s / 0.9, 7) AS coherence FROM s",
    "expected_distance": _SC + ", rw AS (SELECT a, avg(d) AS m, stddev_pop(d) AS s FROM y GROUP BY 1), ex AS (SELECT tk.image_id, true_species, sum(prob * CASE WHEN true_species = species THEN 0 ELSE d END) / sum(prob) AS e FROM tk JOIN tr USING (image_id) LEFT JOIN y ON y.a = true_species AND y.b = species GROUP BY 1, 2) SELECT image_id, true_species, round(e, 7) AS expected, round((m - e) / s, 7) AS calibrated FROM ex JOIN rw ON rw.a = true_species",
    "severity": _SEV + " SELECT image_id, true_species, predicted_species, correct, round(severity, 8) AS severity FROM sv",
    "worst_predictions": _SEV + " SELECT image_id, true_species, predicted_species, round(severity, 8) AS severity FROM sv WHERE severity IS NOT NULL ORDER BY sv.severity DESC, image_id LIMIT 20",
    "model_agreement": _SC + " SELECT tk.image_id, species AS first_1, true_species AS first_2, CAST(species = true_species AS INT) AS agree FROM tk JOIN tr USING (image_id) WHERE rank = 1",
    "export_support": _EX + " SELECT label, count(*) FILTER (kind = 'gt') AS support, count(*) FILTER (kind = 'pred') AS predicted FROM ex GROUP BY 1",
    "severity_summary": _SEV + " SELECT count(*) AS n, round(avg(correct), 8) AS accuracy, round(avg(severity), 8) AS mean_severity, count(*) FILTER (severity IS NULL) AS unknown FROM sv",
    "image_confidence": f"WITH {A.POLY} SELECT image_id, round(coalesce(avg(score) FILTER (kind = 'pred'), 0), 8) AS mean_score, count(*) FILTER (kind = 'pred') AS n FROM poly WHERE image_id IS NOT NULL GROUP BY 1",
    "union_splits": _RC + " SELECT split, count(*) AS rows, count(DISTINCT record_id) AS records FROM rc GROUP BY 1",
    "split_roundtrip": _RC + " SELECT split, count(DISTINCT trim(image_path)) AS images FROM rc WHERE trim(image_path) <> '' GROUP BY 1",
    "dedupe_first": _RC + ", d AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, record_id) AS r FROM rc WHERE image_path IS NOT NULL) SELECT image_path, record_id, split FROM d WHERE r = 1",
    "species_intersection": "SELECT species_id FROM train WHERE species_id IS NOT NULL INTERSECT SELECT species_id FROM val INTERSECT SELECT species_id FROM test",
    "split_difference": "SELECT DISTINCT image_path FROM train WHERE image_path IS NOT NULL AND image_path NOT IN (SELECT image_path FROM val WHERE image_path IS NOT NULL UNION ALL SELECT image_path FROM test WHERE image_path IS NOT NULL)",
    "coverage_report": _RC + " " + " UNION ALL ".join(f"SELECT split, 'feat_{c}' AS class_name, count(*) FILTER (h{i}) AS images FROM rc GROUP BY 1" for i, c in enumerate(A.CLASSES)),
    "species_distribution": _RC + " SELECT split, species_id, count(*) AS n FROM rc WHERE species_id IS NOT NULL GROUP BY 1, 2",
    "proximity_gated": f"""WITH {A.POLY}, o AS (SELECT image_id, annotation_id AS id, class_id, {A.AREA} AS area, {A.XS} AS xs, {A.YS} AS ys FROM poly WHERE points IS NOT NULL AND image_id IS NOT NULL AND class_id IS NOT NULL),
li AS (SELECT class_id, quantile_cont(area, 0.1) AS p FROM o GROUP BY 1), v AS (SELECT image_id, id, class_id, area, unnest(xs) AS x, unnest(ys) AS y FROM o),
d AS (SELECT p.image_id, p.class_id, p.id AS a, q.id AS b, least(p.area, q.area) AS small, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM v p JOIN v q ON p.image_id = q.image_id AND p.class_id = q.class_id AND p.id < q.id GROUP BY ALL)
SELECT image_id, class_id, a, b, round(d, 8) AS distance FROM d JOIN li USING (class_id) WHERE d <= 20 AND small < p""",
    "proximity_pairs": f"""WITH {A.POLY}, o AS (SELECT image_id, annotation_id AS id, class_id, {A.XS} AS xs, {A.YS} AS ys FROM poly WHERE points IS NOT NULL AND image_id IS NOT NULL AND class_id IS NOT NULL),
v AS (SELECT image_id, id, class_id, unnest(xs) AS x, unnest(ys) AS y FROM o), d AS (SELECT p.image_id, p.class_id, p.id AS a, q.id AS b, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM v p JOIN v q ON p.image_id = q.image_id AND p.class_id = q.class_id AND p.id < q.id GROUP BY 1, 2, 3, 4)
SELECT image_id, class_id, a, b, round(d, 8) AS distance FROM d WHERE d <= 20""",
}
