"""Instances against predictions, and what a confusion matrix says (J-8, J-9, AG-13..18, AG-33, WN-3).

A confusion matrix is long: (level keys..., gt_label, pred_label, n); the label
``background`` stands for the missing partner.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BACKGROUND = "background"


def candidates(gt: DataFrame, pred: DataFrame, measure: Callable[[Column, Column], Column], least: float, box_overlap: Callable[[Column, Column], Column], shape: str = "box") -> DataFrame:
    """J-8: pairs of an image whose similarity is at least ``least``, whatever their labels.

    ``gt``: image_id, gt_id, label, box[, points]; ``pred``: image_id, pred_id, label, box[, points].
    An equi-join on the image with an overlap of the boxes comes first; only what is
    left is measured, in a column of its own so that the cheap test goes before.
    """
    extra = [] if shape == "box" else [shape]
    g = gt.select("image_id", "gt_id", F.col("box").alias("gb"), *[F.col(c).alias("gs") for c in extra])
    p = pred.select(F.col("image_id").alias("_i"), "pred_id", F.col("box").alias("pb"), *[F.col(c).alias("ps") for c in extra])
    t = g.join(p, F.col("image_id") == F.col("_i")).where(box_overlap(F.col("gb"), F.col("pb")) > 0)
    a, b = ("gs", "ps") if extra else ("gb", "pb")
    return t.withColumn("iou", measure(F.col(a), F.col(b))).where(F.col("iou") >= least).select("image_id", "gt_id", "pred_id", "iou")


def greedy(cand: DataFrame) -> DataFrame:
    """J-9: one-to-one matches per image, best similarity first, ties by (gt, pred).

    A fold over the image's sorted candidates; no Python and no loop over images.  The
    list of an image's candidates is bounded by its own annotations.
    """
    kind = "array<struct<gt_id:bigint,pred_id:bigint,iou:double>>"
    order = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), "gt_id", "pred_id", "iou")))
    t = cand.groupBy("image_id").agg(order.alias("c"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda m: (m["gt_id"] == x["gt_id"]) | (m["pred_id"] == x["pred_id"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(x["gt_id"].alias("gt_id"), x["pred_id"].alias("pred_id"), x["iou"].alias("iou")))))

    t = t.select("image_id", F.inline(F.aggregate("c", F.array().cast(kind), step)))
    return t.select("image_id", "gt_id", "pred_id", "iou")


def instance_pairs(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """AG-13: (image_id, gt_label, pred_label) of matches and of the instances without a partner."""
    m = matches.join(gt.select("gt_id", F.col("label").alias("gt_label")), "gt_id").join(pred.select("pred_id", F.col("label").alias("pred_label")), "pred_id")
    lost = gt.join(matches.select("gt_id"), "gt_id", "left_anti").select("image_id", F.col("label").alias("gt_label"), F.lit(BACKGROUND).alias("pred_label"))
    extra = pred.join(matches.select("pred_id"), "pred_id", "left_anti").select("image_id", F.lit(BACKGROUND).alias("gt_label"), F.col("label").alias("pred_label"))
    return m.select("image_id", "gt_label", "pred_label").unionByName(lost).unionByName(extra)


def confusion(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AG-13: counts per (keys, gt_label, pred_label); zero cells do not exist (FL-11)."""
    return pairs.groupBy(*keys, "gt_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def rollup(pairs: DataFrame) -> DataFrame:
    """AG-14: the matrix per image, per species and as a whole by grouping sets.  ``pairs`` has image_id and species_id."""
    sets = [["image_id", "gt_label", "pred_label"], ["species_id", "gt_label", "pred_label"], ["gt_label", "pred_label"]]
    per = pairs.groupBy("image_id", "species_id", "gt_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.grouping("image_id") == 0, "image").when(F.grouping("species_id") == 0, "species").otherwise("whole")
    return per.groupingSets(sets, "image_id", "species_id", "gt_label", "pred_label").agg(level.alias("level"), F.sum("n").alias("n"))


def class_metrics(conf: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AG-15: tp, fp, fn, support, predicted, precision, recall and F1 per label; empty ratios are 0."""
    hit = F.when(F.col("gt_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    one = lambda col, name: conf.groupBy(*keys, F.col(col).alias("label")).agg(F.sum("n").alias(name), F.sum(hit).alias(f"tp_{name}"))
    t = one("gt_label", "support").join(one("pred_label", "predicted"), [*keys, "label"], "full_outer").na.fill(0, ["support", "predicted", "tp_support"])
    t = t.where(F.col("label") != BACKGROUND).withColumn("tp", F.col("tp_support"))
    t = t.withColumns({"fn": F.col("support") - F.col("tp"), "fp": F.col("predicted") - F.col("tp")})
    return _ratios(t).select(*keys, "label", "tp", "fp", "fn", "support", "predicted", "precision", "recall", "f1")


def _ratios(t: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def global_metrics(per_class: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AG-16: micro over the totals; macro over the labels with support; accuracy over the instances."""
    some = F.col("support") > 0
    t = per_class.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.coalesce(F.avg(F.when(some, F.col(c))), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.count_if(some).alias("labels"))
    t = _ratios(t)
    return t.select(*keys, "labels", "tp", "fp", "fn", F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")


def supported(metrics: DataFrame, least: int = 3) -> DataFrame:
    """FL-8: only rows with at least ``least`` true instances."""
    return metrics.where(F.col("support") >= least)


def trait_ranking(metrics: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """WN-3: per key the best labels by F1, recall and support; ties by label."""
    w = W.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("recall"), F.desc("support"), "label")
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def class_report(pairs: DataFrame) -> DataFrame:
    """AG-33: per-label metrics of single-label pairs with accuracy and macro and weighted means as rows of their own."""
    per = class_metrics(confusion(pairs))
    n = F.sum("support")
    mean = lambda c: F.avg(F.when(F.col("support") > 0, F.col(c)))
    cols = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("label"), *[mean(c).alias(c) for c in cols], n.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in cols], n.alias("support"))
    acc = F.try_divide(F.sum("tp"), n)
    accuracy = per.agg(F.lit("accuracy").alias("label"), *[acc.alias(c) for c in cols], n.alias("support"))
    return per.select("label", *cols, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def nearest_instance(cand: DataFrame) -> DataFrame:
    """WN-8: the most similar true instance of each prediction; ties by its id."""
    best = F.max_by(F.struct("gt_id", "iou"), F.struct("iou", (-F.col("gt_id")).alias("i")))
    return cand.groupBy("image_id", "pred_id").agg(best.alias("b")).select("image_id", "pred_id", "b.gt_id", "b.iou")


def prior_divergence(priors: DataFrame, predicted: DataFrame) -> DataFrame:
    """J-18: L1 distance of predicted presence and area per class from the species' priors; absent classes count 0.

    Both: species_id, class_id, presence, area.
    """
    k = ["species_id", "class_id"]
    p = predicted.select(*k, F.col("presence").alias("_p"), F.col("area").alias("_a"))
    t = priors.select(*k, "presence", "area").join(p, k, "full_outer").na.fill(0.0, ["presence", "area", "_p", "_a"])
    return t.groupBy("species_id").agg(F.sum(F.abs(F.col("presence") - F.col("_p"))).alias("presence_l1"), F.sum(F.abs(F.col("area") - F.col("_a"))).alias("area_l1"))
