"""Annotations that are too near to one of their own class (J-7, ST-5, ML-11, ML-12)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import raster


def near_pairs(polys: DataFrame, most: float = 20.0) -> DataFrame:
    """J-7: pairs of an image and class whose least vertex distance is at most ``most``.

    ``polys``: image_id, annotation_id, class_id, points.  Boxes grown by the distance
    must meet before any vertex is compared.
    """
    t = polys.select("image_id", "class_id", "annotation_id", "points", G.box(F.col("points")).alias("box"))
    a = t.select("image_id", "class_id", F.col("annotation_id").alias("a"), F.col("points").alias("pa"), F.col("box").alias("ba"))
    b = t.select(F.col("image_id").alias("_i"), F.col("class_id").alias("_c"), F.col("annotation_id").alias("b"), F.col("points").alias("pb"), F.col("box").alias("bb"))
    apart = (F.col("ba.x0") - F.col("bb.x1") > most) | (F.col("bb.x0") - F.col("ba.x1") > most) | (F.col("ba.y0") - F.col("bb.y1") > most) | (F.col("bb.y0") - F.col("ba.y1") > most)
    p = a.join(b, (F.col("image_id") == F.col("_i")) & (F.col("class_id") == F.col("_c")) & (F.col("a") < F.col("b")) & ~apart)
    p = p.withColumn("distance", G.min_vertex_distance(F.col("pa"), F.col("pb")))
    return p.where(F.col("distance") <= most).select("image_id", "class_id", "a", "b", "distance", "pa", "pb")


def small_pairs(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """FL-7: the near pairs of which at least one outline is smaller than its class's limit; a class without a limit keeps all.

    ``pairs``: as of ``near_pairs``.  ``limits``: class_id, p.
    """
    t = pairs.join(limits.select("class_id", F.col("p").alias("_limit")), "class_id", "left")
    return t.where(F.col("_limit").isNull() | (F.least(G.area(F.col("pa")), G.area(F.col("pb"))) < F.col("_limit"))).select(*pairs.columns)


def duplicates(polys: DataFrame, least_pct: float = 95.0) -> DataFrame:
    """ML-11: annotations to discard: (image_id, class_id, annotation_id, kept_id, overlap_pct).

    Within an image and class, in the order of the ids: of two that overlap by more than
    ``least_pct`` of the larger, the one with fewer vertices goes (the later one of
    equals), and what is discarded is not compared again.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("annotation_id", ignore_index=True)
        ids, pts = f["annotation_id"].tolist(), f["points"].tolist()
        box = np.array([[p[::2].min(), p[1::2].min(), p[::2].max(), p[1::2].max()] for p in map(np.asarray, pts)])
        dead, out = set(), []
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if i in dead:
                    break
                if j in dead or (box[i, :2] > box[j, 2:]).any() or (box[j, :2] > box[i, 2:]).any():
                    continue
                pct = raster.overlap_pct(pts[i], pts[j])
                if pct > least_pct:
                    lose, keep = (i, j) if len(pts[i]) < len(pts[j]) else (j, i)
                    dead.add(lose)
                    out.append((f["image_id"].iat[0], f["class_id"].iat[0], ids[lose], ids[keep], pct))
        return pd.DataFrame(out, columns=["image_id", "class_id", "annotation_id", "kept_id", "overlap_pct"])

    t = polys.select("image_id", "class_id", "annotation_id", "points").where("points is not null")
    return t.groupBy("image_id", "class_id").applyInPandas(run, "image_id long, class_id int, annotation_id long, kept_id long, overlap_pct double")


def apply_decisions(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """ML-12: annotations without those that the review log deletes; the last decision on an id counts.

    ``decisions``: annotation_id, decision (``keep`` or ``delete``), step.
    """
    last = decisions.groupBy("annotation_id").agg(F.max_by("decision", "step").alias("decision"))
    return annotations.join(last.where("decision = 'delete'").select("annotation_id"), "annotation_id", "left_anti")
