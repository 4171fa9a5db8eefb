"""Queries of streams, logs, models, and round trips through writers and readers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import geometry as G
from ..operators import confidence as C
from ..operators import ml
from ..operators import nested as N
from ..sinks import writers
from ..sources import labels as L
from ..sources import tables as T
from ..streaming import incremental as I
from . import adapters as A
from . import features as Q


def epoch_mean(spark: SparkSession, sf: str) -> DataFrame:
    """AG-24 on events: means per day."""
    t = A.table(spark, sf, "events").select(F.to_date("ts").alias("epoch"), "value", F.col("user_id").cast("double").alias("user"))
    m = T.epoch_means(t)
    return m.select(F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), F.round("value", 8).alias("value"), F.round("user", 8).alias("user"))


def streaming_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2: the class pairs that overlap on an image arrive as files; a first run counts those there are, a second goes on with the rest."""
    pairs = R.written(Q._overlaps(spark, sf, F.when(F.col("points").isNotNull(), F.array("points"))), "pairs")
    seen = pairs.join(A.images(spark, sf).where("species_id is not null").select("image_id", "species_id"), "image_id").select("species_id", "a", "b")
    path, state = R.scratch(spark, "arrivals"), R.scratch(spark, "overlap-state")
    early = F.xxhash64("species_id", "a", "b") % 2 == 0
    out = None
    for part in (seen.where(early), seen.where(~early)):
        part.write.mode("append").parquet(path)
        out = I.resumed_counts(I.file_stream(spark, path), ["species_id", "a", "b"], state)
    return out


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows of a day over the events as a stream."""
    t = I.available_now(I.windowed_counts(I.file_stream(spark, sf, "events.parquet"), "ts", "event_type", "1 day", "2 days"), "windows")
    return t.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 8).alias("mean"))


def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: running means of an append-only log."""
    t = I.available_now(I.running_means(I.file_stream(spark, sf, "events.parquet"), "event_type", ["value"]), "log")
    return t.select("event_type", "n", F.round("value", 8).alias("value"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    cols = [f"x{i}" for i in range(64)]
    t = A.table(spark, sf, "embeddings")
    return t.select("vec_id", F.col("label").cast("string").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols


def rf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """ML-3, ML-8: a forest's five best classes per image."""
    t, cols = _vectors(spark, sf)
    model = ml.random_forest(cols, "label", trees=50, depth=10).fit(ml.balanced(t, "label"))
    return C.topk(ml.probabilities(model, t, "vec_id"), 5)


def rff_topk(spark: SparkSession, sf: str) -> DataFrame:
    """ML-4: the same with logistic regression on random Fourier features."""
    t, cols = _vectors(spark, sf)
    t, cols = ml.fourier_features(t, cols)
    model = ml.linear_model(cols, "label").fit(ml.balanced(t, "label"))
    return C.topk(ml.probabilities(model, t, "vec_id"), 5)


def cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    """ML-5: accuracy and macro-F1 per fold of the linear model."""
    t, cols = _vectors(spark, sf)
    p = R.written(ml.cross_predict(t, lambda: ml.linear_model(cols, "label"), "label", "vec_id", 3), "oof")
    return ml.cross_validate(p)


def label_files(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-5: the label file of each image as one text, a line for each part of an annotation and each outline of a run-length mask."""
    t = A.polygons(spark, sf, masks=True).where("image_id is not null and class_id is not null").withColumn("class_id", F.col("class_id") - 1)
    return writers.label_lines(t.withColumn("points", F.explode_outer("outlines")), 6)


def label_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-5, SRC-4: label texts of the polygons, all their parts, written and read again; class and area of every line."""
    path = R.scratch(spark, "labels")
    t = A.polygons(spark, sf).where("image_id is not null and class_id is not null").withColumn("class_id", F.col("class_id") - 1)
    t = t.withColumn("points", F.explode_outer(G.multipart(F.col("parts"), "split")))
    writers.label_lines(t, 6).where("text <> ''").select("text").write.option("lineSep", "\n").text(path)
    lines = spark.read.text(path).select(F.lit("all").alias("file"), F.lit(0).alias("label_idx"), F.col("value").alias("line")).where("trim(line) <> ''")
    t = L.parse_label_lines(lines, "dissimilarity", classes=14)
    return t.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area"))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1, SRC-6: totals per image written as CSV and read again, ids as text."""
    path = R.scratch(spark, "csv")
    writers.table(Q.image_totals(spark, sf), path, "csv")
    return T.read_csv(spark, path, "image_id string, species_id string, total_annotations long, total_area double, density_pct double")


def coco_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-10, SRC-1: documents written per image and flattened again; annotations per image."""
    t = R.written(A.polygons(spark, sf).where("points is not null and image_id is not null"), "polys")
    im = t.select(F.col("image_id").alias("id"), F.concat("image_id", F.lit(".jpg")).alias("file_name"), "width", "height").distinct()
    an = t.select(F.col("annotation_id").alias("id"), "image_id", F.col("class_id").alias("category_id"), "points", F.lit(1.0).alias("area"), "score")
    docs = writers.coco_document(im, an, A.categories(spark).select(F.col("class_id").alias("id"), "name"))
    flat = N.flatten(docs, "image_id", "document", payload=False)
    n = lambda tag: F.count_if(F.col("tag") == tag)
    return flat.groupBy(F.col("doc_id").alias("image_id")).agg(n("annotation").alias("annotations"), n("segment").alias("segments"), n("category").alias("categories"))


def coco_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AG-27: annotations, images and scores per kind and class."""
    t = A.polygons(spark, sf)
    return t.groupBy("kind", "class_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"), F.round(F.min("score"), 6).alias("score_min"), F.round(F.avg("score"), 8).alias("score_mean"), F.round(F.max("score"), 6).alias("score_max"))


def rename_files(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-16: a plan that gives photographs their species' number as a prefix."""
    t = A.images(spark, sf).where("file_name is not null and species_id is not null").select(F.lit("fotos").alias("folder"), F.concat_ws("/", "image_id", "file_name").alias("name"), "species_id")
    return writers.rename_plan(t, F.concat(F.col("species_id"), F.lit(".jpg")))


def class_values(spark: SparkSession, sf: str) -> DataFrame:
    """AG-30."""
    return A.annotations(spark, sf).groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).join(A.categories(spark), "class_id").select("name", "n")


def write_summary(df: DataFrame, path: str) -> dict:
    """SNK-4 for callers of the catalogue: one-row results as JSON."""
    writers.json_file(df, path)
    return json.loads(Path(path).read_text(encoding="utf-8"))


QUERIES = {f.__name__: f for f in (epoch_mean, streaming_overlap, event_windows, log_stream, rf_topk, rff_topk, cv_scores, label_files, label_roundtrip, csv_roundtrip, coco_roundtrip, coco_summary, rename_files, class_values)}
_POLY = f"WITH {A.POLY}"
SQL = {
    "epoch_mean": "SELECT strftime(ts, '%Y-%m-%d') AS epoch, round(avg(value), 8) AS value, round(avg(CAST(user_id AS DOUBLE)), 8) AS \"user\" FROM events GROUP BY 1",
    "streaming_overlap": Q._OVER + " SELECT species_id, a, b, n FROM oc",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2",
    "log_stream": "SELECT event_type, count(*) AS n, round(avg(value), 8) AS value FROM events GROUP BY 1",
    "label_roundtrip": f"{_POLY} SELECT CAST(class_id - 1 AS INT) AS class_id, count(*) AS n, round(sum(q1.ar / (width * height)), 2) AS area FROM q1 JOIN (SELECT DISTINCT annotation_id, kind, class_id, width, height FROM poly WHERE width > 0 AND height > 0 AND image_id IS NOT NULL AND class_id IS NOT NULL) USING (annotation_id, kind) GROUP BY 1",
    "csv_roundtrip": "SELECT * REPLACE (CAST(image_id AS VARCHAR) AS image_id) FROM (" + Q.SQL["image_totals"] + ")",
    "coco_roundtrip": f"{_POLY} SELECT image_id, count(*) AS annotations, count(*) AS segments, 14 AS categories FROM poly WHERE points IS NOT NULL AND image_id IS NOT NULL GROUP BY 1",
    "coco_summary": f"{_POLY} SELECT kind, class_id, count(*) AS n, count(DISTINCT image_id) AS images, round(min(score), 6) AS score_min, round(avg(score), 8) AS score_mean, round(max(score), 6) AS score_max FROM poly GROUP BY 1, 2",
    "rename_files": A.BASE + ", f AS (SELECT image_id || '/' || file_name AS name, species_id || '.jpg' AS want, species_id FROM img WHERE file_name IS NOT NULL AND species_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY CAST(name <> want AS INT), name) - 1 AS n FROM f) SELECT 'fotos' AS folder, name AS old, CASE WHEN n = 0 THEN want ELSE species_id || '_' || n || '.jpg' END AS new, name <> CASE WHEN n = 0 THEN want ELSE species_id || '_' || n || '.jpg' END AS change FROM r",
    "class_values": A.BASE + " SELECT name, count(*) AS n FROM ann JOIN cat USING (class_id) GROUP BY 1",
}
