"""Plain tables: CSV, matrices, species maps, true labels, logs (SRC-6..SRC-8, SRC-14..SRC-16)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_id


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-6: a CSV with a header; without a schema every column is text, so ids keep their zeros."""
    r = spark.read.option("header", True).option("encoding", "UTF-8")
    return (r.schema(schema) if schema else r).csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: a labelled square matrix as (a, b, d); labels of digits are padded to four."""
    t = spark.read.option("header", True).csv(path)
    names = t.columns[1:]
    t = t.toDF("_row", *[f"_{i}" for i in range(len(names))])  # labels may be any text
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("b"), F.col(f"_{i}").alias("d")) for i, n in enumerate(names)]))
    t = t.select("_row", cells.alias("c"))
    return t.select(canonical_id(F.col("_row")).alias("a"), canonical_id(F.col("c.b")).alias("b"), F.col("c.d").try_cast("double").alias("d"))


def read_species_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: (species_id, species_name) of a JSON object id -> name; ids in four digits, the last of equal ids counts."""
    text = Path(path).read_text(encoding="utf-8-sig")
    rows = {str(k).strip().zfill(4) if str(k).strip().isdigit() else str(k).strip(): str(v) for k, v in json.loads(text).items()}
    return spark.createDataFrame(sorted(rows.items()), "species_id string, species_name string")


def read_true_labels(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC-14: (image, true_species) of the first file there is: a JSON object, or a CSV with one of several headers.

    The last of equal images counts.  Without any file the table is empty.
    """
    path = next((p for p in paths if Path(p).exists()), None)
    if path is None:
        return spark.createDataFrame([], "image string, true_species string")
    if path.endswith(".json"):
        rows = [(str(k), str(v)) for k, v in json.loads(Path(path).read_text(encoding="utf-8-sig")).items()]
        return spark.createDataFrame(rows, "image string, true_species string")
    t = read_csv(spark, path)
    image = next((c for c in ("image", "file_name", "filename", "image_name") if c in t.columns), None)
    label = next((c for c in ("true_species_id", "true_species", "species_id", "species") if c in t.columns), None)
    if image is None or label is None:
        raise ValueError(f"{path}: no image or label column")
    t = t.select(F.trim(image).alias("image"), F.trim(label).alias("true_species"), F.monotonically_increasing_id().alias("_i"))
    return t.where("image is not null and true_species is not null").groupBy("image").agg(F.max_by("true_species", "_i").alias("true_species"))


def read_model(path: str) -> PipelineModel:
    """SRC-15."""
    return PipelineModel.load(path)


def epoch_means(log: DataFrame, epoch: str = "epoch") -> DataFrame:
    """SRC-16, AG-24: the mean of every numeric column per epoch."""
    cols = [f.name for f in log.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint") and f.name != epoch]
    return log.groupBy(epoch).agg(*[F.avg(f"`{c}`").alias(c) for c in cols])
