"""COCO documents as tables (SRC-1..SRC-3, SRC-10)."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested as N

ANNOTATION = "category_id int, segmentation string, bbox array<double>, area double, iscrowd int, score double"
IMAGE = "file_name string, width int, height int, _species string, _split string"
CATEGORY = "name string, supercategory string"


@dataclass(frozen=True)
class Coco:
    """The three tables; every row keeps the id of its document."""

    categories: DataFrame
    images: DataFrame
    annotations: DataFrame


def resolve(path: str) -> str:
    """SRC-2: a file as it is, a folder's first ``*.json`` by name, or the path with ``.json`` added; raises if there is none."""
    p = Path(path)
    if p.is_dir():
        found = sorted(p.glob("*.json"))
        if found:
            return str(found[0])
    elif p.exists():
        return str(p)
    elif p.with_name(p.name + ".json").exists():
        return str(p.with_name(p.name + ".json"))
    raise FileNotFoundError(path)


def read(spark: SparkSession, *paths: str, required: tuple[str, ...] = ("images", "annotations", "categories")) -> Coco:
    """SRC-1: whole files, each a document, parsed once; ``segmentation`` stays text, whatever its form.

    SRC-2: raises if a document is invalid or lacks one of the ``required`` lists.
    """
    raw = spark.read.text(list(paths), wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("file"), "value")
    notes = N.Table("annotation", "annotations", parent_field="image_id")
    path = N.write_tables(N.flatten(raw, "doc_id", "value", spec=(N.COCO[0], N.COCO[1], notes), lists=True))
    has = N.read_table(spark, path, N.DOCUMENT).select("doc_id", F.from_json("payload", "array<string>").alias("lists"))
    names = F.array(*[F.lit(n) for n in required])
    bad = raw.select("doc_id", "file").join(has, "doc_id", "left").where(F.col("lists").isNull() | (F.size(F.array_except(names, "lists")) > 0))
    bad = bad.select("file", F.coalesce(F.array_join(F.array_except(names, "lists"), ", "), F.lit("COCO document")).alias("lacks")).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}: no {r['lacks']}" for r in bad))
    num = lambda c: F.expr(f"try_cast({c} as bigint)")
    cats = N.read_table(spark, path, "category", CATEGORY).select("doc_id", num("pk").cast("int").alias("id"), "o.*").distinct()
    imgs = N.read_table(spark, path, "image", IMAGE).select("doc_id", num("pk").alias("id"), "o.*").distinct()
    anns = N.read_table(spark, path, "annotation", ANNOTATION).select("doc_id", num("pk").alias("id"), num("parent").alias("image_id"), "o.*").distinct()
    return Coco(cats, imgs, anns)


def class_table(categories: DataFrame) -> DataFrame:
    """SRC-3: categories by id with the 0-based class of label files."""
    return categories.select("id", "name").distinct().withColumn("class_id", F.col("id") - 1).orderBy("id")


def polygons_of(segmentation):
    """Parts of a segmentation column: a list of flat polygons, or one flat polygon as a single part; other forms have none."""
    flat = F.from_json(segmentation, "array<double>")
    none = F.array().cast("array<array<double>>")
    return F.when(F.trim(segmentation).rlike(r"^\[\s*\["), F.from_json(segmentation, "array<array<double>>")).when(F.trim(segmentation).rlike(r"^\[\s*[-0-9]"), F.array(flat)).otherwise(none)
