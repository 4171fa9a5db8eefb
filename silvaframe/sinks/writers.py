"""Writers (SNK-1 .. SNK-16).  Results are written as folders of Parquet or CSV parts; single files only for what a driver may hold."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import geometry as G

#: Rows that a single-file writer takes at most; more raise.
MOST = 100_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows: write a folder instead")
    return rows


def table(df: DataFrame, path: str, form: str = "parquet", mode: str = "error", by: list[str] = ()) -> None:
    """SNK-1, SNK-8, SNK-13: a folder of parts, by column values if given; ``append`` adds to it."""
    w = df.write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    w.option("header", True).format(form).save(path)


def csv_file(df: DataFrame, path: str, bom: bool = False) -> None:
    """SNK-1: one small CSV file, replaced as a whole (SNK-9)."""
    rows = _rows(df)
    tmp = Path(f"{path}.tmp")
    with tmp.open("w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows(["" if v is None else v for v in r] for r in rows)
    os.replace(tmp, path)


def wide_features(df: DataFrame, path: str, key: list[str], schema_path: str | None = None) -> None:
    """SNK-2: a wide table in its own column order, with a JSON file that names the columns and their kinds."""
    table(df, path, "csv", "overwrite")
    if schema_path:
        json_file({"key": key, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]}, schema_path)


def matrix_files(m: DataFrame, path: str) -> None:
    """SNK-3: a small matrix (a, b, d) as labelled CSV and as float32 ``.npz`` with its labels."""
    import numpy as np

    from ..operators.matrix import square

    labels, d = square(m)
    with open(f"{path}.csv", "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(["", *labels])
        w.writerows([n, *map(float, row)] for n, row in zip(labels, d, strict=True))
    np.savez(f"{path}.npz", labels=np.array(labels), matrix=d.astype(np.float32))


def json_file(value, path: str) -> None:
    """SNK-4, SNK-9: a JSON file; a one-row DataFrame becomes an object."""
    if isinstance(value, DataFrame):
        row = value.limit(2).collect()
        if len(row) != 1:
            raise ValueError("a summary has one row")
        value = row[0].asDict(recursive=True)
    tmp = Path(f"{path}.tmp")
    tmp.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    os.replace(tmp, path)


def label_lines(polys: DataFrame, digits: int = 6) -> DataFrame:
    """SNK-5: (image_id, text): the label file of each image, its lines by annotation id.

    ``polys``: image_id, annotation_id, class_id (0-based), points, width, height.  An image
    whose annotations have no points gets an empty text; without a size it is left out.
    """
    t = polys.where("width > 0 and height > 0")
    line = G.label_line(F.col("class_id"), F.col("points"), F.col("width"), F.col("height"), digits)
    t = t.select("image_id", F.struct("annotation_id", F.coalesce(line, F.lit("")).alias("line")).alias("s"))
    t = t.groupBy("image_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # an image's own annotations
    return t.select("image_id", F.array_join(F.filter(F.col("s.line"), lambda x: x != ""), "\n").alias("text"))


def label_files(texts: DataFrame, folder: str) -> None:
    """SNK-5: one ``image_id.txt`` per row, written by the executors to a folder that all of them share."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            tmp = os.path.join(folder, f".{r['image_id']}.{os.getpid()}")
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(r["text"])
            os.replace(tmp, os.path.join(folder, f"{r['image_id']}.txt"))

    texts.select("image_id", "text").foreachPartition(run)


def overwrite_guard(folder: str, new: int, most: float = 0.5, pattern: str = "*.txt") -> None:
    """SNK-6: raises if the number of files would change by more than ``most`` of the old one."""
    old = len(list(Path(folder).glob(pattern))) if Path(folder).is_dir() else 0
    if old and abs(new - old) / old > most:
        raise ValueError(f"{folder} has {old} files, {new} would replace them")


def replace_folder(df: DataFrame, path: str, form: str = "parquet") -> None:
    """SNK-7, SNK-9: write beside the old folder, move the old one aside, put the new one in its place, then remove the old.

    Nothing is removed before the new folder stands; what a crash has left aside, ``recover_folder`` puts back.
    """
    spark = df.sparkSession
    recover_folder(spark, path)
    fs, target = R.hadoop(spark, path)
    table(df, f"{path}.new", form, "overwrite")
    new, old = R.hadoop(spark, f"{path}.new")[1], R.hadoop(spark, f"{path}.old")[1]
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, target):
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def recover_folder(spark: SparkSession, path: str) -> bool:
    """Put back what an interrupted ``replace_folder`` moved aside; whether there was anything to do."""
    fs, target = R.hadoop(spark, path)
    old = R.hadoop(spark, f"{path}.old")[1]
    if not fs.exists(old):
        return False
    if fs.exists(target):  # the new folder stands already
        fs.delete(old, True)
    elif not fs.rename(old, target):
        raise OSError(f"{path} could not be put back")
    return True


def split_dataset(records: DataFrame, folder: str, names: list[str]) -> str:
    """SNK-13: a CSV folder and a list folder of images per split, and a dataset.yaml that names the lists and the classes; its path.

    ``records`` has split and image_path; all its columns go to the CSV files.
    """
    spark = records.sparkSession
    splits = sorted(r[0] for r in records.select("split").distinct().collect())  # a few names
    for s in splits:
        own = records.where(F.col("split") == s)
        table(own, f"{folder}/{s}.csv", "csv", "overwrite")
        own.where("image_path is not null").select("image_path").distinct().write.mode("overwrite").text(f"{folder}/{s}.txt")
    lines = [f"path: {json.dumps(folder)}", *(f"{s}: {s}.txt" for s in splits), "names:", *(f"  {i}: {json.dumps(n)}" for i, n in enumerate(names))]
    R.remove(spark, f"{folder}/dataset.yaml")
    R.write_text(spark, f"{folder}/dataset.yaml", "\n".join(lines) + "\n")
    return f"{folder}/dataset.yaml"


def done(df_or_none, path: str) -> bool:
    """SNK-9: whether a result is complete already, so that a step can be skipped."""
    return (Path(path) / "_SUCCESS").exists() or Path(path).is_file()


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """SNK-10: (image_id, document): a COCO document per image, coordinates and areas with 2 decimals, scores with 4.

    Documents are per image, so none grows with the data; ``nested.flatten`` reads them back.
    ``annotations``: id, image_id, category_id, points, area, score.
    """
    r2 = lambda c: F.transform(c, lambda v: F.round(v, 2))
    b = G.box(F.col("points"))
    box = F.array(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])
    a = annotations.select("image_id", F.struct("id", "image_id", "category_id", F.array(r2(F.col("points"))).alias("segmentation"), r2(box).alias("bbox"), F.round("area", 2).alias("area"), F.lit(0).alias("iscrowd"), F.round("score", 4).alias("score")).alias("o"))
    a = a.groupBy("image_id").agg(F.sort_array(F.collect_list("o")).alias("annotations"))
    cats = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))  # the classes
    t = images.join(a, images["id"] == a["image_id"], "left").join(F.broadcast(cats))
    doc = F.to_json(F.struct(F.array(F.struct("id", "file_name", "width", "height")).alias("images"), F.coalesce("annotations", F.array().cast(a.schema["annotations"].dataType)).alias("annotations"), "categories"))
    return t.select(F.col("id").alias("image_id"), doc.alias("document"))


def square_confusion(conf: DataFrame, labels: list[str]) -> DataFrame:
    """SNK-11: the square form: a row per true label, a column per predicted one, zeros filled in."""
    t = conf.groupBy("gt_label").pivot("pred_label", labels).agg(F.sum("n")).na.fill(0)
    every = conf.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "gt_label string, _i int")
    return every.join(t, "gt_label", "left").na.fill(0).orderBy("_i").drop("_i")


def latex_table(hit_rates: dict[str, tuple[float, float, float]]) -> str:
    """SNK-12: hit rates at 1, 3 and 5 per model in percent."""
    body = "\n".join(f"{m.replace('_', ' ')} & " + " & ".join(f"{100 * v:.1f}" for v in r) + r" \\" for m, r in sorted(hit_rates.items()))
    return "\\begin{tabular}{lrrr}\n\\hline\nModel & hit@1 & hit@3 & hit@5 \\\\\n\\hline\n" + body + "\n\\hline\n\\end{tabular}\n"


def rename_plan(files: DataFrame, new_name) -> DataFrame:
    """SNK-16: (folder, old, new, change): new names of a listing, later ones of a collision with _1, _2, ...; nothing is renamed.

    ``files``: folder, name.  ``new_name``: a column; a file that has it already stays.
    """
    t = files.withColumn("want", new_name)
    stem, ext = F.regexp_replace("want", r"\.[^.]*$", ""), F.regexp_extract("want", r"(\.[^.]*)$", 1)
    n = F.row_number().over(W.partitionBy("folder", "want").orderBy((F.col("name") != F.col("want")).cast("int"), "name")) - 1
    t = t.withColumn("n", n)
    new = F.when(F.col("n") == 0, F.col("want")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), ext))
    return t.select("folder", F.col("name").alias("old"), new.alias("new"), (F.col("name") != new).alias("change"))
