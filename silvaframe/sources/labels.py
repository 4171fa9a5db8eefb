"""Polygon label files, class names, image listings and split files (SRC-4, SRC-5, SRC-9..SRC-13, SRC-17, FN-14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import geometry as G

IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


@dataclass(frozen=True)
class Mode:
    """What a reader of label lines accepts.

    ``tokens``: least number of tokens.  ``whole``: the class must be written as a whole
    number (else 1.0 is 1).  ``ranged``: the class must be known.  ``odd``: what an odd
    number of coordinates does: ``skip`` the line, count it with ``area0``, ``cut`` the
    last value, or ``keep`` the line as invalid.  ``bad``: ``skip``, ``raise`` or ``keep``.
    """

    tokens: int
    whole: bool
    ranged: bool
    odd: str
    bad: str


MODES = {
    "evaluation": Mode(7, False, False, "skip", "skip"),
    "vectors": Mode(1, True, False, "area0", "skip"),
    "dissimilarity": Mode(7, True, True, "area0", "skip"),
    "small_filter": Mode(7, True, False, "keep", "keep"),
    "small_flags": Mode(7, True, False, "cut", "raise"),
    "proximity": Mode(5, True, False, "cut", "raise"),
    "overlap": Mode(7, True, True, "skip", "skip"),
}


def read_label_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, label_idx, line): all lines but blank ones, with their position in the file."""
    t = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    t = t.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("label_idx", "line"))
    return t.where(F.trim("line") != "")


def parse_label_lines(lines: DataFrame, mode: str | Mode, classes: int | None = None) -> DataFrame:
    """SRC-4, FN-14: (file, label_idx, line, class_id, coords, area, valid) of the lines that the mode accepts.

    Coordinates are as they stand in the file (0..1).  Area is 0 for lines whose
    coordinates make no polygon.
    """
    m = MODES[mode] if isinstance(mode, str) else mode
    tok = F.split(F.trim("line"), r"\s+")
    head = F.get(tok, F.lit(0))
    number = head.try_cast("double")
    cls = F.when(head.rlike(r"^[+-]?\d+$"), head.try_cast("int")) if m.whole else F.when(~F.isnan(number), F.try_divide(number, F.lit(1.0)).cast("int"))
    coords = F.transform(F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    t = lines.withColumns({"class_id": cls, "coords": coords})
    parsed = F.col("class_id").isNotNull() & ~F.exists("coords", lambda x: x.isNull()) & (F.size(tok) >= m.tokens)
    if m.ranged:
        if classes is None:
            raise ValueError("this mode needs the number of classes")
        parsed = parsed & F.col("class_id").between(0, classes - 1)
    odd = F.size("coords") % 2 == 1
    if m.odd == "cut":
        t = t.withColumn("coords", F.when(odd, F.slice("coords", 1, F.size("coords") - 1)).otherwise(F.col("coords")))
        good = parsed
    elif m.odd == "area0":
        good = parsed
    else:
        good = parsed & ~odd
    t = t.withColumn("valid", good)
    if m.bad == "raise":
        t = t.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("bad label line in "), F.col("file"), F.lit(": "), F.col("line"))).cast("boolean")))
    elif m.bad == "skip":
        t = t.where("valid")
    return t.withColumn("area", F.when(F.col("valid"), G.area(F.col("coords"))).otherwise(0.0)).select("file", "label_idx", "line", "class_id", "coords", "area", "valid")


def drop_small(parsed: DataFrame, least: float = 0.003) -> DataFrame:
    """FL-5: lines whose polygon has at least ``least``; lines that are no polygon stay as they are."""
    return parsed.where(~F.col("valid") | (F.col("area") >= least))


def flag_small(parsed: DataFrame, sizes: DataFrame, least_px: float = 20.0) -> DataFrame:
    """FL-6: polygons below ``least_px`` square pixels with their centre in pixels.  ``sizes``: file, width, height."""
    t = parsed.where("valid").join(sizes, "file")
    px = F.transform("coords", lambda v, i: v * F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    t = t.withColumn("px", px).withColumn("area_px", G.area(F.col("px"))).where(F.col("area_px") < least_px)
    c = G.centroid(F.col("px"))
    return t.select("file", "label_idx", "class_id", c["x"].alias("x_px"), c["y"].alias("y_px"), "area_px")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: (class_id, name) of a data.yaml whose ``names`` is a list or a mapping; names stay text."""
    import yaml

    with open(path, encoding="utf-8") as f:
        names = (yaml.safe_load(f) or {}).get("names")
    if isinstance(names, dict):
        rows = sorted((int(k), str(v)) for k, v in names.items())
    elif isinstance(names, list):
        rows = [(i, str(v)) for i, v in enumerate(names)]
    else:
        raise ValueError(f"{path}: names is neither a list nor a mapping")
    return spark.createDataFrame(rows, "class_id int, name string")


def scan_images(spark: SparkSession, path: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """SRC-9: (path, length) of the image files below a folder, sorted; their content is never read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return t.select("path", "length").where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*types)).orderBy("path")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: (path, width, height) of images; unreadable ones are left out."""
    t = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return t.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def first_column(df: DataFrame, *names: str) -> str | None:
    """The first of the candidate columns that a table has."""
    return next((n for n in names if n in df.columns), None)


def split_records(df: DataFrame, image: tuple[str, ...] = ("image_path", "image", "image_name", "path"), label: tuple[str, ...] = ("label_path", "label", "label_name"), species: tuple[str, ...] = ("species_id", "species"), task: tuple[str, ...] = ("task", "task_name")) -> DataFrame:
    """SRC-11, SRC-17: (image, label, species) from a split table with loose headers.

    Backslashes become slashes; blank and ``nan`` are no value; the species falls back to
    the task's leading digits and then to ``unknown``.  A table without an image column raises.
    """
    col = first_column(df, *image)
    if col is None:
        raise ValueError("no image column")

    def text(name: str | None) -> Column:
        if name is None:
            return F.lit(None).cast("string")
        s = F.trim(F.col(name).cast("string"))
        return F.when(F.lower(s).isin("", "nan"), F.lit(None)).otherwise(s)

    slash = lambda c: F.translate(c, "\\", "/")
    digits = F.nullif(F.regexp_extract(text(first_column(df, *task)), r"^(\d+)", 1), F.lit(""))
    t = df.select(slash(text(col)).alias("image"), slash(text(first_column(df, *label))).alias("label"), F.coalesce(text(first_column(df, *species)), digits, F.lit("unknown")).alias("species"))
    return t.where("image is not null")


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: the non-blank lines of a list file; the species is unknown."""
    return spark.read.text(path).select(F.trim("value").alias("image"), F.lit("unknown").alias("species")).where("image <> ''")


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: (split, image, species) of the list files that a dataset.yaml names for train, val and test, below its ``path``."""
    import yaml

    d = yaml.safe_load(R.read_text(spark, path)) or {}
    base = d.get("path") or path.rsplit("/", 1)[0]
    out = None
    for split in ("train", "val", "test"):
        for name in d[split] if isinstance(d.get(split), list) else [d[split]] if d.get(split) else []:
            own = split_list(spark, name if "://" in name or name.startswith("/") else f"{base}/{name}").select(F.lit(split).alias("split"), "image", "species")
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError(f"{path} names no list")
    return out


def resolve_paths(records: DataFrame, key: str, candidates: Column, listing: DataFrame, path: str = "path") -> DataFrame:
    """SRC-13: (key, resolved): the first of each record's candidate paths that the listing has; null if none has."""
    t = records.select(F.col(key).alias("_k"), F.posexplode(candidates).alias("_p", "_c"))
    hit = t.join(listing.select(F.col(path).alias("_c")).distinct(), "_c").groupBy("_k").agg(F.min_by("_c", "_p").alias("resolved"))
    return records.select(F.col(key)).distinct().join(hit, F.col(key) == F.col("_k"), "left").select(key, "resolved")


def label_of_image(path: Column) -> Column:
    """SRC-13: the label file beside an image: the last ``images`` folder becomes ``labels``, the type ``.txt``."""
    p = F.translate(path, "\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(.*/)?images/(?!.*/images/)", "$1labels/"), r"\.[^./]+$", ".txt")
