"""Per-annotation rows to image, species and class features (J-1..J-3, AG-1..AG-12, AG-21..AG-23).

Frames: ``images`` (image_id, species_id, img_area, ...), one row each;
``annotations`` (annotation_id, image_id, class_id, area_frac, ...), one row each.
Results stay long - a row per image or species and class - until a sink wants
them wide.  Zero rows for absent classes come from exploding the list of classes,
so nothing is crossed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import runtime as R

SHAPES = ("log_area", "sphericity", "log_aspect", "log_elong", "bbox_extent")


def every_class(df: DataFrame, classes: list[int]) -> DataFrame:
    """Each row once per class."""
    return df.withColumn("class_id", F.explode(F.array(*[F.lit(c) for c in classes])))


def filled(keys: DataFrame, agg: DataFrame, on: list[str], classes: list[int], zeros: list[str]) -> DataFrame:
    """J-3: every key and class; absent aggregates are 0."""
    return every_class(keys, classes).join(agg, [*on, "class_id"], "left").na.fill(0, zeros)


# -- features of the classifier -------------------------------------------------


def class_features(images: DataFrame, annotations: DataFrame, classes: list[int]) -> DataFrame:
    """AG-1: count, sum, mean, sample deviation (0 for one) and density in % of the areas per image and class."""
    t = annotations.join(images.select("image_id", "img_area"), "image_id").withColumn("area", F.col("area_frac") * F.col("img_area"))
    std = F.coalesce(F.stddev_samp("area"), F.lit(0.0))
    agg = t.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area_sum"), F.avg("area").alias("area_mean"), std.alias("area_std"))
    out = filled(images.select("image_id", "species_id", "img_area"), agg, ["image_id"], classes, ["n", "area_sum", "area_mean", "area_std"])
    density = F.coalesce(F.try_divide(F.col("area_sum") * 100, F.col("img_area")), F.lit(0.0))
    return out.withColumn("density_pct", density).drop("img_area")


def wide(features: DataFrame, key: list[str], values: dict[str, str], classes: list[int], prefix: str) -> DataFrame:
    """SNK-2: one row per key with a column per class and value, in a fixed order."""
    aggs = [F.first(v).alias(name) for v, name in values.items()]
    t = features.groupBy(*key).pivot("class_id", classes).agg(*aggs)
    cols = [F.col(f"{c}_{name}" if len(values) > 1 else str(c)).alias(f"{prefix}{c}_{name}") for c in classes for name in values.values()]
    return t.select(*key, *cols)


def image_totals(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """AG-2: annotations, their area and its share of the image in %; images without annotations stay."""
    agg = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area_frac").alias("frac"))
    t = images.select("image_id", "species_id", "img_area").join(agg, "image_id", "left").na.fill(0, ["n", "frac"])
    return t.select("image_id", "species_id", F.col("n").alias("total_annotations"), F.coalesce(F.col("frac") * F.col("img_area"), F.lit(0.0)).alias("total_area"), (F.col("frac") * 100).alias("density_pct"))


def dissimilarity_features(images: DataFrame, annotations: DataFrame, classes: list[int]) -> DataFrame:
    """AG-3 with FN-35: count and area share per image and class, each divided by the image's sum."""
    agg = annotations.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area_frac").alias("area"))
    sums = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_all"), F.sum("area_frac").alias("area_all"))
    t = filled(images.select("image_id", "species_id"), agg, ["image_id"], classes, ["n", "area"]).join(sums, "image_id", "left")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return t.select("image_id", "species_id", "class_id", "n", "area", share("n", "n_all").alias("n_share"), share("area", "area_all").alias("area_share"))


# -- statistics and trait scores --------------------------------------------------


def dataset_stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """AG-4: instances, images and area per class and per (species, class) by grouping sets; species null is the whole."""
    t = annotations.join(images.select("image_id", "species_id"), "image_id").groupBy("image_id", "species_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area_frac").alias("area"))
    t = t.withColumn("species_id", F.coalesce("species_id", F.lit("unknown")))
    out = t.groupingSets([["species_id", "class_id"], ["class_id"]], "species_id", "class_id").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("images"), F.sum("area").alias("area"), F.grouping("species_id").alias("whole"))
    return out


def trait_scores(images: DataFrame, annotations: DataFrame, classes: list[int], weights: tuple[float, float, float] = (0.5, 0.2, 0.3), full: int = 5) -> DataFrame:
    """AG-5: local, species and global share of an image's count of a class, and their score.

    The species weight counts as far as the species is reliable (FN-37); what it loses
    goes to the global one.  Weights must add up to 1 (AG-6).  Absent classes score 0.
    """
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    wl, ws, wg = weights
    im = images.select("image_id", "species_id")
    n = annotations.join(im, "image_id").groupBy("image_id", "species_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    # the rows lie by image, so the image's sum needs no shuffle; written once, as three sums and the scores read it
    n = R.written(n.withColumn("of_image", F.sum("n").over(W.partitionBy("image_id"))), "counts")
    per_species = n.groupBy("species_id", "class_id").agg(F.sum("n").alias("of_species"))
    per_class = per_species.groupBy("class_id").agg(F.sum("of_species").alias("of_class"))
    size = im.groupBy("species_id").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / F.lit(float(full))).alias("reliability"))
    t = n.join(per_species.select(F.col("species_id").alias("_s"), F.col("class_id").alias("_c"), "of_species"), F.col("species_id").eqNullSafe(F.col("_s")) & (F.col("class_id") == F.col("_c"))).drop("_s", "_c")
    t = t.join(per_class, "class_id").join(size.withColumnRenamed("species_id", "_s"), F.col("species_id").eqNullSafe(F.col("_s"))).drop("_s")
    local, sp, gl = F.col("n") / F.col("of_image"), F.col("n") / F.col("of_species"), F.col("n") / F.col("of_class")
    score = wl * local + ws * F.col("reliability") * sp + (wg + ws * (1 - F.col("reliability"))) * gl
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)
    t = t.select("image_id", "class_id", "n", local.alias("local"), sp.alias("species"), gl.alias("global"), score.alias("score"))
    return filled(im, t, ["image_id"], classes, ["n", "local", "species", "global", "score"])


# -- proximity features and species signatures -----------------------------------


def proximity_features(annotations: DataFrame, classes: list[int]) -> DataFrame:
    """AG-7: presence, area and mean and population deviation of the shape keys, for images with annotations."""
    t = annotations.where("area_frac is not null")
    aggs = [F.sum("area_frac").alias("area")]
    for k in SHAPES:
        aggs += [F.avg(k).alias(k), F.stddev_pop(k).alias(f"{k}_std")]
    agg = t.groupBy("image_id", "class_id").agg(F.lit(1).alias("presence"), *aggs)
    zeros = ["presence", "area", *SHAPES, *[f"{k}_std" for k in SHAPES]]
    return filled(t.select("image_id").distinct(), agg, ["image_id"], classes, zeros)


def signature_b1(prox: DataFrame, images: DataFrame) -> DataFrame:
    """AG-8: mean presence, and mean area divided by the species' sum."""
    t = prox.join(images.select("image_id", "species_id"), "image_id").where("species_id is not null")
    m = t.groupBy("species_id", "class_id").agg(F.avg("presence").alias("presence"), F.avg("area").alias("area"))
    s = m.groupBy("species_id").agg(F.sum(F.abs("area")).alias("s"))
    return m.join(s, "species_id").select("species_id", "class_id", "presence", F.coalesce(F.try_divide("area", "s"), F.lit(0.0)).alias("area_share"))


def signature_b2(prox: DataFrame, images: DataFrame) -> DataFrame:
    """AG-9: means of the shape keys and their deviations over the images that have the class; 0 if none has."""
    t = prox.join(images.select("image_id", "species_id"), "image_id").where("species_id is not null")
    keys = [k for s in SHAPES for k in (s, f"{s}_std")]
    return t.groupBy("species_id", "class_id").agg(*[F.coalesce(F.avg(F.when(F.col("presence") == 1, F.col(k))), F.lit(0.0)).alias(k) for k in keys])


def signature_b3(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """AG-10: Jaccard index of two classes over a species' images, a <= b; pairs that never meet are left out (0).

    The union is n_a + n_b - both, so one join of each image's classes suffices.
    """
    p = annotations.where("area_frac is not null").join(images.select("image_id", "species_id"), "image_id").where("species_id is not null")
    p = p.groupBy("species_id", "image_id").agg(F.array_sort(F.collect_set("class_id")).alias("c"))  # at most one entry per class
    a = p.select("species_id", "c", F.posexplode("c").alias("i", "a"))
    both = a.select("species_id", "a", F.explode(F.slice("c", F.col("i") + 1, F.size("c"))).alias("b")).groupBy("species_id", "a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    both = R.written(both, "both")  # pairs per species; read three times
    one = both.where("a = b").select("species_id", F.col("a").alias("x"), F.col("n_both").alias("n_x"))
    t = both.join(one.select("species_id", F.col("x").alias("a"), F.col("n_x").alias("na")), ["species_id", "a"])
    t = t.join(one.select("species_id", F.col("x").alias("b"), F.col("n_x").alias("nb")), ["species_id", "b"])
    return t.select("species_id", "a", "b", "n_both", (F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard"))


def spatial_pairs(polys: DataFrame) -> DataFrame:
    """J-6: all pairs of annotations of an image, each once, with the distance of their centres over the image's diagonal.

    ``polys``: image_id, annotation_id, class_id, cx, cy, box, diagonal.
    """
    cols = ("annotation_id", "class_id", "cx", "cy", "box")
    a = polys.select("image_id", "diagonal", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = polys.select(F.col("image_id").alias("_i"), *[F.col(c).alias(f"b_{c}") for c in cols])
    p = a.join(b, (F.col("image_id") == F.col("_i")) & (F.col("a_annotation_id") < F.col("b_annotation_id"))).drop("_i")
    return p.withColumn("d", F.sqrt(F.pow(F.col("a_cx") - F.col("b_cx"), 2) + F.pow(F.col("a_cy") - F.col("b_cy"), 2)) / F.col("diagonal"))


def spatial_b4(polys: DataFrame, q: float, iou: Callable[[Column, Column], Column], containment: Callable[[Column, Column], Column]) -> DataFrame:
    """AG-11 long: per image and ordered class pair the median distance over the image's, the share of close pairs, mean IoU and containment.

    Close means at most the image's ``q``-quantile of distances.  A class with a single
    annotation is at distance 0 from itself and close to itself.  Images with one
    annotation have no row.  Everything lies by image, so the pair join is the only shuffle.
    """
    image = W.partitionBy("image_id")
    p = spatial_pairs(polys).withColumn("refs", F.percentile("d", F.array(F.lit(0.5), F.lit(q))).over(image))
    p = p.withColumns({"med": F.greatest(F.get("refs", F.lit(0)), F.lit(1e-12)), "close": (F.round("d", 9) <= F.round(F.get("refs", F.lit(1)), 9)).cast("double"), "iou": iou(F.col("a_box"), F.col("b_box"))})
    way = lambda x, y: F.struct(F.col(f"{x}_class_id").alias("a"), F.col(f"{y}_class_id").alias("b"), containment(F.col(f"{x}_box"), F.col(f"{y}_box")).alias("contain"))
    p = p.select("image_id", "d", "med", "close", "iou", F.inline(F.array(way("a", "b"), way("b", "a"))))  # both orders, after what they share
    t = p.groupBy("image_id", "a", "b").agg((F.median("d") / F.max("med")).alias("reldist"), F.avg("close").alias("closefrac"), F.avg("iou").alias("iou"), F.avg("contain").alias("contain"))
    n = polys.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    single = n.withColumn("all", F.sum("n").over(image)).where("n = 1 and all > 1")
    one = F.lit(1.0)
    self_pair = single.select("image_id", F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(0.0).alias("reldist"), one.alias("closefrac"), one.alias("iou"), one.alias("contain"))
    return t.unionByName(self_pair)


def species_b4(image_b4: DataFrame, images: DataFrame) -> DataFrame:
    """AG-12: means over a species' images with at least two annotations; an absent class pair counts 0."""
    im = images.select("image_id", "species_id").where("species_id is not null")
    image_b4 = R.written(image_b4, "b4")
    n = image_b4.select("image_id").distinct().join(im, "image_id").groupBy("species_id").agg(F.count(F.lit(1)).alias("n"))
    cols = ("reldist", "closefrac", "iou", "contain")
    s = image_b4.join(im, "image_id").groupBy("species_id", "a", "b").agg(*[F.sum(c).alias(c) for c in cols])
    return s.join(n, "species_id").select("species_id", "a", "b", *[(F.col(c) / F.col("n")).alias(c) for c in cols])


# -- priors ------------------------------------------------------------------------


def presence_priors(images: DataFrame, annotations: DataFrame, classes: list[int]) -> DataFrame:
    """AG-21: mean presence and area per species and class over all its images."""
    im = images.where("species_id is not null").select("image_id", "species_id")
    per = annotations.join(im, "image_id").groupBy("species_id", "image_id", "class_id").agg(F.sum("area_frac").alias("area")).groupBy("species_id", "class_id").agg(F.count(F.lit(1)).alias("p"), F.sum("area").alias("area"))
    n = im.groupBy("species_id").agg(F.count(F.lit(1)).alias("n"))
    t = filled(n, per, ["species_id"], classes, ["p", "area"])
    return t.select("species_id", "class_id", (F.col("p") / F.col("n")).alias("presence"), (F.col("area") / F.col("n")).alias("area"))


def diagnostic_weights(priors: DataFrame, least: float = 0.10, gain: float = 2.0, cap: float = 3.0) -> DataFrame:
    """AG-22: 1 + gain * min(z, cap) / cap, where z is how far the species' mean area is from the class's; 1 where presence is rare."""
    here = F.col("presence") >= least
    c = priors.where(here).groupBy("class_id").agg(F.avg("area").alias("m"), (F.stddev_pop("area") + 1e-8).alias("s"))
    z = F.abs(F.col("area") - F.coalesce("m", F.lit(0.0))) / F.coalesce("s", F.lit(1.0))
    w = F.when(here, 1 + gain * F.least(z, F.lit(cap)) / cap).otherwise(1.0)
    return priors.join(c, "class_id", "left").select("species_id", "class_id", w.alias("weight"))


def image_overlaps(words: DataFrame) -> DataFrame:
    """AG-23: (image_id, a, b), a < b: the classes of an image whose masks share a grid cell.

    ``words``: image_id, class_id, i, w: the words of masks as bits (64 cells to a word).  The masks of a class are
    joined by OR, map-side first; pairs meet in a word by AND, so an image has at most classes x 256 rows.
    """
    one = words.groupBy("image_id", "i", "class_id").agg(F.bit_or("w").alias("w"))
    c = one.groupBy("image_id", "i").agg(F.array_sort(F.collect_list(F.struct("class_id", "w"))).alias("c")).where("size(c) > 1")  # a row per class
    a = c.select("image_id", F.posexplode("c").alias("k", "x"), "c")
    p = a.select("image_id", F.col("x.class_id").alias("a"), F.explode(F.filter(F.slice("c", F.col("k") + 2, F.size("c")), lambda y: y["w"].bitwiseAND(F.col("x.w")) != 0)).alias("y"))
    return p.select("image_id", "a", F.col("y.class_id").alias("b")).distinct()


def overlap_counts(overlaps: DataFrame, images: DataFrame) -> DataFrame:
    """AG-23: per species the number of images in which two classes share a grid cell.  ``overlaps``: image_id, a, b."""
    return overlaps.join(images.select("image_id", "species_id"), "image_id").groupBy("species_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def allowed_overlap(counts: DataFrame, least: int, classes: list[int]) -> DataFrame:
    """AG-23: class pairs allowed to overlap: counted at least ``least`` times, in both orders, and each class with itself."""
    ok = counts.where(F.col("n") >= least)
    both = ok.select("species_id", "a", "b").unionByName(ok.select("species_id", F.col("b").alias("a"), F.col("a").alias("b")))
    own = every_class(counts.select("species_id").distinct(), classes).select("species_id", F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    return both.unionByName(own)


def seed_vs_learned(seed: DataFrame, learned: DataFrame) -> DataFrame:
    """J-16: per (species, a, b) whether the pair is allowed by the seed, by what was learned, or newly learned."""
    k = ["species_id", "a", "b"]
    t = seed.select(*k, F.lit(True).alias("in_seed")).join(learned.select(*k, F.lit(True).alias("in_learned")), k, "full_outer").na.fill(False, ["in_seed", "in_learned"])
    return t.withColumn("new", F.col("in_learned") & ~F.col("in_seed"))


def percentiles(df: DataFrame, key: str, value: str, q: float, cells: int = 1024, most: int = 1 << 20) -> DataFrame:
    """(key, p): the exact percentile (interpolated) of each key's values, a bounded number of keys.

    Counts per cell of the values' range say where the two order statistics lie; the range is narrowed to
    those cells until they hold at most ``most`` rows, and only these are put in order.  Null values do not count.
    """
    t = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    s = t.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # a row per key
    kind = dict(t.dtypes)[key]
    part = {r[key]: (0, r["n"], r["lo"], r["hi"], r["n"]) for r in s}  # rows below the range, rows in it, the range, all rows
    done = []
    while any(m > most and lo < hi for _, m, lo, hi, _ in part.values()):
        rows = [(k, lo, hi) for k, (_, m, lo, hi, _) in part.items() if m > most and lo < hi]
        r = df.sparkSession.createDataFrame(rows, f"{key} {kind}, lo double, hi double")
        c = F.least(F.lit(cells - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)).cast("int").alias("c")
        hist: dict = {}
        for x in t.join(r, key).where("v between lo and hi").groupBy(key, c).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy(key, "c").collect():  # keys x cells
            hist.setdefault(x[key], []).append(x)
        for k, own in hist.items():
            below, _, _, _, n = part[k]
            first = int(q * (n - 1))
            last = min(first + 1, n - 1)
            some = []
            at = below
            for x in own:
                if at <= last and at + x["m"] > first:
                    some.append((at, x))
                at += x["m"]
            if len(some) == 2:  # the last of one cell and the first of the next
                v = some[0][1]["b"], some[1][1]["a"]
                done.append((k, v[0] + (v[1] - v[0]) * (q * (n - 1) - first)))
                del part[k]
            else:
                part[k] = (some[0][0], some[0][1]["m"], some[0][1]["a"], some[0][1]["b"], n)
    r = df.sparkSession.createDataFrame([(k, *x) for k, x in part.items()], f"{key} {kind}, below long, m long, lo double, hi double, n long")
    rest = t.join(r, key).where("v between lo and hi").groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("m") <= most, F.col("v")))).alias("a"), F.min("v").alias("only"), F.first("below").alias("below"), F.first("n").alias("n"))  # at most ``most`` rows; more are one value
    pos = F.lit(q) * (F.col("n") - 1)
    at = lambda i: F.coalesce(F.get("a", (i - F.col("below")).cast("int")), F.col("only"))
    lo, hi = at(F.floor(pos)), at(F.least(F.floor(pos) + 1, F.col("n") - 1))
    out = rest.select(key, (lo + (hi - lo) * (pos - F.floor(pos))).alias("p"))
    return out.unionByName(df.sparkSession.createDataFrame(done, f"{key} {kind}, p double"))


# -- filters -----------------------------------------------------------------------


def min_images(images: DataFrame, least: int) -> DataFrame:
    """FL-2: images of species with at least ``least`` images."""
    n = images.groupBy("species_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return images.join(n.select("species_id"), "species_id", "left_semi")


def without_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """J-17: images that no annotation names."""
    return images.join(annotations.select("image_id"), "image_id", "left_anti")


def orphans(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """FL-3: annotations whose image is not there."""
    return annotations.join(images.select("image_id"), "image_id", "left_anti")


def empty_guard(images: DataFrame, annotations: DataFrame, most: float = 0.10) -> float:
    """FL-9: the share of images without annotations; raises above ``most``."""
    n = images.count()
    share = without_annotations(images, annotations).count() / n if n else 0.0
    if share > most:
        raise ValueError(f"{share:.1%} of the images have no annotation, more than {most:.1%}")
    return share
