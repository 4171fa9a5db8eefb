"""Train, validation and test splits (SP-1..SP-6, WN-6, SO-1..SO-5, AG-29).

Stratification is systematic sampling instead of a greedy loop over all images:
images are ordered by their set of classes, by hash within the set, and every
1/share-th goes to the split.  Each set of classes, and so each class, gets its share up
to rounding, in one ranking; the driver sees counts per set.  Only rare classes
are seeded greedily: fewer than ``rare`` images each, so that list is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import runtime as R


def presence_mask(df: DataFrame, classes: list[str]) -> DataFrame:
    """SP-1: adds ``mask``; bit i is set where class i is present, by the first value among the presence_, count_ and feat_ columns there are."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(classes):
        cols = [F.col(f"{p}{c}").cast("double") for p in ("presence_", "count_", "") if f"{p}{c}" in df.columns]
        if cols:
            out = out + F.when(F.coalesce(*cols) != 0, F.lit(1 << i)).otherwise(F.lit(0))
    return df.withColumn("mask", out)


def class_totals(images: DataFrame, n: int) -> list[int]:
    """Images per class."""
    r = images.agg(*[F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).alias(str(i)) for i in range(n)]).first()
    return [int(x or 0) for x in r]


def quotas(totals: list[int], static: int = 3, fraction: float = 0.15, rare: int = 15) -> list[int]:
    """FN-38: how many images of each rare class a split is seeded with."""
    out = []
    for t in totals:
        q = min(static, max(1, -(-int(t * fraction * 1000) // 1000))) if 0 < t < rare else 0
        out.append(max(0, min(q, t - 1)))
    return out


def seed(images: DataFrame, key: str, totals: list[int], quota: list[int], salt: int) -> list:
    """SP-2: keys of the images a split is seeded with, rarest class first.

    Candidates are the images of classes with a quota: fewer than ``rare`` per class.
    """
    want = sum(1 << i for i, q in enumerate(quota) if q)
    if not want:
        return []
    rows = images.where(F.col("mask").bitwiseAND(F.lit(want)) != 0).select(key, "mask", F.xxhash64(F.lit(salt), key).alias("h")).collect()
    taken: dict = {}
    for c in sorted((i for i, q in enumerate(quota) if q), key=lambda i: (totals[i], i)):
        open_ = [max(0, q - sum(m >> i & 1 for m in taken.values())) for i, q in enumerate(quota)]
        need = open_[c]
        if need > 0:
            pool = [r for r in rows if r["mask"] >> c & 1 and r[key] not in taken]
            pool.sort(key=lambda r: (-sum(1 for i, o in enumerate(open_) if o and r["mask"] >> i & 1), bin(r["mask"]).count("1"), r["h"]))
            taken |= {r[key]: r["mask"] for r in pool[:need]}
    return list(taken)


def systematic(images: DataFrame, key: str, want: int, salt: int) -> DataFrame:
    """SP-4: ``want`` images, spread evenly over the order (mask, hash)."""
    t = images.select(key, "mask").withColumn("o", F.struct(F.xxhash64(F.lit(salt), key).alias("h"), F.col(key)))
    t = R.ranked(t, ["mask"], "o", uniform="o.h")
    n = images.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("mask").rowsBetween(W.unboundedPreceding, -1)  # one row per set of classes
    n = n.select(F.col("mask").alias("_m"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_b"), F.sum("n").over(W.partitionBy()).alias("_all"))
    t = t.join(n, F.col("mask") == F.col("_m"))
    i = F.col("_b") + F.col("rank")
    share = F.lit(float(want)) / F.col("_all")
    return t.where(F.floor((i + 1) * share + 1e-9) > F.floor(i * share + 1e-9)).select(key)


def assign(images: DataFrame, key: str, n_classes: int, test: float = 0.15, val: float = 0.15, salt: int = 42) -> DataFrame:
    """SP-5: (key, split): shares of all images for test and val, the rest is train.

    ``images``: key, mask, one row each.  Raises if a split would be empty (SNK-13).
    """
    spark = images.sparkSession
    pool = R.written(images.select(key, "mask"), "pool")
    n = pool.count()
    totals = class_totals(pool, n_classes)
    kind = dict(images.dtypes)[key]
    out = None
    for i, (name, share) in enumerate((("test", test), ("val", val))):
        seeded = seed(pool, key, totals, quotas(totals), salt + i)
        s = spark.createDataFrame([(k,) for k in seeded], f"{key} {kind}")
        rest = pool.join(s, key, "left_anti")
        part = s.union(systematic(rest, key, max(0, round(n * share) - len(seeded)), salt + i))
        part = R.written(part.withColumn("split", F.lit(name)), name)
        if part.isEmpty():
            raise ValueError(f"no image is left for {name}")
        out = part if out is None else out.unionByName(part)
        pool = pool.join(part.select(key), key, "left_anti")
    if pool.isEmpty():
        raise ValueError("no image is left for train")
    return out.unionByName(pool.select(key, F.lit("train").alias("split")))


def check_partition(splits: list[DataFrame], whole: DataFrame, key: str) -> None:
    """SO-4: the splits are disjoint and complete; raises else."""
    n = sum(s.select(key).distinct().count() for s in splits)
    union = splits[0].select(key)
    for s in splits[1:]:
        union = union.union(s.select(key))
    if union.distinct().count() != n:
        raise ValueError("splits share rows")
    if whole.select(key).distinct().join(union, key, "left_anti").count():
        raise ValueError("splits leave rows out")


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """WN-6: one row per key, the first in the given order."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def folds(df: DataFrame, label: str, key: str, k: int = 5, salt: int = 42) -> DataFrame:
    """SP-6: stratified folds 0 .. k-1: rank by hash within the label, modulo k."""
    t = df.withColumn("_o", F.struct(F.xxhash64(F.lit(salt), key).alias("h"), F.col(key)))
    return R.ranked(t, [label], "_o", "_rank", uniform="_o.h").withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_o", "_rank")


def align(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """SO-5: the given columns in their order, missing ones as 0; also what was missing and what was left over."""
    have = set(df.columns)
    out = df.select(*keep, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in columns])
    return out, [c for c in columns if c not in have], [c for c in df.columns if c not in columns and c not in keep]


def coverage(df: DataFrame, classes: list[str]) -> DataFrame:
    """AG-29: images per split and class that have it.  ``df``: split, mask."""
    bits = F.explode(F.array(*[F.struct(F.lit(c).alias("class_name"), (F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1).alias("on")) for i, c in enumerate(classes)])).alias("b")
    return df.select("split", bits).groupBy("split", "b.class_name").agg(F.count_if("b.on").alias("images"))


def assert_coverage(cover: DataFrame, least: int = 1) -> None:
    """FL-13: raises if a class has fewer than ``least`` images in a split.  ``cover``: split, class_name, images."""
    bad = cover.where(F.col("images") < least).orderBy("split", "class_name").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['split']} has {r['images']} images of {r['class_name']}" for r in bad))


def required_columns(df: DataFrame, names: list[str]) -> None:
    """SO-6: raises if columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def sequential_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """WN-7: 1-based ids in a total order, without one task for all rows.

    Rows are range-partitioned by the order and written, so that the ranges stand; each partition's offset
    is the number of rows before it (a count per partition).
    """
    t = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = R.written(t.withColumn("_p", F.spark_partition_id()), "ranges")
    n = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    n = n.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return t.withColumn("_r", own).join(n, "_p").withColumn(name, F.col("_b") + F.col("_r") + (start - 1)).select(*df.columns, name)


def most_imaged(images: DataFrame, k: int = 12) -> DataFrame:
    """ST-6: the k species with the most images, a top-k report."""
    n = images.where("species_id is not null").groupBy("species_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "species_id").limit(k)
