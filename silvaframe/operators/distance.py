"""Vectors, distance matrices and what follows from them (DV-1..6, AG-19/20, AG-31/32, WN-1/4, ST-1/2/4).

A matrix is long: (a, b, d).  Matrices are between *labels* (species); their pairs come
from an equi-join on pairs of blocks of labels.  Between images
nothing is paired where algebra allows: with unit vectors u the mean cosine distance
of two groups is 1 - mean(u_a) . mean(u_b), and means and deviations within a
group follow from its sum vector and its Gram matrix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import vectors as V


def vectors(long: DataFrame, key: str, dim: list[str], value: str, dims: DataFrame | None = None) -> DataFrame:
    """(key, v): the values in the order of their dimensions.  ``dims``: all dimensions, for values left out (0)."""
    if dims is not None:
        every = long.select(key).distinct().join(F.broadcast(dims))  # labels x dimensions
        long = every.join(long, [key, *dim], "left").na.fill(0.0, [value])
    t = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*dim, value))).alias("s"))
    return t.select(key, F.col(f"s.{value}").alias("v"))


def z_scored(long: DataFrame, dim: list[str], value: str) -> DataFrame:
    """FN-36: each dimension minus its mean, over its population deviation (0 counts as 1)."""
    s = long.groupBy(*dim).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    t = long.join(s, dim)
    return t.withColumn(value, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def label_pairs(t: DataFrame, key: str) -> DataFrame:
    """(l, r): all pairs of rows with l.key < r.key, as structs, by an equi-join on pairs of blocks.

    Keys are dealt to blocks by hash; each row goes once to each block of the other side, so no task sees
    more than a block of each and nothing is broadcast or crossed.
    """
    n = max(2, int(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    own, every = F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.struct(*t.columns)
    left, right = t.select(row.alias("l"), own.alias("ka"), every.alias("kb")), t.select(row.alias("r"), own.alias("kb"), every.alias("ka"))
    return left.join(right, ["ka", "kb"]).where(F.col(f"l.{key}") < F.col(f"r.{key}")).select("l", "r")


def matrix(sig: DataFrame, key: str, metric: Callable[[Column, Column], Column]) -> DataFrame:
    """DV-1..3, DV-6: (a, b, d) of all a < b.  ``sig``: key, v, a bounded number of labels."""
    p = label_pairs(sig.select(key, "v"), key)
    return p.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), metric(F.col("l.v"), F.col("r.v")).alias("d"))


def combined(blocks: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """DV-4: weighted mean of the blocks' cosine distances, with each block's own (d_name)."""
    own, total = None, sum(w for _, w in blocks.values())
    for name, (sig, _) in blocks.items():
        # unit vectors once per label, so that a pair costs one dot product
        u = sig.select(key, unit(F.col("v")).alias(name))
        own = u if own is None else own.join(u, key)
    p = label_pairs(own, key)  # all blocks in one pass over the pairs
    out = p.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), *[unit_distance(F.col(f"l.{n}"), F.col(f"r.{n}")).alias(f"d_{n}") for n in blocks])
    d = sum((F.col(f"d_{n}") * F.lit(w / total) for n, (_, w) in blocks.items()), F.lit(0.0))
    return out.withColumn("d", d)


def symmetric(m: DataFrame) -> DataFrame:
    """Both orders of every pair, from one pass over the matrix."""
    both = F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    return m.select(F.inline(both))


def unit(v: Column) -> Column:
    n = V.norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def unit_distance(a: Column, b: Column) -> Column:
    """DV-1 of unit (or zero) vectors."""
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), V.dot(a, b)))


def group_sums(points: DataFrame, group: str) -> DataFrame:
    """Per group: n, non-zero vectors, and the sum of unit vectors.  ``points``: group, v."""
    t = points.select(group, unit(F.col("v")).alias("u"))
    per = t.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"))
    s = per.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s")).select(group, F.col("s.s").alias("sum"))
    n = t.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(V.norm(F.col("u")) > 0).alias("n_pos"))
    return n.join(s, group)


def inter(points: DataFrame, group: str) -> DataFrame:
    """AG-19: mean cosine distance between the images of two groups, a < b, without pairing images."""
    g = group_sums(points, group)
    p = label_pairs(g, group)
    return p.select(F.col(f"l.{group}").alias("a"), F.col(f"r.{group}").alias("b"), (1 - V.dot(F.col("l.sum"), F.col("r.sum")) / (F.col("l.n") * F.col("r.n"))).alias("inter"))


def intra(points: DataFrame, group: str) -> DataFrame:
    """AG-19, AG-20: images and mean cosine distance within a group over i < j; 0 below two images."""
    g = group_sums(points, group)
    mean = 1 - F.try_divide(V.dot(F.col("sum"), F.col("sum")) - F.col("n_pos"), F.col("n") * (F.col("n") - 1))
    return g.select(group, "n", F.when(F.col("n") > 1, mean).otherwise(0.0).alias("intra_mean"))


def intra_spread(points: DataFrame, group: str, key: str) -> DataFrame:
    """AG-19: population deviation and maximum of the distances within a group; these need the group's pairs."""
    side = lambda x: points.select(*[F.col(c).alias(f"_{x}{n}") for c, n in ((group, "g"), (key, "k"), ("v", "v"))])
    p = side("a").join(side("b"), (F.col("_ag") == F.col("_bg")) & (F.col("_ak") < F.col("_bk")))
    s = p.groupBy("_ag").agg(F.stddev_pop(V.cosine_distance(F.col("_av"), F.col("_bv"))).alias("_s"), F.max(V.cosine_distance(F.col("_av"), F.col("_bv"))).alias("_m"))
    t = points.select(group).distinct().join(s, F.col(group) == F.col("_ag"), "left")
    return t.select(group, F.coalesce("_s", F.lit(0.0)).alias("intra_std"), F.coalesce("_m", F.lit(0.0)).alias("intra_max"))


def separability(inter_m: DataFrame, intra_m: DataFrame, group: str) -> DataFrame:
    """ST-1, DV-14: contrast = inter - max(intra of both); small is hard to tell apart."""
    side = lambda k: intra_m.select(F.col(group).alias(k), F.col("intra_mean").alias(f"intra_{k}"))
    t = inter_m.join(side("a"), "a").join(side("b"), "b")
    return t.withColumn("contrast", F.col("inter") - F.greatest("intra_a", "intra_b"))


def nearest(m: DataFrame, k: int) -> DataFrame:
    """WN-1: the k nearest others of each label; ties by name."""
    w = W.partitionBy("a").orderBy("d", "b")
    return symmetric(m).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def common(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """J-11: (a, b, d1, d2) of the pairs in both matrices."""
    return m1.select("a", "b", F.col("d").alias("d1")).join(m2.select("a", "b", F.col("d").alias("d2")), ["a", "b"])


def changed_pairs(m1: DataFrame, m2: DataFrame, k: int) -> DataFrame:
    """ST-2: the k pairs whose distance changed most."""
    t = common(m1, m2).withColumn("delta", F.col("d2") - F.col("d1"))
    return t.orderBy(F.abs("delta").desc(), "a", "b").limit(k)


def rank_flips(m1: DataFrame, m2: DataFrame, k: int) -> DataFrame:
    """WN-4: the k largest changes of a neighbour's rank (0 is the label itself)."""
    both = common(symmetric(m1), symmetric(m2))
    t = both.withColumns({f"rank_{i}": F.row_number().over(W.partitionBy("a").orderBy(f"d{i}", "b")) for i in (1, 2)})
    t = t.withColumn("rank_delta", F.col("rank_2") - F.col("rank_1"))
    return t.orderBy(F.abs("rank_delta").desc(), "a", "b").limit(k).select("a", "b", "rank_1", "rank_2", "rank_delta")


def movement(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """AG-32: mean, mean absolute and greatest absolute change of a label's distances."""
    t = common(symmetric(m1), symmetric(m2)).withColumn("delta", F.col("d2") - F.col("d1"))
    return t.groupBy("a").agg(F.avg("delta").alias("mean_delta"), F.avg(F.abs("delta")).alias("abs_mean_delta"), F.max(F.abs("delta")).alias("max_abs_delta"))


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from 1, ties at their mean, without one task for all rows of equal value or all rows at all.

    Values are counted first; the distinct ones are put in order by ranges, each in a task of its own, and a
    range begins behind the rows of those before it (one count per range).
    """
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    n = R.written(n.repartitionByRange(col).withColumn("_p", F.spark_partition_id()), "ranges")
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    at = n.groupBy("_p").agg(F.sum("_c").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    w = W.partitionBy("_p").orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    r = n.withColumn("_o", F.coalesce(F.sum("_c").over(w), F.lit(0))).join(at, "_p")
    r = r.select(F.col(col).alias("_v"), (F.col("_b") + F.col("_o") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(r, F.col(col) == F.col("_v")).drop("_v")


def correlation(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """AG-31: Pearson and Spearman correlation of two matrices over their common pairs."""
    t = average_rank(average_rank(common(m1, m2), "d1", "r1"), "d2", "r2")
    return t.agg(F.corr("d1", "d2").alias("pearson"), F.corr("r1", "r2").alias("spearman"), F.count(F.lit(1)).alias("n_pairs"))
