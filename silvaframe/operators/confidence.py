"""Top-k predictions: ranks, hit rates, spread, expected distance, severity (WN-2, WN-5, AG-25, AG-26, AG-28, DV-11, DV-13, J-12..J-15).

Predictions are long: (image_id, rank, species, prob).  Matrices are (a, b, d), a < b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .distance import symmetric


def topk(scores: DataFrame, k: int) -> DataFrame:
    """WN-2: the k most probable classes of each image; ties by class.  ``scores``: image_id, species, prob."""
    w = W.partitionBy("image_id").orderBy(F.desc("prob"), "species")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("image_id", "rank", "species", "prob")


def true_ranks(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """WN-5, J-5: rank and probability of the true class among the predictions, null where it is not among them.

    ``truth``: image_id, true_species; images without a label do not come out, those
    without predictions have nulls.
    """
    hit = pred.join(truth, "image_id").where(F.col("species") == F.col("true_species")).groupBy("image_id").agg(F.min("rank").alias("rank_true"), F.max("prob").alias("prob_true"))
    return truth.join(hit, "image_id", "left")


def hit_rates(ranks: DataFrame, catalogue: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """AG-25: share of labelled images with the truth in the first k, over all and over those in the catalogue."""
    t = ranks.join(catalogue.select(F.col("species").alias("_c")).distinct(), F.col("true_species") == F.col("_c"), "left")
    inside = F.col("_c").isNotNull()
    hit = lambda k: F.when(F.col("rank_true") <= k, 1.0).otherwise(0.0)
    return t.agg(F.count(F.lit(1)).alias("labelled"), F.count_if(~inside).alias("out_of_catalogue"), F.avg("prob_true").alias("mean_prob_true"), *[F.avg(hit(k)).alias(f"hit_{k}") for k in ks], *[F.avg(F.when(inside, hit(k))).alias(f"hit_{k}_catalogue") for k in ks])


def spread(pred: DataFrame, m: DataFrame, baseline: tuple[float, float] | None = None) -> DataFrame:
    """DV-11, J-12: mean distance between an image's candidates, weighted by p_i p_j; null below two known ones.

    ``baseline`` (mean, deviation of random candidates) adds z and coherence.
    """
    t = pred.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "species", "prob"))).alias("p"))  # k entries
    t = t.select("image_id", "p", F.posexplode("p").alias("i", "x"))
    t = t.select("image_id", "x", F.explode_outer(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    t = t.join(symmetric(m), (F.col("x.species") == F.col("a")) & (F.col("y.species") == F.col("b")), "left")
    w = F.when(F.col("d").isNotNull(), F.col("x.prob") * F.col("y.prob"))
    out = t.groupBy("image_id").agg(F.try_divide(F.sum(w * F.col("d")), F.sum(w)).alias("spread"))
    if baseline:
        mean, sd = baseline
        out = out.withColumns({"z": (F.lit(mean) - F.col("spread")) / F.lit(sd), "coherence": 1 - F.try_divide(F.col("spread"), F.lit(mean))})
    return out


def expected_distance(pred: DataFrame, truth: DataFrame, m: DataFrame) -> DataFrame:
    """DV-13, J-13: mean distance of the candidates to the truth, over the probability that has a distance; calibrated against the truth's row.

    ``calibrated`` is (mean of the row - expected) / population deviation of the row.
    """
    sym = symmetric(m)
    row = sym.groupBy(F.col("a").alias("_l")).agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"))
    t = pred.join(truth, "image_id").join(row, F.col("true_species") == F.col("_l")).join(sym, (F.col("true_species") == F.col("a")) & (F.col("species") == F.col("b")), "left")
    d = F.when(F.col("species") == F.col("true_species"), 0.0).otherwise(F.col("d"))
    t = t.withColumn("_d", d).where("_d is not null")
    e = t.groupBy("image_id", "true_species").agg(F.try_divide(F.sum(F.col("prob") * F.col("_d")), F.sum("prob")).alias("expected"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    return e.select("image_id", "true_species", "expected", F.try_divide(F.col("mean") - F.col("expected"), F.nullif("sd", F.lit(0.0))).alias("calibrated"))


def severity(first: DataFrame, m: DataFrame) -> DataFrame:
    """J-14: 0 for a right prediction, else the distance over the matrix's maximum; null for unknown labels.

    ``first``: image_id, true_species, predicted_species.
    """
    top = m.agg(F.max("d").alias("top"))
    s = symmetric(m)
    t = first.join(s, (F.col("true_species") == F.col("a")) & (F.col("predicted_species") == F.col("b")), "left").join(F.broadcast(top))  # one row
    right = F.col("true_species") == F.col("predicted_species")
    return t.select("image_id", "true_species", "predicted_species", right.cast("int").alias("correct"), F.when(right, 0.0).otherwise(F.try_divide("d", "top")).alias("severity"))


def severity_summary(sev: DataFrame) -> DataFrame:
    """AG-26: accuracy, mean severity without nulls, and how many labels were unknown."""
    return sev.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("severity").alias("mean_severity"), F.count_if(F.col("severity").isNull()).alias("unknown"))


def worst(sev: DataFrame, k: int = 20) -> DataFrame:
    """ST-3: the k gravest errors."""
    return sev.where("severity is not null").orderBy(F.desc("severity"), "image_id").limit(k)


def agreement(p1: DataFrame, p2: DataFrame) -> DataFrame:
    """J-15: whether two models' first choices agree, per image."""
    a = p1.where("rank = 1").select("image_id", F.col("species").alias("first_1"))
    b = p2.where("rank = 1").select("image_id", F.col("species").alias("first_2"))
    return a.join(b, "image_id").withColumn("agree", (F.col("first_1") == F.col("first_2")).cast("int"))


def image_confidence(images: DataFrame, instances: DataFrame) -> DataFrame:
    """AG-28: mean score and number of an image's instances; 0 where there are none."""
    t = instances.groupBy("image_id").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return images.select("image_id").distinct().join(t, "image_id", "left").na.fill(0, ["mean_score", "n"])
