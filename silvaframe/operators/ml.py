"""The tabular classifier on Spark ML (ML-1 .. ML-8).

There is no kernel machine in Spark ML.  ``rff_classifier`` is not one: it is
multinomial logistic regression on random Fourier features, which approximates an
RBF kernel and trains distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .confidence import topk
from .evaluation import class_metrics, confusion, global_metrics
from .splits import folds


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows / (labels * rows of the label)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    s = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(n, label).join(F.broadcast(s)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def random_forest(columns: list[str], label: str, trees: int = 500, depth: int = 30, leaf: int = 2, seed: int = 42) -> Pipeline:
    """ML-1, ML-3: median imputation and a balanced forest; needs the column ``weight``."""
    filled = [f"{c}_f" for c in columns]
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_x"),
        RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed),
    ])


def linear_model(columns: list[str], label: str, scale: bool = True) -> Pipeline:
    """ML-1, ML-2: imputation, scaling and multinomial logistic regression; needs the column ``weight``."""
    filled = [f"{c}_f" for c in columns]
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"), Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v")]
    stages.append(StandardScaler(inputCol="_v", outputCol="_x", withMean=True)) if scale else stages[-1].setOutputCol("_x")
    return Pipeline(stages=[*stages, LogisticRegression(labelCol="_y", featuresCol="_x", weightCol="weight", regParam=1e-3, maxIter=60)])


def fourier_features(df: DataFrame, columns: list[str], n: int = 128, gamma: float | None = None, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """ML-4: random Fourier features of an RBF kernel over standardised columns; the new columns' names.

    Missing values count as the mean.  The random directions come from ``seed`` alone.
    """
    stat = df.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stat[f"{c}_m"] or 0.0 for c in columns])
    sd = np.array([stat[f"{c}_s"] or 1.0 for c in columns])
    sd[sd == 0] = 1.0
    rng = np.random.default_rng(seed)
    g = gamma or 1.0 / len(columns)
    w, b = rng.normal(0, np.sqrt(2 * g), (len(columns), n)), rng.uniform(0, 2 * np.pi, n)
    names = [f"rff_{i}" for i in range(n)]
    others = [c for c in df.columns if c not in columns]
    schema = ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in others), *(f"{c} double" for c in names)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = (f[columns].to_numpy(float) - mean) / sd
            z = np.sqrt(2 / n) * np.cos(np.nan_to_num(x) @ w + b)
            yield pd.concat([f[others].reset_index(drop=True), pd.DataFrame(z, columns=names)], axis=1)

    return df.mapInPandas(run, schema), names


def probabilities(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """ML-8: (image_id, species, prob) of every class, long."""
    labels = model.stages[0].labels
    known = F.slice(vector_to_array("probability"), 1, len(labels))  # without the place for unseen labels
    t = model.transform(df).select(F.col(key).alias("image_id"), known.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    t = t.select("image_id", F.posexplode(F.transform("p", lambda x: x / total)).alias("i", "prob"))
    return t.select("image_id", F.get(F.array(*[F.lit(x) for x in labels]), F.col("i")).alias("species"), "prob")


def cross_predict(df: DataFrame, make, label: str, key: str, k: int = 5) -> DataFrame:
    """ML-5, SP-6: out-of-fold first choices: (image_id, fold, gt_label, pred_label)."""
    t = folds(df, label, key, k)
    t = balanced(t, label)
    out = None
    for i in range(k):
        model = make().fit(t.where(F.col("fold") != i))
        p = topk(probabilities(model, t.where(F.col("fold") == i), key), 1)
        p = p.join(t.select(F.col(key).alias("image_id"), "fold", F.col(label).cast("string").alias("gt_label")), "image_id").select("image_id", "fold", "gt_label", F.col("species").alias("pred_label"))
        out = p if out is None else out.unionByName(p)
    return out


def cross_validate(pred: DataFrame) -> DataFrame:
    """ML-5: accuracy and macro-F1 per fold."""
    m = global_metrics(class_metrics(confusion(pred, ["fold"]), ["fold"]), ["fold"])
    acc = pred.groupBy("fold").agg(F.avg((F.col("gt_label") == F.col("pred_label")).cast("double")).alias("accuracy"))
    return m.join(acc, "fold").select("fold", "accuracy", "macro_f1")


def best_model(scores: dict[str, float]) -> str:
    """ML-6: the name with the greatest score, the first of equals by name."""
    return max(sorted(scores), key=lambda n: scores[n])


def introspect(model: PipelineModel) -> tuple[list[str], list[str]]:
    """ML-7: the feature columns and the classes of a fitted pipeline."""
    cols = next(s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler))
    return cols, list(model.stages[0].labels)
