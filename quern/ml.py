"""Learned ranking with spark.ml and its evaluation."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import lexicon as L
from quern.functions.text import half_up
from quern.operators.pairs import FEATURES, GROUPS
from quern.operators.statistics import positions

#: The model's features in the order of its schema.
SCHEMA = [f for g, names in GROUPS.items() if g != "flags" for f in names]
# Beta parameters of how well a pair fits, by what fits, of relevant pairs and of others.
FIT = {
    "skills": ((5, 1.5), (1.5, 4)), "experience": ((4, 2), (2, 4)), "retrieval": ((4.5, 1.5), (1.5, 4)), "education": ((3, 2), (2, 3)), "projects": ((3, 2), (2, 4)),
}
POSITIVE = 0.4
_DRIVEN = {f for weights in L.CATEGORY_WEIGHTS.values() for f in weights}


def synthetic_rows(spark: SparkSession, n: int = 3000, seed: int = 42, block: int = 1000) -> DataFrame:
    """(row, label, the 85 features): labelled rows, 40 per cent positive, any number of them in parallel (M1).

    How well a pair fits is drawn per group from a Beta mixture; the features
    that scores weigh follow it with normal noise, flags are drawn by it, the
    others are free. Blocks of rows have their own seeds, so rows don't depend
    on how they are cut into tasks.
    """

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(frame["block"].iloc[0])])
        rows = np.sort(frame["row"].to_numpy())
        label = (rng.random(len(rows)) < POSITIVE).astype(np.int32)
        out = {"row": rows, "label": label}
        for group, names in GROUPS.items():
            good, bad = FIT.get(group, ((3, 2), (3, 2)))
            fit = np.where(label == 1, rng.beta(*good, len(rows)), rng.beta(*bad, len(rows)))
            for k, name in enumerate(x for x in names if x in SCHEMA):
                flag = name.startswith(("has_", "is_")) or name.endswith("_flag")
                value = (rng.random(len(rows)) < 0.2 + 0.6 * fit) if flag else fit * (1 - 0.03 * (k % 5)) + rng.normal(0, 0.05, len(rows)) if name in _DRIVEN else rng.beta(2, 2, len(rows))
                out[name] = np.clip(np.asarray(value, dtype=float), 0, 1)
        return pd.DataFrame(out)

    ids = spark.range(n).select(F.col("id").alias("row"), F.floor(F.col("id") / block).alias("block"))
    return ids.groupBy("block").applyInPandas(draw, "row long, label int, " + ", ".join(f"{f} double" for f in SCHEMA))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """Adds `part`, train or test: of each label about the given share of keys, by a hash of key and label (M2).

    Every row is decided on its own, so nothing is shuffled; a null key is
    that of an empty text.
    """
    hashed = F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(label).cast("string"))), 1, 8)
    return rows.withColumn("part", F.when(hashed < f"{int(share * 2**32):08x}", "train").otherwise("test"))


def fit_trees(train: DataFrame, label: str, features: list[str], trees: int = 200, depth: int = 6, seed: int = 42):
    """A gradient-boosted classifier over feature columns (M3)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
    ]
    return Pipeline(stages=stages).fit(train)


def importances(spark: SparkSession, model, features: list[str], k: int = 10) -> DataFrame:
    """(rank, feature, importance): the k most important features of a fitted model, ties to the earlier feature (M4)."""
    values = model.stages[-1].featureImportances.toArray()
    best = sorted(range(len(features)), key=lambda i: (-values[i], i))[:k]
    return spark.createDataFrame([(r, features[i], float(values[i])) for r, i in enumerate(best, 1)], "rank int, feature string, importance double")


def save_model(model, features: list[str], folder: str) -> None:
    """Write a fitted model and the schema of its features (M4)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{folder}/model")
    meta = json.dumps({"feature_names": features, "n_features": len(features)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/features")


def load_model(folder: str):
    """(model, names of its features) as written by `save_model`."""
    from pyspark.ml import PipelineModel

    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{folder}/model"), json.loads(spark.read.text(f"{folder}/features").first().value)["feature_names"]


def _positive(probability: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), vector_to_array(probability)[1]))


def learned_score(rows: DataFrame, model) -> DataFrame:
    """Adds overall_score, the model's probability in per cent to one decimal, and the label of the method (C9, C10); nulls count 0."""
    filled = rows.fillna(0.0, [c for c in SCHEMA if c in rows.columns])
    scored = model.transform(filled).withColumn("overall_score", half_up(half_up(100 * _positive(F.col("probability")), 6), 1))
    return scored.withColumn("ranking_method", F.lit("xgboost")).drop("features", "rawPrediction", "probability", "prediction")


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): area under the curve by rank sums, ties sharing their mean rank; null if a class is missing (M4).

    Scores are counted before they are ranked, and ranked in ranges over the tasks.
    """
    groups = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"), F.lit(0).alias("g"))
    ranked = positions(groups, "s", "n", ["g"])
    total = ranked.agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    return total.select(((F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / F.nullif(F.col("np") * F.col("nn"), F.lit(0))).alias("auc"))
