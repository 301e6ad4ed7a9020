"""Token type models: features to emissions. The model is gradient boosting over the matrix of matrix.py (boosting.py); a
multinomial logistic regression and any function of a feature matrix can take its place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dual import frame_operator
from . import boosting
from .matrix import PAIR, WINDOW
from .shipped import read_bytes, shipped

CLASSES = 11


def train(features: DataFrame, max_iter: int = 20):
    """features (features array<float>, label int) -> a Spark ML model with a probability for each of the 11 types."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = features.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=0.01).fit(data)


def score(features: DataFrame, model) -> DataFrame:
    """Adds p array<double>: emissions of the 11 types; a type that training never saw has 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(features.withColumn("_vector", array_to_vector(F.col("features").cast("array<double>"))), {model.featuresCol: "_vector", model.probabilityCol: "_p", model.rawPredictionCol: "_raw", model.predictionCol: "_prediction"})
    p = vector_to_array("_p")
    return out.withColumn("p", F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(CLASSES) - F.size(p))))).drop("_vector", "_p", "_raw", "_prediction")


def score_with(features: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], key: tuple[str, ...] = ("doc_id", "page_number", "pos")) -> DataFrame:
    """Emissions by a function of a float32 matrix, batch by batch; it goes to the workers once a task."""
    return _scored(features, lambda: scorer, key)


def score_file(features: DataFrame, path: str, make: Callable[[bytes], Callable[[np.ndarray], np.ndarray]], key: tuple[str, ...] = ("doc_id", "page_number", "pos")) -> DataFrame:
    """Emissions by a model in a file: make(its bytes) is a function as for score_with. A worker makes it once for each version of
    the file, however many tasks and queries use it."""
    return _scored(features, shipped(features.sparkSession, read_bytes(features.sparkSession, path), make), key)


def _scored(features: DataFrame, get: Callable, key: tuple[str, ...]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in features.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x[list(key)].assign(p=[r.tolist() for r in np.asarray(get()(np.stack(x["features"].to_list()).astype(np.float32)), float)])

    return features.select(*key, "features").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", p array<double>")


def save(model, trans: DataFrame, path: str) -> None:
    """Model and transition table below one folder of any store."""
    model.write().overwrite().save(f"{path}/model")
    trans.write.mode("overwrite").parquet(f"{path}/transitions")


def load(spark, path: str):
    from pyspark.ml.classification import LogisticRegressionModel

    return LogisticRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/transitions")


def save_boosted(model: boosting.Model, trans: DataFrame, path: str) -> None:
    """A boosted model, a row of bytes, and the transition table below one folder of any store."""
    spark = trans.sparkSession
    spark.createDataFrame([(bytearray(model.to_bytes()),)], "model binary").write.mode("overwrite").parquet(f"{path}/boosted")
    trans.write.mode("overwrite").parquet(f"{path}/transitions")


def load_boosted(spark, path: str) -> tuple[boosting.Model, DataFrame]:
    return boosting.Model.of_bytes(bytes(spark.read.parquet(f"{path}/boosted").first()["model"])), spark.read.parquet(f"{path}/transitions")


#: Settings of the registered query; a model of use has those of boosting.Settings.
FEW = boosting.Settings(rounds=2, leaves=8, bins=31, feature_fraction=0.25, bagging_freq=1)


def train_boosted(matrix: DataFrame, tok: DataFrame, settings: boosting.Settings = boosting.Settings()) -> boosting.Model:
    """matrix (key, places, values) and tok (key, token_type) -> a boosted model of token types."""
    key = ["doc_id", "page_number", "pos"]
    return boosting.train(matrix.join(tok.select(*key, F.col("token_type").alias("label")), key), PAIR * WINDOW, settings)


@frame_operator("labelled")
def model_emissions(labelled: DataFrame) -> DataFrame:
    """Emissions of a model that is trained on the documents' own types from the matrix of features."""
    out = boosting.fitted(labelled.withColumnRenamed("token_type", "label"), PAIR * WINDOW, FEW)
    return out.select("doc_id", "page_number", "pos", F.array_join(F.transform("p", lambda v: F.round(v, 4).cast("string")), ",").alias("p"))
