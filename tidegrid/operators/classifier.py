"""Distributed class probabilities from pooled token features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.numeric import argmax
from tidegrid.operators.features import (
    fit_statistics, masked_mean_max_last, masked_mean_pool, standardize, state_columns,
)
from tidegrid.session import stage


def pooled_classifier(bundles: DataFrame, label: str = "label_id", ids: Sequence[str] = ("sample_id",),
                      pooling: str = "mean", max_iter: int = 25, reg: float = 0.01) -> DataFrame:
    """Train on the train split, score every split; a prediction table.

    Normalisation is fitted on train only. The pooled rows are written once to
    the shared folder, since the solver passes over them many times.
    """
    mean, scale = state_columns(fit_statistics(bundles))
    pool = masked_mean_pool if pooling == "mean" else masked_mean_max_last
    pooled = pool(standardize(bundles, mean, scale)).where("pooled is not null")
    rows = stage(pooled.select(*ids, "split", F.col(label).cast("double").alias("label"), "pooled"), "pooled")
    vectors = rows.withColumn("features", array_to_vector("pooled"))
    solver = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, standardization=False)
    model = solver.fit(vectors.where("split = 'train'"))
    scored = model.transform(vectors)
    return scored.select(
        *ids, "split", F.col("label").cast("int").alias("label_id"),
        vector_to_array("probability").alias("probabilities"),
    ).withColumn("prediction", argmax(F.col("probabilities")))
