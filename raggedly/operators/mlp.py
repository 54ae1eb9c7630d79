"""Batch scoring with a small network, and a distributed baseline."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WEIGHT_BYTES = 256 << 20


def mlp_score(
    vectors: DataFrame,
    layers: Sequence[tuple[np.ndarray, np.ndarray]],
    column: str = "x",
    max_bytes: int = MAX_WEIGHT_BYTES,
) -> DataFrame:
    """Logits of a feed-forward network with ReLU between its layers.

    ``layers`` holds (weight[out, in], bias[out]). Whole Arrow batches go through
    NumPy; the weights are broadcast once per executor, after a check of their size
    against ``max_bytes``.
    """
    size = sum(w.nbytes + b.nbytes for w, b in layers)
    if size > max_bytes:
        raise ValueError(f"weights take {size} bytes, more than {max_bytes}")
    shared = vectors.sparkSession.sparkContext.broadcast(
        [(np.ascontiguousarray(w.T), b) for w, b in layers]
    )

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            h = np.stack(batch.to_numpy()).astype(np.float64)
            for i, (w, b) in enumerate(net):
                h = h @ w + b
                if i < len(net) - 1:
                    np.maximum(h, 0.0, out=h)
            yield pd.Series(list(h))

    return vectors.withColumn("logits", forward(F.col(column)))


def mlp_baseline(
    train: DataFrame,
    width: int,
    hidden: int,
    n_classes: int,
    max_iter: int = 50,
    seed: int = 42,
):
    """Train a network of the same shape with Spark's own distributed optimizer."""
    rows = train.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(
        layers=[width, hidden, hidden // 2, n_classes], maxIter=max_iter, seed=seed
    ).fit(rows)


def baseline_predictions(model, vectors: DataFrame) -> DataFrame:
    scored = model.transform(vectors.withColumn("features", array_to_vector("x")))
    return scored.select(
        F.col("y").alias("label"), vector_to_array("rawPrediction").alias("logits")
    )
