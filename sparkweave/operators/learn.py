"""Pair classifiers of Spark ML: presets, folds, out-of-fold scores, calibration. Rows need s1, cand, label, features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.evaluate import folds
from sparkweave.sources.store import apart, dropped, joined, materialized

#: Boosted trees by name: rounds, learning rate, depth, least rows of a leaf, share of rows (fixed values; Spark has no leaf limit).
BOOSTED = {
    "boosted": (200, 0.07, 7, 20, 0.85),
    "boosted_slow": (400, 0.03, 9, 50, 0.85),
    "histogram": (200, 0.07, 7, 20, 1.0),
    "histogram_older": (200, 0.08, 6, 20, 1.0),
    "ordered": (450, 0.05, 7, 1, 1.0),
    "extreme": (400, 0.03, 8, 1, 0.8),
    "boosted_deep": (600, 0.025, 11, 20, 0.85),
}


def classifier(kind: str, rounds: int | None = None, seed: int = 42):
    if kind == "forest":
        return RandomForestClassifier(numTrees=rounds or 100, maxDepth=12, seed=seed)
    if kind == "logistic":
        return LogisticRegression(maxIter=rounds or 1000)
    n, rate, depth, least, share = BOOSTED[kind]
    return GBTClassifier(maxIter=rounds or n, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=share, seed=seed)


def fit(rows: DataFrame, features: list[str], kind: str = "boosted", rounds: int | None = None) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), classifier(kind, rounds)]).fit(rows)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows)
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, features: list[str], kind: str = "boosted", n: int = 5, rounds: int | None = None, keep: bool = True) -> DataFrame:
    """rows with fold and p, each scored by a model of the other folds; all pairs of a record share a fold.

    Parts of a table that is written already get their folds one after the other; without keep each is deleted then."""
    keep, rows = (keep, rows) if hasattr(rows, "written_at") else (False, materialized(rows, "pairs"))
    places, done = materialized(folds(rows, n), "places"), []
    for part in apart(rows):
        done.append(materialized(part.join(places, "s1"), "folds"))
        if not keep:
            dropped(part)
    dropped(places)
    rows = joined(done)
    if kind == "logistic":
        return rows.withColumn("p", logistic(rows, features, n, rounds or 1000))
    parts = [score(fit(rows.where(F.col("fold") != k), features, kind, rounds), rows.where(F.col("fold") == k)) for k in range(n)]
    return reduce(DataFrame.unionByName, parts)


def logistic(rows: DataFrame, features: list[str], n: int, rounds: int) -> Column:
    """The probability by the logistic regression of the folds other than the row's own, at its optimum.

    Newton's method for all folds at once: a pass over the rows, of which equal ones count by their number, gives each fold's
    loss, slope and curvature. Features are centred and scaled for each fold and pass by the rows that still count in the
    curvature, so that a feature which varies little among these keeps its digits. Where classes can be told apart there is
    no finite optimum; it ends where nothing is left to gain."""
    counted = rows.groupBy(F.col("fold").cast("double").alias("fold"), "label", *features).agg(F.count("*").cast("double").alias("weight"))
    m = len(features) + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).tobytes()])], ["x"])

    blocks = materialized(counted.select("fold", "label", "weight", *(F.col(f).cast("double") for f in features)).mapInArrow(packed, "x binary"), "blocks")

    def sums(at: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n, 2 + m + m * m))
            for block in (x for b in batches for x in b.column("x")):
                fold, y, w, *x = np.frombuffer(block.as_py()).reshape(m + 2, -1)
                for k in range(n):
                    own, own_x = w * (fold != k), np.stack([np.ones(len(w)), *((v - c) / d for v, c, d in zip(x, mean[k], scale[k]))])
                    z = at[k] @ own_x
                    low = np.exp(-np.abs(z))
                    p = np.where(z < 0, low, 1.0) / (1 + low)
                    loss = own @ (np.maximum(z, 0) + np.log1p(low) - y * z)
                    out[k] += np.concatenate([[loss, own.sum()], own_x @ (own * (y - p)), ((own_x * (own * p * (1 - p))) @ own_x.T).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel()])], ["s"])

        return sum((np.array(r[0]) for r in blocks.mapInArrow(run, "s array<double>").collect()), np.zeros(n * (2 + m + m * m))).reshape(n, -1)

    at, step, mean, scale = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m - 1)), np.ones((n, m - 1))
    last, done = np.full(n, np.inf), np.zeros(n, bool)
    for _ in range(rounds):
        for k, (loss, total, *more) in enumerate(sums(at + step, mean, scale)):
            if done[k]:
                continue
            if not loss <= last[k]:
                step[k] /= 2
                done[k] = np.abs(step[k]).max() < 1e-10
            else:
                at[k], last[k] = at[k] + step[k], loss
                step[k], to, by = newton(np.array(more[:m]), np.reshape(more[m:], (m, m)))
                done[k] = step[k] @ more[:m] / 2 <= 1e-9 * loss or loss <= 1e-10 * total
                mean[k] += scale[k] * to
                scale[k] *= by
                for v in (at[k], step[k]):
                    v[0] += v[1:] @ to
                    v[1:] *= by
                at[k] += step[k] * done[k]  # the last step, too small to need proof
            step[k] *= not done[k]
        if done.all():
            break
    dropped(blocks)
    of_fold = lambda values: F.get(F.array(*(F.lit(float(x)) for x in values)), F.col("fold"))
    parts = (of_fold(at[:, i + 1] / scale[:, i]) * (F.col(f) - of_fold(mean[:, i])) for i, f in enumerate(features))
    return 1 / (1 + F.exp(-reduce(lambda s, x: s + x, parts, of_fold(at[:, 0]))))


def newton(slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step to the optimum of the quadratic form, and centres and scales of features by its weights. A feature that doesn't
    vary, or less than can be told before it is centred, is left as it is."""
    if curve[0, 0] < 1e-200:
        return np.zeros(len(slope)), np.zeros(len(slope) - 1), np.ones(len(slope) - 1)
    to = curve[0, 1:] / curve[0, 0]
    spread = curve[1:, 1:] - np.outer(to, to) * curve[0, 0]
    size = np.sqrt(np.maximum(np.diag(spread), 0))
    varies = size > 1e-7 * np.sqrt(np.diag(curve)[1:])
    size = np.where(varies, size, 1.0)
    part = varies / size
    own = np.linalg.lstsq(spread * np.outer(part, part), (slope[1:] - to * slope[0]) * part, rcond=1e-12)[0] * part
    return np.concatenate([[slope[0] / curve[0, 0] - to @ own], own]), to, np.where(varies, size / np.sqrt(curve[0, 0]), 1.0)


def by_source(rows: DataFrame, features: list[str], kind: str = "boosted", n: int = 5, rounds: int | None = None) -> DataFrame:
    """Out-of-fold scores of a model for each source, put together."""
    return reduce(DataFrame.unionByName, [out_of_fold(rows.where(F.col("is_s3") == k), features, kind, n, rounds) for k in (0.0, 1.0)])


def calibrated(scored: DataFrame, n: int = 3) -> DataFrame:
    """p replaced by a logistic curve fitted on it, out of fold."""
    rows = scored.drop("fold").withColumnRenamed("p", "raw")
    return out_of_fold(rows, ["raw"], "logistic", n, 100)


def importances(models: list[PipelineModel], features: list[str]) -> list[tuple[str, float]]:
    """Mean importance of each feature over models of trees, highest first."""
    vectors = [m.stages[-1].featureImportances.toArray() for m in models]
    mean = [sum(float(v[i]) for v in vectors) / len(vectors) for i in range(len(features))]
    return sorted(zip(features, mean), key=lambda x: (-x[1], x[0]))
