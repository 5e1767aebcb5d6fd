"""Bounded samples of labelled rows, models learned from them in one task, and a small logistic regression."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows of df with the `rows` least values of key; only keys meet in one place."""
    least = df.select(key.alias("h")).where("h is not null").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(key <= F.lit(least)) if least is not None else df.limit(0)


def chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, y of the chosen(doc_id, y) documents, a few thousand at most, which alone are broadcast.

    Where several rows share an id, the text that sorts first counts; a null text is empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """doc_id, text and label y of at most `rows` labelled documents, drawn by id hash.

    labels(doc_id, <label>): null labels are left out; of several for one id the largest
    counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y is not null").where(usable)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    return chosen_texts(docs, known.orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(rows))


def trained(sample: DataFrame, learn: Callable[[list, list], object]) -> object:
    """learn(texts, y) of a bounded sample(doc_id, text, y), rows in the order of doc_id.

    It runs in one task of an executor, which a lost executor only repeats; the driver
    gets the finished model, never the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = pickle.dumps(learn([r[1] for r in rows], [r[2] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else learn([], [])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights with the bias last) by damped Newton steps."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * max(len(x), 1) ** 0.5)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return mean, dev, w


def logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, dev, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / dev) @ w[:-1] + w[-1], -30, 30)))
