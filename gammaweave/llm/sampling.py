"""Bounded, repeatable samples of labelled rows for fitting classifiers, and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def label_rows(labels: DataFrame, label: str, doc: str = "doc_id") -> DataFrame:
    """doc_id, label (0 or 1): of several labels of one document the largest; rows without either are left out."""
    return labels.select(F.col(doc).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def chosen(rows: DataFrame, classes: list, per_class: dict, column: str = "label") -> DataFrame:
    """At most per_class[c] rows (doc_id, label) of each class c: those with the smallest hash of doc_id. Bounded, so it can be broadcast."""
    parts = [rows.where(F.col(column) == F.lit(c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[c]) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ids = out.select("doc_id", column).collect()
    spark = rows.sparkSession
    return spark.createDataFrame([tuple(r) for r in ids], out.select("doc_id", column).schema)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method for a ridge logistic fit on standardised columns: (mean, scale, coefficients with the intercept last)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty, grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def column(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(documents: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, str]:
    """documents' columns keep by their places, as k_0, k_1, ..., so that no name can clash, and the name there of the text, which is not sent twice."""
    kept = [column(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    if text in keep and documents.schema[text].dataType.simpleString() == "string":
        return documents.select(*kept), f"k_{keep.index(text)}"
    return documents.select(*kept, column(text).cast("string").alias("text")), "text"


def carried(keep: tuple[str, ...]) -> list[str]:
    return [f"k_{i}" for i in range(len(keep))]


def restored(rows: DataFrame, keep: tuple[str, ...], *added: str) -> DataFrame:
    """The kept columns by their own names, and the added ones; a kept one that an added one's name clashes with gets _ at its end."""
    taken, names = list(added), []
    for c in keep:
        names.append(fresh(c, taken))
        taken.append(names[-1])
    return rows.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(names)), *added)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
