"""Labelled documents, all or a bounded sample, and logistic loss by Newton's method."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import text_of


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def _known(labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most `bound` allowed labelled rows, those whose hashed ids are least.

    Null labels and ids are left out; of repeated label rows the largest label counts, of repeated document rows the
    least text. The ids are bounded, so they may be broadcast, and so is the sample, which is written once.
    """
    chosen = _known(labels, label, allowed).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut_lineage(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    """(doc_id, text, y) of all allowed labelled rows, with repeated ones as in labelled_sample."""
    found = docs.select("doc_id", text_of().alias("text")).join(_known(labels, label, allowed), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def summed(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of an array of numbers that `of` makes of each batch of written rows. A task sends one array, and these are
    added by partition, so that the sum is the same in every run."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = [np.asarray(of(batch), float) for batch in batches if len(batch)]
        if arrays:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "x": [np.sum(arrays, 0).tolist()]})

    found = sorted(rows.mapInPandas(sums, "at int, x array<double>").collect())
    return np.sum([r["x"] for r in found], 0)


def derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of logistic loss."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def newton(at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], prior: np.ndarray, pull: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights that minimise a loss, whose derivatives `at` gives, plus pull/2 times the squared distance from prior."""
    w = prior.astype(float).copy()
    for _ in range(rounds):
        gradient, hessian = at(w)
        step = np.linalg.solve(hessian + pull * np.eye(len(w)), gradient + pull * (w - prior))
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights that minimise logistic loss plus pull/2 times the squared distance from prior."""
    return newton(lambda w: derivatives(x, y, w), prior, pull, rounds)
