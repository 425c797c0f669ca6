"""Held-out folds, bounded samples of labelled rows, and scoring columns shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import column, cut

FOLDS = 5


def held_out(doc: Column) -> Column:
    """Whether crc32 of the id, as text, leaves no remainder by FOLDS. A null id is never held out and never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out, written to shared storage.

    They are the first by a hash of the id, so the choice doesn't depend on
    order or partitions; of several texts of an id the least counts, and equal
    texts with equal labels count once. Of conflicting labels of an id the larger holds; null
    labels and ids don't count. The ids are at most ``rows`` rows, which bounds
    the broadcast.
    """
    known = labels.select(column(doc).alias("doc"), column(label).cast("int").alias("label")).dropna().filter(~held_out(F.col("doc")))
    chosen = known.groupBy("doc").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("doc").cast("string"), F.lit("fit")), "doc").limit(rows)
    texts = docs.select(column(doc).alias("doc"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(chosen), "doc").groupBy("doc").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return cut(one.select("text", (F.col("label") > 0).cast("int").alias("label")).dropDuplicates())


def in_order(chosen: DataFrame, size: int) -> Iterator[tuple[str, int]]:
    """The sample's first rows by a hash of the text, up to ``size`` bytes of text: the same for every partitioning."""
    for text, label in chosen.orderBy(F.xxhash64("text", F.lit("order")), "text", "label").toLocalIterator():
        size -= len(text.encode())
        if size < 0:
            return
        yield text, label


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalised logistic regression, by Newton steps; one class alone gives its smoothed log-odds."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w += size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return w


def grid(x: np.ndarray) -> np.ndarray:
    """Rounded to multiples of 2 ** -16, so that sums of very many are exact and don't depend on how texts are batched."""
    return np.round(np.asarray(x, np.float64) * 65536) / 65536


def predictions(scored: DataFrame, score: Column, threshold: float, doc: str = "doc_id") -> list[Column]:
    """The query's columns."""
    return [column(doc), held_out(column(doc)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")]
