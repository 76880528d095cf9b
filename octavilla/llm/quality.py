"""Quality by ordinal regression: one weight per hashed feature, ordered thresholds between grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text
from .models import FEATURES, feature_matrix, labelled_sample, minimize, sigmoid, text_features

#: A document is kept if it is at least as likely as this to reach grade 1.
KEPT_FROM = 0.5
#: Weight of the squared norm of the weights, per labelled row.
RIDGE = 2e-4


@dataclass
class Grader:
    """P(grade > k) = sigmoid(x w - threshold[k]) for k = 0 .. grades - 2."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights).sum(axis=1)  # row by row, so that a text's score is the same in any batch
        return sigmoid(z[:, None] - self.thresholds[None, :])


def _unpack(p: np.ndarray, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds come as the first one and the logarithms of the steps up, so they stay ordered."""
    t = p[:cuts]
    return p[cuts:], t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def fit_grades(x: np.ndarray, grade: np.ndarray, grades: int) -> Grader:
    """Maximum likelihood of the cumulative-link model; without rows every grade is as likely."""
    cuts = grades - 1
    if not len(x):
        even = np.arange(1, grades) / grades
        return Grader(np.zeros(FEATURES), np.log(even / (1 - even)))
    scale = 1 / np.maximum(x.std(axis=0), 1e-2)
    x = x * scale
    n, upper = len(x), np.minimum(grade, cuts - 1)
    lower = np.maximum(grade - 1, 0)

    def f(p):
        w, t = _unpack(p, cuts)
        z = x @ w
        below = np.where(grade == cuts, 1.0, sigmoid(t[upper] - z))  # P(y <= grade)
        under = np.where(grade == 0, 0.0, sigmoid(t[lower] - z))
        mass = np.maximum(below - under, 1e-12)
        db, du = below * (1 - below) / mass, under * (1 - under) / mass
        by_threshold = np.zeros(cuts)
        np.add.at(by_threshold, upper, np.where(grade == cuts, 0.0, db))
        np.add.at(by_threshold, lower, -np.where(grade == 0, 0.0, du))
        g_t = np.empty(cuts)
        for k in range(cuts):
            g_t[k] = by_threshold[k:].sum() * (1.0 if k == 0 else np.exp(p[k]))
        g_w = x.T @ (db - du)
        value = -np.log(mass).sum() / n + RIDGE * (w @ w) / 2
        return value, np.concatenate([-g_t / n, g_w / n + RIDGE * w])

    shares = np.clip([(grade <= k).mean() for k in range(cuts)], 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    p = minimize(f, np.concatenate([start[:1], steps, np.zeros(x.shape[1])]))
    w, t = _unpack(p, cuts)
    return Grader(w * scale, t)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 good but toxic, 2 good.  Rows with a null label are not ratings."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


def fit_on_ratings(docs: DataFrame, ratings: DataFrame, grades: int) -> Grader:
    """The sample of rated rows is bounded by ``models.SAMPLE``; each rating of a document counts."""
    sample = labelled_sample(docs, ratings, ["grade"])
    return fit_grades(feature_matrix(sample), sample["grade"].to_numpy(np.int64), grades)


def grade_documents(docs: DataFrame, grader: Grader) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_1`` .. and ``selected``, in one pass without a shuffle.

    ``tail_k`` is the probability of at least grade k, ``expected_grade`` their sum, and
    ``selected`` says whether ``tail_1`` reaches ``KEPT_FROM``.  A null text is the empty text,
    which has a score like any other.  All columns of ``docs`` are kept as they are; new ones
    replace older ones of the same name.  Repeated rows are scored alike; no row, no result.
    """
    cuts = len(grader.thresholds)
    sent = docs.sparkSession.sparkContext.broadcast(grader)

    @F.pandas_udf("array<double>")
    def tails(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), 64):
            out += [r.tolist() for r in sent.value.tails(text_features(texts.iloc[k:k + 64].tolist()))]
        return pd.Series(out)

    scored = docs.withColumn("_tails", tails(whole_text()))
    tail = [F.col("_tails")[k] for k in range(cuts)]
    return scored.withColumns(
        {"expected_grade": sum(tail[1:], tail[0])} | {f"tail_{k + 1}": t for k, t in enumerate(tail)}
        | {"selected": tail[0] >= KEPT_FROM}).drop("_tails")


def keep_selected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents likely to reach grade 1, with the columns they came with."""
    grader = fit_on_ratings(table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels")), 3)
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    return grade_documents(whole, grader).filter("selected").select("row.*")


def op4_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grader = fit_on_ratings(docs, graded(table(spark, sf_dir, "labels")), 3)
    scored = grade_documents(docs.select("doc_id", "text"), grader)
    return scored.select("doc_id", "expected_grade", "tail_1", "tail_2", "selected")
