"""Severity of toxic language by cumulative-link ordinal regression.

Grades are ordered: 0 for documents labelled clean, 1 to ``GRADES - 1`` for
toxic ones by how dense their marker words are (equal shares of the labelled
toxic rows; markers are the features most over-represented in them). One weight
vector is shared by all thresholds: P(grade <= j) = 1 / (1 + exp(w.x - b_j)),
b rising. The result is the expected grade.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hidden_names, stage
from tidemark.llm.textmodel import SAMPLE, choose_features, labelled_sample, matrix, minimise, per_document

GRADES, REJECT = 4, 0.5
#: Fewer features than other classifiers take: markers are rare and strong. One that occurs counts in a long text too.
FEATURES, PRESENCE, RIDGE = 600, 0.5, 1e-3


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(rows, cols, vals, grade, size: int, grades: int, ridge: float = RIDGE):
    """Shared weights and rising thresholds. Thresholds are a first value and positive steps, so they stay ordered."""
    n = len(grade)
    weight = n / (grades * np.maximum(1, np.bincount(grade, minlength=grades)))[grade]
    weight = np.sqrt(weight) / np.sqrt(weight).sum()

    def unpack(p):
        steps = np.exp(np.clip(p[size + 1 :], -20, 20))
        return p[:size], p[size] + np.concatenate([[0.0], np.cumsum(steps)]), steps

    def slope(p):
        w, b, steps = unpack(p)
        eta = np.bincount(rows, vals * w[cols], minlength=n)
        below = np.hstack([np.zeros((n, 1)), _sigmoid(b[None, :] - eta[:, None]), np.ones((n, 1))])
        hi, lo = below[np.arange(n), grade + 1], below[np.arange(n), grade]
        like = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        d_eta = weight * (dhi - dlo) / like
        g = np.zeros_like(p)
        g[:size] = np.bincount(cols, vals * d_eta[rows], minlength=size) + ridge * w
        db = np.zeros(grades - 1)
        up = grade < grades - 1
        np.add.at(db, grade[up], -(weight * dhi / like)[up])
        down = grade > 0
        np.add.at(db, grade[down] - 1, (weight * dlo / like)[down])
        g[size] = db.sum()
        tail = np.cumsum(db[::-1])[::-1]
        g[size + 1 :] = tail[1:] * steps
        return g

    start = np.zeros(size + grades - 1)
    start[size] = 1.0
    w, b, _ = unpack(minimise(slope, start))
    return w, b


def expected(w: np.ndarray, b: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per score (w.x) the expected grade, and P(grade > j) for every threshold."""
    above = 1 - _sigmoid(b[None, :] - score[:, None])
    return above.sum(1), above


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, size: int = FEATURES, grades: int = GRADES):
    """(features, weights, thresholds) from at most ``limit`` rows of ``labels`` (doc_id, toxic) and their texts.

    Without a toxic and a clean row among them, nothing is ever rejected.
    """
    sample = stage(labelled_sample(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("y")), limit))
    features = choose_features(sample, size)
    rows, cols, vals, y = matrix(sample, features, PRESENCE)
    if len(set(y.tolist())) < 2 or not features:
        return features, np.zeros(len(features)), 40.0 + np.arange(grades - 1)
    toxic = y > 0
    hit = lambda of: np.bincount(cols, of[rows], minlength=len(features)) / max(1, of.sum())
    share, rest = hit(toxic.astype(float)), hit((~toxic).astype(float))
    marker = share > 4 * rest + 0.002
    dense = np.bincount(rows, vals * marker[cols], minlength=len(y))
    edges = np.quantile(dense[toxic], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic, 1 + np.searchsorted(edges, dense, side="right"), 0)
    w, b = fit_ordinal(rows, cols, vals, grade, len(features), grades)
    return features, w, b


def severity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    severity (expected grade, 0 to GRADES - 1), grade (the likeliest), p_toxic
    (probability of grade 1 or more) and toxic (severity >= ``reject``).

    A null or empty text has no features and takes the model's base severity.
    Repeated rows score alike; null doc_ids score but are never trained on. An
    empty ``labels`` rejects nothing; an empty table gives an empty one.
    """
    features, w, b = fit(docs, labels, limit)

    def compute(x):
        s, above = expected(w, b, x.dot(w))
        edge = np.ones((len(s), 1))
        p = -np.diff(np.hstack([edge, above, 0 * edge]), axis=1)
        return s, p.argmax(1), above[:, 0]

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = per_document(typed, "text", features, compute, "severity double, grade int, p_toxic double", PRESENCE).drop("text")
    return scored.withColumn("toxic", F.col("severity") >= reject)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the rows whose expected severity reaches ``reject``.

    All columns stay, whatever their names. Texts are read whole, whatever their
    length; a null or empty one takes the model's base severity. Repeated rows
    go or stay together; rows with a null doc_id are judged like any other. An
    empty ``labels`` rejects nothing; an empty table gives an empty one.
    """
    features, w, b = fit(docs, labels)
    hidden, names = hidden_names(docs)
    text = f"_c{docs.columns.index('text')}"
    scored = per_document(hidden, text, features, lambda x: (expected(w, b, x.dot(w))[0],), "severity double", PRESENCE)
    return scored.where(F.col("severity") < reject).select(*names)
