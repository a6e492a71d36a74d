"""Mixing of sources to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives
every document a posterior over the domains. Document rates r >= 0 are then
fitted by projected-gradient least squares so that the expected tokens of every
domain, sum of rate * tokens * posterior, meet the targets. The gradient of a
rate needs only the document's posterior and the vector of domain residuals, so
each step sends one number a domain to the executors and gets as many back.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hidden_names, stage
from tidemark.llm.textmodel import FEATURES, SAMPLE, choose_features, labelled_sample, matrix, minimise, per_document

#: Steps after which a fit ends that neither meets its targets nor stands still; what it reached is logged and returned.
STEPS, TOLERANCE = 300, 1e-4
#: Movement of a plain gradient step (part of all tokens) at which rates stand still: the targets are out of reach.
STILL = 1e-7
#: Domains of the labels table, and their target shares of all tokens.
DOMAINS = ("low", "high", "toxic")
TARGETS = {"low": 0.10, "high": 0.88, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) -> (doc_id, y): the place of the row's domain in ``DOMAINS``; null where it is unknown."""
    y = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return labels.select("doc_id", y.alias("y"))


def fit_softmax(rows, cols, vals, y, size: int, k: int, ridge: float = 1e-4) -> np.ndarray:
    """(size + 1, k) weights, the last row the intercepts."""
    n = len(y)

    def slope(p):
        w = p.reshape(size + 1, k)
        eta = np.stack([np.bincount(rows, vals * w[cols, j], minlength=n) for j in range(k)], 1) + w[size]
        e = np.exp(eta - eta.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - (y[:, None] == np.arange(k))) / n
        g = np.zeros((size + 1, k))
        for j in range(k):
            g[:size, j] = np.bincount(cols, vals * d[rows, j], minlength=size)
        g[size] = d.sum(0)
        g[:size] += ridge * w[:size]
        return g.ravel()

    return minimise(slope, np.zeros((size + 1) * k), steps=150).reshape(size + 1, k)


def posteriors(docs: DataFrame, sample: DataFrame, text: str = "text", size: int = FEATURES) -> DataFrame:
    """``docs`` with tokens (words) and p (posterior of each domain); ``sample`` (doc_id, y, text) is bounded."""
    sample = stage(sample)
    features = choose_features(sample, size)
    rows, cols, vals, y = matrix(sample, features)
    k = len(DOMAINS)
    w = fit_softmax(rows, cols, vals, y, len(features), k) if len(y) else np.zeros((len(features) + 1, k))

    def compute(x):
        e = x.dot(w[:-1]) + w[-1]
        e = np.exp(e - e.max(1, keepdims=True))
        return x.words, e / e.sum(1, keepdims=True)

    return per_document(docs, text, features, compute, "tokens long, p array<double>")


log = logging.getLogger(__name__)


def _fold(p: np.ndarray, steps: list[tuple[float, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given steps (momentum, scaled residuals) from 1, and those before the last step."""
    r = last = np.ones(len(p))
    for momentum, miss in steps:
        r, last = np.maximum(least, r + momentum * (r - last) - p @ miss), r
    return r, last


def _rate(steps: list[tuple[float, np.ndarray]], k: int, least: float):
    """``_fold`` as a column over ``p``."""
    if not steps:
        return F.lit(1.0)
    each = F.array(*[F.array(F.lit(float(m)), *[F.lit(float(x)) for x in miss]) for m, miss in steps])

    def step(a, s):
        push = sum((F.col("p")[i] * s[i + 1] for i in range(k)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(float(least)), a["r"] + s[0] * (a["r"] - a["last"]) - push).alias("r"), a["r"].alias("last"))

    return F.aggregate(each, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("last")), step, lambda a: a["r"])


def fit_rates(known: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE, least: float = 0.0) -> DataFrame:
    """``known`` (tokens, p, ...) with ``rate``: at least ``least``, starting from 1, meeting ``targets`` (tokens of each domain).

    Accelerated projected gradient; residuals are weighted by the inverse Gram
    matrix of the posteriors, so that small domains move as fast as large ones
    (a domain with target zero keeps the plain weight). Steps go on until the
    rates themselves meet the targets, or stand still: then these are out of
    reach, which is logged. Every step is one pass that replays the few numbers
    of the steps before it, so no rates are written in between and a lost
    executor costs only its own tasks. The result's ``reached`` holds the tokens
    of each domain.
    """
    k = len(targets)
    pairs = known.select(F.col("tokens").cast("double").alias("t"), "p")
    names = [f"g{i}" for i in range(max(k * k, 2 * k + 1))]

    def summed(compute, n):
        def run(batches):
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in compute(b.column(0).to_numpy(zero_copy_only=False), p)], names=names[:n])

        parts = pairs.mapInArrow(run, ", ".join(f"{c} double" for c in names[:n]))
        return np.array([x or 0.0 for x in parts.agg(*[F.sum(c) for c in names[:n]]).first()], dtype=float)

    total = float(known.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        out = known.withColumn("rate", F.lit(1.0))
        out.reached = [0.0] * k
        return out
    gram = summed(lambda t, p: ((p * t[:, None]).T @ p).ravel(), k * k).reshape(k, k) / total
    goal = np.array(targets) / total
    plain = 1 / np.linalg.eigvalsh(gram)[-1]
    weight = np.eye(k) * plain
    wanted = np.flatnonzero(goal > 0)
    weight[np.ix_(wanted, wanted)] = np.linalg.pinv(gram[np.ix_(wanted, wanted)], rcond=1e-9, hermitian=True)
    weight /= np.linalg.eigvals(weight @ gram).real.max()
    done: list[tuple[float, np.ndarray]] = []
    age, worst = 0, np.inf
    for _ in range(steps):
        momentum = age / (age + 3)

        def ahead(t, p, done=tuple(done), momentum=momentum):
            r, last = _fold(p, done, least)
            return np.concatenate([(t * r) @ p, (t * (r + momentum * (r - last))) @ p, [t @ np.abs(r - last)]])

        sums = summed(ahead, 2 * k + 1) / total
        miss = sums[:k] - goal
        if np.abs(miss).max() < tolerance * goal.sum():
            break
        if done and done[-1][0] == 0 and sums[-1] < STILL and len(done) > 1:
            log.warning("mixing: targets out of reach; shares wanted %s, reached %s", goal.tolist(), sums[:k].tolist())
            break
        # Momentum starts anew where the residual grows or the rates hardly move.
        size = float(miss @ weight @ miss)
        push = sums[k : 2 * k] - goal
        if size > worst or sums[-1] < STILL and done:
            age, momentum, push = 0, 0.0, miss
        done.append((momentum, weight @ push))
        age, worst = age + 1, size
    else:
        steps_done = tuple(done)
        sums = summed(lambda t, p: (t * _fold(p, steps_done, least)[0]) @ p, k) / total
        log.warning("mixing: rates not settled after %s steps; shares wanted %s, reached %s", steps, goal.tolist(), sums.tolist())
    out = known.withColumn("rate", _rate(done, k, least))
    out.reached = (sums[:k] * total).tolist()
    return out


def scaled_targets(known: DataFrame, targets: dict[str, float]) -> list[float]:
    """Target tokens of each domain: the target shares at the corpus' own size."""
    total = known.agg(F.sum("tokens")).first()[0] or 0
    share = sum(targets.values())
    return [targets[d] / share * total for d in DOMAINS]


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    tokens, a posterior p_<domain> for each domain, and rate.

    Null and empty texts have no tokens; their rate follows their posterior.
    Texts of any length are read whole. Repeated rows get equal rates; null doc_ids are mixed but never trained on.
    An empty ``labels`` gives equal posteriors, an empty table an empty one.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stage(posteriors(typed, labelled_sample(typed, domain_labels(labels), SAMPLE)).drop("text"))
    fitted = fit_rates(known, scaled_targets(known, targets))
    return fitted.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")


def repeated_targets(known: DataFrame, targets: dict[str, float]) -> list[float]:
    """Target tokens of each domain, with the target shares, that rates of 1 or more can meet.

    Rates 1 + p.c add G c tokens (G the Gram matrix of the posteriors, by
    tokens); the smallest corpus with c >= 0 is taken. A domain without a share
    keeps its tokens and what the others' rows bring. Where posteriors tell the
    domains too badly apart for that, every domain is given at least its tokens.
    """
    k = len(DOMAINS)
    p, t = [F.col("p")[i] for i in range(k)], F.col("tokens")
    sums = [x or 0.0 for x in known.agg(*[F.sum(a * t) for a in p], *[F.sum(a * b * t) for a in p for b in p]).first()]
    own, gram = np.array(sums[:k]), np.array(sums[k:]).reshape(k, k)
    share = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    plain = max((n / x for n, x in zip(own, share) if x > 0), default=0.0)
    wanted = np.flatnonzero(share > 0)
    inner = np.linalg.pinv(gram[np.ix_(wanted, wanted)], rcond=1e-9, hermitian=True)
    up, now = inner @ share[wanted], inner @ own[wanted]
    if own.any() and (up > 0).all() and (size := float((now / up).max())) < 4 * plain:
        return (own + gram[:, wanted] @ (size * up - now)).tolist()
    return np.maximum(own, share * plain).tolist()


def repeat_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with every row repeated by its rate; all columns stay, whatever their names.

    Rates are fitted to be 1 or more, so the mix meets the target shares by
    repetition alone and no row goes; the result's ``reached`` holds the tokens
    of each domain. The fraction of a rate is rounded by a hash of doc_id and
    text, so repeated rows get equal copies. Posteriors come with the rows in
    one pass over the texts. A null or empty text, or one of any length, is one
    row like any other; null doc_ids are repeated but never trained on. Empty
    ``labels`` give equal posteriors, an empty table an empty one.
    """
    hidden, names = hidden_names(docs)
    own_id, own_text = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    known = stage(posteriors(hidden, labelled_sample(docs, domain_labels(labels), SAMPLE), own_text))
    fitted = fit_rates(known, repeated_targets(known, targets), least=1.0)
    draw = F.pmod(F.xxhash64(own_id, own_text), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.col("rate") + draw).cast("int")
    out = fitted.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*names)
    out.reached = fitted.reached
    return out
