"""Operator 2: quality classifier by positive-unlabelled learning.

A linear model over the make-up of a text: how often each class of characters follows each other, and some lengths and
repetition figures. It minimises the non-negative unbiased risk for positive and unlabelled data,

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss, from trusted positives (texts labelled 1 in the training folds) and unlabelled web text (any texts
of the training folds; their labels aren't looked at). The class prior is estimated as well: a first model tells positives
from unlabelled texts, and the prior is the least ratio of the share of unlabelled texts to the share of positives among
the high scores of texts that were kept out of its fit.

Training reads a bounded sample: at most about ``POSITIVES`` and ``UNLABELLED`` texts, drawn by a hash of id and text; rows that repeat
both count once there, and a trusted id that several texts have teaches one of them. Scoring reads every text whole.

Nulls and odd rows: a null text is an empty one, and those score by their (zero) features like any other; repeated rows
score alike; labels that contradict each other count as positive; without positives or unlabelled texts nothing is learnt and
every score is 0.5 times the prior of 1, that is 0.5; columns other than doc_id and text are never read by the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._sample import drawn, held_out, labelled, unpacked
from brooklet.llm._text import Hasher, batches, windows, words
from brooklet.session import table

POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 400, 0.05, 1e-4
#: Share of the positives that a score must be reached by for the prior to be read off at it; random splits that it is the mean of.
LEAST_TAIL, SPLITS = 0.5, 3
#: How much of its sampling error is added to each bound, since the least of many is found too low.
ERROR = 0.2

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:192] = 4
_CLASS[192:] = 5
for _i, _same in enumerate((" ", "\n\t", ".", ",", ":;", "!", "?", "|", "%", "$", "*", "#", "&", "@", "/\\", "-_", "+=<>~^`", "()[]{}", "\"'"), start=6):
    _CLASS[[ord(c) for c in _same]] = _i
_K = int(_CLASS.max()) + 1
#: Marks that prose has few of.
_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "|%$*#&@/\\_+=<>[]{}~^`"]] = True
EXTRA = 12
WIDTH = _K * _K + EXTRA


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(text, feature) of a piece of texts."""
    n = len(off) - 1
    size = np.diff(off)
    owner = np.repeat(np.arange(n), size)
    c = _CLASS[data]
    code = owner[:-1] * (_K * _K) + c[:-1] * _K + c[1:]
    pairs = np.bincount(code[owner[:-1] == owner[1:]], minlength=n * _K * _K).reshape(n, _K * _K)
    out = np.empty((n, WIDTH), dtype=np.float32)
    out[:, :-EXTRA] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    low, s, e, whose = words(data, off)
    count = np.bincount(whose, minlength=n)
    h = Hasher(low).spans(s, e)
    kinds = _kinds(h, whose, n)
    within = whose[1:] == whose[:-1]
    pair = windows(h, 2)[within]
    pair_kinds = _kinds(pair, whose[1:][within], n)
    again = np.bincount(whose[1:][within & (h[1:] == h[:-1])], minlength=n)
    thrice = np.bincount(whose[2:][within[1:] & within[:-1] & (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])], minlength=n)
    odd = np.bincount(owner[_ODD[data]], minlength=n)
    barred = np.bincount(owner[data == 124], minlength=n)
    letters = np.bincount(whose, weights=e - s, minlength=n)
    lines = np.bincount(owner[data == 10], minlength=n) + 1
    out[:, -12] = np.minimum(10 * thrice / np.maximum(count, 1), 1)
    out[:, -11] = np.minimum(thrice, 3) / 3
    out[:, -10] = np.sqrt(again / np.maximum(count, 1))
    out[:, -9] = np.log((pair_kinds + 1) / (np.bincount(whose[1:][within], minlength=n) + 1))
    out[:, -8] = np.minimum(odd / np.maximum(count, 1), 2)
    out[:, -7] = np.minimum(barred / np.maximum(count, 1), 1)
    out[:, -6] = np.log1p(count) / 10
    out[:, -5] = np.log1p(letters / np.maximum(count, 1))
    out[:, -4] = np.log((kinds + 1) / (count + 1))
    out[:, -3] = np.log1p(count / lines) / 10
    out[:, -2] = count == 0
    out[:, -1] = np.maximum(0, 5 - np.log1p(count))
    return out


def _kinds(h: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text."""
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    return np.bincount(whose[new], minlength=n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(x: np.ndarray, slope, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam on a linear model; slope(z) is the gradient of the risk by each row's output."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = slope((x @ w.astype(np.float32)).astype(np.float64) + b)
        grad = np.append(x.T @ g.astype(np.float32) + RIDGE * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 2) -> float:
    """Share of positives among unlabelled rows, from two-fold scores of positive against unlabelled.

    Above any score the share of unlabelled rows is at least the prior times that of the positives; the score at which that bound is least
    tells the most. It is looked for among scores that at least ``LEAST_TAIL`` of the positives reach, since a thin tail would be taken at its luckiest; a part
    ``ERROR`` of the sampling error is added, and the mean is taken over ``SPLITS`` random splits.
    """
    rng, found = np.random.default_rng(seed), []
    for _ in range(SPLITS if len(p) > 1 and len(u) > 1 else 0):
        half_p, half_u = rng.permutation(len(p)) % 2, rng.permutation(len(u)) % 2
        for k in (0, 1):
            x, n_p = np.concatenate([p[half_p == k], u[half_u == k]]), int((half_p == k).sum())
            n_u = len(x) - n_p
            y, weight = np.arange(len(x)) < n_p, np.where(np.arange(len(x)) < n_p, 0.5 / n_p, 0.5 / n_u)
            w, b = _descend(x, lambda z, y=y, weight=weight: 2 * weight * (_sigmoid(z) - y), 150)
            high, other = np.sort(p[half_p != k] @ w + b)[::-1], np.sort(u[half_u != k] @ w + b)
            share = np.arange(1, len(high) + 1) / len(high)
            above = 1 - np.searchsorted(other, high, "left") / len(other)
            error = np.sqrt(1 / np.maximum(len(high) * share, 1) + 1 / np.maximum(len(other) * above, 1))
            found.append(float(np.min((above * (1 + ERROR * error) / share)[share >= LEAST_TAIL])))
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def pu_risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the outputs ``z``, positives first, and the slope to descend by.

    Logistic loss: l(+1) = log(1 + e^-z), l(-1) = log(1 + e^z). Where the estimate of the negatives' risk is below 0, the risk
    is that of the positives, and the slope leads back along the estimate only.
    """
    zp, zu = z[:n_p], z[n_p:]
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    toward = prior * (_sigmoid(zp) - 1) / n_p
    away_p, away_u = -prior * _sigmoid(zp) / n_p, _sigmoid(zu) / len(zu)
    risk = float(prior * np.logaddexp(0, -zp).mean() + max(0.0, negative))
    return risk, np.concatenate([-away_p, -away_u] if negative < 0 else [toward + away_p, away_u])


def fit(x: np.ndarray, n_p: int) -> Model:
    """Minimises ``pu_risk`` over features, positives first; ``x`` is standardised in place."""
    if not n_p or n_p == len(x):
        return Model(np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = x[n_p:].mean(axis=0, dtype=np.float64), x[n_p:].std(axis=0, dtype=np.float64) + 0.02
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    prior = estimate_prior(x[:n_p], x[n_p:])
    w, b = _descend(x, lambda z: pu_risk(z, n_p, prior)[1])
    return Model(w / scale, float(b - (mean / scale) @ w), prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from positives of the training folds and from unlabelled texts of the same folds."""
    known = labelled(labels, "quality").filter("label = 1").select("doc_id")
    trusted = F.broadcast(drawn(known, positives, known.count(), "positive"))  # bounded by the parameter
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h")).filter(~held_out())
    n = texts.count()
    # One text for each trusted id, so that the bound of the ids is one of the rows.
    least = texts.join(trusted, "doc_id").groupBy("doc_id").agg(F.min("h").alias("h")).withColumn("p", F.lit(1))
    web = F.pmod(F.xxhash64("h", F.lit("unlabelled")), F.lit(1 << 30)) < (1 << 30 if n <= unlabelled else int(unlabelled / n * (1 << 30)))
    marked = texts.join(F.broadcast(least), ["doc_id", "h"], "left").withColumn("u", web).filter(F.col("u") | F.col("p").isNotNull())
    drawn_once = marked.groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.max("p").alias("p"), F.max("u").alias("u"))

    def extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, data, off in batches(batch.column(1)):
                x = features(data, off)
                yield pa.record_batch([*(batch.column(k).slice(a, b - a) for k in (0, 2, 3)), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "p", "u", "x"])

    found = drawn_once.select("h", "text", "p", "u").mapInArrow(extract, "h long, p int, u boolean, x binary").toArrow()
    order = np.argsort(found.column("h").to_numpy(), kind="stable")
    is_p, is_u = np.array(found.column("p").is_valid())[order], found.column("u").to_numpy().astype(bool)[order]
    rows = np.concatenate([order[is_p], order[is_u]])
    x = unpacked(found.column("x"), np.float32).reshape(-1, WIDTH)
    del found
    return fit(x[rows], int(is_p.sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, of each whole text."""
    docs = docs.drop("score").withColumn("score", F.lit(0.0))
    at, n = docs.columns.index("text"), len(docs.columns) - 1

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [_sigmoid(features(data, off) @ model.weights + model.bias) for _, _, data, off in batches(batch.column(at))]
            yield pa.record_batch([*batch.columns[:n], pa.array(np.concatenate(found) if found else [], pa.float64())], names=batch.schema.names)

    return docs.mapInArrow(rate, docs.schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts that the model rejects, columns unchanged."""
    rated = score(docs.select(F.struct("*").alias("row"), "text"), model)
    return rated.filter(F.col("score") >= THRESHOLD).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
