"""Operator 8: toxicity by multiple-instance learning.

A text is a bag of sentences (cut at ``. ! ?`` and line feeds). A linear model over hashed words and word beginnings gives
each sentence a probability; the text's score is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels train
it: the gradient of the noisy-or passes the label to the sentences. Afterwards the sentence scores say where the offence is.

Training reads a bounded sample: at most about ``POSITIVES`` and ``NEGATIVES`` labelled texts of the training folds, none of more than
``LONGEST`` bytes and about ``MAX_BYTES`` in all, weighted back to the proportions that the labels have. Scoring reads every text whole.

Nulls and odd rows: a null text, an empty one, or one without words scores 0; repeated rows score alike; an id that several texts
have teaches the least of them once; labels that
contradict each other count as toxic; without a label of either class nothing is learnt and every score is 0; columns
other than doc_id and text are never read by the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._sample import drawn, held_out, labelled, unpacked
from brooklet.llm._text import BASE2, Hasher, U, batches, mix, sums, words
from brooklet.session import checkpointed, table

POSITIVES, NEGATIVES = 1500, 3000
BITS = 18
#: Bytes of a word's beginning that are features beside the whole word; a word that goes on is told from one that ends there.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
STEPS, RATE = 120, 0.12
#: L1 penalty: words that tell nothing get no weight at all.
SPARSE = 2e-4
#: A feature is learnt if so many training texts hold it, and at most this share of the clean ones.
LEAST_TEXTS, MOST_SHARE = 5, 0.3
#: Gradients well below this move a weight little, so that a word of one text is not learnt by heart.
SMALL = 1e-3
THRESHOLD = 0.3
#: Bytes of the longest text that may be drawn for training, and of all that are.
LONGEST, MAX_BYTES = 1 << 20, 32 << 20
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of each word, its sentence, each sentence's text, and the bytes where each sentence starts and ends."""
    low, s, e, owner = words(data, off)
    if not len(s):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros((0, 1 + len(BEGINNINGS)), dtype=np.int32), none, none, none, none
    hasher, mask = Hasher(low), np.uint64((1 << BITS) - 1)
    columns = [hasher.spans(s, e) & mask]
    for k in BEGINNINGS:
        salt = np.where(e > s + k, np.uint64(0x9E3779B9 * k), np.uint64(0x85EBCA6B * k))
        columns.append((hasher.spans(s, np.minimum(e, s + k)) ^ salt) & mask)
    passed = np.cumsum(_END[low], dtype=np.int64)[s]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (passed[1:] != passed[:-1])
    sentence, first = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return np.stack(columns, axis=1).astype(np.int32), sentence, owner[first], s[first], e[last]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sentence_logits(model: Model, f: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    z = model.weights[f[:, 0]]
    for k in range(1, f.shape[1]):
        z = z + model.weights[f[:, k]]
    return sums(z, sentence, n) + model.bias


def risk(w: np.ndarray, bias: float, columns: np.ndarray, word: np.ndarray, starts: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The weighted log loss of the noisy-or, and its gradient by the weights and by the bias.

    ``columns``: the places in ``w`` of each kind of word, its last place standing for none; ``word``: the kind of each word of the
    sentences, end to end; ``starts``: where each sentence begins; ``owner``: each sentence's text, ascending.
    """
    each = np.append(w, 0.0)[columns].sum(axis=1)
    total = np.zeros(len(word) + 1)
    np.cumsum(each[word], out=total[1:])
    z = total[np.append(starts[1:], len(word))] - total[starts] + bias
    none = np.maximum(sums(_softplus(z), owner, len(y)), 1e-12)  # -log P(no sentence is toxic)
    loss = float((weight * ((1 - y) * none - y * np.log(-np.expm1(-none)))).sum())
    slope = weight * ((1 - y) - y / np.expm1(np.minimum(none, 500)))
    g = slope[owner] / (1 + np.exp(-np.maximum(z, -500)))
    by_word = np.bincount(word, weights=np.repeat(g, np.diff(np.append(starts, len(word)))), minlength=len(columns))
    gw = np.bincount(columns.ravel(), weights=np.repeat(by_word, columns.shape[1]), minlength=len(w) + 1)
    return loss, gw[:-1], float(g.sum())


def fit(columns: np.ndarray, word: np.ndarray, starts: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, common: np.ndarray) -> Model:
    """Minimises ``risk`` and an L1 penalty by full-batch Adam. ``common``: the features' numbers by their places."""
    if not len(y) or y.min() == y.max() or not len(word):
        return Model(np.zeros(1 << BITS, dtype=np.float32), -np.inf)
    weight = weight / weight.sum()
    size = len(common)
    w, bias = np.zeros(size), -6.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        _, gw, gb = risk(w, bias, columns, word, starts, owner, y, weight)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        pace = RATE / (np.sqrt(v / fix2) + SMALL)
        w -= pace * (m / fix1)
        w = np.sign(w) * np.maximum(np.abs(w) - pace * SPARSE, 0)
        bias -= RATE * (mb / fix1) / (np.sqrt(vb / fix2) + SMALL)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[common] = w
    return Model(weights, float(bias))


def _common(texts: DataFrame) -> np.ndarray:
    """Numbers of the features that enough texts share, and not too many clean ones; counted where the texts are.

    Neither bound depends on the share of toxic texts, which changes with the size of the labelled table.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]  # of clean and toxic texts
        for batch in rows:
            for i, label in enumerate(batch.column(2).to_pylist()):
                n[label] += 1
                for _, _, data, off in batches(batch.column(1).slice(i, 1)):
                    seen[label, np.unique(features(data, off)[0])] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(np.append(at, -1)), *(pa.array(np.append(seen[k, at], n[k])) for k in (0, 1))], names=["feature", "clean", "toxic"])

    counted = texts.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counted.toArrow()  # a row for each of 2**BITS features at most
    feature, clean, toxic = (found.column(k).to_numpy() for k in ("feature", "clean", "toxic"))
    every = int(clean[feature < 0].sum())
    keep = (feature >= 0) & (clean + toxic >= LEAST_TEXTS) & (clean <= max(2 * LEAST_TEXTS, MOST_SHARE * every))
    return np.sort(feature[keep])


def sample(docs: DataFrame, labels: DataFrame, name: str, bounds: dict[int, int], max_bytes: int = MAX_BYTES, longest: int = LONGEST) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of a bounded sample of the labelled texts, and the number of labelled ids of each class.

    An id that ``docs`` repeats gives its least text. Texts of more than ``longest`` bytes aren't drawn, and what is drawn is
    thinned by a hash of the ids to about ``max_bytes``.
    """
    known = labelled(labels, name)
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = [drawn(known.filter(F.col("label") == k), bound, n.get(k, 0), "toxic") for k, bound in bounds.items()]
    ids = F.broadcast(reduce(DataFrame.unionByName, some))  # bounded by the parameters
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    found = checkpointed(texts.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"))
    total = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > max_bytes:
        found = found.filter(F.pmod(F.xxhash64("doc_id", F.lit("thinned")), F.lit(1 << 30)) < int(max_bytes / total * (1 << 30)))
    return found, n


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the training folds of ``labels`` and the whole texts of a bounded sample of ``docs``.

    The driver gets the sample as numbers: the kinds of words once with their features, and a number of four bytes for each word.
    """
    texts, n = sample(docs, labels, "toxic", {1: POSITIVES, 0: NEGATIVES})
    none = np.zeros(0, dtype=np.int64)
    if not n.get(0) or not n.get(1):
        return fit(np.zeros((0, 1), dtype=np.int64), none, none, none, np.zeros(0), np.zeros(0), none)
    common = _common(texts)
    size = len(common)
    place = np.full(1 << BITS, size, dtype=np.int32)
    place[common] = np.arange(size, dtype=np.int32)

    def placed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """The words that have a learnt feature: keys, places of the features, sentences; and each sentence's text."""
        f, sentence, owner, _, _ = features(data, off)
        own = place[f]
        kept = (own < size).any(axis=1)
        own = own[kept]
        key = np.zeros(len(own), dtype=U)
        for k in range(own.shape[1]):
            key = mix(key * U(BASE2) + own[:, k].astype(U))
        return key.view(np.int64), own, sentence[kept], owner

    def kinds(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, _, data, off in batches(batch.column(1)):
                key, own, _, _ = placed(data, off)
                key, at = np.unique(key, return_index=True)
                yield pa.record_batch([pa.array(key), pa.array([r.tobytes() for r in own[at]], pa.binary())], names=["key", "kind"])

    def extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, (doc, label) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2)), strict=True)):
                for _, _, data, off in batches(batch.column(1).slice(i, 1)):
                    key, _, sentence, owner = placed(data, off)
                    at = np.searchsorted(keys, key).astype(np.int32)
                    starts = np.searchsorted(sentence, np.arange(len(owner))).astype(np.int32)
                    yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([label], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([starts.tobytes()], pa.binary())], names=["doc_id", "label", "words", "starts"])

    found = texts.mapInArrow(kinds, "key long, kind binary").groupBy("key").agg(F.first("kind").alias("kind")).toArrow()
    keys = found.column("key").to_numpy()
    order = np.argsort(keys)
    keys, columns = keys[order], unpacked(found.column("kind"), np.int32).reshape(-1, 1 + len(BEGINNINGS))[order]
    found = texts.mapInArrow(extract, "doc_id long, label int, words binary, starts binary").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")  # an id has one row
    label, parts = found.column("label").to_numpy(), {k: _pieces(found.column(k)) for k in ("words", "starts")}
    sizes, sentences = (np.array([len(parts[k][i]) for i in order], dtype=np.int64) for k in ("words", "starts"))
    none = np.zeros(0, dtype=np.int32)  # labels may have no text
    word = np.concatenate([none, *(parts["words"][i] for i in order)])
    starts = np.concatenate([none, *(parts["starts"][i] for i in order)]).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, sentences)
    y = label[order].astype(np.float64)
    weight = np.array([n[0], n[1]]) / np.maximum(np.bincount(label, minlength=2), 1)
    return fit(columns, word, starts, np.repeat(np.arange(len(y)), sentences), y, weight[label[order]], common)


def _pieces(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Views of the numbers of each row."""
    return [np.frombuffer(row.as_buffer(), dtype=np.int32) if row.as_buffer().size else np.zeros(0, np.int32) for row in column]


def _scores(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    f, sentence, owner, start, end = features(data, off)
    z = sentence_logits(model, f, sentence, len(owner)) if len(f) else np.zeros(0)
    return -np.expm1(-sums(_softplus(z), owner, len(off) - 1)), z, owner, start, end


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, of each whole text."""
    docs = docs.drop("score").withColumn("score", F.lit(0.0))
    at, n = docs.columns.index("text"), len(docs.columns) - 1

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [_scores(model, data, off)[0] for _, _, data, off in batches(batch.column(at))]
            yield pa.record_batch([*batch.columns[:n], pa.array(np.concatenate(found) if found else [], pa.float64())], names=batch.schema.names)

    return docs.mapInArrow(rate, docs.schema)


def sentences(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The offending sentences: doc_id, sentence number, score and text of each that reaches ``least`` by itself."""

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, _, data, off in batches(batch.column(1)):
                _, z, owner, start, end = _scores(model, data, off)
                p = 1 / (1 + np.exp(-np.maximum(z, -500)))
                hit = np.flatnonzero(p >= least)
                number = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
                texts = [data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in hit]
                yield pa.record_batch([batch.column(0).take(pa.array(owner[hit] + a)), pa.array(number[hit], pa.int32()), pa.array(p[hit]), pa.array(texts, pa.string())], names=["doc_id", "sentence", "score", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, sentence int, score double, text string")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts that the model rejects, columns unchanged."""
    rated = score(docs.select(F.struct("*").alias("row"), "text"), model)
    return rated.filter(F.col("score") < THRESHOLD).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
