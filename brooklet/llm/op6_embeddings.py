"""Operator 6: near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are compared only within a label. A vector is normalised, projected on random Gaussian directions, shifted by a random
offset and quantised: a table's bucket is the tuple of several such numbers. At cosine c two unit vectors lie
sqrt(2 - 2c) apart, from which the chance of one equal number follows in closed form; the number of tables is chosen for the
target recall at the threshold. The number of hashes is the one of least work by a bounded sample of vectors (``SAMPLE``): more hashes
take more tables and leave fewer vectors in a bucket that aren't close. The pairs of a bucket are verified by
exact cosine in double precision, block by block (``_links``); equal vectors count by weight.

Result: one row a vector: ``n_links`` (other vectors linked directly), ``component_id`` (smallest vec_id reachable by links, itself
included) and ``kept`` (whether the two ids are equal).

Nulls and odd rows: a vector that is null, empty, zero or has a null or non-finite component, or whose label is null, is
linked with nothing, and is its own component; vectors of different lengths are never linked; rows that repeat a vec_id count
each; a null vec_id has component_id null unless its component has an id, and is then not kept; other columns are ignored;
an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._links import links, named
from brooklet.llm._text import BASE2, Hasher, U, mix
from brooklet.session import checkpointed, table

COSINE = 0.98
WIDTH, RECALL = 1.6, 0.9998
#: Numbers of hashes to choose from, vectors looked at for the choice, and the work of one bucket's row in compared vectors.
HASHES, SAMPLE, ROW = range(4, 33), 600, 4
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def collision(distance: float, width: float) -> float:
    """The chance that one quantised projection is equal for two points so far apart."""
    if distance == 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def n_tables(cosine: float, hashes: int, width: float, recall: float) -> int:
    """Tables for which a pair at the threshold shares a bucket with probability ``recall``."""
    p = collision(math.sqrt(2 - 2 * cosine), width) ** hashes
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def least_work(distances: np.ndarray, largest: int, cosine: float, width: float, recall: float) -> int:
    """The number of hashes for which a vector's rows and the vectors that share its buckets by chance are least.

    ``distances``: of pairs of one label that aren't linked; ``largest``: vectors of the largest label.
    """

    def work(k: int) -> float:
        chance = np.mean([collision(d, width) ** k for d in distances]) if len(distances) else 0.0
        return n_tables(cosine, k, width, recall) * (ROW + largest * chance)

    return min(HASHES, key=work)


def choose(vectors: DataFrame, cosine: float, width: float, recall: float) -> int:
    """``least_work`` for a table of (vec_id, embedding, label), by about ``SAMPLE`` of its vectors."""
    known = vectors.filter("label IS NOT NULL AND size(embedding) > 0")
    of_label = known.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, n = of_label[0] or 0, of_label[1] or 0
    few = known.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    rows = few.select("label", "embedding").distinct().limit(2 * SAMPLE).collect()  # the sample's bound, if the hash were uneven
    found = []
    for pick in ({r["label"] for r in rows}, (None,)):  # pairs of one label, or else of any
        for label in pick:
            same = [r["embedding"] for r in rows if label is None or r["label"] == label]
            for d in {len(x) for x in same}:
                x = np.array([[np.nan if c is None else c for c in v] for v in same if len(v) == d], dtype=np.float64)
                x = x[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)]
                x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
                x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
                c = (x @ x.T)[np.triu_indices(len(x), 1)]
                found += np.sqrt(np.maximum(2 - 2 * c[c < cosine], 0)).tolist()
        if len(found) >= 100:
            break
    return least_work(np.quantile(found, np.linspace(0, 1, 1001)) if len(found) > 1001 else np.array(found), largest, cosine, width, recall)


def _sketch(vectors: np.ndarray, labels: np.ndarray, tables: int, hashes: int, width: float, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Key of each (label, vector) and its buckets (vector, table)."""
    d = vectors.shape[1]
    rng = np.random.default_rng([seed, d])
    directions, offsets = rng.standard_normal((d, tables * hashes)), rng.random(tables * hashes) * width
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ directions + offsets) / width).astype(np.int64).view(U).reshape(-1, tables, hashes)
    salt = mix(labels.astype(np.int64).view(U) * U(BASE2) + U(d))
    bucket = np.zeros(cells.shape[:2], dtype=U)
    for k in range(hashes):
        bucket = mix(bucket * U(BASE2) + cells[:, :, k])
    bucket = mix(bucket + salt[:, None] + np.arange(tables, dtype=U) * U(BASE2))
    raw = np.ascontiguousarray(vectors).view(np.uint8).reshape(-1)
    at = np.arange(len(vectors)) * vectors.shape[1] * vectors.itemsize
    return mix(Hasher(raw).spans(at, at + d * vectors.itemsize) + salt), bucket


def sketches(vectors: DataFrame, tables: int, hashes: int, width: float) -> DataFrame:
    """vec_id, key, buckets and payload (label and components) of each vector; key is null where it can link with nothing."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists, label = batch.column(1), batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat, start = lists.values, lists.offsets.to_numpy()
            numbers = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            usable = np.array(lists.is_valid()) & np.array(label.is_valid()) & (size > 0)
            labels = label.fill_null(0).to_numpy()
            key, payload = np.zeros(len(size), U), np.empty(len(size), object)
            buckets: list[np.ndarray | None] = [None] * len(size)
            for d in np.unique(size[usable]):
                at = np.flatnonzero(usable & (size == d))
                x = numbers[start[at][:, None] + np.arange(d)] + 0.0  # -0.0 becomes 0.0
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[good], x[good]
                # Scaled by its largest component, so that no square overflows or vanishes.
                own, bucket = _sketch(x / np.abs(x).max(axis=1, keepdims=True), labels[at], tables, hashes, width)
                key[at] = np.maximum(own, U(1))
                for i, j in enumerate(at):
                    buckets[j], payload[j] = bucket[i].view(np.int64), labels[j].tobytes() + x[i].tobytes()
            yield pa.record_batch([batch.column(0), pa.array(key.view(np.int64), mask=key == 0), pa.array(buckets, pa.list_(pa.int64())), pa.array(payload, pa.binary())], names=["vec_id", "key", "buckets", "payload"])

    return picked(vectors).mapInArrow(work, "vec_id long, key long, buckets array<long>, payload binary")


def picked(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label in one form; labels that are no whole numbers are told apart by a 64-bit hash."""
    label = F.col("label").cast("long") if dict(vectors.dtypes)["label"] in _WHOLE else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))


def close(cosine: float):
    """A verifier of vectors, packed as a label and doubles: cosine in double precision, equal labels and lengths."""

    def verify(payloads: list[bytes]) -> np.ndarray:
        length = np.array([len(p) // 8 - 1 for p in payloads])
        label = np.array([np.frombuffer(p, dtype=np.int64, count=1)[0] for p in payloads])
        x = np.zeros((len(payloads), length.max()))
        for i, p in enumerate(payloads):
            x[i, : length[i]] = np.frombuffer(p, offset=8)
        x /= np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        # A hash of buckets may coincide for two labels or lengths; those never link.
        return (unit @ unit.T >= cosine) & (length[:, None] == length[None]) & (label[:, None] == label[None])

    return verify


def components_of(vectors: DataFrame, cosine: float = COSINE, hashes: int | None = None, width: float = WIDTH, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector; ``hashes`` is chosen by a sample where it isn't given."""
    hashes = hashes or choose(picked(vectors), cosine, width, recall)
    sketched = checkpointed(sketches(vectors, n_tables(cosine, hashes, width, recall), hashes, width))
    some = sketched.filter(F.col("key").isNotNull())
    distinct = some.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.min("payload").alias("payload"))
    buckets = some.select(F.col("key").alias("node"), F.explode("buckets").alias("bucket")).groupBy("bucket", "node").agg(F.count("*").alias("c")).select("bucket", "node")
    found = links(buckets, distinct.select(F.col("key").alias("node"), "weight", "payload"), close(cosine))
    nodes = distinct.join(found.withColumnRenamed("node", "key"), "key", "left")
    nodes = nodes.select("key", "least", F.coalesce("component", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = named(nodes, "least").select("key", F.col("name").alias("component_id"), "n_links")
    own = sketched.filter(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = some.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id").unionByName(own)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(rid, other) AS (SELECT rid, rid FROM v UNION SELECT reach.rid, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other)
SELECT v.vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = v.rid) AS n_links, min(o.vec_id) AS component_id, coalesce(v.vec_id = min(o.vec_id), false) AS kept
FROM v JOIN reach ON reach.rid = v.rid JOIN v o ON o.rid = reach.other GROUP BY v.rid, v.vec_id
"""
