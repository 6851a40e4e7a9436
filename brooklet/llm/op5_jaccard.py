"""Operator 5: similarity join of documents by the Jaccard index of their word 5-grams, by MinHash banding.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased; a text of fewer than five words, but
not none, is one n-gram. Two texts are linked if the index of their n-gram sets is at least ``THRESHOLD``.

1. Each text becomes the key of its set (a 64-bit hash of the whole set; texts with one key are copies) and a MinHash
   signature in bands. The number of rows of a band is a parameter; the number of bands follows from the target recall at the threshold.
2. A representative of each set goes, for each band, to the bucket of that band's hash (the shuffle). In a bucket, pairs are
   compared by sketches of ``SKETCH`` MinHash values of four bits: those whose estimate is not ``MARGIN`` standard errors below the threshold
   are joined into candidate groups, so that texts that are merely akin don't chain them (a pair at the threshold fails that with odds of 3e-7).
3. The texts of candidates are read again, and the pairs of a group are verified on the full sets, block by block
   (``_links``). Copies are counted by weight and never expanded into pairs.

Result: one row a document with ``class_id``, the smallest doc_id reachable by links, and ``n_links``, the number of other
documents linked directly, copies included.

Nulls and odd rows: a null, empty or wordless text is linked with nothing and is its own class; a row without doc_id has
class_id null unless its class has a document with one; rows that repeat a doc_id count each; other columns are
ignored by ``classes`` and kept by ``one_of_each``; an empty table gives no row. Two sets among n share a key with odds
of about n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._links import links, named
from brooklet.llm._text import BASE2, Hasher, U, batches, mix, windows, words
from brooklet.session import checkpointed, table

N, THRESHOLD = 5, 0.8
ROWS, RECALL = 8, 0.9998
SKETCH, MARGIN = 256, 5.0


def n_bands(threshold: float, rows: int, recall: float) -> int:
    """Bands for which a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, end to end in ascending order, and where each text's begin."""
    low, s, e, owner = words(data, off)
    h = Hasher(low).spans(s, e)
    count = np.bincount(owner, minlength=len(off) - 1)
    w = windows(h, n)
    at = np.flatnonzero(owner[: len(w)] == owner[n - 1 :]) if len(w) else np.zeros(0, np.int64)
    values, whose = w[at], owner[at]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = [windows(h[first[i] : first[i] + count[i]], int(count[i])) for i in short]
        values, whose = np.concatenate([values, *own]), np.concatenate([whose, short])
    order = np.lexsort((values, whose))
    values, whose = values[order], whose[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (whose[1:] != whose[:-1])
    return values[new], np.searchsorted(whose[new], np.arange(len(off)))


def keys(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ U(BASE2)), dtype=U)])
    size = np.diff(edges).astype(U)
    out = mix(total[edges[1:]] - total[edges[:-1]] + size * U(BASE2))
    out[out == 0] = 1
    out[size == 0] = 0
    return out


def signatures(values: np.ndarray, edges: np.ndarray, bands: int, rows: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (text, band) and sketches (text, byte) of the texts whose sets aren't empty."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
    salt = rng.integers(0, 1 << 63, bands * rows, dtype=U)
    starts = edges[:-1][edges[1:] > edges[:-1]]
    out = np.zeros((len(starts), bands), dtype=U)
    nibbles = np.zeros((len(starts), min(SKETCH, bands * rows // 2 * 2)), dtype=np.uint8)
    if not len(starts):
        return out, nibbles[:, ::2]
    v = np.empty_like(values)
    for k in range(bands * rows):
        np.multiply(values, factor[k], out=v)
        np.bitwise_xor(v, salt[k], out=v)
        least = mix(np.minimum.reduceat(v, starts))
        column = out[:, k // rows]
        column *= U(BASE2)
        column += least
        if k < nibbles.shape[1]:
            nibbles[:, k] = least & U(15)
    return mix(out + np.arange(bands, dtype=U)), nibbles[:, ::2] | nibbles[:, 1::2] << 4


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, bands, sketch, grams) of each document; key and sketch are null without words, ``grams`` counts the set."""

    def sketch(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, data, off in batches(batch.column(1)):
                values, edges = shingles(data, off, n)
                key = keys(values, edges)
                full = key != 0
                sign, sketched = signatures(values, edges, bands, rows)
                own = iter(sketched)
                at = np.zeros(len(key) + 1, dtype=np.int32)
                np.cumsum(full * bands, out=at[1:])
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sign.view(np.int64).ravel()))
                packed = pa.array([next(own).tobytes() if x else None for x in full], pa.binary())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(key.view(np.int64), mask=~full), lists, packed, pa.array(np.diff(edges), pa.int64())], names=["doc_id", "key", "bands", "sketch", "grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, key long, bands array<long>, sketch binary, grams long")


def akin(threshold: float):
    """A verifier of sketches: whether the estimated index isn't well below the threshold."""

    def verify(payloads: list[bytes]) -> np.ndarray:
        packed = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(len(payloads), -1)
        x = np.concatenate([packed & 15, packed >> 4], axis=1)
        n = x.shape[1]
        # Of two different values one in 16 is equal in its four bits.
        least = (threshold + (1 - threshold) / 16) * n - MARGIN * np.sqrt(n * threshold * (1 - threshold))
        out = np.empty((len(x), len(x)), dtype=bool)
        for i in range(len(x)):
            out[i] = np.count_nonzero(x == x[i], axis=1) >= least
        return out

    return verify


def similar(threshold: float):
    """A verifier of n-gram sets, packed as sorted 64-bit hashes."""

    def verify(payloads: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, dtype=U) for p in payloads]
        size = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = values[1:] != values[:-1]
        column = np.cumsum(new) - 1
        several = np.bincount(column) > 1
        keep = several[column]
        owner, column = owner[keep], (np.cumsum(several) - 1)[column[keep]]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        step = 8192
        edges = np.searchsorted(column, np.arange(0, int(several.sum()) + step, step))
        for i in range(len(edges) - 1):
            part = np.zeros((len(sets), step), dtype=np.float32)
            part[owner[edges[i] : edges[i + 1]], column[edges[i] : edges[i + 1]] - i * step] = 1
            both += part @ part.T
        both = both.astype(np.float64)
        return both / np.maximum(size[:, None] + size[None] - both, 1) >= threshold

    return verify


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, weight, payload): the sets of the documents (doc_id, node, weight) in ``wanted``."""

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, data, off in batches(batch.column(0)):
                values, edges = shingles(data, off, n)
                node = batch.column(1).slice(a, b - a)
                same = np.flatnonzero(keys(values, edges).view(np.int64) == node.to_numpy())
                sets = [values[edges[i] : edges[i + 1]].tobytes() for i in same]
                at = pa.array(same)
                yield pa.record_batch([node.take(at), batch.column(2).slice(a, b - a).take(at), pa.array(sets, pa.binary())], names=["node", "weight", "payload"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    joined = texts.join(wanted, texts["id"].eqNullSafe(wanted["doc_id"])).select("text", "node", "weight")
    return joined.mapInArrow(pack, "node long, weight long, payload binary")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, key, class_id, n_links of each document."""
    sketched = checkpointed(sketches(docs, n, n_bands(threshold, rows, recall), rows))
    some = sketched.filter(F.col("key").isNotNull())
    sets = checkpointed(some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), F.min("sketch").alias("sketch"), (8 * F.min("grams")).alias("bytes")))
    # Copies have the same bands: partial aggregation drops them before the shuffle.
    buckets = some.select(F.col("key").alias("node"), F.explode("bands").alias("bucket")).groupBy("bucket", "node").agg(F.count("*").alias("c")).select("bucket", "node")
    groups = links(buckets, sets.select(F.col("key").alias("node"), "weight", F.col("sketch").alias("payload")), akin(threshold)).select("node", F.col("component").alias("bucket"))
    groups = checkpointed(groups)
    wanted = groups.select(F.col("node").alias("key")).join(sets, "key").select("doc_id", F.col("key").alias("node"), "weight")
    groups = groups.join(sets.select(F.col("key").alias("node"), "bytes"), "node")
    linked = links(groups, _sets(docs, wanted, n), similar(threshold))
    nodes = sets.join(linked.withColumnRenamed("node", "key"), "key", "left")
    nodes = nodes.select("key", "doc_id", F.coalesce("component", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = named(nodes, "doc_id").select("key", F.col("name").alias("class_id"), "n_links")
    own = sketched.filter(F.col("key").isNull()).select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.select("doc_id", "key").join(known, "key").select("doc_id", "key", "class_id", "n_links").unionByName(own)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, columns unchanged: the one with the smallest doc_id (of rows alike in id and text, any
    one). Texts without words all stay; a class without any doc_id loses all but one of its rows."""
    n = how.get("n", N)
    found = classes(docs, **how)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    gone = found.filter(F.col("key").isNotNull())
    # A class without any doc_id is named by its sets' keys instead.
    gone = gone.withColumn("class", F.when(F.col("class_id").isNull(), F.concat(F.lit("k"), F.col("key"))).otherwise(F.col("class_id").cast("string")))
    kept = gone.groupBy("class").agg(F.min(first).alias("f")).select("f.doc_id", "f.key").withColumn("keep", F.lit(True))
    repeats = gone.groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    kept = kept.join(repeats, kept["doc_id"].eqNullSafe(repeats["doc_id"]) & (kept["key"] == repeats["key"])).select(kept["doc_id"].alias("keep_id"), kept["key"].alias("keep_key"), "rows")
    kept = checkpointed(kept)

    def tag(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [keys(*shingles(data, off, n)).view(np.int64) for _, _, data, off in batches(batch.column("text"))]
            key = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column("row"), batch.column("text"), pa.array(key)], names=["row", "text", "key"])

    wrapped = docs.select(F.struct("*").alias("row"), "text", F.lit(0).cast("long").alias("key"))
    tagged = wrapped.mapInArrow(tag, wrapped.schema).select("row", "key")
    none = tagged.filter("key = 0").select("row.*")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    chosen = tagged.filter("key <> 0").join(kept, same)
    single = chosen.filter("rows = 1").select("row.*")
    several = chosen.filter("rows > 1").dropDuplicates(["keep_id", "keep_key"]).select("row.*")
    return single.unionByName(several).unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
s AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
pairs AS MATERIALIZED (
  SELECT x.rid AS a, y.rid AS b FROM g x JOIN g y ON x.gram = y.gram AND x.rid <> y.rid JOIN s sx ON sx.rid = x.rid JOIN s sy ON sy.rid = y.rid
  GROUP BY x.rid, y.rid, sx.n, sy.n HAVING count(*)::DOUBLE / (sx.n + sy.n - count(*)) >= 0.8),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other)
SELECT d.doc_id, min(o.doc_id) AS class_id, (SELECT count(*) FROM pairs WHERE pairs.a = d.rid) AS n_links
FROM d JOIN reach ON reach.rid = d.rid JOIN d o ON o.rid = reach.other GROUP BY d.rid, d.doc_id
"""
