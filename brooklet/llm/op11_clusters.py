"""Operator 11: k-means of vectors by Elkan's bounds, exact in whole numbers.

Vectors of ``width`` finite components become whole numbers floor(scale * x). The first centroids are the vectors with the smallest
SHA-256 of ``salt`` and vec_id; each round assigns every vector to its nearest centroid (of equals the smaller number) and replaces every
centroid that has vectors by floor(sum / count) of each component.

A vector's row keeps its cluster, an upper bound of its distance to that centroid and a lower bound of its distance to each
centroid. When centroids move, bounds move by the length of the move. A centroid is looked at only if neither the lower bound nor half the
distance between the two centroids lies strictly above the upper bound, so a tie is always looked at; distances are then compared as
exact whole numbers. Bounds are rounded away from the truth (``up``, ``down``), so they hold in spite of floating point.

Rows are written to the shared folder in each round, along with a row for each task and cluster with sums and counts; only totals of
clusters come to the driver, and only centroids go out. A lost executor's part is computed again from the rows of the round before.

Nulls and odd rows: vectors that are null, have another number of components, or a null or non-finite one give no row; rows with equal
vec_id count each; a null vec_id stays null and comes after all others as a first centroid, equals in the order of their components; with fewer
than ``k`` vectors there are as many centroids as vectors; sums of distances beyond a long, and a distance beyond it, are null; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._whole import Sums, floors, kept, longs, means, removed, summed, texts, totals, vectors
from brooklet.session import shared_dir, table

K, ROUNDS, WIDTH, SCALE, SALT = 8, 10, 64, 1024, "3:"
#: More than what rounding can do to a root of a whole number, or to a sum of two numbers.
SLACK = 2.0**-50


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - y
    return (d * d).sum(axis=-1)


#: A whole number with more bits has a root that is only known to be above this one's.
_BITS = 1000


def roots(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the roots of whole numbers, from below and from above."""
    if d.dtype != object:
        r = np.sqrt(d.astype(np.float64))
        return down(r), up(r)
    low = np.array([math.sqrt(min(int(v), 1 << _BITS)) for v in d.ravel()]).reshape(d.shape)
    high = np.array([math.sqrt(v) if int(v).bit_length() <= _BITS else math.inf for v in d.ravel()]).reshape(d.shape)
    return down(low), up(high)


@dataclass
class Centroids:
    """Centroids of a round, half the distances between them from below, and how far each has moved from the round before, from above."""

    x: np.ndarray
    half: np.ndarray
    nearest: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        half = np.array([roots(squares(x, c))[0] for c in x]).reshape(len(x), len(x)) / 2
        apart = np.where(np.eye(len(x), dtype=bool), math.inf, half)
        moved = np.zeros(len(x)) if before is None else roots(squares(x, before))[1]
        return cls(x, half, apart.min(axis=1) if len(x) else np.zeros(0), moved)


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector and its bounds, from those of the round before; and how many distances were computed."""
    cluster, upper, lower = cluster.copy(), up(upper + c.moved[cluster]), np.maximum(down(lower - c.moved), 0)
    own = np.zeros(len(x), dtype=np.result_type(x, c.x))  # exact, where ``exact``
    exact = np.zeros(len(x), dtype=bool)
    open_ = upper >= c.nearest[cluster]
    count = 0
    for j in range(len(c.x)):
        rows = np.flatnonzero(open_ & (cluster != j) & (upper >= lower[:, j]) & (upper >= c.half[cluster, j]))
        loose = rows[~exact[rows]]
        if len(loose):
            own[loose] = squares(x[loose], c.x[cluster[loose]])
            lower[loose, cluster[loose]], upper[loose] = roots(own[loose])
            exact[loose] = True
            count += len(loose)
            rows = rows[(upper[rows] >= lower[rows, j]) & (upper[rows] >= c.half[cluster[rows], j])]
        if not len(rows):
            continue
        d = squares(x[rows], c.x[j])
        count += len(rows)
        low, high = roots(d)
        lower[rows, j] = low
        better = (d < own[rows]) | ((d == own[rows]) & (j < cluster[rows]))
        won = rows[better]
        cluster[won], own[won], upper[won] = j, d[better], high[better]
    return cluster, upper, lower, count


_STATE = "vec_id long, grid array<double>, cluster int, upper double, lower array<double>, computed long, slot int, n long, sums array<string>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("grid", pa.list_(pa.float64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("computed", pa.int64()), ("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    flat, start, _ = vectors(column)
    return flat[start[:, None] + np.arange(width)]


def _round(state: DataFrame, c: Centroids, scale: int, first: bool) -> DataFrame:
    """The rows after one assignment, and a row for each task and cluster with its sums; ``first``: without bounds yet."""
    k, width = c.x.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, computed = Sums(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = floors(_rows(batch.column(1), width), scale)
            if first:
                bounds = np.zeros(n, dtype=np.int64), np.full(n, math.inf), np.zeros((n, k))
                # On the grid, what was quantised once gives the same whole numbers again, and there are few different ones to store.
                grid = batch.column(1) if x.dtype == object else _lists(x / scale)
            else:
                bounds = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(zero_copy_only=False), _rows(batch.column(4), k)
                grid = batch.column(1)
            cluster, upper, lower, count = assign(x, c, *bounds)
            computed += count
            for j in np.unique(cluster).tolist():
                own = x[cluster == j]
                sums.add(j, len(own), own.sum(axis=0))
            none = [pa.nulls(n, t) for t in _ARROW.types[5:]]
            yield pa.record_batch([batch.column(0), grid, pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower), *none], schema=_ARROW)
        part = sums.batch()
        m = part.num_rows
        if m:
            yield pa.record_batch([*(pa.nulls(m, t) for t in _ARROW.types[:5]), pa.array([computed] + [0] * (m - 1), pa.int64()), *part.columns], schema=_ARROW)

    return state.select("vec_id", "grid", "cluster", "upper", "lower").mapInArrow(step, _STATE)


def _first(rows: DataFrame, k: int, scale: int, salt: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    found = rows.orderBy(order, "grid").limit(k).select("grid").collect()
    return floors(np.array([r["grid"] for r in found]), scale)


def clusters(vecs: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = SALT, log: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector. ``log`` gets the number of distances of each round."""
    spark = vecs.sparkSession
    rows = kept(vecs).filter(F.size("embedding") == width).select("vec_id", F.col("embedding").alias("grid"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("upper"), F.lit(None).cast("array<double>").alias("lower"))
    now = _first(rows, k, scale, salt)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(now):
        return spark.createDataFrame([], out)
    folder, state, c = f"{shared_dir(spark)}/op11-{uuid.uuid4().hex}", rows, Centroids.of(now)
    for r in range(rounds + 1):
        _round(state, c, scale, r == 0).write.parquet(f"{folder}/{r}")
        if r:
            removed(spark, f"{folder}/{r - 1}")
        written = spark.read.schema(_STATE).parquet(f"{folder}/{r}")
        state, parts = written.filter("slot IS NULL"), written.filter("slot IS NOT NULL")
        if log is not None:
            log.append(parts.agg(F.sum("computed")).first()[0] or 0)
        if r < rounds:
            sums = totals(parts.select("slot", "n", "sums"), parts.count())
            c = Centroids.of(means(c.x, sums), c.x)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(1), longs(squares(floors(_rows(batch.column(2), width), scale), c.x[cluster]))], names=["vec_id", "cluster", "distance"])

    measured = state.select("vec_id", "cluster", "grid").mapInArrow(measure, "vec_id long, cluster int, distance long")
    measured.write.parquet(f"{folder}/distances")
    measured = spark.read.schema("vec_id long, cluster int, distance long").parquet(f"{folder}/distances")
    removed(spark, f"{folder}/{rounds}")
    per = {r["cluster"]: r["d"] for r in measured.groupBy("cluster").agg(summed("distance").alias("d")).collect()}
    total = None if None in per.values() or sum(per.values()) >= 1 << 63 else sum(per.values())
    digests = [hashlib.sha256(",".join(texts(v)).encode()).hexdigest() for v in c.x]
    known = spark.createDataFrame([(j, per[j], total, digests[j]) for j in sorted(per)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = SALT) -> str:
    """The same in SQL: every distance of every round."""
    parts = [
        f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS MATERIALIZED (SELECT rid, vec_id, list_transform(e, lambda x: floor({scale} * x)::BIGINT) AS x FROM v
  WHERE len(e) = {width} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, x) - 1 AS c, x FROM q QUALIFY c < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min(p) AS p FROM (
  SELECT q.rid, q.vec_id, q.x, {{'d': list_sum(list_transform(list_zip(q.x, c.x), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT)), 'c': c.c}} AS p FROM q, c{r} c) GROUP BY rid)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (
    SELECT p.c AS c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY 1, 2) GROUP BY c) m ON m.c = c.c)"""
            )
    return (
        ",\n".join(parts)
        + f"""
SELECT a.vec_id, a.p.c::INTEGER AS cluster, a.p.d::BIGINT AS distance, (sum(a.p.d) OVER (PARTITION BY a.p.c))::BIGINT AS cluster_inertia,
  (sum(a.p.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.p.c"""
    )
