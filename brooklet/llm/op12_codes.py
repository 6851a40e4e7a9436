"""Operator 12: vectors as short codes, by the filtering form of Lloyd's algorithm on kd-trees, exact in whole numbers.

Components become whole numbers floor(scale * x); a vector is cut into ``parts`` equal consecutive parts, and each part position has a
codebook, which starts as that part of the vectors with the smallest vec_id. Each round assigns every part to the nearest entry (of equals
the lower one) and replaces each entry that has parts by floor(sum / count) of each component; unused entries stay.

Every partition cuts its vectors into blocks and builds a kd-tree over the parts of each position of a block: boxes, sums and
counts of all nodes, written to the shared folder once. A round goes down the trees: of the entries that a node still has, those go that for the
whole box aren't nearer than the one nearest to its middle; if one entry is left, the node's sum and count are its as a whole, else the
node's halves are looked at, at last the parts of a leaf. Only sums and counts of entries come to the driver, and only codebooks go out.

Nulls and odd rows: vectors that are null or have a null or non-finite component give no row; ``code`` and ``error`` are null for a vector
that has another length than the one with the smallest vec_id, or whose length the parts don't divide; rows with equal vec_id count each; a null
vec_id stays null and comes after all others in the first codebook, equals in the order of their components; with fewer vectors than ``entries``
a codebook has as many entries as vectors; vectors of no component have code 0 in every part; sums beyond a long are null, and so is the
``label_error`` of a label with a vector without error; labels are equal if they read the same as text; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._links import met
from brooklet.llm._whole import PARTIAL, Sums, floors, kept, longs, means, narrow, removed, summed, texts, totals, vectors
from brooklet.session import shared_dir, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most, bytes of its components, parts of a leaf at most.
BLOCK, BLOCK_BYTES, LEAF = 4096, 1 << 23, 16


class Tree:
    """A kd-tree: the order of its points, and for each level the edges, boxes and sums of its nodes; node i has the halves 2i and 2i + 1."""

    def __init__(self, x: np.ndarray):
        order, edges = np.arange(len(x)), np.array([0, len(x)])
        self.edges = [edges]
        rough = np.clip(x, -(10**300), 10**300).astype(np.float64) if x.dtype == object else x.astype(np.float64)
        while np.diff(edges).max() > LEAF:
            starts = edges[:-1]
            wide = (np.maximum.reduceat(rough[order], starts) - np.minimum.reduceat(rough[order], starts)).argmax(axis=1)
            node = np.repeat(np.arange(len(starts)), np.diff(edges))
            order = order[np.lexsort((rough[order, wide[node]], node))]
            edges = np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
            self.edges.append(edges)
        self.order = order
        x = x[order]
        self.low, self.high, self.sums = ([f.reduceat(x, e[:-1]) for e in self.edges] for f in (np.minimum, np.maximum, np.add))

    def nearest(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The entry of each point, the sums and counts of the entries, and how many points were compared one by one."""
        m, dtype = len(entries), np.result_type(x, entries)
        owner, sums, count = np.zeros(len(x), dtype=np.int64), np.zeros((m, x.shape[1]), dtype=dtype), np.zeros(m, dtype=np.int64)
        nodes, left = np.array([0]), np.ones((1, m), dtype=bool)
        for level, edges in enumerate(self.edges):
            left = _not_worse(self.low[level][nodes], self.high[level][nodes], entries, left)
            one = left.sum(axis=1) == 1
            whole, entry = nodes[one], left[one].argmax(axis=1)
            np.add.at(sums, entry, self.sums[level][whole])
            size = edges[whole + 1] - edges[whole]
            np.add.at(count, entry, size)
            owner[_ranges(edges[whole], size)] = np.repeat(entry, size)
            nodes, left = nodes[~one], left[~one]
            if level < len(self.edges) - 1:
                nodes, left = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(left, 2, axis=0)
        size = self.edges[-1][nodes + 1] - self.edges[-1][nodes]
        single = _ranges(self.edges[-1][nodes], size)
        if len(single):
            points = x[self.order[single]]
            owner[single] = _least(((points[:, None] - entries) ** 2).sum(axis=2), np.repeat(left, size, axis=0))
            np.add.at(sums, owner[single], points)
            np.add.at(count, owner[single], 1)
        out = np.empty_like(owner)
        out[self.order] = owner
        return out, sums, count, len(single)


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


def _least(d: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each row the first of the smallest that are left."""
    if not len(d):
        return np.zeros(0, dtype=np.int64)
    return np.where(left, d, d.max() + 1).argmin(axis=1)


def _not_worse(low: np.ndarray, high: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which of the entries ``left`` may be the nearest of some point in each box, of equals the first.

    An entry goes if at the corner that is best for it the one nearest to the box's middle is nearer still, or as near and comes first.
    """
    middle = _least((((low + high)[:, None] - 2 * entries) ** 2).sum(axis=2), left)
    towards = entries - entries[middle][:, None]
    corner = np.where(towards > 0, high[:, None], low[:, None])
    lead = (towards * (entries + entries[middle][:, None] - 2 * corner)).sum(axis=2)  # squared distance beyond that of the middle's entry
    number = np.arange(len(entries))
    return left & ((lead < 0) | ((lead == 0) & (number <= middle[:, None])) | (number == middle[:, None]))


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [narrow(p) for p in np.split(x, parts, axis=1)]


def blocks(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """Rows (vec_id, embedding, label) as blocks (vec_ids, labels, trees): a block's parts and their trees."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    fields = dict(rows.dtypes)

    def packed(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(found).combine_chunks()
        flat, start, _ = vectors(both.column("embedding"))
        own = [(p, Tree(p)) for p in _split(floors(flat[start[:, None] + np.arange(width)], scale), parts)]
        lists = [pa.ListArray.from_arrays(pa.array([0, both.num_rows], pa.int32()), both.column(c).combine_chunks()) for c in ("vec_id", "label")]
        return pa.record_batch([*lists, pa.array([pickle.dumps(own)], pa.binary())], names=["vec_ids", "labels", "trees"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, size - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
                if sum(b.num_rows for b in held) == size:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return rows.select("vec_id", "embedding", "label").mapInArrow(build, f"vec_ids array<long>, labels array<{fields['label']}>, trees binary")


def round_sums(built: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Sums and counts of the entries (slot: part times the entries of a codebook, plus the entry), a row for each task."""
    m = len(books[0])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums()
        for batch in batches:
            for trees in batch.column(0):
                for p, (x, tree) in enumerate(pickle.loads(trees.as_py())):
                    _, sums, count, _ = tree.nearest(x, books[p])
                    for e in np.flatnonzero(count).tolist():
                        total.add(p * m + e, int(count[e]), sums[e])
        yield total.batch()

    return built.select("trees").mapInArrow(step, PARTIAL)


def assigned(built: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    """vec_id, label, code, error of the vectors of the blocks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, trees in enumerate(batch.column(2)):
                own = pickle.loads(trees.as_py())
                codes = [tree.nearest(x, books[p])[0] for p, (x, tree) in enumerate(own)]
                error = sum(((x - books[p][code]) ** 2).sum(axis=1) for p, ((x, _), code) in enumerate(zip(own, codes, strict=True)))
                packed = np.stack(codes, axis=1).astype(np.uint8)
                ids, labels = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                yield pa.record_batch([ids, labels, pa.array([c.tobytes().hex() for c in packed], pa.string()), longs(error)], names=["vec_id", "label", "code", "error"])

    return built.select("vec_ids", "labels", "trees").mapInArrow(step, f"vec_id long, label {label_type}, code string, error long")


def compressed(vecs: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each kept vector; a codebook has at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    spark, rows = vecs.sparkSession, kept(vecs)
    label_type = dict(rows.dtypes)["label"]
    order = (F.col("vec_id").asc_nulls_last(), "embedding")
    least = rows.orderBy(*order).limit(1).select(F.size("embedding").alias("n")).first()
    width = least["n"] if least else 0
    fits = rows.filter(F.size("embedding") == width) if width and width % parts == 0 else rows.filter("false")
    first = fits.orderBy(*order).limit(entries).select("embedding").collect()
    books = _split(floors(np.array([r["embedding"] for r in first]), scale), parts) if first else []
    folder = f"{shared_dir(spark)}/op12-{uuid.uuid4().hex}"
    plain = rows.filter(F.size("embedding") != width) if books else rows
    zero = F.lit("00" * parts) if width == 0 and least else F.lit(None).cast("string")
    empty = F.size("embedding") == 0
    coded = plain.select("vec_id", "label", F.when(empty, zero).alias("code"), F.when(empty & zero.isNotNull(), F.lit(0)).cast("long").alias("error"))
    if books:
        blocks(fits, width, parts, scale).write.parquet(f"{folder}/blocks")
        built = spark.read.schema(f"vec_ids array<long>, labels array<{label_type}>, trees binary").parquet(f"{folder}/blocks")
        n = built.select(F.lit(1).alias("one")).count() * parts * len(books[0])
        for _ in range(rounds):
            sums = totals(round_sums(built, books), n)
            books = [means(book, sums, p * len(book)) for p, book in enumerate(books)]
        coded = assigned(built, books, label_type).unionByName(coded)
    coded.write.parquet(f"{folder}/codes")
    coded = spark.read.schema(coded.schema).parquet(f"{folder}/codes")
    removed(spark, f"{folder}/blocks")
    digest = hashlib.sha256(",".join(v for book in books for entry in book for v in texts(entry)).encode()).hexdigest()
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    per = coded.groupBy("key").agg(summed("error").alias("label_error"), F.count("*").alias("n"))
    return met(coded, per, "key", coded.count()).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).drop("label")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL for vectors of one length: every distance of every round."""
    ctes = [
        f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id::BIGINT AS vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
q AS MATERIALIZED (SELECT rid, vec_id, label, e, list_transform(e, lambda x: floor({scale} * x)::BIGINT) AS x FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM q, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, e) - 1 AS c, p.x FROM p JOIN q USING (rid) QUALIFY c < {entries})"""
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, part, any_value(x) AS x, min(m) AS m FROM (
  SELECT p.rid, p.part, p.x, {{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT)), 'c': b.c}} AS m FROM p JOIN b{r} b ON b.part = p.part) GROUP BY rid, part)"""
        )
        if r < rounds:
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.c, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
  SELECT part, c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (
    SELECT part, a.m.c AS c, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT part, m, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) a GROUP BY 1, 2, 3) GROUP BY part, c) m ON m.part = b.part AND m.c = b.c)"""
            )
    return (
        ",\n".join(ctes)
        + f""",
e AS (SELECT rid, string_agg(lower(printf('%02x', m.c::INTEGER)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(x, ','), ',' ORDER BY part, c) FROM b{rounds})) AS codebooks_sha256
FROM q JOIN e USING (rid)"""
    )
