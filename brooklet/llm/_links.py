"""Links between rows that share a bucket: block-wise verification inside each bucket, connected components of the links.

No step makes a row for each pair. A bucket is cut into blocks of about ``BLOCK`` rows, and each pair of blocks is one unit of
work, so that a bucket that holds a third of all rows is spread over many tasks. A unit compares all its rows at once and returns
a row for each of them that is linked: its number of links and a row that it hangs together with. Buckets of the same members are
verified once, and a pair that shares several buckets is counted in the first of them only. Components are those of verified links.

A join whose keys may be frequent leaves the rows of the frequent keys where they are: keys with more than one in ``HEAVY`` of all rows
are less than ``HEAVY`` in number, hence broadcast (``met``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.session import checkpointed

BLOCK = 256
#: Bytes of payloads of a block, about, where they are known.
BLOCK_BYTES = 1 << 24
HEAVY = 1000
#: Rows of two or three numbers that make a task of their own; fewer tasks than the shuffle has partitions write fewer small files.
TASK_ROWS = 1 << 18
#: verify(payloads) -> symmetric boolean matrix of links.
Verify = Callable[[list[bytes]], np.ndarray]


def met(rows: DataFrame, by: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` to ``by``, which has a row for each key and in ``n`` how many of the ``total`` rows joined have it."""
    by, often = checkpointed(_few(by, total)), F.col("n") > total // HEAVY
    if not by.filter(often).take(1):
        return rows.join(by.drop("n"), key)
    heavy = by.filter(often).drop("n")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(by.filter(~often).drop("n"), key))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most so many small rows, in as many partitions as they need."""
    return df.coalesce(1 + rows // TASK_ROWS)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: each node hangs its larger neighbours, then its smaller ones, on the
    smallest of its neighbourhood. Only a count and a checksum of the edges come to the driver.
    """
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _few(met(both, low, "a", 2 * state[0]), 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(_few(large, state[0]))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _few(met(large, least, "a", state[0]), 2 * state[0])
        e = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = checkpointed(_few(e.distinct(), 2 * state[0]))
        before, state = state, _state(e)
        if before == state:
            break
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it hangs together with."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.zeros(len(linked), dtype=bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = linked[front].any(axis=0) & (root < 0)
    return root


def _shared_before(bucket: int, mine: list[np.ndarray]) -> np.ndarray | None:
    """Which pairs share a bucket below ``bucket``; None where no row is in one."""
    below = [m[: np.searchsorted(m, bucket)] for m in mine]
    size = np.array([len(m) for m in below])
    if np.count_nonzero(size) < 2:
        return None
    values, column, count = np.unique(np.concatenate(below), return_inverse=True, return_counts=True)
    several = count > 1
    held = several[column]
    inside = np.zeros((len(mine), int(several.sum())), dtype=np.float32)
    inside[np.repeat(np.arange(len(mine)), size)[held], (np.cumsum(several) - 1)[column[held]]] = 1
    return inside @ inside.T > 0


_OUT = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _unit(bucket: int, rows: list[tuple[int, int, int, np.ndarray, bytes]], verify: Verify) -> pa.RecordBatch:
    """rows: (node, weight, side, buckets of the node, payload) of one unit; side 2 marks rows compared among themselves."""
    side = np.array([r[2] for r in rows])
    linked = verify([r[4] for r in rows])
    np.fill_diagonal(linked, False)
    node, weight = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
    root = _forest(linked)
    if side[0] != 2:
        # What hangs together on one side is told by the unit of that side alone: here only the joints of the sides count.
        own = _forest(linked & (side[:, None] == side[None]))
        root = np.where(own == np.arange(len(rows)), root, np.arange(len(rows)))
        linked &= side[:, None] != side[None]
    if linked.any() and (before := _shared_before(bucket, [r[3] for r in rows])) is not None:
        linked &= ~before
    links = linked.astype(np.float64) @ weight.astype(np.float64)
    hit = np.flatnonzero((links > 0) | (root != np.arange(len(rows))))
    return pa.record_batch([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[root[hit]])], schema=_OUT)


def links(buckets: DataFrame, payloads: DataFrame, verify: Verify, block: int = BLOCK) -> DataFrame:
    """(node, links, component) of the rows that have a verified link.

    ``buckets``: distinct (bucket, node), and ``bytes`` of the node's payload where blocks are to be bounded by them; ``payloads``: (node, weight, payload). The pairs that share a bucket are verified.
    ``links`` sums the weights of the rows linked. Two of n sets of members are taken for one with odds of about n^2 / 2^65.
    """
    mark = F.bit_xor(F.xxhash64("node"))
    heavy = F.sum("bytes") if "bytes" in buckets.columns else F.lit(0)
    size = buckets.groupBy("bucket").agg(F.count("*").alias("n"), mark.alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi"), heavy.alias("bytes")).filter("lo < hi")
    k = F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int")
    size = checkpointed(size.groupBy("n", "x", "lo", "hi", "bytes").agg(F.min("bucket").alias("bucket")).select("bucket", "n", k.alias("k")))
    buckets = buckets.drop("bytes")
    total = size.agg(F.sum("n")).first()[0] or 0
    # A node is in no more buckets than there are tables.
    mine = met(buckets, size, "bucket", total).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("bucket", "k"))).alias("mine"))
    # The payloads meet their buckets before they are copied to the units.
    held = payloads.join(mine, "node").select("node", "weight", "payload", F.col("mine.bucket").alias("mine"), F.explode("mine").alias("m")).select("*", "m.*")
    held = held.withColumn("x", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("x") == F.col("y"), 2).when(F.col("x") < F.col("y"), 0).otherwise(1)
    unit = held.select(F.col("bucket").alias("g"), F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "node", "weight", side.alias("side"), "mine", "payload")
    dealt = unit.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)
            lists = batch.column(6)
            edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            values = zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), own, batch.column(7).to_pylist(), strict=True)
            for k, v in zip(keys, values, strict=True):
                if k != key:
                    if len(rows) > 1:
                        yield _unit(key[0], rows, verify)
                    key, rows = k, []
                rows.append(v)
        if len(rows) > 1:
            yield _unit(key[0], rows, verify)

    found = checkpointed(dealt.mapInArrow(work, "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    return counts.join(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node")


def named(nodes: DataFrame, least: str) -> DataFrame:
    """``nodes`` (component and others) with the smallest ``least`` of each component as ``name``."""
    nodes = checkpointed(nodes)
    names = nodes.groupBy("component").agg(F.min(least).alias("name"), F.count("*").alias("n"))
    return met(nodes, names, "component", nodes.count())
