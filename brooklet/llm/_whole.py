"""Exact whole-number arithmetic on vectors, for clusterings whose results are whole numbers.

Components are ``int64`` where no square or sum of one vector can leave it, else Python's own integers in object arrays; both go through the
same expressions. Sums over a table are added up as decimal text, so that they have no bound either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Four times components up to this number, squared and summed over ``WIDTH`` of them, fit 64 bits, and so do eight such sums of their differences.
SMALL, WIDTH = 1 << 24, 512
LONG = (1 << 63) - 1
#: Rows of partial sums that make a task of their own.
TASK_ROWS = 1 << 14


def narrow(x: np.ndarray) -> np.ndarray:
    """``x``, of whole numbers, as int64 if they are small enough, else as Python's integers."""
    if x.size == 0:
        return x.astype(np.int64)
    if max(abs(x.max()), abs(x.min())) <= SMALL and x.shape[-1] <= WIDTH:
        return x.astype(np.int64)
    if x.dtype == object:
        return x
    return np.frompyfunc(int, 1, 1)(x)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly; ``scale`` is a power of two, so only an overflow could round."""
    with np.errstate(over="ignore"):
        scaled = x * float(scale)
    if np.isfinite(scaled).all():
        return narrow(np.floor(scaled))
    return narrow(np.frompyfunc(lambda v: int(v) * scale if abs(v) > 1e300 else int(np.floor(v * scale)), 1, 1)(x))


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers end to end (nulls are NaN), and where each vector begins and how long it is; a null vector has length -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = column.offsets.to_numpy()
    size = np.where(np.array(column.is_valid(), dtype=bool), np.diff(start), -1)
    flat = column.values.cast(pa.float64())
    return flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), start[:-1], size


def texts(x: np.ndarray) -> list[str]:
    return [str(int(v)) for v in x]


def longs(values) -> pa.Array:
    """Whole numbers as a long column; null where one doesn't fit."""
    return pa.array([int(v) if abs(v) <= LONG else None for v in values], pa.int64())


PARTIAL = "slot int, n long, sums array<string>"
_PARTIAL = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


class Sums:
    """Sums and counts of vectors by slot."""

    def __init__(self) -> None:
        self.n: dict[int, int] = {}
        self.total: dict[int, np.ndarray] = {}

    def add(self, slot: int, n: int, sums: np.ndarray) -> None:
        """``sums`` fit their own type; their total is kept in Python's integers."""
        sums = sums.astype(object)
        self.total[slot] = self.total[slot] + sums if slot in self.total else sums
        self.n[slot] = self.n.get(slot, 0) + n

    def batch(self) -> pa.RecordBatch:
        slots = sorted(self.n)
        return pa.record_batch([pa.array(slots, pa.int32()), pa.array([self.n[s] for s in slots], pa.int64()), pa.array([texts(self.total[s]) for s in slots], pa.list_(pa.string()))], schema=_PARTIAL)


def totals(partial: DataFrame, rows: int) -> Sums:
    """Sums and counts of each slot, of ``partial`` rows (slot, n, sums); ``rows`` is about how many there are, and slots are few."""

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in parts:
            for slot, n, values in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sums.add(slot, n, np.array(list(map(int, values)), dtype=object))
        yield sums.batch()

    some = partial.repartition(max(1, min(1024, rows // TASK_ROWS))).mapInArrow(fold, PARTIAL)
    out = Sums()
    for row in some.collect():
        out.add(row["slot"], row["n"], np.array(list(map(int, row["sums"])), dtype=object))
    return out


def means(old: np.ndarray, sums: Sums, first: int = 0) -> np.ndarray:
    """``old`` with each row whose slot has vectors replaced by floor(sum / count)."""
    new = old.astype(object)
    for i in range(len(new)):
        if n := sums.n.get(first + i):
            new[i] = sums.total[first + i] // n
    return narrow(new)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and label of the vectors that aren't null and have no null or non-finite component."""
    x = F.col("embedding").cast("array<double>")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), label.alias("label"))


def summed(name: str) -> Column:
    """The sum of a long column as a long; null where it doesn't fit or a part is missing."""
    total = F.when(F.count(name) == F.count("*"), F.sum(F.col(name).cast("decimal(38,0)")))
    return F.when(F.abs(total) <= F.lit(str(LONG)).cast("decimal(38,0)"), total).cast("long")


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
