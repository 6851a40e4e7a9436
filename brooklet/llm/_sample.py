"""Bounded samples of labelled documents, and the fold that no label is learnt from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """True where crc32 of the id's decimal text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn(ids: DataFrame, bound: int, total: int, salt: str) -> DataFrame:
    """About ``bound`` of ``total`` distinct ids, by hash, so that every run draws the same ones."""
    if total <= bound:
        return ids
    part = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))
    return ids.filter(part < int(bound / total * (1 << 30)))


def labelled(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the training folds: one row an id, label 1 where repeated rows disagree, nulls left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
    return known.filter(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label")).filter(F.col("doc_id").isNotNull())


def unpacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The numbers of a binary column end to end, without a copy for each row."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(parts).view(dtype) if parts else np.zeros(0, dtype)
