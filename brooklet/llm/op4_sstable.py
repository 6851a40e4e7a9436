"""Operator 4: token ids in sorted-string-table shards.

A shard is one file with the documents of a key range in ascending order::

    block*  index  bloom  footer

* A block holds about ``BLOCK`` bytes of entries, compressed with zstd. An entry is ``<u8 shared> <u8 rest> <u32 n>``, the
  ``rest`` last bytes of the key (the ``shared`` first ones are those of the key before it in the block) and n values.
  A key is the document id as 8 big-endian bytes with the sign bit flipped, so that byte order is numeric order; a null id
  has the empty key, which sorts first. Values are little-endian, 2 bytes each where all ids of the shard fit, else 4.
* The sparse index has a row for each block: its last key, place, size on disk, size unpacked, entries and values.
* The Bloom filter has ``BITS`` bits a key and ``PROBES`` probes.
* The footer has a fixed size and says where index and filter lie; a reader starts from it.

A lookup reads the footer, asks the filter, searches the index by bisection and unpacks one block.

Nulls and odd rows: a null text is an empty one; repeated document ids stay, in the order of a hash of their texts, and
many rows of one id or of none are dealt over several shards; other columns are ignored; an empty table gives no shard and no row. A task that runs twice writes two files; the manifest, which Spark
commits once, names the file that counts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brooklet.llm import _store
from brooklet.llm._bpe import encoder
from brooklet.llm._text import batches, gather, mix
from brooklet.session import shared_dir, table

BLOCK = 1 << 18
#: Bytes of text of a shard, about; keys that the filter takes in at once.
SHARD, AT_ONCE = 1 << 28, 1 << 16
BITS, PROBES = 10, 7
MAGIC = b"BRKSST01"
_FOOTER = struct.Struct("<8s4sBQQQQQQQ")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<BQIIIQ")
MANIFEST = "shard int, path string, n_documents long, n_values long, nulls boolean, min_id long, max_id long"

_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_documents", pa.int64()), ("n_values", pa.int64()), ("nulls", pa.bool_()), ("min_id", pa.int64()), ("max_id", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys + np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64)[None] * step[:, None]) % np.uint64(bits)


def _bloom_key(key: bytes) -> int:
    return int.from_bytes(key, "big") if key else 0x5BD1E995


class Writer:
    """Writes one shard; entries come in key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.index, self.keys = bytearray(), [], array("Q")  # eight bytes a key, for the filter
        self.before, self.entries, self.values, self.total = b"", 0, 0, 0

    def add(self, key: bytes, values: np.ndarray) -> None:
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        self.block += _ENTRY.pack(shared, len(key) - shared, len(values)) + key[shared:]
        self.block += values.astype(f"<u{self.width}").tobytes()
        self.before, self.entries, self.values = key, self.entries + 1, self.values + len(values)
        self.keys.append(_bloom_key(key))
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            packed = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
            self.out.write(packed)
            self.index.append(_INDEX.pack(len(self.before), self.at, len(packed), len(self.block), self.entries, self.values) + self.before)
            self.at, self.total = self.at + len(packed), self.total + self.values
            self.block, self.entries, self.values = bytearray(), 0, 0

    def close(self) -> tuple[int, int]:
        self._flush()
        keys = np.frombuffer(self.keys, dtype=np.uint64)
        bits = max(64, -(-BITS * len(keys) // 8) * 8)
        filter_ = np.zeros(bits // 8, dtype=np.uint8)
        for i in range(0, len(keys), AT_ONCE):
            where = _probes(keys[i : i + AT_ONCE], bits).ravel().astype(np.int64)
            np.bitwise_or.at(filter_, where >> 3, np.left_shift(1, where & 7).astype(np.uint8))
        index, bloom = b"".join(self.index), filter_.tobytes()
        self.out.write(index + bloom)
        self.out.write(_FOOTER.pack(MAGIC, b"zstd", self.width, self.at, len(index), self.at + len(index), len(bloom), len(keys), self.total, zlib.crc32(index)))
        self.out.close()
        return len(keys), self.total


class Reader:
    """Reads a shard from its footer on."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - _FOOTER.size)
        magic, codec, self.width, at, n, bloom_at, bloom_n, self.n_documents, self.n_values, crc = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC or codec != b"zstd":
            raise ValueError("not a shard of this format")
        file.seek(at)
        raw = file.read(n)
        if zlib.crc32(raw) != crc:
            raise ValueError("the index of this shard is damaged")
        self.blocks: list[tuple[bytes, int, int, int]] = []
        place = 0
        while place < n:
            k, start, packed, size, _, _ = _INDEX.unpack_from(raw, place)
            place += _INDEX.size + k
            self.blocks.append((raw[place - k : place], start, packed, size))
        file.seek(bloom_at)
        self.bloom, self.bits = np.frombuffer(file.read(bloom_n), dtype=np.uint8), bloom_n * 8

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, packed, size = self.blocks[i]
        self.file.seek(start)
        raw = pa.decompress(self.file.read(packed), decompressed_size=size, codec="zstd", asbytes=True)
        at, key = 0, b""
        while at < size:
            shared, rest, n = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, dtype=f"<u{self.width}", count=n, offset=at)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        where = _probes(np.array([_bloom_key(key)], dtype=np.uint64), self.bits)[0].astype(np.int64)
        return bool(((self.bloom[where >> 3] >> (where & 7).astype(np.uint8)) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id lists stored under a document id: none, one, or several where the id was repeated."""
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            i = bisect_left([b[0] for b in self.blocks], key)
            while i < len(self.blocks):
                found += [v for k, v in self.block(i) if k == key]
                if self.blocks[i][0] != key:
                    break
                i += 1
        return found


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shards: int | None = None, end_id: int = 0) -> DataFrame:
    """Encodes ``text`` and writes one shard for each range of ``doc_id``; returns the committed manifest.

    There are as many shards as the texts' bytes ask for (``SHARD``), but no fewer than partitions of a shuffle.

    One shuffle moves the texts to their ranges; the ids are made where they are written.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if shards is None:
        size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, to, part = encoder(tokenizer), None, TaskContext.get().partitionId()
        nulls, least, most = False, None, None
        width = 2 if max(bpe.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        path = f"{folder}/shards/{part:08d}-{uuid.uuid4().hex}.sst"
        for batch in rows:
            keys, end = batch.column(0).to_pylist(), np.array([end_id], dtype=np.int32)
            if present := [k for k in keys if k is not None]:
                least, most = present[0] if least is None else least, present[-1]
            nulls |= len(present) < len(keys)
            for a, _, data, off in batches(batch.column(1)):
                ids, counts = bpe.encode(data, off)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for i in range(len(counts)):
                    to = to or Writer(_store.writer(path), width)
                    to.add(key_of(keys[a + i]), np.concatenate([ids[edges[i] : edges[i + 1]], end]))
        if to is not None:
            n_documents, n_values = to.close()
            row = {"shard": part, "path": path, "n_documents": n_documents, "n_values": n_values, "nulls": nulls, "min_id": least, "max_id": most}
            yield pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

    # An id that many rows have, or none, is dealt over ranges of its texts' hashes.
    ranged = kept.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row for each stored document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the values of all documents before it; the running total over the manifest has a row a shard.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, start in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                shard = Reader(_store.reader(path))
                for i in range(len(shard.blocks)):
                    keys, counts, sums = [], [], []
                    for key, values in shard.block(i):
                        keys.append(id_of(key))
                        counts.append(len(values))
                        sums.append(zlib.crc32(values.astype("<u4").tobytes()))
                    n = np.array(counts, dtype=np.int64)
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(n.sum())

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_values").over(before), F.lit(0)).alias("start"))
    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("path", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The id lists stored under one document id; only shards whose key range covers it are opened, and of them one block."""
    covers = F.col("nulls") if doc_id is None else F.lit(doc_id).between(F.col("min_id"), F.col("max_id"))
    shards = manifest.filter(covers).select("path").collect()
    return [v.tolist() for (path,) in shards for v in Reader(_store.reader(path)).get(doc_id)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/op4-{uuid.uuid4().hex}"
    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder))
