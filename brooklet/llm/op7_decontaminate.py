"""Operator 7: benchmark decontamination.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. The windows of an item are its runs of 13
words, or all its words where it has fewer. Their hashes are a set that every task gets; each document's token windows are
looked up in it, hits are verified word by word, and the words under any hit are marked.

What is sent out is bounded as it is built: a window takes ``WINDOW_BYTES`` beside the words of its item, which are held once. Items of
more than ``PIECE`` words are split at windows, and where all windows take more than ``MAX_BYTES`` the pieces are dealt into blocks of
about that size; the documents are scanned once for each block, marks adding up, with a checkpoint between the scans.

Nulls and odd rows: a null or empty text has no words; an item without words has no window; repeated items count once by
their id, and a null item_id is named ``null``; repeated documents are judged each; ``scan`` replaces columns
named like those it adds, the removers keep every column; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._bpe import Table
from brooklet.llm._text import BASE2, Hasher, U, batches, mix, windows, words
from brooklet.session import checkpointed, table

WINDOW = 13
MAX_BYTES = 64 << 20
#: Bytes that a window takes: its hashes, item and first word, and up to four places in the hash table.
WINDOW_BYTES = 80
#: Windows of an item that are kept together.
PIECE = 1 << 16
HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class _Set:
    """Windows of one length: groups of equal ones, in order of their hashes, with a first word and the items of each."""

    def __init__(self, h: np.ndarray, at: np.ndarray, owner: np.ndarray, k: int):
        w, other = windows(h, k)[at], windows(mix(h ^ U(BASE2)), k)[at]
        order = np.lexsort((owner, other, w))
        w, other, at, owner = w[order], other[order], at[order], owner[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (other[1:] != other[:-1])
        group = np.cumsum(new) - 1
        mine = np.ones(len(w), dtype=bool)
        mine[1:] = new[1:] | (owner[1:] != owner[:-1])
        self.hashes, self.first = w[new], at[new].astype(np.int32)
        self.owners = owner[mine].astype(np.int32)
        self.edges = np.searchsorted(group[mine], np.arange(len(self.first) + 1)).astype(np.int32)
        unique, place = np.unique(self.hashes, return_index=True)
        self.places = Table(max(4, (2 * len(unique)).bit_length()))
        self.places.put(unique, place.astype(np.int32))


class Windows:
    """The windows of one block of items (name, text), by length."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts = [text.encode() for _, text in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        low, s, e, owner = words(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
        name = np.array([number[n] for n, _ in items], dtype=np.int64)[owner] if len(s) else owner
        count = np.bincount(owner, minlength=len(items))[owner] if len(s) else owner
        h = Hasher(low).spans(s, e)
        self.low, self.s, self.e = low, s.astype(np.int32), e.astype(np.int32)
        self.by_length: dict[int, _Set] = {}
        for k in np.unique(np.minimum(count, size)).tolist():
            at = np.flatnonzero((owner[: len(s) - k + 1] == owner[k - 1 :]) & (np.minimum(count, size)[: len(s) - k + 1] == k))
            self.by_length[k] = _Set(h, at, name[at], k)

    def items(self, k: int, n: int, text: bytes) -> set[int]:
        """The items of the windows of ``k`` words that are ``text``, words joined by blanks; ``n``: the first group of its hash."""
        found, own = set(), self.by_length[k]
        group = n
        while group < len(own.hashes) and own.hashes[group] == own.hashes[n]:
            i = own.first[group]
            if joined(self.low, self.s[i : i + k], self.e[i : i + k]) == text:
                found.update(own.owners[own.edges[group] : own.edges[group + 1]].tolist())
            group += 1
        return found


def joined(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    return b" ".join(low[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True))


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return data, np.array([0, len(data)])


def pieces(items: DataFrame, size: int, piece: int) -> DataFrame:
    """(name, text, cost) of the pieces of the items (name, text): each window lies in one of them. ``cost``: bytes as built."""

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, s, e, _ = words(*_one(text))
                for a in range(0, max(1, len(s) - size + 1), piece):
                    own = low[s[a] : e[min(len(s), a + piece + size - 1) - 1]].tobytes().decode() if len(s) else ""
                    cost = len(own.encode()) + (WINDOW_BYTES + 8) * min(len(s), piece + size)
                    yield pa.record_batch([pa.array([name], pa.string()), pa.array([own], pa.string()), pa.array([cost], pa.int64())], names=["name", "text", "cost"])

    return items.mapInArrow(split, "name string, text string, cost long")


def _scan(block: Windows, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[int, set[int]]]]:
    """For pieces of the column: its first row, words and marks of each text, and the items found in each text."""
    for a, _, data, off in batches(column):
        low, s, e, owner = words(data, off)
        h = Hasher(low).spans(s, e)
        marks, found = np.zeros(len(s) + 1, dtype=np.int64), defaultdict(set)
        for k, own in block.by_length.items():
            w = windows(h, k)
            if not len(w):
                continue
            at = np.flatnonzero(owner[: len(w)] == owner[k - 1 :])
            hit = own.places.find(w[at])
            for i, n in zip(at[hit >= 0].tolist(), hit[hit >= 0].tolist(), strict=True):
                if items := block.items(k, n, joined(low, s[i : i + k], e[i : i + k])):
                    marks[i] += 1
                    marks[i + k] -= 1
                    found[int(owner[i])] |= items
        yield a, np.bincount(owner, minlength=len(off) - 1), np.cumsum(marks[:-1]) > 0, found


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BYTES, piece: int = PIECE) -> DataFrame:
    """``docs`` with the number of words, the spans of words under windows, and the ids of the items they come from."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = checkpointed(pieces(items, size, piece))
    total = items.agg(F.sum("cost")).first()[0] or 0
    n = -(-total // max_bytes) or 1
    docs = docs.drop("n_words", "spans", "items")
    empty = F.lit(None)
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), empty.cast("array<struct<start:long,end:long>>").alias("spans"), empty.cast("array<string>").alias("items"))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) if n > 1 else items
        block = Windows(sorted(tuple(r) for r in rows.select("name", "text").collect()), size)
        out = _mark(out, docs.sparkSession.sparkContext.broadcast(block))
        if k + 1 < n:
            out = checkpointed(out)
    return out


def _mark(docs: DataFrame, sent: Broadcast) -> DataFrame:
    at = docs.columns.index("text")

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in rows:
            counts, spans, items = [], [], []
            before, named = batch.column("spans"), batch.column("items")
            for a, n_words, hit, found in _scan(block, batch.column(at)):
                edges = np.concatenate([[0], np.cumsum(n_words)])
                counts.append(n_words)
                for i in range(len(n_words)):
                    old, names = before[a + i], named[a + i]
                    own = hit[edges[i] : edges[i + 1]]
                    if old.is_valid and len(old):
                        own = own.copy()
                        for x in old.as_py():
                            own[x["start"] : x["end"]] = True
                    if not own.any():
                        spans.append([])
                        items.append([])
                        continue
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                    items.append(sorted({block.names[j] for j in found.get(i, ())} | set(names.as_py() or ())))
            new = [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
            keep = batch.num_columns - 3
            yield pa.record_batch([*batch.columns[:keep], *new], names=batch.schema.names)

    return docs.mapInArrow(mark, docs.schema)


def judged(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (a hit, and at least a twentieth of the words under hits)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = scanned.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, columns unchanged."""
    return judged(scan(_wrapped(docs), benchmark)).filter(~F.col("contaminated")).select("row.*")


def _wrapped(docs: DataFrame) -> DataFrame:
    """The whole row in one column, so that no name of it can clash with an added one."""
    return docs.select(F.struct("*").alias("row"), "text")


def remove_spans(docs: DataFrame, benchmark: DataFrame, with_blank: str = " ") -> DataFrame:
    """``docs`` with the words under hits cut from ``text``, from the first word's first byte to the last word's last."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            for i, own in enumerate(spans):
                if own:
                    data, off = _one(texts[i])
                    _, s, e, _ = words(data, off)
                    raw, last, parts = data.tobytes(), 0, []
                    for x in own:
                        parts.append(raw[last : s[x["start"]]])
                        last = int(e[x["end"] - 1])
                    texts[i] = with_blank.encode().join([*parts, raw[last:]]).decode()
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    found = scan(_wrapped(docs), benchmark)
    return found.mapInArrow(cut, found.schema).select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(scan(docs, table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT item, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
marked AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS w FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""
