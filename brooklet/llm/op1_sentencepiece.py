"""Operator 1: SentencePiece encoding and decoding over a relational lattice.

A text is escaped as the model does it (a leading blank is added, blanks become U+2581) and cut where no piece can reach across:
between two characters that follow each other in no piece. What lies between two cuts is a *unit*; the ids of a text are those of its units.

1. Each split of the input reports its distinct units.
2. All distinct units are encoded once, as a relation: substrings of up to the longest piece's length are exploded, equi-joined to
   the piece table (as large as the vocabulary, hence broadcast) and grouped by unit; a higher-order ``aggregate`` folds the edges:
   ``viterbi`` for unigram models (best sum of scores), ``merged`` for BPE models (the best-ranked pair of
   neighbours is merged until none is left). The model's type is read from its file. The public model is BPE: a Viterbi path over its ranks
   is not what it means, so the query folds merges. Units of more than ``MOST`` characters, for which an edge's number has no room,
   take the same merges or the same path in a task (``merge_long``, ``path_of_long``).
3. The units' ids go back to the splits that hold them, as one sorted file a split in the shared folder, and a second
   scan looks each unit of a text up there. No text is shuffled.

Characters without a piece become the pieces of their UTF-8 bytes. Decoding is the inverse: pieces are joined, byte pieces
become bytes, U+2581 becomes a blank, the leading blank goes.

Nulls and odd rows: a null text stays null with null ids; an empty one has no ids; repeated rows are encoded each;
U+2581 in a text is read back as a blank, as by the library; other columns are ignored; an empty table gives no row. Two of n units share a 64-bit hash with odds of about n^2 / 2^65.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm import _store
from brooklet.llm._bpe import Table
from brooklet.llm._text import Hasher, batches, gather
from brooklet.session import shared_dir, table

BLANK = 0x2581
#: Characters of a unit that one 64-bit mask of boundaries can hold.
MOST = 62
UNKNOWN = -10.0
#: Units that a task remembers as reported.
SEEN = 1 << 20


@dataclass
class Pieces:
    """The ordinary pieces of a model with their scores, and the ids of its byte pieces."""

    names: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]
    bpe: bool = True

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        with open(path, "rb") as file:
            kind = model_type(file.read())
        if kind not in ("unigram", "bpe"):
            raise ValueError(f"models of type {kind} aren't encoded here")
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        plain = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unused(i) or m.is_unknown(i))]
        byte = {m.id_to_piece(i): i for i in every if m.is_byte(i)}
        return cls([m.id_to_piece(i) for i in plain], plain, [m.get_score(i) for i in plain], [byte.get(f"<0x{b:02X}>", m.unk_id()) for b in range(256)], kind == "bpe")

    def cutter(self) -> Cutter:
        return Cutter({p[i : i + 2] for p in self.names for i in range(len(p) - 1)})

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score); of equal scores the earlier piece has the better rank."""
        rank = np.empty(len(self.ids), dtype=np.int32)
        rank[np.lexsort((np.arange(len(self.ids)), -np.array(self.scores)))] = np.arange(len(self.ids))
        columns = {"piece": pa.array(self.names), "id": pa.array(self.ids, pa.int32()), "score": pa.array(self.scores, pa.float64()), "rank": pa.array(rank)}
        return spark.createDataFrame(pa.table(columns))

    @property
    def longest(self) -> int:
        return max(map(len, self.names), default=1)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in protocol-buffer form: numbers, and the bytes of what has a length."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            at += size
            yield key >> 3, raw[at - size : at]


def model_type(raw: bytes) -> str:
    """The type in a model's trainer settings (field 2 of the model, field 3 of the settings); unigram where it says none."""
    trainer = next((v for k, v in _fields(raw) if k == 2), b"")
    return ("unigram", "bpe", "word", "char")[next((v for k, v in _fields(trainer) if k == 3), 1) - 1]


class Cutter:
    """Cuts texts into units."""

    def __init__(self, pairs: set[str]):
        letters = sorted({c for p in pairs for c in p})
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1) ** 2, dtype=bool)
        self.wide = len(letters) + 1
        for p in pairs:
            self.joined[self.number[ord(p[0])] * self.wide + self.number[ord(p[1])]] = True

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Escaped code points of a piece of texts, the starts and ends of their units, and the first unit of each text."""
        cp, begin = code_points(data, off)
        cp[cp == 32] = BLANK
        full = begin[1:] > begin[:-1]
        cp = np.insert(cp, begin[:-1][full], BLANK)
        begin = begin + np.concatenate([[0], np.cumsum(full)])
        n = self.number[cp]
        new = np.ones(len(cp), dtype=bool)
        new[1:] = ~self.joined[n[:-1] * self.wide + n[1:]]
        new[begin[:-1][begin[:-1] < len(cp)]] = True
        starts = np.flatnonzero(new)
        return cp, starts, np.append(starts[1:], len(cp)), np.searchsorted(starts, begin)


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, end to end, and where each text's begin."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b0 = data[lead].astype(np.uint32)
    cp = b0.copy()
    if len(high := np.flatnonzero(b0 >= 0xC0)):
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        at, b = lead[high], b0[high]
        b1, b2, b3 = (more[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        cp[high] = np.where(b < 0xE0, (b & 0x1F) << 6 | b1, np.where(b < 0xF0, (b & 0xF) << 12 | b1 << 6 | b2, (b & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    return cp, np.searchsorted(lead, off)


def _hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = Hasher(cp).spans(starts, ends)
    h[h == 0] = 1
    return h


def reported(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(unit, split): the distinct units of each split of ``docs`` (text, split); few come more than once."""

    def report(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, known = None, Table(SEEN.bit_length()), 0
        for batch in rows:
            splits = batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(splits, prepend=splits[:1] - 1, append=splits[-1:] + 1)) if len(splits) else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if splits[a] != now:
                    now, seen, known = splits[a], Table(SEEN.bit_length()), 0
                units: list[str] = []
                for _, _, data, off in batches(batch.column(0).slice(a, b - a)):
                    cp, starts, ends, _ = cutter.units(data, off)
                    h, at = np.unique(_hashes(cp, starts, ends), return_index=True)
                    new = seen.find(h) < 0
                    h, at = h[new], at[new]
                    if known + len(h) > SEEN:
                        seen, known = Table(SEEN.bit_length()), 0
                    if len(h) <= SEEN:
                        seen.put(h, np.ones(len(h), dtype=np.int32))
                        known += len(h)
                    text = cp.astype("<u4").tobytes().decode("utf-32-le", "replace")
                    units += [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                # In order, units share beginnings with their neighbours and take less room.
                column = pa.array(units, pa.string())
                yield pa.record_batch([column.take(pc.sort_indices(column)), pa.array(np.full(len(units), now))], names=["unit", "split"])

    return docs.select("text", "split").mapInArrow(report, "unit string, split long")


#: Bits of an edge: rank, id, start, size. Rank comes first, so that the least edge is the one to merge.
_ID, _START, _SIZE = 1 << 12, 1 << 6, 1 << 6
_RANK = 1 << 32


def _part(e: Column, below: int, wide: int) -> Column:
    return F.call_function("shiftright", e, F.lit(below.bit_length() - 1)).bitwiseAND(F.lit(wide - 1)).cast("int")


def _start(e: Column) -> Column:
    return _part(e, _SIZE, _START)


def _size(e: Column) -> Column:
    return _part(e, 1, _SIZE)


def _id(e: Column) -> Column:
    return _part(e, _ID, _RANK // _ID)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, n, edges): the pieces of two characters or more inside each unit of at most ``MOST`` characters.

    An edge is one number (rank, id, start and size of the piece); edges come by rank, then by start. An edge 0 stands in each
    list first, so that a unit without pieces has its group.
    """
    n = F.length("unit")
    one = units.filter(n.between(1, MOST)).select("unit", F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).alias("start"))
    least = F.when(F.col("start") == 0, 1).otherwise(2)
    two = one.select("unit", "start", F.explode(F.sequence(least, F.least(F.lit(longest), n - F.col("start")))).alias("size"))
    three = two.withColumn("piece", F.when(F.col("size") > 1, F.substring("unit", F.col("start") + 1, F.col("size"))))
    # The vocabulary bounds the piece table.
    found = three.join(F.broadcast(pieces), "piece", "left").filter(F.col("rank").isNotNull() | (F.col("size") == 1))
    edge = F.coalesce(F.col("rank") * _RANK + F.col("id") * _ID + F.col("start") * _SIZE + F.col("size"), F.lit(0).cast("long"))
    grouped = found.groupBy("unit").agg(F.collect_list(edge).alias("edges"))
    return grouped.select("unit", F.length("unit").alias("n"), F.array_sort("edges").alias("edges"))


def _spelt(start: Column, singles: Column, single_ids: Column, byte_ids: Column) -> Column:
    """The ids of one character of the unit: its piece, or its bytes."""
    letter = F.substring(F.col("unit"), start + 1, F.lit(1))
    place = F.call_function("instr", singles, letter)
    code = F.hex(F.encode(letter, "utf-8"))
    spelt = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.element_at(byte_ids, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + 1))
    return F.when(place > 0, F.array(F.element_at(single_ids, place))).otherwise(spelt)


class _Letters:
    """Pieces of one character as a text in which they are looked up, the common ones first."""

    def __init__(self, pieces: Pieces):
        single = sorted((p, i) for p, i in zip(pieces.names, pieces.ids, strict=True) if len(p) == 1)
        self.text = F.lit("".join(p for p, _ in single))
        self.ids = F.array(*[F.lit(i) for _, i in single]) if single else F.array(F.lit(0))
        self.byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])

    def ids_of(self, start: Column) -> Column:
        return _spelt(start, self.text, self.ids, self.byte_ids)


def merged(found: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) by byte-pair merges: the state is the mask of the boundaries that stand."""
    letters = _Letters(pieces)
    ends = lambda e: _bit(_start(e)) + _bit(_start(e) + _size(e))
    inner = lambda e: (_bit(_start(e) + _size(e)) - 1).bitwiseAND(F.bitwise_not(_bit(_start(e) + 1) - 1))
    edges = F.transform(F.filter("edges", lambda e: e > 0), lambda e: F.struct(ends(e).alias("ends"), inner(e).alias("inner"), _start(e).alias("start"), _id(e).alias("id")))
    held = found.select("unit", "n", edges.alias("e"))
    every = _bit(F.col("n") + 1) - 1

    def fits(m: Column, e: Column) -> Column:
        return (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["inner"])) == 1)

    def step(m: Column, _: Column) -> Column:
        best = F.get(F.filter("e", lambda e: fits(m, e)), 0)
        return m.bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("long"))))

    turns = F.least(F.col("n") - 1, F.size("e"))
    folded = F.when(turns > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), every, step)).otherwise(every)
    masked = held.select("unit", "n", "e", folded.alias("m"))
    stand = lambda e: (F.col("m").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("m").bitwiseAND(e["inner"]) == 0)
    joint = F.transform(F.filter("e", stand), lambda e: F.struct(e["start"].alias("start"), F.array(e["id"]).alias("ids")))
    alone = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("m").bitwiseAND(_bit(i) * 3) == _bit(i) * 3)
    single = F.transform(alone, lambda i: F.struct(i.alias("start"), letters.ids_of(i).alias("ids")))
    every_token = F.array_sort(F.concat(joint, single))
    return masked.select("unit", F.flatten(F.transform(every_token, lambda t: t["ids"])).alias("ids"))


def viterbi(found: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) by the path of the greatest sum of scores; of equal paths the one whose last piece begins first.

    A character without a piece of its own costs ``UNKNOWN`` more than the worst piece.
    """
    letters = _Letters(pieces)
    ranked = sorted(zip(pieces.scores, range(len(pieces.ids)), strict=True), key=lambda x: (-x[0], x[1]))
    scores = F.lit([x[0] for x in ranked])
    own = {p: s for p, s in zip(pieces.names, pieces.scores, strict=True) if len(p) == 1}
    single_scores = F.lit([own[p] for p in sorted(own)] or [0.0])
    unknown = F.lit(min(pieces.scores) + UNKNOWN)
    kept = found.select("unit", "n", F.filter("edges", lambda e: e > 0).alias("edges"))
    first = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(0).alias("id"))

    def reach(best: Column, k: Column) -> Column:
        here = F.filter("edges", lambda e: _start(e) + _size(e) == k)
        rank = lambda e: F.call_function("shiftright", e, F.lit(_RANK.bit_length() - 1)).cast("int")
        ways = F.transform(here, lambda e: F.struct((F.element_at(best, _start(e) + 1)["score"] + F.element_at(scores, rank(e) + 1)).alias("score"), (-_start(e)).alias("back"), _id(e).alias("id")))
        place = F.call_function("instr", letters.text, F.substring(F.col("unit"), k, F.lit(1)))
        alone = F.struct((F.element_at(best, k)["score"] + F.when(place > 0, F.element_at(single_scores, place)).otherwise(unknown)).alias("score"), (F.lit(1) - k).alias("back"), F.lit(-1).alias("id"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(alone)))))

    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(first), reach)
    path = kept.select("unit", "n", best.alias("best"))
    start = F.struct(F.col("n").alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("path"))

    def back(s: Column, _: Column) -> Column:
        way = F.element_at(F.col("best"), s["at"] + 1)
        on = F.struct((-way["back"]).alias("at"), F.concat(F.array(F.struct((-way["back"]).alias("start"), way["id"].alias("id"))), s["path"]).alias("path"))
        return F.when(s["at"] > 0, on).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, back, lambda s: s["path"])
    ids = F.transform(walked, lambda t: F.when(t["id"] >= 0, F.array(t["id"])).otherwise(letters.ids_of(t["start"])))
    return path.select("unit", F.flatten(ids).alias("ids"))


def merge_long(unit: str, rank: dict[str, tuple[int, int]], byte_ids: list[int]) -> list[int]:
    """The merges of one long unit: a heap of neighbours by rank, then place. ``rank``: piece -> (rank, id)."""
    n = len(unit)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if 0 <= i < n and after[i] < n and (r := rank.get(unit[i : ends[after[i]]])):
            heapq.heappush(heap, (r[0], i, ends[after[i]]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        found = rank.get(unit[i : ends[i]])
        out += [found[1]] if found else [byte_ids[b] for b in unit[i : ends[i]].encode()]
        i = after[i]
    return out


def path_of_long(unit: str, score: dict[str, tuple[float, int]], unknown: float, byte_ids: list[int], longest: int) -> list[int]:
    """The path of one long unit that ``viterbi`` finds. ``score``: piece -> (score, id)."""
    best: list[tuple[float, int]] = [(0.0, 0)]  # score, and minus the start of the last piece
    for k in range(1, len(unit) + 1):
        own = score.get(unit[k - 1])
        ways = [(best[k - 1][0] + (own[0] if own else unknown), 1 - k)]
        ways += [(best[j][0] + found[0], -j) for j in range(max(0, k - longest), k - 1) if (found := score.get(unit[j:k]))]
        best.append(max(ways))
    out, k = [], len(unit)
    while k:
        j = -best[k][1]
        found = score.get(unit[j:k])
        out.append([found[1]] if found else [byte_ids[b] for b in unit[j:k].encode()])
        k = j
    return [i for part in reversed(out) for i in part]


def _split() -> Column:
    return F.xxhash64(F.input_file_name(), F.input_file_block_start())


def encoded_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of distinct units."""
    spark = units.sparkSession
    rows = pieces.frame(spark)
    found = lattice(units, rows, pieces.longest)
    byte_ids, longest, bpe, unknown = pieces.byte_ids, pieces.longest, pieces.bpe, min(pieces.scores, default=0.0) + UNKNOWN
    if bpe:
        known = {r[0]: (r[1], r[2]) for r in rows.select("piece", "rank", "id").collect()}
    else:
        known = {p: (s, i) for p, s, i in zip(pieces.names, pieces.scores, pieces.ids, strict=True)}

    def long(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            names = batch.column(0).to_pylist()
            ids = [merge_long(u, known, byte_ids) if bpe else path_of_long(u, known, unknown, byte_ids, longest) for u in names]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["unit", "ids"])

    rest = units.filter(F.length("unit") > MOST).mapInArrow(long, "unit string, ids array<int>")
    return (merged if bpe else viterbi)(found, pieces).unionByName(rest)


def _write_splits(rows: DataFrame, folder: str) -> None:
    """One file for each split: its units' hashes in ascending order, the numbers of their ids, the ids."""

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> pa.RecordBatch:
            h, size, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
            h, at = np.unique(h, return_index=True)
            ids = gather(ids, (np.cumsum(size, dtype=np.int64) - size)[at], size[at].astype(np.int64))
            with _store.writer(f"{folder}/{now & ((1 << 64) - 1):016x}") as out:
                out.write(np.array([len(h), len(ids)], dtype="<i8").tobytes() + pa.compress(h.tobytes() + size[at].astype("<i4").tobytes() + ids.astype("<i4").tobytes(), codec="zstd", asbytes=True))
            return pa.record_batch([pa.array([now]), pa.array([len(h)])], names=["split", "n"])

        for batch in found:
            splits = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(splits, prepend=splits[:1] - 1, append=splits[-1:] + 1)) if len(splits) else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if splits[a] != now:
                    if parts:
                        yield close()
                    now, parts = int(splits[a]), []
                lists, place = batch.column(2).slice(a, b - a), 0
                size, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                for x, y, data, off in batches(batch.column(1).slice(a, b - a)):
                    cp, begin = code_points(data, off)
                    n = int(size[x:y].sum())
                    parts.append((_hashes(cp, begin[:-1], begin[1:]), size[x:y], ids[place : place + n]))
                    place += n
        if parts:
            yield close()

    sorted_ = rows.select("split", "unit", "ids").repartition("split").sortWithinPartitions("split")
    sorted_.mapInArrow(write, "split long, n long").agg(F.sum("n")).collect()


@lru_cache(2)
def _dictionary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    with _store.reader(path) as file:
        raw = file.read()
    n, m = np.frombuffer(raw, dtype="<i8", count=2)
    body = pa.decompress(raw[16:], decompressed_size=int(12 * n + 4 * m), codec="zstd", asbytes=True)
    h, size, ids = np.frombuffer(body, dtype="<u8", count=n), np.frombuffer(body, dtype="<i4", count=n, offset=8 * n), np.frombuffer(body, dtype="<i4", count=m, offset=12 * n)
    return h, np.cumsum(size, dtype=np.int64) - size, size, ids


Batches = Iterator[pa.RecordBatch]


def _prepared(docs: DataFrame, pieces: Pieces, folder: str | None) -> tuple[DataFrame, Callable[[Batches], Batches]]:
    """The documents (doc_id, text, split), and what turns their batches into (doc_id, text, ids)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/op1-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not docs.inputFiles():
        docs.write.parquet(f"{folder}/documents")
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/documents")
    cutter = pieces.cutter()
    split = docs.select("doc_id", "text", _split().alias("split"))
    reported(split, cutter).write.option("compression", "zstd").parquet(f"{folder}/reported")
    held = spark.read.schema("unit string, split long").parquet(f"{folder}/reported")
    _write_splits(held.join(encoded_units(held.select("unit").distinct(), pieces), "unit"), f"{folder}/units")

    def look_up(rows: Batches) -> Batches:
        for batch in rows:
            splits, texts = batch.column(2).to_numpy(), batch.column(1)
            edges = np.flatnonzero(np.diff(splits, prepend=splits[:1] - 1, append=splits[-1:] + 1)) if len(splits) else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for x, y, data, off in batches(texts.slice(a, b - a)):
                    cp, starts, ends, first = cutter.units(data, off)
                    if len(starts):
                        h, start, size, ids = _dictionary(f"{folder}/units/{int(splits[a]) & ((1 << 64) - 1):016x}")
                        own = _hashes(cp, starts, ends)
                        at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                        if (h[at] != own).any():
                            raise ValueError("a unit of this split was not reported: the files changed between the scans")
                        flat, total = gather(ids, start[at], size[at]), np.concatenate([[0], np.cumsum(size[at], dtype=np.int64)])
                    else:
                        flat, total = np.zeros(0, np.int32), np.zeros(1, np.int64)
                    there = texts.slice(a + x, y - x)
                    at = pa.array(total[first].astype(np.int32), mask=np.append(~np.array(there.is_valid()), False))
                    yield pa.record_batch([batch.column(0).slice(a + x, y - x), there, pa.ListArray.from_arrays(at, pa.array(flat, pa.int32()))], names=["doc_id", "text", "ids"])

    return split, look_up


def encode(docs: DataFrame, pieces: Pieces, folder: str | None = None) -> DataFrame:
    """doc_id, text and ids of each document.

    ``docs`` is a table as read from files, perhaps filtered or projected; one that comes from no file is written first.
    """
    split, look_up = _prepared(docs, pieces, folder)
    return split.mapInArrow(look_up, "doc_id long, text string, ids array<int>")


def _speller(pieces: Pieces) -> Callable[[pa.ListArray], list[str | None]]:
    """The texts of lists of ids."""
    spelling = {i: p.replace("▁", " ").encode() for i, p in zip(pieces.ids, pieces.names, strict=True)} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
    size = np.zeros(max(spelling) + 1, dtype=np.int64)
    for i, p in spelling.items():
        size[i] = len(p)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(spelling[i] for i in sorted(spelling)), dtype=np.uint8)

    def spell(lists: pa.ListArray) -> list[str | None]:
        edges, ids, texts = lists.offsets.to_numpy(), lists.values.to_numpy(), []
        for i, valid in enumerate(lists.is_valid().to_pylist()):
            own = ids[edges[i] : edges[i + 1]]
            texts.append(gather(flat, start[own], size[own]).tobytes().decode("utf-8", "replace")[1:] if valid else None)
        return texts

    return spell


def decode(rows: DataFrame, pieces: Pieces, to: str = "decoded") -> DataFrame:
    """``rows`` with the texts of their ``ids``."""
    spell = _speller(pieces)
    rows = rows.drop(to).withColumn(to, F.lit(None).cast("string"))
    at, n = rows.columns.index("ids"), len(rows.columns) - 1

    def work(found: Batches) -> Batches:
        for batch in found:
            yield pa.record_batch([*batch.columns[:n], pa.array(spell(batch.column(at)), pa.string())], names=batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens of each document, and whether decoding gives the text back: both ways in one pass."""
    pieces = Pieces.read(path)
    split, look_up = _prepared(docs, pieces, None)
    spell = _speller(pieces)

    def work(found: Batches) -> Batches:
        for batch in look_up(found):
            lists = batch.column(2)
            exact = [a == b for a, b in zip(batch.column(1).to_pylist(), spell(lists), strict=True)]
            yield pa.record_batch([batch.column(0), lists, pa.array(exact, pa.bool_())], names=["doc_id", "ids", "exact"])

    both = split.mapInArrow(work, "doc_id long, ids array<int>, exact boolean")
    return both.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "exact")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
