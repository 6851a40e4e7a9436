"""Delta frames of groups of any size: what a stretch of rows does to an open frame, as a value that can be put together.

A frame is closed by the first row at least ``delta`` away from the value that opened it, and that row opens the next. So whatever frame is open
before a stretch, one number of it matters: its first value. ``Change`` holds, for every such number, the frame that is open after the stretch: the
row that closes a frame from below or above is one that no earlier row of the stretch exceeds, and from each of those rows on everything
is settled. Groups of up to ``WHOLE`` rows need none of that: a task cuts many of them in one pass. Two changes in a row are one change again, so a group's frames are found in three levels, none of which reads a group's rows in one task:
stretches, ``COARSE`` stretches at a time, and those of the group. Then each stretch knows the frame open before it and cuts its own rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.session import checkpointed

#: Stretches of one coarse stretch.
COARSE = 1024
#: An open frame: its first value, time and place, and how many frames were closed on the way.
OPEN = np.dtype([("v", "f8"), ("t", "i8"), ("pos", "i8"), ("count", "i8")])


def _closes(highs: np.ndarray, lows: np.ndarray, start: np.ndarray, delta: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (highs - start >= delta) | (start - lows >= delta)


def next_rows(v: np.ndarray, delta: float) -> np.ndarray:
    """For each row the next one that is at least ``delta`` away from it, or the number of rows."""
    n = len(v)
    high, low = np.where(np.isnan(v), -np.inf, v), np.where(np.isnan(v), np.inf, v)
    highs, lows, size = [high], [low], 1
    while 2 * size <= n:
        highs.append(np.maximum(highs[-1][:-size], highs[-1][size:]))
        lows.append(np.minimum(lows[-1][:-size], lows[-1][size:]))
        size *= 2
    at = np.arange(1, n + 1)
    for k in range(len(highs) - 1, -1, -1):  # over blocks in which no row closes the frame
        for _ in range(2 if k == len(highs) - 1 else 1):
            rows = np.flatnonzero(at + (1 << k) <= n)
            rows = rows[~_closes(highs[k][at[rows]], lows[k][at[rows]], v[rows], delta)]
            at[rows] += 1 << k
    return at


@dataclass
class Change:
    """What a stretch does: to a frame that begins with it (``first``), and to one that is open before it, by the rows that could close it."""

    n: int
    last: int
    first: np.void
    high: np.ndarray
    high_at: np.ndarray
    after_high: np.ndarray
    low: np.ndarray
    low_at: np.ndarray
    after_low: np.ndarray

    @classmethod
    def of(cls, t: np.ndarray, v: np.ndarray, delta: float) -> Change:
        n, after = len(v), next_rows(v, delta)
        end, count = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
        while (end[end] != end).any():
            count, end = count + count[end], end[end]
        opened = np.zeros(n, dtype=OPEN)
        opened["v"], opened["t"], opened["pos"], opened["count"] = v[end], t[end], end, count
        closed = opened.copy()
        closed["count"] += 1
        high, low = np.where(np.isnan(v), -np.inf, v), np.where(np.isnan(v), np.inf, v)
        up = np.flatnonzero(np.concatenate([[True], high[1:] > np.maximum.accumulate(high)[:-1]]))
        down = np.flatnonzero(np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]]))
        return cls(n, int(t[-1]), opened[0], high[up], up, closed[up], low[down], down, closed[down])

    def on(self, start: float, delta: float) -> np.void | None:
        """The frame that is open after the stretch if one with this first value is before it; None if that one still is."""
        with np.errstate(invalid="ignore"):
            up, down = self.high - start >= delta, start - self.low >= delta
        i, j = int(up.argmax()), int(down.argmax())
        if up[i] and (not down[j] or self.high_at[i] <= self.low_at[j]):
            return self.after_high[i]
        return self.after_low[j] if down[j] else None

    def then(self, other: Change, delta: float) -> Change:
        """This stretch and the ``other`` after it as one."""

        def through(opened: np.ndarray) -> np.ndarray:
            out = opened.copy()
            for k in range(len(out)):
                if (now := other.on(float(out["v"][k]), delta)) is not None:
                    count = out["count"][k]
                    out[k] = now
                    out["pos"][k] += self.n
                    out["count"][k] += count
            return out

        def moved(opened: np.ndarray) -> np.ndarray:
            out = opened.copy()
            out["pos"] += self.n
            return out

        up, down = other.high > self.high[-1], other.low < self.low[-1]
        return Change(
            self.n + other.n, other.last, through(np.array([self.first], dtype=OPEN))[0],
            np.concatenate([self.high, other.high[up]]), np.concatenate([self.high_at, other.high_at[up] + self.n]), np.concatenate([through(self.after_high), moved(other.after_high[up])]),
            np.concatenate([self.low, other.low[down]]), np.concatenate([self.low_at, other.low_at[down] + self.n]), np.concatenate([through(self.after_low), moved(other.after_low[down])]),
        )


@dataclass
class Entry:
    """The frame that is open before a stretch: its first value, time, place and number; how many rows its group has before the stretch, and the time of the last."""

    v: float
    t: int
    pos: int
    number: int
    rows: int
    last: int

    @classmethod
    def after(cls, entry: Entry | None, change: Change, delta: float) -> Entry:
        rows = entry.rows if entry else 0
        now = change.on(entry.v, delta) if entry else change.first
        if now is None:
            return cls(entry.v, entry.t, entry.pos, entry.number, rows + change.n, change.last)
        return cls(float(now["v"]), int(now["t"]), int(now["pos"]) + rows, (entry.number if entry else 1) + int(now["count"]), rows + change.n, change.last)


def together(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            now = tuple("NaN" if x != x else x for x in (batch.column(k)[a].as_py() for k in range(keys)))
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


#: Values that are looked at together for the next change; doubled as long as there is none.
_STRETCH = 64


def next_change(values: np.ndarray, start: float, delta: float) -> int:
    """The place of the first value that is at least ``delta`` away from ``start``, or the number of values."""
    at, size = 0, _STRETCH
    while at < len(values):
        away = np.abs(values[at : at + size] - start) >= delta
        if away.any():
            return at + int(np.argmax(away))
        at, size = at + size, 2 * size
    return len(values)


def cut(t: np.ndarray, v: np.ndarray, entry: Entry | None, delta: float, closed_end: bool) -> tuple[list[tuple], Entry]:
    """(number, start, end, length) of the frames that end in a stretch, and the frame that is open after it."""
    out, i = [], 0
    if entry is None:
        entry, i = Entry(float(v[0]), int(t[0]), 0, 1, 0, int(t[0])), 1
    start, opened, pos, number = entry.v, entry.t, entry.pos, entry.number
    while (i := i + next_change(v[i:], start, delta)) < len(v):
        last = int(t[i - 1]) if i else entry.last
        out.append((number, opened, int(t[i]) if closed_end else last, entry.rows + i - pos))
        start, opened, pos, number = float(v[i]), int(t[i]), entry.rows + i, number + 1
        i += 1
    return out, Entry(start, opened, pos, number, entry.rows + len(v), int(t[-1]))


#: Rows of a group that is cut whole, with others in one pass; groups of more rows are dealt over stretches.
WHOLE = 1 << 16


def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (of the first column, by which the batches are sorted), and where their groups begin."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        starts = _starts(held)
        if starts[-1]:
            yield held.slice(0, int(starts[-1])), starts[:-1]
            held = held.slice(int(starts[-1])).combine_chunks()
    if held is not None:
        yield held, _starts(held)


def _starts(table: pa.Table) -> np.ndarray:
    codes = pa.concat_arrays(table.column(0).chunks).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def cut_groups(t: np.ndarray, v: np.ndarray, starts: np.ndarray, delta: float, closed_end: bool) -> tuple[np.ndarray, ...]:
    """(row of the group's beginning, number, start, end, length) of all frames of whole groups, which begin at ``starts``."""
    ends = np.append(starts[1:], len(v))
    after = np.minimum(next_rows(v, delta), np.repeat(ends, ends - starts))
    group, at, number, found = np.arange(len(starts)), starts, 1, []
    while len(at):  # the frames of each group with one number at a time
        found.append((starts[group], np.full(len(at), number), at, after[at], ends[group]))
        more = after[at] < ends[group]
        group, at, number = group[more], after[at][more], number + 1
    first, number, at, after, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    last = t[np.where(after < ends, after, after - 1)] if closed_end else t[after - 1]
    return first, number, t[at], last, after - at


def dealt(df: DataFrame, group: str, t: str, value: str, by: Column) -> DataFrame:
    """(g, b, kind, t, v, entry) of the rows with a value, dealt by group and stretch and in order."""
    rows = df.filter(F.col(value).isNotNull() & F.col(t).isNotNull())
    return rows.select(F.col(group).alias("g"), by.cast("long").alias("b"), F.lit(1).alias("kind"), F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("v"), F.lit(None).cast("binary").alias("entry"))


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _batch(values: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.record_batch(list(values.values()), names=list(values))


_OUT = {"frame_id": pa.int64(), "frame_start": pa.int64(), "frame_end": pa.int64(), "length": pa.int64()}


def frames(df: DataFrame, group: str, t: str, value: str, delta: float, by: Column, closed_end: bool = False) -> DataFrame:
    """(g, frame_id, frame_start, frame_end, length) of all frames, the last of a group too."""
    rows = dealt(df, group, t, value, by)
    g = dict(rows.dtypes)["g"]
    schema = f"g {g}, frame_id long, frame_start long, frame_end long, length long"
    large = checkpointed(rows.groupBy("g").count().filter(F.col("count") > WHOLE).select(F.col("g").alias("large")))  # fewer than one for each WHOLE rows
    is_large = F.col("g").eqNullSafe(F.col("large"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in complete(batches):
            first, *found = cut_groups(table.column("t").to_numpy(), table.column("v").to_numpy(), starts, delta, closed_end)
            yield _batch({"g": pa.concat_arrays(table.column("g").chunks).take(pa.array(first))} | {c: pa.array(x, k) for (c, k), x in zip(_OUT.items(), found, strict=True)})

    small = rows.join(F.broadcast(large), is_large, "left_anti").select("g", "t", "v")
    small = _sorted(small, ["g"], ["t", "v"]).mapInArrow(whole, schema)
    return small if large.isEmpty() else small.unionByName(_of_stretches(rows.join(F.broadcast(large), is_large, "left_semi"), delta, closed_end))


def _of_stretches(rows: DataFrame, delta: float, closed_end: bool) -> DataFrame:
    """The frames of groups that are dealt over stretches."""
    g = dict(rows.dtypes)["g"]

    def numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("t").to_numpy(), table.column("v").to_numpy()

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, 2):
            one = table.slice(0, 1)
            yield _batch({c: one.column(c).combine_chunks() for c in ("g", "b")} | {"change": pa.array([pickle.dumps(Change.of(*numbers(table), delta))], pa.binary())})

    small = _sorted(rows.select("g", "b", "t", "v"), ["g", "b"], ["t", "v"]).mapInArrow(changes, f"g {g}, b long, change binary")
    small = checkpointed(small.withColumn("c", F.floor(F.col("b") / COARSE)))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, 2):
            whole = None
            for one in table.column("change"):
                own = pickle.loads(one.as_py())
                whole = own if whole is None else whole.then(own, delta)
            yield _batch({c: table.column(c).slice(0, 1).combine_chunks() for c in ("g", "c")} | {"change": pa.array([pickle.dumps(whole)], pa.binary())})

    coarse = _sorted(small.select("g", "c", "b", "change"), ["g", "c"], ["b"]).mapInArrow(composed, f"g {g}, c long, change binary")

    def entries(keys: int, stretch: str, end: bool):
        """Entries of the stretches in order, from the first entry given (none: the group begins); at the ``end`` the open frame."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in together(batches, keys):
                entry, found, places = None, [], []
                for kind, place, given, change in zip(*(table.column(c).to_pylist() for c in ("kind", stretch, "entry", "change")), strict=True):
                    if kind == 0:
                        entry = pickle.loads(given)
                    else:
                        found.append(pickle.dumps(entry))
                        places.append(place)
                        entry = Entry.after(entry, pickle.loads(change), delta)
                if end:
                    found.append(pickle.dumps(entry))
                    places.append(None)
                key = table.column("g").slice(0, 1).combine_chunks()
                yield _batch({"g": pa.concat_arrays([key] * len(found)), "b": pa.array(places, pa.int64()), "entry": pa.array(found, pa.binary())})

        return work

    none = F.lit(None).cast("binary")
    tops = coarse.select("g", F.col("c").alias("b"), F.lit(1).alias("kind"), none.alias("entry"), "change")
    tops = checkpointed(_sorted(tops, ["g"], ["b"]).mapInArrow(entries(1, "b", True), f"g {g}, b long, entry binary"))
    given = tops.filter("b IS NOT NULL").select("g", F.col("b").alias("c"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "entry", none.alias("change"))
    inner = small.select("g", "c", F.lit(1).alias("kind"), "b", none.alias("entry"), "change").unionByName(given)
    inner = _sorted(inner, ["g", "c"], ["kind", "b"]).mapInArrow(entries(2, "b", False), f"g {g}, b long, entry binary")


    def told(key: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*found, strict=True)] or [[]] * 4
        return _batch({"g": pa.concat_arrays([key] * len(found)) if found else key.slice(0, 0)} | {c: pa.array(x, k) for (c, k), x in zip(_OUT.items(), columns, strict=True)})

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, 2):
            entry = pickle.loads(table.column("entry")[0].as_py())  # the entry comes before the rows
            yield told(table.column("g").slice(0, 1).combine_chunks(), cut(*numbers(table.slice(1)), entry, delta, closed_end)[0])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                e = pickle.loads(batch.column(1)[k].as_py())
                yield told(batch.column(0).slice(k, 1), [(e.number, e.t, e.last, e.rows - e.pos)])

    schema = f"g {g}, frame_id long, frame_start long, frame_end long, length long"
    inner = inner.select("g", "b", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("v"), "entry")
    closed = _sorted(rows.unionByName(inner), ["g", "b"], ["kind", "t", "v"]).mapInArrow(cuts, schema)
    return closed.unionByName(tops.filter("b IS NULL").select("g", "entry").mapInArrow(ends, schema))
