"""Operators on streams that keep rows until time decides about them: joins with purge, ticks, hold and release, filling of open frames.

Times (``t``) are microseconds; marks and watermarks go by whole milliseconds, as Spark's do. Each operator but ``join`` keeps its rows in the state of a
``transformWithState`` processor, which needs the RocksDB state store (``rocks``); a row in state is its JSON, so that nothing is lost in pandas.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brooklet.functions.columns import div

# Spark looks at a processor in a process of its own, which doesn't get the files that workers get.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MILLI = 1000
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _plain(schema: T.StructType) -> T.StructType:
    """The schema without the mark of event time."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _only_time(df: DataFrame) -> DataFrame:
    """No row of ``df``, whose time ``_at`` moves the watermark all the same."""
    return df.filter(F.unix_micros("_at") < -(1 << 62))


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _JSON)


def _back(df: DataFrame, column: str, schema: T.StructType, *added: str) -> DataFrame:
    return df.withColumn("_r", F.from_json(column, _plain(schema), _JSON)).select("_r.*", *added)


def join(left: DataFrame, right: DataFrame, pairs: Mapping[str, str], t: tuple[str, str], before: int, after: int, delay: str, residual: Column | None = None, stretch: int | None = None) -> DataFrame:
    """Inner join of two streams on pairs of columns, for rows of the right from ``before`` before the left row's time to ``after`` after it.

    ``t``: the time columns of left and right (microseconds). Each side has a watermark, ``delay`` behind its latest time, and rows go from the state
    once no row of the other side that is still to come can meet them. 0 and 0 join rows of equal times. Rows meet by key and ``stretch`` of time, so that
    a frequent key is dealt over many tasks. Columns of the right side get the prefix ``r_``.
    """
    step = stretch or max(before + after, 3_600_000_000)
    l = left.withColumn("_lt", F.timestamp_micros(t[0])).withWatermark("_lt", delay).withColumn("_b", div(t[0], step))
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    low, high = div(F.col(f"r_{t[1]}") - after, step), div(F.col(f"r_{t[1]}") + before, step)
    r = r.withColumn("_rt", F.timestamp_micros(f"r_{t[1]}")).withWatermark("_rt", delay).withColumn("_rb", F.explode(F.sequence(low, high)))
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"r_{b}") for a, b in pairs.items()], F.col("_b") == F.col("_rb"))
    near = (F.col("_rt") >= F.col("_lt") - F.expr(f"make_dt_interval(0, 0, 0, {before / 1e6:.6f})")) & (F.col("_rt") <= F.col("_lt") + F.expr(f"make_dt_interval(0, 0, 0, {after / 1e6:.6f})"))
    joined = l.join(r, on & near, "inner")
    return (joined if residual is None else joined.filter(residual)).drop("_lt", "_rt", "_b", "_rb")


def _emit(columns: list[str], *values: Any) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(columns, values, strict=True)), columns=columns)


class _Ticks(StatefulProcessor):
    """Rows after the last tick, and a mark for each tick that follows; the watermark is the last tick."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "tick long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tick, some = timerValues.getCurrentWatermarkInMs(), False
        for part in rows:
            part = part[part["t"] >= (tick + 1) * MILLI] if tick > 0 else part[:0]
            if len(part):
                some = True
                yield _emit(["lane", "tick", "mark", "row"], key[0], tick, None, part["row"].to_numpy())
        if some and not self.last.exists():
            self.last.update((tick,))
            self.handle.registerTimer(tick + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick = timerValues.getCurrentWatermarkInMs()
        yield _emit(["lane", "tick", "mark", "row"], [key[0]], [tick], [self.last.get()[0]], [None])
        self.last.update((tick,))
        self.handle.registerTimer(tick + 1)

    def close(self) -> None:
        pass


def punctuate(data: DataFrame, ticks: DataFrame, lane: Column, t: str, tick: str) -> DataFrame:
    """Merges a stream with a timer: each row gets the last ``tick`` before it; rows at or before that tick are late and go, as do all rows before the first tick.

    ``ticks`` has times (``tick``, milliseconds); those of one micro-batch count together from the next one on, by their latest. The rows are dealt over lanes
    (a whole number, of a few values). When a tick follows, a lane that has had rows tells by a ``mark`` that none up to the tick before will come (the
    data columns are null then); a mark holds for the stream once all lanes have told it.
    """
    rows = data.select(F.lit(None).cast("timestamp").alias("_at"), lane.cast("long").alias("lane"), F.col(t).cast("long").alias("t"), _row(data).alias("row"))
    beats = ticks.select(F.timestamp_millis(tick).alias("_at")).withWatermark("_at", "0 seconds").select("_at", F.lit(-1).cast("long").alias("lane"), F.lit(0).cast("long").alias("t"), F.lit(None).cast("string").alias("row"))
    # The ticks come first: a union's time column is its first input's.
    found = _only_time(beats).unionByName(rows).groupBy("lane").transformWithStateInPandas(_Ticks(), "lane long, tick long, mark long, row string", "Append", "EventTime")
    return _back(found, "row", data.schema, "lane", "tick", "mark")


class _Hold(StatefulProcessor):
    """Keeps the rows of a stretch of time until the watermark has passed its end."""

    def __init__(self, stretch: int):
        self.stretch = stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "t long, side string, row string")

    def _out(self, key: tuple, rows: list[tuple], at: int) -> pd.DataFrame:
        rows = sorted(rows)
        return _emit(["side", "row", "released"], [r[1] for r in rows], [r[2] for r in rows], at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end, now = -(-(key[0] + 1) * self.stretch // MILLI), timerValues.getCurrentWatermarkInMs()
        new = [r for part in rows for r in part[["t", "side", "row"]].itertuples(index=False, name=None)]
        if new and end <= now:
            yield self._out(key, new, now)
        elif new:
            first = not self.held.exists()
            self.held.appendList(new)
            if first:
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._out(key, list(self.held.get()), timerValues.getCurrentWatermarkInMs())
        self.held.clear()

    def close(self) -> None:
        pass


def _side(df: DataFrame, side: str, t: str, stretch: int, lane: Column, at: Column) -> DataFrame:
    return df.select(at.alias("_at"), div(t, stretch).alias("stretch"), lane.cast("long").alias("lane"), F.col(t).cast("long").alias("t"), F.lit(side).alias("side"), _row(df).alias("row"))


def _held(rows: DataFrame, stretch: int) -> DataFrame:
    return rows.groupBy("stretch", "lane").transformWithStateInPandas(_Hold(stretch), "side string, row string, released long", "Append", "EventTime")


def synchronize(left: DataFrame, right: DataFrame, t: str, right_t: str, stretch: int, delay: str = "0 seconds", lane: Column | None = None) -> DataFrame:
    """(side, left, right, released): the rows of two streams, held until both have passed the end of their stretch of time, and then put out in its order.

    ``side`` is left or right, and so is the struct with the row; ``released``: the watermark (milliseconds) that let it go, which is that of the stream behind.
    Within a stretch a row comes after those with an earlier time; ``lane`` deals the rows of a stretch over several tasks. A row that comes after its stretch was put out goes out at once;
    Spark drops it instead if it is behind the watermark of the micro-batch before.
    """
    lane = F.lit(0) if lane is None else lane
    sides = [_side(df, name, c, stretch, lane, F.timestamp_micros(c)).withWatermark("_at", delay) for df, name, c in ((left, "left", t), (right, "right", right_t))]
    found = _held(sides[0].unionByName(sides[1]), stretch)
    rows = [F.when(F.col("side") == name, F.from_json("row", _plain(df.schema), _JSON)).alias(name) for name, df in (("left", left), ("right", right))]
    return found.select("side", *rows, "released")


def present(left: DataFrame, right: DataFrame, t: str, right_t: str, stretch: int, delay: str = "0 seconds", lane: Column | None = None) -> DataFrame:
    """The left rows, held until the right stream has passed the end of their stretch of time; adds ``released``. A row that comes after that goes out at once."""
    marks = right.select(F.timestamp_micros(right_t).alias("_at")).withWatermark("_at", delay)
    marks = marks.select("_at", *[F.lit(None).cast(k).alias(c) for c, k in (("stretch", "long"), ("lane", "long"), ("t", "long"), ("side", "string"), ("row", "string"))])
    rows = _side(left, "left", t, stretch, F.lit(0) if lane is None else lane, F.lit(None).cast("timestamp"))
    return _back(_held(_only_time(marks).unionByName(rows), stretch), "row", left.schema, "released")


_ROW, _FRAME, _MARK = 0, 1, 2


class _Fill(StatefulProcessor):
    """Rows and frames of one group, until each row is in a frame or the frames are told to be complete up to its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows, self.frames = handle.getListState("rows", "t long, row string"), handle.getListState("frames", "start long, end long, id long")
        self.mark = handle.getValueState("mark", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        kind, t, end, number, row = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("kind", "t", "end", "id", "row"))
        # What is not there is empty; asking whether it is would be one more call for each group.
        held, known, mark = list(self.rows.get()), list(self.frames.get()), self.mark.get()
        mark = None if mark is None else mark[0]
        own, framed, marks = (np.flatnonzero(kind == k) for k in (_ROW, _FRAME, _MARK))
        if len(marks):
            mark = max(int(end[marks].max()), int(end[marks].max()) if mark is None else mark)
            self.mark.update((mark,))
        frames = sorted({*known, *zip(t[framed].tolist(), end[framed].tolist(), number[framed].tolist(), strict=True)})
        every = held + list(zip(t[own].tolist(), row[own].tolist(), strict=True))
        frame = first_frames(np.array([t for t, _ in every], dtype=np.int64), frames)
        hit = np.flatnonzero(frame >= 0)
        if len(hit):
            yield _emit(["frame_id", "row"], [frames[frame[k]][2] for k in hit], [every[k][1] for k in hit])
        left = [r for r, f in zip(every, frame, strict=True) if f < 0 and (mark is None or r[0] > mark)]
        if left != held:
            self.rows.put(left) if left else self.rows.clear()
        # No row before the watermark comes any more.
        kept = [f for f in frames if f[1] >= timerValues.getCurrentWatermarkInMs() * MILLI]
        if kept != known:
            self.frames.put(kept) if kept else self.frames.clear()

    def close(self) -> None:
        pass


def first_frames(t: np.ndarray, frames: list[tuple[int, int, int]]) -> np.ndarray:
    """The first of the ``frames`` (start, end, id; sorted) that holds each time, or -1."""
    out = np.full(len(t), -1)
    if not frames or not len(t):
        return out
    start, end = np.array([f[0] for f in frames]), np.array([f[1] for f in frames])
    upto = np.searchsorted(start, t, "right")  # frames that begin at or before
    reach = np.maximum.accumulate(end)
    at = np.searchsorted(reach, t, "left")  # the first frame by which the frames reach to the time is the first that holds it, if it has begun
    inside = (at < upto) & (at < len(frames))
    out[inside] = at[inside]
    return out


def fill_frames(rows: DataFrame, frames: DataFrame, group: str, t: str, delay: str = "0 seconds") -> DataFrame:
    """Adds ``ff_frame_id`` to the rows of a stream: the first frame of the row's group with start <= t <= end; rows in no frame go.

    ``frames`` is a stream of frame_group, frame_id, frame_start, frame_end, in which a row without frame_id marks that the group's frames up to
    frame_end are complete (``threshold_frames`` with ``marks``). A row waits in the state until a frame holds it or a mark says that none will; a frame
    waits until the rows' watermark, ``delay`` behind their latest time, has passed its end. Rows behind the watermark are late and go.
    """
    none = F.lit(0).cast("long")
    own = rows.select(F.timestamp_micros(t).alias("_at"), F.lit(_ROW).alias("kind"), F.col(group).cast("long").alias("g"), F.col(t).cast("long").alias("t"), none.alias("end"), none.alias("id"), _row(rows).alias("row")).withWatermark("_at", delay)
    mark, end = F.col("frame_id").isNull(), F.col("frame_end").cast("long").alias("end")
    told = frames.select(F.lit(None).cast("timestamp").alias("_at"), F.when(mark, _MARK).otherwise(_FRAME).alias("kind"), F.col("frame_group").cast("long").alias("g"), F.coalesce("frame_start", "frame_end").cast("long").alias("t"), end, F.coalesce(F.col("frame_id").cast("long"), none).alias("id"), F.lit(None).cast("string").alias("row"))
    found = own.unionByName(told).groupBy("g").transformWithStateInPandas(_Fill(), "frame_id long, row string", "Append", "EventTime")
    return _back(found.withColumnRenamed("frame_id", "ff_frame_id"), "row", rows.schema, "ff_frame_id")
