"""Structured Streaming: late rows, windows, partial results, stateful frames, counters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brooklet.operators.deltas import next_change


def punctuated(stream: DataFrame, t: str, delay: str) -> DataFrame:
    """Marks the time column that moves the stream on; stateful operators drop rows that are later than ``delay``."""
    return stream.withWatermark(t, delay)


def window_average(stream: DataFrame, t: str, group: str, value: str, span: str, slide: str) -> DataFrame:
    """Average for each group and window."""
    return stream.groupBy(F.window(t, span, slide), group).agg(F.avg(value).alias("avg"), F.count(value).alias("n")).select(F.col("window.end").alias("window_end"), group, "avg", "n")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads what it put out. ``mode`` append goes to files; update and complete
    keep the latest batch's row for each key in a table of the shared folder."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is tried again overwrites what it wrote.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def latest(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Of partial results, the last of each key."""
    rest = [c for c in partial.columns if c not in (*keys, "batch")]
    return partial.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, "_l.*")


_FRAME = "frame_group long, frame_id long, frame_start long, frame_end long, length long"


#: Microseconds in a millisecond.
_MICROS = 1000


def _in_time(parts: Iterator[pd.DataFrame], t: str, value: str, seen: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a micro-batch's rows in the order of time, without those that are late: at or before what the group has ``seen``.

    Groups are many and small, so that a step in pandas would cost more than the rows.
    """
    held = list(parts)
    times, values = (held[0][c].to_numpy() if len(held) == 1 else np.concatenate([part[c].to_numpy() for part in held]) for c in (t, value))
    if seen is not None and len(times) and times.min() <= seen:
        late = times <= seen
        times, values = times[~late], values[~late]
    if (times[1:] < times[:-1]).any():
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
    return times, values


def _frames_of(key: Any, out: list[tuple], marks: bool = False) -> pd.DataFrame:
    """Frames (id, start, end, length) of a group; with ``marks`` their numbers may be missing."""
    columns = zip(*out, strict=True)
    if not marks:
        found = (np.array(c, dtype=np.int64) for c in columns)
    else:
        found = (pd.arrays.IntegerArray(np.array([x or 0 for x in c], dtype=np.int64), np.array([x is None for x in c])) for c in columns)
    return pd.DataFrame(dict(zip(_COLUMNS, [[key] * len(out), *found], strict=True)), copy=False)


def _ended(state: GroupState, seen: int, idle: int | None) -> None:
    """Lets the group's state end once the watermark is ``idle`` milliseconds past its last row."""
    if idle is not None:
        state.setTimeoutTimestamp(max(seen // _MICROS + idle, state.getCurrentWatermarkMs() + 1))


def _stateful(stream: DataFrame, group: str, step, out: str, state: str, idle: int | None) -> DataFrame:
    how = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(group).applyInPandasWithState(step, out, state, "append", how)


_COLUMNS = ["frame_group", "frame_id", "frame_start", "frame_end", "length"]


def threshold_frames(stream: DataFrame, group: str, t: str, predicate: str, size: int, fragments: bool = False, idle: int | None = None, marks: bool = False) -> DataFrame:
    """Runs of 1 in a stream, put out when a 0 ends them; the open run is state, so a run over several micro-batches is one frame.

    With ``fragments`` a run that is long enough is put out at the end of each micro-batch as well: a fragment begins where the
    last one of its frame ended, and has its frame's id. Rows at or before the group's last row are late and are dropped. ``t`` is
    in microseconds; with ``idle`` (milliseconds), on a stream with a watermark, a group without rows for so long ends: its open run
    is put out, its state goes, and its frames count from 1 if it comes again. With ``marks`` each micro-batch of a group ends with a row without frame_id
    whose frame_end is the time up to which the group's frames are complete: before an open run, or, with ``fragments``, at the end of what is out of it.
    """

    def step(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # first: where the frame, or its next fragment, begins; shown: whether a fragment of it is out; seen: the last row.
        n, first, last, length, shown, seen = state.get if state.exists else (0, 0, 0, 0, False, None)
        out = []

        def close() -> None:
            nonlocal n, length, shown
            if shown and last > first:
                out.append((n, first, last, length))
            elif not shown and length >= size:
                n += 1
                out.append((n, first, last, length))
            length, shown = 0, False

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            times, held = _in_time(parts, t, predicate, seen)
            held = held != 0 if held.dtype.kind in "iub" else pd.Series(held).fillna(0).to_numpy() != 0
            edges = np.flatnonzero(np.diff(held)) + 1
            for a, b in zip([0, *edges], [*edges, len(held)], strict=True) if len(held) else ():  # stretches of rows alike
                if held[a]:
                    first = int(times[a]) if length == 0 else first
                    last, length = int(times[b - 1]), length + int(b - a)
                elif length:
                    close()
            seen = int(times[-1]) if len(times) else seen
            if fragments and length >= size and (not shown or last > first):
                n += not shown
                out.append((n, first, last, length))
                first, shown = last, True
            if marks and seen is not None:
                out.append((None, None, seen if not length else last if shown else first - 1, None))
            if seen is not None:
                state.update((int(n), int(first), int(last), length, shown, int(seen)))
                _ended(state, int(seen), idle)
        if out:
            yield _frames_of(key[0], out, marks)

    return _stateful(stream, group, step, _FRAME, "n long, first long, last long, length long, shown boolean, seen long", idle)


def delta_frames(stream: DataFrame, group: str, t: str, value: str, delta: float, idle: int | None = None) -> DataFrame:
    """Frames that end where the value has moved by ``delta`` from their first one, put out when they end.

    Late rows and ``idle`` as in ``threshold_frames``.
    """

    def step(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, length, start = state.get if state.exists else (0, 0, None, 0, 0.0)
        out = []
        if state.hasTimedOut:
            out.append((n + 1, first, last, length))
            state.remove()
        else:
            times, values = _in_time(parts, t, value, last)
            values = values.astype(float)
            i = 0
            while i < len(values):
                if length == 0:
                    first, start = int(times[i]), float(values[i])
                end = i + next_change(values[i:], start, delta)
                if end > i:
                    last, length = int(times[end - 1]), length + end - i
                if end < len(values):
                    n += 1
                    out.append((n, first, last, length))
                    length = 0
                i = end
            if last is not None:
                state.update((n, first, last, length, start))
                _ended(state, last, idle)
        if out:
            yield _frames_of(key[0], out)

    return _stateful(stream, group, step, _FRAME, "n long, first long, last long, length long, start double", idle)


def running_max(stream: DataFrame, group: str, t: str, value: str, idle: int | None = None) -> DataFrame:
    """A row whenever a group's maximum rises. Late rows and ``idle`` as in ``threshold_frames``."""

    def step(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, seen = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            return
        times, values = _in_time(parts, t, value, seen)
        values = values.astype(float)
        values = values[~np.isnan(values)]
        # A maximum that is not there yet is NaN, which Spark reads as null.
        highs = np.fmax.accumulate(np.concatenate([[np.nan if high is None else high], values]))
        rose = np.flatnonzero(~(highs[1:] <= highs[:-1]))
        if len(times):
            seen, high = int(times[-1]), float(highs[-1])
            state.update((None if math.isnan(high) else high, seen))
            _ended(state, seen, idle)
        if len(rose):
            yield pd.DataFrame({"key": [key[0]] * len(rose), "old_max": highs[rose], "new_max": highs[rose + 1]}, copy=False)

    return _stateful(stream, group, step, "key long, old_max double, new_max double", "high double, seen long", idle)


def counters(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(stream, counter, value) of a stream over the batches that ``spark.sql.streaming.numRecentProgressUpdates`` keeps: rows in, batches, rows of state
    (open groups) now, late rows dropped. ``watch`` counts over all batches."""
    done = query.recentProgress
    states = [o for p in done for o in p.stateOperators]
    last = done[-1].stateOperators if done else []
    found = {"rows_in": sum(p.numInputRows for p in done), "batches": len(done), "state_rows": sum(o.numRowsTotal for o in last), "late_rows": sum(o.numRowsDroppedByWatermark for o in states)}
    return spark.createDataFrame([(query.name or str(query.id), k, int(v)) for k, v in found.items()], "stream string, counter string, value long")


def counted(df: DataFrame, operator: str) -> DataFrame:
    """Counts the rows that leave an operator of a stream, by micro-batch; see ``operator_counters``."""
    return df.observe(f"{_OPERATOR}{operator}", F.count(F.lit(1)).alias("rows"))


_OPERATOR = "operator:"


def operator_counters(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(operator, rows, batches, rows_per_second) of a stream's ``counted`` operators, over the micro-batches that ``recentProgress`` keeps; the rate is that of the time in which they ran."""
    rows: dict[str, list[int]] = {}
    spent = 0.0
    for p in query.recentProgress:
        spent += p.batchDuration / 1000
        for name, metrics in p.observedMetrics.items():
            if name.startswith(_OPERATOR):
                rows.setdefault(name.removeprefix(_OPERATOR), []).append(int(metrics["rows"]))
    found = [(name, sum(n), len(n), sum(n) / spent if spent else None) for name, n in sorted(rows.items())]
    return spark.createDataFrame(found, "operator string, rows long, batches long, rows_per_second double")


class Progress(StreamingQueryListener):
    """Counters of running streams, by stream name: rows in, batches, rows of state (open groups) and late rows dropped."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.state_rows: dict[str, int] = {}
        self.late_rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.batches[name] = self.batches.get(name, 0) + 1
        self.state_rows[name] = sum(o.numRowsTotal for o in p.stateOperators)
        self.late_rows[name] = self.late_rows.get(name, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def watch(spark: SparkSession) -> Progress:
    """Starts counting; ``spark.streams.removeListener`` ends it."""
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
