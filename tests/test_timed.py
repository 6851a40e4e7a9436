"""Streams that keep rows until time decides about them."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brooklet.sources.generated import file_stream
from brooklet.streaming import streams as s
from brooklet.streaming import timed

SECOND = 1_000_000


def _stream(spark, where, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        time.sleep(0.05)
    return file_stream(spark, where, spark.createDataFrame([], schema).schema)


def _run(spark, df, where):
    """The rows put out, and for each micro-batch the rows in state and those dropped as late."""
    with timed.rocks(spark):
        query = df.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    state = [(sum(o.numRowsTotal for o in p.stateOperators), sum(o.numRowsDroppedByWatermark for o in p.stateOperators)) for p in query.recentProgress]
    return sorted(map(tuple, spark.read.schema(df.schema).parquet(f"{where}/out").collect()), key=str), state


def test_join_of_streams_forgets_what_can_meet_nothing(spark, tmp_path):
    left = _stream(spark, f"{tmp_path}/l", [[(1, 1), (2, 12)], [(1, 13), (4, 29)], [(5, 100)], [(5, 101)]], "id long, s long").withColumn("t", F.col("s") * SECOND)
    right = _stream(spark, f"{tmp_path}/r", [[(1, 2), (1, 16)], [(2, 20), (2, 21)], [(4, 26), (4, 25)], [(9, 102)]], "rid long, s long").withColumn("t", F.col("s") * SECOND)
    joined = timed.join(left, right, {"id": "rid"}, ("t", "t"), 3 * SECOND, 8 * SECOND, "20 seconds")
    found, state = _run(spark, joined.select("id", "s", "r_s"), f"{tmp_path}/o")
    assert found == [(1, 1, 2), (1, 13, 16), (2, 12, 20), (4, 29, 26)]
    rows = [n for n, _ in state]
    assert max(rows) >= 8 and rows[-1] <= 3 and state[-1][1] == 0


def test_join_of_equal_times_and_a_residual(spark, tmp_path):
    left = _stream(spark, f"{tmp_path}/l", [[(1, 5), (2, 5)], [(1, 9)]], "id long, t long")
    right = _stream(spark, f"{tmp_path}/r", [[(1, 5), (2, 6)], [(1, 9), (1, 9)]], "id long, t long")
    joined = timed.join(left, right, {"id": "id"}, ("t", "t"), 0, 0, "1 second", residual=F.col("t") > 1)
    assert _run(spark, joined, f"{tmp_path}/o")[0] == [(1, 5, 1, 5), (1, 9, 1, 9), (1, 9, 1, 9)]


def test_ticks(spark, tmp_path):
    data = _stream(spark, f"{tmp_path}/d", [[(1, 1), (2, 2)], [(3, 3), (4, 9), (5, 10)], [(6, 10), (7, 25), (8, 19), (None, 30)]], "id long, s long")
    data = data.withColumn("t", F.col("s") * SECOND)
    ticks = _stream(spark, f"{tmp_path}/t", [[(5000,)], [(10_000,), (15_000,)], [(20_000,)]], "tick long")
    found, state = _run(spark, timed.punctuate(data, ticks, F.coalesce(F.col("id") % 2, F.lit(0)), "t", "tick").select("id", "lane", "tick", "mark"), f"{tmp_path}/o")
    # 1 and 2 come before the first tick, 3 and 6 at or before the last one.
    rows = [(4, 0, 5000, None), (5, 1, 5000, None), (7, 1, 15_000, None), (8, 0, 15_000, None), (None, 0, 15_000, None)]
    marks = [(None, lane, t, m) for lane in (0, 1) for t, m in ((15_000, 5000), (20_000, 15_000))]
    assert found == sorted(rows + marks, key=str)
    assert all(late == 0 for _, late in state)  # a row is late by ticks alone


def test_rows_wait_for_both_streams(spark, tmp_path):
    left = _stream(spark, f"{tmp_path}/l", [[(1, 1), (2, 12)], [(3, 13), (4, 29)], [(5, 35)]], "id long, s long").withColumn("t", F.col("s") * SECOND)
    right = _stream(spark, f"{tmp_path}/r", [[("a", 2)], [("b", 20)], [("c", 40), ("d", 28), ("e", 3)]], "name string, s long").withColumn("t", F.col("s") * SECOND)
    found, state = _run(spark, timed.synchronize(left, right, "t", "t", 10 * SECOND).select("side", F.coalesce(F.col("left.id").cast("string"), "right.name").alias("id"), "released"), f"{tmp_path}/o")
    assert found == [("left", "1", 20_000), ("left", "2", 20_000), ("left", "3", 20_000), ("left", "4", 35_000), ("right", "a", 20_000), ("right", "b", 35_000), ("right", "d", 35_000), ("right", "e", 20_000)]
    assert state[-1][0] < max(n for n, _ in state)
    found, state = _run(spark, timed.present(left, right, "t", "t", 10 * SECOND).select("id", "released"), f"{tmp_path}/p")
    assert found == [(1, 20_000), (2, 20_000), (3, 20_000), (4, 40_000), (5, 40_000)] and state[-1][0] == 0


def test_a_row_after_its_time_is_present_at_once(spark, tmp_path):
    left = _stream(spark, f"{tmp_path}/l", [[(1, 15)], [(2, 1), (3, 25)]], "id long, s long").withColumn("t", F.col("s") * SECOND)
    right = _stream(spark, f"{tmp_path}/r", [[(20,)], [(22,)]], "s long").withColumn("t", F.col("s") * SECOND)
    assert _run(spark, timed.present(left, right, "t", "t", 10 * SECOND).select("id", "released"), f"{tmp_path}/p")[0] == [(1, 20_000), (2, 20_000)]


def test_rows_wait_for_frames_and_marks(spark, tmp_path):
    rows = _stream(spark, f"{tmp_path}/r", [[(1, 1, 1), (1, 2, 12), (2, 9, 1)], [(1, 3, 13), (1, 4, 29)], [(1, 5, 35)]], "g long, id long, s long").withColumn("t", F.col("s") * SECOND)
    frames = [[(1, 1, 1, 2)], [(1, None, None, 12), (1, 2, 13, 30), (2, 5, 0, 1)], [(1, None, None, 34)]]
    frames = _stream(spark, f"{tmp_path}/f", frames, "frame_group long, frame_id long, frame_start long, frame_end long")
    frames = frames.withColumns({c: F.col(c) * SECOND for c in ("frame_start", "frame_end")})
    found, state = _run(spark, timed.fill_frames(rows, frames, "g", "t").select("g", "id", "ff_frame_id"), f"{tmp_path}/o")
    assert found == [(1, 1, 1), (1, 3, 2), (1, 4, 2), (2, 9, 5)]  # the row at 12 is in no frame, the one at 35 still waits


def test_columns_pass_as_they_are(spark, tmp_path):
    schema = "id long, t long, at timestamp, price decimal(10,2), list array<string>, x double"
    row = (1 << 60, SECOND, None, None, ["a", None, 'quo"te'], 0.1)
    left = _stream(spark, f"{tmp_path}/l", [[row], [(2, 30 * SECOND, None, None, None, float("nan"))]], schema).withColumn("at", F.timestamp_micros(F.lit(1_234_567)))
    right = _stream(spark, f"{tmp_path}/r", [[(20 * SECOND,)]], "t long")
    found = _run(spark, timed.present(left, right, "t", "t", 10 * SECOND), f"{tmp_path}/o")[0]
    assert [(r[0], r[1], r[2].microsecond, r[3], r[4], r[5], r[6]) for r in found] == [(1 << 60, SECOND, 234_567, None, ["a", None, 'quo"te'], 0.1, 20_000)]


def test_the_first_frame_of_a_time():
    rng = random.Random(1)
    for _ in range(200):
        frames = sorted({(a := rng.randint(0, 20), a + rng.randint(0, 6), k) for k in range(rng.randint(0, 6))})
        t = np.arange(25)
        expected = [next((k for k, (a, b, _) in enumerate(frames) if a <= x <= b), -1) for x in t]
        assert timed.first_frames(t, frames).tolist() == expected


def test_marks_of_open_runs(spark, tmp_path):
    runs = [[(1, 1, 1), (1, 2, 1), (2, 1, 1)], [(1, 3, 1), (1, 4, 0), (2, 2, 0), (2, 3, 1)], [(1, 5, 1)]]
    stream = _stream(spark, f"{tmp_path}/in", runs, "g long, t long, p int")
    found = s.run_once(s.threshold_frames(stream, "g", "t", "p", 2, fragments=True, marks=True), str(tmp_path))
    told = sorted(((r["frame_group"], r["frame_id"], r["frame_start"], r["frame_end"]) for r in found.collect()), key=str)
    marks = [(1, None, None, 2), (1, None, None, 4), (1, None, None, 4), (2, None, None, 0), (2, None, None, 2)]
    assert told == sorted([(1, 1, 1, 2), (1, 1, 2, 3), *marks], key=str)


class _State:
    """A list or a value of one group, without asking first whether it is there."""

    def __init__(self, value):
        self.value = value

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, value):
        self.value = list(value)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = []


def test_filling_asks_for_each_state_once():
    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    fill = timed._Fill()
    fill.rows, fill.frames, fill.mark = _State([]), _State([]), _State(None)
    rows = pd.DataFrame({"kind": [0, 0, 0, 1, 2], "t": [5, 1, 30, 4, 0], "end": [0, 0, 0, 9, 20], "id": [0, 0, 0, 6, 0], "row": ["a", "b", "c", None, None]})
    found = [tuple(r) for part in fill.handleInputRows((1,), iter([rows[:2], rows[2:]]), Timers()) for r in part.itertuples(index=False)]
    assert found == [(6, "a")] and fill.rows.value == [(30, "c")] and fill.frames.value == [(4, 9, 6)] and fill.mark.value == (20,)
