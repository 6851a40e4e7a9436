"""Streams over several micro-batches."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brooklet.sources.generated import file_stream, rate_source
from brooklet.streaming import streams as s


def _stream(spark, where, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        time.sleep(0.05)
    return file_stream(spark, f"{where}/in", spark.createDataFrame([], schema).schema)


def test_a_run_over_micro_batches_is_one_frame(spark, tmp_path):
    runs = [[(1, 1, 1), (1, 2, 1)], [(1, 3, 1), (1, 4, 0), (1, 5, 1)], [(1, 6, 0)]]
    stream = _stream(spark, tmp_path, runs, "g long, t long, p int")
    found = s.run_once(s.threshold_frames(stream, "g", "t", "p", 2), str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 3, 3)]


def test_fragments_have_the_id_of_their_frame(spark, tmp_path):
    runs = [[(1, 1, 1), (1, 2, 1)], [(1, 3, 1), (1, 4, 1)], [(1, 5, 0), (1, 6, 1), (1, 7, 1), (1, 8, 0)]]
    stream = _stream(spark, tmp_path, runs, "g long, t long, p int")
    found = s.run_once(s.threshold_frames(stream, "g", "t", "p", 2, fragments=True), str(tmp_path))
    assert sorted((r["frame_id"], r["frame_start"], r["frame_end"]) for r in found.collect()) == [(1, 1, 2), (1, 2, 4), (2, 6, 7)]


def test_delta_frames_over_micro_batches(spark, tmp_path):
    rows = [[(1, 1, 50.0), (1, 2, 48.0)], [(1, 3, 50.0), (1, 4, 57.0)], [(1, 5, 55.0), (1, 6, 59.0), (1, 7, 63.0)]]
    stream = _stream(spark, tmp_path, rows, "g long, t long, v double")
    found = s.run_once(s.delta_frames(stream, "g", "t", "v", 5.0), str(tmp_path))
    assert sorted((r["frame_id"], r["frame_start"], r["frame_end"]) for r in found.collect()) == [(1, 1, 3), (2, 4, 6)]


def test_running_max_and_counters(spark, tmp_path):
    rows = [[(1, 1, 5.0), (1, 2, 3.0)], [(1, 3, 6.0)], [(1, 4, 6.0), (2, 4, 1.0)]]
    stream = _stream(spark, tmp_path, rows, "g long, t long, v double")
    watch = s.watch(spark)
    found = s.run_once(s.running_max(stream, "g", "t", "v"), str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, None, 5.0), (1, 5.0, 6.0), (2, None, 1.0)], key=str)
    for _ in range(50):
        if sum(watch.rows.values()) == 5:
            break
        time.sleep(0.1)
    spark.streams.removeListener(watch)
    assert sum(watch.rows.values()) == 5


def test_partial_results_end_at_the_whole_result(spark, tmp_path):
    rows = [[(1, 10, 1.0), (1, 20, 3.0)], [(1, 30, 5.0)]]
    stream = _stream(spark, tmp_path, rows, "g long, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    out = s.run_once(s.window_average(s.punctuated(stream, "ts", "1 minute"), "ts", "g", "v", "1 minute", "1 minute"), str(tmp_path), "update")
    assert out.count() == 2 and [r["avg"] for r in s.latest(out, ["window_end", "g"]).collect()] == [3.0]


def test_rate_source_is_a_stream(spark):
    assert rate_source(spark, 5).isStreaming


def test_late_rows_are_dropped(spark, tmp_path):
    runs = [[(1, 10, 1), (1, 11, 1), (1, 12, 1)], [(1, 5, 1), (1, 12, 0), (1, 6, 0)], [(1, 13, 1), (1, 14, 0)]]
    stream = _stream(spark, tmp_path, runs, "g long, t long, p int")
    found = s.run_once(s.threshold_frames(stream, "g", "t", "p", 2), f"{tmp_path}/a")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 10, 13, 4)]
    found = s.run_once(s.running_max(stream.withColumn("v", stream["t"].cast("double")), "g", "t", "v"), f"{tmp_path}/b")
    assert [r["new_max"] for r in found.orderBy("new_max").collect()] == [10.0, 11.0, 12.0, 13.0, 14.0]
    found = s.run_once(s.delta_frames(stream.withColumn("v", stream["t"].cast("double")), "g", "t", "v", 2.0), f"{tmp_path}/c")
    assert sorted((r["frame_start"], r["frame_end"]) for r in found.collect()) == [(10, 11), (12, 13)]


def test_idle_groups_end_and_leave_no_state(spark, tmp_path):
    second = 1_000_000
    runs = [[(1, second, 1), (1, 2 * second, 1)], [(2, 100 * second, 1)], [(2, 101 * second, 1)], [(1, 102 * second, 1)]]
    stream = _stream(spark, tmp_path, runs, "g long, t long, p int").withColumn("ts", F.timestamp_micros("t"))
    watch = s.watch(spark)
    found = s.run_once(s.threshold_frames(s.punctuated(stream, "ts", "1 second"), "g", "t", "p", 2, idle=10_000), str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 1, second, 2 * second, 2)]
    for _ in range(50):
        if sum(watch.rows.values()) == 5:
            break
        time.sleep(0.1)
    spark.streams.removeListener(watch)
    assert sum(watch.rows.values()) == 5 and sum(watch.batches.values()) >= 3 and set(watch.state_rows.values()) == {2}


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    """The state forgets that the last batch was done, as after a crash between its output and its commit."""
    import pathlib

    stream = _stream(spark, tmp_path, [[(1, 10, 1.0)], [(1, 20, 3.0)]], "g long, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    run = lambda: s.run_once(s.window_average(s.punctuated(stream, "ts", "1 minute"), "ts", "g", "v", "1 minute", "1 minute"), str(tmp_path), "update")
    before = run().count()
    done = sorted((f for f in pathlib.Path(f"{tmp_path}/state/commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    for f in (done[-1], done[-1].with_name(f".{done[-1].name}.crc")):
        f.unlink(missing_ok=True)
    assert run().count() == before


def test_a_groups_step_is_done_in_arrays(monkeypatch):
    """Groups are many and small: no step joins, filters or sorts data frames."""
    parts = [pd.DataFrame({"g": 1, "t": [5, 3, 9], "v": [1.0, np.nan, 4.0]}), pd.DataFrame({"g": 1, "t": [4, 9], "v": [2.0, 5.0]})]

    def refused(*a, **k):
        raise AssertionError("a data frame for each group")

    monkeypatch.setattr(pd, "concat", refused)
    monkeypatch.setattr(pd.DataFrame, "sort_values", refused)
    times, values = s._in_time(iter(parts), "t", "v", 3)
    assert times.tolist() == [4, 5, 9, 9] and values.tolist() == [2.0, 1.0, 4.0, 5.0]
    times, values = s._in_time(iter(parts[:1]), "t", "v", None)
    assert times.tolist() == [3, 5, 9] and np.isnan(values[0])
    assert [len(x) for x in s._in_time(iter(parts), "t", "v", 9)] == [0, 0]
    found = s._frames_of(7, [(1, 2, 3, 4), (None, None, 5, None)], marks=True)
    assert found["frame_group"].tolist() == [7, 7] and found["frame_end"].tolist() == [3, 5] and found["frame_id"].isna().tolist() == [False, True]
