"""Feedback between micro-batches, archives driven by a stream, the firehose, counters of operators."""

from __future__ import annotations

import io
import pathlib
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from brooklet.sources import firehose
from brooklet.streaming import feedback
from brooklet.streaming import streams as s


def _put(spark, where, rows):
    spark.createDataFrame(rows, "id long, t long").withColumn("hour", F.expr("t div 10")).coalesce(1).write.mode("append").partitionBy("hour").parquet(where)
    return spark.readStream.schema("id long, t long, hour long").option("maxFilesPerTrigger", 1000).parquet(where)


def _spoil(folder):
    for file in pathlib.Path(folder).glob("*.parquet"):
        (file.parent / f".{file.name}.crc").unlink()
        file.write_bytes(b"not a Parquet file")


def test_a_lagging_input_is_told_to_skip_and_its_files_are_not_opened(spark, tmp_path):
    schema = "id long, t long, hour long"
    for name, divergence in (("fed", 20), ("free", 1000)):
        where = f"{tmp_path}/{name}"
        _put(spark, f"{where}/l", [(1, 1), (2, 100)])
        _put(spark, f"{where}/r", [(3, 5)])
        run = feedback.pace(spark, {"left": f"{where}/l", "right": f"{where}/r"}, spark.createDataFrame([], schema).schema, "t", divergence, f"{where}/p", "hour", 10)
        assert run().count() == 3
        _put(spark, f"{where}/r", [(0, 40), (4, 7), (5, 99), (6, 101), (7, 130)])
        _put(spark, f"{where}/l", [(8, 3)])
        _spoil(f"{where}/r/hour=4")
        if name == "free":
            with pytest.raises(StreamingQueryException):
                run()
            continue
        found = sorted((r["side"], r["id"]) for r in run().collect())
        assert found == [("left", 1), ("left", 2), ("left", 8), ("right", 3), ("right", 6), ("right", 7)]
        assert feedback.Feedback(spark, f"{where}/p").before(2) == {"left": (100, 130), "right": (130, 100)}


def test_bounds_only_rise():
    none = feedback.advanced({}, {"l": 5, "r": None}, 3)
    assert none == {"l": (5, None), "r": (None, None)}
    one = feedback.advanced(none, {"l": None, "r": 1}, 3)
    assert one == {"l": (5, None), "r": (1, 5)}
    assert feedback.advanced(one, {"l": 4, "r": 2}, 3) == {"l": (5, None), "r": (2, 5)}
    assert feedback.advanced(one, {"l": 9, "r": 20}, 3) == {"l": (9, 20), "r": (20, 5)}


def test_only_the_partitions_asked_for_are_read(spark, tmp_path):
    spark.range(1000).select("id", F.expr("id div 10").alias("hour")).repartition(1).write.partitionBy("hour").parquet(f"{tmp_path}/archive")
    archive = spark.read.schema("id long, hour long").parquet(f"{tmp_path}/archive")
    for hour in (4, 50, 99):
        _spoil(f"{tmp_path}/archive/hour={hour}")
    rows = _put(spark, f"{tmp_path}/in", [(1, 35), (2, 36), (3, None), (4, 90)])
    run = feedback.asking(rows, archive, "hour", lambda r: F.expr("t div 10"), lambda r, found: found, f"{tmp_path}/w")
    assert sorted(r["id"] for r in run().collect()) == [*range(30, 40), *range(90, 100)]
    again = feedback.asked_for(spark, archive, "hour", f"{tmp_path}/w", 0)
    assert again.count() == 20
    assert "dynamicpruning" in again._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="Parquet|parquet|CANNOT_READ"):
        archive.agg(F.sum("id")).collect()


def test_lines_of_pieces():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 60))).encode()
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(4))})
        for block in (1, 3, 100):
            found = [line for a, b in zip(cuts[:-1], cuts[1:], strict=True) for line in firehose.lines(firehose._Lines(io.BytesIO(text), block), a, b)]
            assert found == text.splitlines(keepends=True)
    parts = firehose.pieces([("a", 10), ("b", 0), ("c", 7)], 3, 15, 4)
    assert [(p.path, p.start, p.end) for p in parts] == [("a", 3, 7), ("a", 7, 10), ("c", 0, 4), ("c", 4, 5)]


def test_firehose_lets_in_by_rate_and_goes_on(spark, tmp_path):
    spark.dataSource.register(firehose.Firehose)
    (tmp_path / "in").mkdir()
    lines = [f'{k},"a,{k}",{k * 0.5}\n' for k in range(2000)]
    (tmp_path / "in/part-0").write_text("".join(lines[:900]) + "*,900\n\nx,y\n")
    (tmp_path / "in/_SUCCESS").write_text("")

    def run():
        stream = spark.readStream.format("firehose").schema("id long, name string, x double, control long").option("path", f"file://{tmp_path}/in").option("rate", "1").option("least", "4000").option("piece", "1500").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        return [p.numInputRows for p in query.recentProgress if p.numInputRows]

    taken = run()
    assert len(taken) >= 3 and sum(taken) == 902
    (tmp_path / "in/part-1").write_text("".join(lines[900:]) + "*,2000")
    assert sum(run()) == 1101
    found = spark.read.schema("id long, name string, x double, control long").parquet(f"{tmp_path}/out").collect()
    assert sorted(r["id"] for r in found if r["id"] is not None) == list(range(2000))
    assert sorted(r["control"] for r in found if r["control"] is not None) == [900, 2000]
    assert [(r["name"], r["x"]) for r in found if r["id"] == 7] == [("a,7", 3.5)] and [r["x"] for r in found if r["name"] == "y"] == [None]


def test_counters_of_operators(spark, tmp_path):
    for k in range(2):
        spark.range(10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = s.counted(s.counted(stream, "scan").filter("id < 3"), "select").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r["operator"]: (r["rows"], r["batches"], r["rows_per_second"] > 0) for r in s.operator_counters(spark, query).collect()}
    assert found == {"scan": (20, 2, True), "select": (6, 2, True)}
