"""Feedback at run time: what one micro-batch has learnt, the source of the next one leaves out; archives that a stream asks for.

Feedback is a lower bound of time for each input of a union. It is kept with the number of the micro-batch that gave it, in the shared folder, so
that a micro-batch that is tried again reads and writes the same. Files of partitions below the bound aren't opened.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH = "batch"
_BOUNDS = "side string, high long, bound long"


class Feedback:
    """The high-water mark of each input and the bound below which it need not deliver, by micro-batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/feedback"

    def before(self, number: int) -> dict[str, tuple[int | None, int | None]]:
        """The mark and bound of each input as the micro-batches before ``number`` left them."""
        if number == 0:
            return {}
        held = self.spark.read.schema(f"{_BOUNDS}, {BATCH} long").parquet(self.folder).filter(F.col(BATCH) < number)
        last = held.groupBy("side").agg(F.max("high").alias("high"), F.max("bound").alias("bound"))  # neither ever falls
        return {r["side"]: (r["high"], r["bound"]) for r in last.collect()}

    def put(self, number: int, found: Mapping[str, tuple[int | None, int | None]]) -> None:
        rows = [(side, high, bound) for side, (high, bound) in found.items()]
        self.spark.createDataFrame(rows, _BOUNDS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{BATCH}={number}")


def advanced(before: Mapping[str, tuple[int | None, int | None]], highs: Mapping[str, int | None], divergence: int) -> dict[str, tuple[int | None, int | None]]:
    """Marks and bounds after a micro-batch that has seen these ``highs``: an input more than ``divergence`` behind the leading one is bounded by its mark."""
    marks = {s: max((h for h in (highs[s], before.get(s, (None, None))[0]) if h is not None), default=None) for s in highs}
    lead = max((h for h in marks.values() if h is not None), default=None)
    out = {}
    for side, high in marks.items():
        bound = before.get(side, (None, None))[1]
        # An input that hasn't begun is not behind yet.
        if high is not None and lead - high > divergence and (bound is None or lead > bound):
            bound = lead
        out[side] = (high, bound)
    return out


def arriving(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """A stream of the paths of a folder's Parquet files, which aren't opened."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch)
    return found.load(folder).select("path")


def pace(spark: SparkSession, inputs: Mapping[str, str], schema: T.StructType, t: str, divergence: int, folder: str, partition: str, stretch: int, files_per_batch: int = 1000) -> Callable[[], DataFrame]:
    """Union of streams in which an input that lags too far behind is told not to deliver what lies before the leading one's mark.

    ``inputs``: for each side a folder of Parquet files of one ``schema``, to which files are added, partitioned by ``partition``, which is ``t`` div ``stretch``. The
    stream is of files: those of partitions that lie before a side's bound aren't opened, and of the others the bound is a filter that Spark pushes down. ``side`` is
    added. The paths of one micro-batch, ``files_per_batch`` a side at the most, come to the driver. Rows without time go once their side is bounded. Returns a
    function that runs the stream over what is there and reads what was put out so far.
    """
    parts = [arriving(spark, path, files_per_batch).withColumn("side", F.lit(side)) for side, path in inputs.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    feedback = Feedback(spark, folder)

    def rows(side: str, paths: list[str], bound: int | None) -> DataFrame:
        found = spark.read.schema(schema).option("basePath", inputs[side]).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return (found if bound is None else found.filter(F.col(t) >= bound)).withColumn("side", F.lit(side))

    def step(batch: DataFrame, number: int) -> None:
        before, seen, held = feedback.before(number), Observation(f"pace_{number}"), None
        place = F.regexp_extract("path", f"/{partition}=(-?[0-9]+)/", 1).try_cast("long")
        paths = batch.select("side", "path", place.alias("place")).collect()
        for side in inputs:
            bound = before.get(side, (None, None))[1]
            least = None if bound is None else bound // stretch  # not above the truncated quotient
            wanted = [r["path"] for r in paths if r["side"] == side and (least is None or r["place"] is None or r["place"] >= least)]
            own = rows(side, wanted, bound)
            held = own if held is None else held.unionByName(own)
        marked = held.observe(seen, *[F.max(F.when(F.col("side") == side, F.col(t))).alias(side) for side in inputs])
        marked.write.mode("overwrite").parquet(f"{folder}/out/{BATCH}={number}")
        feedback.put(number, advanced(before, {side: seen.get[side] for side in inputs}, divergence))

    def run() -> DataFrame:
        every.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(T.StructType([*schema, T.StructField("side", T.StringType()), T.StructField(BATCH, T.LongType())])).parquet(f"{folder}/out")

    return run


def asking(stream: DataFrame, archive: DataFrame, place: str, wanted: Callable[[DataFrame], Column], answer: Callable[[DataFrame, DataFrame], DataFrame], folder: str) -> Callable[[], DataFrame]:
    """A stream that drives an archive: each micro-batch's rows ask for places of it, and only those partitions are read.

    ``archive`` is a table partitioned by ``place``; ``wanted`` gives the place that each row of a micro-batch asks for (null: none), and ``answer`` what
    comes of the rows and the archive's rows. What is asked for is a table of its own, so that the join prunes the archive's partitions when it runs.
    Returns a function that runs the stream over what is there and reads what was put out so far.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={number}")
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows/{BATCH}={number}")
        rows.select(wanted(rows).cast("long").alias("asked")).filter("asked IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{folder}/asked/{BATCH}={number}")
        answer(rows, asked_for(spark, archive, place, folder, number)).write.mode("overwrite").parquet(f"{folder}/out/{BATCH}={number}")

    def run() -> DataFrame:
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out").drop(BATCH)

    return run


def asked_for(spark: SparkSession, archive: DataFrame, place: str, folder: str, number: int) -> DataFrame:
    """The archive's rows that micro-batch ``number`` asked for."""
    asked = spark.read.schema(f"asked long, {BATCH} long").parquet(f"{folder}/asked").filter(F.col(BATCH) == number)
    return archive.join(asked.select(F.col("asked").alias("_asked")), archive[place] == F.col("_asked")).drop("_asked")
