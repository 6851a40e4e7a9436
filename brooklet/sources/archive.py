"""Archives: rows of earlier days that resemble the days of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brooklet.functions.columns import div

DAY = 86_400_000_000
#: Stretches asked for that are sent to all tasks, so that a stretch with many rows isn't moved to one; beyond, rows move by stretch.
FEW = 100_000


def _asked(archive: DataFrame, t: str, stretch: int, wanted: DataFrame) -> DataFrame:
    """The archive's rows of the ``wanted`` stretches."""
    few = wanted.limit(FEW + 1).count() <= FEW
    return archive.withColumn("_s", div(t, stretch)).join(F.broadcast(wanted) if few else wanted, "_s").drop("_s")


def database(spark: SparkSession, url: str, query: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """The rows of a database query, read in ``parts`` ranges of a whole-number column. Credentials come as options."""
    held = f"({query}) AS archive"
    return spark.read.format("jdbc").options(url=url, dbtable=held, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()


def similar_days(stream: DataFrame, archive: DataFrame, t: str, kind: str, days: int, offset: int = 0, stretch: int = 3_600_000_000) -> DataFrame:
    """Archive rows of the ``days`` days before each stretch of the stream, at the same time of day.

    ``kind``: AllDays, WeekDays (Monday to Friday only) or SameDayOfWeek (``days`` weeks back). ``offset`` moves the time of day that is looked
    up, in stretches. Times are microseconds. A row comes once for each stretch of the stream that asks for it (``for_stretch``).
    """
    wanted = _earlier(stream, t, kind, days, offset, stretch)
    return _asked(archive, t, stretch, wanted)


def _earlier(stream: DataFrame, t: str, kind: str, days: int, offset: int, stretch: int) -> DataFrame:
    """(for_stretch, _s): the earlier stretches that each stretch of the stream may look at."""
    if kind not in ("AllDays", "WeekDays", "SameDayOfWeek"):
        raise ValueError(f"no such similarity: {kind}")
    per_day, step = DAY // stretch, 7 if kind == "SameDayOfWeek" else 1
    asked = stream.select(div(t, stretch).alias("for_stretch")).distinct()
    found = asked.select("for_stretch", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_back"))
    found = found.select("for_stretch", (F.col("for_stretch") + offset - F.col("_back") * step * per_day).alias("_s"))
    # 1970-01-01 was a Thursday: day numbers leave 2 and 3 on division by 7 on Saturdays and Sundays.
    return found.filter(~F.pmod(div("_s", per_day), F.lit(7)).isin(2, 3)) if kind == "WeekDays" else found


def similar_conditions(stream: DataFrame, archive: DataFrame, conditions: DataFrame, t: str, kind: str, days: int, tolerance: float, look_back: int = 30, stretch: int = 3_600_000_000) -> DataFrame:
    """Archive rows of the ``days`` stretches, at the same time of day in the last ``look_back`` days (weeks for SameDayOfWeek), whose weather was most alike.

    ``conditions`` (stretch, level) has a row for each stretch, the stream's own too, where a missing one counts as 0. Alike are levels that differ
    by no more than ``tolerance``: the nearest first, for a level of 0 the latest first; of equally near ones the later.
    """
    level = conditions.select(F.col("stretch").alias("_s"), F.col("level").alias("_level"))
    now = conditions.select(F.col("stretch").alias("for_stretch"), F.col("level").alias("_now"))
    held = _earlier(stream, t, kind, look_back, 0, stretch).join(level, "_s").join(now, "for_stretch", "left")
    held = held.withColumn("_now", F.coalesce("_now", F.lit(0.0))).withColumn("_far", F.abs(F.col("_level") - F.col("_now")))
    near = F.when(F.col("_now") > 0, F.col("_far"))
    # No stretch has more candidates than ``look_back``.
    rank = F.row_number().over(Window.partitionBy("for_stretch").orderBy(near, F.desc("_s")))
    wanted = held.filter(F.col("_far") <= tolerance).withColumn("_rank", rank).filter(F.col("_rank") <= days).select("for_stretch", "_s")
    return _asked(archive, t, stretch, wanted)
