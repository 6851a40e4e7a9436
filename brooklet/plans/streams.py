"""Streaming queries over the events, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions.columns import div
from brooklet.operators.rows import apply
from brooklet.plans.common import DAY, HOUR, START, events, folder, query, rounded
from brooklet.sources.firehose import Firehose
from brooklet.sources.generated import file_stream
from brooklet.streaming import feedback, timed
from brooklet.streaming import streams as s

_EV = "(SELECT event_id, ts, epoch_us(ts) AS t, user_id, event_type, value FROM events)"
BATCHES = 3


def arrive(spark: SparkSession, d: str, where: str, run: Callable[[DataFrame], DataFrame], late: Column | None = None) -> DataFrame:
    """Lets the events arrive in a few parts, a third of the time each, and runs the stream after each of them.

    Rows that are ``late`` come with the last part. Returns what the last run gives.
    """
    rows = events(spark, d).withColumn("ts", F.timestamp_micros("t"))
    part = F.least(F.greatest(F.floor((F.col("t") - START) / (10 * DAY)), F.lit(0)), F.lit(BATCHES - 1))
    rows = rows.withColumn("part", part if late is None else F.when(late, BATCHES - 1).otherwise(part))
    for k in range(BATCHES):
        rows.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{where}/in")
        found = run(file_stream(spark, f"{where}/in", rows.drop("part").schema, 1 << 20))
    return found


_WINDOWS = f"SELECT (t // {6 * HOUR} + 1) * {6 * HOUR} AS window_end, event_type, round(avg(value) + 1e-9, 6) AS avg, count(*)::BIGINT AS n FROM {_EV} GROUP BY 1, 2"


@query("t_window_average_append", f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(t) FROM {_EV}) - {HOUR}")
def append(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t1")
    out = arrive(spark, d, where, lambda e: s.run_once(s.window_average(s.punctuated(e, "ts", "1 hour"), "ts", "event_type", "value", "6 hours", "6 hours"), where))
    return out.select(F.unix_micros("window_end").alias("window_end"), "event_type", rounded("avg"), "n")


#: Every 97th row of the first two thirds comes with the last one. It counts only where its window is still open then.
_LATE = f"(event_id % 97 = 0 AND t < {START + 20 * DAY})"


@query(
    "t_late_rows",
    f"""WITH m AS (SELECT max(t) - {HOUR} AS mark FROM {_EV} WHERE t < {START + 20 * DAY} AND NOT {_LATE}),
e AS (SELECT * FROM {_EV}, m WHERE NOT {_LATE} OR (t // {6 * HOUR} + 1) * {6 * HOUR} > mark // 1000 * 1000)
SELECT (t // {6 * HOUR} + 1) * {6 * HOUR} AS window_end, event_type, round(avg(value) + 1e-9, 6) AS avg, count(*)::BIGINT AS n FROM e GROUP BY 1, 2
HAVING window_end <= (SELECT max(t) FROM {_EV}) - {HOUR}""",
)
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t6")
    late = (F.col("event_id") % 97 == 0) & (F.col("t") < START + 20 * DAY)
    out = arrive(spark, d, where, lambda e: s.run_once(s.window_average(s.punctuated(e, "ts", "1 hour"), "ts", "event_type", "value", "6 hours", "6 hours"), where), late)
    return out.select(F.unix_micros("window_end").alias("window_end"), "event_type", rounded("avg"), "n")


@query("t_window_average_partial", _WINDOWS)
def partial(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t2")
    out = arrive(spark, d, where, lambda e: s.run_once(s.window_average(s.punctuated(e, "ts", "1 hour"), "ts", "event_type", "value", "6 hours", "6 hours"), where, "update"))
    out = s.latest(out, ["window_end", "event_type"])
    return out.select(F.unix_micros("window_end").alias("window_end"), "event_type", rounded("avg"), "n")


@query(
    "t_threshold_frames",
    f"""WITH p AS (SELECT *, (value > 20)::INTEGER AS p FROM {_EV}),
c AS (SELECT *, CASE WHEN lag(p) OVER w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS new, max(t) OVER (PARTITION BY user_id) AS last FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS island FROM c),
f AS (SELECT user_id, min(t) AS s, max(t) AS e, count(*)::BIGINT AS n, min(p) AS p, max(last) AS last FROM i GROUP BY user_id, island)
SELECT user_id AS frame_group, row_number() OVER (PARTITION BY user_id ORDER BY s)::BIGINT AS frame_id, s AS frame_start, e AS frame_end, n AS length FROM f WHERE p = 1 AND n >= 3 AND e < last""",
)
def threshold(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t3")
    return arrive(spark, d, where, lambda e: s.run_once(s.threshold_frames(apply(e, F.col("value") > 20, "p").select("user_id", "t", "p"), "user_id", "t", "p", 3), where))


@query(
    "t_delta_frames",
    f"""WITH RECURSIVE e AS (SELECT user_id, t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM {_EV}),
f AS (SELECT user_id, rn, t, v AS v0, t AS s, 1 AS k FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, e.t, CASE WHEN abs(f.v0 - e.v) >= 30 THEN e.v ELSE f.v0 END, CASE WHEN abs(f.v0 - e.v) >= 30 THEN e.t ELSE f.s END, CASE WHEN abs(f.v0 - e.v) >= 30 THEN k + 1 ELSE k END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1),
g AS (SELECT user_id, k, min(s) AS s, max(t) AS e, count(*) AS n FROM f GROUP BY 1, 2)
SELECT user_id AS frame_group, k::BIGINT AS frame_id, s AS frame_start, e AS frame_end, n::BIGINT AS length FROM g WHERE e < (SELECT max(t) FROM e WHERE e.user_id = g.user_id)""",
)
def delta(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t4")
    return arrive(spark, d, where, lambda e: s.run_once(s.delta_frames(e.select("user_id", "t", "value"), "user_id", "t", "value", 30.0), where))


@query(
    "t_running_max",
    f"""SELECT user_id AS key, o AS old_max, m AS new_max FROM (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY t) AS o FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t) AS m FROM {_EV})) WHERE o IS NULL OR m > o""",
)
def running_max(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t5")
    return arrive(spark, d, where, lambda e: s.run_once(s.running_max(e.select("user_id", "t", "value"), "user_id", "t", "value"), where))


@query("k2_display", f"SELECT event_type, count(*)::BIGINT AS n FROM {_EV} GROUP BY 1")
def display(spark: SparkSession, d: str) -> DataFrame:
    from brooklet.sources.files import display as show

    where = folder(spark, "k2")

    def send(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{where}/sent/batch={number}")

    def run(e: DataFrame) -> DataFrame:
        show(e, send).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{where}/sent")

    return arrive(spark, d, where, run).groupBy("event_type").agg(F.sum("count").alias("n"))


@query(
    "s12_counters",
    f"""SELECT 'maxima' AS stream, 'rows_in' AS counter, count(*)::BIGINT AS value FROM {_EV} WHERE t >= {START + 20 * DAY}
UNION ALL SELECT 'maxima', 'state_rows', count(DISTINCT user_id)::BIGINT FROM {_EV} UNION ALL SELECT 'maxima', 'late_rows', 0::BIGINT""",
)
def counted(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "s12")

    def run(e: DataFrame) -> DataFrame:
        maxima = s.running_max(e.select("user_id", "t", "value"), "user_id", "t", "value")
        running = maxima.writeStream.format("noop").queryName("maxima").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        running.awaitTermination()
        return s.counters(spark, running)

    return arrive(spark, d, where, run).filter("counter <> 'batches'")


_PURCHASES, _CLICKS = "event_type = 'purchase'", "event_type = 'click'"


@query(
    "t_stream_join",
    f"""SELECT l.event_id, l.user_id, l.t, r.event_id AS r_event_id, r.t AS r_t FROM {_EV} l JOIN {_EV} r ON l.user_id = r.user_id AND r.t BETWEEN l.t - {12 * HOUR} AND l.t + {HOUR}
WHERE l.{_PURCHASES} AND r.{_CLICKS}""",
)
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t7")

    def run(e: DataFrame) -> DataFrame:
        joined = timed.join(e.filter(_PURCHASES), e.filter(_CLICKS), {"user_id": "user_id"}, ("t", "t"), 12 * HOUR, HOUR, "1 hour")
        return s.run_once(joined.select("event_id", "user_id", "t", "r_event_id", "r_t"), where)

    return arrive(spark, d, where, run)


#: Which part a row comes with, and the last full six hours of each part and those before it.
_ARRIVED = f"a AS (SELECT *, CASE WHEN {_LATE} THEN 2 ELSE least(greatest((t - {START}) // {10 * DAY}, 0), 2) END AS part, t // {6 * HOUR} * {6 * HOUR} // 1000 AS tick FROM {_EV})"


@query(
    "t_punctuate",
    f"""WITH {_ARRIVED}, w AS (SELECT max(tick) FILTER (part = 0) AS w0, max(tick) FILTER (part <= 1) AS w1, max(tick) AS w2 FROM a),
k AS (SELECT event_id, user_id % 8 AS lane, part, CASE part WHEN 1 THEN w0 ELSE w1 END AS tick FROM a, w WHERE part > 0 AND t >= (CASE part WHEN 1 THEN w0 ELSE w1 END + 1) * 1000),
l AS (SELECT lane, min(part) AS first FROM k GROUP BY lane)
SELECT event_id, lane, tick, NULL::BIGINT AS mark FROM k UNION ALL SELECT NULL, lane, w1, w0 FROM l, w WHERE first = 1 UNION ALL SELECT NULL, lane, w2, w1 FROM l, w""",
)
def punctuate(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t8")
    late = (F.col("event_id") % 97 == 0) & (F.col("t") < START + 20 * DAY)

    def run(e: DataFrame) -> DataFrame:
        ticks = e.select((div(div("t", 6 * HOUR) * (6 * HOUR), 1000)).alias("tick"))
        return s.run_once(timed.punctuate(e.select("event_id", "user_id", "t"), ticks, F.col("user_id") % 8, "t", "tick").select("event_id", "lane", "tick", "mark"), where)

    with timed.rocks(spark):
        return arrive(spark, d, where, run, late)


def _released(marks: str) -> tuple[str, str]:
    """When a row's day is over by ``marks`` (w0, w1, w2: how far the parts go, in milliseconds)."""
    end = f"((t // {DAY} + 1) * {DAY // 1000})"
    return f"CASE WHEN {end} <= w0 THEN w0 WHEN {end} <= w1 THEN w1 WHEN {end} <= w2 THEN w2 END", f"w AS (SELECT {marks} FROM p)"


_PARTS = f"p AS (SELECT event_type, t, least(greatest((t - {START}) // {10 * DAY}, 0), 2) AS part FROM {_EV})"
_BOTH, _W_BOTH = _released(", ".join(f"least(max(t) FILTER (part <= {k} AND {_PURCHASES}), max(t) FILTER (part <= {k} AND {_CLICKS})) // 1000 AS w{k}" for k in range(3)))
_RIGHT, _W_RIGHT = _released(", ".join(f"max(t) FILTER (part <= {k} AND {_CLICKS}) // 1000 AS w{k}" for k in range(3)))


@query(
    "t_synchronize",
    f"""WITH {_PARTS}, {_W_BOTH} SELECT * FROM (SELECT CASE WHEN {_PURCHASES} THEN 'left' ELSE 'right' END AS side, event_id, t, {_BOTH} AS released FROM {_EV}, w WHERE {_PURCHASES} OR {_CLICKS}) WHERE released IS NOT NULL""",
)
def synchronize(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t9")

    def run(e: DataFrame) -> DataFrame:
        e = e.select("event_id", "event_type", "t")
        found = timed.synchronize(e.filter(_PURCHASES), e.filter(_CLICKS), "t", "t", DAY, lane=F.col("event_id") % 4)
        return s.run_once(found.select("side", F.coalesce("left.event_id", "right.event_id").alias("event_id"), F.coalesce("left.t", "right.t").alias("t"), "released"), where)

    with timed.rocks(spark):
        return arrive(spark, d, where, run)


@query("t_present", f"WITH {_PARTS}, {_W_RIGHT} SELECT * FROM (SELECT event_id, user_id, value, {_RIGHT} AS released FROM {_EV}, w WHERE {_PURCHASES}) WHERE released IS NOT NULL")
def present(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t10")

    def run(e: DataFrame) -> DataFrame:
        found = timed.present(e.filter(_PURCHASES), e.filter(_CLICKS), "t", "t", DAY, lane=F.col("event_id") % 4)
        return s.run_once(found.select("event_id", "user_id", "value", "released"), where)

    with timed.rocks(spark):
        return arrive(spark, d, where, run)


#: Runs of at least three values over 20, by number, and what of them has come with each part.
_LONG_RUNS = f"""p AS (SELECT *, (value > 20)::INTEGER AS p, least(greatest((t - {START}) // {10 * DAY}, 0), 2) AS part FROM {_EV}),
c AS (SELECT *, CASE WHEN lag(p) OVER w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS island FROM c),
f AS (SELECT user_id, island, min(t) AS s, max(t) AS e, row_number() OVER (PARTITION BY user_id ORDER BY min(t))::BIGINT AS frame_id FROM i WHERE p = 1 GROUP BY user_id, island HAVING count(*) >= 3)"""


@query(
    "t_fragments",
    f"""WITH {_LONG_RUNS}, g AS (SELECT user_id, island, part, max(t) AS e, sum(count(*)) OVER (PARTITION BY user_id, island ORDER BY part)::BIGINT AS n FROM i WHERE p = 1 GROUP BY user_id, island, part)
SELECT user_id AS frame_group, frame_id, coalesce(lag(g.e) OVER (PARTITION BY user_id, island ORDER BY part), f.s) AS frame_start, g.e AS frame_end, g.n AS length FROM g JOIN f USING (user_id, island) WHERE g.n >= 3""",
)
def fragments(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t11")
    return arrive(spark, d, where, lambda e: s.run_once(s.threshold_frames(apply(e, F.col("value") > 20, "p").select("user_id", "t", "p"), "user_id", "t", "p", 3, fragments=True), where))


@query("t_fill_frames", f"WITH {_LONG_RUNS} SELECT event_id, user_id, value, frame_id AS ff_frame_id FROM i JOIN f USING (user_id, island)")
def fill_frames(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t12")

    def run(e: DataFrame) -> DataFrame:
        found = s.run_once(s.threshold_frames(apply(e, F.col("value") > 20, "p").select("user_id", "t", "p"), "user_id", "t", "p", 3, fragments=True, marks=True), f"{where}/frames")
        frames = file_stream(spark, f"{where}/frames/out", found.schema, 1 << 20)
        return s.run_once(timed.fill_frames(e.select("event_id", "user_id", "t", "value"), frames, "user_id", "t").select("event_id", "user_id", "value", "ff_frame_id"), f"{where}/filled")

    with timed.rocks(spark):
        return arrive(spark, d, where, run)


def part_of(t: str) -> Column:
    return F.least(F.greatest(F.floor((F.col(t) - START) / (10 * DAY)), F.lit(0)), F.lit(BATCHES - 1))


@query(
    "t_pace_feedback",
    f"""WITH {_PARTS.replace("event_type, t", "event_id, event_type, t")}, w AS (SELECT max(t) FILTER (part <= 1 AND {_PURCHASES}) AS l1, max(t) FILTER (part = 0 AND {_CLICKS}) AS r0 FROM p)
SELECT event_id, t, 'left' AS side FROM p WHERE {_PURCHASES}
UNION ALL SELECT event_id, t, 'right' FROM p, w WHERE {_CLICKS} AND (part = 0 OR l1 - r0 <= {5 * DAY} OR t >= l1)""",
)
def pace_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The right input comes a part late; what it is told not to deliver any more lies in whole days."""
    where = folder(spark, "t13")
    rows = events(spark, d).select("event_id", "t", "event_type", div("t", DAY).alias("day"), part_of("t").alias("part"))
    sides = {"left": rows.filter(_PURCHASES), "right": rows.filter(_CLICKS)}
    schema = rows.select("event_id", "t", "day").schema
    late = {0: [], 1: [0], 2: [1, 2]}
    for k in range(BATCHES):
        for side, parts in (("left", [k]), ("right", late[k])):
            sides[side].filter(F.col("part").isin(parts)).select("event_id", "t", "day").write.mode("append").partitionBy("day").parquet(f"{where}/{side}")
        found = feedback.pace(spark, {side: f"{where}/{side}" for side in sides}, schema, "t", 5 * DAY, f"{where}/paced", "day", DAY, 1 << 20)()
    return found.select("event_id", "t", "side")


def _archive(spark: SparkSession, d: str, where: str) -> DataFrame:
    """The events as an archive in stretches of six hours."""
    rows = events(spark, d).select("event_id", "t", "event_type", "value", div("t", 6 * HOUR).alias("stretch"))
    rows.repartition("stretch").write.partitionBy("stretch").parquet(f"{where}/archive")
    return spark.read.schema(rows.schema).parquet(f"{where}/archive")


@query(
    "t_archive_by_stream",
    f"""WITH a AS (SELECT event_id, t, t // {6 * HOUR} AS stretch FROM {_EV} WHERE t // {6 * HOUR} + 28 IN (SELECT t // {6 * HOUR} FROM {_EV} WHERE {_PURCHASES}))
SELECT event_id, t, NULL::BIGINT AS mark FROM a UNION ALL SELECT DISTINCT NULL, NULL, (stretch + 1) * {6 * HOUR} FROM a""",
)
def archive_by_stream(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t14")
    archive = _archive(spark, d, where)

    def answer(rows: DataFrame, found: DataFrame) -> DataFrame:
        marks = found.select("stretch").distinct().select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("t"), ((F.col("stretch") + 1) * (6 * HOUR)).alias("mark"))
        return found.select("event_id", "t", F.lit(None).cast("long").alias("mark")).unionByName(marks)

    asks = lambda rows: div("t", 6 * HOUR) - 28
    return arrive(spark, d, where, lambda e: feedback.asking(e.filter(_PURCHASES).select("event_id", "t"), archive, "stretch", asks, answer, where)())


@query(
    "t_impute_from_archive",
    f"""WITH m AS (SELECT t // {6 * HOUR} AS stretch, event_type, avg(value) AS mean FROM {_EV} GROUP BY 1, 2)
SELECT event_id, round(CASE WHEN event_id % 50 = 0 THEN mean ELSE value END + 1e-9, 6) AS value FROM {_EV} e LEFT JOIN m ON m.stretch = t // {6 * HOUR} - 4 AND m.event_type = e.event_type""",
)
def impute_from_archive(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t15")
    archive = _archive(spark, d, where)

    def answer(rows: DataFrame, found: DataFrame) -> DataFrame:
        mean = found.groupBy((F.col("stretch") + 4).alias("place"), "event_type").agg(F.avg("value").alias("mean"))
        return rows.withColumn("place", div("t", 6 * HOUR)).join(mean, ["place", "event_type"], "left").select("event_id", F.coalesce("value", "mean").alias("value"))

    asks = lambda rows: F.when(rows["value"].isNull(), div("t", 6 * HOUR) - 4)
    missing = F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value")
    out = arrive(spark, d, where, lambda e: feedback.asking(e.select("event_id", "t", "event_type", missing), archive, "stretch", asks, answer, where)())
    return out.select("event_id", rounded("value"))


@query("s4_firehose", f"SELECT event_id, t, user_id, value, NULL::BIGINT AS control FROM {_EV} UNION ALL SELECT DISTINCT NULL, NULL, NULL, NULL, (t // {DAY} + 1) * {DAY} FROM {_EV}")
def s4_firehose(spark: SparkSession, d: str) -> DataFrame:
    """The events as lines in the order of time, each day ended by a control row."""
    where, rows = folder(spark, "s4"), events(spark, d)
    spark.dataSource.register(Firehose)
    line = rows.select("t", F.concat_ws(",", F.col("event_id").cast("string"), F.col("t").cast("string"), F.col("user_id").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("line"))
    day = ((div("t", DAY) + 1) * DAY).alias("t")
    control = rows.select(day).distinct().select("t", F.concat(F.lit("*,"), F.col("t").cast("string")).alias("line"))
    line.unionByName(control).repartitionByRange("t").sortWithinPartitions("t").select("line").write.text(f"{where}/lines")
    stream = spark.readStream.format("firehose").schema("event_id long, t long, user_id long, value double, control long").option("path", f"{where}/lines").option("rate", 65536).option("least", 1 << 20).load()
    running = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").start()
    running.processAllAvailable()
    running.stop()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


@query(
    "t_operator_counters",
    f"""SELECT * FROM (SELECT 'scan' AS operator, count(*)::BIGINT AS rows, 1::BIGINT AS batches FROM {_EV} WHERE t >= {START + 20 * DAY}
UNION ALL SELECT 'select', count(*), 1 FROM {_EV} WHERE t >= {START + 20 * DAY} AND {_PURCHASES} UNION ALL SELECT 'expensive', count(*), 1 FROM {_EV} WHERE t >= {START + 20 * DAY} AND {_PURCHASES} AND value > 20)""",
)
def operator_counters(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "t16")

    def run(e: DataFrame) -> DataFrame:
        chosen = s.counted(s.counted(e, "scan").filter(_PURCHASES), "select")
        last = s.counted(chosen.filter("value > 20"), "expensive")
        running = last.writeStream.format("noop").queryName("counted").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        running.awaitTermination()
        return s.operator_counters(spark, running)

    return arrive(spark, d, where, run).select("operator", "rows", "batches")
