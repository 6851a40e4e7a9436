"""Frames, grids and the heat map on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.operators import frames as f
from brooklet.operators import grid as g
from brooklet.operators import rows
from brooklet.operators import windows as w
from brooklet.plans.common import DAY, HOUR, NUDGE, START, by_day, events, query

_EV = "(SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value FROM events)"


def _runs(p: str, by: str = "user_id", base: str = _EV) -> str:
    return f"""p AS (SELECT *, {p} AS p FROM {base}),
c AS (SELECT *, CASE WHEN lag(p) OVER w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY {by} ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY t) AS island FROM c)"""


_THRESHOLD = f"""WITH {_runs('(value > 20)::INTEGER')},
f AS (SELECT user_id, min(t) AS s, max(t) AS e, count(*)::BIGINT AS n, min(p) AS p FROM i GROUP BY user_id, island)
SELECT row_number() OVER (PARTITION BY user_id ORDER BY s)::BIGINT AS frame_id, s AS frame_start, e AS frame_end, user_id AS frame_group, n AS length, p AS predicate FROM f WHERE """


@query("f1_apply_and_count", f"SELECT user_id, sum((value > 20)::INTEGER)::BIGINT AS n FROM {_EV} GROUP BY 1")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return rows.apply(events(spark, d), F.col("value") > 20, "p").groupBy("user_id").agg(F.sum("p").alias("n"))


@query("f2_threshold_frames", _THRESHOLD + "p = 1 AND n >= 3")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return f.threshold_frames(rows.apply(events(spark, d), F.col("value") > 20, "p"), "user_id", "t", "p", 3, by_day())


@query("f2_threshold_segments", _THRESHOLD + "n >= 2")
def f2_segments(spark: SparkSession, d: str) -> DataFrame:
    return f.threshold_frames(rows.apply(events(spark, d), F.col("value") > 20, "p"), "user_id", "t", "p", 2, by_day(), True)


@query(
    "f3_delta_frames",
    f"""WITH RECURSIVE e AS (SELECT user_id, t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM {_EV}),
f AS (SELECT user_id, rn, t, v AS v0, t AS s, 1 AS k FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, e.t, CASE WHEN abs(f.v0 - e.v) >= 30 THEN e.v ELSE f.v0 END, CASE WHEN abs(f.v0 - e.v) >= 30 THEN e.t ELSE f.s END, CASE WHEN abs(f.v0 - e.v) >= 30 THEN k + 1 ELSE k END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id AS frame_group, k::BIGINT AS frame_id, min(s) AS frame_start, max(t) AS frame_end, count(*)::BIGINT AS length, 'final' AS status FROM f GROUP BY 1, 2""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    return f.delta_frames(events(spark, d), "user_id", "t", "value", 30.0, by_day())


@query(
    "f3_boundary_frames",
    f"""WITH {_runs('floor(value / 25)')}
SELECT island::BIGINT AS frame_id, min(t) AS frame_start, max(t) AS frame_end, user_id AS frame_group, count(*)::BIGINT AS length, min(p)::BIGINT AS stripe FROM i GROUP BY user_id, island""",
)
def f3_boundary(spark: SparkSession, d: str) -> DataFrame:
    return f.boundary_frames(events(spark, d), "user_id", "t", "value", 25.0, by_day())


#: x is the value, y the hour of the day.
GRID = g.Grid(8, 4, 0.0, 0.0, 80.0, 24.0)
_XY = f"(SELECT *, value AS x, (t // {HOUR}) % 24 AS y FROM {_EV})"
_CELL = f"""(SELECT *, CASE WHEN inside THEN (floor((24 - y) * 4 / 24.0) * 8 + floor(x * 8 / 80.0) + 1)::BIGINT ELSE 0 END AS cid,
CASE WHEN inside THEN (floor(x * 8 / 80.0) + 0.5) * 80.0 / 8 ELSE -2147483648.0 END AS c_midx, CASE WHEN inside THEN 24.0 - (floor((24 - y) * 4 / 24.0) + 0.5) * 24.0 / 4 ELSE -2147483648.0 END AS c_midy
FROM (SELECT *, (x >= 0 AND x < 80 AND y > 0 AND y <= 24) AS inside FROM {_XY}))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    hour = F.call_function("div", F.col("t"), F.lit(HOUR)) % 24
    return events(spark, d).select("event_id", "t", "user_id", F.col("value").alias("x"), hour.alias("y"))


@query("f5_grid_cell", f"SELECT event_id, cid, c_midx::DOUBLE AS c_midx, c_midy::DOUBLE AS c_midy FROM {_CELL}")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return g.grid_cell(_points(spark, d), "x", "y", GRID).select("event_id", "cid", "c_midx", "c_midy")


_STAYS = f"""{_runs('cid', base=_CELL)},
s AS (SELECT user_id, island, min(t) AS t_in, min_by(event_id, t) AS event_id, min(cid) AS cid, min(c_midx)::DOUBLE AS c_midx, min(c_midy)::DOUBLE AS c_midy FROM i GROUP BY user_id, island),
g AS (SELECT event_id, user_id, lag(t_in) OVER w AS st_ts, t_in AS end_ts, lag(cid) OVER w AS cid, lag(c_midx) OVER w AS c_midx, lag(c_midy) OVER w AS c_midy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY island))"""


@query("f4_grid_frames", f"WITH {_STAYS} SELECT * FROM g WHERE st_ts IS NOT NULL")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return g.grid_frames(_points(spark, d), "user_id", "t", "x", "y", GRID, by_day()).select("event_id", "user_id", "st_ts", "end_ts", "cid", "c_midx", "c_midy")


_PIECES = f"""{_STAYS},
z AS (SELECT user_id, cid, c_midx, c_midy, greatest(st_ts, {START} + k * {HOUR}) AS st_ts, least(end_ts, {START} + (k + 1) * {HOUR}) AS end_ts
FROM (SELECT *, unnest(range((st_ts - {START}) // {HOUR}, (end_ts - {START}) // {HOUR} + 1)) AS k FROM g WHERE st_ts IS NOT NULL))"""


@query("f6_split_frames", f"WITH {_PIECES} SELECT user_id, cid, st_ts, end_ts FROM z WHERE st_ts < end_ts")
def f6(spark: SparkSession, d: str) -> DataFrame:
    stays = g.grid_frames(_points(spark, d), "user_id", "t", "x", "y", GRID, by_day())
    return f.split_on_boundaries(stays.select("user_id", "cid", "st_ts", "end_ts"), "st_ts", "end_ts", START, HOUR)


_SPAN = 24  # slides in a window


@query(
    "heat_map",
    f"""WITH {_PIECES},
b AS (SELECT *, unnest(range((st_ts - {START}) // {HOUR}, ((st_ts - {START}) + {_SPAN * HOUR}) // {HOUR})) AS wid FROM z WHERE st_ts < end_ts)
SELECT {START} + (wid + 1) * {HOUR} AS ts_at_update, user_id, cid, c_midx, c_midy,
round(100 * sum(end_ts - st_ts)::DOUBLE / (CASE WHEN wid >= {_SPAN - 1} THEN {_SPAN * HOUR} ELSE (wid + 1) * {HOUR} END) + 1e-9, 6) AS percent FROM b GROUP BY wid, user_id, cid, c_midx, c_midy""",
)
def heat_map(spark: SparkSession, d: str) -> DataFrame:
    """Share of each window that a group spends in each cell: stays, cut at window boundaries, summed over sliding windows.
    The first windows are shorter and are measured against the time that they have."""
    stays = g.grid_frames(_points(spark, d), "user_id", "t", "x", "y", GRID, by_day())
    pieces = f.split_on_boundaries(stays, "st_ts", "end_ts", START, HOUR).withColumn("length", F.col("end_ts") - F.col("st_ts"))
    held = w.bucket(pieces, "st_ts", _SPAN * HOUR, HOUR, START)
    sums = w.aggregate(held, ["user_id", "cid", "c_midx", "c_midy"], time=w.long_total("length"))
    full = F.when(F.col("wid_from_w") >= _SPAN - 1, F.lit(_SPAN * HOUR)).otherwise((F.col("wid_from_w") + 1) * HOUR)
    percent = F.round(100 * F.col("time").cast("double") / full + NUDGE, 6)
    return sums.select((F.lit(START) + (F.col("wid_from_w") + 1) * HOUR).alias("ts_at_update"), "user_id", "cid", "c_midx", "c_midy", percent.alias("percent"))


@query(
    "heat_map_of_samples",
    f"""WITH b AS (SELECT *, unnest(range((t - {START}) // {HOUR}, ((t - {START}) + {_SPAN * HOUR}) // {HOUR})) AS wid FROM {_CELL}),
n AS (SELECT wid, user_id, cid, count(*)::BIGINT AS n FROM b GROUP BY 1, 2, 3), a AS (SELECT wid, user_id, sum(n) AS every FROM n GROUP BY 1, 2)
SELECT wid AS wid_from_w, user_id, cid, round(100.0 * n / every + 1e-9, 6) AS percent FROM n JOIN a USING (wid, user_id)""",
)
def heat_map_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """The windows-only variant: share of a window's samples in each cell, by counts for each cell beside counts of all cells."""
    held = w.bucket(g.grid_cell(_points(spark, d), "x", "y", GRID), "t", _SPAN * HOUR, HOUR, START)
    found = w.shares(held, ["user_id"], "cid")
    return found.select("wid_from_w", "user_id", "cid", F.round(100.0 * F.col("n") / F.col("every") + NUDGE, 6).alias("percent"))




_POSITIONS = f"""WITH s AS (SELECT event_id, t, user_id % 40 AS k, (value * 100)::BIGINT AS x, (event_id % 1000) * 7 AS y FROM {_EV}),
p AS (SELECT event_id, t, k, x, y, k // 2 AS pid, k % 2 AS side FROM s WHERE k < 34),
l AS (SELECT *, last_value(CASE WHEN side = 0 THEN x END IGNORE NULLS) OVER w AS x0, last_value(CASE WHEN side = 0 THEN y END IGNORE NULLS) OVER w AS y0,
last_value(CASE WHEN side = 1 THEN x END IGNORE NULLS) OVER w AS x1, last_value(CASE WHEN side = 1 THEN y END IGNORE NULLS) OVER w AS y1 FROM p
WINDOW w AS (PARTITION BY pid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, pid::INTEGER AS pid, CASE WHEN x0 IS NULL OR x1 IS NULL THEN x ELSE (x0 + x1) // 2 END AS x, CASE WHEN x0 IS NULL OR x1 IS NULL THEN y ELSE (y0 + y1) // 2 END AS y FROM l"""


@query("f8_person_positions", _POSITIONS)
def f8(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 40
    sid = F.element_at(F.array(*[F.lit(s) for pair in g.SENSORS for s in pair]), (F.least(k, F.lit(33)) + 1).cast("int"))
    s = events(spark, d).select("event_id", "t", F.when(k < 34, sid).otherwise(-1).alias("sid"), F.round(F.col("value") * 100).cast("long").alias("x"), ((F.col("event_id") % 1000) * 7).alias("y"))
    return g.person_positions(s, "sid", "t", "x", "y", by_day(), "event_id").select("event_id", "pid", "x", "y")


@query("f9_positions_of_columns", f"SELECT event_id, pid, x AS across, y AS along FROM ({_POSITIONS})")
def f9(spark: SparkSession, d: str) -> DataFrame:
    """The coordinates are in columns of the caller's choice."""
    k = F.col("user_id") % 40
    sid = F.element_at(F.array(*[F.lit(s) for pair in g.SENSORS for s in pair]), (F.least(k, F.lit(33)) + 1).cast("int"))
    s = events(spark, d).select("event_id", "t", F.when(k < 34, sid).otherwise(-1).alias("sensor"), F.round(F.col("value") * 100).cast("long").alias("across"), ((F.col("event_id") % 1000) * 7).alias("along"))
    return g.person_positions(s, "sensor", "t", "across", "along", by_day(), "event_id").select("event_id", "pid", "across", "along")
