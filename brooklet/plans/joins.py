"""Joins and n-ary operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.operators import joins as j
from brooklet.operators import windows as w
from brooklet.operators.frames import threshold_frames
from brooklet.plans.common import DAY, HOUR, START, by_arrival, by_day, events, query, rounded
from brooklet.session import table

_EV = "(SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value FROM events)"
_CLICKS = f"(SELECT user_id, event_id, t, value FROM {_EV} WHERE event_type = 'click')"
_BUYS = f"(SELECT user_id, event_id, t, value FROM {_EV} WHERE event_type = 'purchase')"


def _of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type") == kind).select("user_id", "event_id", "t", "value")


@query("j1_equi_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate")
def j1(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return j.equi_join(lines, orders, {"l_orderkey": "o_orderkey"}, F.col("l_shipdate") > F.col("o_orderdate")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("j3_theta_join", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return j.theta_join(table(spark, d, "region"), table(spark, d, "nation"), F.col("r_regionkey") < F.col("n_regionkey")).select("r_name", "n_name")


@query("j4_extension_left", f"SELECT l.event_id, r.e AS r_event_id FROM {_CLICKS} l JOIN (SELECT user_id, min(event_id) AS e FROM {_BUYS} GROUP BY 1) r USING (user_id)")
def j4_left(spark: SparkSession, d: str) -> DataFrame:
    return j.extension_join(_of(spark, d, "click"), _of(spark, d, "purchase"), ["user_id"], "event_id", "left").select("event_id", "r_event_id")


@query("j4_extension_right", f"SELECT l.e AS event_id, r.event_id AS r_event_id FROM (SELECT user_id, min(event_id) AS e FROM {_CLICKS} GROUP BY 1) l JOIN {_BUYS} r USING (user_id)")
def j4_right(spark: SparkSession, d: str) -> DataFrame:
    return j.extension_join(_of(spark, d, "click"), _of(spark, d, "purchase"), ["user_id"], "event_id", "right").select("event_id", "r_event_id")


@query("j4_extension_both", f"SELECT l.event_id, r.event_id AS r_event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {_CLICKS}) l JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {_BUYS}) r USING (user_id, k)")
def j4_both(spark: SparkSession, d: str) -> DataFrame:
    return j.extension_join(_of(spark, d, "click"), _of(spark, d, "purchase"), ["user_id"], "event_id", "both").select("event_id", "r_event_id")


@query("j5_window_join", f"SELECT l.event_id, r.event_id AS r_event_id FROM {_CLICKS} l JOIN {_BUYS} r ON l.user_id = r.user_id AND abs(l.t - r.t) <= {6 * HOUR}")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return j.window_join(_of(spark, d, "click"), _of(spark, d, "purchase"), ["user_id"], "t", 6 * HOUR).select("event_id", "r_event_id")


@query("j5_pane_join", f"SELECT l.event_id, r.event_id AS r_event_id FROM {_CLICKS} l JOIN {_BUYS} r ON l.user_id = r.user_id AND (l.t - {START}) // {DAY} = (r.t - {START}) // {DAY}")
def j5_pane(spark: SparkSession, d: str) -> DataFrame:
    held = [w.bucket(_of(spark, d, k), "t", DAY, DAY, START).drop("wid_to_w") for k in ("click", "purchase")]
    return j.pane_join(*held, ["user_id"], "wid_from_w").select("event_id", "r_event_id")


@query("j6_present", f"SELECT event_id, t FROM {_CLICKS} WHERE t <= (SELECT max(t) FROM {_BUYS})")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return j.present(_of(spark, d, "click"), _of(spark, d, "purchase"), "t", "t").select("event_id", "t")


@query(
    "j7_fill_frames",
    f"""WITH e AS {_EV}, p AS (SELECT *, (value > 20)::INTEGER AS p FROM e),
c AS (SELECT *, CASE WHEN lag(p) OVER w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS island FROM c),
f AS (SELECT user_id, island, min(t) AS s, max(t) AS e, min(p) AS p, count(*) AS n FROM i GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS frame_id FROM f WHERE p = 1 AND n >= 3)
SELECT e.event_id, min(k.frame_id)::BIGINT AS ff_frame_id FROM e JOIN k ON e.user_id = k.user_id AND e.t BETWEEN k.s AND k.e GROUP BY 1""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "t", "user_id", "value")
    frames = threshold_frames(e.withColumn("p", (F.col("value") > 20).cast("int")), "user_id", "t", "p", 3, by_day())
    return j.fill_frames(e, frames, "user_id", "t", "event_id", DAY).select("event_id", "ff_frame_id")


@query("j8_union", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return j.union([table(spark, d, "customer"), table(spark, d, "supplier")], {"name": ["c_name", "s_name"], "balance": ["c_acctbal", "s_acctbal"], "segment": ["c_mktsegment", None]})


@query("j9_pace", f"SELECT event_id FROM (SELECT event_id, t, max(t) OVER (ORDER BY event_id) AS high FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN t - {HOUR} * (event_id % 5) ELSE t END AS t FROM {_EV} WHERE event_type IN ('click', 'purchase'))) WHERE t >= high - {2 * HOUR}")
def j9(spark: SparkSession, d: str) -> DataFrame:
    late = _of(spark, d, "purchase").withColumn("t", F.col("t") - F.lit(HOUR) * (F.col("event_id") % 5))
    return j.pace([_of(spark, d, "click"), late], "t", "event_id", by_arrival(), 2 * HOUR).select("event_id")


@query("j10_synchronize", f"SELECT 'l' AS side, event_id FROM {_CLICKS} WHERE t <= least((SELECT max(t) FROM {_CLICKS}), (SELECT max(t) FROM {_BUYS})) UNION ALL SELECT 'r', event_id FROM {_BUYS} WHERE t <= least((SELECT max(t) FROM {_CLICKS}), (SELECT max(t) FROM {_BUYS}))")
def j10(spark: SparkSession, d: str) -> DataFrame:
    l, r = j.synchronize(_of(spark, d, "click"), _of(spark, d, "purchase"), "t", "t")
    return l.select(F.lit("l").alias("side"), "event_id").unionByName(r.select(F.lit("r").alias("side"), "event_id"))


@query("j11_impute", f"WITH m AS (SELECT user_id, avg(value) AS m FROM {_EV} WHERE t < {START + 10 * DAY} GROUP BY 1) SELECT event_id, round(coalesce(CASE WHEN event_type <> 'error' THEN value END, m) + 1e-9, 6) AS value FROM {_EV} LEFT JOIN m USING (user_id)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    gaps = e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return j.impute(gaps, e.filter(F.col("t") < START + 10 * DAY), ["user_id"], "value").select("event_id", rounded("value"))


@query("j12_archive_at", f"SELECT event_id FROM {_EV} WHERE t // {HOUR} IN (SELECT t // {HOUR} FROM {_EV} WHERE event_type = 'signup')")
def j12(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("h", F.call_function("div", F.col("t"), F.lit(HOUR)))
    return j.archive_at(e.filter("event_type = 'signup'"), e, "h").select("event_id")
