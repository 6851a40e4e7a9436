"""Window, group, running and partition aggregates on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.operators import aggregates as a
from brooklet.operators import windows as w
from brooklet.operators.templates import Merge, merge
from brooklet.plans.common import HOUR, MINUTE, START, by_arrival, events, query, rounded
from brooklet.session import table

_EV = "(SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value FROM events)"


def _ids(span: int, slide: int) -> str:
    return f"SELECT *, (t - {START}) // {slide} AS wf, ((t - {START}) + {span}) // {slide} - 1 AS wt FROM {_EV}"


def _spread(span: int, slide: int) -> str:
    return f"SELECT * EXCLUDE (wf, wt), unnest(range(wf, wt + 1)) AS wid_from_w FROM ({_ids(span, slide)}) WHERE wt >= wf"


@query("w1_bucket", f"SELECT event_id, wf AS wid_from_w, wt AS wid_to_w FROM ({_ids(HOUR, 10 * MINUTE)})")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return w.bucket(events(spark, d), "t", HOUR, 10 * MINUTE, START).select("event_id", "wid_from_w", "wid_to_w")


@query("w1_tuple_bucket", f"SELECT event_id, n // 30 AS wid_from_w, (n + 100) // 30 - 1 AS wid_to_w FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM {_EV})")
def w1_tuple(spark: SparkSession, d: str) -> DataFrame:
    return w.tuple_bucket(events(spark, d), "event_id", by_arrival(), 100, 30).select("event_id", "wid_from_w", "wid_to_w")


@query("w2_bucket_with_gaps", f"SELECT wid_from_w, count(*)::BIGINT AS n FROM ({_spread(20 * MINUTE, HOUR)}) GROUP BY 1")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return w.aggregate(w.bucket(events(spark, d), "t", 20 * MINUTE, HOUR, START), [], n=w.count())


@query("w3_window_count", f"SELECT event_type, wid_from_w, count(value)::BIGINT AS n FROM ({_spread(HOUR, 10 * MINUTE)}) GROUP BY 1, 2")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return w.aggregate(w.bucket(events(spark, d), "t", HOUR, 10 * MINUTE, START), ["event_type"], n=w.count("value"))


@query("w4_window_sum", f"SELECT event_type, wid_from_w, round(sum(value) + 1e-9, 6) AS total FROM ({_spread(HOUR, 10 * MINUTE)}) GROUP BY 1, 2")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return w.aggregate(w.bucket(events(spark, d), "t", HOUR, 10 * MINUTE, START), ["event_type"], total=w.total("value")).select("event_type", "wid_from_w", rounded("total"))


@query("w5_window_long_sum", f"SELECT user_id, wid_from_w, sum(event_id)::BIGINT AS total FROM ({_spread(24 * HOUR, 6 * HOUR)}) GROUP BY 1, 2")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return w.aggregate(w.bucket(events(spark, d), "t", 24 * HOUR, 6 * HOUR, START), ["user_id"], total=w.long_total("event_id"))


@query("w6_window_max", f"SELECT user_id, wid_from_w, max(value) AS highest, greatest(0, trunc(max(value))::BIGINT) AS whole FROM ({_spread(24 * HOUR, 6 * HOUR)}) GROUP BY 1, 2")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return w.aggregate(w.bucket(events(spark, d), "t", 24 * HOUR, 6 * HOUR, START), ["user_id"], highest=w.largest("value"), whole=w.largest("value", compat=True))


@query("window_average", f"SELECT event_type, wid_from_w, round(avg(value) + 1e-9, 6) AS mean FROM ({_spread(HOUR, MINUTE)}) GROUP BY 1, 2")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return w.aggregate(w.bucket(events(spark, d), "t", HOUR, MINUTE, START), ["event_type"], mean=w.average("value")).select("event_type", "wid_from_w", rounded("mean"))


@query(
    "w7_window_average_of_parts",
    f"SELECT event_type, (wid_from_w + 6) // 6 - 1 AS wid_from_v, round(sum(s) / sum(n) + 1e-9, 6) AS mean FROM (SELECT event_type, wid_from_w, sum(value) AS s, count(value) AS n FROM ({_spread(10 * MINUTE, 10 * MINUTE)}) GROUP BY 1, 2) GROUP BY 1, 2",
)
def w7_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = w.aggregate(w.bucket(events(spark, d), "t", 10 * MINUTE, 10 * MINUTE, START), ["event_type"], s=w.total("value"), n=w.count("value"))
    whole = w.aggregate(w.bucket(parts, "wid_from_w", 6, 6, 0, "v"), ["event_type"], "v", mean=w.average("s", "n"))
    return whole.select("event_type", "wid_from_v", rounded("mean"))


@query("w8_window_average_early", f"SELECT wid_from_w, round(avg(value) + 1e-9, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY wid_from_w ORDER BY event_id) AS n FROM ({_spread(HOUR, 10 * MINUTE)})) WHERE n <= 6 GROUP BY 1")
def w8(spark: SparkSession, d: str) -> DataFrame:
    held = w.bucket(events(spark, d), "t", HOUR, 10 * MINUTE, START)
    return w.early_average(held, [], "value", "event_id", 5, to="mean").select("wid_from_w", rounded("mean"))


@query("w10_sliding_tuple_windows", f"SELECT wid_from_w, count(*)::BIGINT AS n, round(sum(value) + 1e-9, 6) AS total, max(value) AS highest, round(avg(value) + 1e-9, 6) AS mean FROM (SELECT value, unnest(range(n // 50, (n + 200) // 50)) AS wid_from_w FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS n FROM {_EV})) GROUP BY 1")
def w10(spark: SparkSession, d: str) -> DataFrame:
    held = w.tuple_bucket(events(spark, d), "event_id", by_arrival(), 200, 50)
    return w.aggregate(held, [], n=w.count(), total=w.total("value"), highest=w.largest("value"), mean=w.average("value")).select("wid_from_w", "n", rounded("total"), "highest", rounded("mean"))


@query("w11_partition_average", f"SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS mean FROM {_EV}")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return a.partition_average(events(spark, d), ["user_id"], "value", "event_id", by_arrival(), 5, "mean").select("event_id", "user_id", rounded("mean"))


@query("w11_landmark_average", f"SELECT event_id, user_id, round(m + 1e-9, 6) AS mean FROM (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM {_EV})) WHERE o IS NULL OR abs(m - o) > 1e-12")
def w11_landmark(spark: SparkSession, d: str) -> DataFrame:
    return a.partition_average(events(spark, d), ["user_id"], "value", "event_id", by_arrival(), None, "mean").select("event_id", "user_id", rounded("mean"))


@query("w12_partition_max", f"SELECT event_id, event_type, greatest(10.0, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS highest FROM {_EV}")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return a.partition_max(events(spark, d), ["event_type"], "value", "event_id", by_arrival(), 10, 10.0, "highest").select("event_id", "event_type", "highest")


for _kind, _sql in (("count", "count(value)::BIGINT"), ("sum", "round(sum(value) + 1e-9, 6)"), ("average", "round(avg(value) + 1e-9, 6)"), ("max", "round(max(value) + 1e-9, 6)"), ("min", "round(min(value) + 1e-9, 6)"), ("variance", "round(var_pop(value) + 1e-9, 6)")):

    def _run(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        found = a.group_aggregate(events(spark, d), ["user_id"], kind, "value", "x")
        return found if kind == "count" else found.select("user_id", rounded("x"))

    query(f"a{('count', 'sum', 'average', 'max', 'min', 'variance').index(_kind) + 1}_{_kind}", f"SELECT user_id, {_sql} AS x FROM {_EV} GROUP BY 1")(_run)


@query("a6_whole_input", "SELECT count(l_quantity)::BIGINT AS n, round(avg(l_quantity) + 1e-9, 6) AS mean, round(var_pop(l_quantity) + 1e-9, 6) AS variance FROM lineitem")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return a.user_aggregate(table(spark, d, "lineitem"), [], n=F.count("l_quantity"), mean=F.round(F.avg("l_quantity") + 1e-9, 6), variance=F.round(F.var_pop("l_quantity") + 1e-9, 6))


@query("a7_nest", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return a.nest(table(spark, d, "nation"), ["n_regionkey"], F.col("n_name"), "n_nationkey", "names")


@query(
    "a8_incremental_max",
    f"""SELECT event_id, user_id, old_max, new_max FROM (SELECT event_id, user_id, m AS new_max, lag(m, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id) AS old_max
FROM (SELECT *, greatest(0.0, max(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS m FROM {_EV})) WHERE new_max <> old_max""",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    return a.incremental_max(events(spark, d), ["user_id"], "value", "event_id", by_arrival(), 0.0).select("event_id", "user_id", "old_max", "new_max")


@query("a9_incremental_average", f"SELECT event_id, user_id, round(m + 1e-9, 6) AS new_avg FROM (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM {_EV})) WHERE o IS NULL OR abs(m - o) > 1e-12")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return a.incremental_average(events(spark, d), ["user_id"], "value", "event_id", by_arrival()).select("event_id", "user_id", rounded("new_avg"))


@query(
    "a11_accumulate",
    """WITH c AS (SELECT c_nationkey AS nation, count(*)::BIGINT AS n, max(c_acctbal) AS best FROM customer WHERE c_nationkey < 20 GROUP BY 1),
s AS (SELECT s_nationkey AS nation, count(*)::BIGINT AS n, max(s_acctbal) AS other FROM supplier WHERE s_nationkey > 3 GROUP BY 1)
SELECT nation, coalesce(s.n, c.n) AS n, best, other FROM c FULL JOIN s USING (nation)""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("best"))
    s = table(spark, d, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.max("s_acctbal").alias("other"))
    return a.accumulate(c, s, ["nation"], "full", "right")


@query(
    "a11_accumulate_nested",
    """WITH l AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*)::BIGINT AS n FROM customer WHERE c_nationkey < 20 AND c_acctbal >= 5000 GROUP BY 1, 2),
r AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*)::BIGINT AS n, min(c_acctbal) AS low FROM customer WHERE c_nationkey > 3 AND c_acctbal < 2000 GROUP BY 1, 2),
ln AS (SELECT nation, sum(n)::BIGINT AS n FROM l GROUP BY 1), rn AS (SELECT nation, sum(n)::BIGINT AS n, min(low) AS low FROM r GROUP BY 1)
SELECT nation, segment, coalesce(l.n, r.n) AS n, r.low, coalesce(ln.n, rn.n) AS whole, rn.low AS lowest FROM l FULL JOIN r USING (nation, segment) LEFT JOIN ln USING (nation) LEFT JOIN rn USING (nation)""",
)
def a11_nested(spark: SparkSession, d: str) -> DataFrame:
    def side(condition: str, low: Column) -> DataFrame:
        parts = table(spark, d, "customer").filter(condition).groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), low.alias("low"))
        return parts.groupBy("nation").agg(F.struct(F.sum("n").alias("n"), F.min("low").alias("low")).alias("whole"), F.array_sort(F.collect_list(F.struct("segment", "n", "low"))).alias("parts"))

    left, right = side("c_nationkey < 20 AND c_acctbal >= 5000", F.min(F.lit(None).cast("double"))), side("c_nationkey > 3 AND c_acctbal < 2000", F.min("c_acctbal"))
    merged = a.accumulate_nested(left, right, ["nation"], {"parts": "segment"})
    return merged.select("nation", F.col("whole.n").alias("whole"), F.col("whole.low").alias("lowest"), F.inline("parts"))


@query(
    "a11_merge_template",
    """WITH l AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS custkey, c_acctbal AS bal, c_name AS name FROM customer WHERE c_acctbal >= 2000),
r AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS custkey, c_acctbal AS bal, upper(c_name) AS name FROM customer WHERE c_acctbal < 6000 AND c_nationkey > 3),
ls AS (SELECT nation, segment, count(*)::BIGINT AS n, max(bal) AS best FROM l GROUP BY 1, 2), rs AS (SELECT nation, segment, count(*)::BIGINT AS n, max(bal) AS best FROM r GROUP BY 1, 2)
SELECT nation, segment, coalesce(ls.n + rs.n, ls.n, rs.n) AS n, greatest(ls.best, rs.best) AS best, custkey, coalesce(r.name, l.name) AS name, round(coalesce(l.bal + r.bal, l.bal, r.bal), 2) AS bal
FROM l FULL JOIN r USING (nation, segment, custkey) LEFT JOIN ls USING (nation, segment) LEFT JOIN rs USING (nation, segment) WHERE rs.n IS NOT NULL""",
)
def a11_template(spark: SparkSession, d: str) -> DataFrame:
    """Segments of nations, and people of segments: numbers are added up, names come from the right, segments without one on the right go."""

    def side(condition: str, name: Column) -> DataFrame:
        held = table(spark, d, "customer").filter(condition).select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_custkey").alias("custkey"), name.alias("name"), F.col("c_acctbal").alias("bal")).alias("person"))
        parts = held.groupBy("nation", "segment").agg(F.count("*").alias("n"), F.max("person.bal").alias("best"), F.collect_list("person").alias("people"))
        return parts.groupBy("nation").agg(F.collect_list(F.struct("segment", "n", "best", "people")).alias("segments"))

    people = Merge(type="outer", key=("custkey",), children={"custkey": Merge(), "name": Merge(side="right"), "bal": Merge("sum")})
    segments = Merge(type="right", key=("segment",), children={"segment": Merge(), "n": Merge("sum", type="outer"), "best": Merge("max", type="outer"), "people": people})
    merged = merge(side("c_acctbal >= 2000", F.col("c_name")), side("c_acctbal < 6000 AND c_nationkey > 3", F.upper("c_name")), ["nation"], Merge(children={"segments": segments}))
    return merged.select("nation", F.inline("segments")).select("nation", "segment", "n", "best", F.inline("people")).withColumn("bal", F.round("bal", 2))
