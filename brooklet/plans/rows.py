"""Sources, sinks, row operators, predicates, sorts and nested data on the test tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions.columns import any_pair, any_value, compare, compare_text, div, interval
from brooklet.operators import nested, rows, variants
from brooklet.plans.common import DAY, HOUR, MINUTE, START, by_arrival, events, folder, query
from brooklet.session import table
from brooklet.sources import archive, files, generated
from brooklet.operators.windows import ticks

_EV = "(SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, props FROM events)"


@query("s1_csv_stream", f"SELECT event_id, t, user_id, value FROM {_EV}")
def s1(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "s1")
    files.write_csv_with_control(events(spark, d).select("event_id", "t", "user_id", "value"), "t", HOUR, where)
    return files.csv_stream(spark, where, files.declared("event_id t user_id value", "long TS long double"))[0]


@query("s1_control_rows", f"SELECT ((SELECT min(t) FROM {_EV}) // {HOUR} + k) * {HOUR} AS t FROM (SELECT unnest(range(1, ((SELECT max(t) FROM {_EV}) + {HOUR} - ((SELECT min(t) FROM {_EV}) // {HOUR} + 1) * {HOUR} + {HOUR} - 1) // {HOUR} + 1)) AS k)")
def s1_control(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "s1c")
    files.write_csv_with_control(events(spark, d).select("event_id", "t", "user_id", "value"), "t", HOUR, where)
    marks = files.csv_stream(spark, where, files.declared("event_id t user_id value", "long TS long double"))[1]
    return marks.select(F.col("t").cast("long").alias("t"))


@query("s2_xml_scan", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation")
def s2(spark: SparkSession, d: str) -> DataFrame:
    nation, where = table(spark, d, "nation"), folder(spark, "s2")
    files.write_xml(nation, where, "nation")
    return files.xml_scan(spark, where, "nation", nation.schema)


@query("s3_registered_stream", "SELECT r_regionkey::INTEGER AS r_regionkey, upper(r_name) AS r_name FROM region")
def s3(spark: SparkSession, d: str) -> DataFrame:
    region, where = table(spark, d, "region"), folder(spark, "s3")
    files.write_xml(region, where, "region")
    files.xml_scan(spark, where, "region", region.schema).createOrReplaceTempView("region_stream")
    return spark.sql("SELECT r_regionkey, upper(r_name) AS r_name FROM region_stream")


def _draw(n: str, salt: int, choices: int) -> str:
    return f"(((({n}) * 7919 + {salt} * 104729) % 1000003 * 31 + {salt}) % {choices})"


@query(
    "s5_auction_generator",
    f"""WITH b AS (SELECT id, floor(pow({_draw("id", 5, 10000)} / 10000.0, 3) * (SELECT 50 + count(*) FROM customer))::BIGINT AS auction_id, {_draw("id", 7, 500)} + 1 AS bid FROM (SELECT unnest(range((SELECT 10 * count(*) FROM customer))) AS id)),
a AS (SELECT id AS auction_id, {_draw("id", 2, 20)} AS category FROM (SELECT unnest(range((SELECT 50 + count(*) FROM customer))) AS id))
SELECT category::BIGINT AS category, count(*)::BIGINT AS bids, max(bid)::BIGINT AS highest FROM b JOIN a USING (auction_id) GROUP BY category""",
)
def s5_auction(spark: SparkSession, d: str) -> DataFrame:
    made = generated.auction(spark, table(spark, d, "customer").count())  # a call for each customer
    return made["bid"].join(made["open_auction"], "auction_id").groupBy("category").agg(F.count("*").alias("bids"), F.max("bid").alias("highest"))


@query(
    "s5_traffic_generator",
    f"""SELECT (id % 360) // 40 AS segment_id, count(*)::BIGINT AS n, sum(CASE WHEN {_draw("id", 11, 100)} < 6 THEN 0 ELSE {_draw("id", 12, 60)} + 5 END)::BIGINT AS speed, sum({_draw("id", 13, 10)})::BIGINT AS volume
FROM (SELECT unnest(range((SELECT count(*) // 100 * 360 FROM events))) AS id) GROUP BY 1""",
)
def s5_traffic(spark: SparkSession, d: str) -> DataFrame:
    return generated.traffic(spark, reports=table(spark, d, "events").count() // 100).groupBy("segment_id").agg(F.count("*").alias("n"), F.sum("speed").alias("speed"), F.sum("volume").alias("volume"))


@query("s5_temperature_generator", f"SELECT id % 10 AS station, max({_draw('id', 21, 400)} - 100)::BIGINT AS highest FROM (SELECT unnest(range((SELECT count(*) // 2 FROM events))) AS id) GROUP BY 1")
def s5_temperature(spark: SparkSession, d: str) -> DataFrame:
    return generated.temperature(spark, table(spark, d, "events").count() // 2).groupBy("station").agg(F.max("tenths").alias("highest"))


@query("s5_packet_generator", f"SELECT CASE {_draw('id', 33, 3)} WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol, count(*)::BIGINT AS n, sum({_draw('id', 34, 1460)} + 40)::BIGINT AS bytes FROM (SELECT unnest(range((SELECT 2 * count(*) FROM events))) AS id) GROUP BY 1")
def s5_packets(spark: SparkSession, d: str) -> DataFrame:
    return generated.packets(spark, 2 * table(spark, d, "events").count()).groupBy("protocol").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("s5_subfile_generator", "SELECT n, r_regionkey, r_name FROM (SELECT unnest(range(23)) AS n) JOIN region ON r_regionkey = n % 5")
def s5_subfile(spark: SparkSession, d: str) -> DataFrame:
    region, where = table(spark, d, "region"), folder(spark, "s5")
    files.write_xml(region, where, "region")
    return generated.parts_of_file(spark, where, "region", region.schema, "r_regionkey", F.lit(0), 23).select("n", "r_regionkey", "r_name")


def _line(salt: int) -> str:
    return f"""'<line><part>' || {_draw("n", salt, 1000)} || '</part>' || CASE WHEN {_draw("n", salt + 1, 2)} > 0 THEN '<count>' || {_draw("n", salt + 2, 1000)} || '</count>' ELSE '' END || '</line>'"""


@query(
    "s5_declared_generator",
    f"""SELECT n, '<order><id>' || {_draw("n", 42, 1000)} || '</id>' || {_line(45)} || CASE WHEN {_draw("n", 43, 2)} > 0 THEN {_line(49)} ELSE '' END
|| CASE WHEN {_draw("n", 52, 2)} > 0 THEN '<note>' || {_draw("n", 53, 1000)} || '</note>' ELSE '' END || '</order>' AS xml FROM (SELECT unnest(range((SELECT count(*) // 20 FROM events))) AS n)""",
)
def s5_declared(spark: SparkSession, d: str) -> DataFrame:
    return generated.declared_documents(spark, table(spark, d, "events").count() // 20, "order", {"order": ["id", "line+", "note?"], "line": ["part", "count?"]}, most=2)


def _similar(kind: str, step: int, days: int, condition: str = "TRUE") -> str:
    return f"""WITH e AS {_EV}, s AS (SELECT DISTINCT t // {HOUR} AS h FROM e WHERE t >= {START + 25 * DAY}),
w AS (SELECT h AS for_stretch, h - k * {step} * 24 AS s FROM s, (SELECT unnest(range(1, {days} + 1)) AS k)),
k AS (SELECT * FROM w WHERE {condition})
SELECT for_stretch, count(*)::BIGINT AS n, round(sum(value) + 1e-9, 4) AS total FROM e JOIN k ON e.t // {HOUR} = k.s GROUP BY 1"""


def _archive(kind: str, days: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = events(spark, d)
        found = archive.similar_days(e.filter(F.col("t") >= START + 25 * DAY), e, "t", kind, days)
        return found.groupBy("for_stretch").agg(F.count("*").alias("n"), F.round(F.sum("value") + 1e-9, 4).alias("total"))

    return run


query("s6_archive_all_days", _similar("AllDays", 1, 5))(_archive("AllDays", 5))
query("s6_archive_week_days", _similar("WeekDays", 1, 5, "(s // 24) % 7 NOT IN (2, 3)"))(_archive("WeekDays", 5))
query("s6_archive_same_day_of_week", _similar("SameDayOfWeek", 7, 2))(_archive("SameDayOfWeek", 2))


@query(
    "s6_archive_weather",
    f"""WITH e AS (SELECT *, t // {HOUR} AS s FROM {_EV}), l AS (SELECT s, round(avg(value) + 1e-9, 6) AS level FROM e GROUP BY 1),
c AS (SELECT a.s AS for_stretch, l.s, abs(l.level - n.level) AS far, n.level AS now FROM (SELECT DISTINCT s FROM e WHERE t >= {START + 25 * DAY}) a
JOIN l ON l.s < a.s AND l.s >= a.s - 20 * 24 AND (a.s - l.s) % 24 = 0 AND (l.s // 24) % 7 NOT IN (2, 3) JOIN l n ON n.s = a.s),
k AS (SELECT * FROM c WHERE far <= 3 QUALIFY row_number() OVER (PARTITION BY for_stretch ORDER BY CASE WHEN now > 0 THEN far END, s DESC) <= 2)
SELECT for_stretch, count(*)::BIGINT AS n, round(sum(value) + 1e-9, 4) AS total FROM e JOIN k USING (s) GROUP BY 1""",
)
def s6_weather(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    levels = e.groupBy(div("t", HOUR).alias("stretch")).agg(F.round(F.avg("value") + 1e-9, 6).alias("level"))
    found = archive.similar_conditions(e.filter(F.col("t") >= START + 25 * DAY), e, levels, "t", "WeekDays", 2, 3.0, 20)
    return found.groupBy("for_stretch").agg(F.count("*").alias("n"), F.round(F.sum("value") + 1e-9, 4).alias("total"))


@query("s8_constant_scan", f"SELECT id, sum(value * x)::DOUBLE AS weighted, count(*)::BIGINT AS n FROM (SELECT id, x, (value * 100)::BIGINT AS value FROM {_EV} JOIN (VALUES (1, 'click', 2), (2, 'view', 3)) v(id, name, x) ON name = event_type) GROUP BY 1")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Literal rows joined to the events."""
    held = files.constant(spark, [(1, "click", 2), (2, "view", 3)], "id name x", "int string int")
    met = events(spark, d).join(F.broadcast(held), F.col("name") == F.col("event_type"))  # two rows
    return met.groupBy("id").agg(F.sum(F.round(F.col("value") * 100).cast("long") * F.col("x")).cast("double").alias("weighted"), F.count("*").alias("n"))


@query("s9_documents", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return files.documents(spark, [f"{d}/region.parquet", f"{d}/region.parquet"], table(spark, d, "region").schema)


@query("s9_texts", "SELECT count(*)::BIGINT AS names FROM nation")
def s9_texts(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "s9")
    files.write_xml(table(spark, d, "nation"), where, "nation")
    return files.texts(spark, [where]).agg(F.sum(F.regexp_count("text", F.lit("<n_name>"))).cast("long").alias("names"))


@query("s9_resource", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def s9_resource(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "s9")
    files.store(table(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name"), "some_nations", where)
    return files.resource(spark, "some_nations", where)


@query(
    "s10_timer_relative",
    f"""WITH m AS (SELECT max(t) AS m FROM {_EV}), k AS (SELECT unnest(range((SELECT (m - {START} + {90 * MINUTE // 60} - 1) // {90 * MINUTE // 60} FROM m))) AS k)
SELECT x - x % {MINUTE} AS tick FROM (SELECT k * {90 * MINUTE} - 5000000 AS x FROM k)""",
)
def s10_relative(spark: SparkSession, d: str) -> DataFrame:
    """Ticks up to the last event."""
    end = events(spark, d).agg(F.max("t")).first()[0]
    return ticks(spark, START, end, interval("1 hour 30 minutes") * 1000, relative=START, slack=interval("5 seconds") * 1000, granularity=interval("1 minute") * 1000, warp=60)


@query(
    "s10_timer",
    f"""WITH k AS (SELECT {START} + unnest(range((SELECT (max(t) - {START}) // {90 * MINUTE} + 1 FROM {_EV}))) * {90 * MINUTE} AS tick)
SELECT tick, (SELECT count(*) FROM {_EV} WHERE t >= tick AND t < tick + {90 * MINUTE})::BIGINT AS n FROM k""",
)
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Ticks up to the last event, and the events from each to the next."""
    e, period = events(spark, d), interval("1 hour 30 minutes") * 1000
    n = e.groupBy((F.lit(START) + div(F.col("t") - START, period) * period).alias("tick")).agg(F.count("*").alias("n"))
    return ticks(spark, START, e.agg(F.max("t")).first()[0] + 1, period).join(n, "tick", "left").select("tick", F.coalesce("n", F.lit(0)).alias("n"))


@query("s13_tunables", f"SELECT name, value, CASE WHEN value IS NOT NULL THEN ((SELECT count(*) FROM {_EV}) + value::BIGINT - 1) // value::BIGINT END AS pages FROM (VALUES ('brooklet.page.rows', '30'), ('brooklet.stream.pages', '5'), ('brooklet.unset', NULL)) v(name, value)")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Settings, and how many pages of so many rows the events are."""
    spark.conf.set("brooklet.page.rows", "30")
    spark.conf.set("brooklet.stream.pages", "5")
    held = files.tunables(spark, ["brooklet.page.rows", "brooklet.stream.pages", "brooklet.unset"])
    rows_ = events(spark, d).agg(F.count("*").alias("n"))  # one row
    of = F.col("value").cast("long")
    return held.crossJoin(F.broadcast(rows_)).select("name", "value", div(F.col("n") + of - 1, of).alias("pages"))


@query("k1_store", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return files.store(table(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey", "n_name"), "kept_nations", folder(spark, "k1"))


@query("k3_deliver", "SELECT '<row><id>' || s_suppkey || '</id><name>' || s_name || '</name></row>' AS result FROM supplier")
def k3(spark: SparkSession, d: str) -> DataFrame:
    built = nested.construct(table(spark, d, "supplier"), "xml", "row", {"id": F.col("s_suppkey"), "name": F.col("s_name")})
    return files.deliver(built, "xml")


@query("p1_project", "SELECT l_orderkey, l_quantity FROM lineitem")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return rows.project(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity"])


@query("p2_rename", "SELECT c_custkey AS customer, c_name AS name FROM customer")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return rows.rename(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"], ["customer", "name"])


@query("p3_select", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount <= 0.02) OR NOT (l_returnflag <> 'R' OR l_tax < 0.08)")
def p3(spark: SparkSession, d: str) -> DataFrame:
    p = (compare(F.col("l_quantity"), "gt", F.lit(45)) & compare(F.col("l_discount"), "le", F.lit(0.02))) | ~(compare(F.col("l_returnflag"), "ne", F.lit("R")) | compare(F.col("l_tax"), "lt", F.lit(0.08)))
    return rows.select(table(spark, d, "lineitem"), p).select("l_orderkey", "l_linenumber", "l_quantity")


@query("p4_select_alternate", f"SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM {_EV} WHERE value > 20) WHERE n % 2 = 0")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return rows.select_alternate(events(spark, d), F.col("value") > 20, "event_id", by_arrival()).select("event_id", "value")


@query("p5_apply", f"SELECT event_id, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS high FROM {_EV}")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return rows.apply(events(spark, d), F.col("value") >= 50, "high").select("event_id", "high")


@query("p6_expression", f"SELECT event_id, CASE WHEN value > 100 THEN value * 2 ELSE value + 1 END AS y FROM {_EV} WHERE event_type <> 'error'")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return rows.expression(events(spark, d), "y", "CASE WHEN event_type = 'error' THEN NULL WHEN value > 100 THEN value * 2 ELSE value + 1 END").select("event_id", "y")


@query("p7_prefix", f"SELECT event_id, t FROM {_EV} ORDER BY event_id LIMIT 100")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return rows.prefix(events(spark, d).select("event_id", "t"), 100, "event_id")


@query("p8_dup", f"SELECT event_type, 'n' AS what, count(*)::DOUBLE AS x FROM {_EV} GROUP BY 1 UNION ALL SELECT event_type, 'max', max(value) FROM {_EV} GROUP BY 1")
def p8(spark: SparkSession, d: str) -> DataFrame:
    a, b = rows.dup(events(spark, d), 2)
    one = a.groupBy("event_type").agg(F.count("*").cast("double").alias("x")).withColumn("what", F.lit("n"))
    return one.unionByName(b.groupBy("event_type").agg(F.max("value").alias("x")).withColumn("what", F.lit("max")))


@query("p9_expensive", f"SELECT event_id FROM {_EV} WHERE value > 90")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return rows.expensive(events(spark, d), 10).filter("value > 90").select("event_id")


@query("p10_instrument", f"SELECT event_id, value FROM {_EV}")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return rows.instrument(events(spark, d).select("event_id", "value"), "events", highest=F.max("value"))[0]


@query("p11_feedback_fixed", f"SELECT event_id, t FROM {_EV} WHERE NOT (t <= {START + DAY} AND user_id <= 15)")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return rows.suppress(events(spark, d), ["t", "user_id"], ["le", "le"], [START + DAY, 15]).select("event_id", "t")


@query("p12_feedback_configured", f"SELECT event_id, value FROM {_EV} WHERE NOT (value < 5 AND event_type = 'view')")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return rows.suppress(events(spark, d), ["v", "event_type"], ["lt", "eq"], [5, "view"], {"v": "value"}).select("event_id", "value")


@query("r2_compare_text", f"""SELECT event_id, (CASE WHEN regexp_full_match(a, '[0-9]+\\.?[0-9]*') AND regexp_full_match(b, '[0-9]+\\.?[0-9]*') THEN a::DOUBLE > b::DOUBLE ELSE a > b END) AS greater
FROM (SELECT event_id, value::INTEGER::VARCHAR AS a, CASE WHEN event_id % 3 = 0 THEN '-1' WHEN event_id % 3 = 1 THEN '9' ELSE 'abc' END AS b FROM (SELECT event_id, floor(value) AS value FROM events))""")
def r2(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    b = F.when(F.col("event_id") % 3 == 0, "-1").when(F.col("event_id") % 3 == 1, "9").otherwise("abc")
    # Floored doubles are at most 491 here, so a case that casts never meets text.
    both = e.select("event_id", F.floor("value").cast("string").alias("a"), b.alias("b"))
    return both.select("event_id", compare_text(F.col("a"), "gt", F.col("b")).alias("greater"))


@query("r3_any_pair", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), string_split('red ring', ' '))")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(any_pair(F.split("p_name", " "), "eq", F.array(F.lit("red"), F.lit("ring")))).select("p_partkey")


def _nation_xml(spark: SparkSession, d: str) -> DataFrame:
    return nested.construct(table(spark, d, "nation"), "xml", "nation", {"name": F.col("n_name"), "region": F.col("n_regionkey")})


@query("r4_path_vs_const", "SELECT n_nationkey FROM nation WHERE n_regionkey >= 3")
def r4(spark: SparkSession, d: str) -> DataFrame:
    regions = nested.xml_values(F.col("xml"), ["nation", "region"])
    return _nation_xml(spark, d).filter(any_value(regions, "ge", F.lit("3"))).select("n_nationkey")


@query("r5_const_vs_variable", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 45 < l_quantity")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return rows.select(table(spark, d, "lineitem"), compare(F.lit(45), "lt", F.col("l_quantity"))).select("l_orderkey", "l_linenumber")


@query("r7_null_operand", f"SELECT event_id FROM {_EV} WHERE event_type <> 'error' AND event_type <> 'view'")
def r7(spark: SparkSession, d: str) -> DataFrame:
    """A null operand makes the comparison unknown, and the row goes: those of type error have a null here."""
    known = F.when(F.col("event_type") != "error", F.col("event_type"))
    return rows.select(events(spark, d), compare(known, "ne", F.lit("view"))).select("event_id")


@query("r6_contain", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'wid')")
def r6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(compare(F.col("p_name"), "contain", F.lit("wid"))).select("p_partkey", "p_name")


@query("o1_sort_numeric", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return nested.sort(table(spark, d, "customer"), "c_acctbal", "c_custkey", descending=True).select("c_custkey", "c_mktsegment")


@query("o1_sort_alphabetic", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def o1_alphabetic(spark: SparkSession, d: str) -> DataFrame:
    return nested.sort(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", alphabetic=True)


@query("o2_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return nested.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@query("u1_unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return nested.unnest(table(spark, d, "part"), F.split("p_name", " "), "word").select("p_partkey", "word")


@query("u1_unnest_outer", "SELECT p_partkey, w AS word FROM part LEFT JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) x USING (p_partkey) WHERE p_size > 10 AND w IS NOT NULL UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 10")
def u1_outer(spark: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("p_size") > 10, F.split("p_name", " "))
    return nested.unnest(table(spark, d, "part"), words, "word", "yes").select("p_partkey", "word")


@query("u1_unnest_path", "SELECT n_nationkey, n_name AS name FROM nation")
def u1_path(spark: SparkSession, d: str) -> DataFrame:
    built = nested.construct(table(spark, d, "nation"), "xml", "nation", {"name": F.col("n_name"), "region": F.col("n_regionkey")})
    return nested.unnest(built, nested.xml_values(F.col("xml"), ["nation", "name|title"]), "name").select("n_nationkey", "name")


@query("u1_unnest_element", "SELECT n_nationkey, '<name>' || n_name || '</name>' AS node FROM nation")
def u1_element(spark: SparkSession, d: str) -> DataFrame:
    return nested.unnest(_nation_xml(spark, d), nested.xml_nodes(F.col("xml"), ["nation", "name"], "element"), "node").select("n_nationkey", "node")


@query("u1_unnest_tag", "SELECT n_nationkey, unnest(['name', 'region']) AS tag FROM nation")
def u1_tag(spark: SparkSession, d: str) -> DataFrame:
    return nested.unnest(_nation_xml(spark, d), nested.xml_nodes(F.col("xml"), ["nation", "$"], "tag"), "tag").select("n_nationkey", "tag")


@query("u1_unnest_typed", "SELECT n_nationkey, unnest([NULL, n_regionkey::BIGINT]) AS number FROM nation")
def u1_typed(spark: SparkSession, d: str) -> DataFrame:
    return nested.unnest(_nation_xml(spark, d), nested.xml_nodes(F.col("xml"), ["nation", "name|region"], "content", "bigint"), "number").select("n_nationkey", "number")


@query("u1_unnest_closure", "SELECT n_nationkey, unnest([n_name, n_name || '2', n_name || '3']) AS name FROM nation")
def u1_closure(spark: SparkSession, d: str) -> DataFrame:
    """Names at any depth of groups, inside an optional element as well."""
    name = lambda mark: F.concat(F.lit("<name>"), F.col("n_name"), F.lit(f"{mark}</name>"))
    xml = F.concat(F.lit("<nation>"), name(""), F.lit("<group><group>"), name("2"), F.lit("</group></group><group><old>"), name("3"), F.lit("</old></group><other>"), name("4"), F.lit("</other></nation>"))
    built = table(spark, d, "nation").withColumn("xml", xml)
    return nested.unnest(built, nested.xml_nodes(F.col("xml"), ["nation", "group*", "old?", "name"]), "name").select("n_nationkey", "name")


@query("u1_unnest_variant", "SELECT p_partkey, name FROM (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS name FROM part) WHERE name IS NOT NULL")
def u1_variant(spark: SparkSession, d: str) -> DataFrame:
    """Names at any depth of groups of a JSON document, without leaving the JVM."""
    listed = lambda c: F.to_json(F.array(c))
    document = F.concat(F.lit('{"name":'), listed("p_name"), F.lit(',"group":[{"name":'), listed("p_brand"), F.lit('},{"group":{"old":{"n":1,"name":'), listed("p_type"), F.lit('}}}],"other":{"name":"x"}}'))
    parsed = table(spark, d, "part").withColumn("v", F.parse_json(document))
    return nested.unnest(parsed, variants.values(F.col("v"), ["group*", "old?", "name"]), "name").select("p_partkey", "name")


@query("u1_unnest_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def u1_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = events(spark, d).withColumn("p", F.from_json("props", "k long"))
    return nested.unnest(parsed, F.array("p.k"), "k").select("event_id", "k")


@query("u2_unnest_where", "SELECT p_partkey, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) > 4")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return nested.unnest_where(table(spark, d, "part"), F.split("p_name", " "), "word", lambda w: F.length(w) > 4).select("p_partkey", "word")


@query("u4_construct", "SELECT '<event><id>' || event_id || '</id><type>' || event_type || '</type></event>' AS xml FROM events")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return nested.construct(events(spark, d), "xml", "event", {"id": F.col("event_id"), "type": F.col("event_type")}).select("xml")


@query("u6_interest", f"SELECT event_id, event_type FROM {_EV} WHERE (['click', 'view', 'error'])[(t // {HOUR}) % 3 + 1] = event_type")
def u6(spark: SparkSession, d: str) -> DataFrame:
    return rows.interest(events(spark, d), "event_type", "t", HOUR, ["click", "view", "error"]).select("event_id", "event_type")


@query("u7_table_function", "SELECT p_partkey, i::INTEGER AS place, string_split(p_name, ' ')[i] AS word FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def u7_table(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="place int, word string")
    class Words:
        def eval(self, text: str):
            yield from enumerate((text or "").split(" "), 1)

    return rows.table_function(table(spark, d, "part"), Words, ["p_name"]).select("p_partkey", "place", "word")


@query("u7_user_aggregate", "SELECT event_type, round(exp(avg(ln(value + 1))) + 1e-9, 6) AS mean FROM events GROUP BY 1")
def u7_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A user's aggregate: the geometric mean, over sums that the user's function makes of the Arrow batches of a group's hour."""
    from brooklet.operators.aggregates import user_aggregate

    logs = F.pandas_udf(log_sum, "double")
    by_hour = user_aggregate(events(spark, d).withColumn("hour", F.call_function("div", F.col("t"), F.lit(HOUR))), ["event_type", "hour"], s=logs("value"), n=F.pandas_udf(size, "long")("value"))
    whole = by_hour.groupBy("event_type").agg(F.exp(F.sum("s") / F.sum("n")).alias("mean"))
    return whole.select("event_type", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


def log_sum(values: pd.Series) -> float:
    return float(np.log1p(values).sum())


def size(values: pd.Series) -> int:
    return int(values.count())


#: What a price is worth: given prices, straight lines between them.
PRICES, WORTH = (0.0, 1000.0, 10_000.0, 100_000.0, 1_000_000.0), (0.0, 50.0, 400.0, 2000.0, 5000.0)


def worth(prices: pd.Series) -> pd.Series:
    return pd.Series(np.interp(prices, PRICES, WORTH))


_BETWEEN = " ".join(f"WHEN o_totalprice < {b} THEN {c} + (o_totalprice - {a}) * {e - c} / {b - a}" for a, b, c, e in zip(PRICES[:-1], PRICES[1:], WORTH[:-1], WORTH[1:], strict=True))


@query("u7_user_function", f"SELECT o_orderkey, round(CASE {_BETWEEN} ELSE {WORTH[-1]} END + 1e-9, 6) AS worth FROM orders")
def u7(spark: SparkSession, d: str) -> DataFrame:
    convert = F.pandas_udf(worth, "double")
    return table(spark, d, "orders").select("o_orderkey", F.round(convert("o_totalprice") + 1e-9, 6).alias("worth"))
