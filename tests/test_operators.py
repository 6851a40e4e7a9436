"""Hand-made cases."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from brooklet.functions.columns import any_pair, compare, compare_text, div, interval
from brooklet.operators import aggregates, frames, grid, joins, nested, ordered, rows
from brooklet.operators import windows as w
from brooklet.sources import archive, files, generated


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bucket_sliding(spark):
    df = spark.createDataFrame([(t,) for t in (0, 9, 10, 65)], "t long")
    assert got(w.bucket(df, "t", 60, 10, 0), "t", "wid_from_w", "wid_to_w") == [(0, 0, 5), (9, 0, 5), (10, 1, 6), (65, 6, 11)]


def test_windows_from_the_least_time(spark):
    df = spark.createDataFrame([(107,), (100,), (125,)], "t long")
    assert got(w.bucket(df, "t", 20, 10), "t", "wid_from_w", "wid_to_w") == got(w.bucket(df, "t", 20, 10, 100), "t", "wid_from_w", "wid_to_w")
    assert got(w.bucket(df.filter("false"), "t", 20, 10), "t") == []


def test_bucket_with_gap_and_before_start(spark):
    df = spark.createDataFrame([(3,), (7,)], "t long")
    held = w.bucket(df, "t", 5, 10, 0)
    assert got(held, "t", "wid_from_w", "wid_to_w") == [(3, 0, -1), (7, 0, 0)]
    assert got(w.aggregate(held, [], n=w.count()), "wid_from_w", "n") == [(0, 1)]
    early = w.bucket(spark.createDataFrame([(3,)], "t long"), "t", 10, 10, 10)
    assert got(early, "wid_from_w", "wid_to_w") == [(0, -1)]


def test_tuple_bucket_counts_from_one(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "i long")
    held = w.tuple_bucket(df, "i", div("i", 2), 3, 3)
    assert got(w.aggregate(held, [], n=w.count()), "wid_from_w", "n") == [(0, 2), (1, 3), (2, 2)]


def _frames(spark, text, size, **how):
    df = spark.createDataFrame([(1, i + 1, int(c == "T")) for i, c in enumerate(text)], "g long, t long, p int")
    return got(frames.threshold_frames(df, "g", "t", "p", size, div("t", 3), **how), "frame_id", "frame_start", "frame_end")


def test_threshold_frames(spark):
    assert _frames(spark, "FFTTTTTTTF", 5) == [(1, 3, 9)]
    assert _frames(spark, "FTTTTTTTFT", 5) == [(1, 2, 8)]
    assert _frames(spark, "TTTFFFT", 3, segmentation=True) == [(1, 1, 3), (2, 4, 6)]
    assert _frames(spark, "", 3) == []


def test_delta_frames(spark):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate((50, 48, 50, 57, 55, 59, 63), 1)] + [(1, 8, None)], "g long, t long, v double")
    found = frames.delta_frames(df, "g", "t", "v", 5, div("t", 2))
    assert got(found, "frame_id", "frame_start", "frame_end", "length") == [(1, 1, 3, 3), (2, 4, 6, 3), (3, 7, 7, 1)]
    assert got(frames.delta_frames(df, "g", "t", "v", 5, div("t", 3), closed_end=True), "frame_start", "frame_end")[:2] == [(1, 4), (4, 7)]
    assert got(frames.delta_frames(df.filter("g = 2"), "g", "t", "v", 5, div("t", 2)), "frame_id") == []


def test_grid_cells(spark):
    g = grid.Grid(16, 25, 0, -33960, 52483, 33965)
    df = spark.createDataFrame([(0, 33965), (52483, 0), (1640, -32601)], "x int, y int")
    assert got(grid.grid_cell(df, "x", "y", g), "x", "cid") == [(0, 1), (1640, 385), (52483, 0)]


def test_grid_frames_give_the_old_cell(spark):
    g = grid.Grid(2, 1, 0, 0, 10, 10)
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 7.0), (1, 4, 1.0)], "g long, t long, x double").withColumn("y", F.lit(5.0))
    assert got(grid.grid_frames(df, "g", "t", "x", "y", g, div("t", 2)), "t", "st_ts", "end_ts", "cid") == [(3, 1, 3, 1), (4, 3, 4, 2)]


def test_split(spark):
    df = spark.createDataFrame([(5, 27, "a")], "s long, e long, k string")
    assert got(frames.split_on_boundaries(df, "s", "e", 0, 10), "s", "e", "k") == [(5, 10, "a"), (10, 20, "a"), (20, 27, "a")]


def test_extension_join(spark):
    l = spark.createDataFrame([(1, 0)], "k long, i long")
    r = spark.createDataFrame([(1, 1), (1, 2)], "k long, i long")
    assert got(joins.extension_join(l, r, ["k"], "i", "left"), "i", "r_i") == [(0, 1)]
    assert got(joins.extension_join(l, r, ["k"], "i", "right"), "i", "r_i") == [(0, 1), (0, 2)]
    assert got(joins.extension_join(l, r, ["k"], "i", "both"), "i", "r_i") == [(0, 1)]


def test_select_alternate(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i long")
    assert got(rows.select_alternate(df, F.col("i") >= 5, "i", div("i", 3)), "i") == [(6,), (8,)]
    assert got(rows.select_alternate(df, F.col("i") >= 5, "i", div("i", 3), True), "i") == [(5,), (7,), (9,)]


def test_union_with_none(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted(map(tuple, joins.union([a, b], {"x": ["x", "x"], "y": ["y", None]}).collect()), key=str) == [(1, 2), (3, None)]


def test_partition_average(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 5)], "g int, i long, v double")
    assert got(aggregates.partition_average(df, ["g"], "v", "i", div("i", 2), 3), "i", "avg") == [(1, 1.0), (2, 1.5), (3, 2.0), (4, 3.0)]


def test_variance_is_of_the_population(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double")
    assert got(aggregates.group_aggregate(df, [], "variance", "v", "x"), "x") == [(1.25,)]


def test_compare_text(spark):
    df = spark.createDataFrame([("10", "9"), ("10", "-1"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(compare_text(F.col("a"), "gt", F.col("b"))).collect()] == [True, True, False]
    assert df.select(compare(F.col("a"), "contain", F.lit("1"))).collect()[0][0]
    assert spark.range(1).select(any_pair(F.array(F.lit(1), F.lit(5)), "gt", F.array(F.lit(4)))).collect()[0][0]


def test_early_average(spark):
    df = spark.createDataFrame([(i, i, float(i)) for i in range(5)], "i long, t long, v double")
    assert got(w.early_average(w.bucket(df, "t", 10, 10, 0), [], "v", "i", 2), "wid_from_w", "avg") == [(0, 1.0)]


def test_window_aggregates_compat(spark):
    df = spark.createDataFrame([(0, -2.5), (1, -1.5)], "t long, v double")
    held = w.bucket(df, "t", 10, 10, 0)
    found = w.aggregate(held, [], s=w.total("v", True), m=w.largest("v", True), r=w.largest("v"))
    assert got(found, "s", "m", "r") == [(-4, 0, -1.5)]


def test_window_suppression_keeps_later_windows(spark):
    df = spark.createDataFrame([(t, 1.0) for t in range(100)], "t long, v double")
    whole = w.aggregate(w.bucket(df, "t", 30, 10, 0), [], n=w.count("v")).filter("wid_from_w > 4")
    less = w.aggregate(w.bucket(rows.suppress_windows(df, "t", 4, 30, 10, 0), "t", 30, 10, 0), [], n=w.count("v")).filter("wid_from_w > 4")
    assert got(whole, "wid_from_w", "n") == got(less, "wid_from_w", "n")


def test_ordered_against_plain_python(spark):
    values = [(g, i, (i * 7919) % 13) for i in range(200) for g in ((i * 31) % 3,)]
    df = spark.createDataFrame(values, "g long, i long, v long")
    by = div("i", 16)
    high, count = {}, {}
    expected = []
    for g, i, v in values:
        high[g], count[g] = max(high.get(g, v), v), count.get(g, 0) + 1
        expected.append((i, high[g], count[g]))
    out = ordered.running(df, ["g"], "i", by, F.col("v"), "max", "m")
    out = ordered.numbered(out, ["g"], "i", by, "n")
    assert [tuple(r) for r in out.select("i", "m", "n").orderBy("i").collect()] == expected


@pytest.mark.parametrize(("stretch", "least"), [(1, 1), (2, 3), (7, 2), (1000, 1)])
def test_runs_against_plain_python(spark, stretch, least):
    """Runs that end at, cross, and fill whole buckets; a null group; values that are null."""
    rng = random.Random(stretch)
    values = []
    for g in (1, 2, None):
        v, t = None, 0
        while t < 150:
            v = rng.choice((None, 1, 2))
            for _ in range(rng.choice((1, 1, 2, 5, 17))):
                t += rng.choice((1, 1, 3))
                values.append((g, t, v, t * 10))
    df = spark.createDataFrame(values, "g long, t long, v long, x long")
    expected = []
    for g in (1, 2, None):
        no, before, own = 0, None, sorted(r[1:] for r in values if r[0] == g)
        for v, rows_ in itertools.groupby(own, key=lambda r: r[1]):
            rows_ = list(rows_)
            if len(rows_) >= least and v != 2:
                no += 1
                expected.append((g, no, rows_[0][0], rows_[-1][0], len(rows_), v, rows_[0][2], before))
            before = (rows_[0][2], v)
    found = ordered.runs(df, ["g"], "t", div("t", stretch), ["v"], ["x"], lambda run, n: (n >= least) & ~run["v"].eqNullSafe(2))
    got_ = [(r["g"], r["run_no"], r["start"], r["end"], r["length"], r["run"]["v"], r["row"]["x"], r["before"] and (r["before"]["row"]["x"], r["before"]["run"]["v"])) for r in found.collect()]
    assert sorted(got_, key=str) == sorted(expected, key=str)
    assert ordered.runs(df.filter("t < 0"), ["g"], "t", div("t", stretch), ["v"], ["x"], lambda run, n: F.lit(True)).count() == 0


def test_ordered_with_null_groups_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "g long, i long")
    assert got(ordered.numbered(df, ["g"], "i", div("i", 2)), "i", "row_no") == [(1, 1), (2, 2), (3, 1)]
    assert ordered.numbered(df.filter("i > 9"), [], "i", div("i", 2)).count() == 0


def test_interval_and_types(spark):
    assert interval("1 hour 30 minutes") == 5_400_000
    assert interval("250") == interval(250) == 250
    with pytest.raises(ValueError):
        interval("3 fortnights")
    assert files.declared("a b c", "int TS Double").simpleString() == "struct<a:int,b:bigint,c:double>"
    with pytest.raises(ValueError):
        files.declared("a", "decimal")


def test_rename_refuses_two_columns_of_one_name(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows.rename(df, ["a"], ["c"]).columns == ["c", "b"]
    with pytest.raises(ValueError):
        rows.rename(df, ["a"], ["b"])


def test_instrument_counts(spark):
    df, seen = rows.instrument(spark.range(10), "ten", high=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 10, "high": 9}


def test_unnest_kinds(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k int, xs array<string>")
    assert got(nested.unnest(df, F.col("xs"), "x"), "k", "x") == [(1, "a"), (1, "b")]
    assert sorted(map(tuple, nested.unnest(df, F.col("xs"), "x", "yes").select("k", "x").collect()), key=str) == [(1, "a"), (1, "b"), (2, None)]
    with pytest.raises(Exception, match="nothing to unnest"):
        nested.unnest(df, F.col("xs"), "x", "strict").collect()
    assert nested.path(["a", "$", "b|c"]) == "a/*/*[self::b or self::c]"


def test_construct_escapes(spark):
    df = spark.createDataFrame([("a<b&c", None)], "x string, y string")
    assert nested.construct(df, "xml", "r", {"x": F.col("x"), "y": F.col("y")}).collect()[0]["xml"] == "<r><x>a&lt;b&amp;c</x><y></y></r>"


def test_person_positions(spark):
    df = spark.createDataFrame([(13, 1, 10, 0), (14, 2, 21, 4), (13, 3, 11, 2), (999, 4, 0, 0)], "sid int, t long, x int, y int")
    assert got(grid.person_positions(df, "sid", "t", "x", "y", div("t", 2)), "t", "x", "y", "pid") == [(1, 10, 0, 0), (2, 15, 2, 0), (3, 16, 3, 0)]


def test_person_positions_of_one_time_come_by_arrival(spark):
    rows = [(k, (13, 14)[k % 2], k // 50, k * k, -k) for k in range(200)]
    df = spark.createDataFrame(rows[::-1], "id int, sid int, t long, x int, y int").repartition(7)
    expected = [(k, x, y) if k == 0 else (k, (x + (k - 1) ** 2) // 2, -((2 * k - 1) // 2)) for k, _, _, x, y in rows]
    assert got(grid.person_positions(df, "sid", "t", "x", "y", div("t", 2), "id"), "id", "x", "y") == expected


def test_archive_kinds(spark):
    day = archive.DAY
    e = spark.createDataFrame([(d * day,) for d in range(15)], "t long")
    now = e.filter(F.col("t") == 14 * day)
    assert [t // day for (t, _) in got(archive.similar_days(now, e, "t", "AllDays", 3), "t", "for_stretch")] == [11, 12, 13]
    assert [t // day for (t, _) in got(archive.similar_days(now, e, "t", "SameDayOfWeek", 2), "t", "for_stretch")] == [0, 7]
    with pytest.raises(ValueError):
        archive.similar_days(now, e, "t", "Sometimes", 1)


def test_generated_tables_do_not_depend_on_partitions(spark):
    a = generated.traffic(spark, 3, 4, 10).repartition(3)
    assert got(a, *a.columns) == got(generated.traffic(spark, 3, 4, 10), *a.columns)
    made = generated.auction(spark, 100)
    assert [made[k].count() for k in ("person", "open_auction", "bid")] == [60, 150, 1000]


def test_accumulate_sides(spark):
    a = spark.createDataFrame([(1, "l", 1), (2, None, 2)], "k int, v string, x int")
    b = spark.createDataFrame([(2, "r", 5), (3, "r", 6)], "k int, v string, y int")
    assert sorted(map(tuple, aggregates.accumulate(a, b, ["k"]).collect())) == [(1, "l", 1, None), (2, "r", 2, 5), (3, "r", None, 6)]
    assert got(aggregates.accumulate(a, b, ["k"], "inner", "right"), "k", "v") == [(2, "r")]


def test_delta_frames_of_long_and_null_groups(spark):
    rng = random.Random(3)
    values = [(g, t, rng.choice((0.0, 1.0, 7.0)) if t % 500 else 30.0 + t) for g in (1, None, 2) for t in range(3000)]
    expected = []
    for g in (1, None, 2):
        start = opened = None
        for t, v in ((t, v) for k, t, v in values if k == g):
            if start is None or abs(v - start) >= 8:
                if start is not None:
                    expected.append((g, opened, t - 1))
                start, opened = v, t
        expected.append((g, opened, 2999))
    found = frames.delta_frames(spark.createDataFrame(values, "g long, t long, v double"), "g", "t", "v", 8.0, div("t", 700))
    assert sorted(got_ := [(r["frame_group"], r["frame_start"], r["frame_end"]) for r in found.collect()], key=str) == sorted(expected, key=str) and got_


def test_paths_with_closures(spark):
    from xml.etree import ElementTree

    root = ElementTree.fromstring("<a><b><b><c>1</c></b></b><c>2</c><d><c>3</c></d></a>")
    reach = lambda *steps: [n.text for n in nested.reached(root, steps)]
    assert reach("a", "b*", "c") == ["1", "2"] and reach("a", "b+", "c") == ["1"] and reach("a", "d?", "c") == ["2", "3"]
    assert reach("a", "$*", "c") == ["1", "2", "3"] and reach("a", "b|d", "c") == ["3"] and reach("b") == [] and reach("$+") == [None, None, None, "1", "2", None, "3"]
    df = spark.createDataFrame([("<a><b>5</b><b>x</b></a>",), ("<a>",), (None,)], "x string")
    found = [r[0] for r in df.select(nested.xml_nodes(F.col("x"), ["a", "b"], "content", "int")).collect()]
    assert found == [[5, None], [], None]


def test_expressions_in_text_are_checked(spark):
    df = spark.createDataFrame([(2.0, None)], "v double, u double")
    assert rows.expression(df, "y", "CASE WHEN v > 1 THEN round(v * 2.5e0, 1) ELSE coalesce(u, -1) END").collect()[0]["y"] == 5.0
    assert rows.expression(df, "y", "u + 1").count() == 0
    for bad in ("java_method('java.lang.System', 'exit', 1)", "(SELECT 1)", "v; 1", "reflect('x', 'y')", "input_file_name()"):
        with pytest.raises(ValueError):
            rows.expression(df, "y", bad)


def test_theta_join_checks_its_small_side(spark):
    with pytest.raises(ValueError):
        joins.theta_join(spark.range(3), spark.range(50).withColumnRenamed("id", "k"), F.col("id") < F.col("k"), 10)


def test_order_over_many_buckets(spark):
    df = spark.range(5000).select(((F.col("id") * 37) % 5000).alias("i"))
    found = ordered.running_all(ordered.numbered(df, [], "i", div("i", 2)), [], "i", div("i", 2), {"s": ("sum", F.col("i")), "m": ("max", -F.col("i")), "l": ("last", F.when(F.col("i") % 3000 == 5, F.col("i")))}, before=True)
    bad = found.filter((F.col("row_no") != F.col("i") + 1) | (F.coalesce("s", F.lit(0)) != F.col("i") * (F.col("i") - 1) / 2) | ~F.col("m").eqNullSafe(F.when(F.col("i") > 0, 0)) | ~F.col("l").eqNullSafe(F.when(F.col("i") > 3005, 3005).when(F.col("i") > 5, 5)))
    assert found.count() == 5000 and bad.count() == 0


def test_database(spark):
    from brooklet.sources.archive import database

    url = "jdbc:derby:memory:archive;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id AS k", "id * 2 AS v").write.format("jdbc").options(url=url, dbtable="readings", driver=driver).save()
    got = database(spark, url, "SELECT * FROM readings WHERE \"v\" < 50", "k", 0, 100, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == [(k, 2 * k) for k in range(25)]


def test_similar_conditions(spark):
    from brooklet.sources.archive import similar_conditions

    hour = 3_600_000_000
    now = 24 * 100
    archive = spark.createDataFrame([((now - 24 * k) * hour, k) for k in range(1, 6)], "t long, k long")
    stream = spark.createDataFrame([(now * hour,), (now * hour + 5,)], "t long")
    pick = lambda levels, days=2: sorted(r.k for r in similar_conditions(stream, archive, spark.createDataFrame(levels, "stretch long, level double"), "t", "AllDays", days, 3.0).collect())
    earlier = [(now - 24, 9.0), (now - 48, 6.0), (now - 72, 5.5), (now - 96, 2.0), (now - 120, 4.5)]
    assert pick([*earlier, (now, 5.0)]) == [3, 5]  # the two nearest; 2.0 and 9.0 are the ends
    assert pick([*earlier, (now, 5.0)], 9) == [2, 3, 4, 5]
    assert pick([(now - 24, 3.0), (now - 48, 0.0), (now - 72, 1.0)], 2) == [1, 2]  # no level: 0, the latest first
    assert pick([(now, 5.0)]) == []
    with pytest.raises(ValueError):
        similar_conditions(stream, archive, archive.select(F.col("t").alias("stretch"), F.lit(0.0).alias("level")), "t", "NoDays", 1, 1.0)


def test_accumulate_nested_odd_values(spark):
    from brooklet.operators.aggregates import accumulate_nested

    schema = "k int, s struct<a:int,b:string>, l array<struct<id:int,x:int>>, p array<int>"
    left = spark.createDataFrame([(1, (1, None), [(1, None), (None, 5)], [1]), (2, None, None, None), (3, (3, "l"), [], None)], schema)
    right = spark.createDataFrame([(1, (9, "r"), [(1, 7), (2, 8), (None, 6), (2, 9)], [2]), (2, (2, "r"), [(4, 4)], [3]), (4, None, None, None)], schema)
    got = {r.k: r for r in accumulate_nested(left, right, ["k"], {"l": "id"}).collect()}
    assert (tuple(got[1].s), [tuple(x) for x in got[1].l], got[1].p) == ((1, "r"), [(1, 7), (None, 5), (2, 8), (None, 6), (2, 9)], [1])
    assert (tuple(got[2].s), [tuple(x) for x in got[2].l], got[2].p) == ((2, "r"), [(4, 4)], [3])
    assert (tuple(got[3].s), got[3].l, got[3].p) == ((3, "l"), [], None)
    assert (got[4].s, got[4].l) == (None, None)
    turned = {r.k: r for r in accumulate_nested(left, right, ["k"], {"l": "id"}, "inner", "right").collect()}
    assert sorted(turned) == [1, 2] and tuple(turned[1].s) == (9, "r") and turned[1].p == [2]
    with pytest.raises(ValueError):
        accumulate_nested(left, right.withColumn("p", F.lit("x")), ["k"], {})


def test_declared_documents_must_end(spark):
    from brooklet.sources.generated import declared_documents

    deep = declared_documents(spark, 20, "a", {"a": ["a?", "b"]}, depth=3).collect()
    assert max(r.xml.count("<a>") for r in deep) <= 4 and all(r.xml.count("<b>") == r.xml.count("<a>") for r in deep)
    with pytest.raises(ValueError):
        declared_documents(spark, 1, "a", {"a": ["a"]})


def test_sums_of_windows_are_not_multiplied_before_they_are_made(spark):
    rows = [(g, k * 37 % 1500 - 40, None if k % 5 == 0 else k % 11 - 5) for g in ("a", None, "b") for k in range(90 if g else 3)]
    df = w.bucket(spark.createDataFrame(rows, "g string, t long, v long"), "t", 25, 2, 0)
    expected = {}
    for g, t, v in rows:
        for i in range(int(t / 2), int((t + 25) / 2)):
            expected.setdefault((g, i), []).append(v)
    found = w.aggregate(df, ["g"], n=w.count("v"), s=w.long_total("v"))
    known = {k: (sum(x is not None for x in v), sum(x for x in v if x is not None) if any(x is not None for x in v) else None) for k, v in expected.items()}
    assert {(r["g"], r["wid_from_w"]): (r["n"], r["s"]) for r in found.collect()} == known and found.count() == len(known)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(_from") < plan.index("Aggregate")  # above it
    cells = w.shares(df.filter("g IS NOT NULL").withColumn("c", F.col("t") % 3), ["g"], "c")
    by_cell = {}
    for g, t, _ in rows:
        for i in range(int(t / 2), int((t + 25) / 2)) if g else ():
            by_cell[g, i, math.fmod(t, 3)] = by_cell.get((g, i, math.fmod(t, 3)), 0) + 1
    assert {(r["g"], r["wid_from_w"], float(r["c"])): (r["n"], r["every"]) for r in cells.collect()} == {k: (n, len(expected[k[:2]])) for k, n in by_cell.items()}


def test_panes_move_once_after_they_are_made(spark):
    df = w.bucket(spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 2).cast("double").alias("x")), "id", 24, 1, 0)
    for found, moves in ((w.aggregate(df, ["g", "x"], n=w.count()), 2), (w.shares(df, ["g"], "x"), 4)):
        assert found.count() > 0 and found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == moves
