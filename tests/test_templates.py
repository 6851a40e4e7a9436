"""Merge templates and paths through VARIANT."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from brooklet.operators import variants
from brooklet.operators.templates import Merge, merge

SCHEMA = "id long, name string, n int, items array<struct<k:string,v:int,tags:array<string>,parts:array<struct<p:int,q:int>>>>"


def _plain(x):
    return {k: _plain(v) for k, v in x.asDict().items()} if hasattr(x, "asDict") else [_plain(v) for v in x] if isinstance(x, list) else x


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _merge(spark, left, right, template):
    return {r["id"]: _plain(r) for r in merge(_docs(spark, left), _docs(spark, right), ["id"], template).collect()}


LEFT = [(1, "a", 1, [("x", 1, ["t"], [(1, 10), (2, 20)]), ("y", None, None, None), (None, 5, None, []), ("x", 9, None, None)]), (2, None, None, None), (3, "l", 3, [])]
RIGHT = [(1, "b", 2, [("z", 3, None, None), ("x", 2, ["u"], [(2, 21), (3, 30)]), ("y", 7, None, None)]), (2, "c", 5, [("q", 1, None, None)]), (4, "r", 4, None)]
PARTS = Merge(key=("p",), children={"p": Merge(), "q": Merge("sum")})


def _template(type_, wins, **items):
    return Merge(type=type_, side=wins, children={"name": Merge(), "n": Merge("max"), "items": Merge(key=("k",), children={"k": Merge(), "v": Merge(), "tags": Merge("union"), "parts": PARTS}, **items)})


def test_outer_merge_where_the_right_side_wins(spark):
    found = _merge(spark, LEFT, RIGHT, _template("outer", "right"))
    assert sorted(found) == [1, 2, 3, 4]
    assert (found[1]["name"], found[1]["n"], found[2]["name"], found[3]["name"], found[4]["n"]) == ("b", 2, "c", "l", 4)
    items = found[1]["items"]
    # The right side's first; what has no key, or one that was there before, matches none.
    assert [(i["k"], i["v"]) for i in items] == [("z", 3), ("x", 2), ("y", 7), (None, 5), ("x", 9)]
    assert items[1]["tags"] == ["u", "t"] and items[1]["parts"] == [{"p": 2, "q": 41}, {"p": 3, "q": 30}, {"p": 1, "q": 10}]
    assert found[2]["items"] == [{"k": "q", "v": 1, "tags": None, "parts": None}] and found[3]["items"] == [] and found[4]["items"] is None


@pytest.mark.parametrize(("type_", "documents", "keys"), [("left", [1, 2, 3], ["x", "y", None, "x"]), ("right", [1, 2, 4], ["x", "y", "z"]), ("inner", [1, 2], ["x", "y"])])
def test_types_of_merge(spark, type_, documents, keys):
    found = _merge(spark, LEFT, RIGHT, _template(type_, "left"))
    assert sorted(found) == documents and [i["k"] for i in found[1]["items"]] == keys


def test_a_type_and_a_side_of_a_nodes_own(spark):
    found = _merge(spark, LEFT, RIGHT, _template("outer", "left", type="inner", side="right"))
    assert found[1]["name"] == "a" and [(i["k"], i["v"]) for i in found[1]["items"]] == [("x", 2), ("y", None)]


def test_names_whole_subtrees_and_fields_left_out(spark):
    template = Merge(side="right", children={"title": Merge(left="name", right="name"), "items": Merge("replace", side="left")})
    found = _merge(spark, LEFT, RIGHT, template)
    assert list(found[1]) == ["id", "title", "items"] and found[1]["title"] == "b" and len(found[1]["items"]) == 4 and found[2]["items"][0]["k"] == "q"


def test_exact_values(spark):
    template = Merge(children={"name": Merge("exact")})
    assert _merge(spark, LEFT[1:], RIGHT[1:], template)[2]["name"] == "c"
    with pytest.raises(Exception, match="values differ"):
        _merge(spark, LEFT, RIGHT, template)


def test_without_children_all_fields_stay(spark):
    found = _merge(spark, LEFT[:1], RIGHT[:1], Merge(side="right"))
    assert found[1]["n"] == 2 and len(found[1]["items"]) == 3
    with pytest.raises(ValueError, match="neither"):
        _merge(spark, LEFT, RIGHT, Merge(children={"none": Merge()}))


def test_long_lists(spark):
    rng = random.Random(1)
    sides = []
    for _ in range(2):
        keys = [f"k{i}" for i in range(20_000)]
        rng.shuffle(keys)
        sides.append([(1, None, None, [(k, rng.randint(0, 9), None, None) for k in keys[:15_000]])])
    found = _merge(spark, *sides, Merge(children={"items": Merge(key=("k",), children={"k": Merge(), "v": Merge("sum")})}))
    expected = {}
    for side in sides:
        for k, v, *_ in side[0][3]:
            expected[k] = expected.get(k, 0) + v
    assert {i["k"]: i["v"] for i in found[1]["items"]} == expected and len(found[1]["items"]) == len(expected)


def _values(spark, document, steps, type_="string", **how):
    df = spark.createDataFrame([(json.dumps(document) if document is not None else None,)], "x string")
    return df.select(variants.values(F.parse_json("x"), steps, type_, **how).alias("v")).first()["v"]


DOCUMENT = {"b": {"b": {"c": 1}, "c": "007"}, "c": [2, None, [3]], "d": {"c": {"e": 5}}, "it's": {"a b": 6}}


def test_paths_through_variants(spark):
    at = lambda *steps, **how: _values(spark, DOCUMENT, steps, **how)
    assert at("c") == ["2", None, "[3]"] and at("b*", "c") == ["2", None, "[3]", "007", "1"] and at("b+", "c") == ["007", "1"]
    assert at("d?", "c", "e", type_="int") == [5] and at("b|d", "c") == ["007", '{"e":5}'] and at("$", "c", type_="int") == [7, None]
    assert at("$*", "e") == ["5"] and at("it's", "a b") == ["6"] and at("nothing", "c") == [] and _values(spark, None, ["a"]) == [] and _values(spark, [{"a": 1}, {"a": 2}], ["a"]) == ["1", "2"]


def test_a_document_that_is_too_deep_is_told(spark):
    deep = {"c": 0}
    for _ in range(10):
        deep = {"b": deep}
    assert _values(spark, deep, ["b*", "c"], depth=12) == ["0"]
    with pytest.raises(Exception, match="repeats more than 4"):
        _values(spark, deep, ["b*", "c"], depth=4)
