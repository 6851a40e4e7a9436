"""Paths through documents held as VARIANT: unnesting by regular paths inside the JVM.

A step is a field name, ``a|b`` for either or ``$`` for any, and may end in ``?``, ``*`` or ``+``. A list on the way stands for its elements, as repeated
elements of one name do. JSON keeps its values as they are; XML read as VARIANT does not (a text of 007 becomes 7), so XML has ``nested.xml_nodes``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How often a step with ``*`` or ``+`` may repeat before a document counts as too deep.
DEPTH = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda a column is computed again for each element, a lambda's variable isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def elements(v: Column) -> Column:
    """The elements of a list, or the value alone; nothing for null."""
    alone = F.filter(F.array(v), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), alone)


def _fields(v: Column, name: str) -> Column:
    if name == "$":
        return F.flatten(F.transform(F.map_values(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), elements))
    mark = '"' if "'" in name else "'"
    if mark in name:
        raise ValueError(f"a path cannot hold both kinds of quotes: {name}")
    return elements(F.try_variant_get(v, f"$[{mark}{name}{mark}]", "variant"))


def _on(nodes: Column, names: Sequence[str]) -> Column:
    """The fields of these names of all nodes."""
    return F.flatten(F.transform(nodes, lambda v: F.concat(*[_fields(v, n) for n in names])))


def reached(v: Column, steps: Sequence[str], depth: int = DEPTH) -> Column:
    """The values that a path reaches from a VARIANT, as a list: those of fewer repetitions first, for each node in the order of its lists.

    A document in which a step repeats more than ``depth`` times raises an error.
    """
    nodes = F.coalesce(elements(v), F.array().cast("array<variant>"))
    for step in steps:
        name, mark = (step[:-1], step[-1]) if step[-1] in "?*+" and len(step) > 1 else (step, "")
        nodes = _step(nodes, name.split("|"), mark, step, depth)
    return nodes


def _step(nodes: Column, names: Sequence[str], mark: str, step: str, depth: int) -> Column:
    if mark == "":
        return _on(nodes, names)
    if mark == "?":
        return let(nodes, lambda n: F.concat(n, _on(n, names)))
    begun = lambda n: F.struct(n.alias("all"), n.alias("front"))
    start = let(nodes if mark == "*" else _on(nodes, names), begun)

    def further(state: Column, _: Column) -> Column:
        go = lambda front: F.struct(F.concat(state["all"], front).alias("all"), front.alias("front"))
        return F.when(F.size(state["front"]) == 0, state).otherwise(let(_on(state["front"], names), go))

    last = F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, further)
    deep = F.raise_error(F.lit(f"{step} repeats more than {depth} times")).cast("array<variant>")
    return let(last, lambda s: F.when(F.size(s["front"]) > 0, deep).otherwise(s["all"]))


def values(v: Column, steps: Sequence[str], type_: str = "string", depth: int = DEPTH) -> Column:
    """``reached`` values, cast to a type where they can be."""
    return F.transform(reached(v, steps, depth), lambda x: F.try_variant_get(x, "$", type_))
