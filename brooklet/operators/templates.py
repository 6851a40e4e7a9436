"""Merging of nested documents by a template: for each node how its two sides are merged, which of them wins, and by what its elements match.

A document is a struct; a child is a struct, a list of structs or a value. A template is a tree of ``Merge`` nodes and is compiled to one column. An element
matches only elements under matched parents, so its key is rooted: its own, below its parent's. Lists are merged by maps of their keys, in time that
grows with their length times its logarithm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.variants import let

TYPES, SIDES = ("outer", "left", "right", "inner"), ("left", "right")
_AGGREGATES = {
    "sum": lambda l, r: F.coalesce(l + r, l, r),
    "min": lambda l, r: F.least(l, r),
    "max": lambda l, r: F.greatest(l, r),
}


@dataclass(frozen=True)
class Merge:
    """How a node is merged.

    ``how``: ``content`` (the winning side's value, or the other's where that is null; structs and keyed lists by their children), ``replace`` (the winning
    side's whole subtree), ``union`` (both lists end to end), ``exact`` (both sides must be equal where both are there, else an error), ``empty`` (an element without
    content: only its children), or an aggregate of both values: ``sum``, ``min``, ``max``.
    ``type``: outer, left, right, inner: whose elements stay without a partner (a value is an element too: with inner it stays where both sides have one); ``side``: left or right, which wins. Both are handed down where they are None.
    ``key``: by which fields the elements of a list match; without one they match none, and both lists stay, the winning side's first.
    ``left``, ``right``: the child's name in the two inputs, where it differs. ``children``: the template's children; fields without one are left out, but a
    node with none keeps all fields of either side, merged as it says itself.
    """

    how: str = "content"
    type: str | None = None
    side: str | None = None
    key: tuple[str, ...] = ()
    left: str | None = None
    right: str | None = None
    children: Mapping[str, Merge] = field(default_factory=dict)


def _struct_of(kind: T.DataType | None) -> T.StructType | None:
    return kind if isinstance(kind, T.StructType) else kind.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else None


def _children(node: Merge, l: T.StructType | None, r: T.StructType | None) -> dict[str, Merge]:
    if node.children:
        return dict(node.children)
    names = dict.fromkeys([*(l.names if l else []), *(r.names if r else [])])
    return {n: Merge("content") for n in names}


def _field(value: Column, kind: T.StructType | None, name: str) -> tuple[Column, T.DataType | None]:
    return (value[name], kind[name].dataType) if kind is not None and name in kind.names else (F.lit(None), None)


def _keyed(rows: Column, kind: T.StructType, key: Sequence[str]) -> Column:
    """Struct of ``first`` (a map from key to place and element, for the first element of each key) and ``rest`` (place and element of those without key, or not the first of theirs).

    Spark looks up maps of plain keys only by hash, and only where it joins two maps; so a key of several fields is their JSON, and nothing is looked up here.
    """
    plain = len(key) == 1 and isinstance(kind[key[0]].dataType, T.AtomicType)
    own = (lambda e: e[key[0]]) if plain else (lambda e: F.to_json(F.struct(*[e[k].alias(k) for k in key])))
    whole = lambda e: F.forall(F.array(*[e[k].isNotNull() for k in key]), lambda x: x)
    number = lambda rows: F.transform(rows, lambda e, i: F.struct(own(e).alias("k"), i.alias("i"), whole(e).alias("w")))

    def parts(rows: Column, sorted_: Column) -> Column:
        at = lambda x: F.struct(x["i"].alias("i"), F.get(rows, x["i"]).alias("v"))
        again = lambda x, i: (i > 0) & F.get(sorted_, i - 1)["k"].eqNullSafe(x["k"])
        heads = F.transform(F.filter(sorted_, lambda x, i: ~again(x, i)), lambda x: F.struct(x["k"].alias("k"), at(x).alias("v")))
        rest = F.concat(F.filter(sorted_, again), F.filter(number(rows), lambda x: ~x["w"]))
        return F.struct(F.map_from_entries(heads).alias("first"), F.transform(rest, at).alias("rest"))

    return let(rows, lambda rows: let(F.array_sort(F.filter(number(rows), lambda x: x["w"])), lambda s: parts(rows, s)))


def _list(l: Column, r: Column, lk: T.StructType | None, rk: T.StructType | None, node: Merge, type_: str, side: str) -> Column:
    one = lambda a, b: _struct(a, b, lk, rk, node, type_, side)
    none = lambda kind: F.lit(None) if kind is None else F.lit(None).cast(kind)
    shape = lambda e, left: one(e, none(rk)) if left else one(none(lk), e)
    there = F.when(l.isNotNull() | r.isNotNull(), F.lit(True))
    if lk is None or rk is None:
        return F.when(there, F.filter(F.transform(r if lk is None else l, lambda e: shape(e, lk is not None)), lambda e: e.isNotNull()))
    ours, theirs = (F.coalesce(l, F.array().cast(T.ArrayType(lk))), F.coalesce(r, F.array().cast(T.ArrayType(rk))))
    placed = lambda n, i, e: F.struct(F.lit(n).alias("n"), i.alias("i"), e.alias("e"))

    def merged(pair: Column) -> Column:
        # The winning side's elements come first, in its order, then what the other side alone has.
        a, b = (pair["l"], pair["r"]) if side == "left" else (pair["r"], pair["l"])
        joined = lambda x, y: one(x["v"], y["v"]) if side == "left" else one(y["v"], x["v"])
        met = F.map_zip_with(a["first"], b["first"], lambda _, x, y: F.struct(F.when(x.isNull(), 1).otherwise(0).alias("n"), F.coalesce(x["i"], y["i"]).alias("i"), joined(x, y).alias("e")))
        rest = [_rest(x["rest"], n, left, placed, shape) for n, x, left in ((0, a, side == "left"), (1, b, side != "left"))]
        return F.filter(F.concat(F.map_values(met), *rest), lambda x: x["e"].isNotNull())

    def in_order(found: Column) -> Column:
        places = F.array_sort(F.transform(found, lambda x, p: F.struct(x["n"].alias("n"), x["i"].alias("i"), p.alias("p"))))
        return F.transform(places, lambda x: F.get(found, x["p"])["e"])

    keyed = let(let(F.struct(_keyed(ours, lk, node.key).alias("l"), _keyed(theirs, rk, node.key).alias("r")), merged), in_order)
    return F.when(there, keyed)


def _rest(rest: Column, n: int, left: bool, placed, shape) -> Column:
    return F.transform(rest, lambda x: placed(n, x["i"], shape(x["v"], left)))


def _struct(l: Column, r: Column, lk: T.StructType | None, rk: T.StructType | None, node: Merge, type_: str, side: str) -> Column:
    fields = []
    for name, child in _children(node, lk, rk).items():
        x, xk = _field(l, lk, child.left or name)
        y, yk = _field(r, rk, child.right or name)
        if xk is None and yk is None:
            raise ValueError(f"neither side has {name}")
        fields.append(_merged(x, y, xk, yk, child, child.type or type_, child.side or side).alias(name))
    there = {"outer": l.isNotNull() | r.isNotNull(), "left": l.isNotNull(), "right": r.isNotNull(), "inner": l.isNotNull() & r.isNotNull()}[type_]
    return F.when(there, F.struct(*fields))


def _merged(l: Column, r: Column, lk: T.DataType | None, rk: T.DataType | None, node: Merge, type_: str, side: str) -> Column:
    if type_ not in TYPES or side not in SIDES:
        raise ValueError(f"no such merge: {type_}, {side}")
    one = lk is None or rk is None
    winner = F.coalesce(*((l, r) if side == "left" else (r, l))) if not one else r if lk is None else l
    there = {"outer": None, "left": l.isNotNull() if lk is not None else F.lit(False), "right": r.isNotNull() if rk is not None else F.lit(False)}.get(type_, F.lit(False) if one else l.isNotNull() & r.isNotNull())
    if node.how in ("content", "empty") and not (isinstance(lk or rk, T.ArrayType) and not node.key and not node.children):
        if isinstance(lk or rk, T.ArrayType) and _struct_of(lk or rk) is not None:
            if not node.key:
                raise ValueError("elements with children need a key")
            return _list(l, r, _struct_of(lk), _struct_of(rk), node, type_, side)
        if isinstance(lk or rk, T.StructType):
            return _struct(l, r, _struct_of(lk), _struct_of(rk), node, type_, side)
    if node.how == "empty":
        return F.lit(None).cast((lk or rk).simpleString())
    if node.how in ("content", "replace"):
        value = winner
    elif one:
        value = winner
    elif node.how == "union":
        a, b = (l, r) if side == "left" else (r, l)
        value = F.when(l.isNotNull() | r.isNotNull(), F.concat(F.coalesce(a, F.array().cast(lk)), F.coalesce(b, F.array().cast(lk))))
    elif node.how == "exact":
        value = F.when(l.isNotNull() & r.isNotNull() & ~l.eqNullSafe(r), F.raise_error(F.concat(F.lit("values differ: "), l.cast("string"), F.lit(" and "), r.cast("string"))).cast(lk)).otherwise(F.coalesce(l, r))
    elif node.how in _AGGREGATES:
        value = _AGGREGATES[node.how](l, r)
    else:
        raise ValueError(f"no such merge: {node.how}")
    return value if there is None else F.when(there, value)


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], template: Merge) -> DataFrame:
    """The documents of two tables, one a key on each side, merged by a template whose children are columns other than the ``keys``.

    The root's ``type`` (outer if None) says which documents stay without a partner, its ``side`` (left if None) which side wins. Null keys match none.
    """
    type_, side = template.type or "outer", template.side or "left"
    how = {"outer": "full", "left": "left", "right": "right", "inner": "inner"}[type_]
    columns = [[c for c in df.columns if c not in keys] for df in (left, right)]
    l = left.select(*keys, F.struct(*columns[0]).alias("_l"))
    r = right.select(*keys, F.struct(*columns[1]).alias("_r"))
    kinds = [T.StructType([df.schema[c] for c in own]) for df, own in ((left, columns[0]), (right, columns[1]))]
    both = l.join(r, list(keys), how)
    return both.select(*keys, _struct(F.col("_l"), F.col("_r"), kinds[0], kinds[1], template, type_, side).alias("_m")).select(*keys, "_m.*")
