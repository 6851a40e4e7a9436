"""Whole-input, running and partition aggregates; nesting and keyed merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.templates import Merge, merge
from brooklet.operators.ordered import last_rows, running_all

_KINDS = {"count": F.count, "sum": F.sum, "average": F.avg, "max": F.max, "min": F.min, "variance": F.var_pop}


def group_aggregate(df: DataFrame, group: Sequence[str], kind: str, value: str, to: str) -> DataFrame:
    """count, sum, average, max, min or (population) variance of a column for each group, or of all rows."""
    return df.groupBy(*group).agg(_KINDS[kind](value).alias(to))


def user_aggregate(df: DataFrame, group: Sequence[str], **what: Column) -> DataFrame:
    """Any aggregate columns, grouped pandas UDFs among them."""
    return df.groupBy(*group).agg(*[c.alias(k) for k, c in what.items()])


def nest(df: DataFrame, group: Sequence[str], element: Column, order: str, to: str) -> DataFrame:
    """Gathers one element for each row under its group, in order. A group's elements must fit in a row."""
    held = df.select(*group, F.struct(F.col(order).alias("o"), element.alias("e")).alias("_p"))
    return held.groupBy(*group).agg(F.array_sort(F.collect_list("_p")).alias("_l")).select(*group, F.transform("_l", lambda p: p["e"]).alias(to))


def incremental_max(df: DataFrame, group: list[str], value: str, order: str, by: Column, empty: float | None = None) -> DataFrame:
    """A row whenever a group's maximum changes: old_max (``empty`` before the first), new_max."""
    held = running_all(df, group, order, by, {"old_max": ("max", F.col(value))}, before=True)
    old = F.col("old_max") if empty is None else F.greatest(F.col("old_max"), F.lit(empty))
    held = held.withColumn("old_max", old)
    return held.withColumn("new_max", F.greatest("old_max", value)).filter(F.col("new_max").isNotNull() & ~F.col("new_max").eqNullSafe(F.col("old_max")))


#: Running averages that differ by no more are taken for equal: the order of a sum decides their last digits.
EQUAL = 1e-12


def incremental_average(df: DataFrame, group: list[str], value: str, order: str, by: Column) -> DataFrame:
    """A row whenever a group's running average changes, by more than ``EQUAL``: new_avg."""
    v = F.col(value)
    held = running_all(df, group, order, by, {"_s": ("sum", v), "_n": ("count", v)}, before=True)
    old = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    new = (F.coalesce("_s", F.lit(0.0)) + v) / (F.coalesce("_n", F.lit(0)) + 1)
    return held.withColumn("new_avg", new).filter(F.col("new_avg").isNotNull() & (old.isNull() | (F.abs(F.col("new_avg") - old) > EQUAL))).drop("_s", "_n")


def partition_average(df: DataFrame, group: list[str], value: str, order: str, by: Column, size: int | None, to: str = "avg") -> DataFrame:
    """Average of the group's last ``size`` values at each row; early rows average what there is.

    Without ``size`` the window begins at the group's first row (a landmark) and a row comes only when the average changes.
    """
    if size is None:
        return incremental_average(df, group, value, order, by).withColumnRenamed("new_avg", to)
    return last_rows(df, group, order, by, size, {to: F.avg(value)})


def partition_max(df: DataFrame, group: list[str], value: str, order: str, by: Column, size: int, empty: float | None = None, to: str = "max") -> DataFrame:
    """Maximum of the group's last ``size`` values at each row, at least ``empty`` where that is given."""
    largest = last_rows(df, group, order, by, size, {to: F.max(value)})
    return largest if empty is None else largest.withColumn(to, F.greatest(to, F.lit(empty)))


def accumulate(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full", dominant: str = "left") -> DataFrame:
    """Merges two keyed tables: full, left, right or inner; where both have a column, the dominant side's value wins unless null.

    Each side should have one row a key; several make all combinations, as any join does.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(r, list(keys), how)
    for c in shared:
        pair = (F.col(c), F.col(f"_r_{c}"))
        out = out.withColumn(c, F.coalesce(*(pair if dominant == "left" else pair[::-1])))
    return out.drop(*[f"_r_{c}" for c in shared])


def _template(kind: T.DataType, keys: dict[str, str], at: str) -> Merge:
    """How two values of one type are joined, whichever side has them."""
    if isinstance(kind, T.StructType):
        return Merge(type="outer", children={f.name: _template(f.dataType, keys, f"{at}.{f.name}") for f in kind})
    if isinstance(kind, T.ArrayType) and at in keys:
        return Merge(type="outer", key=(keys[at],), children=_template(kind.elementType, keys, at).children)
    return Merge(type="outer")


def accumulate_nested(left: DataFrame, right: DataFrame, keys: Sequence[str], local_keys: dict[str, str], how: str = "full", dominant: str = "left") -> DataFrame:
    """``accumulate`` for nested columns of equal types on both sides: structs are merged field by field.

    ``local_keys`` names, for a list of structs (``column`` or ``column.field``), the field by which its elements match; matched elements are merged, the
    dominant side's come first and the other side's unmatched ones after them; of several with one key on a side the first is merged, the others stay as they are. An element without a key matches none. Lists without a local key and
    plain values are taken whole, from the dominant side unless null there.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    differ = [c for c in shared if left.schema[c].dataType.simpleString() != right.schema[c].dataType.simpleString()]
    if differ:
        raise ValueError(f"types differ: {differ[0]}")
    kinds = {c: (left if c in left.columns else right).schema[c].dataType for c in dict.fromkeys([*left.columns, *right.columns]) if c not in keys}
    root = {"full": "outer"}.get(how, how)
    return merge(left, right, keys, Merge(type=root, side=dominant, children={c: _template(k, local_keys, c) for c, k in kinds.items()}))
