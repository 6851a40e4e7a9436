"""Unary operators on rows: projection, filters, computed columns, pass-through counters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from brooklet.operators.ordered import numbered


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, source: Sequence[str], dest: Sequence[str]) -> DataFrame:
    """Renames columns pairwise; the result must not name two columns alike."""
    if len(source) != len(dest):
        raise ValueError("as many new names as old ones")
    out = df.withColumnsRenamed(dict(zip(source, dest, strict=True)))
    if len(set(out.columns)) < len(out.columns):
        raise ValueError("two columns would have one name")
    return out


def select(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Keeps the rows that satisfy the predicate; without one, all."""
    return df if predicate is None else df.filter(predicate)


def select_alternate(df: DataFrame, predicate: Column, order: str, bucket: Column, first: bool = False) -> DataFrame:
    """Every second row that satisfies the predicate, in the given order: the even ones, or the odd ones with ``first``."""
    kept = numbered(df.filter(predicate), [], order, bucket, "_no")
    return kept.filter(F.col("_no") % 2 == (1 if first else 0)).drop("_no")


def apply(df: DataFrame, predicate: Column, to: str) -> DataFrame:
    """Adds 1 where the predicate holds, else 0."""
    return df.withColumn(to, F.when(predicate, 1).otherwise(0))


_TOKEN = re.compile(r"\s*(?:\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|'[^'\\]*'|`[^`]*`|(\w+)(\s*\()?|<=>|[<>!=]=|<>|\|\||[-+*/%(),.<>=])")
#: Functions that an expression in text may call; a cast, CASE and the operators are no functions.
FUNCTIONS = frozenset("abs ceil ceiling coalesce concat exp floor greatest if length least ln log lower mod nullif pow power round sign sqrt substring trim upper cast".split())
_WORDS_BEFORE_BRACKET = frozenset("and or not in when then else between case".split())


def checked(text: str) -> str:
    """An expression in text if it has only names, literals, operators and ``FUNCTIONS``; others are refused."""
    at, text = 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in an expression: {text[at:]!r}")
        word = (m[1] or "").lower()
        if m[2] and word not in FUNCTIONS | _WORDS_BEFORE_BRACKET or word in ("select", "from"):
            raise ValueError(f"no such function in an expression: {word}")
        at = m.end()
    return text


def expression(df: DataFrame, to: str, value: Column | str) -> DataFrame:
    """Adds a computed column; rows for which it is null go. Text is ``checked`` first."""
    value = checked(value) if isinstance(value, str) else value
    return df.withColumn(to, F.expr(value) if isinstance(value, str) else value).filter(F.col(to).isNotNull())


def table_function(df: DataFrame, function, arguments: Sequence[str]) -> DataFrame:
    """Each row with every row that a table function (made by ``udtf``) gives for it."""
    return df.lateralJoin(function(*[F.col(c).outer() for c in arguments]))


def prefix(df: DataFrame, length: int, order: str) -> DataFrame:
    """The first rows in the given order."""
    return df.orderBy(order).limit(length)


def dup(df: DataFrame, branches: int) -> list[DataFrame]:
    """The same rows for several consumers: a plan is shared by name, and Spark reuses what branches have in common."""
    return [df] * branches


def expensive(df: DataFrame, cost: int) -> DataFrame:
    """Passes rows on after ``cost`` rounds of hashing each; a stub for tests of filters below it."""
    spent = F.aggregate(F.sequence(F.lit(1), F.lit(max(cost, 1))), F.lit(0).cast("long"), lambda h, k: F.xxhash64(h, k))
    return df.filter(spent.isNotNull())


def instrument(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Passes rows on and counts them; the counts are there once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counters.items()]), seen


_SUPPRESS = {"lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "eq": lambda c, v: c == v, "ge": lambda c, v: c >= v, "gt": lambda c, v: c > v}


def suppress(df: DataFrame, names: Sequence[str], comparators: Sequence[str], values: Sequence, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Drops the rows that a consumer says it doesn't need: those that meet all the comparisons.

    The filter stands where it is called; Spark pushes it towards the sources. ``columns`` renames the consumer's columns to those of ``df``.
    """
    unwanted = F.lit(True)
    for name, op, value in zip(names, comparators, values, strict=True):
        unwanted = unwanted & _SUPPRESS[op](F.col((columns or {}).get(name, name)), F.lit(value))
    return df.filter(~F.coalesce(unwanted, F.lit(False)))


def suppress_windows(df: DataFrame, t: str, last: int, span: int, slide: int, start: int) -> DataFrame:
    """Drops the rows that belong only to windows with an id of at most ``last``; applied below the window operator."""
    return df.filter(F.col(t) >= start + (last + 2) * slide - span)


def interest(df: DataFrame, segment: str, t: str, period: int, segments: Sequence) -> DataFrame:
    """Keeps the rows of the segment that is of interest at their time; the interest moves on every ``period``."""
    turn = F.call_function("div", F.col(t), F.lit(period)) % len(segments)
    return df.filter(F.element_at(F.array(*[F.lit(s) for s in segments]), (turn + 1).cast("int")) == F.col(segment))
