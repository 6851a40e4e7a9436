"""Nested data: unnesting, construction, sorting and limits of what comes out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.functions.columns import number_or_zero


def unnest(df: DataFrame, nodes: Column, to: str, outer: str = "no") -> DataFrame:
    """A row for each element of an array: ``outer`` no, yes (a row without elements stays, with null) or strict (raises)."""
    if outer == "strict":
        empty = nodes.isNull() | (F.size(nodes) <= 0)
        nodes = F.when(empty, F.raise_error(F.lit(f"nothing to unnest into {to}"))).otherwise(nodes)
    return df.select("*", (F.explode_outer if outer == "yes" else F.explode)(nodes).alias(to))


def unnest_where(df: DataFrame, nodes: Column, to: str, keep) -> DataFrame:
    """Unnests only the elements that satisfy ``keep``, which are filtered before they become rows."""
    return df.select("*", F.explode(F.filter(nodes, keep)).alias(to))


def path(steps: Sequence[str]) -> str:
    """XPath of a path of tags: ``$`` is any tag, ``a|b`` either, ``**`` any number of tags."""
    out = ""
    for i, s in enumerate(steps):
        if s == "**":
            out += "/"
            continue
        out += "/" if out or i else ""
        out += "*" if s == "$" else f"*[{' or '.join(f'self::{t}' for t in s.split('|'))}]" if "|" in s else s
    return out


def xml_values(xml: Column, steps: Sequence[str], kind: str = "content") -> Column:
    """Texts of the elements (or the values of the attribute) that a path reaches in an XML string."""
    end = {"content": "/text()", "attribute": ""}[kind]
    return F.xpath(xml, F.lit(path(steps) + end))


_FITS = {"?": (True, False), "*": (True, True), "+": (False, True)}


def reached(root: ElementTree.Element, steps: Sequence[str]) -> Iterator[ElementTree.Element]:
    """The elements that a path of tags reaches, in document order. A step may end in ``?``, ``*`` or ``+``; ``$`` is any tag, ``a|b`` either."""
    tags = [s.rstrip("?*+") for s in steps]
    names = [None if t == "$" else frozenset(t.split("|")) for t in tags]
    may_skip, may_repeat = zip(*(_FITS.get(s[len(t) :], (False, False)) for s, t in zip(steps, tags, strict=True)), strict=True)

    def on(states: set[int]) -> set[int]:
        for i in sorted(states):
            while i < len(tags) and may_skip[i]:
                i += 1
                states.add(i)
        return states

    left = [(root, frozenset(on({0})))]
    while left:
        node, before = left.pop()
        fits = [i for i in before if i < len(tags) and (names[i] is None or node.tag in names[i])]
        after = on({i + 1 for i in fits} | {i for i in fits if may_repeat[i]})
        if len(tags) in after:
            yield node
        if after - {len(tags)}:
            left += [(child, frozenset(after)) for child in reversed(node)]


def xml_nodes(xml: Column, steps: Sequence[str], kind: str = "content", type_: str = "string") -> Column:
    """What a path with closures reaches in an XML string: elements, their tags, or their own text, cast to a type where it can be.

    XML that cannot be read reaches nothing, nor does XML with a document type, whose entities could grow without bound. Spark's XPath has neither closures of tags nor elements, so batches go to Python.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    steps = list(steps)

    @pandas_udf("array<string>")
    def reach(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            if "<!DOCTYPE" in text:
                return []
            try:
                root = ElementTree.fromstring(text)
            except ElementTree.ParseError:
                return []
            out = []
            for node in reached(root, steps):
                node.tail = None
                out.append(node.tag if kind == "tag" else node.text or "" if kind == "content" else ElementTree.tostring(node, encoding="unicode"))
            return out

        return texts.map(one)

    if kind not in ("content", "tag", "element"):
        raise ValueError(f"no such kind: {kind}")
    found = reach(xml)
    return found if type_ == "string" else F.transform(found, lambda v: v.try_cast(type_))


def construct(df: DataFrame, to: str, tag: str, parts: Mapping[str, Column]) -> DataFrame:
    """Adds an element made of parts, with their text escaped; a null part is an empty element."""
    escaped = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = [F.concat(F.lit(f"<{k}>"), F.coalesce(escaped(c), F.lit("")), F.lit(f"</{k}>")) for k, c in parts.items()]
    return df.withColumn(to, F.concat(F.lit(f"<{tag}>"), *body, F.lit(f"</{tag}>")))


def construct_struct(df: DataFrame, to: str, parts: Mapping[str, Column]) -> DataFrame:
    """Adds a nested value made of parts."""
    return df.withColumn(to, F.struct(*[c.alias(k) for k, c in parts.items()]))


def sort(df: DataFrame, by: str, arrival: str, alphabetic: bool = False, descending: bool = False) -> DataFrame:
    """Sorts by one key; what arrived first comes first among equals, in either direction. Without ``alphabetic`` text that is no number counts as 0."""
    key = F.col(by).cast("string") if alphabetic else number_or_zero(F.col(by).cast("string"))
    return df.orderBy(key.desc() if descending else key.asc(), F.col(arrival).asc())


def top(df: DataFrame, by: str, arrival: str, n: int) -> DataFrame:
    """The n largest; only n rows leave a task."""
    return df.orderBy(F.col(by).desc(), F.col(arrival).asc()).limit(n)
