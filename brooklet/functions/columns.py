"""Column helpers: event time, intervals in words, comparisons, typed arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of the interval words.
UNITS = {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000, "millisecond": 1}


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def interval(text: str | int) -> int:
    """Milliseconds of ``1 hour 30 minutes``; terms add up, and a number without a word counts as it is."""
    if isinstance(text, int):
        return text
    total, rest = 0, text.strip()
    for number, word in re.findall(r"(\d+)\s*([a-z]*)", rest.lower()):
        if word and word.rstrip("s") not in UNITS:
            raise ValueError(f"no interval: {text!r}")
        total += int(number) * UNITS.get(word.rstrip("s"), 1)
    if not re.fullmatch(r"(\s*\d+\s*[a-z]*)+", rest.lower()):
        raise ValueError(f"no interval: {text!r}")
    return total


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    left = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", left, F.lit(b) if isinstance(b, int) else b)


_NUMBER = r"^[0-9]+\.?[0-9]*$"
_OPERATORS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def compare(a: Column, op: str, b: Column) -> Column:
    """A typed comparison; ``contain`` is a substring test. A null operand gives null, so the row isn't kept."""
    return a.contains(b) if op == "contain" else _OPERATORS[op](a, b)


def compare_text(a: Column, op: str, b: Column) -> Column:
    """A comparison of strings: as numbers where both are unsigned decimals, else by characters.

    A sign makes a string no number, so ``'10' > '-1'`` compares characters.
    """
    if op == "contain":
        return a.contains(b)
    numbers = a.rlike(_NUMBER) & b.rlike(_NUMBER)
    return F.when(numbers, _OPERATORS[op](a.cast("double"), b.cast("double"))).otherwise(_OPERATORS[op](a, b))


def any_pair(left: Column, op: str, right: Column) -> Column:
    """True if any element of one array compares so with any of the other."""
    return F.exists(left, lambda a: F.exists(right, lambda b: compare(a, op, b)))


def any_value(values: Column, op: str, constant: Column) -> Column:
    """True if any of the texts that a path reaches compares so with a constant; numbers compare as numbers."""
    return F.exists(values, lambda v: compare_text(v, op, constant))


def number_or_zero(value: Column) -> Column:
    """A string as a double; what is no number counts as 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))
