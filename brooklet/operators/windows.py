"""Window ids and window aggregates.

A row at time t belongs to the windows ``from`` to ``to``, with from = (t - start) / slide and to = ((t - start) + range) / slide - 1 in
integer division: window i covers [start + (i + 1) * slide - range, start + (i + 1) * slide), so ids count window ends and the first
range / slide - 1 windows are cut short. If to < from the row is in no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklet.functions.columns import div
from brooklet.operators.ordered import numbered


def _with_ids(df: DataFrame, place: Column, span: int, slide: int, wid: str) -> DataFrame:
    return df.withColumn(f"wid_from_{wid}", div(place, slide)).withColumn(f"wid_to_{wid}", div(place + span, slide) - 1)


def bucket(df: DataFrame, t: str, span: int, slide: int, start: int | None = None, wid: str = "w") -> DataFrame:
    """Adds the first and last window of each row by time; without ``start`` the least time is it."""
    if start is None:
        least = df.agg(F.coalesce(F.min(t), F.lit(0)).alias("_start"))  # one row
        held = df.crossJoin(F.broadcast(least))
        return _with_ids(held, F.coalesce(F.col(t), F.lit(0)) - F.col("_start"), span, slide, wid).drop("_start")
    return _with_ids(df, F.coalesce(F.col(t), F.lit(0)) - start, span, slide, wid)


def tuple_bucket(df: DataFrame, order: str, by: Column, span: int, slide: int, wid: str = "w") -> DataFrame:
    """Adds the first and last window of each row by its number, which counts from 1; ``by``: see ``ordered``."""
    held = numbered(df, [], order, by, "_no")
    return _with_ids(held, F.col("_no"), span, slide, wid).drop("_no")


class Aggregate:
    """An aggregate in two parts: what is kept of some rows, and how kept parts are joined."""

    def __init__(self, kind: str, value: str | None = None, weight: str | None = None, compat: bool = False):
        self.whole_numbers = kind in ("count", "long_sum")
        v = F.col(value) if value else F.lit(1)
        if kind == "count":
            self.kept, self.join = {"n": F.count(v)}, lambda p: F.sum(p["n"])
        elif kind == "sum":
            self.kept, self.join = {"s": F.sum(v.cast("double"))}, lambda p: F.sum(p["s"]).cast("bigint") if compat else F.sum(p["s"])
        elif kind == "long_sum":
            self.kept, self.join = {"s": F.sum(v.cast("bigint"))}, lambda p: F.sum(p["s"])
        elif kind == "max":
            self.kept, self.join = {"m": F.max(v)}, lambda p: F.greatest(F.lit(0).cast("bigint"), F.max(p["m"]).cast("bigint")) if compat else F.max(p["m"])
        elif kind == "avg":
            n = F.sum(weight) if weight else F.count(v)
            self.kept, self.join = {"s": F.sum(v.cast("double")), "n": n}, lambda p: F.sum(p["s"]) / F.sum(p["n"])
        else:
            raise ValueError(f"no such aggregate: {kind}")


def count(value: str | None = None) -> Aggregate:
    return Aggregate("count", value)


def total(value: str, compat: bool = False) -> Aggregate:
    """Sum as double; ``compat`` cuts it to a whole number."""
    return Aggregate("sum", value, compat=compat)


def long_total(value: str) -> Aggregate:
    return Aggregate("long_sum", value)


def largest(value: str, compat: bool = False) -> Aggregate:
    """Maximum; ``compat`` starts from 0 and cuts to a whole number."""
    return Aggregate("max", value, compat=compat)


def average(value: str, count_column: str | None = None) -> Aggregate:
    """Average; with ``count_column``, of sums and counts that were made before."""
    return Aggregate("avg", value, count_column)


def aggregate(df: DataFrame, group: list[str], wid: str = "w", **what: Aggregate) -> DataFrame:
    """Group columns, ``wid_from_<wid>`` and the results, a row for each group and window.

    Rows with the same windows are joined first, so that a row isn't copied to each of its windows: what is multiplied is
    a row for each group and slide. Sums of whole numbers aren't multiplied before they are made: they change where a pane begins or ends (``_steps``).
    """
    lo, hi = f"wid_from_{wid}", f"wid_to_{wid}"
    panes = _panes(df, group, lo, hi, what)
    if all(a.whole_numbers for a in what.values()):
        steps = _steps(_dealt(panes, group, lo, hi), group, lo, hi, what).filter("_open > 0")
        return steps.select(*group, F.explode(F.sequence("_from", F.col("_to") - 1)).alias(lo), *what)
    spread = panes.withColumn(lo, F.explode(F.sequence(lo, hi)))
    return spread.groupBy(*group, lo).agg(*[a.join({p: F.col(f"_{k}_{p}") for p in a.kept}).alias(k) for k, a in what.items()])


#: Windows of one stretch.
STRETCH = 256


def _panes(df: DataFrame, group: list[str], lo: str, hi: str, what: dict[str, Aggregate]) -> DataFrame:
    """What is kept of a group's rows with the same windows."""
    kept = [c.alias(f"_{k}_{p}") for k, a in what.items() for p, c in a.kept.items()]
    return df.filter(F.col(hi) >= F.col(lo)).groupBy(*group, lo, hi).agg(*kept)


def _dealt(panes: DataFrame, together: list[str], lo: str, hi: str) -> DataFrame:
    """Panes in each ``_stretch`` of windows that they reach; a task gets whole stretches of the columns ``together``.

    Fractions are left out where there are other columns: Spark evens out their zeros before it groups, and would move the rows again.
    """
    together = [c for c in together if panes.schema[c].dataType.typeName() not in ("float", "double")] or together
    first, last = F.floor(F.col(lo) / STRETCH), F.floor(F.col(hi) / STRETCH)
    return panes.withColumn("_stretch", F.explode(F.sequence(first, last))).repartition(*together, "_stretch")


def _steps(dealt: DataFrame, group: list[str], lo: str, hi: str, what: dict[str, Aggregate]) -> DataFrame:
    """Stretches of windows [``_from``, ``_to``) in which a group's sums don't change, and how many panes they hold (``_open``).

    A pane is added where it begins and taken away after its end, so each gives two rows, however many windows it is in.
    """
    begin, end = F.col("_stretch") * STRETCH, (F.col("_stretch") + 1) * STRETCH
    points = F.explode(F.array(F.struct(F.greatest(lo, begin).alias("at"), F.lit(1).alias("sign")), F.struct((F.col(hi) + 1).alias("at"), F.lit(-1).alias("sign")))).alias("_p")
    points = dealt.select(*group, "_stretch", points, *[f"_{k}_{p}" for k, a in what.items() for p in a.kept]).filter(F.col("_p.at") < end)
    inside = Window.partitionBy(*group, "_stretch").orderBy("_p.at", "_p.sign")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def now(c: Column) -> Column:
        return F.sum(F.when(F.col("_p.sign") > 0, c).otherwise(-c)).over(upto)

    sums = [F.when(now(F.col(f"_{k}_{p}").isNotNull().cast("int")) > 0, now(F.col(f"_{k}_{p}"))).alias(k) for k, a in what.items() for p in a.kept]
    steps = points.select(*group, "_stretch", F.col("_p.at").alias("_from"), F.coalesce(F.lead("_p.at").over(inside), end).alias("_to"), now(F.lit(1)).alias("_open"), *sums)
    return steps.filter("_from < _to")


def shares(df: DataFrame, within: list[str], cell: str, wid: str = "w") -> DataFrame:
    """(within, window, cell, n, every): the rows of each window in each cell, and in all cells.

    The counts of all cells are joined while a stretch of windows is one row, so that no row for a window is moved or sorted.
    """
    lo, hi = f"wid_from_{wid}", f"wid_to_{wid}"
    what, group = {"n": count()}, [*within, cell]
    n = _steps(_dealt(_panes(df, group, lo, hi, what), within, lo, hi), group, lo, hi, what).filter("_open > 0")
    steps = _steps(_dealt(_panes(df, within, lo, hi, what), within, lo, hi), within, lo, hi, what)
    steps = steps.groupBy(*within, "_stretch").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "n"))).alias("_s"))  # STRETCH at most
    counts = F.flatten(F.transform("_s", lambda s: F.array_repeat(s["n"], (s["_to"] - s["_from"]).cast("int"))))
    every = steps.select(*within, "_stretch", F.col("_s")[0]["_from"].alias("_first"), counts.alias("_every"))
    held = n.join(every, [*within, "_stretch"])
    held = held.select(*group, F.explode(F.sequence("_from", F.col("_to") - 1)).alias(lo), "n", "_first", "_every")
    return held.select(*group, lo, "n", F.get("_every", (F.col(lo) - F.col("_first")).cast("int")).alias("every"))


def early_average(df: DataFrame, group: list[str], value: str, order: str, threshold: int, wid: str = "w", to: str = "avg") -> DataFrame:
    """Average of a window's first ``threshold`` + 1 rows: the window closes once its count exceeds the threshold."""
    lo, hi = f"wid_from_{wid}", f"wid_to_{wid}"
    spread = df.filter(F.col(hi) >= F.col(lo)).withColumn(lo, F.explode(F.sequence(lo, hi)))
    # The rank filter is pushed below the exchange: at most threshold + 1 rows of a window leave a task.
    first = spread.withColumn("_no", F.row_number().over(Window.partitionBy(*group, lo).orderBy(order))).filter(F.col("_no") <= threshold + 1)
    return first.groupBy(*group, lo).agg(F.avg(value).alias(to))


def ticks(spark, start: int, end: int, period: int, column: str = "tick", relative: int = 0, slack: int = 0, granularity: int = 1, warp: int = 1) -> DataFrame:
    """Ticks of a timer from ``start`` on, before ``end``.

    A tick at time s shows (s - ``relative``) * ``warp`` - ``slack``, cut towards zero to a multiple of ``granularity``. ``period`` counts in the
    time shown: with a ``warp`` of 60 a period of a minute ticks each second.
    """
    shown = (F.col("id") - relative) * warp - slack
    return spark.range(start, end, max(period // warp, 1)).select((shown - shown % granularity).alias(column))
