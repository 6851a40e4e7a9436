"""Order-dependent columns without one task for each group.

Each function takes a ``bucket`` column that never falls as the order grows. Windows run within (group, bucket); what earlier buckets
contribute is found on one row for each group and bucket and joined back; the whole input as one group takes its buckets by the thousand. A group that holds a third of all rows is so dealt
over as many tasks as it has buckets, and an empty ``group`` (the whole input) is no special case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_BUCKET = "_ord_bucket"


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


#: Buckets of one coarse bucket.
COARSE = 1024
#: How what earlier buckets contribute is found over their rows, and joined with what earlier coarse buckets contribute.
_EARLIER = {
    "sum": (lambda c, o: F.sum(c), lambda within, top: F.coalesce(within + top, within, top)),
    "max": (lambda c, o: F.max(c), lambda within, top: F.greatest(within, top)),
    "last": (lambda c, o: F.max_by(c, F.when(c.isNotNull(), F.col(o))), lambda within, top: F.coalesce(within, top)),
}


def _over(kind: str, c: str, window: WindowSpec) -> Column:
    return {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}[kind](c).over(window)


def _with_before(df: DataFrame, group: list[str], aggregates: dict[str, Column], over_earlier: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for each row's (group, bucket), the sum, maximum or last of the aggregates of the earlier buckets.

    ``over_earlier``: name -> (kind, aggregate). The whole input as one group has many buckets: they are taken by ``COARSE`` at a
    time, so that no task holds more than those, or one row for each coarse bucket. Its buckets are numbers.
    """
    keys = [*group, _BUCKET]
    sums = df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggregates.items()])
    if group:
        earlier = Window.partitionBy(*group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], *[_over(kind, c, earlier).alias(k) for k, (kind, c) in over_earlier.items()])
    else:
        sums = sums.withColumn("_coarse", F.floor(F.col(_BUCKET) / COARSE))
        top = sums.groupBy("_coarse").agg(*[_EARLIER[kind][0](F.col(c), _BUCKET).alias(c) for kind, c in over_earlier.values()])
        above = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
        top = top.select(F.col("_coarse").alias("_c"), *[_over(kind, c, above).alias(f"_top_{k}") for k, (kind, c) in over_earlier.items()])
        earlier = Window.partitionBy("_coarse").orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        near = sums.select(F.col(_BUCKET).alias(f"_{_BUCKET}"), "_coarse", *[_over(kind, c, earlier).alias(k) for k, (kind, c) in over_earlier.items()])
        both = near.join(top, near["_coarse"].eqNullSafe(top["_c"]))
        before = both.select(f"_{_BUCKET}", *[_EARLIER[kind][1](F.col(k), F.col(f"_top_{k}")).alias(k) for k, (kind, _) in over_earlier.items()])
    return df.join(before, _same(keys, df, before), "left").drop(*[f"_{k}" for k in keys])


def _inside(group: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*group, _BUCKET).orderBy(order)


def numbered(df: DataFrame, group: list[str], order: str, bucket: Column, to: str = "row_no") -> DataFrame:
    """Adds the place of each row in its group, from 1."""
    held = df.withColumn(_BUCKET, bucket)
    out = _with_before(held, group, {"_ord_n": F.count(F.lit(1))}, {"_ord_before": ("sum", "_ord_n")})
    place = F.row_number().over(_inside(group, order)) + F.coalesce("_ord_before", F.lit(0))
    return out.withColumn(to, place.cast("long")).drop("_ord_before", _BUCKET)


def _join_sum(here: Column, before: Column) -> Column:
    return F.coalesce(here + before, here, before)


#: For each kind: the aggregate of a whole bucket, how it is taken over earlier buckets, the aggregate over a frame, how the two are joined.
_KINDS = {
    "sum": (lambda v, o: F.sum(v), "sum", F.sum, _join_sum),
    "count": (lambda v, o: F.count(v), "sum", F.count, _join_sum),
    "max": (lambda v, o: F.max(v), "max", F.max, F.greatest),
    "last": (lambda v, o: F.max_by(v, F.when(v.isNotNull(), F.col(o))), "last", lambda v: F.last(v, ignorenulls=True), F.coalesce),
}


def running_all(df: DataFrame, group: list[str], order: str, bucket: Column, values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Adds, for each name, the sum, count, max or last value that isn't null of the group's rows up to each row, or ``before`` it.

    ``values``: name -> (kind, column).
    """
    held = df.withColumn(_BUCKET, bucket).select("*", *[v.alias(f"_ord_v_{k}") for k, (_, v) in values.items()])
    kinds = {k: _KINDS[kind] for k, (kind, _) in values.items()}
    whole = {f"_ord_a_{k}": x[0](F.col(f"_ord_v_{k}"), order) for k, x in kinds.items()}
    out = _with_before(held, group, whole, {f"_ord_b_{k}": (x[1], f"_ord_a_{k}") for k, x in kinds.items()})
    frame = _inside(group, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    added = [x[3](x[2](F.col(f"_ord_v_{k}")).over(frame), F.col(f"_ord_b_{k}")).alias(k) for k, x in kinds.items()]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *added)


def running(df: DataFrame, group: list[str], order: str, bucket: Column, value: Column, kind: str, to: str) -> DataFrame:
    """Adds one running value; see ``running_all``."""
    return running_all(df, group, order, bucket, {to: (kind, value)})


def runs(df: DataFrame, group: list[str], order: str, bucket: Column, values: list[str], first: list[str], wanted: Callable[[Column, Column], Column]) -> DataFrame:
    """The maximal runs of rows with equal ``values`` in each group that are ``wanted`` (by the struct of values, and by length).

    Columns: the group, ``run_no`` (the place among the group's wanted runs, from 1), ``start`` and ``end`` (first and last ``order``),
    ``length``, ``run`` (the values), ``row`` (``first`` of the row that opened it) and ``before`` (row and values of the run before, wanted or not).

    Rows move once, to their (group, bucket), where they are cut into pieces. One row for each bucket goes to its group, where
    pieces that meet at a bucket's edge are chained, and back; the pieces don't move. A run is told in the bucket in which it begins.
    """
    # A struct is never null itself, so that null groups meet in plain joins.
    held = df.select(F.struct(*group, bucket.alias("_b")).alias("_k"), F.col(order).alias("s"), F.struct(*values).alias("v"), F.struct(*first).alias("row"))
    inside = Window.partitionBy("_k").orderBy("s")
    every = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of one order, so that one pass gives all
    placed = held.select("*", F.row_number().over(inside).alias("no"), F.lag("v").over(inside).eqNullSafe(F.col("v")).alias("same"), F.lag("s").over(inside).alias("ago"), F.count(F.lit(1)).over(every).alias("rows"), F.last("s").over(every).alias("until"))
    n = F.coalesce(F.lead("no").over(inside), F.col("rows") + 1) - F.col("no")
    was = F.lag(F.struct("row", F.col("v").alias("run"))).over(inside).alias("was")
    pieces = placed.filter(~F.col("same")).select("_k", "s", "v", "row", F.coalesce(F.lead("ago").over(inside), "until").alias("e"), n.cast("long").alias("n"), F.row_number().over(inside).alias("i"), F.count(F.lit(1)).over(every).alias("k"), was)

    middle = F.sum(F.when((F.col("i") > 1) & (F.col("i") < F.col("k")) & wanted(F.col("v"), F.col("n")), 1).otherwise(0)).over(every)
    last = [F.last(c).over(every).alias(f"last_{c}") for c in ("s", "v", "row", "e", "n")]
    edges = pieces.select("_k", "v", "n", "e", "i", "k", middle.alias("middle"), *last).filter("i = 1").withColumn("_g", F.struct(*[F.col(f"_k.{g}") for g in group]))

    along = Window.partitionBy("_g").orderBy("_k._b")
    met = edges.select("*", F.lag("last_v").over(along).eqNullSafe(F.col("v")).alias("on")).withColumn("through", F.col("on") & (F.col("k") == 1))
    ends = F.col("on") & ~F.col("through")  # the first piece ends the chain of the bucket before
    met = met.select("*", F.sum(F.when(F.col("through"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"), F.lead(F.when(ends, F.struct("n", "e"))).over(along).alias("tail"))
    chain = Window.partitionBy("_g", "chain").orderBy("_k._b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.select("*", F.sum(F.col("last_n") + F.coalesce("tail.n", F.lit(0))).over(chain).alias("all_n"), F.last(F.coalesce("tail.e", "last_e")).over(chain).alias("all_e"), F.first("last_row").over(chain).alias("opened"))
    found = F.col("middle") + F.when((F.col("k") > 1) & ~F.col("on") & wanted(F.col("v"), F.col("n")), 1).otherwise(0) + F.when(~F.col("through") & wanted(F.col("last_v"), F.col("all_n")), 1).otherwise(0)
    earlier = F.coalesce(F.sum(found).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.when(F.lag("chain").over(along).isNotNull(), F.struct(F.lag("opened").over(along).alias("row"), F.lag("last_v").over(along).alias("run")))
    told = met.select("_k", "on", "all_n", "all_e", earlier.alias("earlier"), before.alias("old"))

    at_end = F.col("i") == F.col("k")
    own = pieces.join(told, "_k").filter(~(F.col("on") & (F.col("i") == 1)))
    # The piece after one that goes on from the bucket before has that run before it, not the piece.
    old = F.when((F.col("i") == 1) | ((F.col("i") == 2) & F.col("on")), F.col("old")).otherwise(F.col("was"))
    out = own.select("_k", "earlier", "row", old.alias("before"), F.col("v").alias("run"), F.col("s").alias("start"), F.when(at_end, F.col("all_e")).otherwise(F.col("e")).alias("end"), F.when(at_end, F.col("all_n")).otherwise(F.col("n")).alias("length"))
    out = out.filter(wanted(F.col("run"), F.col("length")))
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("_k").orderBy("start"))
    return out.select(*[F.col(f"_k.{g}").alias(g) for g in group], place.cast("long").alias("run_no"), "start", "end", "length", "run", "row", "before")


def last_rows(df: DataFrame, group: list[str], order: str, bucket: Column, size: int, aggregates: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the last ``size`` rows of the group up to each row.

    Rows are dealt in blocks by their number; each block also gets the ``size`` - 1 rows before it.
    """
    block = max(4096, 8 * size)
    held = numbered(df, group, order, bucket, "_no")
    own = F.call_function("div", F.col("_no") - 1, F.lit(block))
    late = (F.col("_no") - 1) % block >= block - (size - 1)
    copies = F.when(late, F.array(own, own + 1)).otherwise(F.array(own)) if size > 1 else F.array(own)
    dealt = held.withColumn("_own", own).withColumn("_block", F.explode(copies))
    frame = Window.partitionBy(*group, "_block").orderBy("_no").rowsBetween(-(size - 1), 0)
    out = dealt.select("*", *[a.over(frame).alias(k) for k, a in aggregates.items()])
    return out.filter("_own = _block").drop("_no", "_own", "_block")
