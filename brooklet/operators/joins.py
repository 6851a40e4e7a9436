"""Joins and n-ary operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.functions.columns import div
from brooklet.operators.ordered import numbered, running


def equi_join(left: DataFrame, right: DataFrame, pairs: Mapping[str, str], residual: Column | None = None) -> DataFrame:
    """Inner join on pairs of columns and, on top, any other condition. Null keys match nothing."""
    on = F.lit(True) if residual is None else residual
    for l, r in pairs.items():
        on = on & (left[l] == right[r])
    return left.join(right, on, "inner")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, most: int = 10_000) -> DataFrame:
    """Join by any condition. Without an equality in it all pairs are tried: the right side must have ``most`` rows at the utmost, which
    is looked at first; then it is broadcast."""
    if len(right.limit(most + 1).select(F.lit(1)).collect()) > most:
        raise ValueError(f"the right side of a join without equality has more than {most} rows: join by stretches of the values first")
    return left.join(F.broadcast(right), condition, "inner")


def extension_join(left: DataFrame, right: DataFrame, keys: Sequence[str], arrival: str, side: str, stretch: int = 4096) -> DataFrame:
    """Equi-join in which rows of the flagged side match at most once: the first to arrive of the other side.

    With ``both``, the k-th row of a key on the left meets the k-th on the right: whichever side is ahead waits, oldest first.
    Columns of the right side other than the keys get the prefix ``r_``. ``arrival`` is a whole number; the rows of a key are
    counted in stretches of it.
    """
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in keys})
    if side == "left":
        one = r.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in r.columns if c not in keys]), f"r_{arrival}").alias("_r"))
        return left.join(one, list(keys)).select(*left.columns, "_r.*")
    if side == "right":
        one = left.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in left.columns if c not in keys]), arrival).alias("_l"))
        return r.join(one, list(keys)).select(*keys, "_l.*", *[c for c in r.columns if c not in keys])
    if side == "both":
        l = numbered(left, list(keys), arrival, div(arrival, stretch), "_k")
        r = numbered(r, list(keys), f"r_{arrival}", div(f"r_{arrival}", stretch), "_k")
        return l.join(r, [*keys, "_k"]).drop("_k")
    raise ValueError(f"no such side: {side}")


def window_join(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, size: int) -> DataFrame:
    """Equi-join of rows whose times differ by at most ``size``.

    Rows meet by key and stretch of time, so that a frequent key is dealt over many tasks. Columns of the right side other
    than the keys get the prefix ``r_``.
    """
    step = max(size, 1)
    l = left.withColumn("_b", div(F.col(t), step))
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in keys})
    place = div(F.col(f"r_{t}"), step)
    r = r.withColumn("_b", F.explode(F.array(place - 1, place, place + 1)))
    near = F.col(f"r_{t}").between(F.col(t) - size, F.col(t) + size)
    return l.join(r, [*keys, "_b"]).filter(near).drop("_b")


def pane_join(left: DataFrame, right: DataFrame, keys: Sequence[str], wid: str) -> DataFrame:
    """Equi-join of rows that share a window id."""
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in (*keys, wid)})
    return left.join(r, [*keys, wid])


def present(left: DataFrame, right: DataFrame, t: str, right_t: str) -> DataFrame:
    """The left rows that the right side's progress covers: those not after its latest time."""
    done = right.agg(F.max(right_t).alias("_done"))
    return left.join(F.broadcast(done), F.col(t) <= F.col("_done")).drop("_done")  # one row


def fill_frames(rows: DataFrame, frames: DataFrame, group: str, t: str, key: str, stretch: int) -> DataFrame:
    """Adds ``ff_frame_id``: the first frame of the row's group with start <= t <= end; rows in no frame go.

    ``frames``: frame_id, frame_start, frame_end, frame_group; ``key`` tells rows apart. Frames are cut into stretches of
    time, by which rows and frames meet, so that neither a frequent group nor a long frame lands in one task.
    """
    f = frames.select("frame_id", "frame_start", "frame_end", F.col("frame_group").alias(group), F.explode(F.sequence(div("frame_start", stretch), div("frame_end", stretch))).alias("_b"))
    met = rows.withColumn("_b", div(t, stretch)).join(f, [group, "_b"]).filter(F.col(t).between(F.col("frame_start"), F.col("frame_end")))
    first = met.groupBy(key).agg(F.min(F.struct("frame_start", "frame_id")).alias("_f"), *[F.first(c).alias(c) for c in rows.columns if c != key])
    return first.select(*rows.columns, F.col("_f.frame_id").alias("ff_frame_id"))


def union(inputs: Sequence[DataFrame], mapping: Mapping[str, Sequence[str | None]]) -> DataFrame:
    """Bag union: each output column names the column of each input, or None for null."""
    parts = [df.select(*[(F.col(names[i]) if names[i] else F.lit(None)).alias(out) for out, names in mapping.items()]) for i, df in enumerate(inputs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pace(inputs: Sequence[DataFrame], t: str, order: str, by: Column, divergence: int) -> DataFrame:
    """Union that drops rows which lag more than ``divergence`` behind the latest time seen before them in arrival order."""
    every = inputs[0]
    for df in inputs[1:]:
        every = every.unionByName(df)
    seen = running(every, [], order, by, F.col(t), "max", "_high")
    return seen.filter(F.col(t) >= F.col("_high") - divergence).drop("_high")


def synchronize(left: DataFrame, right: DataFrame, t: str, right_t: str) -> tuple[DataFrame, DataFrame]:
    """Both inputs in time order, up to the time that both have reached."""
    reach = left.agg(F.max(t).alias("_l")).crossJoin(right.agg(F.max(right_t).alias("_r"))).select(F.least("_l", "_r").alias("_done"))  # one row
    return tuple(df.join(F.broadcast(reach), F.col(c) <= F.col("_done")).drop("_done").orderBy(c) for df, c in ((left, t), (right, right_t)))


def impute(rows: DataFrame, archive: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Replaces a missing value by the archive's average for the same keys."""
    mean = archive.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return rows.join(mean, list(keys), "left").withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def archive_at(times: DataFrame, archive: DataFrame, t: str) -> DataFrame:
    """The archive's rows of the times that the stream has passed."""
    return archive.join(times.select(t).distinct(), t, "left_semi")
