"""Frames: stretches of a stream that its own data delimit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.operators import deltas
from brooklet.operators.ordered import runs


def threshold_frames(df: DataFrame, group: str, t: str, predicate: str, size: int, by: Column, segmentation: bool = False) -> DataFrame:
    """Maximal runs of rows whose 0/1 ``predicate`` is 1, of at least ``size`` rows, as [first time, last time].

    With ``segmentation`` the runs of 0 are frames as well. ``frame_id`` counts a group's frames from 1.
    Times of a group must differ. Null counts as 0.
    """
    held = df.select(group, t, F.coalesce(F.col(predicate).cast("int"), F.lit(0)).alias("predicate"))

    def wanted(run: Column, length: Column) -> Column:
        return (length >= size) & (run["predicate"].isin(0, 1) if segmentation else run["predicate"] == 1)

    found = runs(held, [group], t, by, ["predicate"], [t], wanted)
    return found.select(F.col("run_no").alias("frame_id"), F.col("start").alias("frame_start"), F.col("end").alias("frame_end"), F.col(group).alias("frame_group"), "length", "run.predicate")


def delta_frames(df: DataFrame, group: str, t: str, value: str, delta: float, by: Column, closed_end: bool = False) -> DataFrame:
    """Partitions each group: a frame ends before the first row that is at least ``delta`` away from the frame's first value.

    That row begins the next frame. ``frame_end`` is the time of the frame's last row, or with ``closed_end`` that of the
    row that closed it. Rows without value are passed over. ``by`` is a whole number that never falls as time grows: a group is dealt over its
    stretches, of which a task holds one (``deltas``).
    """
    found = deltas.frames(df, group, t, value, delta, by, closed_end)
    return found.select(F.col("g").alias("frame_group"), "frame_id", "frame_start", "frame_end", "length", F.lit("final").alias("status"))


def boundary_frames(df: DataFrame, group: str, t: str, value: str, width: float, by: Column) -> DataFrame:
    """Maximal runs of rows whose value lies in one stripe [k * width, (k + 1) * width)."""
    held = df.filter(F.col(value).isNotNull()).select(group, t, F.floor(F.col(value) / width).alias("stripe"))
    found = runs(held, [group], t, by, ["stripe"], [t], lambda run, length: F.lit(True))
    return found.select(F.col("run_no").alias("frame_id"), F.col("start").alias("frame_start"), F.col("end").alias("frame_end"), F.col(group).alias("frame_group"), "length", "run.stripe")


def split_on_boundaries(df: DataFrame, t1: str, t2: str, start: int, gap: int) -> DataFrame:
    """Cuts each interval [t1, t2] at start + k * gap into consecutive pieces; empty pieces go."""
    k = F.explode(F.sequence(F.floor((F.col(t1) - start) / F.lit(gap)), F.floor((F.col(t2) - start) / F.lit(gap)))).alias("_k")
    cut = df.select("*", k)
    lo, hi = F.greatest(F.col(t1), F.lit(start) + F.col("_k") * gap), F.least(F.col(t2), F.lit(start) + (F.col("_k") + 1) * gap)
    return cut.select(*[lo.alias(t1) if c == t1 else hi.alias(t2) if c == t2 else F.col(c) for c in df.columns]).filter(F.col(t1) < F.col(t2))
