"""Grid cells, cell frames and the two-sensor position of a person."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions.columns import div
from brooklet.operators.ordered import running_all, runs

#: The sensors on the left and right foot of persons 0 to 16.
SENSORS = (
    (13, 14), (47, 16), (49, 88), (19, 52), (53, 54), (23, 24), (57, 58), (59, 28), (61, 62),
    (63, 64), (65, 66), (67, 68), (69, 38), (71, 40), (73, 74), (75, 44), (105, 106),
)
#: Mid-point of the cell outside the grid.
NOWHERE = float(-(1 << 31))


@dataclass(frozen=True)
class Grid:
    """xcells * ycells cells over [left, right) and (bottom, top], numbered from 1 by rows from the top left."""

    xcells: int
    ycells: int
    left: float
    bottom: float
    right: float
    top: float

    def cell(self, x: Column, y: Column) -> Column:
        """cid (0 outside) and the mid-point of the cell."""
        inside = (x >= self.left) & (x < self.right) & (y > self.bottom) & (y <= self.top)
        w, h = self.right - self.left, self.top - self.bottom
        xc, yc = F.floor((x - self.left) * self.xcells / w), F.floor((F.lit(self.top) - y) * self.ycells / h)
        cid = F.when(inside, yc * self.xcells + xc + 1).otherwise(0).cast("long")
        mid_x, mid_y = F.lit(self.left) + (xc + 0.5) * w / self.xcells, F.lit(self.top) - (yc + 0.5) * h / self.ycells
        return F.struct(cid.alias("cid"), F.when(inside, mid_x).otherwise(NOWHERE).alias("c_midx"), F.when(inside, mid_y).otherwise(NOWHERE).alias("c_midy"))


def grid_cell(df: DataFrame, x: str, y: str, grid: Grid) -> DataFrame:
    """Adds cid, c_midx, c_midy of each point."""
    return df.select("*", grid.cell(F.col(x).cast("double"), F.col(y).cast("double")).alias("_c")).select(*df.columns, "_c.*")


def grid_frames(df: DataFrame, group: str, t: str, x: str, y: str, grid: Grid, by: Column) -> DataFrame:
    """For each change of a group's cell, the row that changed it with ``st_ts`` (entry to the old cell), ``end_ts`` (its own time) and
    the old cell. The first cell of a group gives nothing, and neither does the open stay at the end.

    Cells come from the coordinates alone, so a jump over several cells is one change.
    """
    cells = grid_cell(df, x, y, grid)
    stays = runs(cells, [group], t, by, ["cid", "c_midx", "c_midy"], df.columns, lambda run, length: F.lit(True)).filter(F.col("before").isNotNull())
    return stays.select("row.*", F.col(f"before.row.{t}").alias("st_ts"), F.col("start").alias("end_ts"), "before.run.*")


def sensor_table(spark: SparkSession) -> DataFrame:
    """sid, pid and side (0 left, 1 right) of the 34 sensors."""
    return spark.createDataFrame([(sid, pid, side) for pid, pair in enumerate(SENSORS) for side, sid in enumerate(pair)], "sid int, pid int, side int")


def person_positions(df: DataFrame, sid: str, t: str, x: str, y: str, by: Column, tie: str | None = None) -> DataFrame:
    """Adds ``pid`` and replaces x and y by the whole-number mean of the latest positions of the person's two sensors.

    Rows of unknown sensors go; until the other foot is seen a row keeps its own position. Rows of one person and time come in the order of ``tie``
    (of arrival, say); without it times must differ within a person.
    """
    known = sensor_table(df.sparkSession).select(F.col("sid").alias("_sid"), "pid", F.col("side").alias("_side"))
    held = df.join(F.broadcast(known), df[sid] == known["_sid"])  # 34 rows
    held = held.withColumn("_order", F.struct(t, *([tie] if tie else [])))
    held = running_all(held, ["pid"], "_order", by, {f"_{side}": ("last", F.when(F.col("_side") == side, F.struct(x, y))) for side in (0, 1)})
    both = F.col("_0").isNotNull() & F.col("_1").isNotNull()
    mean = {c: F.when(both, div(F.col(f"_0.{c}") + F.col(f"_1.{c}"), 2)).otherwise(F.col(c)) for c in (x, y)}
    return held.select(*[mean[c].alias(c) if c in mean else F.col(c) for c in df.columns], "pid")
