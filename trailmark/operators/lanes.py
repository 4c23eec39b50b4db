"""Lanes, driving direction and maneuvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kinematics import TRACK, along

KEEP = 3


def markings(text: Column) -> Column:
    """``'0;3.5;7'`` as an array of doubles."""
    return F.transform(F.split(text, ";"), lambda s: s.cast("double"))


def lane_width(lines: Column) -> Column:
    """The mean distance of neighbouring markings."""
    return (F.element_at(lines, -1) - F.element_at(lines, 1)) / (F.size(lines) - 1)


def lane_displacement(y: Column, lane: Column, direction: Column, lines: Column) -> Column:
    """Offset from the lane's centre in [-1, 1], positive to the left of travel."""
    value = F.lit(2.0) * (y - F.get(lines, lane - 2)) / lane_width(lines) - 1
    return F.when(direction == 2, -value).otherwise(value)


def road_displacement(y: Column, direction: Column, lines: Column) -> Column:
    low, high = F.element_at(lines, 1), F.element_at(lines, -1)
    value = F.lit(2.0) * (y - low) / (high - low) - 1
    return F.when(direction == 2, -value).otherwise(value)


def centroid(x: Column, y: Column, width: Column, height: Column, direction: Column) -> tuple[Column, Column]:
    """From the upper-left corner of a box to the centre of the front edge's side."""
    return F.when(direction == 2, x + width / 2).otherwise(x - width / 2), y + height / 2


def normalize_direction(tracks: DataFrame, y_upper: float, y_lower: float) -> DataFrame:
    """Forward and left axes for both directions of travel; direction 1 is turned about the recording's greatest x, after x is rebased to 0."""
    turned = F.col("driving_direction") == 1
    near, far = (f("x").over(W.partitionBy("rec_id")) for f in (F.min, F.max))
    flip = lambda c: F.when(turned, -F.col(c)).otherwise(F.col(c))
    side = lambda c: F.when(turned, F.col(c)).otherwise(-F.col(c))
    out = {
        "x": F.when(turned, far - F.col("x")).otherwise(F.col("x") - near),
        "y": F.when(turned, F.col("y") - y_upper).otherwise(F.lit(y_lower) - F.col("y")),
    }
    out |= {c: flip(c) for c in ("vx", "ax") if c in tracks.columns} | {c: side(c) for c in ("vy", "ay") if c in tracks.columns}
    return tracks.withColumns(out)


def map_of_direction(direction: Column) -> Column:
    """Which of a recording's two maps a track drives on: the upper one in direction 1, else the lower one."""
    return F.when(direction == 1, "upper").otherwise("lower")


def assign_lane(y: Column, width: float, lanes: int, negative: int = 0) -> Column:
    """``ceil(y / width)``, null outside the road."""
    lane = F.ceil(y / F.lit(width)).cast("int")
    return F.when((lane >= 1 - negative) & (lane <= lanes - negative), lane)


def fill_lane(tracks: DataFrame, column: str = "lane_id", keys=TRACK) -> DataFrame:
    """Forward fill if the track's last value is missing, else back fill."""
    w = along(keys)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ahead = F.last(column, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    back = F.first(column, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return tracks.withColumn(column, F.when(F.last(F.col(column)).over(whole).isNull(), ahead).otherwise(back))


def lane_changes(tracks: DataFrame, column: str = "lane_id", keys=TRACK) -> DataFrame:
    """``num_lane_changes``: the sum of jumps in lane numbers (two lanes at once count two), missing values skipped."""
    step = F.abs(F.col(column) - F.lag(column).over(along(keys)))
    return tracks.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0)).cast("int").alias("num_lane_changes"))


def driving_direction(tracks: DataFrame, keys=TRACK) -> DataFrame:
    """2 for tracks whose x grows from the first to the last frame, else 1."""
    return tracks.groupBy(*keys).agg(F.when(F.min_by("x", "frame") < F.max_by("x", "frame"), 2).otherwise(1).cast("int").alias("driving_direction"))


def _label(tracks: DataFrame, event: Column, fz: int, keys) -> DataFrame:
    """The last event within five seconds ahead labels a row; ``event`` is its sign (null: none; > 0: to the left)."""
    w = along(keys)
    pos = F.row_number().over(w)
    held = tracks.withColumn("_e", event)
    mark = F.when(F.col("_e").isNotNull(), F.struct(pos.alias("at"), F.col("_e").alias("side")))
    held = held.withColumn("_p", pos).withColumn("_m", mark)
    found = F.last("_m", True).over(w.rowsBetween(1, 5 * fz - 1))
    gap = F.col("_f.at") - F.col("_p")
    near = F.when(gap <= fz - 1, 0).when(gap <= 3 * fz - 1, 1).otherwise(2)
    code = F.when(F.col("_f").isNull(), KEEP).when(F.col("_f.side") > 0, near).otherwise(near + 4)
    return held.withColumn("_f", found).withColumn("maneuver", code.cast("int")).drop("_e", "_p", "_m", "_f")


def maneuvers(tracks: DataFrame, fz: int, column: str = "lane_id", keys=TRACK) -> DataFrame:
    """0/1/2 before a change to the left within 1/3/5 s, 4/5/6 to the right, 3 else; the latest change decides."""
    step = F.col(column) - F.lag(column).over(along(keys))
    side = F.when(F.col("driving_direction") == 2, -F.signum(step)).otherwise(F.signum(step))
    return _label(tracks, F.when(step != 0, side), fz, keys)


def exit_maneuvers(tracks: DataFrame, fz: int, keys=TRACK) -> DataFrame:
    """As maneuvers(), for recordings with a ``lane_change`` flag and an offset from the lane's centre."""
    w = along(keys)
    starts = (F.col("lane_change") == 1) & (F.coalesce(F.lag("lane_change").over(w), F.lit(0)) == 0)
    side = F.signum(F.col("lane_offset") - F.lag("lane_offset").over(w))
    return _label(tracks, F.when(starts, F.coalesce(side, F.lit(0.0))), fz, keys)


def lane_model(tracks: DataFrame, column: str = "lane_id") -> DataFrame:
    """Equidistant lane bounds, ``rec_id, bound, y``, from a line through the medians of y of the lanes.

    Of n lanes, 1 to n - 1 are fitted: the last one, where vehicles come and go, is left out.  There are n bounds, the
    first half a lane before the first lane's centre.  With fewer than two lanes to fit, the bounds are null.
    """
    lanes = tracks.where(F.col(column).isNotNull()).groupBy("rec_id", column).agg(F.median("y").alias("m"))
    lanes = lanes.withColumn("n", F.count("*").over(W.partitionBy("rec_id")).cast("int"))  # a row per lane
    fitted = F.when(F.col(column).between(1, F.col("n") - 1), F.col("m"))
    line = lanes.groupBy("rec_id").agg(F.regr_slope(fitted, column).alias("width"), F.regr_intercept(fitted, column).alias("base"), F.max("n").alias("n"))
    bounds = line.withColumn("bound", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return bounds.select("rec_id", "bound", (F.col("base") + F.col("width") / 2 + F.col("width") * F.col("bound")).alias("y"))
