"""Derivatives and derived motion features of tracks (``rec_id, track_id, frame, x, y, ...``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

TRACK = ("rec_id", "track_id")


def along(keys=TRACK, order: str = "frame"):
    return W.partitionBy(*keys).orderBy(order)


def gradient(value: Column, dt: float, window) -> Column:
    """Central difference by row adjacency, one-sided at the ends, 0 for a single row."""
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    return (
        F.when(before.isNull() & after.isNull(), 0.0)
        .when(before.isNull(), (after - value) / F.lit(dt))
        .when(after.isNull(), (value - before) / F.lit(dt))
        .otherwise((after - before) / F.lit(2 * dt))
    )


def with_velocity(tracks: DataFrame, dt: float) -> DataFrame:
    w = along()
    return tracks.withColumns({"vx": gradient(F.col("x"), dt, w), "vy": gradient(F.col("y"), dt, w)})


def with_acceleration(tracks: DataFrame, dt: float) -> DataFrame:
    w = along()
    return tracks.withColumns({"ax": gradient(F.col("vx"), dt, w), "ay": gradient(F.col("vy"), dt, w)})


def with_motion(tracks: DataFrame, dt: float) -> DataFrame:
    """Velocity, acceleration and heading; one sort of each track serves all of them."""
    out = with_acceleration(with_velocity(tracks, dt), dt)
    return out.withColumn("psi", G.heading(F.col("vx"), F.col("vy")))


def with_polar(tracks: DataFrame, x0: float, y0: float) -> DataFrame:
    rho, theta = G.polar(F.col("x"), F.col("y"), x0, y0)
    return tracks.withColumns({"rho": rho, "theta": theta})


def speed_stats(tracks: DataFrame, by: str = "agent_type") -> DataFrame:
    v = G.speed(F.col("vx"), F.col("vy"))
    return tracks.groupBy(by).agg(
        F.max(v).alias("max_speed"), F.avg(v).alias("mean_speed"), F.median(v).alias("median_speed"), F.countDistinct("track_id").alias("n_tracks")
    )


def two_wheeler_rule(tracks: DataFrame, threshold: float = 3.0, keys=TRACK, joint: str | None = None) -> DataFrame:
    """Tracks of the joint pedestrian/bicycle class: a pedestrian if it is always slower than the threshold, else a bicycle.

    ``joint`` names the class that is split, and rows of others keep theirs; without it all rows are of that class.
    A track without any speed is a bicycle.
    """
    v = G.speed(F.col("vx"), F.col("vy"))
    top = F.max(v).over(W.partitionBy(*keys))
    kind = F.when(top < threshold, "pedestrian").otherwise("bicycle")
    return tracks.withColumn("agent_type", kind if joint is None else F.when(F.col("agent_type") == joint, kind).otherwise(F.col("agent_type")))


def motion_rule(tracks: DataFrame, speed: float = 3.0, acceleration: float = 3.0, turn: float = 0.5, keys=TRACK) -> DataFrame:
    """One row per track: a bicycle if its top speed is above its limit, or top acceleration or turn rate is not above theirs."""
    v, a = G.speed(F.col("vx"), F.col("vy")), G.speed(F.col("ax"), F.col("ay"))
    w = G.angular_velocity(F.col("vx"), F.col("vy"), F.col("ax"), F.col("ay"))
    tops = tracks.groupBy(*keys).agg(F.max(v).alias("top_speed"), F.max(a).alias("top_acceleration"), F.max(w).alias("top_turn"))
    bicycle = (F.col("top_speed") > speed) | (F.col("top_acceleration") <= acceleration) | (F.col("top_turn") <= turn)
    return tops.withColumn("agent_type", F.when(bicycle, "bicycle").otherwise("pedestrian"))


def origin_shift(tracks: DataFrame, x0: Column, y0: Column) -> DataFrame:
    return tracks.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def rebase(tracks: DataFrame, column: str, keys=("rec_id",)) -> DataFrame:
    """Subtract the recording's least value."""
    return tracks.withColumn(column, F.col(column) - F.min(column).over(W.partitionBy(*keys)))


def unit_axes(tracks: DataFrame) -> DataFrame:
    """Feet to metres with the axes swapped: the long axis becomes x, the lateral one is negated."""
    return tracks.withColumns({"x": G.feet(F.col("y")), "y": -G.feet(F.col("x"))})
