"""Track metadata and filters on whole tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kinematics import TRACK


def meta(tracks: DataFrame, kind: str | None = None, keys=TRACK) -> DataFrame:
    """One row per track: its first and last frame, and the class of its first row."""
    first = [F.min_by(kind, "frame").alias("agent_type")] if kind else []
    return tracks.groupBy(*keys).agg(F.min("frame").alias("initial_frame"), F.max("frame").alias("final_frame"), *first)


def without_classes(tracks: DataFrame, classes, column: str = "agent_type") -> DataFrame:
    return tracks.where(~F.col(column).isin(*classes))


def without_parked(tracks_meta: DataFrame, first: int = 0) -> DataFrame:
    """Tracks that are not there from the first frame to the recording's last."""
    last = F.max("final_frame").over(W.partitionBy("rec_id"))
    parked = (F.col("initial_frame") == first) & (F.col("final_frame") == F.col("_last"))
    return tracks_meta.withColumn("_last", last).where(~parked).drop("_last")


def without_any(tracks: DataFrame, bad: Column, keys=TRACK) -> DataFrame:
    """Tracks in which no row is bad."""
    return tracks.withColumn("_bad", F.bool_or(bad).over(W.partitionBy(*keys))).where(~F.coalesce("_bad", F.lit(False))).drop("_bad")


def present_by(tracks: DataFrame, frame: int, keys=TRACK) -> DataFrame:
    """Tracks that have started by a frame."""
    return tracks.withColumn("_first", F.min("frame").over(W.partitionBy(*keys))).where(F.col("_first") <= frame).drop("_first")


def at_least(tracks: DataFrame, n: int, keys=TRACK) -> DataFrame:
    """Tracks of n rows or more."""
    return tracks.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def near_static(steps: DataFrame, keys, threshold: int = 3) -> DataFrame:
    """``static`` per agent: at most ``threshold`` distinct x, each missing one counting as distinct."""
    spread = F.countDistinct("x") + F.count_if(F.col("x").isNull())
    return steps.groupBy(*keys).agg((spread <= threshold).alias("static"))


def near_static_steps(rows: DataFrame, value=lambda s: s["x"], threshold: int = 3) -> DataFrame:
    """near_static() of rows with whole ``steps``: adds ``static``, with nothing dealt or counted by step."""
    xs = F.transform("steps", lambda s: value(s) + F.lit(0.0))  # adding 0 makes -0.0 and 0.0 one
    spread = F.size(F.array_distinct(F.filter(xs, lambda x: x.isNotNull()))) + F.size(F.filter(xs, lambda x: x.isNull()))
    return rows.withColumn("static", spread <= threshold)


def unlabelled_targets(steps: DataFrame, features) -> DataFrame:
    """Samples of an unlabelled split: future values are 0, and ``has_target`` says that they are none."""
    future = F.col("part") == "trg"
    return steps.withColumns({f: F.when(future, F.lit(0.0)).otherwise(F.col(f)) for f in features} | {"has_target": F.lit(False)})


def included(tracks: DataFrame, key: str, recordings: dict) -> DataFrame:
    """Rows of the recordings that a configuration says to include; those that it does not name are left out."""
    wanted = [k for k, c in recordings.items() if c.get("include")]
    kind = tracks.schema[key].dataType.simpleString()
    table = tracks.sparkSession.createDataFrame([(k,) for k in sorted(wanted)], f"{key} {kind}")
    return tracks.join(F.broadcast(table), key, "left_semi")  # as long as the configuration
