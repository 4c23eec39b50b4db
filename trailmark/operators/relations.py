"""Joins, set operations, ordering and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def interval_join(ranges: DataFrame, rows: DataFrame, lo: str, hi: str, position: str) -> DataFrame:
    """Rows whose position lies in ``[lo, hi)``: each range is exploded, so that the join is an equality."""
    each = ranges.where(F.col(lo) < F.col(hi)).withColumn(position, F.explode(F.sequence(F.col(lo), F.col(hi) - 1)))
    return each.join(rows, position)


def follow(df: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Many-to-one joins along tokens: (table, column of df so far, key of the table)."""
    for other, left, right in chain:
        df = df.join(other, df[left] == other[right])
    return df


def list_order(rows: DataFrame, scene: str, time: str, token: str, following: str) -> DataFrame:
    """``ordinal`` of rows that are linked by tokens: the order of times, checked against the links."""
    w = W.partitionBy(scene).orderBy(time)
    broken = F.col(following).isNotNull() & ~F.col(following).eqNullSafe(F.lead(token).over(w))
    at = (F.row_number().over(w) - 1).cast("int")
    out = rows.withColumns({"ordinal": at, "_broken": broken})
    return out.withColumn("ordinal", F.when(F.col("_broken"), F.raise_error(F.lit("links disagree with times"))).otherwise(F.col("ordinal"))).drop("_broken")


def union_with_offset(first: DataFrame, second: DataFrame, key: str | None = None) -> DataFrame:
    """Both sets of tracks; the second's ids follow the first's greatest, in the order in which they appear.

    With ``key``, ids are counted within each of its values (recordings), and tracks are ranked there.
    """
    if key is None:
        top = first.agg(F.coalesce(F.max("track_id"), F.lit(0)).alias("_top"))
        ids = second.groupBy("track_id").agg(F.min("frame").alias("_f"))
        ids = ranked(ids, "_f", "track_id", name="_rank").drop("_f").crossJoin(F.broadcast(top))  # one row
        moved = second.join(ids, "track_id")
    else:
        top = first.groupBy(key).agg(F.max("track_id").alias("_top"))
        ids = second.groupBy(key, "track_id").agg(F.min("frame").alias("_f"))
        ids = ids.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy("_f", "track_id")) - 1).drop("_f")
        moved = second.join(ids, [key, "track_id"]).join(top, key, "left").fillna({"_top": 0})
    moved = moved.withColumn("track_id", F.col("_top") + F.col("_rank") + 1).drop("_top", "_rank")
    return first.unionByName(moved, allowMissingColumns=True)


def dense_frame(df: DataFrame, key: str, time: Column) -> DataFrame:
    """``frame`` from 0: the rank of a time among the distinct times of its recording."""
    return df.withColumn("_t", time).withColumn("frame", (F.dense_rank().over(W.partitionBy(key).orderBy("_t")) - 1).cast("int")).drop("_t")


def with_split_lists(df: DataFrame, key: str, lists: dict[str, list]) -> DataFrame:
    """Adds ``split`` by published lists; rows in no list are left out, and a key in two lists counts once for each."""
    rows = [(k, s) for s, keys in lists.items() for k in sorted(set(keys))]
    kind = df.schema[key].dataType.simpleString()
    table = df.sparkSession.createDataFrame(rows, f"{key} {kind}, split string")
    return df.join(F.broadcast(table), key)  # as long as the published lists


def translate_by_median(points: DataFrame, key: str = "map_id") -> DataFrame:
    """Moves each map so that its lower median place is the origin."""
    m = points.groupBy(key).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("_mx"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)").alias("_my"))
    return points.join(m, key).withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")}).drop("_mx", "_my")


def mean_at_median(tracks: DataFrame, key: str = "rec_id") -> DataFrame:
    """The mean place of the agents at a recording's median frame: ``key, f, x, y``."""
    m = tracks.groupBy(key).agg(F.floor(F.median("frame")).cast("int").alias("f"))
    at = tracks.join(m, key).where(F.col("frame") == F.col("f"))
    return at.groupBy(key, "f").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def small_data(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first n rows by a key."""
    return df.orderBy(key).limit(n)


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def ranked(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """``rank`` of rows from 0 in the order of keys, without gathering them: rows are ranked within ranges.

    Rows are written once with the number of their range of the keys; counting the ranges and ranking rows both read
    that table, so they agree whatever is lost and run again.  A row's rank is its place in its range plus the rows
    of the ranges before.  Rows that agree in all keys are ranked in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row per range
    here = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*keys)) - 1)
    return here.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``batch`` numbers of rows in the order of a key."""
    return ranked(df, key, name="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("int"))
