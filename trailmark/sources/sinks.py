"""Writers: samples by split, staged scenes, metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread


def write_samples(samples: DataFrame, path: str, overwrite: bool = False, resume: bool = False) -> None:
    """Samples as Parquet, a folder for each split; existing data is an error unless it is overwritten or resumed.

    ``resume`` adds the samples whose ids are not there yet, as after an export that was broken off.
    """
    named = samples.withColumn("sample_id", F.concat_ws("-", "rec_id", "target_id", "start"))
    if resume:
        spark = samples.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            there = spark.read.parquet(path).select("split", "sample_id")
            named = named.join(there, ["split", "sample_id"], "left_anti")
    mode = "append" if resume else "overwrite" if overwrite else "errorifexists"
    named.write.partitionBy("split").mode(mode).parquet(path)


def read_samples(spark, path: str, split: str, small: bool = False) -> DataFrame:
    """A split's samples in the order of their ids, the first hundred only for a small run; an empty split is an error."""
    out = spark.read.parquet(path).where(F.col("split") == split)
    if out.isEmpty():
        raise ValueError(f"no samples in split {split}")
    return out.orderBy("sample_id").limit(100) if small else out


def stage_scenes(tracks: DataFrame, lists: dict[str, list], path: str, scene: str = "scene_name") -> None:
    """Scenes of published lists as CSV, by split and scene: a file for each, written by one task."""
    from ..operators.relations import with_split_lists

    out = with_split_lists(tracks, scene, lists).withColumn("_scene", F.col(scene))
    spread(out, 0.4, "split", "_scene").write.partitionBy("split", "_scene").option("header", True).mode("errorifexists").csv(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.option("header", True).mode("append").csv(path)  # a row for each metric
