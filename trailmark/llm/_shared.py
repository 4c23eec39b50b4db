"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group of a table in the shared folder, which its writer holds in memory.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a folder of this session.

    On a cluster it must be set: files in a machine's own folder would be lost without notice.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("trailmark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("trailmark.shared.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: its lineage ends here."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files below a written() table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken, name: str) -> str:
    """A column name that is not taken, in any case of letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def broadcast_value(spark: SparkSession, value):
    """A broadcast of a value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)
