"""Session settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as keyword ``spark__sql__x="1"``."""
    builder = SparkSession.builder.master(master).appName("trailmark")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of ``spark.checkpoint.dir``.

    Where that is unset and executors run in the driver's process (tests), a temporary folder of this session; on a
    cluster it must be set, for files in a machine's own folder would be lost without notice.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("trailmark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("trailmark.shared.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pieces(df: DataFrame, mb: float) -> int:
    """How many pieces have ``mb`` each of the files that df is read from (rows made in the driver count as nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return -(-sum(n for n in sizes if n < 1 << 50) // int(mb * 1_000_000))


def spread(df: DataFrame, mb: float, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys into pieces of ``mb`` of the files that they come from, so that a task's memory does not grow with the table.

    Merging of shuffled partitions goes by their compressed bytes, which say little about what a task makes of them.
    Where there are no more pieces than tasks run at once, the session's settings say how many partitions there are.
    """
    n = pieces(df, mb)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: its lineage ends here."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
