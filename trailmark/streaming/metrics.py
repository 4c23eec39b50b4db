"""Running metrics over a stream of per-step errors.

The batch metrics are sums and counts, so a stream keeps those: each batch of steps is summed up by agent and mode, and
what it comes to is a folder of files of its own.  Reading adds the batches up.  Neither the driver nor a state store
holds a row for each agent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import AGENT

STEPS = "scenario_id long, agent_id long, mode int, t int, d double"


def step_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Valid steps' errors as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_errors(steps: DataFrame) -> DataFrame:
    """``ade, fde`` of every agent and mode so far: state of one row for each, whatever the number of steps."""
    return steps.groupBy(*AGENT, "mode").agg(F.avg("d").alias("ade"), F.max_by("d", "t").alias("fde"))


def run_to_folder(steps: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is: the sums of each batch, as Parquet below ``path``.  A batch that is run again replaces its files."""

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*AGENT, "mode").agg(F.sum("d").alias("s"), F.count("d").alias("n"), F.max(F.struct("t", "d")).alias("last"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    steps.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def errors_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``ade, fde`` of every agent and mode, from the batches that run_to_folder() has written."""
    schema = "scenario_id long, agent_id long, mode int, s double, n long, last struct<t:int,d:double>, batch int"
    whole = spark.read.schema(schema).parquet(path).groupBy(*AGENT, "mode").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("last").alias("last"))
    return whole.select(*AGENT, "mode", F.try_divide("s", "n").alias("ade"), F.col("last.d").alias("fde"))
