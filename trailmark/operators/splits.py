"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Which tenth of a recording is validation and which test, for both test sizes.
VALIDATION, TEST = {10: (8,), 25: (5,)}, {10: (1,), 25: (1, 8)}


def block(frame: Column, n: Column, blocks: int = 10) -> Column:
    """Which of ten nearly equal blocks of 1..n holds a frame: the first n % 10 are one longer; null outside 1..n."""
    size, longer = F.floor(n / blocks), n % blocks
    head = longer * (size + 1)
    inside = F.when(frame <= head, F.floor((frame - 1) / (size + 1))).otherwise(longer + F.floor((frame - head - 1) / F.nullif(size, F.lit(0))))
    return F.when((frame >= 1) & (frame <= n), inside).cast("int")


def split_of(block_no: Column, test_percent: int = 10) -> Column:
    return (
        F.when(block_no.isin(*VALIDATION[test_percent]), "val")
        .when(block_no.isin(*TEST[test_percent]), "test")
        .when(block_no.isNotNull(), "train")
    )


def with_split(tracks: DataFrame, test_percent: int = 10) -> DataFrame:
    """Adds ``split`` by the recording's last frame: the final frame of its last track."""
    last = F.max_by("_final", "track_id").over(W.partitionBy("rec_id"))
    out = tracks.withColumn("_final", F.max("frame").over(W.partitionBy("rec_id", "track_id"))).withColumn("_n", last)
    return out.withColumn("split", split_of(block(F.col("frame"), F.col("_n")), test_percent)).drop("_final", "_n")


def purge(tracks: DataFrame, split: str) -> DataFrame:
    """A split's frames: those of the other splits are removed, frames of no split stay."""
    return tracks.where(F.col("split").isNull() | (F.col("split") == split))


def file_split(name: Column, train_percent: int = 80) -> Column:
    """Train or val by a hash of the file's name."""
    return F.when(F.pmod(F.crc32(name.cast("binary")), F.lit(100)) < train_percent, "train").otherwise("val")
