"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._shared import dropped, written


def dealt_anew(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, of which the planner no longer knows how they are dealt by a key (a long).

    Only a join of two exchanges of its own can divide a key that many rows of the other side share.
    """
    return rows.withColumn(key, F.bitwise_not(F.bitwise_not(key)))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node of the node's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in an edge table ``a, b``: root is the least node of its component.

    Nodes that are roots have no row.  Loops, repeated edges and an empty table do no harm.  Each turn is
    written to the shared folder, so nothing of earlier turns is computed again when executors are lost;
    the number of turns grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    at, now = _observed(edges.select("a", "b").where(F.col("a") != F.col("b")), "edges")
    while now[0]:
        before, old = now, at
        at, now = _observed(_small(_large(at)).distinct(), "stars")
        dropped(spark, old)
        if now == before:
            break
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _observed(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Edges, written, and their number with two sums of hashes, by which a turn that changes nothing is known."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x"), F.sum(F.xxhash64("b", "a") % 998_244_353).alias("y")
    table = written(edges.observe(seen, *sums), name)
    found = seen.get
    return table, (found["n"], found["x"], found["y"])
