"""Bounded, deterministic samples of labelled rows for fitting a classifier.

The labels table is reduced to at most ``limit`` rows (lowest hashes first, half of them for each class
where both have enough), which bounds what is broadcast to find their documents.  Rows are held out when
crc32 of the id's decimal text is divisible by ``fold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD = 5
#: At most so many labelled rows of each class are used to fit a classifier.
PER_CLASS = 8_000


def held_out(doc_id: Column, fold: int = FOLD) -> Column:
    """True for rows that no classifier learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str, text: str, per_class: int = PER_CLASS) -> DataFrame:
    """``text, y``: documents with a label that is 0 or 1 and that are not held out; equal ids count once.

    Per class a top-n by hash is taken (a partial top-n on each partition, so at most ``per_class`` rows of
    a partition move), and the chosen ids, at most ``2 * per_class``, are broadcast to the documents.
    """
    base = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y"))
    base = base.where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
    parts = [base.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionAll(parts[1]).groupBy("_id").agg(F.max("y").alias("y"))
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return found.join(F.broadcast(chosen), "_id").select("_id", "text", "y")
