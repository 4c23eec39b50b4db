"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``CELLS`` cells.  Every shard owns ``vnodes`` cells by hash; a key's cell belongs to the
next virtual node clockwise.  Each shard takes its own keys up to its capacity, in ring order; keys
beyond it go on clockwise to the next shard with room.  Capacities add up to the number of rows and
differ by one at most, so counts do too (the law ``rows``), and keys of a shard that is not full stay
where plain consistent hashing puts them, which bounds movement when shards are added.

Only counts by cell (a fixed number) meet in one place; rows are ranked within cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL_BITS = 14
CELLS = 1 << CELL_BITS


def cell_of(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - CELL_BITS)


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """``arc, cell, orders``: virtual nodes by their cell, each with all shards in clockwise order from it."""
    shard, replica = F.floor(F.col("id") / vnodes), F.col("id") % vnodes
    nodes = spark.range(shards * vnodes).select(shard.cast("int").alias("shard"), cell_of(F.lit("node"), shard, replica).alias("cell"))
    nodes = nodes.groupBy("cell").agg(F.min("shard").alias("shard"))
    whole = nodes.agg(F.array_sort(F.collect_list(F.struct("cell", "shard"))).alias("ring"))
    n = F.size("ring")
    arc = whole.select("ring", F.posexplode("ring").alias("arc", "node"))
    turned = F.concat(F.slice("ring", F.col("arc") + 1, n), F.slice("ring", F.lit(1), F.col("arc")))
    return arc.select("arc", F.col("node.cell").alias("cell"), F.array_distinct(F.transform(turned, lambda x: x["shard"])).alias("orders"))


def _arcs_of_cells(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """``cell, arc``: for every cell the virtual node at or after it, round the ring."""
    spots = nodes.agg(F.array_sort(F.collect_list("cell")).alias("spots"))
    width = F.col("spots")
    lead = spots.select(
        F.explode(
            F.transform(width, lambda to, i: F.struct(i.alias("arc"), F.when(i > 0, F.get(width, i - 1) + 1).otherwise(F.lit(0)).alias("a"), to.alias("b")))
        ).alias("r"),
    )
    tail = spots.select(F.struct(F.lit(0).alias("arc"), F.element_at("spots", -1) + 1, F.lit(CELLS - 1)).alias("r"))
    runs = lead.select("r.arc", F.col("r.a").cast("long").alias("a"), F.col("r.b").cast("long").alias("b"))
    last = tail.select(F.col("r.arc").alias("arc"), F.col("r.col2").cast("long").alias("a"), F.col("r.col3").cast("long").alias("b"))
    both = runs.unionAll(last).where(F.col("a") <= F.col("b"))
    return both.select("arc", F.explode(F.sequence("a", "b")).alias("cell"))


def plan(counts: DataFrame, shards: int, vnodes: int) -> tuple[DataFrame, DataFrame]:
    """From ``cell, n``: where each cell's ranks start in its arc, and which shard takes which ranks of an arc.

    All tables here have at most ``CELLS`` or ``shards * vnodes + shards ** 2`` rows, whatever the input.
    """
    spark = counts.sparkSession
    nodes = ring(spark, shards, vnodes)
    arcs = _arcs_of_cells(spark, nodes)
    cells = arcs.join(F.broadcast(counts), "cell")
    before = F.sum("n").over(W.partitionBy("arc").orderBy("cell")) - F.col("n")
    cells = cells.select("cell", "arc", "n", before.cast("long").alias("base"))
    loads = cells.groupBy("arc").agg(F.sum("n").alias("n")).join(F.broadcast(nodes.select("arc", "orders")), "arc")
    total = loads.agg(F.sum("n").alias("total"))
    loads = loads.crossJoin(F.broadcast(total))  # one row: the number of rows of the input
    cap = lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0)
    own = F.get("orders", F.lit(0))
    held = F.sum("n").over(W.partitionBy("own").orderBy("arc")) - F.col("n")
    first = loads.withColumn("own", own).withColumn("held", held.cast("long"))
    first = first.withColumn("took", F.greatest(F.lit(0), F.least(F.col("n"), cap(F.col("own")) - F.col("held"))).cast("long"))
    settled = first.where("took > 0").select("arc", F.col("own").alias("shard"), F.lit(0).cast("long").alias("lo"), F.col("took").alias("hi"), F.col("held").alias("slot"))
    over = F.when(F.col("n") > F.col("took"), F.struct("arc", "orders", F.col("took").alias("lo"), F.col("n").alias("hi")))
    state = first.withColumn("used", F.sum("took").over(W.partitionBy("own"))).agg(
        F.array_sort(F.collect_list(over)).alias("over"),
        F.first("total").alias("total"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("own", "used")))).alias("used"),
    )
    return cells, settled.unionByName(_overflow(state, shards))


def _overflow(state: DataFrame, shards: int) -> DataFrame:
    """Walk the overflowing arcs in ring order; each goes clockwise, filling what room the shards have left."""
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    room = F.transform(
        every,
        lambda s: (F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0) - F.coalesce(F.element_at("used", s), F.lit(0))).cast("long"),
    )
    full = F.transform(every, lambda s: F.coalesce(F.element_at("used", s), F.lit(0)).cast("long"))
    out = F.array().cast("array<struct<arc:int,shard:int,lo:bigint,hi:bigint,slot:bigint>>")

    def offer(acc: Column, part: Column) -> Column:
        def one(st: Column, s: Column) -> Column:
            take = F.least(F.get(st["room"], s), st["hi"] - st["lo"])
            moved = F.transform(st["room"], lambda r, i: F.when(i == s, r - take).otherwise(r))
            slots = F.transform(st["full"], lambda r, i: F.when(i == s, r + take).otherwise(r))
            piece = F.array(F.struct(part["arc"].cast("int").alias("arc"), s.alias("shard"), st["lo"].alias("lo"), (st["lo"] + take).alias("hi"), F.get(st["full"], s).alias("slot")))
            changed = F.struct(moved.alias("room"), slots.alias("full"), (st["lo"] + take).alias("lo"), st["hi"].alias("hi"), F.concat(st["out"], piece).alias("out"))
            return F.when(take > 0, changed).otherwise(st)

        start = F.struct(acc["room"].alias("room"), acc["full"].alias("full"), part["lo"].alias("lo"), part["hi"].alias("hi"), acc["out"].alias("out"))
        return F.aggregate(part["orders"], start, one, lambda st: F.struct(st["room"].alias("room"), st["full"].alias("full"), st["out"].alias("out")))

    folded = state.select(F.aggregate("over", F.struct(room.alias("room"), full.alias("full"), out.alias("out")), offer, lambda st: st["out"]).alias("out"))
    return folded.select(F.explode("out").alias("o")).select("o.arc", "o.shard", "o.lo", "o.hi", "o.slot")


def shard(df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 24, vnodes: int = 64) -> DataFrame:
    """Every row's shard and its place there.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  A null text has size 8 and the
    checksum of no bytes; a null key has a place on the ring like any other.  Rows equal in key, size and
    checksum are counted before they move and dealt out after, so a key that a third of the rows share
    makes no hot task; such rows fill slots side by side.  An empty table gives no rows.
    """
    base = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    items = base.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("k"))
    items = items.withColumn("spot", F.xxhash64("doc_id")).withColumn("cell", cell_of(F.col("doc_id")))
    counts = items.groupBy("cell").agg(F.sum("k").alias("n"))
    cells, pieces = plan(counts, shards, vnodes)
    rank = F.sum("k").over(W.partitionBy("cell").orderBy("spot", "doc_id", "size", "text_crc32")) - F.col("k")
    ranked = items.withColumn("rank", rank.cast("long")).join(F.broadcast(cells.select("cell", "arc", "base")), "cell")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    here = pieces.withColumnRenamed("arc", "_arc")
    dealt = ranked.join(F.broadcast(here), (F.col("arc") == F.col("_arc")) & (F.col("rank") < F.col("hi")) & (F.col("rank") + F.col("k") > F.col("lo")))
    a, b = F.greatest("rank", "lo"), F.least(F.col("rank") + F.col("k"), F.col("hi")) - 1
    return dealt.withColumn("at", F.explode(F.sequence(a, b))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("at") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
