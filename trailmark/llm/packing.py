"""Packing by column generation for the cutting-stock problem.

A document is cut into full sequences, a half sequence where more than that is left, and one rest.  The histogram of the pieces' lengths, in classes of
``UNIT`` tokens, is a cutting-stock problem: cover the demand of every class with as few sequences as
possible.  Its linear program is solved by the revised simplex method; a knapsack by dynamic programming
over the capacity finds the pattern of least reduced cost.  Patterns are used as often as their rounded
amounts say, within the demand; what demand is left is packed first-fit decreasing.  Each class's pieces, ranked, then
take the places of their class in the patterns.

The program sees ``capacity / UNIT`` numbers whatever the input.  Ids never move: a piece carries its checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from ._encode import encoded, encoder
from ._shared import written

CAPACITY, UNIT = 2048, 8
#: Rows that are ranked together, about.
CELL_ROWS = 2_000


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the pattern of most value within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = int(np.searchsorted(sizes, c, "right"))
        if n:
            total = best[c - sizes[:n]] + values[:n]
            i = int(np.argmax(total))
            if total[i] > best[c] + 1e-12:
                best[c], pick[c] = total[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, gap: float = 5e-4, most_steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns) and their amounts: a feasible point within ``gap`` of the optimum.

    The optimum is at least the duals' worth of the demand over the value of the best pattern (Farley).
    """
    m = len(sizes)
    fill = capacity // sizes
    columns = np.diag(fill).astype(float)
    inverse = np.diag(1.0 / fill)
    amount = demand / fill
    for _ in range(most_steps):
        dual = inverse.sum(0)  # each pattern costs one sequence
        value, pattern = price(np.maximum(dual, 0), sizes, capacity)
        if value <= 1 + 1e-6 or amount.sum() <= (1 + gap) * (np.maximum(dual, 0) @ demand) / value:
            break
        way = inverse @ pattern
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, way, 1), np.inf)
        r = int(np.argmin(ratio))
        inverse[r] /= way[r]
        amount[r] = ratio[r]
        others = np.arange(m) != r
        amount[others] = np.maximum(amount[others] - way[others] * amount[r], 0)
        inverse[others] -= np.outer(way[others], inverse[r])
        columns[:, r] = pattern
    return columns.astype(np.int64), amount


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> copies) and how often each is used, which hold the demand exactly or with places left."""
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0), np.int64)
    left = np.array([demand[k] for k in sizes.tolist()], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    if not len(sizes):
        return out
    columns, amount = solve(sizes, left.astype(float), capacity)
    for p in np.argsort(-amount, kind="stable").tolist():
        pattern = columns[:, p]
        used = pattern > 0
        times = min(int(np.floor(amount[p] + 0.5)), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times:
            out.append(({int(s): int(c) for s, c in zip(sizes[used], pattern[used], strict=True)}, times))
            left -= pattern * times
    bins: list[list] = [[] for _ in range(capacity + 1)]  # by room left: patterns under way
    for s, n in sorted(zip(sizes.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            room = next((c for c in range(s, capacity + 1) if bins[c]), 0)  # best fit
            held = bins[room].pop() if room else {}
            held[s] = held.get(s, 0) + 1
            bins[(room or capacity) - s].append(held)
    return out + [(held, 1) for row in bins for held in row]


def _segments(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``class, lo, hi, copies, first sequence, first place``: which ranks of a class go where."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        place = 0
        for s in sorted(pattern, reverse=True):
            lo = taken.get(s, 0)
            taken[s] = lo + pattern[s] * times
            rows.append((s, lo, taken[s], pattern[s], sequence, place))
            place += pattern[s]
        sequence += times
    return rows


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: every document cut into full sequences, a half and a rest."""

    def run(batches):
        for part, ids, edge in encoded(batches, encoder(tokenizer, False)):
            flat = np.insert(ids.astype("<u4"), edge[1:], end_id)
            begin = edge[:-1] + np.arange(part.num_rows)
            total = np.diff(edge) + 1
            full, rest = total // capacity, total % capacity
            n = full + (rest > 0) + (rest > capacity // 2)
            doc = np.repeat(np.arange(part.num_rows), n)
            nth = X.expand(np.zeros(len(n), np.int64), n)
            start = np.minimum(nth, full[doc]) * capacity + (nth > full[doc]) * (capacity // 2)
            length = np.append(start[1:], 0)
            last = np.cumsum(n) - 1
            length[last] = total
            length -= start
            at = begin[doc] + start
            crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, unit: int = UNIT, **names) -> DataFrame:
    """Where each piece of each document goes.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  A null text is empty and
    has the end id alone.  Pieces alike in all columns (of repeated rows) are counted before they move and
    dealt out after.  Sequence ids are 0, 1, 2, ... without gaps; an empty table gives no rows.  ``unit``
    must divide ``capacity``.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, capacity=capacity, **names)
    same = cut.groupBy("doc_id", "start", "length", "ids_crc32", "doc_tokens").agg(F.count("*").alias("k"))
    same = same.withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    same = written(same, "pieces")
    # each class has cells by its rows, so their number grows with the pieces
    counted = same.groupBy("size").agg(F.sum("k").alias("n"), F.count("*").alias("rows")).collect()  # capacity / unit rows
    demand = {r["size"]: r["n"] for r in counted}
    many = F.create_map(*(F.lit(int(x)) for r in counted for x in (r["size"], -(-r["rows"] // CELL_ROWS)))) if counted else F.create_map(F.lit(1), F.lit(1))
    hashed = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(many, F.col("size")))
    same = same.withColumn("cell", hashed.cast("int"))
    cells = same.groupBy("size", "cell").agg(F.sum("k").alias("n"))
    cells = cells.withColumn("base", (F.sum("n").over(W.partitionBy("size").orderBy("cell")) - F.col("n")).cast("long"))
    rows = _segments(plan(demand, capacity // unit))
    where = spark.createDataFrame(rows, "_size int, lo long, hi long, copies int, sequence long, place long")
    rank = F.sum("k").over(W.partitionBy("size", "cell").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")) - F.col("k")
    ranked = same.withColumn("rank", rank.cast("long")).join(cells.select("size", "cell", "base"), ["size", "cell"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    dealt = ranked.join(F.broadcast(where), (F.col("size") == F.col("_size")) & (F.col("rank") < F.col("hi")) & (F.col("rank") + F.col("k") > F.col("lo")))
    a, b = F.greatest("rank", "lo"), F.least(F.col("rank") + F.col("k"), F.col("hi")) - 1
    dealt = dealt.withColumn("at", F.explode(F.sequence(a, b))).withColumn("at", F.col("at") - F.col("lo"))
    dealt = dealt.withColumn("sequence_id", F.col("sequence") + F.floor(F.col("at") / F.col("copies")))
    dealt = dealt.withColumn("place", F.col("place") + F.col("at") % F.col("copies"))
    inside = W.partitionBy("sequence_id").orderBy("place")  # at most ``capacity`` rows each
    return dealt.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(inside) - F.col("length")).cast("long").alias("offset"),
    )
