"""Jaccard join of word n-gram sets by vertical partitioning, and the components of its links.

The global order of n-grams is that of their hashes; it is cut into fragments, and each set into the
segments that fall in them.  Two sets that reach the threshold differ in at most k n-grams, k following
from their sizes, so of more than k fragments one at least is the same in both.  Sets meet where a
segment is equal (the number of fragments depends on the class of size; a set is also cut as the next class is, if
a partner can be there).  Segments of few n-grams would bring strangers together, the more the larger the table, until
chance ties most of it into one cluster: sets have a few more fragments than needed, and of their segments, in one order for all
sets, only the first k + 1 count.  Those with many n-grams come first; n-grams that many documents share (passages, licence
lines) don't add to that.

Sets that meet, directly or through others, form a cluster.  Clusters are first screened by sketches: the
numbers of n-grams in cells of the order bound the difference of two sets from below, so
pairs that cannot reach the threshold no longer hold a cluster together.  In the clusters that remain the
overlap of pairs is counted fragment by fragment (a product of incidence matrices for each fragment of the order) and summed
per pair, and a spanning forest of the pairs that reach the threshold is kept: components need no
more, so copies are never expanded into pairs.

Clusters of more than ``BLOCK`` sets are cut, ordered by size, into blocks, both times, and pairs of blocks meet
where sizes can match.  In clusters of more than ``FEW`` blocks each is first worked on by itself, then one set of
every component found so far against the others, and last what is still apart from its cluster's largest
component against the whole cluster.  So a large cluster whose sets are linked costs as much as its size, and its square is paid only
for sets that are not.  Blocks are cut within ranges of the sorted rows: no task holds a cluster.

Equal sets are one node from the start.  A node is a 64-bit hash; sets are told apart by a second, independent one,
and nodes that two sets share are replaced by another hash for both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import _text as X
from ._shared import broadcast_value, dropped, free_name, written
from .components import components, dealt_anew

BLOCK, LEAST = 512, 1024
#: Clusters of at most so many blocks have all pairs of them worked on at once.
FEW = 8
#: A sketch has two to the power of at least and at most so many cells; sets have two to four n-grams a cell.
CELL_BITS = (5, 13)
#: Text handled at once when segments are dealt out.
DEAL_BYTES = 4 << 20
#: Text whose n-grams are made at once.
TEXT_BYTES = 2 << 20
#: How many documents make an n-gram a common one, and bits of the map of those.
COMMON, MARK_BITS = 64, 26
#: N-grams that a task counts at once, about.
COUNTED = 1 << 22
#: Columns of an incidence matrix worked on at once: one vertical fragment in counting.
WIDTH = 4096


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, and where each document's begin."""
    words = X.scan(data, offsets, X.NONSPACE)
    count = np.diff(words.first)
    g = X.grams(words.hash, k)
    take = np.maximum(count - k + 1, 0)
    short = (count > 0) & (count < k)
    size = take + short
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    out = np.empty(first[-1], np.uint64)
    out[X.expand(first[:-1], take)] = g[X.expand(words.first[:-1], take)]
    for i in np.flatnonzero(short).tolist():  # fewer than k words: the sequence as a whole
        out[first[i]] = X.grams(words.hash[words.first[i] : words.first[i + 1]], int(count[i]), 100 + int(count[i]))[0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[:-1][size > 0]] = True
    edge = np.zeros(len(out) + 1, np.int64)
    np.cumsum(new, out=edge[1:])
    return out[new], edge[first]


def _identity(grams: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set; other salts give independent ones."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(X.mix(grams ^ np.uint64(salt)), out=total[1:])
    return X.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def nodes(grams: np.ndarray, first: np.ndarray, twins: np.ndarray | None = None) -> np.ndarray:
    """The identity of each set; ``twins`` are sorted hashes that unlike sets share, whose sets get another."""
    node = _identity(grams, first, 0x5851F42D4C957F2D)
    if twins is not None and len(twins):
        shared = X.member(node, twins) >= 0
        if shared.any():
            node[shared] = X.mix((checks(grams, first) ^ node).view(np.uint64)).view(np.int64)[shared]
    return node


def checks(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A second hash of each set, by which sets of one node are told apart."""
    return _identity(grams, first, 0x2545F4914F6CDD1D)


@lru_cache(maxsize=4096)
def scheme(size_class: int, num: int, den: int) -> int:
    """The number of fragments of a class of sizes: with those that are likely to be short, more than the greatest difference."""
    lo, hi = _bounds(size_class, num, den)
    k = (den - num) * 2 * hi // (den + num)
    if k == 0:
        return 0
    per = lo / (k + 1)
    least = 3 if per >= 7 else 2 if per >= 5 else 1
    spare = 0
    for _ in range(8):
        n = k + 1 + spare
        mean = lo / n
        p = sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(least))
        want = math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))
        if want <= spare:
            break
        spare = min(want, k + 8)
    return k + 1 + spare


@lru_cache(maxsize=4096)
def _bounds(size_class: int, num: int, den: int) -> tuple[int, int]:
    step = (den / num) ** 2
    return math.ceil(step**size_class), math.ceil(step ** (size_class + 1)) - 1


def _class_of(n: int, num: int, den: int) -> int:
    c = max(0, int(math.log(n) / math.log(den / num) / 2) - 1)
    while _bounds(c, num, den)[1] < n:
        c += 1
    return c


def _cut(grams: np.ndarray, owner: np.ndarray, table: np.ndarray, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signature, set, commonness`` of the segments of sorted n-grams; ``table`` has each set's class and parts."""
    c, parts = table[owner, 0], table[owner, 1]
    piece = ((grams >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(grams), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(grams)))
    rare = count if common is None else np.add.reduceat((~_marked(grams, common)).astype(np.int64), at)
    total = np.add.reduceat(X.mix(grams ^ np.uint64(0xA0761D6478BD642F)), at)
    return X.mix(total ^ _tag(c[at], piece[at])), owner[at], 15 - 4 * np.minimum(rare, 3) - np.minimum(count, 3)


def _tag(size_class, piece: np.ndarray) -> np.ndarray:
    return X.mix((np.asarray(size_class).astype(np.uint64) << np.uint64(40)) ^ (piece + np.uint64(1)))


def _empty(rows: np.ndarray, need: np.ndarray, table: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures of the first empty segments of some sets."""
    for i, n in zip(rows.tolist(), need.tolist(), strict=True):
        g = grams[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
        have = np.unique(((g >> np.uint64(32)) * np.uint64(table[i, 1])) >> np.uint64(32))
        gone = np.setdiff1d(np.arange(table[i, 1], dtype=np.uint64), have)
        first = np.sort(X.mix(_tag(table[i, 0], gone)))[:n]
        yield first, np.full(len(first), i)


def _most(n: int, size_class: int, num: int, den: int) -> int:
    """In how many n-grams at most a set of n differs from one that reaches the threshold and is cut as this class is."""
    return (den - num) * (n + min(n * den // num, _bounds(size_class, num, den)[1])) // (den + num)


def segments(grams: np.ndarray, first: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``signature, set``: of every set the segments by which others can meet it.

    ``common`` is a bitmap of n-grams that many documents have.  All segments have one order, which depends on nothing
    but themselves: those with most n-grams that are not common come first, empty ones last.  Two sets that differ in at
    most k n-grams have the first of their equal segments among the first k + 1 of each, whatever n-grams the bitmap marks.
    """
    size = np.diff(first)
    lookup = {}
    for n in np.unique(size[size > 0]).tolist():
        c = _class_of(n, num, den)
        own = [c]
        if n * den // num >= _bounds(c + 1, num, den)[0]:
            own.append(c + 1)
        lookup[n] = own
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for turn in (0, 1):
        plans = {n: (cs[turn], scheme(cs[turn], num, den), _most(n, cs[turn], num, den) + 1) for n, cs in lookup.items() if len(cs) > turn}
        plans = {n: p for n, p in plans.items() if p[1]}
        if not plans:
            continue
        by_size = np.zeros((int(size.max()) + 1, 3), np.int64)
        for n, p in plans.items():
            by_size[n] = p
        table = by_size[size]
        rows = np.flatnonzero(table[:, 1] > 0)
        which = np.repeat(rows, size[rows])
        g = grams[X.expand(first[rows], size[rows])]
        signature, owner, commonness = _cut(g, which, table, common)
        held = np.bincount(owner, minlength=len(size))
        order = np.lexsort(((signature >> np.uint64(4)) | (commonness.astype(np.uint64) << np.uint64(60)), owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        order = order[place < table[owner, 2]]  # owners rise, so they stand as before
        out.append((signature[order], owner[order]))
        need = table[:, 2] - held
        few = np.flatnonzero((table[:, 1] > 0) & (need > 0))
        out += _empty(few, need[few], table, g, which)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out])


def _marked(grams: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = grams >> np.uint64(64 - MARK_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def common_grams(docs: DataFrame, light: DataFrame, k: int) -> np.ndarray:
    """A bitmap of the n-grams that at least ``COMMON`` documents have: a hint, which changes no result.

    Every n-gram of every document is counted, by 32 bits of its hash beside those that choose its part; parts grow in
    number with the table.  A part is a stretch of the bitmap, which has a fixed size; an n-gram that shares a bit with a
    common one counts as common.
    """
    total = light.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    level = min(16, max(4, math.ceil(math.log2(max(total / COUNTED, 1)))))

    def deal(batches):
        X.only("ngram_join")
        for batch in batches:
            for whole in X.slices(batch, "text", DEAL_BYTES):
                found = [sets(*X.utf8(part.column("text")), k)[0] >> np.uint64(32 - level) for part in X.slices(whole, "text", TEXT_BYTES)]
                grams = np.sort(np.concatenate(found))
                grams = grams[np.append(np.ones(min(COMMON, len(grams)), bool), grams[COMMON:] != grams[:-COMMON])]  # more of one add nothing
                edge = np.searchsorted(grams >> np.uint64(32), np.arange((1 << level) + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edge))
                blobs = [grams[edge[i] : edge[i + 1]].astype(np.uint32).tobytes() for i in full.tolist()]
                yield pa.record_batch([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["part", "grams"])

    def add(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(blob, np.uint32))
        for part, blobs in held.items():
            grams = np.sort(np.concatenate(blobs))
            blobs.clear()
            often = grams[COMMON - 1 :][grams[COMMON - 1 :] == grams[: max(len(grams) - COMMON + 1, 0)]]  # at the end of a run of so many
            flags = np.zeros(1 << (MARK_BITS - level), bool)
            flags[often >> np.uint32(32 + level - MARK_BITS)] = True
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    dealt = docs.select("text").mapInArrow(deal, "part int, grams binary").repartition(1 << level, "part")
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    width = len(out) >> level
    for part, bits in dealt.mapInArrow(add, "part int, bits binary").collect():  # the bitmap's size in all
        out[part * width : (part + 1) * width] = np.frombuffer(bits, np.uint8)
    return out


def sketches(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many n-grams of each set lie in each cell; large sets have more cells, always a power of two.

    A set with a cell of more than 255 has an empty sketch, which bounds nothing.
    """
    size = np.diff(first)
    out = [b""] * len(size)
    levels = np.clip(np.ceil(np.log2(np.maximum(size, 1) / 4)), *CELL_BITS).astype(np.int64)
    for level in np.unique(levels[size > 0]).tolist():
        rows = np.flatnonzero((levels == level) & (size > 0))
        for some in np.array_split(rows, -(-(len(rows) << level) >> 20)):
            cell = ((grams[X.expand(first[some], size[some])] >> np.uint64(8)) & np.uint64((1 << level) - 1)).astype(np.int64)
            count = np.bincount((np.repeat(np.arange(len(some)), size[some]) << level) + cell, minlength=len(some) << level).reshape(len(some), -1)
            for i, row, most in zip(some.tolist(), count.astype(np.uint8), count.max(axis=1).tolist(), strict=True):
                out[i] = row.tobytes() if most <= 255 else b""
    return out


def _light(k: int):
    def run(batches):
        X.only("ngram_join")
        for batch in batches:
            for part in X.slices(batch, "text", TEXT_BYTES):
                grams, first = sets(*X.utf8(part.column("text")), k)
                n = np.diff(first)
                node, check = (pa.array(f(grams, first), pa.int64(), mask=n == 0) for f in (nodes, checks))
                blobs = sketches(grams, first)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), node, check, pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "node", "check", "sketch"])

    return run


def _told_apart(light: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows with nodes that no two unlike sets share, and the hashes that were shared (a few at most, whatever the input)."""
    found = light.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b")
    twins = sorted(r[0] for r in found.select("node").collect())
    if not twins:
        return light.drop("check"), np.zeros(0, np.int64)
    shared = broadcast_value(light.sparkSession, np.array(twins, np.int64))

    def run(batches):
        for batch in batches:
            node = batch.column("node").fill_null(0).to_numpy(zero_copy_only=False).copy()
            check = batch.column("check").fill_null(0).to_numpy(zero_copy_only=False)
            empty = np.asarray(batch.column("node").is_null())
            hit = (X.member(node, shared.value) >= 0) & ~empty
            node[hit] = X.mix((check ^ node).view(np.uint64)).view(np.int64)[hit]
            names = [c for c in batch.schema.names if c != "check"]
            yield pa.record_batch([pa.array(node, pa.int64(), mask=empty) if c == "node" else batch.column(c) for c in names], names)

    kept = light.drop("check").schema
    return light.mapInArrow(run, kept), np.array(twins, np.int64)


def _dealer(k: int, num: int, den: int, parts: int, common, twins: np.ndarray):
    """Packed segments, one row for each part of some texts; equal sets among those count once.

    A row has the 48 low bits of its signatures (the part has the high ones) and, for each, the place of its
    set in a list of sets.  Signatures that are equal by chance only add candidates.
    """

    def run(batches):
        X.only("ngram_join")
        for batch in batches:
            for whole in X.slices(batch, "text", DEAL_BYTES):
                sig, node = [], []
                for part in X.slices(whole, "text", TEXT_BYTES):
                    grams, first = sets(*X.utf8(part.column("text")), k)
                    s, i = segments(grams, first, num, den, common.value)
                    sig.append(s)
                    node.append(nodes(grams, first, twins)[i])
                yield _packed(np.concatenate(sig), np.concatenate(node), parts)

    return run


def _packed(s: np.ndarray, v: np.ndarray, parts: int) -> pa.RecordBatch:
    order = np.lexsort((v, s))
    s, v = s[order], v[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    s, v = s[new], v[new]
    p = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with s
    edge = np.searchsorted(p, np.arange(parts + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edge))
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint16)
    cols: list[list[bytes]] = [[], [], [], []]
    for i in full.tolist():
        a, b = edge[i], edge[i + 1]
        held, place = np.unique(v[a:b], return_inverse=True)
        place = place.astype(np.uint16 if len(held) <= 1 << 16 else np.uint32)
        for col, x in zip(cols, (low[a:b], high[a:b], place, held), strict=True):
            col.append(x.tobytes())
    return pa.record_batch([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["part", "low", "high", "place", "held"])


def _meet(batches):
    """Star edges of the sets with equal segments: the least of them, and each other."""
    sig, node = [], []
    for batch in batches:
        for part, low, high, place, held in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "place", "held")), strict=True):
            low = np.frombuffer(low, np.uint32)
            sig.append((np.uint64(part) << np.uint64(48)) | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)) | low)
            held = np.frombuffer(held, np.int64)
            node.append(held[np.frombuffer(place, np.uint16 if len(held) <= 1 << 16 else np.uint32)])
    if not sig:
        return
    s, v = np.concatenate(sig), np.concatenate(node)
    sig.clear()
    node.clear()
    order = np.argsort(s, kind="stable")
    s, v = s[order], v[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(s)))
    least = np.repeat(np.minimum.reduceat(v, at), size)
    pair = np.unique(np.column_stack([least, v])[least != v], axis=0)
    for i in range(0, len(pair), 100_000):
        yield pa.record_batch([pa.array(pair[i : i + 100_000, 0]), pa.array(pair[i : i + 100_000, 1])], ["a", "b"])


def _setter(k: int, twins: np.ndarray):
    """The n-grams of each text's set, where the text still has the set that the row was made for."""

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text", TEXT_BYTES):
                grams, first = sets(*X.utf8(part.column("text")), k)
                same = nodes(grams, first, twins) == part.column("node").to_numpy()
                kept = part.filter(pa.array(same)).drop_columns(["text"])
                blobs = [grams[a:b].tobytes() for a, b in zip(first[:-1][same].tolist(), first[1:][same].tolist(), strict=True)]
                yield kept.append_column("value", pa.array(blobs, pa.binary()))

    return run


def overlaps(arrays: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs, counted fragment by fragment of the order and summed."""
    m = len(arrays)
    flat = np.concatenate(arrays)
    who = np.repeat(np.arange(m), [len(a) for a in arrays])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, who = column[shared], who[shared]
    if len(column):
        step = np.ones(len(column), bool)
        step[1:] = column[1:] != column[:-1]
        column = np.cumsum(step) - 1
    total = np.zeros((m, m), np.float32 if len(flat) < 1 << 24 else np.float64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(column, column[at] + WIDTH))
        part = np.zeros((m, column[to - 1] - column[at] + 1), np.float32)
        part[who[at:to], column[at:to] - column[at]] = 1
        total += part @ part.T
        at = to
    return total.astype(np.int64)


def forest(ids: list[int], arrays: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: each set and the first found of its component."""
    both = overlaps(arrays)
    size = np.array([len(a) for a in arrays])
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    todo, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not todo[root]:
            continue
        todo[root] = False
        front = linked[root] & todo
        while front.any():
            todo &= ~front
            out += [(ids[root], ids[i]) for i in np.flatnonzero(front).tolist()]
            front = linked[front].any(axis=0) & todo
    return out


def _folded(rows: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Lengths of sketches, and for each length the sketches of at least that length, folded to it."""
    length = np.array([len(x) for x in rows])
    held = [np.frombuffer(x, np.uint8).astype(np.int16) for x in rows]
    levels = {}
    for n in sorted(set(length.tolist()) - {0}, reverse=True):
        held = [x if len(x) <= n else x.reshape(-1, n).sum(axis=0, dtype=np.int16) for x in held]
        levels[n] = np.zeros((len(rows), n), np.int16)
        for i in np.flatnonzero(length >= n).tolist():
            levels[n][i] = held[i]
    return length, levels


def screen(ids: list[int], rows: list[tuple[int, bytes]], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect all pairs whose sizes and sketches leave the threshold within reach."""
    size = np.array([n for n, _ in rows])
    length, levels = _folded([x for _, x in rows])
    todo, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            at = front.pop()
            rest = np.flatnonzero(todo & (size * den >= size[at] * num) & (size * num <= size[at] * den))
            both = np.minimum(length[rest], length[at])
            near = [rest[both == 0]]
            for n in np.unique(both[both > 0]).tolist():
                some = rest[both == n]
                differ = np.abs(levels[n][some] - levels[n][at]).sum(axis=1, dtype=np.int64)
                near.append(some[differ * (den + num) <= (den - num) * (size[some] + size[at])])
            found = np.concatenate(near)
            todo[found] = False
            out += [(ids[root], ids[i]) for i in found.tolist()]
            front += found.tolist()
    return out


def _by_group(decide):
    """Edges ``cluster, a, b`` of each group; rows come ordered by group, and a group has two blocks at most."""

    def run(batches):
        key, ids, values = None, [], []
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out = []
            columns = (batch.column(x).to_pylist() for x in ("cluster", "i", "j", "node", "n", "value"))
            for c, i, j, node, n, value in zip(*columns, strict=True):
                if key != (c, i, j):
                    out += _edges(decide, key, ids, values)
                    key, ids, values = (c, i, j), [], []
                if not ids or ids[-1] != node:
                    ids.append(node)
                    values.append((n, value))
            yield _pairs(out)
        yield _pairs(_edges(decide, key, ids, values))

    return run


def _edges(decide, key, ids: list[int], values: list) -> list[tuple[int, int, int]]:
    return [(key[0], a, b) for a, b in decide(ids, values)] if len(ids) > 1 else []


def _pairs(edges: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([e[x] for e in edges], pa.int64()) for x in range(3)], ["cluster", "a", "b"])


def _screener(num: int, den: int):
    return lambda ids, rows: screen(ids, rows, num, den)


def _counter(num: int, den: int):
    return lambda ids, rows: forest(ids, [np.frombuffer(blob, np.uint64) for _, blob in rows], num, den)


def _blocked(rows: DataFrame, name: str, kind: Column | int = 0) -> DataFrame:
    """Rows (``cluster, node, n, ..``), written, with ``block``: those of a cluster and kind in the order of size, cut where enough have come.

    A block has at most BLOCK sets, and fewer large ones: as many as have BLOCK * LEAST n-grams, or one.  Rows are
    put into ranges of (cluster, kind, n, node), and each row gets the sum of those before it in its range.  Only the first
    and the last group of a range can go on in another one; what they add there, two numbers for each range at most,
    is broadcast.
    """
    spark = rows.sparkSession
    kind = F.lit(kind) if isinstance(kind, int) else kind
    ranged = rows.withColumn("kind", kind.cast("long")).repartitionByRange("cluster", "kind", "n", "node").sortWithinPartitions("cluster", "kind", "n", "node")

    def place(batches):
        part, key, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            group = np.column_stack([batch.column(c).to_numpy() for c in ("cluster", "kind")])
            weight = np.maximum(batch.column("n").to_numpy(), LEAST)
            if not len(weight):
                continue
            new = np.ones(len(weight), bool)
            new[1:] = (group[1:] != group[:-1]).any(axis=1)
            new[0] = key is None or tuple(group[0].tolist()) != key
            total = 0 if new[0] else total
            before = np.cumsum(weight) - weight
            at = np.flatnonzero(new)
            lead = np.concatenate([[before[0] - total] if not new[0] else [], before[at]])
            spot = before - lead[np.cumsum(new) - (1 if new[0] else 0)]
            key, total = tuple(group[-1].tolist()), int(spot[-1] + weight[-1])
            yield batch.append_column("part", pa.array(np.full(len(weight), part), pa.int32())).append_column("spot", pa.array(spot, pa.int64()))

    fields = [*ranged.schema.fields, StructField("part", IntegerType()), StructField("spot", LongType())]
    table = written(ranged.mapInArrow(place, StructType(fields)), name)
    ends = table.groupBy("cluster", "kind", "part").agg(F.sum(F.greatest(F.col("n"), F.lit(LEAST))).alias("sum"))
    ends = ends.join(ends.groupBy("cluster", "kind").agg(F.count("*").alias("of")).where("of > 1").select("cluster", "kind"), ["cluster", "kind"], "left_semi")
    before: dict[tuple[int, int], int] = {}
    known = []
    for c, k, part, total in sorted(map(tuple, ends.select("cluster", "kind", "part", "sum").collect())):  # two rows for each range at most
        known.append((c, k, part, before.get((c, k), 0)))
        before[c, k] = before.get((c, k), 0) + total
    lead = spark.createDataFrame(known, "cluster long, kind long, part int, lead long")
    placed = table.join(F.broadcast(lead), ["cluster", "kind", "part"], "left")
    block = F.shiftleft(F.col("kind"), 48) + F.floor((F.coalesce("lead", F.lit(0)) + F.col("spot")) / (BLOCK * LEAST))
    return placed.withColumn("block", block.cast("long")).drop("part", "spot", "lead", "kind")


def _spans(blocked: DataFrame) -> DataFrame:
    """``cluster, block, lo, hi`` of blocks: several hundred times fewer than sets where clusters are large."""
    return blocked.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))


def _sides(spans: DataFrame, num: int, den: int, wanted: Column | None = None) -> DataFrame:
    """``cluster, block, i, j``: the pairs of blocks of a cluster in which each works: those whose sizes can match, ``wanted`` pairs only."""
    one = spans.select("cluster", F.col("block").alias("i"), F.col("lo").alias("_a"), F.col("hi").alias("_b"))
    two = spans.select("cluster", F.col("block").alias("j"), F.col("lo").alias("_c"), F.col("hi").alias("_d"))
    can = (F.col("i") <= F.col("j")) & (F.col("_c") * num <= F.col("_b") * den) & (F.col("_a") * num <= F.col("_d") * den)
    pairs = one.join(two, "cluster").where(can if wanted is None else can & wanted).select("cluster", "i", "j")
    return pairs.withColumn("block", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))))


def _decided(work: DataFrame, decide) -> DataFrame:
    """Edges of the groups ``cluster, i, j`` of rows with ``node, n, value``."""
    dealt = work.select("cluster", "i", "j", "node", "n", "value").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return dealt.mapInArrow(_by_group(decide), "cluster long, a long, b long")


def connect(blocked: DataFrame, values: DataFrame, decide, num: int, den: int, temporary: list[DataFrame]) -> DataFrame:
    """``a, b``: edges that connect all that ``decide`` connects within each cluster.

    ``blocked(cluster, node, n, block)`` and ``values(cluster, node, n, block, value)`` have a row for each set.  Tables that are
    written on the way are added to ``temporary``.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        temporary.append(written(df, name))
        return temporary[-1]

    spans = keep(_spans(blocked).withColumn("of", F.count("*").over(W.partitionBy("cluster"))), "spans")  # a row for each block
    sides = keep(_sides(spans.where(F.col("of").between(2, FEW)).drop("of"), num, den), "sides")
    work = values.join(sides, ["cluster", "block"], "left").withColumns({"i": F.coalesce("i", "block"), "j": F.coalesce("j", "block")})
    alone = keep(_decided(work, decide), "alone")
    many = keep(spans.where(F.col("of") > FEW).select("cluster").distinct(), "large")
    if many.isEmpty():
        return alone.select("a", "b")
    own = values.join(many, "cluster", "left_semi").select("node", "value")
    # edges within a block are stars: each set but the first of its component has one, from that first set
    stars = alone.join(many, "cluster", "left_semi").select(F.col("b").alias("node"), F.col("a").alias("hub"))
    members = blocked.select("cluster", "node", "n").join(many, "cluster", "left_semi").join(stars, "node", "left")
    members = keep(members.withColumn("hub", F.coalesce("hub", "node")), "members")
    # one set of each component against the others
    hubs = _blocked(members.where("node = hub").drop("hub"), "hubs")
    temporary.append(hubs)
    second = keep(_decided(hubs.join(_sides(_spans(hubs), num, den), ["cluster", "block"]).join(own, "node"), decide), "between")
    # what is still apart from its cluster's largest component, against the whole cluster, but for pairs of hubs
    roots = components(second.select("a", "b")).withColumnsRenamed({"node": "hub"})
    labelled = members.join(roots, "hub", "left").withColumn("root", F.coalesce("root", "hub"))
    largest = labelled.groupBy("cluster", "root").agg(F.count("*").alias("_n")).groupBy("cluster").agg(F.max_by("root", F.struct("_n", "root")).alias("_most"), F.count("*").alias("_of"))
    apart = labelled.join(largest.where("_of > 1"), "cluster")
    kind = F.when(F.col("node") == F.col("hub"), 2).otherwise(0) + F.when(F.col("root") == F.col("_most"), 0).otherwise(1)
    apart = _blocked(apart.withColumn("kind", kind).select("cluster", "node", "n", "kind"), "apart", F.col("kind"))
    temporary.append(apart)
    both_hubs = (F.shiftright("i", 49) == 1) & (F.shiftright("j", 49) == 1)
    some_rest = (F.shiftright("i", 48).bitwiseAND(1) == 1) | (F.shiftright("j", 48).bitwiseAND(1) == 1)
    sides = _sides(_spans(apart), num, den, some_rest & ~both_hubs)
    third = keep(_decided(apart.join(sides, ["cluster", "block"]).join(own, "node"), decide), "last")
    return alone.select("a", "b").unionByName(second.select("a", "b")).unionByName(third.select("a", "b"))


def _clusters(edges: DataFrame) -> DataFrame:
    roots = components(edges)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "cluster")


def links(docs: DataFrame, light: DataFrame, twins: np.ndarray, *, k: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """``a, b``: edges between nodes that connect what the links connect, and the tables written for them.  docs has doc_id, text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    temporary: list[DataFrame] = []
    common = broadcast_value(spark, common_grams(docs, light, k))
    dealt = docs.select("text").mapInArrow(_dealer(k, num, den, parts, common, twins), "part int, low binary, high binary, place binary, held binary")
    met = dealt.repartition(parts, "part").mapInArrow(_meet, "a long, b long")
    holders = light.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("sketch").alias("value"))
    rough = _blocked(_clusters(met).join(holders, "node"), "rough")
    temporary.append(rough)
    near = connect(rough, rough, _screener(num, den), num, den, temporary)
    fine = _blocked(_clusters(near).join(rough.select("node", "n", "doc_id"), "node"), "fine")
    temporary.append(fine)
    texts = docs.join(fine.hint("merge"), "doc_id").select("cluster", "node", "n", "block", "text")  # grows with the input: never broadcast
    if not light.where(F.col("doc_id").isNull() & F.col("node").isNotNull()).isEmpty():
        # sets that only rows without an id hold are found by the set itself
        bare = docs.where(F.col("doc_id").isNull()).select("text").mapInArrow(_tagger(k, "text", "_node", twins), "text string, _node long")
        bare = bare.where(F.col("_node").isNotNull()).dropDuplicates(["_node"])
        held = fine.where(F.col("doc_id").isNull()).drop("doc_id")
        texts = texts.unionByName(bare.join(held.hint("merge"), F.col("_node") == F.col("node")).select("cluster", "node", "n", "block", "text"))
    grams = written(texts.mapInArrow(_setter(k, twins), "cluster long, node long, n long, block long, value binary"), "grams")
    temporary.append(grams)
    return connect(fine, grams, _counter(num, den), num, den, temporary), temporary


def _membership(base: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n_shingles, node, root, least``: each row's set, its component and the least id there; and the shared hashes."""
    spark = base.sparkSession
    kind = base.schema["doc_id"].dataType.simpleString()
    light = written(base.mapInArrow(_light(k), f"doc_id {kind}, n_shingles long, node long, check long, sketch binary"), "sets")
    light, twins = _told_apart(light)
    edges, temporary = links(base, light, twins, k=k, num=num, den=den)
    roots = components(edges)  # written: the tables before it are not read again
    for table in temporary:
        dropped(spark, table)
    mapped = light.drop("sketch").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = mapped.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    return mapped.join(dealt_anew(least, "root"), "root", "left"), twins


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, for links at a Jaccard similarity of num / den or more.

    component_id is the least doc_id reachable by links, the document's own included.  Null texts and texts
    without words have no n-grams and are linked with nothing; fewer than k words make one n-gram.  Rows
    with equal texts are linked (if they have words); rows with equal ids are rows of their own.  Rows with
    null ids are linked as others are, but are never the least: component_id is null where all ids are.  An
    empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _membership(base, k, num, den)[0].select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without their near duplicates: of each component the row with the least id stays.

    Rows without words (null and empty texts among them) are in no component and stay.  Where rows share that least id,
    one of them stays.  Null ids come after all others: a row with one stays only if no row of its component has an id,
    and then one row does.  Texts of any length are compared whole.  All columns are kept, whatever their names; an
    empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    gone_id, node_id, row_id = (free_name(docs.columns, n) for n in ("_gone", "_node", "_id"))
    members, twins = _membership(base, k, num, den)
    found = written(members, "members")
    gone = found.where(F.col("root").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least"))).select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone.hint("merge"), F.col(doc_id) == F.col(gone_id), "left_anti")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("root").alias("worded")).where("worded > 0 AND (n > 1 OR doc_id IS NULL)")
    if again.isEmpty():
        return kept
    # equal ids with different texts, or none: rows are told apart by their sets, and each component keeps one row
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    chosen = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("one"))
    chosen = chosen.select(F.col("one.doc_id").alias(row_id), F.col("one.node").alias(node_id))
    tagged = docs.mapInArrow(_tagger(k, text, node_id, twins), StructType([*docs.schema.fields, StructField(node_id, LongType())]))
    bare = tagged.where(F.col(node_id).isNull())
    worded = tagged.join(chosen, node_id).where(F.col(doc_id).eqNullSafe(F.col(row_id))).drop(row_id).dropDuplicates([node_id])
    return bare.unionByName(worded).drop(node_id)


def _tagger(k: int, text: str, name: str, twins: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in X.slices(batch, text, TEXT_BYTES):
                grams, first = sets(*X.utf8(part.column(text)), k)
                yield part.append_column(name, pa.array(nodes(grams, first, twins), pa.int64(), mask=np.diff(first) == 0))

    return run
