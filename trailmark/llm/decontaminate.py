"""Benchmark decontamination by winnowing.

Every item and document is reduced to fingerprints: the least hash of each window of consecutive
k-grams.  With k-grams of ``kgram`` words and windows of ``window - kgram + 1`` of them, any span of
``window`` words that a document shares with an item leaves a common fingerprint.  Fingerprints are
joined, and each hit is extended to the windows of words that cover it, which are compared whole by two
64-bit hashes, made of two independent hashes of their words.  Items shorter than a window are windows themselves, of their own length;
for those the winnowing window is one k-gram, k being that length.

The items are a query set: they are read in blocks of bounded size, and each block is a broadcast
hash table that all documents pass.  Nothing is shuffled and no document moves.  After ``TABLES`` blocks the
documents' state is written, and the tables are given back, so memory is bounded whatever the items' number.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import broadcast_value, written

WINDOW, KGRAM = 10, 5
#: Bytes of item texts held as one broadcast table (about 5 bytes of table per byte).
BLOCK_BYTES = 4 << 20
#: Tables that are held at a time.
TABLES = 8


def winnow(words: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: the rightmost least k-gram hash of each window of w."""
    g = X.grams(words, k)
    ok = X.inside(first, len(words), k + w - 1)
    n = len(ok)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    chosen = np.zeros(len(g), bool)
    open_ = ok.copy()
    for j in range(w - 1, -1, -1):
        hit = open_ & (g[j : j + n] == least)
        chosen[j : j + n] |= hit
        open_ &= ~hit
    at = np.flatnonzero(chosen)
    return at, g[at]


def _window_table(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Sorted distinct windows (two hashes) with the items that hold them."""
    a, b, item = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((item, b, a))
    a, b, item = a[order], b[order], item[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    return a[start], b[start], np.append(start, len(a)), item


def index_items(rows: list[tuple[int, str]], window: int, kgram: int) -> dict:
    """The hash tables of one block of items."""
    prints, by_length = [], defaultdict(list)
    for number, (_, text) in enumerate(rows):
        data, offsets = X.utf8(pa.array([text], pa.string()))
        found = X.scan(data, offsets, X.ALNUM)
        words = found.hash
        if not len(words):
            continue
        length = min(window, len(words))
        if length == window:
            prints.append(winnow(words, np.array([0, len(words)]), kgram, window - kgram + 1)[1])
        g = X.grams(words, length)
        other = X.second_hashes(data, found, np.arange(len(words)))
        by_length[length].append((g, X.grams(other, length, 7), np.full(len(g), number, np.int64)))
    return {
        "ids": [r[0] for r in rows],
        "prints": np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64),
        "windows": {n: _window_table(v) for n, v in by_length.items()},
    }


def _matches(data: np.ndarray, words: X.Words, length: int, starts: np.ndarray, table):
    """Those of the runs at ``starts`` that are windows of items, and the rows of the table."""
    a, b, _, _ = table
    first = _grams_at(words.hash, starts, length, 0)
    starts = starts[X.member(first, a) >= 0]
    first = _grams_at(words.hash, starts, length, 0)
    used = np.unique((starts[:, None] + np.arange(length)[None, :]).ravel())
    second = _grams_at(X.second_hashes(data, words, used), starts, length, 7)
    at = np.searchsorted(a, first)
    keep = np.zeros(len(starts), bool)
    row = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    while len(live):  # one turn, but for windows whose first hashes are equal
        live = live[(at[live] < len(a))]
        live = live[a[at[live]] == first[live]]
        hit = b[at[live]] == second[live]
        keep[live[hit]], row[live[hit]] = True, at[live[hit]]
        live = live[~hit]
        at[live] += 1
    return starts[keep], row[keep]


def _grams_at(words: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    flat = words[(starts[:, None] + np.arange(k)[None, :]).ravel()]
    acc = np.full(len(starts), seed * 2 + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = (acc ^ flat[j::k]) * X._MULT
            acc ^= acc >> np.uint64(29)
    return X.mix(acc)


def hits(data: np.ndarray, words: X.Words, index: dict, window: int, kgram: int) -> tuple[np.ndarray, list[set[int]]]:
    """Which words (of the bytes ``data``) are hit, and for each document the numbers of the items found in it."""
    n = len(words.hash)
    edge = np.zeros(n + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(words.first) - 1)]
    for length, table in index["windows"].items():
        if length == window:
            at, prints = winnow(words.hash, words.first, kgram, window - kgram + 1)
            at = at[X.member(prints, index["prints"]) >= 0]
            starts = np.unique((at[:, None] - np.arange(window - kgram + 1)[None, :]).ravel())
            starts = starts[starts >= 0]
        else:
            starts = np.flatnonzero(X.member(X.grams(words.hash, length), table[0]) >= 0)
        ok = X.inside(words.first, n, length)
        starts = starts[starts < len(ok)]
        starts, rows = _matches(data, words, length, starts[ok[starts]], table)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
        _, _, bounds, item = table
        doc = np.searchsorted(words.first, starts, "right") - 1
        for d, r in set(zip(doc.tolist(), rows.tolist(), strict=True)):
            items[d].update(item[bounds[r] : bounds[r + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, items


def decontaminate(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, kgram: int = KGRAM, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: what of it occurs in benchmark items.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``.  Null and empty texts
    have no words and are clean; repeated rows each give their row; an empty ``items`` leaves all clean;
    an item row without words, or with a null id, is never found.  Other columns of either table are ignored.
    """
    out = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"),
    )
    schema = out.schema
    out = _through(out, items, item_id, item_text, block_bytes, lambda df, index: df.mapInArrow(_marker(index, window, kgram), schema), window, kgram)
    id_type = out.schema["doc_id"].dataType.simpleString()
    final = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return out.mapInArrow(_summary, final)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, kgram: int = KGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows in which no item's window occurs, with all their columns, whatever their names; no row moves.

    Null and empty texts have no words and stay, repeated rows and null ids are rows like others, texts of any length
    are read whole, and an empty table (of rows or of items) changes nothing.
    """
    schema = docs.schema
    return _through(docs, items, item_id, item_text, block_bytes, lambda df, index: df.mapInArrow(_passer(index, window, kgram, text), schema), window, kgram)


def _through(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, block_bytes: int, step, window: int, kgram: int) -> DataFrame:
    """Rows after a step with the table of each block of items, TABLES of them at a time."""
    held = []
    for block in _blocks(items, item_id, item_text, block_bytes):
        if len(held) == TABLES:
            rows = written(rows, "marked")
            for index in held:
                index.destroy()
            held = []
        held.append(broadcast_value(rows.sparkSession, index_items(block, window, kgram)))
        rows = step(rows, held[-1])
    return rows


def _passer(index, window: int, kgram: int, text: str):
    def run(batches):
        for batch in batches:
            for part in X.slices(batch, text):
                data, offsets = X.utf8(part.column(text))
                found = hits(data, X.scan(data, offsets, X.ALNUM), index.value, window, kgram)[1]
                yield part.filter(pa.array([not x for x in found], pa.bool_()))

    return run


def _blocks(items: DataFrame, item_id: str, text: str, limit: int):
    block, size = [], 0
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    for row in rows.toLocalIterator():
        n = len(row[1].encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def _marker(index, window: int, kgram: int):
    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                data, offsets = X.utf8(part.column("text"))
                words = X.scan(data, offsets, X.ALNUM)
                hit, found = hits(data, words, index.value, window, kgram)
                bits, names = part.column("hit").to_pylist(), part.column("items").to_pylist()
                for i in [i for i, x in enumerate(found) if x]:
                    now = hit[words.first[i] : words.first[i + 1]]
                    if bits[i] is not None:
                        now = now | np.unpackbits(np.frombuffer(bits[i], np.uint8), count=len(now)).astype(bool)
                    bits[i] = np.packbits(now).tobytes()
                    names[i] = sorted({*names[i], *(index.value["ids"][j] for j in found[i])})
                yield pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])

    return run


def _summary(batches):
    for batch in batches:
        for part in X.slices(batch, "text"):
            words = np.diff(X.scan(*X.utf8(part.column("text")), X.ALNUM).first)
            hit = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in part.column("hit").to_pylist()]
            items = [x or [] for x in part.column("items").to_pylist()]
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit]), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )
