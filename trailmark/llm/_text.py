"""Vectorised word scanning over Arrow string columns.

Everything here works on the raw UTF-8 bytes of a record batch: a word is a run of bytes of one
class, so no Python object is made per word.  Temporaries are bounded by ``PIECE`` bytes whatever
the length of a text; a result holds 24 bytes per word of the documents handled at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

PIECE = 1 << 20
SLICE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
ALNUM[65:91] = True
#: ``[^\x20\x09-\x0D]+``: all that is no white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

_MULT = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_OTHER = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_STEP = 0xD6E8FEB86659FD93
_POW = np.ones(PIECE + 1, np.uint64)
_INV = np.ones(PIECE + 1, np.uint64)


def _powers() -> None:
    with np.errstate(over="ignore"):
        for table, step in ((_POW, _STEP), (_INV, pow(_STEP, -1, 1 << 64))):
            table[1:] = np.uint64(step)
            np.multiply.accumulate(table, out=table)


_powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: their 64-bit hashes, where each document's words begin, and each word's bytes."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _lean() -> None:
    """In a worker, give memory back to the system instead of keeping it in Arrow's pool."""
    if TaskContext.get() is not None:
        pa.set_memory_pool(pa.system_memory_pool())


#: What operators keep in a worker from task to task, by their name, and how it is let go.
_KEPT: dict[str, object] = {}


def keeps(name: str, clear) -> None:
    """An operator keeps tables in its worker, and ``clear`` lets them go."""
    _KEPT[name] = clear


def only(name: str) -> None:
    """In a worker, the tables of one operator at a time are kept: those of others go."""
    if TaskContext.get() is not None:
        for other, clear in _KEPT.items():
            if other != name:
                clear()


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def _trim() -> None:
    """In a worker, give what was freed back to the system, so that it does not add up over the tasks of a worker."""
    if TaskContext.get() is not None and _libc() is not None:
        _libc().malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes of text, one row at least."""
    _lean()
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    _trim()


def scan(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Hashes of all words (runs of bytes in ``kind``, A-Z as a-z); a word ends with its document."""
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | heads[1:-1]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | heads[1:-1]
    end = np.flatnonzero(ends) + 1
    return Words(mix(hash_spans(data, start, end, _BYTE)), np.searchsorted(start, offsets), start, end)


def second_hashes(data: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
    """Hashes of some words (their rising numbers) that are independent of the first ones; 0 for all others."""
    out = np.zeros(len(words.hash), np.uint64)
    out[which] = mix(hash_spans(data, words.start[which], words.end[which], _OTHER))
    return out


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span of bytes (spans rise and don't overlap); ``table`` gives a value for each byte."""
    out = np.empty(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            base = start[at]
            to = int(np.searchsorted(end, base + PIECE, "right"))
            if to <= at:  # one span longer than a piece
                out[at] = _long_word(data[base : end[at]], table)
                at += 1
                continue
            span = data[base : end[to - 1]]
            total = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(table[span] * _POW[: len(span)], out=total[1:])
            a, b = start[at:to] - base, end[at:to] - base
            out[at:to] = (total[b] - total[a]) * _INV[a]
            at = to
    return out


def hash_strings(column: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each string, upper and lower case apart; other seeds give independent hashes."""
    data, offsets = utf8(column)
    table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    return mix(hash_spans(data, offsets[:-1], offsets[1:], table) ^ np.uint64(seed))


def _long_word(span: np.ndarray, table: np.ndarray) -> np.uint64:
    value = np.uint64(0)
    for i in range(0, len(span), PIECE):
        part = span[i : i + PIECE]
        shift = np.uint64(pow(_STEP, i, 1 << 64))
        value += (table[part] * _POW[: len(part)]).sum(dtype=np.uint64) * shift
    return value


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words, over document boundaries too (callers mask those)."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, seed * 2 + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ words[j : j + n]) * _MULT
            out ^= out >> np.uint64(29)
    return mix(out)


def inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each run of k words: does it lie in one document?"""
    n = max(0, n_words - k + 1)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 if it is not there."""
    if not len(table) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i]+length[i]-1 for all i, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.cumsum(length) - length
    return np.arange(total) - np.repeat(lead - start, length)
