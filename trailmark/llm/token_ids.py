"""Token-id files with a minimal perfect hash index.

``write`` puts each range of documents into a shard: ``shard-NNNNN.ids`` holds the raw ids of its
documents in ascending id order, little-endian, two bytes each where the vocabulary allows and else
four; ``shard-NNNNN.mph`` maps a document's key to its place.  The index is a cascade of bit arrays: a
key that is alone at its place on one level stays there, the others go on to the next.  The rank of its
bit is its slot, and the slot holds a 32-bit fingerprint of the key (an unknown key is refused with
probability 1 - 2**-32), the first id and the number of ids.  A look-up reads a fixed number of places.

Files are written under a temporary name and renamed, so a task that is run again leaves the same file.
They go to any store that pyarrow's file systems reach.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._encode import encoded, encoder

MAGIC = b"TMIDX1\n"
LEVELS, ROOM = 48, 2.0
#: Bytes of text in a shard, about, and documents whose ids are read at once.
SHARD_BYTES, READ_ROWS = 256 << 20, 50_000


def keys_of(doc_ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The 64-bit keys of documents: of the id, and of which of equal ids it is."""
    return X.mix(X.mix(doc_ids.astype(np.int64).view(np.uint64)) ^ (nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        counts = [np.cumsum(np.concatenate([[0], np.bitwise_count(b)])) for b in bits]
        base = np.cumsum([0] + [int(c[-1]) for c in counts])
        self.rank = [c + b for c, b in zip(counts, base[:-1], strict=True)]
        self.n = int(base[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (X.mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, -(-int(ROOM * len(keys)) // 64) * 64)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(size, np.uint8)
            flags[at[alone]] = 1
            sizes.append(size)
            bits.append(np.packbits(flags, bitorder="little").view("<u8"))
            keys = keys[~alone]
        if len(keys):
            raise ValueError("keys are not distinct")
        return cls(sizes, bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, any slot or -1 for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(zip(self.sizes, self.bits, self.rank, strict=True)):
            at = self._place(keys[todo], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = rank[word] + np.bitwise_count(below)
            out[todo[hit]] = slot[hit]
            todo = todo[~hit]
        return out


def _nth(ids: np.ndarray) -> np.ndarray:
    """For sorted ids: how many equal ones stand before each."""
    start = np.searchsorted(ids, ids, "left")
    return np.arange(len(ids)) - start


def _index_bytes(ids: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> bytes:
    keys = keys_of(ids, _nth(ids))
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    prints, starts, lengths = np.zeros(len(ids), "<u4"), np.zeros(len(ids), "<u8"), np.zeros(len(ids), "<u8")
    prints[slot] = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    starts[slot], lengths[slot] = start, length
    head = json.dumps({"n": len(ids), "width": width, "sizes": mph.sizes}).encode()
    out = io.BytesIO()
    out.write(MAGIC + len(head).to_bytes(4, "little") + head)
    for part in [*mph.bits, prints, starts, lengths, ids.astype("<i8")]:
        out.write(part.tobytes())
    return out.getvalue()


class Shard:
    """One shard: its index, and a function that reads a range of bytes of its ids."""

    def __init__(self, ids, index: bytes):
        if not index.startswith(MAGIC):
            raise ValueError("not a token index")
        at = len(MAGIC) + 4
        size = int.from_bytes(index[len(MAGIC) : at], "little")
        head = json.loads(index[at : at + size])
        at += size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, n, at)
            at += out.nbytes
            return out

        self.mph = PerfectHash(head["sizes"], [take("<u8", s // 64) for s in head["sizes"]])
        self.prints, self.starts, self.lengths, self.doc_ids = (take(k, head["n"]) for k in ("<u4", "<u8", "<u8", "<i8"))
        self.width = head["width"]
        self.read = (lambda at, size: ids[at : at + size]) if isinstance(ids, bytes) else ids

    def ids(self, start: int, length: int) -> np.ndarray:
        """A range of ids; no more than that is read."""
        return np.frombuffer(self.read(start * self.width, length * self.width), f"<u{self.width}")

    def find(self, doc_ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 and 0 for keys that the shard does not hold."""
        keys = keys_of(doc_ids, nth)
        slot = self.mph.slots(keys)
        ok = (slot >= 0) & (len(self.prints) > 0)
        ok[ok] &= self.prints[slot[ok]] == (keys[ok] & np.uint64(0xFFFFFFFF))
        start, length = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        start[ok], length[ok] = self.starts[slot[ok]], self.lengths[slot[ok]]
        return start, length


def _store(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _put(folder: str, name: str, chunks) -> None:
    store, base = _store(folder)
    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(temp, f"{base}/{name}")


def _reader(folder: str, name: str):
    """A function that reads ranges of a file, which stays open."""
    store, base = _store(folder)
    file = store.open_input_file(f"{base}/{name}")
    return lambda at, size: file.read_at(size, at)


def _get(folder: str, name: str) -> bytes:
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        return f.read()


def write(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode all texts and write them; returns ``shard, n_docs, n_tokens`` (running it writes).

    Shards are ranges of ids, so all ids of one document's shard precede those of the next; an id that many rows
    share goes on in the next shard.  There are as many as the texts' bytes ask for (SHARD_BYTES), and as the session
    has shuffle partitions at least.  Ids must be numbers (a text that is none is an error).  Rows with a null id are
    not addressable and are written under the least id there is.
    """
    spark = docs.sparkSession
    n = shards
    if not n:
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    least = F.lit(-(1 << 63)).cast("long")
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), least).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the second key makes equal ids come in one order, whichever task reads them first, and divides an id that is hot
    ranged = base.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:05d}"
        tokens = encoder(tokenizer, True)
        width = 2 if max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys, sizes, wrote = [], [], 0

        def chunks():
            nonlocal wrote
            for part, ids, edge in encoded(batches, tokens):
                out = np.insert(ids.astype(f"<u{width}", copy=False), edge[1:], end_id)
                keys.append(part.column("doc_id").to_numpy())
                sizes.append(np.diff(edge) + 1)
                wrote += len(out)
                yield out.tobytes()

        _put(folder, f"{name}.ids", chunks())
        doc_ids = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        length = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        _put(folder, f"{name}.mph", [_index_bytes(doc_ids, np.cumsum(length) - length, length, width)])
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([wrote], pa.int64())], ["shard", "n_docs", "n_tokens"])

    return ranged.mapInArrow(run, "shard int, n_docs long, n_tokens long")


def read(spark: SparkSession, folder: str, summary: list[tuple[int, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, by look-ups in the files of all shards.

    ``summary`` has one row for each shard (their number is a setting, not the input's).
    """
    first, at = {}, 0
    for shard, _, n in sorted(summary):
        first[shard] = at
        at += n
    n = len(first)
    todo = spark.range(0, n, 1, max(n, 1)).select(F.col("id").cast("int").alias("shard"))
    names = sorted(first)

    def run(batches):
        for batch in batches:
            for i in batch.column("shard").to_pylist():
                name = f"shard-{names[i]:05d}"
                shard = Shard(_reader(folder, f"{name}.ids"), _get(folder, f"{name}.mph"))
                nth = _nth(shard.doc_ids)
                for lo in range(0, len(shard.doc_ids), READ_ROWS):
                    ids = shard.doc_ids[lo : lo + READ_ROWS]
                    start, length = shard.find(ids, nth[lo : lo + READ_ROWS])
                    crc = [zlib.crc32(shard.ids(a, k).astype("<u4").tobytes()) for a, k in zip(start.tolist(), length.tolist(), strict=True)]
                    yield pa.record_batch([pa.array(ids), pa.array(start + first[names[i]]), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    got = todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def token_ids(docs: DataFrame, folder: str, tokenizer: str, **options) -> DataFrame:
    """Write all documents' ids below ``folder`` and give what the files hold of each.

    Returns ``doc_id, start, n_tokens, ids_crc32``: ids of all documents before it, its ids with the end
    id, and their checksum as 32-bit values.  A null text is empty and has the end id alone; rows with
    equal ids each keep their own entry, in an order set by their texts; an empty table gives empty files.
    """
    summary = [tuple(r) for r in write(docs, folder, tokenizer, **options).collect()]  # a row for each shard
    return read(docs.sparkSession, folder, summary)
