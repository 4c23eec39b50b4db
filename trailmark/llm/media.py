"""Ogg media columns.

``to_ogg`` stores a payload as 8-bit samples in two logical streams: blocks of ``BLOCK`` samples go to
either in turn.  ``read_ogg`` verifies every page's checksum, reassembles packets from the lacing
values (over page borders too), separates the streams by serial number, derives each packet's time from
the granule positions, and puts the samples back in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

FRAME, BLOCK, RATE = 192, 1536, 8000
_HEAD = struct.Struct("<4sBBqIIIB")
_INFO = struct.Struct("<8sIIIQ")  # magic, rate, stream, streams, samples in the whole
_MAGIC = b"PCM8LOGG"
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """Checksum of a page (polynomial 04c11db7, not reflected, no inversion), by zlib's reflected one."""
    raw = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = ogg_crc(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def _pages(serial: int, data: bytes) -> list[bytes]:
    """The data pages of one stream: packets of BLOCK bytes, as many lacing values in a page as it takes."""
    whole = b"\xff" * (BLOCK // 255) + bytes([BLOCK % 255])
    full, rest = divmod(len(data), BLOCK)
    lacing = whole * full + (b"\xff" * (rest // 255) + bytes([rest % 255]) if rest else b"")
    out, at, done, carried = [], 0, 0, False
    parts = [lacing[i : i + 255] for i in range(0, len(lacing), 255)] or [b""]
    for number, part in enumerate(parts, 1):
        size = sum(part)
        ended = sum(v < 255 for v in part)
        done += ended
        last = number == len(parts)
        granule = (len(data) if last else done * BLOCK) if ended or last else -1
        out.append(_page(carried * 1 + last * 4, granule, serial, number, part, data[at : at + size]))
        at += size
        carried = bool(part) and part[-1] == 255
    return out


def encode(payload: bytes) -> bytes:
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    pages = [_page(2, 0, s + 1, 0, bytes([_INFO.size]), _INFO.pack(_MAGIC, RATE, s, 2, len(payload))) for s in (0, 1)]
    streams = [_pages(s + 1, b"".join(blocks[s::2])) for s in (0, 1)]
    for i in range(max(map(len, streams))):
        pages += [x[i] for x in streams if i < len(x)]
    return b"".join(pages)


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says of it; ValueError for anything that is not whole."""
    at, pages = 0, 0
    streams: dict[int, dict] = {}
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("a page header is cut short")
        mark, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        body = at + 27 + n
        lacing = media[at + 27 : body]
        end = body + sum(lacing)
        if mark != b"OggS" or version or end > len(media) or len(lacing) < n:
            raise ValueError("not an Ogg page")
        if ogg_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum")
        if bool(flags & 2) == (serial in streams):
            raise ValueError("a stream without its first page, or with two")
        st = streams.setdefault(serial, {"next": 0, "part": b"", "packets": [], "times": [], "end": False})
        if number != st["next"] or st["end"] or bool(flags & 1) != bool(st["part"]):
            raise ValueError("pages out of order")
        st["next"], st["end"] = number + 1, bool(flags & 4)
        ended, size = [], 0
        for v in lacing:
            size += v
            if v < 255:
                ended.append(st["part"] + media[body : body + size])
                st["part"], body, size = b"", body + size, 0
        st["part"] += media[body : body + size]
        if not flags & 2:
            time = granule  # of the last packet that ends here; those before it end earlier by their lengths
            times = []
            for p in reversed(ended):
                times.append(time - len(p))
                time -= len(p)
            st["packets"] += ended
            st["times"] += times[::-1]
        else:
            st["info"] = _INFO.unpack(ended[0])
        at, pages = end, pages + 1
    if len(streams) != 2 or any(not s["end"] or s["part"] or s["info"][0] != _MAGIC for s in streams.values()):
        raise ValueError("a stream does not end")
    slots = [(t // BLOCK * 2 + s["info"][2], p) for s in streams.values() for t, p in zip(s["times"], s["packets"], strict=True)]
    payload = b"".join(p for _, p in sorted(slots, key=lambda x: x[0]))
    info = next(iter(streams.values()))["info"]
    if len(payload) != info[4]:
        raise ValueError("samples are missing")
    return payload, {"pages": pages, "packets": sum(len(s["packets"]) for s in streams.values()), "rate": info[1], "streams": len(streams)}


def padded(data: bytes) -> bytes:
    return data.ljust(-(-max(len(data), 1) // FRAME) * FRAME, b" ")


def to_ogg(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text, padded with spaces to full frames, as an Ogg file.

    A null text is an empty one, of one frame of spaces; equal texts make equal files.
    """

    def run(batches):
        for batch in (part for whole in batches for part in X.slices(whole, "text")):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_ogg(stored: DataFrame) -> DataFrame:
    """What the files of a ``media`` column hold: the payload's size and digests, and features of the sound.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.
    A file that is damaged raises an error; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for stored in batch.column("media"):
                media = stored.as_py()
                data, info = decode(media)
                x = np.frombuffer(data, np.uint8)
                cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                feature = f"streams={info['streams']};pages={info['pages']};packets={info['packets']};seconds={len(data) / info['rate']:.3f};mean={int(x.sum()) / len(x):.4f};peak={int(x.max())};crossings={cross}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes")] + [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", *names])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
