"""Lane-mask images: grey pixels, border pixels, outlines and polylines in metres."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import EDGE_TYPES
from ..operators import mapgraph as G

#: Metres of a pixel.
PIXEL = 0.0375
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The eight neighbours of a pixel in turn, as (row, column).
_RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def png_pixels(content: bytes) -> np.ndarray:
    """Grey values of an 8-bit PNG without interlacing (grey, colour or palette, alpha ignored)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, palette, head = 8, [], None, None
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit images without interlacing")
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * n + 1)
    pixels = _unfiltered(raw[:, 0], raw[:, 1:], n).reshape(height, width, n)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3].astype(float) @ [0.299, 0.587, 0.114]).astype(np.uint8)


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Undo the five row filters; only averages and Paeth predictions need a walk along the row."""
    out = np.zeros(rows.shape, np.uint8)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = row + above
        else:
            now = np.zeros(len(row) + n, np.int64)
            up = np.concatenate([np.zeros(n, np.int64), above.astype(np.int64)])
            for i, v in enumerate(row.tolist(), n):
                a, b, c = int(now[i - n]), int(up[i]), int(up[i - n])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    away = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    guess = (a, b, c)[away.index(min(away))]
                now[i] = (v + guess) & 255
            now = now[n:].astype(np.uint8)
        out[y] = above = now
    return out


def pgm_pixels(content: bytes) -> np.ndarray:
    """Grey values of a plain 8-bit PGM image."""
    width, height, _ = (int(v) for v in content[2:].split(None, 3)[:3])
    return np.frombuffer(content[-width * height :], np.uint8).reshape(height, width)


def pixels_of(content: bytes) -> np.ndarray:
    if content[:2] == b"P5":
        return pgm_pixels(content)
    return png_pixels(content)


def border_mask(grey: np.ndarray) -> np.ndarray:
    """Black pixels that touch a white one: black, but white once white has grown by a pixel to all eight sides."""
    wide = np.pad(grey > 0, 1)
    h, w = grey.shape
    grown = np.zeros((h, w), bool)
    for dy in range(3):
        for dx in range(3):
            grown |= wide[dy : dy + h, dx : dx + w]
    return grown & (grey == 0)


def _flood(seeds: list[tuple[int, int]], free: np.ndarray, steps) -> np.ndarray:
    """All free pixels that are reached from the seeds."""
    seen = np.zeros(free.shape, bool)
    front = [s for s in seeds if free[s]]
    for s in front:
        seen[s] = True
    while front:
        y, x = front.pop()
        for dy, dx in steps:
            to = (y + dy, x + dx)
            if 0 <= to[0] < free.shape[0] and 0 <= to[1] < free.shape[1] and free[to] and not seen[to]:
                seen[to] = True
                front.append(to)
    return seen


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border of each outermost group of touching pixels, as rows of (x, y) in the order of a walk round it."""
    wide = np.pad(mask, 1)
    outside = _flood([(0, 0)], ~wide, [(0, 1), (1, 0), (0, -1), (-1, 0)])
    left = wide.copy()
    out = []
    for y, x in np.argwhere(wide).tolist():
        if not left[y, x]:
            continue
        left &= ~_flood([(y, x)], wide & left, _RING)
        if not outside[y, x - 1]:  # its first pixel is within another group
            continue
        path, at, way = [(x - 1, y - 1)], (y, x), 4
        first = None
        while True:
            for turn in range(1, 9):
                k = (way + turn) % 8
                to = (at[0] + _RING[k][0], at[1] + _RING[k][1])
                if wide[to]:
                    break
            else:
                break  # a single pixel
            if first is None:
                first = (at, to)
            elif (at, to) == first:
                path.pop()
                break
            at, way = to, (k + 4) % 8
            path.append((at[1] - 1, at[0] - 1))
        out.append(np.array(path, float))
    return out


def lane_lines(spark: SparkSession, path: str, metres: float = PIXEL, least: float = 3.0) -> DataFrame:
    """Outlines of the dark borders in lane-mask images as polyline points in metres, ``least`` metres apart, dashed thin lines."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.\w+$", 1).alias("map_id"), "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["map_id"], batch["content"], strict=True):
                for i, line in enumerate(outlines(border_mask(pixels_of(content)))):
                    if len(line) > 1:
                        yield pd.DataFrame({"map_id": name, "line_id": str(i), "pos": np.arange(len(line), dtype="int32"), "x": line[:, 0] * metres, "y": line[:, 1] * metres})

    points = files.mapInPandas(run, "map_id string, line_id string, pos int, x double, y double")
    return G.thin(points, least).withColumn("edge_type", F.lit(EDGE_TYPES["LINE_THIN_DASHED"]))


def image_maps(points: DataFrame, x_max: float = 0.0) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The ``lower`` and ``upper`` map of lane_lines(): edges both ways, mirrored nodes of the lines' type."""
    several = points.join(points.groupBy("map_id", "line_id").count().where("count > 1").drop("count"), ["map_id", "line_id"])
    nodes, edges = G.graph(several)
    lower, upper = G.mirrored(nodes.withColumn("node_type", F.lit(EDGE_TYPES["LINE_THIN_DASHED"])), x_max)
    both = G.both_ways(edges).distinct()
    return {"lower": (lower, both), "upper": (upper, both)}
