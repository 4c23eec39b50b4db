"""Binary recordings: framed protobuf scenarios, SQLite databases, chunked structured arrays.

Files come through Spark's ``binaryFile`` reader, one row each, so any store that Spark reads will do;
decoding runs in Arrow batches on the executors.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pieces


def records(data: bytes) -> Iterator[bytes]:
    """Payloads of a record file: length (8 bytes), its checksum (4), payload, its checksum (4)."""
    at = 0
    while at + 12 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            raise ValueError("a record is cut short")
        yield data[at + 12 : at + 12 + n]
        at += 16 + n


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """``number, wire type, value`` of a protobuf message; nested messages and fixed-width values are bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):  # fixed width: left as bytes
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield number, kind, value


def real(kind: int, value) -> float:
    """A number of any wire type as a float."""
    return struct.unpack("<d" if kind == 1 else "<f", value)[0] if kind in (1, 5) else float(value)


def packed(kind: int, value) -> list[int]:
    """The integers of a repeated field, which may be packed."""
    if kind != 2:
        return [value]
    if value.isascii():  # a byte each
        return list(value)
    out, at = [], 0
    while at < len(value):
        one, at = _varint(value, at)
        out.append(one)
    return out


# Field numbers of the public scenario messages, and object types.
STATE = {2: "x", 3: "y", 8: "psi", 9: "vx", 10: "vy", 11: "valid"}
OBJECTS = {1: "car", 2: "pedestrian", 3: "bicycle"}
FEATURES = {3: "lane", 4: "road_line", 5: "road_edge", 7: "stop_sign", 8: "crosswalk", 9: "speed_bump", 10: "driveway"}


def scenario_rows(payload: bytes, what: tuple[str, ...] = ("tracks", "points")) -> tuple[str, list[tuple], list[tuple]]:
    """A scenario's id, its track rows and its map points; empty what is not asked for."""
    name, tracks, features, ego, interest = "", [], [], -1, []
    for number, kind, value in fields(payload):
        if number == 5:
            name = value.decode()
        elif number == 2 and "tracks" in what:
            tracks.append(value)
        elif number == 8 and "points" in what:
            features.append(value)
        elif number == 6:
            ego = value
        elif number == 4:
            interest += packed(kind, value)
    rows, points = [], []
    for i, track in enumerate(tracks):
        track_id, kind, states = 0, 0, []
        for number, _, value in fields(track):
            if number == 1:
                track_id = value
            elif number == 2:
                kind = value
            elif number == 3:
                states.append(value)
        for frame, state in enumerate(states):
            got = {STATE[n]: real(k, v) for n, k, v in fields(state) if n in STATE}
            if got.get("valid"):
                rows.append((name, frame, -1 if i == ego else track_id, *(got.get(c, 0.0) for c in ("x", "y", "vx", "vy", "psi")), OBJECTS.get(kind, "undefined"), track_id in interest))
    for feature in features:
        number_of, line, kind, sub = 0, "", 0, b""
        for number, _, value in fields(feature):
            if number == 1:
                number_of = value
            elif number in FEATURES:
                line, sub = FEATURES[number], value
        # Where each kind of feature has its points (lanes 8; stop signs 2; polygons 1; lines 2) and its type.
        spot = {"lane": 8, "stop_sign": 2, "road_line": 2, "road_edge": 2}.get(line, 1)
        for number, wire, value in fields(sub):
            if number == 1 and wire == 0 and line in ("road_line", "road_edge"):
                kind = value
            if number == spot and wire == 2:
                p = {n: real(k, v) for n, k, v in fields(value)}
                points.append((name, number_of, line, kind, len(points), p.get(1, 0.0), p.get(2, 0.0)))
    return name, rows, points


_TRACKS = "rec_id string, frame int, track_id bigint, x double, y double, vx double, vy double, psi double, agent_type string, of_interest boolean"
_POINTS = "map_id string, line_id bigint, kind string, type int, pos int, x double, y double"


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def scenarios(spark: SparkSession, path: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks and map points of record files of protobuf scenarios.

    Files are read record by record.  With ``store``, a folder that all executors reach, decoded scenarios are written
    there once and both tables come from it; without it each table decodes for itself, and nothing of the other.
    """
    from .rows import records_of

    kinds = {"tracks": _TRACKS, "points": _POINTS}
    decode = lambda *what: records_of(spark, path).mapInPandas(_decoded(what), ", ".join(f"{k} array<struct<{_struct(kinds[k])}>>" for k in what))
    if store:
        decode("tracks", "points").write.mode("errorifexists").parquet(store)
        decoded = spark.read.parquet(store)
        return decoded.select(F.inline("tracks")), decoded.select(F.inline("points"))
    return decode("tracks").select(F.inline("tracks")), decode("points").select(F.inline("points"))


def _struct(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (c.strip().split(" ") for c in schema.split(",")))


def _decoded(what: tuple[str, ...]):
    names = {"tracks": _names(_TRACKS), "points": _names(_POINTS)}

    def run(batches):
        for batch in batches:
            out = {key: [] for key in what}
            for payload in batch["payload"]:
                _, tracks, points = scenario_rows(payload, what)
                for key, rows in (("tracks", tracks), ("points", points)):
                    if key in out:
                        out[key].append([dict(zip(names[key], r, strict=True)) for r in rows])
            yield pd.DataFrame(out)

    return run


# Field numbers of the semantic map's messages, and edge types of its boundaries' numbers.
BOUNDARIES = {
    0: "NONE", 1: "VIRTUAL", 2: "LINE_THIN", 3: "LINE_THIN", 4: "LINE_THIN_DASHED", 5: "LINE_THIN_DASHED", 6: "LINE_THIN_DOUBLE", 7: "LINE_THIN_DOUBLE",
    8: "LINE_THIN_DOUBLE_DASHED", 9: "LINE_THIN_DOUBLE_DASHED", 10: "CURB", 11: "CURB", 12: "CURB",
}
_ELEMENTS, _SEGMENT, _LANE, _JUNCTION = 2, 1, 3, 5


def _one(message: bytes, number: int):
    """The last value of a field, None if it is not there."""
    found = None
    for n, _, value in fields(message):
        if n == number:
            found = value
    return found


def _global_id(message: bytes | None) -> str:
    return (_one(message or b"", 1) or b"").decode()


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _local_to_earth(p: np.ndarray, lat, lon) -> np.ndarray:
    """Rows of east, north, up about places on the ellipsoid (radians) as earth-centred rows."""
    a, flat = 6378137.0, 1 / 298.257223563
    e2 = flat * (2 - flat)
    s, c, sl, cl = np.sin(lat), np.cos(lat), np.sin(lon), np.cos(lon)
    curve = a / np.sqrt(1 - e2 * s * s)
    east, north, up = p.T
    along = curve * c + c * up - s * north
    return np.stack([along * cl - sl * east, along * sl + cl * east, curve * (1 - e2) * s + c * north + s * up], axis=1)


def boundary_types(kinds: list[int], changes: list[float], steps: list[float]) -> list[str]:
    """The edge type from each point to the next: a boundary's next kind begins after the point at which the way since the last change reaches a change's distance."""
    if not kinds:
        return ["NONE"] * len(steps)
    out, way, at = [], 0.0, 0
    for step in steps:
        out.append(BOUNDARIES.get(kinds[at], "NONE"))
        way += step
        if at < min(len(changes), len(kinds) - 1) and way >= changes[at]:
            at, way = at + 1, 0.0
    return out


def _boundary(message: bytes) -> tuple[list[list[int]], list[int], list[float]]:
    """Deltas along the three axes (none unless all are there), kinds and the distances of changes."""
    deltas, kinds, changes = {1: [], 2: [], 3: []}, [], []
    for n, k, v in fields(message):
        if n in deltas:
            deltas[n] += [_signed(d) for d in packed(k, v)]
        elif n == 4:
            kinds += packed(k, v)
        elif n == 5:
            changes += [d * 0.01 for d in packed(k, v)]
    return (list(deltas.values()) if all(deltas.values()) else [[], [], []]), kinds, changes


def semantic_element(element: bytes, lanes: bool = True, roles: bool = True):
    """``segment`` or ``junction`` with the ids of its lanes, or ``lane`` with its id, place (degrees) and boundaries; None for others."""
    body = _one(element, 2) or b""
    for number, _, value in fields(body):
        if number in (_SEGMENT, _JUNCTION):
            return (("segment" if number == _SEGMENT else "junction"), [_global_id(v) for n, _, v in fields(value) if n == (12 if number == _SEGMENT else 3)]) if roles else None
        if number == _LANE:
            if not lanes:
                return None
            origin = _one(_one(value, 2) or b"", 1) or b""
            place = {n: struct.unpack("<i", v)[0] * 1e-7 for n, k, v in fields(origin) if n in (1, 2) and k == 5}
            return "lane", (_global_id(_one(element, 1)), (place.get(1, 0.0), place.get(2, 0.0)), [_boundary(_one(value, side) or b"") for side in (3, 4)])
    return None


def lane_points(lanes: list, to_world: np.ndarray) -> pd.DataFrame:
    """``lane, what (left or right), pos, x, y, edge_type`` of many lanes at once; centimetres add up as whole numbers."""
    from ..functions.codes import EDGE_TYPES

    sides = [(name, side, *place, *boundary) for name, place, both in lanes for side, boundary in zip(("left", "right"), both, strict=True)]
    sizes = np.array([len(s[4][0]) for s in sides], int)
    ends = np.cumsum(sizes)
    sums = np.cumsum(np.array([[d for s in sides for d in s[4][axis]] for axis in range(3)], np.int64).reshape(3, -1), axis=1)
    before = np.hstack([np.zeros((3, 1), np.int64), sums])[:, ends - sizes]
    local = (sums - np.repeat(before, sizes, axis=1)).T * 0.01
    at = np.repeat(np.radians(np.array([s[2:4] for s in sides], float).reshape(-1, 2)), sizes, axis=0)
    points = _local_to_earth(local, at[:, 0], at[:, 1]) @ to_world[:3, :3].T + to_world[:3, 3]
    steps = np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)).tolist()
    kinds = []
    for (*_, marks, changes), end, n in zip(sides, ends.tolist(), sizes.tolist(), strict=True):
        own = boundary_types(marks, changes, steps[end - n : end - 1] if n else [])
        kinds += [EDGE_TYPES["VIRTUAL" if k == "NONE" else k] for k in (*own, "NONE")[:n]]
    column = lambda i: np.repeat(np.array([s[i] for s in sides], object), sizes)
    pos = np.arange(len(points)) - np.repeat(ends - sizes, sizes)
    return pd.DataFrame({"lane": column(0), "what": column(1), "pos": pos, "x": points[:, 0], "y": points[:, 1], "edge_type": np.array(kinds, int)})


def semantic_map(spark: SparkSession, path: str, world_to_ecef: list[list[float]], map_id: str = "map") -> DataFrame:
    """Typed polylines of a protobuf semantic map: both boundaries of the lanes of road segments, the left one of others in junctions.

    Each lane comes once; where a boundary has no type it is VIRTUAL.  Lanes in neither a segment nor a junction are
    left out.  Deltas are centimetres along the axes of each lane's frame.
    """
    to_world = np.linalg.inv(np.array(world_to_ecef, float))
    files = spark.read.format("binaryFile").load(path).select("content")

    def split(batches):
        for batch in batches:
            for content in batch["content"]:
                elements = [v for n, _, v in fields(content) if n == _ELEMENTS]
                for i in range(0, len(elements), 1000):
                    yield pd.DataFrame({"element": elements[i : i + 1000]})

    def roles(batches):
        for batch in batches:
            found = [semantic_element(e, lanes=False) for e in batch["element"]]
            yield pd.DataFrame([(lane, f[0]) for f in found if f for lane in f[1]], columns=["lane", "what"])

    def decode(batches):
        for batch in batches:
            for i in range(0, len(batch), 1000):
                found = [semantic_element(e, roles=False) for e in batch["element"][i : i + 1000]]
                yield lane_points([f[1] for f in found if f], to_world)

    elements = files.mapInPandas(split, "element binary").repartition(max(pieces(files, 1), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    role = elements.mapInPandas(roles, "lane string, what string").groupBy("lane").agg((F.max("what") == "segment").alias("both"))
    found = elements.mapInPandas(decode, "lane string, what string, pos int, x double, y double, edge_type int")
    lines = found.join(role, "lane").where((F.col("what") == "left") | F.col("both"))
    return lines.select(F.lit(map_id).alias("map_id"), F.concat_ws("-", "lane", "what").alias("line_id"), "pos", "x", "y", "edge_type")


def sqlite_tables(spark: SparkSession, path: str, prefix: str, schema: str) -> DataFrame:
    """The rows of all tables of SQLite files whose name starts with ``prefix``; adds ``table_name``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = _names(schema)

    def run(batches):
        import sqlite3

        for batch in batches:
            for content in batch["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                    if table.startswith(prefix):
                        cursor = db.execute(f'SELECT {", ".join(names)} FROM "{table}"')
                        while rows := cursor.fetchmany(50_000):
                            yield pd.DataFrame(rows, columns=names).assign(table_name=table)[["table_name", *names]]
                db.close()

    return files.mapInPandas(run, f"table_name string, {schema}")


def drone_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of a trajectory database: ``rdb*`` tables, seconds to frames, classes in lower case."""
    from ..operators.relations import dense_frame

    schema = "timestamp double, object_id bigint, utm_x double, utm_y double, utm_angle double, velocity double, acceleration double, object_category string, trailer_id bigint"
    t = sqlite_tables(spark, path, "rdb", schema).withColumnRenamed("table_name", "rec_id")
    t = dense_frame(t, "rec_id", F.round("timestamp", 4))
    # Two classes go by another name here.
    kind = F.lower("object_category")
    kind = F.when(kind == "heavy vehicle", "truck").when(kind == "medium vehicle", "van").otherwise(kind)
    return t.select("rec_id", F.col("object_id").alias("track_id"), "frame", F.col("utm_x").alias("x"), F.col("utm_y").alias("y"), F.col("utm_angle").alias("psi"), F.col("velocity").alias("speed"), kind.alias("agent_type"), "trailer_id")


def _hidden_text(spark: SparkSession, path: str) -> str:
    """A small file that Spark's readers skip for its name, through the same file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def chunked_array(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A one-dimensional chunked array of structures (version 2 layout): ``pos`` and the columns asked for.

    One row of ``binaryFile`` per chunk; chunks may be plain, zlib, gzip or zstd.
    """
    info = json.loads(_hidden_text(spark, f"{path}/.zarray"))
    if len(info["shape"]) != 1:
        raise ValueError("not a one-dimensional array")
    kind = np.dtype([tuple(tuple(x) if isinstance(x, list) else x for x in f) for f in info["dtype"]])
    size, total, packed = info["chunks"][0], info["shape"][0], (info["compressor"] or {}).get("id")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(path)
    files = files.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("chunk"), "content")

    def run(batches):
        for batch in batches:
            for chunk, content in zip(batch["chunk"], batch["content"], strict=True):
                if packed in ("zlib", "gzip"):
                    content = zlib.decompress(content, 47)
                elif packed == "zstd":
                    import zstandard

                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=size * kind.itemsize)
                elif packed:
                    raise ValueError(f"compressor {packed} is not supported")
                rows = np.frombuffer(content, kind)[: max(0, total - chunk * size)]
                out = {"pos": np.arange(len(rows)) + chunk * size}
                for c in columns:
                    out[c] = list(rows[c]) if rows[c].ndim > 1 else rows[c].astype(str) if rows[c].dtype.kind in "SU" else rows[c]
                yield pd.DataFrame(out)

    return files.mapInPandas(run, "pos bigint, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
